"""The shared folder of the registered queries, when the session names none."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from tillroll.plans.staging import named_folder, try_folder


def ensure_folder(spark: SparkSession) -> None:
    """Give a session on this one machine a folder of its own; a cluster must name a shared one."""
    if not named_folder(spark) and spark.sparkContext.master.startswith("local"):
        # a running session refuses to set spark.checkpoint.dir
        spark.sparkContext.setCheckpointDir(os.path.realpath(tempfile.mkdtemp(prefix="tillroll-")))
    try_folder(spark)
