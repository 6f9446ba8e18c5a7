"""Cut lineage by writing a frame to the folder the cluster shares.

Frames that several later jobs read (the de-duplicated lines, the order rollup,
range-split rankings) are written once as Parquet under ``spark.checkpoint.dir``
and read back. Unlike a cache this survives lost executors, and unlike an RDD
checkpoint it stays columnar: readers prune columns and push filters.

The caller names the folder; nothing here makes one up. On a cluster a path without a remote file
system may be a mount that all machines share or a disk of each: executors try it out once, and the
rows of each table staged there are counted.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: per thread the lists of open :func:`passing` blocks
_LOCAL = threading.local()
#: (application, folder) that executors were seen to share although it looks like one machine's
_TRIED: set[tuple[str, str]] = set()


def named_folder(spark: SparkSession) -> str | None:
    """The shared folder the session names, if it names one."""
    return spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()


def _in_doubt(spark: SparkSession, root: str) -> bool:
    """On a cluster: a mounted folder and one of a machine's own have the same kind of path."""
    return not spark.sparkContext.master.startswith("local") and root.startswith(("file:", "/"))


def _own_folder(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/tillroll-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """This application's staging folder inside the cluster's shared folder."""
    root = named_folder(spark)
    if not root:
        raise RuntimeError(
            f"set {_SETTING} to a folder all executors can reach; staged tables are kept there"
        )
    if _in_doubt(spark, root) and (spark.sparkContext.applicationId, root) not in _TRIED:
        raise RuntimeError(f"{_SETTING} is {root}: a folder of one machine, on a cluster")
    return _own_folder(spark, root)


def try_folder(spark: SparkSession) -> None:
    """Let executors write to a folder in doubt; :func:`shared_folder` takes it if nothing is lost.

    Several small tasks per core write a file each. The driver does not find a file that an
    executor put on a disk of its own.
    """
    root, application = named_folder(spark), spark.sparkContext.applicationId
    if not root or not _in_doubt(spark, root) or (application, root) in _TRIED:
        return
    n = 4 * spark.sparkContext.defaultParallelism
    path = f"{_own_folder(spark, root)}/trial-{uuid.uuid4().hex}"
    try:
        rows = spark.range(0, n, 1, n)
        rows.write.parquet(path)
        if len(spark.read.schema(rows.schema).parquet(path).inputFiles()) == n:
            _TRIED.add((application, root))
    finally:
        remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    try_folder(spark)
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def check_whole(found: DataFrame, written: int, folder: str) -> None:
    """Refuse a folder that does not hold as many lines as were written to it."""
    if (n := found.count()) != written:
        raise RuntimeError(f"{written} lines written, {n} found: do all executors share {folder}?")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of that table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for scope in _open_scopes():
        scope.append(path)
    # an executor that came after the trial may have a disk of its own there
    seen = Observation() if _in_doubt(spark, path) else None
    counted = df.observe(seen, F.count("*").alias("lines")) if seen else df
    counted.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    if seen:
        check_whole(staged, seen.get["lines"], path)
    return staged


def _open_scopes() -> list[list[str]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def n_files(spark: SparkSession, path: str) -> int:
    """Files below a folder of any file system; 0 if it is not there."""
    fs, folder = _file_system(spark, path)
    return fs.getContentSummary(folder).getFileCount() if fs.exists(folder) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system, if it is there."""
    fs, folder = _file_system(spark, path)
    fs.delete(folder, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what this thread stages inside.

    For steps that end in a table of their own: nothing staged inside may be read afterwards.
    """
    scopes, own = _open_scopes(), []
    scopes.append(own)
    try:
        yield
    finally:
        scopes.remove(own)
        for path in own:
            remove(spark, path)


def clear_staged(spark: SparkSession) -> None:
    """Remove every table this application has staged; frames that read them end with it."""
    try_folder(spark)
    remove(spark, shared_folder(spark))
