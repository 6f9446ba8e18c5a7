"""What the corpus operators share: tables, the shared folder, words, checksums, size words."""

from __future__ import annotations

import contextlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.plans.staging import named_folder

#: fixed values: the white space that ends a word, `[\x20\x09-\x0D]`
SPACES = " \t\n\x0b\x0c\r"


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors; name a shared folder where none is set.

    The folder is set on a single machine only (tests, smoke runs): a cluster names its own.
    """
    if not named_folder(spark) and spark.sparkContext.master.startswith("local"):
        # a running session refuses to set spark.checkpoint.dir
        spark.sparkContext.setCheckpointDir(str(Path(tempfile.mkdtemp(prefix="tillroll-")).resolve()))
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tillroll-code-")) / "tillroll_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in package.rglob("*.py"):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_rows(docs: DataFrame, **named: Column) -> DataFrame:
    """Every row as one struct ``doc`` beside the columns ``named``: no name can clash."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("doc"), *(c.alias(n) for n, c in named.items()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null and empty text have none."""
    one_space = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(one_space, " "), lambda w: w != "")


#: remove a query's shuffle files when it has ended, not when the driver collects its garbage
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaning_shuffles(spark: SparkSession) -> Iterator[None]:
    """For operators of several large exchanges, each of which ends in a staged table."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def drop_staged(tables: list[DataFrame]) -> None:
    """Remove staged tables that nothing reads any more."""
    for table_ in tables:
        spark = table_.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table_.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
