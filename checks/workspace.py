"""What the registered queries share in one session: feeds, fact and context of a folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from checks import star
from checks.folder import ensure_folder
from tillroll.operators.clean import Cleaning
from tillroll.operators.slices import Slice
from tillroll.plans.context import Context
from tillroll.plans.staging import n_files, new_path, shared_folder
from tillroll.sources.feed import ingest
from tillroll.sources.store import FactStore
from tillroll.sources.tables import load_fact, write_fact


class Workspace:
    """Derived once per session and input folder; everything is written by Spark."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.rules = star.RULES
        self._written: dict[str, int] = {}

    def stands(self, spark: SparkSession) -> bool:
        """Its Spark still runs, and nobody has removed what it has written."""
        return spark.sparkContext is self.spark.sparkContext and all(
            n_files(spark, path) == n for path, n in self._written.items()
        )

    def _note(self, path: str) -> None:
        """``path`` is written, and later queries read it."""
        self._written[path] = n_files(self.spark, path)

    @cached_property
    def raw(self) -> DataFrame:
        folder = new_path(self.spark, "feeds")
        schema = star.write_feeds(self.spark, self.sf_dir, folder)
        self._note(folder)
        return ingest(star.feed_sources(self.spark, folder, schema))

    def cleaning(self) -> Cleaning:
        """A fresh cleaning run over the raw feeds."""
        return Cleaning(self.raw, self.rules)

    @cached_property
    def fact(self) -> DataFrame:
        path = new_path(self.spark, "fact")
        write_fact(self.cleaning().fact, path)
        self._note(path)
        return load_fact(self.spark, path)

    @cached_property
    def store(self) -> FactStore:
        """The same feeds appended one after the other."""
        folder = new_path(self.spark, "feeds")
        schema = star.write_feeds(self.spark, self.sf_dir, folder)
        grown = FactStore(self.spark, new_path(self.spark, "store"), self.rules)
        for name, lines in star.feed_sources(self.spark, folder, schema):
            grown.append(name, lines)
        self._note(grown.folder)
        return grown

    @cached_property
    def context(self) -> Context:
        return Context(self.fact, self.rules)

    def slice(self, **filters) -> Slice:
        return Slice.of(self.fact, self.rules, **filters)


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The one of this application, shared folder and input; a new one if it no longer stands.

    Staged tables may be removed between two queries (``clear_staged``, an emptied folder).
    """
    ensure_folder(spark)
    key = (shared_folder(spark), sf_dir)
    if key not in _OPEN or not _OPEN[key].stands(spark):
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]
