"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and returns a
frame that is written as Parquet and read again for the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import line_dedup, mixing, packing, quality, simhash
from tillroll.llm.common import documents, prepare
from tillroll.plans.staging import stage

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: short texts may be clean: only the other rules judge them
MIN_WORDS = 1


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` again, for texts that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail a base rule, or lie far outside their language and source, go."""
    prepare(spark)
    return quality.keep_quality(docs, min_words=MIN_WORDS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of a source go; documents stay. Copies are one page."""
    prepare(spark)
    return _measured(line_dedup.drop_boilerplate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes once per epoch."""
    prepare(spark)
    return _measured(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    prepare(spark)
    return packing.pack_documents(docs, VOCABULARY, end=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SimHash, tokenizer and packing have no SQL form
ORACLE_SQL = None
