"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    langid,
    line_dedup,
    lm,
    mixing,
    negatives,
    packing,
    phrases,
    quality,
    quality_sql,
    resample,
    simhash,
    suffixes,
    token_files,
    wrapper,
)
from tillroll.llm.common import documents, fold_of, table
from tillroll.plans.staging import new_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(
        documents(spark, sf_dir).select("doc_id", "source", "text"), counts=("n_lines", "n_dropped")
    )
    return cleaned.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify_held_out(docs, fold_of(F.col("doc_id"), 5) == 0, ["doc_id"]).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), with_kept=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.with_verdict(documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc.doc_id", *quality.BASE, "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = new_path(spark, "token-files")
    token_files.write_tokens(docs, path, VOCABULARY, end=2)
    return token_files.read_checksums(spark, path)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.score_held_out(docs, fold_of(F.col("doc_id"), 7) == 2, ["doc_id"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), VOCABULARY, end=0)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.with_fingerprints(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("id") % 100 == 0, label=turned)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = resample.resample(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc.doc_id", "n_features", "weight", "score", "rank")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("page.page_id", "page.url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_language_id, op3_suffix_dedup, op4_simhash, op5_quality,
        op6_mixing, op7_token_files, op8_lm_score, op9_packing, op10_fingerprints,
        op11_hard_negatives, op12_resample, op13_html_text,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_quality": quality_sql.oracle(),
    "op6_mixing": mixing.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_resample": resample.oracle(),
}
