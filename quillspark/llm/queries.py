"""The ten operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import _spark
from . import decontaminate, html_extract, jaccard_join, line_dedup, mixing, quality_embeddings, quotient_dedup, suffix_dedup, toxic_crf, url_filter
from .sql import SQL


def op1_url_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decide(_spark.read(spark, sf_dir, "pages"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_spark.read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_epoch", "mix_block", "mix_place")


def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_dedup.duplicates(_spark.read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_spark.read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.read(spark, sf_dir, "documents")
    return toxic_crf.spans(docs, toxic_crf.fit(docs, _spark.read(spark, sf_dir, "labels")))


def op6_quality_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.read(spark, sf_dir, "documents")
    model = quality_embeddings.fit(docs, _spark.read(spark, sf_dir, "labels"))
    found = quality_embeddings.scores(docs, model)
    return found.where(found.p_quality >= quality_embeddings.THRESHOLD)


def op7_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_spark.read(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_spark.read(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_spark.read(spark, sf_dir, "documents"), decontaminate.fit(_spark.read(spark, sf_dir, "benchmark")))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_spark.read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
