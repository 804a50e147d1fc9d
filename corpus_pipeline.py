"""From raw documents to a training mixture: the stages of the corpus pipeline.

Each stage takes the session, the documents that its predecessor kept, and the
data folder, and works on all of them.  All but the last return the columns of
documents; the last adds the mixture's epoch, block and place.

Defined results, beyond those of the operators: null and blank texts are
rejected by the first stage, without labels they pass all but the last, which
takes nothing without tokens; rows of a null doc_id are classified,
decontaminated and mixed, and equal no other; further columns pass through all
stages, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import _spark, decontaminate, jaccard_join, line_dedup, mixing, quality_embeddings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_embeddings.keep(docs, quality_embeddings.fit(docs, _spark.read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks of lines that an earlier one holds."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, decontaminate.fit(_spark.read(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]
#: The classifier and patience diff have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, applied to the documents table.

    Each stage's result is written as Parquet to the shared folder and read
    again; it is removed once the next one's is written.
    """
    docs, before = _spark.read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = _spark.written(stage(spark, docs, sf_dir))
        if before:
            _spark.discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
