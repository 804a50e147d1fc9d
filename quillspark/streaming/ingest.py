"""Indexing a stream of JSON lines: each micro-batch becomes a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillspark.operators import indexing
from quillspark.sources import jsonl


def append(lines: DataFrame, path: str, fields: list[str], segment_id: int, base: int) -> int:
    """Write the documents of lines as one segment whose ids begin at base; how many there were."""
    docs = jsonl.with_ids(jsonl.documents(lines).select("value", *(jsonl.text_field(F.col("doc"), f).alias(f) for f in fields))).withColumn("doc_id", F.col("doc_id") + base)
    index = indexing.build(docs, fields)
    spark = docs.sparkSession
    numbered = lambda df: df.withColumn("segment_id", F.lit(segment_id).cast("bigint"))
    written = lambda t: spark.read.parquet(f"{path}/{t}/part={segment_id}")
    numbered(index.docs).write.mode("overwrite").parquet(f"{path}/docs/part={segment_id}")
    numbered(index.postings).write.mode("overwrite").parquet(f"{path}/postings/part={segment_id}")
    indexing.terms_of(written("postings")).write.mode("overwrite").parquet(f"{path}/terms/part={segment_id}")
    indexing.segments_of(written("docs"), written("terms")).write.mode("overwrite").parquet(f"{path}/segments/part={segment_id}")
    return written("docs").count()


def stream(lines: DataFrame, path: str, fields: list[str], checkpoint: str) -> DataStreamWriter:
    """A writer that appends segments to path as lines arrive; a repeated batch overwrites its own segment.

    Ids of a batch begin at its number times 2**40, so that batches need not
    know of each other.
    """
    return lines.writeStream.foreachBatch(lambda batch, n: append(batch, path, fields, n, n << 40)).option("checkpointLocation", checkpoint)


def open_stream(spark: SparkSession, path: str) -> indexing.Index:
    """The index of all segments that a stream has written."""
    return indexing.Index(*(spark.read.parquet(f"{path}/{t}").drop("part") for t in ("docs", "postings", "terms", "segments")))
