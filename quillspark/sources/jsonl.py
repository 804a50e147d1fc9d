"""Documents from JSON lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value`` for each line of the files."""
    return spark.read.text(path)


def from_lines(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """The same of lines at hand, such as standard input."""
    return spark.createDataFrame([(v,) for v in values], "value string")


#: A line that holds nothing.
BLANK = r"^\s*$"


def whole_json(value: Column) -> Column:
    """A line's JSON, null where the line as a whole isn't JSON.

    Spark's parser stops after the first value and passes over what follows,
    so a line is read as an item ahead of its own digest, which no line can hold.
    """
    mark = F.sha2(value, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), value, F.lit(',"'), mark, F.lit('"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == mark, F.try_variant_get(pair, "$[0]", "variant"))


def parse(raw: DataFrame) -> DataFrame:
    """(value, doc): blank lines left out, doc the parsed JSON or null where a line isn't JSON."""
    return raw.where(~F.col("value").rlike(BLANK)).select("value", whole_json(F.col("value")).alias("doc"))


def documents(raw: DataFrame) -> DataFrame:
    """The lines that are JSON, of any kind."""
    return parse(raw).where("doc is not null")


def rejects(raw: DataFrame) -> DataFrame:
    """The lines that aren't."""
    return parse(raw).where("doc is null").select("value")


def counters(raw: DataFrame, blank: str = BLANK) -> DataFrame:
    """One row: documents, malformed, blank, which is what lines of a pattern are."""
    blank = F.col("value").rlike(blank)
    bad = whole_json(F.col("value")).isNull()
    return raw.agg(F.count_if(~blank & ~bad).alias("documents"), F.count_if(~blank & bad).alias("malformed"), F.count_if(blank).alias("blank"))


def text_field(doc: Column, field: str) -> Column:
    """A field of a document if it is a string; anything else isn't indexed."""
    value = F.try_variant_get(doc, f"$['{field}']", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, f"$['{field}']", "string"))


def with_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """df with dense numbers from 0 in the order of its files and partitions, without a sort.

    The rows of each partition are counted first; only these counts meet on
    the driver's side.
    """
    spread = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    counts = sorted((r[0], r[1]) for r in spread.groupBy(part.alias("p")).count().collect())
    bases, at = [], 0
    for p, n in counts:
        bases.append((p, at))
        at += n
    base = df.sparkSession.createDataFrame(bases, "__p long, __base long")
    local = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.withColumn("__k", part).join(F.broadcast(base), F.col("__k") == F.col("__p")).withColumn(name, F.col("__base") + local).drop("__m", "__k", "__p", "__base")
