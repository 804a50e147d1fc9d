"""Session helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.shared import shared_folder

_shipped: weakref.WeakSet = weakref.WeakSet()


def session(df: DataFrame) -> SparkSession:
    """The session of df, with this package sent to its Python workers.

    The archive is the driver's own; Spark copies it to the executors.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc not in _shipped:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()
        path = os.path.join(folder, f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder, without its lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Bits of a bitmap that travels to all executors, at most: 32 MB.
BITMAP_BITS = 1 << 28
_PIECE = 1 << 15


def likely(rows: DataFrame, value: Column, keys: DataFrame, most: int = BITMAP_BITS) -> DataFrame:
    """The rows whose bigint value may be in the one column of keys, and perhaps a few more.

    A bitmap of hashed keys, 16 to 32 bits a key but never above ``most`` bits
    in all, is broadcast in pieces, so that only promising rows are moved by
    the join that follows and decides.  Beyond that bound more rows pass, and
    the result of the join stays the same.  Columns of rows pass through.
    """
    n = keys.count()
    bits = min(most, max(_PIECE, 1 << (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    hashed = keys.select(place(F.col(f"`{keys.columns[0]}`")).alias("h"))
    bitmap = hashed.groupBy(F.shiftright("h", 15).alias("__piece")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(_PIECE - 1))).alias("__bits"))
    order = rows.columns
    at = rows.withColumn("__place", place(value)).withColumn("__of", F.shiftright("__place", 15))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(F.col("__place").bitwiseAND(F.lit(_PIECE - 1)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.col("__place").bitwiseAND(F.lit(7)).cast("int")) == 1
    return at.join(F.broadcast(bitmap), F.col("__of") == F.col("__piece")).where(hit).select(*(F.col(f"`{c}`") for c in order))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove what written() wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> list[tuple[int, str, int]]:
    """At most ``per_class`` labelled rows (doc_id, text, label) of each class, to fit a classifier.

    Rows are taken in the order of a hash of doc_id.  Rows whose doc_id, label
    or text is null are passed over; of a doc_id that is labelled or occurs
    more than once, each distinct row counts.
    """
    spark = docs.sparkSession
    one = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null").distinct()
    picked: list[tuple[int, int]] = []
    for value, n in per_class.items():
        picked += [(r[0], r[1]) for r in one.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not picked:
        return []
    ids = spark.createDataFrame(picked, "doc_id long, label int")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").collect()
    return sorted({(r[0], r[1], r[2]) for r in rows})
