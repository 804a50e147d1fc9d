"""The inverted index as tables: documents, postings, term statistics, segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import analyzer, scoring
from quillspark.sources.shared import kept

SEGMENT_DOCS = 500_000
BLOCK_POSTINGS = 128
#: Folders that the postings and terms of a written index lie in, by a hash of the term.
BUCKETS = 16
#: Neighbouring segments whose documents share a folder of a written index, and how many such folders there are at most.
FOLDER_SEGMENTS, FOLDERS = 64, 64
#: Rows of a table that is broadcast by hint, at most.
BROADCAST_ROWS = 500_000


@dataclass
class Index:
    """docs(segment_id, doc_id, dl, norm, ndl, ...stored), postings(segment_id, term, doc_id, tf, ndl),
    terms(segment_id, term, df), segments(segment_id, doc_count, total_tokens, avgdl, min_doc_id, max_doc_id, term_count);
    of an index that isn't written also tokens(segment_id, doc_id, dl, ndl, t)."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    segments: DataFrame
    path: str | None = None
    segment_count: int | None = None
    tokens: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def of(self, table: DataFrame, words: list[str]) -> DataFrame:
        """The rows of postings or terms that have one of the words; of a written index only these words' folders are read."""
        here = table.where(F.col("term").isin(words))
        return here.where(F.col("bucket").isin(*(bucket(F.lit(w)) for w in words))) if self.path and words else here

    def only(self, words: list[str]) -> Index:
        """The index of the words alone.

        Of an index that isn't written the texts are read once: a row for each
        document, with its length and its runs of these words, is kept, and
        postings, terms and segments come from that.
        """
        if self.tokens is None or not words:
            return self
        held = F.sort_array(F.filter("t", lambda x: x.isin(sorted(set(words)))))
        rows = kept(with_runs(self.tokens.select("segment_id", "doc_id", "dl", "ndl", held.alias("t"))))
        postings = rows.select("segment_id", "doc_id", "ndl", F.explode("runs").alias("run")).select("segment_id", F.col("run.term"), "doc_id", tf_of("run").alias("tf"), "ndl")
        return Index(self.docs, postings, terms_of(postings), segments_of(rows, None))

    def small(self, rows_a_segment: int) -> bool:
        """Whether a table of so many rows a segment is known to be small enough for a broadcast."""
        return self.segment_count is not None and self.segment_count * rows_a_segment <= BROADCAST_ROWS


def bucket(term: Column) -> Column:
    """The folder of a term."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def folder(segment_id: Column) -> Column:
    """The folder of a segment's documents: there are no more of them however many segments there are."""
    return F.pmod(F.floor(segment_id / FOLDER_SEGMENTS), F.lit(FOLDERS)).cast("int")


def segments_of(docs: DataFrame, terms: DataFrame | None) -> DataFrame:
    """Statistics of each segment; documents without terms count."""
    out = docs.groupBy("segment_id").agg(
        F.count("*").alias("doc_count"),
        F.sum("dl").cast("bigint").alias("total_tokens"),
        (F.sum("dl").cast("double") / F.count("*")).alias("avgdl"),
        F.min("doc_id").alias("min_doc_id"),
        F.max("doc_id").alias("max_doc_id"),
    )
    if terms is None:
        return out
    return out.join(terms.groupBy("segment_id").agg(F.count("*").alias("term_count")), "segment_id", "left").fillna(0, ["term_count"])


def terms_of(postings: DataFrame) -> DataFrame:
    """Documents that hold each term, segment by segment."""
    return postings.groupBy("segment_id", "term").agg(F.count("*").alias("df"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it has fewer splits than there are cores: a small file may be one row group, which one task reads."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def with_runs(df: DataFrame, each: bool = False) -> DataFrame:
    """df, whose rows have sorted terms ``t``, with ``runs`` of equal ones, each (term, first, next), in its place, or with a row ``run`` for each.

    Only the places where runs begin take a function of each element; the rest
    is compiled code.  Rows are made of the runs' expression and not of a
    column of it, from which Spark would infer a filter that works the terms
    out again for each of them.
    """
    places = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.greatest(F.size("t"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: ~F.get("t", i).eqNullSafe(F.get("t", i - 1)))
    rest = [c for c in df.columns if c != "t"]
    held = df.select(*rest, F.array_distinct("t").alias("d"), first.alias("f"), F.size("t").alias("n"))
    runs = F.arrays_zip(F.col("d").alias("term"), F.col("f").alias("first"), F.slice(F.concat("f", F.array("n")), 2, 1 << 30).alias("next"))
    return held.select(*rest, F.explode(runs).alias("run") if each else runs.alias("runs"))


def tf_of(run: str) -> Column:
    """How often a run's term occurs."""
    return F.col(f"{run}.next") - F.col(f"{run}.first")


def build(df: DataFrame, fields: list[str], key: str = "doc_id", segment_docs: int = SEGMENT_DOCS, lengths: bool = False) -> Index:
    """An index over the fields of df, lazily.

    ``key`` is a dense number in order of arrival; segments are runs of
    ``segment_docs`` of them.  Terms are counted within their row: a document's
    terms are sorted, and runs of equal ones counted, so that nothing is
    shuffled for it.  ``lengths`` also puts dl and norm into the postings, so
    that what needs them has no need of a join.
    """
    norm = scoring.encode_length(F.col("dl"))
    base = spread(df).withColumn("doc_id", F.col(key).cast("bigint")).withColumn("segment_id", F.floor(F.col("doc_id") / segment_docs).cast("bigint"))
    held = base.withColumn("__t", analyzer.field_tokens(fields)).withColumn("dl", F.size("__t")).withColumn("norm", norm).withColumn("ndl", scoring.decode_length(F.col("norm")))
    stored = [c for c in df.columns if c not in ("doc_id", "segment_id", "dl", "norm", "ndl")]
    docs = held.select("segment_id", "doc_id", "dl", "norm", "ndl", *(F.col(f"`{c}`") for c in stored))
    tokens = held.select("segment_id", "doc_id", "dl", "ndl", F.col("__t").alias("t"))
    more = ["dl", "norm"] if lengths else []
    runs = with_runs(held.select("segment_id", "doc_id", "ndl", *more, F.sort_array("__t").alias("t")), each=True)
    postings = runs.select("segment_id", F.col("run.term"), "doc_id", tf_of("run").alias("tf"), "ndl", *more)
    terms = terms_of(postings)
    return Index(docs, postings, terms, segments_of(docs, None), tokens=tokens)


def put(index: Index, path: str, mode: str, above: int = -1) -> None:
    """Write docs and postings of an index, and terms and segments of those above a number from what was written.

    Documents stay in their tasks, which write a file for each folder that
    their segments are in: files grow with the tasks, not with the segments.

    Postings go to a folder by a hash of their term, sorted by term within
    their task, which nothing leaves.  Segments come last: what has no row
    there is in no search.
    """
    spark = index.spark
    written = lambda t: spark.read.parquet(f"{path}/{t}").withColumn("segment_id", F.col("segment_id").cast("bigint")).where(F.col("segment_id") > above)
    index.docs.withColumn("__folder", folder(F.col("segment_id"))).write.mode(mode).partitionBy("__folder").parquet(f"{path}/docs")
    named = index.postings.withColumn("bucket", bucket(F.col("term")))
    named.sortWithinPartitions("bucket", "segment_id", "term", "doc_id").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    terms = written("postings").groupBy("segment_id", "bucket", "term").agg(F.count("*").alias("df")).select("segment_id", "term", "df", "bucket")
    terms.sortWithinPartitions("bucket", "segment_id", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/terms")
    segments_of(written("docs"), written("terms")).coalesce(1).write.mode(mode).parquet(f"{path}/segments")


def write(index: Index, path: str) -> Index:
    """The index as Parquet, in place of what is there."""
    put(index, path, "overwrite")
    return open_index(index.spark, path)


def append(index: Index, path: str) -> Index:
    """The index' segments added to those at path, or written there if nothing is.

    Numbers of segments and documents go on after those at path.
    """
    spark = index.spark
    try:
        there = open_index(spark, path)
    except FileNotFoundError:
        return write(index, path)
    segment, doc = there.segments.agg(F.coalesce(F.max("segment_id"), F.lit(-1)), F.coalesce(F.max("max_doc_id"), F.lit(-1))).first()
    moved = lambda df: df.withColumns({"segment_id": F.col("segment_id") + (segment + 1), "doc_id": F.col("doc_id") + (doc + 1)})
    put(Index(moved(index.docs), moved(index.postings), index.terms, index.segments), path, "append", above=segment)
    for table in ("docs", "postings", "terms", "segments"):
        spark.catalog.refreshByPath(f"{path}/{table}")
    return open_index(spark, path)


def merge_in_place(spark: SparkSession, path: str) -> Index:
    """All segments at path as one; the old ones go once the new one is complete.  With one segment or none, nothing is done."""
    index = open_index(spark, path)
    if (index.segment_count or 0) <= 1:
        return index
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh, old = f"{path.rstrip('/')}.merged", f"{path.rstrip('/')}.old"
    for p in (fresh, old):
        fs.delete(at(p), True)
    write(merge(index), fresh)
    for a, b in ((path, old), (fresh, path)):
        if not fs.rename(at(a), at(b)):
            raise OSError(f"can't rename {a} to {b}")
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """A written index; FileNotFoundError if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/segments")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"index directory not found: {path}")
    table = lambda t: spark.read.parquet(f"{path}/{t}")
    segments = table("segments")
    return Index(table("docs").withColumn("segment_id", F.col("segment_id").cast("bigint")), table("postings"), table("terms"), segments, path, segments.count())


def reload(index: Index) -> Index:
    """The index as it is on disk now."""
    index.spark.catalog.refreshByPath(index.path)
    return open_index(index.spark, index.path)


def stats(index: Index) -> DataFrame:
    """One row: total_docs, total_segments, total_terms (summed over segments)."""
    return index.segments.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).alias("total_docs"), F.count("*").alias("total_segments")).crossJoin(index.terms.agg(F.count("*").alias("total_terms")))


def size_in_bytes(index: Index) -> int:
    """Bytes of a written index."""
    jvm = index.spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(index.path)
    return at.getFileSystem(index.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def merge(index: Index) -> Index:
    """All segments as one, numbers dense in the order of the segments; statistics made anew."""
    before = Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row a segment
    base = F.broadcast(index.segments.select("segment_id", "min_doc_id", F.coalesce(F.sum("doc_count").over(before), F.lit(0)).alias("__base")))

    def moved(df: DataFrame) -> DataFrame:
        order = df.columns
        out = df.join(base, "segment_id").withColumn("doc_id", F.col("doc_id") - F.col("min_doc_id") + F.col("__base")).withColumn("segment_id", F.lit(0).cast("bigint"))
        return out.select(*(F.col(f"`{c}`") for c in order))

    docs, postings = moved(index.docs.drop("__folder")), moved(index.postings.drop("bucket"))
    terms = index.terms.groupBy("term").agg(F.sum("df").cast("bigint").alias("df")).select(F.lit(0).cast("bigint").alias("segment_id"), "term", "df")
    return Index(docs, postings, terms, segments_of(docs, None))


def dictionary(index: Index) -> DataFrame:
    """(segment_id, term_id, term, df): ids count a segment's terms in byte order from 0.

    A term's id is its place among the terms of its initial plus those of
    smaller initials, so that no one task sorts a whole dictionary.
    """
    initial = index.terms.withColumn("__i", F.substring("term", 1, 2))
    counts = initial.groupBy("segment_id", "__i").agg(F.count("*").alias("__n"))
    ahead = counts.select("segment_id", "__i", (F.sum("__n").over(Window.partitionBy("segment_id").orderBy("__i")) - F.col("__n")).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("segment_id", "__i").orderBy("term")) - 1
    return initial.withColumn("__k", place).join(ahead, ["segment_id", "__i"]).select("segment_id", (F.col("__ahead") + F.col("__k")).alias("term_id"), "term", "df")


def seek(index: Index, term: str, target: int) -> DataFrame:
    """One row: the first document of at least target that holds the term."""
    index = index.only([term])
    return index.of(index.postings, [term]).where(F.col("doc_id") >= target).agg(F.min("doc_id").alias("doc_id"))


def segment_of(index: Index, ids: DataFrame) -> DataFrame:
    """(doc_id, segment_id): the segment in whose range of numbers each row of ids lies; null where none does."""
    ranges = index.segments.select("segment_id", "min_doc_id", "max_doc_id")
    return ids.join(F.broadcast(ranges), F.col("doc_id").between(F.col("min_doc_id"), F.col("max_doc_id")), "left").select("doc_id", "segment_id")


def blocks(index: Index) -> DataFrame:
    """Summary of each 128 postings of a term: the last document, largest tf, smallest length and score bound."""
    terms = Window.partitionBy("segment_id", "term")
    row = F.row_number().over(terms.orderBy("doc_id")) - 1
    placed = index.postings.withColumn("block_id", F.floor(row / BLOCK_POSTINGS).cast("bigint"))
    found = placed.groupBy("segment_id", "term", "block_id").agg(F.count("*").alias("postings"), F.max("doc_id").alias("last_doc_id"), F.max("tf").alias("max_tf"), F.min(F.greatest("ndl", F.lit(1))).alias("min_dl"))
    # one row a segment; a term's documents are those of its blocks, which lie together
    meta = index.segments.select("segment_id", "avgdl", F.sum("doc_count").over(Window.partitionBy(F.lit(0))).alias("n"))
    ranked = found.withColumn("df", F.sum("postings").over(terms)).join(F.broadcast(meta), "segment_id")
    bound = scoring.block_bound(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), scoring.idf(F.col("df"), F.col("n")))
    return ranked.select("segment_id", "term", "block_id", "postings", "last_doc_id", "max_tf", "min_dl", F.round(bound, 6).alias("max_score"))


def block_of(index: Index, term: str, target: int) -> DataFrame:
    """One row: the last document of the first block that may hold target."""
    return blocks(index).where((F.col("term") == term) & (F.col("last_doc_id") >= target)).agg(F.min("last_doc_id").alias("last_doc_id"))


def gaps(index: Index) -> DataFrame:
    """(segment_id, term, doc_id, gap): distances between a term's documents, the first from 0."""
    order = Window.partitionBy("segment_id", "term").orderBy("doc_id")
    return index.postings.select("segment_id", "term", "doc_id", (F.col("doc_id") - F.lag("doc_id", 1, 0).over(order)).alias("gap"))


def ungap(gapped: DataFrame) -> DataFrame:
    """Documents from distances."""
    order = Window.partitionBy("segment_id", "term").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return gapped.select("segment_id", "term", "doc_id", F.sum("gap").over(order).alias("decoded"))


def offsets(index: Index) -> DataFrame:
    """(segment_id, term, term_bytes, byte_offset) of a dictionary written term after term, summed like its ids."""
    sized = index.terms.select("segment_id", "term", F.octet_length("term").alias("term_bytes"), F.substring("term", 1, 2).alias("__i"))
    sums = sized.groupBy("segment_id", "__i").agg(F.sum("term_bytes").alias("__n"))
    ahead = sums.select("segment_id", "__i", (F.sum("__n").over(Window.partitionBy("segment_id").orderBy("__i")) - F.col("__n")).alias("__ahead"))
    here = F.sum("term_bytes").over(Window.partitionBy("segment_id", "__i").orderBy("term")) - F.col("term_bytes")
    return sized.withColumn("__k", here).join(ahead, ["segment_id", "__i"]).select("segment_id", "term", "term_bytes", (F.col("__ahead") + F.col("__k")).alias("byte_offset"))


def encoded(index: Index) -> DataFrame:
    """(segment_id, term, block_id, data) of each 128 postings of a term: bytes of (gap, tf), the first gap of a block from 0."""
    order = Window.partitionBy("segment_id", "term").orderBy("doc_id")
    place = F.row_number().over(order) - 1
    gap = F.when(F.col("__k") % BLOCK_POSTINGS == 0, F.col("doc_id")).otherwise(F.col("doc_id") - F.col("__before"))
    placed = index.postings.select("segment_id", "term", "doc_id", "tf", place.alias("__k"), F.lag("doc_id", 1, 0).over(order).alias("__before"))
    digits = placed.select("segment_id", "term", F.floor(F.col("__k") / BLOCK_POSTINGS).cast("bigint").alias("block_id"), "doc_id", F.concat(scoring.vbyte_hex(gap), scoring.vbyte_hex(F.col("tf"))).alias("h"))
    # a block has 128 rows at most
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", "h")))["h"], "")
    return digits.groupBy("segment_id", "term", "block_id").agg(F.unhex(joined).alias("data"))


def decoded(blocks_: DataFrame) -> DataFrame:
    """(segment_id, term, doc_id, tf) of encoded blocks."""
    read = blocks_.select("segment_id", "term", scoring.vbyte_numbers(F.col("data")).alias("v"))
    parts = read.select("segment_id", "term", F.filter("v", lambda x, i: i % 2 == 0).alias("gaps"), F.filter("v", lambda x, i: i % 2 == 1).cast("array<int>").alias("tf"))
    # each sum is the one before and a gap; the 0 that the sums begin from goes
    sums = F.aggregate("gaps", F.array(F.lit(0).cast("bigint")), lambda done, gap: F.array_append(done, F.element_at(done, -1) + gap))
    each = F.arrays_zip(F.slice(sums, 2, BLOCK_POSTINGS).alias("doc_id"), F.col("tf").alias("tf"))
    return parts.select("segment_id", "term", F.inline(each))
