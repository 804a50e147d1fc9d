"""From a query's tree to a table of scored documents."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.operators.indexing import Index
from quillspark.plans.parser import And, Not, Or, Query, QueryError, Term, all_words, words_of


def weighted_postings(index: Index, words: list[str]) -> DataFrame:
    """(segment_id, term, doc_id, score, common) of the postings of the words.

    Postings are filtered to the words before anything else; a word's df is
    that of its segment, the number of documents that of all segments.
    """
    words = sorted(set(words))
    here = index.of(index.postings, words)
    meta = index.segments.select("segment_id", "avgdl", F.sum("doc_count").over(Window.partitionBy(F.lit(0))).alias("n"))
    df = index.of(index.terms, words).join(F.broadcast(meta), "segment_id").select("segment_id", "term", "df", "avgdl", "n")
    if index.small(len(words)):  # words times segments: the postings stay where they are
        df = F.broadcast(df)
    score = scoring.bm25(F.col("tf"), F.col("ndl"), F.col("avgdl"), scoring.idf(F.col("df"), F.col("n")))
    return here.join(df, ["segment_id", "term"]).select("segment_id", "term", "doc_id", score.alias("score"), scoring.over_ceiling(F.col("df"), F.col("n")).alias("common"))


def _weights(words: list[str]) -> F.Column:
    """How often a query names a posting's term."""
    pairs = [x for w, n in Counter(words).items() for x in (F.lit(w), F.lit(n))]
    return F.element_at(F.create_map(*pairs), F.col("term"))


def _any(scored: DataFrame, words: list[str]) -> DataFrame:
    """Documents with any of the words; scores add up."""
    part = scored.where(F.col("term").isin(sorted(set(words))) & ~F.col("common"))
    return part.groupBy("segment_id", "doc_id").agg(scoring.total(F.col("score") * _weights(words)).alias("score"))


def _needed(index: Index, words: list[str]) -> DataFrame:
    """(segment_id, need): how many of the words a segment's documents must hold; too common ones aren't asked for."""
    words = sorted(set(words))
    n = index.segments.select("segment_id", F.sum("doc_count").over(Window.partitionBy(F.lit(0))).alias("n"))
    common = index.of(index.terms, words).join(F.broadcast(n), "segment_id").where(scoring.over_ceiling(F.col("df"), F.col("n"))).groupBy("segment_id").agg(F.count("*").alias("c"))
    return index.segments.select("segment_id").join(common, "segment_id", "left").select("segment_id", (F.lit(len(words)) - F.coalesce("c", F.lit(0))).alias("need"))


def _all(index: Index, scored: DataFrame, words: list[str]) -> DataFrame:
    """Documents with all of the words that aren't too common; scores add up."""
    part = scored.where(F.col("term").isin(sorted(set(words))) & ~F.col("common"))
    found = part.groupBy("segment_id", "doc_id").agg(F.count("*").alias("held"), scoring.total(F.col("score") * _weights(words)).alias("score"))
    return found.join(F.broadcast(_needed(index, words)), "segment_id").where("held = need").select("segment_id", "doc_id", "score")


def top_per_segment(found: DataFrame, k: int) -> DataFrame:
    """The k best of each segment."""
    best = Window.partitionBy("segment_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).drop("__r")


def compile_query(index: Index, query: Query, k: int, compat: bool = False) -> DataFrame:
    """(segment_id, doc_id, score) of all documents that match.

    ``compat`` asks for the flat reading of AND: words of nested parts are all
    required, and nested NOT is passed over.  Otherwise AND, OR and NOT mean
    what they say and a nested part scores as it would alone.  An OR with
    nested parts takes the best k of each part and, for a document in several,
    the highest score.
    """
    if isinstance(query, Not):
        raise QueryError("NOT must be combined with AND")
    index = index.only(all_words(query))
    scored = weighted_postings(index, all_words(query))

    def run(q: Query) -> DataFrame:
        if isinstance(q, Term):
            return _any(scored, [q.text])
        if isinstance(q, Not):
            raise QueryError("NOT must be combined with AND")
        if isinstance(q, Or):
            if all(isinstance(p, Term) for p in q.parts):
                return _any(scored, words_of(q))
            parts = [top_per_segment(run(p), k) for p in q.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out.groupBy("segment_id", "doc_id").agg(F.max("score").alias("score"))
        return conjunction(q)

    def conjunction(q: And) -> DataFrame:
        plain = [p.text for p in q.parts if isinstance(p, Term)]
        nested = [p for p in q.parts if isinstance(p, (And, Or))]
        against = [p.part for p in q.parts if isinstance(p, Not)]
        if compat:
            plain, nested = words_of(q), []
            against = [p for p in against if isinstance(p, Term)]
        if not plain and not nested:
            return _any(scored, []).limit(0)
        out = _all(index, scored, plain) if plain else None
        for p in nested:
            part = run(p).withColumnRenamed("score", "__more")
            out = part.withColumnRenamed("__more", "score") if out is None else out.join(part, ["segment_id", "doc_id"]).select("segment_id", "doc_id", F.round(F.col("score") + F.col("__more"), 6).alias("score"))
        for p in against:
            # what is excluded isn't subject to the ceiling
            bad = scored.where(F.col("term") == p.text).select("segment_id", "doc_id") if isinstance(p, Term) else run(p).select("segment_id", "doc_id")
            out = out.join(bad, ["segment_id", "doc_id"], "left_anti")
        return out

    return run(query)


def estimate(index: Index, query: Query) -> DataFrame:
    """One row: how many documents a query may match at most, by the counts of its words alone.

    AND is bounded by its smallest part, OR by the sum of its parts, and what
    NOT excludes isn't counted.
    """
    words = sorted(set(all_words(query)))
    index = index.only(words)
    counts = index.of(index.terms, words).agg(*(F.coalesce(F.sum(F.when(F.col("term") == w, F.col("df"))), F.lit(0)).cast("bigint").alias(f"w{k}") for k, w in enumerate(words)))

    def bound(q: Query) -> F.Column:
        if isinstance(q, Term):
            return F.col(f"w{words.index(q.text)}")
        if isinstance(q, Not):
            raise QueryError("NOT must be combined with AND")
        parts = [bound(p) for p in q.parts if not isinstance(p, Not)]
        if not parts:
            return F.lit(0).cast("bigint")
        if isinstance(q, And):
            return F.least(*parts) if len(parts) > 1 else parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    return counts.select(bound(query).alias("estimate"))
