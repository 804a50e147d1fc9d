"""Searching an index: ranking, paging, documents, presentation."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.operators import indexing
from quillspark.operators.indexing import Index
from quillspark.plans.parser import Or, Term, parse, words_of
from quillspark.plans.planner import compile_query, weighted_postings


#: Rows of a page that travel to all executors, at most.
PAGE_ROWS = 100_000


def _page(found: DataFrame, limit: int, offset: int) -> DataFrame:
    """(segment_id, doc_id, score) of a page, best first and by doc_id where scores are equal."""
    return found.select("segment_id", "doc_id", "score").orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def _found(index: Index, query: str, limit: int, offset: int, compat: bool) -> DataFrame:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return compile_query(index, parse(query), limit + offset, compat)


def ranked(index: Index, query: str, limit: int = 10, offset: int = 0, compat: bool = False) -> DataFrame:
    """(doc_id, score) of a page, best first and by doc_id where scores are equal."""
    return _page(_found(index, query, limit, offset, compat), limit, offset).select("doc_id", "score")


def _fetched(index: Index, page: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page with ranks and stored columns: its rows go to the documents, which stay where they are and are read in its segments' folders alone."""
    keys = ["segment_id", "doc_id"]
    if "__folder" in index.docs.columns:
        page, keys = page.withColumn("__folder", indexing.folder(F.col("segment_id"))), ["__folder", *keys]
    page = F.broadcast(page) if limit <= PAGE_ROWS else page
    found = index.docs.drop("dl", "norm", "ndl").join(page, keys)
    rest = [c for c in index.docs.columns if c not in ("__folder", "segment_id", "doc_id", "dl", "norm", "ndl")]
    place = F.row_number().over(indexing.Window.orderBy(F.desc("score"), "doc_id")) + F.lit(offset)
    return found.select(place.alias("rank"), "doc_id", "score", *(F.col(f"`{c}`") for c in rest))


def hits(index: Index, query: str, limit: int = 10, offset: int = 0, compat: bool = False) -> DataFrame:
    """(rank, doc_id, score, ...stored) of a page: documents are fetched for its rows alone."""
    return _fetched(index, _page(_found(index, query, limit, offset, compat), limit, offset), limit, offset)


def _totals(found: DataFrame, k: int) -> DataFrame:
    """One row: total_hits, the rows kept of each segment, and total_matches, all that match."""
    each = found.groupBy("segment_id").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(F.least("n", F.lit(k))), F.lit(0)).cast("bigint").alias("total_hits"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_matches"))


def counts(index: Index, query: str, limit: int = 10, offset: int = 0, compat: bool = False) -> DataFrame:
    """One row: total_hits, the rows kept of each segment for the page, and total_matches, all that match."""
    return _totals(_found(index, query, limit, offset, compat), limit + offset)


def batch(index: Index, queries: Mapping[int, str], limit: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) of many plain queries, words joined by OR, in one job.

    The queries' words are a table joined to the postings, whose size decides
    how; a query's words may repeat.
    """
    rows = []
    for i, q in queries.items():
        tree = parse(q)
        if not (isinstance(tree, Term) or isinstance(tree, Or) and all(isinstance(p, Term) for p in tree.parts)):
            raise ValueError("a batch takes words joined by OR")
        rows += [(i, w) for w in words_of(tree)]
    asked = index.spark.createDataFrame(rows, "query_id long, term string").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    words = [w for _, w in rows]
    scored = weighted_postings(index.only(words), words).where("not common")
    found = scored.join(asked, "term").groupBy("query_id", "doc_id").agg(scoring.total(F.col("score") * F.col("times")).alias("score"))
    best = F.row_number().over(indexing.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")


def as_json(page: DataFrame) -> DataFrame:
    """(rank, hit): each row of a page as JSON text."""
    return page.select("rank", F.to_json(F.struct(*(c for c in page.columns if c != "rank"))).alias("hit"))


def title(*fields: str) -> Column:
    """The first of the fields that is there, else a placeholder."""
    return F.coalesce(*(F.col(f"`{f}`") for f in fields), F.lit("(untitled)"))


def snippet(*fields: str, size: int = 200) -> Column:
    """The beginning of the first of the fields that is there, marked where it is cut; empty if none is."""
    text = F.coalesce(*(F.col(f"`{f}`") for f in fields), F.lit(""))
    return F.when(F.octet_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def brief(field: str, size: int = 200) -> Column:
    """The first characters of a field."""
    return F.substring(F.col(f"`{field}`"), 1, size)


def format_bytes(n: int) -> str:
    """A size in B, KB, MB or GB."""
    for unit, scale in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= scale:
            return f"{n / scale:.1f} {unit}"
    return f"{n} B"


def format_duration(ms: float) -> str:
    """Milliseconds, with more places below one."""
    return f"{ms:.2f} ms" if ms < 1 else f"{ms:.1f} ms"


def page_offset(page: int, limit: int) -> int:
    """Where a page, counted from 1, begins."""
    return (max(1, page) - 1) * limit


def page_count(total: int, limit: int) -> int:
    """How many pages of limit rows there are."""
    return -(-total // limit)


@dataclass
class Results:
    """A page of hits with its totals."""

    total_hits: int
    total_matches: int
    took_ms: float
    hits: list[dict]

    def to_json(self) -> str:
        """The page as JSON."""
        return json.dumps({"total_hits": self.total_hits, "total_matches": self.total_matches, "took_ms": self.took_ms, "hits": self.hits}, ensure_ascii=False, default=str)


class SearchIndex:
    """A written index that is open for queries."""

    def __init__(self, spark: SparkSession, path: str):
        self.index = indexing.open_index(spark, path)

    def search(self, query: str, limit: int = 10, offset: int = 0, compat: bool = False) -> Results:
        if not query.strip():
            raise ValueError("query is blank")
        began = time.perf_counter()
        found = _found(self.index, query, limit, offset, compat)
        # one job: the page and the totals share what is scored; a page without rows leaves its totals behind
        page = _page(found, limit, offset)
        both = _totals(found, limit + offset).join(_fetched(self.index, page, limit, offset).withColumn("__there", F.lit(True)), how="left")
        rows = [r.asDict() for r in both.collect()]
        total = rows[0]
        names = ("total_hits", "total_matches", "__there")
        hits_ = sorted(({k: v for k, v in r.items() if k not in names} for r in rows if r["__there"]), key=lambda h: h["rank"])
        return Results(total["total_hits"], total["total_matches"], (time.perf_counter() - began) * 1000, hits_)

    def stats(self) -> dict:
        return indexing.stats(self.index).first().asDict() | {"index_size_bytes": indexing.size_in_bytes(self.index)}

    def reload(self) -> None:
        self.index = indexing.reload(self.index)
