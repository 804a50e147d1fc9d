"""Suffix-array dedup with a sparse suffix array.

Of all suffixes of all token sequences only those are kept that begin at a
minimiser: a place whose hash of ``K`` tokens is the smallest of some ``WINDOW``
consecutive places.  Every passage of ``LENGTH`` tokens therefore holds a kept
suffix that shares at least its first ``LENGTH - WINDOW + 1`` tokens with any
other copy of the passage.  The kept suffixes are sorted by those
tokens and compared with their neighbours; those that agree with a suffix of
another document are extended to the left and right, as far as a kept suffix
of the same passage would not reach, and reported where the agreement is at
least ``LENGTH`` tokens.  All choices depend on content alone.

Extension is exact: for every way in which a passage of ``LENGTH`` tokens can
lie around a suffix, the suffixes are sorted by the whole passage and neighbours
of different documents with equal passages are matches.  Suffixes of a beginning
that more than ``GROUP_ROWS`` of them share don't meet in one task: each of
their passages is counted over all tasks for itself instead, with the same
result.  Tokens and passages are compared by 64-bit hashes.

Defined results: null, empty and short texts match nothing; a passage repeated
only within one document isn't reported; rows with a null doc_id are left out;
rows of equal doc_id count as one document; texts of any length are read whole;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read,
whatever other columns there are.  Spans count tokens (``_text.tokens``) from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

#: Repeated passages of so many tokens or more are reported.
LENGTH = 50
#: Tokens hashed to choose minimisers.
K = 8
#: Consecutive places of which the smallest is kept.
WINDOW = 26


def slide(v: np.ndarray, n: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over each n consecutive values."""
    size = 1
    while 2 * size <= n:
        v = pick(v[: len(v) - size], v[size:])
        size *= 2
    return pick(v[: len(v) - (n - size)], v[n - size :]) if n > size else v


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Places whose value is the smallest of some window of consecutive places, ties all kept."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    low = slide(h, window, np.minimum)
    pad = np.zeros(window - 1, h.dtype)
    return np.flatnonzero(slide(np.concatenate([pad, low, pad]), window, np.maximum) == h)


def anchors(t: _text.Tokens, length: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes among all tokens, and the hash of their shared beginning."""
    reach = length - window + 1
    g = _text.grams(t.hash, k)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = t.bounds[1:][t.row]
    place = np.arange(len(g))
    g[place + k > end[: len(g)]] = np.iinfo(np.uint64).max
    at = minimisers(g, window)
    at = at[(at + reach <= end[at]) & (end[at] - t.bounds[t.row[at]] >= length)]
    return at, _text.grams(t.hash, reach)[at] if len(at) else np.zeros(0, np.uint64)


def shared_rows(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first ``keys`` columns and then the next, those whose key stands with two values of the next."""
    held: pa.RecordBatch | None = None

    def agree(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, columns: range) -> bool:
        return all(a.column(c)[i].as_py() == b.column(c)[j].as_py() for c in columns)

    sure = False  # the key of the batch before goes on and is known to be shared
    last: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        goes_on = last is not None and agree(last, last.num_rows - 1, b, 0, range(keys))
        if held is not None and not goes_on:
            held = None
        columns = [b.column(c).to_numpy(zero_copy_only=False) for c in range(keys + 1)]
        run = _text.run_ids(*columns[:keys])
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        stop = np.append(begin[1:], b.num_rows)
        shared = columns[keys][begin] != columns[keys][stop - 1]
        if goes_on and not shared[0]:
            shared[0] = sure or (held is not None and not agree(held, 0, b, 0, range(keys, keys + 1)))
        if goes_on and shared[0] and held is not None:
            yield held
            held = None
        was_sure = sure and goes_on
        keep = shared[run]
        tail = slice(int(begin[-1]), b.num_rows)
        yield b.filter(pa.array(keep))
        sure = bool(shared[-1]) or (was_sure and len(begin) == 1)
        if not sure:
            rest = b.slice(tail.start)
            held = pa.Table.from_batches([held, rest]).combine_chunks().to_batches()[0] if held is not None and len(begin) == 1 else rest
        else:
            held = None
        last = b.slice(b.num_rows - 1)


def _keys(batches: Iterator[pa.RecordBatch], length: int, k: int, window: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, place) of the kept suffixes of rows (doc_id, text)."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        raw, off = _text.buffers(b.column(1))
        for a, _, r, o in _text.chunks(raw, off):
            t = _text.tokens(r, o)
            at, key = anchors(t, length, k, window)
            row = t.row[at]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[a + row]), pa.array((at - t.bounds[row]).astype(np.int32))], ["key", "doc_id", "place"])


def _passages(batches: Iterator[pa.RecordBatch], length: int, window: int, apart: bool) -> Iterator[pa.RecordBatch]:
    """The passages of ``length`` tokens that lie around the suffixes of rows (doc_id, text, places).

    (key, doc_id, place, passages): the hashes of those that begin 0, 1, ...
    tokens before the suffix, 0 where the text doesn't reach.  With ``apart``
    each passage is a row (passage, doc_id, start).
    """
    reach = length - window + 1
    before = np.arange(length - reach + 1)
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        raw, off = _text.buffers(b.column(1))
        wanted, edge = b.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))])
        for a, z, r, o in _text.chunks(raw, off):
            t = _text.tokens(r, o)
            row = np.repeat(np.arange(z - a), np.diff(edge[a : z + 1]))
            place = wanted[edge[a] : edge[z]].astype(np.int64)
            fits = t.bounds[row] + place + reach <= t.bounds[row + 1]  # another row of the same doc_id may be shorter
            row, place = row[fits], place[fits]
            at = t.bounds[row] + place
            if not len(at):
                continue
            whole = np.maximum(np.append(_text.grams(t.hash, length), np.uint64(0)), np.uint64(1))
            start = at[:, None] - before
            inside = (start >= t.bounds[row][:, None]) & (start + length <= t.bounds[row + 1][:, None])
            found = np.where(inside, whole[np.where(inside, start, 0)], np.uint64(0))
            if apart:
                k, s = np.nonzero(inside)
                yield pa.RecordBatch.from_arrays([pa.array(found[k, s].view(np.int64)), pa.array(ids[a + row[k]]), pa.array((place[k] - s).astype(np.int32))], ["passage", "doc_id", "start"])
                continue
            packed = pa.Array.from_buffers(pa.binary(8 * len(before)), len(at), [None, pa.py_buffer(np.ascontiguousarray(found, "<u8"))]).cast(pa.binary())
            key = _text.grams(t.hash, reach)[at]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[a + row]), pa.array(place.astype(np.int32)), packed], ["key", "doc_id", "place", "passages"])


def matched(doc: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far the passages shared with another document begin before each suffix, most and least, and such a document; -1 most without any."""
    n, ways = passages.shape
    most, least = np.full(n, -1, np.int32), np.full(n, ways, np.int32)
    other = np.zeros(n, np.int64)
    for s in range(ways):
        there = np.flatnonzero(passages[:, s])
        if len(there) < 2:
            continue
        h = passages[there, s]
        order = np.lexsort((doc[there], h))
        run = _text.run_ids(h[order])
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        stop = np.append(begin[1:], len(order))
        d = doc[there][order]
        low, high = d[begin][run], d[stop - 1][run]
        hit = low != high
        i = there[order[hit]]
        most[i] = np.maximum(most[i], s)
        least[i] = np.minimum(least[i], s)
        other[i] = np.where(d[hit] == low[hit], high[hit], low[hit])
    return most, least, other


#: Suffixes with one beginning that are compared in one task.
GROUP_ROWS = 200_000


def _extend(batches: Iterator[pa.RecordBatch], length: int, window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, stop, other_doc_id) of rows (key, doc_id, place, passages) sorted by key."""

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        _, doc, place, passages = rows
        most, least, other = matched(doc, passages)
        hit = np.flatnonzero(most >= 0)
        start = place[hit] - most[hit]
        stop = place[hit] - least[hit] + length
        return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(other[hit])], ["doc_id", "start", "stop", "other_doc_id"])

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        passages = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(-1, window)
        rows = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), passages]
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        if held and (cut or rows[0][0] != held[-1][0][-1]):
            before = [np.concatenate(c) for c in zip(*held, [c[:cut] for c in rows], strict=True)]
            held = []
            yield solve(before)
        elif cut:
            yield solve([c[:cut] for c in rows])
        held.append([c[cut:] for c in rows])
    if held:
        yield solve([np.concatenate(c) for c in zip(*held, strict=True)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of rows sorted by doc_id and start, merged where they overlap or touch."""
    open_span: list | None = None

    def out(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(other, pa.int64())], ["doc_id", "start_token", "stop_token", "other_doc_id"])

    for b in batches:
        if not b.num_rows:
            continue
        doc, start, stop, other = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
        if open_span is not None:
            doc, start, stop, other = (np.concatenate([[o], c]) for o, c in zip(open_span, (doc, start, stop, other), strict=True))
        # the furthest stop so far, document by document
        group = _text.run_ids(doc)
        lift = group * (np.int64(1) << np.int64(33))
        reach = np.maximum.accumulate(stop + lift) - lift
        new = np.ones(len(doc), bool)
        new[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(doc)) - 1
        least = np.minimum.reduceat(other, begin)
        yield out(doc[begin[:-1]], start[begin[:-1]], reach[end[:-1]], least[:-1])
        open_span = [int(doc[begin[-1]]), int(start[begin[-1]]), int(reach[end[-1]]), int(least[-1])]
    if open_span is not None:
        yield out(*(np.array([x]) for x in open_span))


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start_token, stop_token, other_doc_id) of the passages that another document holds too."""
    _spark.session(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
    kept = rows.mapInArrow(lambda b: _keys(b, length, k, window), "key bigint, doc_id bigint, place int")
    alike = _spark.checkpoint(kept.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(lambda b: shared_rows(b), "key bigint, doc_id bigint, place int"))

    def around(some: DataFrame, apart: bool, schema: str) -> DataFrame:
        places = some.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
        texts = _spark.likely(rows, F.col("doc_id"), some.select("doc_id").distinct())
        return texts.join(places.hint("shuffle_hash"), "doc_id").mapInArrow(lambda b: _passages(b, length, window, apart), schema)

    heavy = _spark.checkpoint(alike.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("key"))
    hot = not heavy.isEmpty()
    near = around(alike.join(heavy, "key", "left_anti") if hot else alike, False, "key bigint, doc_id bigint, place int, passages binary")
    spans = near.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(lambda b: _extend(b, length, window), "doc_id bigint, start int, stop int, other_doc_id bigint")
    if hot:
        each = _spark.checkpoint(around(alike.join(heavy, "key", "left_semi"), True, "passage bigint, doc_id bigint, start int"))
        holders = each.groupBy("passage").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
        other = F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
        spans = spans.unionByName(each.join(holders, "passage").select("doc_id", "start", (F.col("start") + length).alias("stop"), other.alias("other_doc_id")))
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_merge, "doc_id bigint, start_token int, stop_token int, other_doc_id bigint")
