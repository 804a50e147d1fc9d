"""Exact dedup by counting quotient filters.

Every text has a 64-bit fingerprint.  Each partition builds counting quotient
filters of its fingerprints, one for each range of the leading bits: the
quotient names a canonical slot, remainders stand sorted in runs from there on,
and each remainder has a count.  Filters of a range are merged without loss by
merging their sorted remainders and adding counts.  Fingerprints whose count is
above one, and only those, route their texts to comparison of the bytes.

Defined results: a null text equals nothing; empty texts equal each other; a
row with a null doc_id counts for nothing; the smallest doc_id of a group of
equal texts stays and each other one is listed once, however often it occurs;
texts of any length are compared whole; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Share of a filter's quotients that are in use.
LOAD = 0.75
#: Fingerprints of a merged range, about.
RANGE = 1 << 20


class QuotientFilter:
    """A counting quotient filter of distinct values of ``bits`` bits with counts.

    A value's leading ``q`` bits are its quotient, the rest its remainder.
    ``occupied`` marks the quotients in use, ``run_end`` the last slot of each
    quotient's run; runs follow each other in the order of their quotients,
    each from its quotient's slot on or from the end of the run before.
    ``slots`` holds the remainders and ``counts`` how often each was seen.
    """

    def __init__(self, bits: int, q: int, occupied: np.ndarray, run_end: np.ndarray, used: np.ndarray, slots: np.ndarray, counts: np.ndarray):
        self.bits, self.q = bits, q
        self.occupied, self.run_end, self.used, self.slots, self.counts = occupied, run_end, used, slots, counts

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray | None = None, bits: int = 64) -> QuotientFilter:
        """The filter of values, in any order and with repeats; counts are added up."""
        values = values.astype(np.uint64)
        counts = np.ones(len(values), np.int64) if counts is None else counts
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        begin = np.flatnonzero(np.diff(values, prepend=values[:1] ^ np.uint64(1)) != 0) if len(values) else np.zeros(0, np.int64)
        values, counts = values[begin], np.add.reduceat(counts, begin) if len(begin) else counts[:0]
        n = len(values)
        q = min(bits, max(1, int(np.ceil(np.log2(max(2, n) / LOAD)))))
        quotient = (values >> np.uint64(bits - q)).astype(np.int64)
        at = np.maximum.accumulate(quotient - np.arange(n)) + np.arange(n) if n else quotient
        size = max(1 << q, int(at[-1]) + 1 if n else 0)
        occupied, run_end, used = np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool)
        slots, held = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        occupied[quotient] = True
        used[at] = True
        slots[at] = values & np.uint64((1 << (bits - q)) - 1)
        held[at] = counts
        if n:
            run_end[at[np.append(quotient[1:] != quotient[:-1], True)]] = True
        return cls(bits, q, occupied, run_end, used, slots, held)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All values, sorted, and their counts: the i-th run belongs to the i-th occupied quotient."""
        at = np.flatnonzero(self.used)
        ends = self.run_end[at]
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << np.uint64(self.bits - self.q)) | self.slots[at], self.counts[at]

    def count(self, value: int) -> int:
        """How often value was added."""
        quotient = value >> (self.bits - self.q)
        if not self.occupied[quotient]:
            return 0
        k = int(self.occupied[: quotient + 1].sum())
        ends = np.flatnonzero(self.run_end)
        first = max(quotient, int(ends[k - 2]) + 1 if k > 1 else 0)
        run = slice(first, int(ends[k - 1]) + 1)
        hit = np.flatnonzero(self.used[run] & (self.slots[run] == np.uint64(value & ((1 << (self.bits - self.q)) - 1))))
        return int(self.counts[run][hit[0]]) if len(hit) else 0

    @staticmethod
    def merge(filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all that the filters hold, counts added.

        Their values come sorted, so that the stable sort merges these runs.
        """
        parts = [f.items() for f in filters]
        return QuotientFilter.of(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]), filters[0].bits)

    def dump(self) -> bytes:
        """Bit maps, remainders of as many bytes as they need, and counts above one."""
        at = np.flatnonzero(self.used)
        width = (self.bits - self.q + 7) // 8
        rest = self.slots[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        more = np.flatnonzero(self.counts[at] > 1)
        head = np.array([self.bits, self.q, len(self.used), len(at), len(more)], "<i8")
        return b"".join(
            x.tobytes()
            for x in (head, np.packbits(self.occupied), np.packbits(self.run_end), np.packbits(self.used), np.ascontiguousarray(rest), more.astype("<i8"), self.counts[at][more].astype("<i8"))
        )

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        bits, q, size, n, m = (int(x) for x in np.frombuffer(data, "<i8", 5))
        place = 40

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(data, kind, k, place)
            place += out.nbytes
            return out

        bitmap = lambda k: np.unpackbits(take("u1", (k + 7) // 8))[:k].astype(bool)
        occupied, run_end, used = bitmap(1 << q), bitmap(size), bitmap(size)
        width = (bits - q + 7) // 8
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = take("u1", n * width).reshape(n, width)
        at = np.flatnonzero(used)
        slots, counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        slots[at] = rest.view("<u8").ravel()
        counts[at] = 1
        more = take("<i8", m)
        counts[at[more]] = take("<i8", m)
        return cls(bits, q, occupied, run_end, used, slots, counts)


def _build(batches: Iterator[pa.RecordBatch], range_bits: int) -> Iterator[pa.RecordBatch]:
    """One dumped filter for each range of leading bits of a partition's fingerprints."""
    parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
    values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    keep = 64 - range_bits
    edge = np.searchsorted(values >> np.uint64(keep), np.arange((1 << range_bits) + 1, dtype=np.uint64))
    ranges = np.flatnonzero(np.diff(edge))
    mask = np.uint64((1 << keep) - 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ranges, pa.int32()), pa.array([QuotientFilter.of(values[edge[r] : edge[r + 1]] & mask, bits=keep).dump() for r in ranges], pa.binary())],
        ["range", "filter"],
    )


def _merge(batches: Iterator[pa.RecordBatch], range_bits: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints counted more than once, of filters sorted by range."""
    keep = np.uint64(64 - range_bits)
    held: list[QuotientFilter] = []
    at = None

    def repeated() -> pa.RecordBatch:
        values, counts = (held[0] if len(held) == 1 else QuotientFilter.merge(held)).items()
        found = values[counts > 1] | (np.uint64(at) << keep)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["fp"])

    for b in batches:
        for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if at is not None and r != at:
                yield repeated()
                held = []
            at = r
            held.append(QuotientFilter.load(data))
            if len(held) >= 64:
                held = [QuotientFilter.merge(held)]
    if held:
        yield repeated()


def repeated_fingerprints(fingerprints: DataFrame, range_bits: int) -> DataFrame:
    """The values of the one bigint column that occur more than once, from filters of 2**range_bits ranges."""
    filters = fingerprints.mapInArrow(lambda b: _build(b, range_bits), "range int, filter binary")
    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(lambda b: _merge(b, range_bits), "fp bigint")


def duplicates(docs: DataFrame, range_bits: int | None = None, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, duplicate_of) of every document whose text equals that of one with a smaller doc_id.

    Ranges hold about ``RANGE`` fingerprints, unless their bits are given.
    """
    _spark.session(docs)
    if range_bits is None:
        range_bits = max(2, (docs.count() // RANGE).bit_length())
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null").withColumn("fp", F.xxhash64("text"))
    repeated = _spark.checkpoint(repeated_fingerprints(rows.select("fp"), range_bits))
    # only texts of repeated fingerprints move on; a few others may pass, which equal nothing
    suspects = _spark.checkpoint(_spark.likely(rows, F.col("fp"), repeated).withColumn("digest", digest(F.col("text"))))
    # equal bytes make a class, named by its first document; a text travels once from each partition
    classes = _spark.checkpoint(suspects.groupBy("fp", "text").agg(F.min("doc_id").alias("first"), F.min("digest").alias("digest")).select("fp", "digest", "first"))
    # a digest only finds a document's class again; where one digest names two classes, bytes decide
    shared = classes.groupBy("fp", "digest").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    found = suspects.select("fp", "doc_id", "digest").distinct().join(shared.where("n = 1"), ["fp", "digest"]).select("doc_id", "first")
    twins = shared.where("n > 1").select("fp", "digest")
    if not twins.isEmpty():
        alike = suspects.join(twins, ["fp", "digest"], "left_semi")
        found = found.unionByName(alike.join(alike.groupBy("fp", "text").agg(F.min("doc_id").alias("first")), ["fp", "text"]).select("doc_id", "first"))
    return found.where("doc_id > first").groupBy("doc_id").agg(F.min("first").alias("duplicate_of"))
