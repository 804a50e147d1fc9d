"""N-gram Jaccard join with count-vector R-trees.

A document is the set of the hashes of its ``N``-grams of tokens.  Hashing the
n-grams into ``GROUPS`` groups gives a vector of group counts, a point; the
overlap of two sets is at most the sum over the groups of the smaller count, so
a rectangle of points bounds the overlap with any point in it.  Points are
packed into R-trees and searched for all that may reach the threshold; documents
that surviving pairs join form groups, and within these all pairs are verified
on the sets themselves.

Since counts of random groups don't keep unlike documents apart along any one
axis, one tree over the corpus would compare nearly all pairs.  So trees are
built in blocks: documents with the same two neighbouring values among the
``SKETCH`` first n-grams in the order of a hash, and, for small sets, the same
value among the first of an exact prefix.  This is the approximate part: of
pairs right at the threshold, two in a million share no block, whichever
n-grams they differ in, and fewer of more alike ones.  Blocks of more than
``BLOCK`` points are searched part against part, all of them, so that no block
has to fit into one task.  Since counts bound little where sets are large, a
surviving pair is also compared on the first ``SAMPLE`` n-grams of its union,
and dropped where these fall short of the threshold by more than ``SLACK``
standard deviations: one in a million at the threshold.

Documents with equal sets are one point, and what stands for a set is its
smallest doc_id.  Results are rows a document or pairs of sets, so that they
don't grow with the square of a group of copies.

Defined results: a text of fewer than ``N`` tokens is the set of its one
shorter n-gram; null texts and texts without tokens join nothing; rows with a
null doc_id are left out; a doc_id with several texts is in the class of each of
them, which makes them one class, and its links are those of all its texts;
repeated rows count once; texts of any length are read whole; an empty table
gives an empty result.  Only ``doc_id`` and ``text`` are read; ``one_of_each``
passes all columns through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from .components import components
from .suffix_dedup import shared_rows

#: Tokens of an n-gram.
N = 2
#: Jaccard similarity from which two documents are a pair.
THRESHOLD = 0.5
#: Groups that n-grams are hashed into: dimensions of the R-tree.
GROUPS = 256
#: The largest count; a vector of nothing else leaves all overlaps possible.
FULL = 255
#: N-grams of a document that make blocks.
SKETCH = 48
#: Sets of up to so many n-grams also make blocks of their exact prefix.
SMALL = 48
#: N-grams of a document, the first in the order, on which surviving pairs are compared before their sets are.
SAMPLE = 64
#: Standard deviations by which a sample may fall short of the threshold.
SLACK = 4.75
#: Points of a block that are searched in one tree.
BLOCK = 4096
#: Points in a leaf, and children of a node, of an R-tree.
FANOUT = 16


def gram_sets(raw: np.ndarray, off: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row the sorted distinct n-gram hashes, and the order of the sketch."""
    t = _text.tokens(raw, off)
    g = _text.grams(t.hash, n)
    # a plain hash order: in any order by content, changes of what comes first would fill the sketch
    rank = _text.mix(g + np.uint64(7))
    out = []
    for a, b in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            h, first = np.unique(g[a : b - n + 1], return_index=True)
            out.append((h, rank[a : b - n + 1][first]))
        elif b > a:
            h = _text.grams(t.hash[a:b], b - a)
            out.append((h, h))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


def block_keys(h: np.ndarray, rank: np.ndarray, sketch: int, small: int, threshold: float) -> np.ndarray:
    """Keys of the blocks that a set belongs to."""
    k = min(len(h), sketch)
    first = h[np.argpartition(rank, k - 1)[:k]] if len(h) > k else h
    if len(h) > k:
        r = np.partition(rank, k - 1)[k - 1]
        at = np.flatnonzero(rank <= r)
        first = h[at[np.lexsort((h[at], rank[at]))][:k]]
    else:
        first = h[np.lexsort((h, rank))]
    keys = [_text.mix(first[:-1] * np.uint64(3) + first[1:])] if len(first) > 1 else []
    if len(h) <= small:
        order = h[np.lexsort((h, rank))]
        keys.append(_text.mix(order[: len(h) - math.ceil(threshold * len(h)) + 1] + np.uint64(11)))
    return np.unique(np.concatenate(keys)) if keys else h[:0]


def sample(rank: np.ndarray) -> np.ndarray:
    """The first ``SAMPLE`` places in the order, 32 bits each; the largest number where there are fewer."""
    first = np.sort((rank >> np.uint64(32)).astype("<u4"))[:SAMPLE]
    return np.concatenate([first, np.full(SAMPLE - len(first), 0xFFFFFFFF, "<u4")])


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether samples, row by row, allow the threshold."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        both = np.sort(np.concatenate([a[at : at + (1 << 15)], b[at : at + (1 << 15)]], axis=1), axis=1)
        there = both != 0xFFFFFFFF
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & there[:, 1:]
        place = np.cumsum(there & ~twice, axis=1)
        n = np.minimum(place[:, -1], SAMPLE)
        shared = (twice & (place <= SAMPLE)).sum(1)
        out[at : at + (1 << 15)] = shared >= threshold * n - SLACK * np.sqrt(n * threshold * (1 - threshold))
    return out


def _points(batches: Iterator[pa.RecordBatch], n: int, groups: int, sketch: int, small: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, size, same, vec, keys) of rows (doc_id, text) that have tokens; same identifies the set, vec has the counts and the sample."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        raw, off = _text.buffers(b.column(1))
        for a, _, r, o in _text.chunks(raw, off):
            sets = gram_sets(r, o, n)
            at = [k for k, (h, _) in enumerate(sets) if len(h)]
            same, vec, keys, size = [], [], [], []
            for k in at:
                h, rank = sets[k]
                size.append(len(h))
                same.append(_number(h))
                count = np.bincount((h >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)
                # counts take a byte; where one doesn't fit, all are the largest, which bounds nothing
                vec.append((count if count.max() < FULL else np.full(groups, FULL)).astype(np.uint8).tobytes() + sample(rank).tobytes())
                keys.append(block_keys(h, rank, sketch, small, threshold).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a + np.array(at, np.int64)]), pa.array(size, pa.int32()), pa.array(same, pa.int64()), pa.array(vec, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "size", "same", "vec", "keys"],
            )


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest possible overlaps of sets with these counts, row by row."""
    return np.where((a[..., 0] == FULL) | (b[..., 0] == FULL), np.int64(1) << 40, np.minimum(a, b).sum(-1, dtype=np.int64))


class RTree:
    """A packed R-tree over count vectors of sets of given sizes; each node holds the largest counts of what is below it."""

    def __init__(self, points: np.ndarray, size: np.ndarray, fanout: int = FANOUT):
        self.fanout = fanout
        self.size = size
        # packed by size, then by the counts of the widest groups, tile by tile
        order = np.argsort(self.size, kind="stable")
        wide = np.argsort(-points.var(0))[:2] if len(points) else np.zeros(2, np.int64)
        tile = fanout * fanout
        order = np.concatenate([c[np.lexsort((points[c, wide[-1]], points[c, wide[0]]))] for c in np.split(order, range(tile, len(order), tile))]) if len(order) else order
        self.order, self.points = order, points[order]
        self.levels = []
        top, low, high = self.points, self.size[order], self.size[order]
        while len(top) > 1:
            cut = np.arange(0, len(top), fanout)
            top, low, high = np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, q: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Numbers of the points whose overlap bound with q, a set of n, allows the threshold."""
        share = threshold / (1 + threshold)

        def may(top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return (high >= threshold * n) & (low * threshold <= n) & (bound(top, q) >= share * (n + low) - 1e-9)

        at = np.zeros(1, np.int64) if self.levels else np.arange(len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            at = at[may(top[at], low[at], high[at])]
            at = (at[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.points))]
        s = self.size[self.order[at]]
        return self.order[at[may(self.points[at], s, s)]]


def _parts(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(key, id, part) of rows (key, id) sorted by both, of keys with several ids.

    Keys of the same ids get one key, so that what is alike in many n-grams is
    searched once.  Of more ids than ``block`` each ``block`` make a part.
    """
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    seen, last = 0, 0  # rows that are out already of a key that goes on, and this key

    def out(key: np.ndarray, ids: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(part.astype(np.int32))], ["key", "id", "part"])

    def whole(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.diff(_text.run_ids(key), prepend=-1))
        span = np.diff(np.append(begin, len(key)))
        mark = _text.mix(np.add.reduceat(_text.mix(ids.view(np.uint64) + np.uint64(1)), begin) + span.astype(np.uint64)).view(np.int64)
        name = np.where(span > block, key[begin], mark)
        return out(np.repeat(name, span), ids, (np.arange(len(key)) - np.repeat(begin, span)) // block)

    def rest(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return out(key, ids, (seen + np.arange(len(key))) // block)

    for b in shared_rows(batches):
        key, ids = (np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False)]) for c, h in enumerate(held))
        if not len(key):
            continue
        if seen:
            n = int(np.searchsorted(key != last, True))
            yield rest(key[:n], ids[:n])
            seen, key, ids = (seen + n if n == len(key) else 0), key[n:], ids[n:]
        cut = int(np.searchsorted(_text.run_ids(key), _text.run_ids(key)[-1], side="left")) if len(key) else 0
        if cut:
            yield whole(key[:cut], ids[:cut])
        held = [key[cut:], ids[cut:]]
        if len(held[0]) > block:
            last = held[0][0]
            yield rest(*held)
            seen, held = len(held[0]), [key[:0], ids[:0]]
    if len(held[0]):
        yield whole(*held)


def _search(batches: Iterator[pa.RecordBatch], groups: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (key, one, two, part, id, size, vec) sorted by the first three.

    The points of part ``one`` of a block are its tree, those of part ``two``
    its queries.  Points that surviving pairs join are each linked to the first
    of them.
    """
    held: list | None = None

    def solve(run: np.ndarray, side: np.ndarray, ids: np.ndarray, size: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
        vec, drawn = both[:, :groups], np.ascontiguousarray(both[:, groups:]).view("<u4")
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        stop = np.append(begin[1:], len(run))
        left, right = [], []
        share = threshold / (1 + threshold)
        # blocks of one leaf, all at once: each row against the k-th after it in its block
        span = stop - begin
        whole = np.maximum.reduceat(side, begin) == 0 if len(begin) else np.zeros(0, bool)
        few = (span <= FANOUT) & whole
        leaf = np.repeat(few, span)
        for k in range(1, FANOUT):
            i = np.flatnonzero(leaf[:-k] & (run[k:] == run[:-k])) if len(run) > k else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + k
            sure = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            i, j = i[sure], j[sure]
            sure = bound(vec[i], vec[j]) >= share * (size[i] + size[j]) - 1e-9
            i, j = i[sure], j[sure]
            sure = alike(drawn[i], drawn[j], threshold)
            left.append(i[sure])
            right.append(j[sure])
        for x, y, one in zip(begin[~few].tolist(), stop[~few].tolist(), whole[~few].tolist(), strict=True):
            trees = np.arange(x, y) if one else x + np.flatnonzero(side[x:y] == 0)
            asked = trees if one else x + np.flatnonzero(side[x:y])
            tree = RTree(vec[trees], size[trees])
            for k in asked.tolist():
                found = trees[tree.search(vec[k], int(size[k]), threshold)]
                found = found[found > k] if one else found
                found = found[alike(drawn[np.full(len(found), k)], drawn[found], threshold)]
                left.append(np.full(len(found), k))
                right.append(found)
        i = np.concatenate(left) if left else np.zeros(0, np.int64)
        j = np.concatenate(right) if right else np.zeros(0, np.int64)
        root = labels(len(run), i, j)
        k = np.flatnonzero(root != np.arange(len(run)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[k]]), pa.array(ids[k])], ["a", "b"])

    def ready(rows: list) -> pa.RecordBatch:
        key, one, two, part, ids, size, vec = rows
        return solve(_text.run_ids(key, one, two), ((part == two) & (one != two)).astype(np.int8), ids, size, vec)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)), np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, groups + 4 * SAMPLE)]
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
        run = _text.run_ids(*rows[:3])
        cut = int(np.searchsorted(run, run[-1], side="left"))
        if cut:
            yield ready([c[:cut] for c in rows])
        held = [c[cut:] for c in rows]
    if held is not None:
        yield ready(held)


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n points joined by the pairs (i, j), the smallest point that each is joined to, directly or through others."""
    out = np.arange(n)
    while len(i):
        low = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, out[i], low)
        np.minimum.at(new, out[j], low)
        new = new[new]
        if (new == out).all():
            break
        out = new
        apart = out[i] != out[j]
        i, j = i[apart], j[apart]
    while (out[out] != out).any():
        out = out[out]
    return out


#: Cells of a 0-1 matrix of sets and n-grams that is multiplied at once.
CELLS = 1 << 23


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of the pairs of sets that reach the threshold: of left with right, or i < j within left."""
    sets = left + (right or [])
    size = np.array([len(x) for x in sets])
    grams, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[inverse]  # what one set alone holds is in no overlap
    row, column = row[column >= 0], column[column >= 0]
    width = max(1, CELLS // len(sets))
    n = len(left)
    overlap = np.zeros((n, len(right) if right else n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, top, width):
        x, y = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(sets), min(width, top - a)), np.float32)
        m[row[x:y], column[x:y] - a] = 1
        overlap += m[:n] @ (m[n:] if right else m).T
    joined = size[:n, None] + (size[n:] if right else size)[None, :] - overlap
    hit = overlap >= threshold * joined - 1e-6
    if right is None:
        hit = np.triu(hit, 1)
    at = np.nonzero(hit)
    return at[0], at[1], overlap[at].astype(np.float64) / joined[at]


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float, every: bool) -> Iterator[pa.RecordBatch]:
    """What verified pairs are in rows (root, one, two, tile, node, first, n, grams) sorted by the first three.

    With ``every`` the pairs (a, b, jaccard) of sets, by their first documents.
    Else (node, a, b, links): each set of a pair, the first of the sets that
    pairs join it to, its own first document, and how many documents its pairs
    link it to; one row for each set of a tile.
    """
    held: list[tuple] = []
    at: tuple | None = None

    def solve(key: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[1]: r for r in rows}.values())  # repeated rows of a document
        left = [r for r in rows if r[0] == key[1]]
        right = [r for r in rows if r[0] != key[1]] if key[1] != key[2] else None
        if not left or right == [] or len(rows) < 2:
            return None
        unpack = lambda rs: [np.frombuffer(r[4], "<u4") for r in rs]
        i, j, score = similar(unpack(left), unpack(right) if right else None, threshold)
        if right:
            rows, j = left + right, j + len(left)
        first = np.array([r[2] for r in rows], np.int64)
        if every:
            a, b = first[i], first[j]
            ok = a != b
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(score[ok])], ["a", "b", "jaccard"])
        n = np.array([r[3] for r in rows], np.float64)
        links = np.bincount(i, weights=n[j], minlength=len(rows)) + np.bincount(j, weights=n[i], minlength=len(rows))
        root = labels(len(rows), i, j)
        k = np.flatnonzero(links)
        node = np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(first[root[k]]), pa.array(first[k]), pa.array(links[k].astype(np.int64))], ["node", "a", "b", "links"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
        for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in range(3, 8)), strict=True), strict=True):
            if key != at:
                if held and (found := solve(at, held)) is not None:
                    yield found
                held, at = [], key
            held.append(row)
    if held and (found := solve(at, held)) is not None:
        yield found


def _number(h: np.ndarray) -> int:
    """Identifies a set."""
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(_text.mix(h + np.uint64(5))).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, ..., grams) of rows (id, text, ...) whose text is the set of this number: the distinct n-grams, 32 bits each."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        raw, off = _text.buffers(b.column(1))
        for a, z, r, o in _text.chunks(raw, off):
            sets = [h for h, _ in gram_sets(r, o, n)]
            own = pa.array([len(h) > 0 and _number(h) == k for h, k in zip(sets, ids[a:z].tolist(), strict=True)], pa.bool_())
            packed = [np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for h in sets]
            rest = [b.column(k).slice(a, z - a) for k in (0, *range(2, b.num_columns))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(packed, pa.binary())], [b.schema.names[0], *b.schema.names[2:], "grams"]).filter(own)


#: Sets of a group that are compared at once; larger groups are compared tile by tile.
TILE = 1024


def _members(docs: DataFrame, n: int, threshold: float, groups: int, sketch: int, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, text); (same, id) of the distinct sets and their documents; points of the sets (id, size, vec, keys), each by its number."""
    _spark.session(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text")).where("id is not null and text is not null")
    points = _spark.checkpoint(rows.mapInArrow(lambda b: _points(b, n, groups, sketch, small, threshold), "id bigint, size int, same bigint, vec binary, keys array<bigint>"))
    ids = points.select("same", "id").distinct()
    first = points.groupBy("same").agg(F.min("id").alias("id"))
    lone = first.join(points, ["same", "id"]).dropDuplicates(["same"]).select(F.col("same").alias("id"), "size", "vec", "keys")
    return rows, ids, _spark.checkpoint(lone)


def _verified(rows: DataFrame, sets: DataFrame, points: DataFrame, n: int, threshold: float, groups: int, block: int, every: bool) -> DataFrame:
    """The rows of ``_tiles`` for the sets (same, first, n)."""
    keys = points.select(F.explode("keys").alias("key"), "id").repartition("key").sortWithinPartitions("key", "id")
    blocks = _spark.checkpoint(keys.mapInArrow(lambda b: _parts(b, block), "key bigint, id bigint, part int"))
    large = blocks.where("part > 0").groupBy("key").agg((F.max("part") + 1).alias("parts"))
    cut = blocks.join(large, "key", "left").groupBy("id").agg(F.collect_set(F.struct("key", "part", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("held"))
    keyed = points.select("id", "size", "vec").join(cut.hint("shuffle_hash"), "id").select(F.explode("held").alias("k"), "id", "size", "vec")
    sides = keyed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("k.parts") - 1))).select("k.key", F.least("k.part", "u").alias("one"), F.greatest("k.part", "u").alias("two"), "k.part", "id", "size", "vec")
    order = ["key", "one", "two"]
    near = sides.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _search(b, groups, threshold), "a bigint, b bigint").distinct()
    # surviving pairs make groups; each set travels to its group once, or once a row of tiles of a large one
    found = components(near)
    tiles = F.ceil(F.col("k") / TILE).cast("int")
    member = found.join(found.groupBy("root").agg(F.count("*").alias("k")), "root").select("node", "root", tiles.alias("m"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("tile"))
    member = _spark.checkpoint(member.join(sets.select(F.col("same").alias("node"), F.col("first").alias("id"), "n"), "node"))
    texts = _spark.likely(rows, F.col("id"), member.select("id")).join(member.hint("shuffle_hash"), "id").select(F.col("node").alias("id"), "text", "root", "m", "tile", F.col("id").alias("first"), "n")
    grams = texts.mapInArrow(lambda b: _sets(b, n), "id bigint, root bigint, m int, tile int, first bigint, n bigint, grams binary")
    other = grams.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("root", F.least("tile", "u").alias("one"), F.greatest("tile", "u").alias("two"), "tile", F.col("id").alias("node"), "first", "n", "grams")
    order = ["root", "one", "two"]
    return other.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _tiles(b, threshold, every), "a bigint, b bigint, jaccard double" if every else "node bigint, a bigint, b bigint, links bigint")


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, groups: int = GROUPS, sketch: int = SKETCH, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, other_doc_id, jaccard) of the pairs of distinct sets at the threshold or above, doc_id < other_doc_id.

    A set is named by its smallest doc_id; what else has this set is in ``members``.
    """
    rows, ids, points = _members(docs, n, threshold, groups, sketch, small)
    sets = ids.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return _verified(rows, sets, points, n, threshold, groups, block, every=True).select(F.col("a").alias("doc_id"), F.col("b").alias("other_doc_id"), "jaccard")


def members(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, first_doc_id): the smallest doc_id whose set equals that of the document."""
    _, ids, _ = _members(docs, n, THRESHOLD, GROUPS, SKETCH, SMALL)
    first = ids.groupBy("same").agg(F.min("id").alias("first_doc_id"))
    return ids.join(first, "same").select(F.col("id").alias("doc_id"), "first_doc_id")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, groups: int = GROUPS, sketch: int = SKETCH, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, links) of every document that is linked to another.

    Two documents are linked if their sets reach the threshold, copies among
    them; ``links`` counts a document's links, all of them verified, and
    ``class_id`` is the smallest doc_id that links lead to, directly or through
    others.
    """
    rows, ids, points = _members(docs, n, threshold, groups, sketch, small)
    ids = _spark.checkpoint(ids)
    sets = ids.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    linked = _spark.checkpoint(_verified(rows, sets, points, n, threshold, groups, block, every=False))
    # a document of several texts joins their classes
    several = ids.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    joints = ids.join(several, "id").join(sets.select("same", "first"), "same").select(F.col("first").alias("a"), F.col("id").alias("b"))
    roots = components(linked.where("a <> b").select("a", "b").unionByName(joints))
    links = linked.groupBy(F.col("node").alias("same")).agg(F.sum("links").alias("more"))
    known = sets.join(links, "same", "left").select("same", "first", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links")).where("links > 0")
    named = known.join(roots.withColumnRenamed("node", "first"), "first", "left").select("same", F.coalesce("root", "first").alias("class"), "links")
    return ids.join(named, "same").groupBy(F.col("id").alias("doc_id")).agg(F.min("class").alias("class_id"), F.sum("links").alias("links"))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents of a class whose doc_id isn't the class'."""
    gone = classes(docs, n, threshold).where("class_id < doc_id").select(F.col("doc_id").alias("__gone"))
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(gone.hint("shuffle_hash"), F.col("row.doc_id").cast("bigint") == F.col("__gone"), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
