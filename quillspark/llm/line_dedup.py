"""Line dedup by pairwise alignment.

Lines are compared by a hash of their text without surrounding white space; the
hash by which documents find each other is another one, so that two lines of
equal hashes by chance don't lead to a deletion.
Documents overlap if they share a line of at least ``MIN_LINE`` characters or a
run of lines that makes a block: a rare one, held by at most ``RARE`` documents,
pairs all of these; a more frequent one pairs each document with the first that
holds it.  A document that keeps part of a frequent run then goes on to the
earlier holders after the first, twice as many in each round, until the run is
deleted or none is left.  So the result is that of all pairs, while pairs grow
with the lines, not their square, wherever an early holder settles them.  Each pair is aligned by patience diff: lines unique on both sides
anchor the longest common increasing sequence, between anchors the alignment
goes on recursively, and equal lines next to an anchor join it.  The documents
that pair with one earlier document are aligned with it in portions of about
``HUB``, so that a line which very many share is no hot spot.  Aligned blocks
of consecutive lines with at least ``MIN_BLOCK`` characters are deleted from
the later document, the one with the larger doc_id.

Defined results: a document that loses all its lines with text is dropped; null
and empty texts, texts without a shared line and rows with a null doc_id stay
as they are; rows of equal doc_id are edited alike, line by line number, from
the alignment of the first of them in the order of their text; texts of any
length and number of lines are read whole; an empty table gives an empty result;
further columns pass through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

#: Characters of a line that can make two documents a pair.
MIN_LINE = 20
#: Documents that hold a line at most for it to be rare.
RARE = 8
#: Characters of an aligned block that is deleted.
MIN_BLOCK = 40
#: Later documents that are aligned with one earlier document in one task.
HUB = 2048


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal values, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        once: dict[int, int] = {}
        for i in range(i0, i1):
            once[a[i]] = i if a[i] not in once else -1
        there: dict[int, int] = {}
        for j in range(j0, j1):
            there[b[j]] = j if b[j] not in there else -1
        pairs = [(i, there[v]) for v, i in once.items() if i >= 0 and there.get(v, -1) >= 0]
        if not pairs:
            continue
        pairs.sort()
        tails: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tails, j)
            before.append(ends[at - 1] if at else -1)
            if at == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[at], ends[at] = j, k
        k, chain = ends[-1], []
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        chain.reverse()
        x, y = i0, j0
        for i, j in chain:
            out.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        todo.append((x, i1, y, j1))
    out.sort()
    return out


def doomed(early: list[int], late: list[int], sizes: list[int], min_block: int) -> list[int]:
    """Line numbers of the later document in aligned blocks of enough characters; blank lines (hash 0) neither count nor part a block."""
    at = [k for k, v in enumerate(late) if v]
    pairs = patience([v for v in early if v], [late[k] for k in at])
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*pairs, (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[at[x]] for x in block) >= min_block:
                out += [at[x] for x in block]
            block = []
        block.append(j)
        last = (i, j)
    return out


def runs(h: list[int], n: list[int], min_block: int) -> Iterator[tuple[int, list[int]]]:
    """(key, line numbers) of the runs of lines that make a block and would not without their first line, or are the shortest from it on.

    Every line of a block of consecutive lines is in such a run within the block.
    """
    at = [k for k, v in enumerate(h) if v]
    for start in range(len(at)):
        key = total = 0
        for stop in range(start, len(at)):
            k = at[stop]
            if total >= min_block and total + n[k] - n[at[start]] >= min_block:
                break
            total += n[k]
            key = (key * 0x9E3779B97F4A7C15 + h[k]) & 0xFFFFFFFFFFFFFFFF
            if total >= min_block:
                yield key - (1 << 64) if key >> 63 else key, at[start : stop + 1]


def _runs(batches: Iterator[pa.RecordBatch], min_line: int, min_block: int) -> Iterator[pa.RecordBatch]:
    """(id, key) of each long line and of each run of lines that makes a block."""
    for b in batches:
        ids, keys = [], []
        for doc, h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found = {v for v, k in zip(h, n, strict=True) if v and k >= min_line}
            found.update(key for key, _ in runs(h, n, min_block))
            ids += [doc] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["id", "line"])


def _left(batches: Iterator[pa.RecordBatch], min_block: int) -> Iterator[pa.RecordBatch]:
    """(id, line, rank) of rows (id, h, n, held, gone): the held keys (line, rank) of runs that aren't wholly deleted."""
    for b in batches:
        out = []
        for doc, h, n, held, gone in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            gone = set(gone or ())
            left = {key for key, at in runs(h, n, min_block) if not gone.issuperset(at)}
            out += [(doc, x["line"], x["rank"]) for x in held if x["line"] in left]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], ["id", "line", "rank"])


def _align(batches: Iterator[pa.RecordBatch], min_block: int) -> Iterator[pa.RecordBatch]:
    """(id, gone) of rows (early, salt, late, h, n) sorted by these: a null late brings the lines of the early document itself, and its pairs follow."""
    early: list[int] = []
    for b in batches:
        ids, lines = [], []
        for late, h, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if late is None:
                early = h
            elif gone := doomed(early, h, n, min_block):
                ids.append(late)
                lines.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], ["id", "gone"])


def ranked(held: DataFrame) -> DataFrame:
    """(line, id, rank) of rows (line, id): the place of id among those of its line, from 1.

    Rows are sorted over all tasks together, so that a line of very many
    documents is spread, and each task's places go on from those before.
    """
    spread = _spark.checkpoint(held.repartitionByRange("line", "id").sortWithinPartitions("line", "id").withColumn("task", F.spark_partition_id()))
    counts = spread.groupBy("line", "task").agg(F.count("*").alias("k"))
    before = counts.select("line", "task", (F.sum("k").over(Window.partitionBy("line").orderBy("task")) - F.col("k")).alias("before"))
    here = F.row_number().over(Window.partitionBy("line", "task").orderBy("id"))
    return spread.withColumn("here", here).join(before, ["line", "task"]).select("line", "id", (F.col("before") + F.col("here")).cast("int").alias("rank"))


def deletions(docs: DataFrame, min_line: int = MIN_LINE, rare: int = RARE, min_block: int = MIN_BLOCK, hub: int = HUB) -> DataFrame:
    """(id, gone): the line numbers, from 0, that each later document loses."""
    _spark.session(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text")).where("id is not null and text is not null")
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    hashed = lambda seed: F.transform("t", lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(x, *seed)))
    lines = rows.select("id", trimmed.alias("t")).select("id", hashed([F.lit("other")]).alias("h"), F.transform("t", lambda x: F.length(x)).alias("n"), hashed([]).alias("k"))
    lines = _spark.checkpoint(lines)
    held = lines.select("id", "k", "n").mapInArrow(lambda b: _runs(b, min_line, min_block), "id bigint, line bigint").distinct()
    facts = held.groupBy("line").agg(F.count("*").alias("df"), F.min("id").alias("first")).where("df > 1")
    shared = held.join(facts, "line")
    star = shared.where("id > first").select(F.col("first").alias("early"), F.col("id").alias("late"))
    few = shared.where((F.col("df") > 2) & (F.col("df") <= rare)).groupBy("line").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    clique = few.select(F.explode("ids").alias("early"), "ids").select("early", F.explode("ids").alias("late")).where("early < late")
    once = lines.groupBy("id").agg(F.min_by(F.struct("h", "n", "k"), F.struct("h", "n")).alias("x")).select("id", "x.h", "x.n", "x.k")

    def align(pairs: DataFrame) -> DataFrame:
        # an early document's lines travel once to each portion of its pairs, not with each pair
        pairs = pairs.distinct()
        portions = pairs.groupBy("early").agg(F.ceil(F.count("*") / hub).cast("int").alias("portions"))
        many = portions.where("portions > 1")
        late = pairs.join(many, "early", "left").join(once.select(F.col("id").alias("late"), "h", "n"), "late")
        late = late.select("early", F.pmod(F.xxhash64("late"), F.coalesce("portions", F.lit(1))).cast("int").alias("salt"), "late", "h", "n")
        own = portions.join(once, F.col("early") == F.col("id")).select("early", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("late"), "h", F.lit(None).cast("array<int>").alias("n"))
        both = late.unionByName(own).repartition("early", "salt").sortWithinPartitions("early", "salt", F.asc_nulls_first("late"))
        return both.mapInArrow(lambda b: _align(b, min_block), "id bigint, gone array<int>")

    def together(found: DataFrame) -> DataFrame:
        return _spark.checkpoint(found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))

    gone = together(align(star.unionByName(clique)))
    frequent = _spark.checkpoint(ranked(shared.where(F.col("df") > rare).select("line", "id")))
    todo = frequent.where("rank > 2")
    low = 2
    while True:
        mine = todo.groupBy("id").agg(F.collect_list(F.struct("line", "rank")).alias("held"))
        state = once.join(mine.hint("shuffle_hash"), "id").join(gone.hint("shuffle_hash"), "id", "left").select("id", "k", "n", "held", "gone")
        todo = _spark.checkpoint(state.mapInArrow(lambda b: _left(b, min_block), "id bigint, line bigint, rank int").where(F.col("rank") > low))
        if todo.isEmpty():
            return gone
        earlier = frequent.where((F.col("rank") >= low) & (F.col("rank") < 2 * low)).select("line", F.col("id").alias("early"), F.col("rank").alias("place"))
        more = todo.join(earlier, "line").where("place < rank").select("early", F.col("id").alias("late"))
        gone = together(gone.unionByName(align(more)))
        low *= 2


def dedup(docs: DataFrame, min_line: int = MIN_LINE, rare: int = RARE, min_block: int = MIN_BLOCK, hub: int = HUB) -> DataFrame:
    """docs without the lines that an earlier document holds in an aligned block, and without documents that consist of such lines."""
    lost = deletions(docs, min_line, rare, min_block, hub).select(F.col("id").alias("lost_id"), "gone")
    at, columns = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(len(columns))
            cut = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            found = [b.column(k) for k in range(len(columns))]
            stays = np.ones(b.num_rows, bool)
            if len(cut):
                texts = found[at].to_pylist()
                for k in cut.tolist():
                    if texts[k] is None:
                        continue
                    out = set(gone[k].as_py())
                    left = [x for i, x in enumerate(texts[k].split("\n")) if i not in out]
                    texts[k] = "\n".join(left)
                    stays[k] = any(x.strip(" \t\r") for x in left)
                found[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(found, schema=pa.schema([b.schema.field(k) for k in range(len(columns))])).filter(pa.array(stays))

    # the user's columns travel as one, so that their names can't clash
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    joined = packed.join(lost.hint("shuffle_hash"), F.col("row.doc_id").cast("bigint") == F.col("lost_id"), "left")
    flat = joined.select(*(F.col("row")[c].alias(f"c{k}") for k, c in enumerate(columns)), F.col("gone").alias(f"c{len(columns)}"))
    back = flat.mapInArrow(run, ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)))
    return back.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))
