"""Benchmark decontamination with a generalised suffix automaton.

The normalised tokens of all test items form one generalised suffix automaton.
Training tokens stream through it; at each token the automaton tracks the
longest match that ends there, and its suffix links lead to the shorter ones.
A match is removed if it is at least ``length`` tokens long or covers at least
``coverage`` of an item that holds it; at each token the longest such match is
found, also where a longer match of another item hides it.  Words of which no
item consists, and pairs of neighbours that no item holds, end a match; they are
found for whole batches at once, and only the stretches between them that are
long enough to exceed a limit go through the automaton token by token.

An automaton takes 6 to 8 bytes of memory for each byte of its items, and some
30 while it is built.  Test items of more than ``PART_BYTES`` make several automata, through which the
documents stream one after the other, with the same result.

Defined results: null, empty and blank texts and items have no tokens and match
nothing; overlapping matches are one span, which names the item of its longest
match: of those that hold it the shortest, then the one with the smallest
item_id, null ids last; offsets count characters of the text as it stands; a
text of any length is read whole; repeated rows give repeated results; without
items nothing matches.  Further columns, of any name, pass through untouched.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

#: A match of so many tokens is removed.
LENGTH = 13
#: So is a match of this share of an item.
COVERAGE = 0.8
#: Fewer tokens are never removed, whatever they cover.
LEAST = 5
#: Bytes of test items in one automaton.
PART_BYTES = 8_000_000

#: Start, stop, item_id, and tokens of the longest match.
Span = tuple[int, int, int | None, int]


class Automaton:
    """A generalised suffix automaton over word numbers.

    Most states have one edge, which is held in two arrays; ``more`` has the
    other edges of those with ``several``, while the automaton is built as
    dictionaries, and then as arrays sorted by state and word.  ``item`` is the
    shortest item that holds a state's words.
    """

    def __init__(self) -> None:
        self.word, self.to, self.link, self.length, self.item = (array("i", [v]) for v in (-1, -1, -1, 0, -1))
        self.more: dict[int, dict[int, int]] = {}
        self.several, self.edge, self.edge_to = bytearray(1), array("q"), array("i")
        self.sizes, self.ids = array("i"), []
        self.words, self.pairs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._limits: dict[tuple, tuple[array, array, array]] = {}

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]]) -> Automaton:
        self = cls()
        seqs: dict[bytes, tuple[int | None, np.ndarray]] = {}
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            h = _text.tokens(raw, np.array([0, len(raw)])).hash
            if len(h):
                seqs.setdefault(h.tobytes(), (i, h))
        if not seqs:
            return self
        found = sorted(seqs.values(), key=lambda x: len(x[1]))  # stable: of equally short ones the smallest id
        hashes = [h for _, h in found]
        self.sizes, self.ids = array("i", [len(h) for h in hashes]), [i for i, _ in found]
        self.words = np.unique(np.concatenate(hashes))
        numbers = [np.searchsorted(self.words, h) for h in hashes]
        self.pairs = np.unique(np.concatenate([w[:-1] * len(self.words) + w[1:] for w in numbers]))
        for w in numbers:
            state = 0
            for c in w.tolist():
                state = self._extend(state, c)
        self._freeze()
        for k, w in enumerate(numbers):
            state = 0
            for c in w.tolist():
                state = s = self.after(state, c)
                while s > 0 and self.item[s] < 0:
                    self.item[s] = k
                    s = self.link[s]
        return self

    def step(self, state: int, c: int) -> int:
        """The state that word c leads to, or -1."""
        if self.word[state] == c:
            return self.to[state]
        edges = self.more.get(state)
        return edges.get(c, -1) if edges else -1

    def _freeze(self) -> None:
        """Turn the dictionaries into arrays."""
        n = sum(map(len, self.more.values()))
        state = np.repeat(np.fromiter(self.more, np.int64, len(self.more)), np.fromiter(map(len, self.more.values()), np.int64, len(self.more)))
        word = np.fromiter((c for edges in self.more.values() for c in edges), np.int64, n)
        to = np.fromiter((t for edges in self.more.values() for t in edges.values()), np.int32, n)
        self.several = bytearray(len(self.length))
        for s in self.more:
            self.several[s] = 1
        key = state * len(self.words) + word
        order = np.argsort(key)
        self.edge, self.edge_to = array("q", key[order].tobytes()), array("i", to[order].tobytes())
        self.more = {}

    def after(self, state: int, c: int) -> int:
        """The state that word c leads to in the finished automaton, or -1."""
        if self.word[state] == c:
            return self.to[state]
        if not self.several[state]:
            return -1
        key = state * len(self.words) + c
        at = bisect_left(self.edge, key)
        return self.edge_to[at] if at < len(self.edge) and self.edge[at] == key else -1

    def _point(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _add(self, length: int) -> int:
        for a, v in ((self.word, -1), (self.to, -1), (self.link, 0), (self.length, length), (self.item, -1)):
            a.append(v)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state reached from p by c whose longest word is one longer than that of p."""
        q = self.step(p, c)
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._add(self.length[p] + 1)
        self.word[twin], self.to[twin], self.link[twin] = self.word[q], self.to[q], self.link[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        self.link[q] = twin
        while p >= 0 and self.step(p, c) == q:
            self._point(p, c, twin)
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if self.step(last, c) >= 0:
            return self._split(last, c)
        new = self._add(self.length[last] + 1)
        p = last
        while p >= 0 and self.step(p, c) < 0:
            self._point(p, c, new)
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c)
        return new

    def shortest(self, length: int, coverage: float, least: int) -> int:
        """Tokens that a match needs at least to exceed a limit."""
        return min([length, *(max(least, math.ceil(coverage * n - 1e-9)) for n in self.sizes[:1])])

    def limits(self, length: int, coverage: float, least: int) -> tuple[array, array]:
        """For each state: tokens that a match in it needs to exceed a limit; the nearest state by its links, itself included, whose longest words do, or 0."""
        key = (length, coverage, least)
        if key not in self._limits:
            item = np.frombuffer(self.item, np.int32)
            sizes = np.append(np.frombuffer(self.sizes, np.int32), 1 << 30)
            need = np.minimum(length, np.maximum(least, np.ceil(coverage * sizes - 1e-9).astype(np.int64)))[item]
            need[0] = 1 << 30
            own = np.frombuffer(self.length, np.int32) >= need
            at = np.where(own, np.arange(len(own)), np.maximum(0, np.frombuffer(self.link, np.int32)))
            while (at[at] != at).any():
                at = at[at]
            self._limits[key] = array("i", need.astype(np.int32).tobytes()), array("i", at.astype(np.int32).tobytes())
        return self._limits[key]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_limits": {}}

    def matches(self, seq: list[int], length: int, coverage: float, least: int) -> list[tuple[int, int, int, int]]:
        """(start, stop, item, tokens of the longest match) of the matches beyond a limit, those that overlap as one."""
        need, other = self.limits(length, coverage, least)
        word, to, link, size = self.word, self.to, self.link, self.length
        state = n = 0
        out: list[tuple[int, int, int, int]] = []
        for i, c in enumerate(seq):
            while True:
                after = to[state] if word[state] == c else self.after(state, c)
                if after >= 0:
                    state, n = after, n + 1
                    break
                if not state:
                    n = 0
                    break
                state = link[state]
                n = size[state]
            if n >= need[state]:
                hit, m = state, n
            else:
                hit = other[link[state]] if state else 0
                if not hit:
                    continue
                m = size[hit]
            start, item, best = i + 1 - m, self.item[hit], m
            while out and out[-1][1] > start:
                s, _, k, x = out.pop()
                start = min(s, start)
                if x >= best:
                    item, best = k, x
            out.append((start, i + 1, item, best))
        return out


def fit(benchmark: DataFrame, id_column: str = "item_id", part_bytes: int = PART_BYTES) -> list[Automaton]:
    """The automata of all items of a benchmark table, each of about ``part_bytes`` of text at most.

    Items come to the driver one partition after the other, in the order of
    their ids; test sets don't grow with the corpus.
    """
    out: list[Automaton] = []
    items: list[tuple[int | None, str]] = []
    size = 0
    rows = benchmark.select(F.col(id_column).alias("i"), F.col("text").alias("t")).where("t is not null").orderBy(F.asc_nulls_last("i"), "t")
    for i, text in rows.toLocalIterator():
        n = len(text.encode("utf-8", "replace"))
        if items and size + n > part_bytes:
            out.append(Automaton.of(items))
            items, size = [], 0
        items.append((i, text))
        size += n
    return [*out, Automaton.of(items)]


def find(raw: np.ndarray, off: np.ndarray, automaton: Automaton, length: int, coverage: float, least: int) -> tuple[list[tuple[int, int, int, int, int]], _text.Tokens]:
    """Spans of matches beyond a limit as (row, first token, end token, item, tokens of the longest match), and the tokens."""
    t = _text.tokens(raw, off)
    words, pairs = automaton.words, automaton.pairs
    if not len(words) or not len(t.hash):
        return [], t
    need = automaton.shortest(length, coverage, least)
    w = np.searchsorted(words, t.hash)
    w[w == len(words)] = 0
    known = words[w] == t.hash
    joined = known[1:] & known[:-1] & (t.row[1:] == t.row[:-1])
    at = np.flatnonzero(joined)
    if len(pairs):
        key = w[at] * len(words) + w[at + 1]
        p = np.searchsorted(pairs, key)
        p[p == len(pairs)] = 0
        joined[at[pairs[p] != key]] = False
    else:
        joined[:] = False
    edges = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(w)]])
    size = np.diff(edges)
    out = []
    for a, n in zip(edges[:-1][size >= need].tolist(), size[size >= need].tolist(), strict=True):
        if known[a]:
            out += [(int(t.row[a]), a + s, a + e, item, m) for s, e, item, m in automaton.matches(w[a : a + n].tolist(), length, coverage, least)]
    return out, t


def spans_of(column: pa.Array, automaton: Automaton, length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST) -> dict[int, list[Span]]:
    """By row: the character spans to remove, in order."""
    raw, off = _text.buffers(column)
    out: dict[int, list[Span]] = {}
    for a, _, r, o in _text.chunks(raw, off):
        found, t = find(r, o, automaton, length, coverage, least)
        if not found:
            continue
        chars = _text.char_starts(r)
        for row, x, y, item, m in found:
            base = chars[o[row]]
            out.setdefault(a + row, []).append((int(chars[t.start[x]] - base), int(chars[t.end[y - 1]] - base), automaton.ids[item], m))
    return out


def joined(spans: list[Span]) -> list[Span]:
    """Spans in order, overlapping ones as one that names the item of the longest match, at first hand."""
    out: list[Span] = []
    for s, e, item, m in sorted(spans, key=lambda x: x[0]):
        if out and s < out[-1][1]:
            a, b, k, n = out[-1]
            out[-1] = (a, max(b, e), *((k, n) if n >= m else (item, m)))
        else:
            out.append((s, e, item, m))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("item_id", pa.int64()), ("tokens", pa.int32())]))


def _stream(docs: DataFrame, automata: list[Automaton], limits: tuple[int, float, int], out: Callable[[pa.RecordBatch, dict[int, list[Span]]], pa.RecordBatch], schema: object) -> DataFrame:
    """out of each batch of docs and the spans of its rows; of several automata each reads the documents in a pass of its own."""
    spark = _spark.session(docs)
    at, width = docs.columns.index("text"), len(docs.columns)
    name = "spans"
    while name in docs.columns:
        name += "_"
    carried = docs.limit(0).withColumn(name, F.expr("cast(null as array<struct<start: int, stop: int, item_id: bigint, tokens: int>>)")).schema
    for k, automaton in enumerate(automata):
        shared, first, last = spark.sparkContext.broadcast(automaton), k == 0, k + 1 == len(automata)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = spans_of(batch.column(at), shared.value, *limits)
                if not first:
                    for row, old in enumerate(batch.column(width).to_pylist()):
                        if old:
                            found[row] = joined([*(tuple(x.values()) for x in old), *found.get(row, ())])
                    batch = batch.select(batch.schema.names[:width])
                if last:
                    yield out(batch, dict(sorted(found.items())))
                else:
                    rows = [[dict(zip(("start", "stop", "item_id", "tokens"), x, strict=True)) for x in found.get(row, ())] for row in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _SPAN)], [*batch.schema.names, name])

        docs = docs.mapInArrow(run, schema if last else carried)
        if not last:
            docs = _spark.checkpoint(docs)
    return docs


def contaminated(docs: DataFrame, automata: list[Automaton], length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """(doc_id, spans, clean_text) of each document that holds a match beyond a limit.

    A span has its start and stop and the item_id of a test item; clean_text is
    the text without the spans.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("item_id", pa.int64())]))

    def out(batch: pa.RecordBatch, found: dict[int, list[Span]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(list(found), pa.int64())),
                pa.array([[{"start": s, "stop": e, "item_id": i} for s, e, i, _ in v] for v in found.values()], span),
                pa.array([cut(batch.column(1)[k].as_py(), v) for k, v in found.items()], pa.string()),
            ],
            ["doc_id", "spans", "clean_text"],
        )

    return _stream(docs.select("doc_id", "text"), automata, (length, coverage, least), out, f"doc_id {kind}, spans array<struct<start: int, stop: int, item_id: bigint>>, clean_text string")


def cut(text: str, spans: list[Span]) -> str:
    """text without the spans; what is left on both sides is joined by a space unless white space is there."""
    parts, at = [], 0
    for s, e, *_ in spans:
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    out = parts[0]
    for p in parts[1:]:
        out += p if not out or not p or out[-1].isspace() or p[0].isspace() else " " + p
    return out


def clean(docs: DataFrame, automata: list[Automaton], length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """docs with the spans cut out of their text; a document of which nothing but them had words is dropped."""
    at = docs.columns.index("text")

    def out(batch: pa.RecordBatch, found: dict[int, list[Span]]) -> pa.RecordBatch:
        if not found:
            return batch
        texts = batch.column(at).to_pylist()
        stays = np.ones(batch.num_rows, bool)
        for k, v in found.items():
            texts[k] = cut(texts[k], v)
            raw = np.frombuffer(texts[k].encode("utf-8", "replace"), np.uint8)
            stays[k] = len(_text.tokens(raw, np.array([0, len(raw)])).hash) > 0
        columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stays))

    return _stream(docs, automata, (length, coverage, least), out, docs.schema)
