"""Quality classifier: supervised subword embeddings.

Every word, pair of words and character n-gram of a text (bytes, with one space
as the word's border) is hashed to a learned vector; the vectors are averaged over the
document and a softmax layer gives the probability of good quality.  Vectors
and layer are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled rows; the whole corpus is then scored.  Since the
layer is linear in the average, scoring sums one folded weight per feature.

Defined results: a null, empty or blank text has no features and is rejected
(probability 0); a text of any length is read whole; repeated rows are scored
alike; without labels of both classes nothing is rejected (probability 1); an
empty table gives an empty result.  Only ``doc_id``, ``text`` and the labels'
``doc_id`` and ``quality`` are read, so further columns, of any name, pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _spark, _text

#: Labelled rows of each class, at most, that a model is fitted on.
SAMPLE_PER_CLASS = 1200
BITS = 18
DIM = 8
EPOCHS = 4
RATE = 0.15
SIZES = (3, 5)
#: Documents whose probability of good quality is lower are rejected.
THRESHOLD = 0.5
#: Bytes of texts whose features are held at once; a longer text is held whole.
PIECE_BYTES = 1 << 18
#: Rows of a batch that is returned.
PIECE_ROWS = 1024


@dataclass
class Model:
    """Vectors of the hashed features, softmax layer, and hashing."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    sizes: tuple[int, ...]
    known: bool = True

    def folded(self) -> tuple[np.ndarray, float]:
        w = self.layer[1] - self.layer[0]
        return (self.vectors @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def features(raw: np.ndarray, off: np.ndarray, bits: int, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, byte place) of each word, each pair of words, and each n-gram of each size.

    A word that follows itself is one feature, whatever the word: immediate
    repetition marks poor text as such, also of words that no labelled text has.
    """
    raw = np.where(raw <= 32, np.uint8(32), raw)
    solid = raw > 32
    prefix = _text.prefix_hashes(raw)
    _, inv = _text.powers(len(raw) + 1)
    begins = off[:-1][off[:-1] < off[1:]]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[begins[1:] - 1] = solid[begins[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    down = np.uint64(64 - bits)
    word = _text.mix((prefix[end] - prefix[start]) * inv[start])
    out = [(word >> down, start)]
    if len(word) > 1:
        same_row = np.searchsorted(off, start[1:], side="right") == np.searchsorted(off, start[:-1], side="right")
        pair = np.where(word[1:] == word[:-1], np.uint64(1), _text.mix(word[:-1] * np.uint64(3) + word[1:]))
        out.append((_text.mix(pair[same_row]) >> down, start[:-1][same_row]))
    # a border ends a run of places within which no n-gram crosses from one document to the next
    doc_of_run = np.zeros(len(raw) + 1, np.int32)
    np.add.at(doc_of_run, begins, 1)
    doc_of_run = np.cumsum(doc_of_run[:-1])
    holes = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(~solid, out=holes[1:])
    for k, n in enumerate(sizes):
        m = len(raw) - n + 1
        if m <= 0:
            continue
        inner = holes[n - 1 : n - 1 + m] == holes[1 : 1 + m]
        at = np.flatnonzero(inner & (doc_of_run[n - 1 :] == doc_of_run[:m]))
        h = (prefix[at + n] - prefix[at]) * inv[at] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        out.append((_text.mix(h) >> down, at))
    return out


def _bags(texts: list[str], bits: int, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text, with their shares of all its features."""
    out = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        off = np.array([0, len(raw)])
        f = np.concatenate([b for b, _ in features(raw, off, bits, sizes)]) if len(raw) else np.zeros(0, np.uint64)
        ids, n = np.unique(f, return_counts=True)
        out.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[int, str, int]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, sizes: tuple[int, ...] = SIZES, seed: int = 0) -> Model:
    """Fit the model to rows (doc_id, text, 0 or 1) by stochastic gradient descent with per-weight steps."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    if len({y for _, _, y in rows}) < 2:
        return Model(vectors, layer, bias, sizes, known=False)
    bags = _bags([t for _, t, _ in rows], bits, sizes)
    y = np.array([v for _, _, v in rows])
    weight = len(y) / (2 * np.bincount(y, minlength=2).astype(np.float32))
    seen_v, seen_l, seen_b = np.full_like(vectors, 1e-8), np.full_like(layer, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            if not len(ids):
                continue
            mean = share @ vectors[ids]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = p @ layer
            g = np.outer(p, mean)
            seen_l += g * g
            layer -= rate * g / np.sqrt(seen_l)
            seen_b += p * p
            bias -= rate * p / np.sqrt(seen_b)
            g = np.outer(share, back)
            s = seen_v[ids] + g * g
            seen_v[ids] = s
            vectors[ids] -= rate * g / np.sqrt(s)
    return Model(vectors, layer, bias, sizes)


def probabilities(column: pa.Array, folded: np.ndarray, bias: float, sizes: tuple[int, ...]) -> np.ndarray:
    """Probability of good quality of each text."""
    bits = int(len(folded)).bit_length() - 1
    raw, off = _text.buffers(column)
    out = np.zeros(len(off) - 1)
    for a, b, r, o in _text.chunks(raw, off, PIECE_BYTES):
        if not len(r):
            continue
        total, n = np.zeros(b - a), np.zeros(b - a, np.int64)
        for bucket, at in features(r, o, bits, sizes):
            edge = np.searchsorted(at, o)
            run = np.zeros(len(at) + 1)
            np.cumsum(folded[bucket], out=run[1:], dtype=np.float64)
            total += run[edge[1:]] - run[edge[:-1]]
            n += np.diff(edge)
        z = np.clip(total / np.maximum(n, 1) + bias, -50, 50)
        out[a:b] = np.where(n > 0, 1 / (1 + np.exp(-z)), 0.0)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of at most ``per_class`` labelled documents of each class."""
    return train(_spark.labelled_sample(docs, labels, "quality", {0: per_class, 1: per_class}))


def _kept(batches: Iterator[pa.RecordBatch], at: int, folded: np.ndarray | None, bias: float, sizes: tuple[int, ...], threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows whose text, in column ``at``, isn't rejected, in small batches; of a model that knows nothing (None), all."""
    for batch in batches:
        p = probabilities(batch.column(at), folded, bias, sizes) if folded is not None else np.ones(batch.num_rows)
        for k in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(k, PIECE_ROWS).filter(pa.array(p[k : k + PIECE_ROWS] >= threshold))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, that the model doesn't reject."""
    _spark.session(docs)
    (folded, bias), sizes, known = model.folded(), model.sizes, model.known
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _kept(b, at, folded if known else None, bias, sizes, threshold), docs.schema)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_quality) of every row."""
    _spark.session(docs)
    (folded, bias), sizes, known = model.folded(), model.sizes, model.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(batch.column(1), folded, bias, sizes) if known else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "p_quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_quality double")
