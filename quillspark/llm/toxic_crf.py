"""Toxicity: a linear-chain conditional random field over tokens.

Two states (clean, toxic) run along the tokens of each line.  A token's
evidence is the summed weight of its hashed word and of its hashed beginnings;
the transition weights tie it to its neighbours.  Weights maximise the
likelihood of labelled tokens by stochastic gradient ascent in numpy, with
forward-backward expectations.  Applied, the forward-backward marginals give
each token's probability; runs of probable tokens are spans, and the document's
score is the probability that at least one of its tokens is toxic, taken as
that of its most probable token.

Token labels come from the labelled documents of a bounded sample: in a toxic
document, a token is toxic if its word or one of its beginnings occurs in so
many toxic documents, with different neighbours, and in no clean one that chance is ruled out.

Defined results: a null, empty or blank text has no tokens and no spans;
offsets count characters of the text as it stands; a text or line of any length
is read whole, in time proportional to it; repeated rows give repeated results;
without labels of both classes nothing is toxic; an empty table gives an empty
result.  Only ``doc_id``, ``text`` and the labels' ``doc_id`` and ``toxic`` are
read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _spark, _text

#: Labelled rows of each class, at most, that a model is fitted on.
SAMPLE_PER_CLASS = {1: 1000, 0: 2000}
BITS = 18
HEADS = (4, 5, 6)
EPOCHS = 2
RATE = 0.5
DECAY = 1e-4
#: How improbable by chance a word's absence from all clean documents must be.
CHANCE = 1e-4
#: A token of at least this probability belongs to a span.
THRESHOLD = 0.5
#: Tokens of a chain that are stepped through; longer chains are cut into such pieces, all of which are stepped through at once.
PIECE = 512


@dataclass
class Model:
    """weights: evidence for toxic of each bucket.  chain: log weights of (from, to).  bias: evidence of any token."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float
    known: bool = True


def _columns(t: _text.Tokens, bits: int) -> np.ndarray:
    """The buckets of every token: word, then beginnings."""
    down = np.uint64(64 - bits)
    return np.stack([t.hash >> down, *(t.head(k) >> down for k in HEADS)]).astype(np.int64)


def _lines(raw: np.ndarray, off: np.ndarray, t: _text.Tokens) -> np.ndarray:
    """Where each chain of tokens begins, and the end: chains stop at line ends and at document ends."""
    breaks = np.union1d(np.flatnonzero(raw == 10), off)
    line = np.searchsorted(breaks, t.start, side="right")
    return np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(line)]]) if len(line) else np.zeros(1, np.int64)


def _between(e: np.ndarray, w: np.ndarray, begin: np.ndarray, stop: np.ndarray, fresh: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic over clean in the messages that enter each piece from the left and from the right.

    A piece takes a message through by a product of 2x2 matrices, formed for
    all pieces at once.  ``fresh`` and ``final`` mark the ends of chains.
    """
    size = stop - begin
    right, left = (np.broadcast_to(np.eye(2), (len(begin), 2, 2)).copy() for _ in range(2))
    for k in range(int(size.max())):
        i = np.flatnonzero(size > k)
        m = np.broadcast_to(w.T, (len(i), 2, 2)).copy()
        if k == 0:
            m[fresh[i]] = np.eye(2)  # no edge leads to a chain's first token
        m[:, 1] *= e[begin[i] + k][:, None]
        right[i] = m @ right[i]
        right[i] /= right[i].max((1, 2), keepdims=True)
        m = np.broadcast_to(w, (len(i), 2, 2)).copy()
        m[:, :, 1] *= e[stop[i] - 1 - k][:, None]
        left[i] = m @ left[i]
        left[i] /= left[i].max((1, 2), keepdims=True)
    into, onto = np.ones(len(begin)), np.ones(len(begin))
    v = np.ones(2)
    for i in range(len(begin)):
        v = np.ones(2) if fresh[i] else v / v.max()
        into[i] = v[1] / v[0]
        v = right[i] @ v
    for i in range(len(begin) - 1, -1, -1):
        v = np.ones(2) if final[i] else v / v.max()
        onto[i] = v[1] / v[0]
        v = left[i] @ v
    return into, onto


def marginals(unary: np.ndarray, bounds: np.ndarray, chain: np.ndarray, pairs: bool = False, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state of each token by forward-backward, all chains at once.

    ``bounds`` are the beginnings of the chains and the end.  The ratio of
    toxic to clean is carried along each chain in both directions, piece by
    piece where it is longer than ``piece``.  With ``pairs``, also the expected
    number of each transition.
    """
    w = np.exp(chain - chain.max())
    e = np.exp(np.clip(unary, -40, 40))
    whole = np.diff(bounds)
    parts = -(-whole // piece)
    owner = np.repeat(np.arange(len(whole)), parts)
    nth = np.arange(len(owner)) - (np.cumsum(parts) - parts)[owner]
    begin = bounds[:-1][owner] + nth * piece
    stop = np.minimum(begin + piece, bounds[1:][owner])
    fresh, final = nth == 0, np.append(nth[1:] == 0, True)[: len(nth)]
    size = stop - begin
    into, onto = np.ones(len(begin)), np.ones(len(begin))
    if (cut := np.flatnonzero(parts[owner] > 1)).size:
        into[cut], onto[cut] = _between(e, w, begin[cut], stop[cut], fresh[cut], final[cut])
    order = np.argsort(-size, kind="stable")
    first, last, size = begin[order], stop[order] - 1, size[order]
    fresh, final, into, onto = fresh[order], final[order], into[order], onto[order]
    ahead, back = np.ones(len(unary)), np.ones(len(unary))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # pieces longer than each step
    f = into
    g = onto
    for k in range(longest):
        n = active[k]
        at = first[:n] + k
        turned = (w[0, 1] + w[1, 1] * f[:n]) / (w[0, 0] + w[1, 0] * f[:n])
        f = e[at] * (np.where(fresh[:n], 1.0, turned) if k == 0 else turned)
        ahead[at] = f
        at = last[:n] - k
        if k:
            x = e[at + 1] * g[:n]
            g = (w[1, 0] + w[1, 1] * x) / (w[0, 0] + w[0, 1] * x)
        else:
            g = onto[:n]
        back[at] = g
    odds = ahead * back
    p = odds / (1 + odds)
    expected = np.zeros((2, 2))
    if pairs and len(unary) > 1:
        inside = np.ones(len(unary), bool)
        inside[bounds[1:-1]] = False
        i = np.flatnonzero(inside[1:])
        right = e[i + 1] * back[i + 1]
        cells = np.stack([np.full(len(i), w[0, 0]), w[0, 1] * right, w[1, 0] * ahead[i], w[1, 1] * ahead[i] * right])
        expected = (cells / cells.sum(0)).sum(1).reshape(2, 2)
    return p, expected


def label_tokens(texts: list[str], toxic: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, chain bounds, token labels) of each text, labelled from the documents' labels."""
    parts = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        off = np.array([0, len(raw)])
        tok = _text.tokens(raw, off)
        parts.append((_columns(tok, bits), _lines(raw, off, tok), tok.hash))
    seen = np.zeros((2, len(HEADS) + 1, 1 << bits), np.int32)
    for (c, _, _), y in zip(parts, toxic, strict=True):
        for k in range(len(c)):
            seen[int(y), k, np.unique(c[k])] += 1
    around = np.concatenate([_text.mix(np.append(h[1:], np.uint64(0)) * np.uint64(3) + np.append(np.uint64(0), h[:-1])) for (_, _, h), y in zip(parts, toxic, strict=True) if y])
    for k in range(len(HEADS) + 1):  # copies of a document repeat their words in the same surroundings, which count once
        at = np.concatenate([c[k] for (c, _, _), y in zip(parts, toxic, strict=True) if y]).astype(np.uint64)
        _, once = np.unique(at + (around << np.uint64(bits)), return_index=True)
        seen[1, k] = np.minimum(seen[1, k], np.bincount(at[once].astype(np.int64), minlength=1 << bits))
    parts = [(c, b) for c, b, _ in parts]
    share = toxic.mean()
    least = math.ceil(math.log(CHANCE) / math.log(share)) if 0 < share < 1 else 1 << 30
    sure = (seen[1] >= max(2, least)) & (seen[0] == 0)
    return [(c, b, sure[np.arange(len(c))[:, None], c].any(0) & bool(y)) for (c, b), y in zip(parts, toxic, strict=True)]


def train(rows: list[tuple[int, str, int]], bits: int = BITS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    """Fit the field to rows (doc_id, text, 0 or 1)."""
    weights, chain, bias = np.zeros(1 << bits), np.zeros((2, 2)), 0.0
    toxic = np.array([y for _, _, y in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return Model(weights, chain, bias, known=False)
    data = label_tokens([t for _, t, _ in rows], toxic, bits)
    rng = np.random.default_rng(seed)
    seen_w, seen_c, seen_b = np.full(1 << bits, 1.0), np.full((2, 2), 1.0), 1.0
    step = 16
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), step):
            batch = [data[i] for i in order[a : a + step] if data[i][0].shape[1]]
            if not batch:
                continue
            c = np.concatenate([x[0] for x in batch], axis=1)
            y = np.concatenate([x[2] for x in batch])
            size = np.concatenate([np.diff(x[1]) for x in batch])
            bounds = np.concatenate([[0], np.cumsum(size)])
            p, expected = marginals(weights[c].sum(0) + bias, bounds, chain, pairs=True)
            gap = y - p
            inside = np.ones(len(y), bool)
            inside[bounds[1:-1]] = False
            i = np.flatnonzero(inside[1:])
            found = np.bincount(2 * y[i] + y[i + 1], minlength=4).reshape(2, 2)
            ids, where = np.unique(c.ravel(), return_inverse=True)
            g = np.bincount(where, weights=np.tile(gap, len(c)), minlength=len(ids)) - DECAY * weights[ids]
            seen_w[ids] += g * g
            weights[ids] += rate * g / np.sqrt(seen_w[ids])
            g = found - expected - DECAY * chain
            seen_c += g * g
            chain += 0.1 * rate * g / np.sqrt(seen_c)
            seen_b += gap.sum() ** 2
            bias += rate * gap.sum() / math.sqrt(seen_b)
    return Model(weights, chain, float(bias))


def fit(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> Model:
    """A model of at most ``per_class`` labelled documents of each class."""
    return train(_spark.labelled_sample(docs, labels, "toxic", per_class or SAMPLE_PER_CLASS))


def tag(column: pa.Array, model: Model, threshold: float = THRESHOLD) -> list[tuple[int, float, list[tuple[int, int, float]]]]:
    """(row, score, spans as (start, end, probability)) of the texts that have a span."""
    raw, off = _text.buffers(column)
    bits = len(model.weights).bit_length() - 1
    out = []
    for a, _, r, o in _text.chunks(raw, off):
        t = _text.tokens(r, o)
        if not len(t.hash):
            continue
        unary = np.full(len(t.hash), model.bias)
        for c in _columns(t, bits):
            unary += model.weights[c]
        p, _ = marginals(unary, _lines(r, o, t), model.chain)
        hit = np.flatnonzero(p >= threshold)
        if not len(hit):
            continue
        chars = _text.char_starts(r)
        run = _text.run_ids(hit - np.arange(len(hit)), t.row[hit])
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        finish = np.append(begin[1:], len(hit)) - 1
        best = np.maximum.reduceat(p[hit], begin)
        row = t.row[hit[begin]]
        base = chars[o[row]]
        s, e = chars[t.start[hit[begin]]] - base, chars[t.end[hit[finish]]] - base
        edge = np.flatnonzero(np.diff(row, prepend=-1))
        for x, y in zip(edge, np.append(edge[1:], len(row)), strict=True):
            out.append((a + int(row[x]), float(best[x:y].max()), list(zip(s[x:y].tolist(), e[x:y].tolist(), best[x:y].tolist(), strict=True))))
    return out


def spans(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, spans) of the documents in which a toxic span is found."""
    _spark.session(docs)
    small = Model(model.weights.astype(np.float32), model.chain, model.bias, model.known)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, spans array<struct<start: int, stop: int, p: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            found = tag(batch.column(1), small, threshold) if small.known else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[{"start": s, "stop": e, "p": p} for s, e, p in f[2]] for f in found], span),
                ],
                ["doc_id", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
