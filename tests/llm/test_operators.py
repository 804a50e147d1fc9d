import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import _text, components, decontaminate, html_extract, jaccard_join, line_dedup, mixing, quality_embeddings, quotient_dedup, suffix_dedup, toxic_crf, url_filter
from quillspark.llm.sql import SQL

from .helpers import SCHEMA, frame, hashes, odd, words

rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3), (100, 90)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_url_filter(spark):
    link = '<html><head><link href="{}" rel="canonical"></head></html>'
    move = '<meta http-equiv=refresh content="0; url={}">'
    pages = [
        (0, "https://good.org/a?utm_source=x#top", link.format("//www.casino-win.example.com/x/")),  # alias of a blocked host
        (1, "http://WWW.good.org/b", move.format("/a")),  # two steps away
        (2, "https://m.ads-track.example.com/1", link.format("http://free-bets.example.com/")),  # allowed by name
        (3, "https://www.ads-track.example.com/2", None),
        (4, "http://plain.org/c/", link.format("c2")),
        (5, "http://plain.org/c2?ref=1&page=2", ""),
        (6, "http://notcasino-win.example.com/", None),
        (7, None, link.format("http://free-bets.example.com/")),
        (8, "", None),
        (1, "http://WWW.good.org/b", move.format("/a")),
        (9, "http://site.org/self", link.format("http://site.org/self")),
        (10, "http://only.org/x", link.format("https://m.ads-track.example.com/1")),  # reaches the block through an allowed page
        (11, "http://allowed-only.org/", link.format("https://m.ads-track.example.com/zz")),  # an allowed page blocks no other
    ]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id bigint, url string, html string, node int, root string")
    got = {r.page_id: r.decision for r in url_filter.decide(df).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "pass", 5: "pass", 6: "pass", 7: "pass", 8: "pass", 9: "pass", 10: "block", 11: "pass"}
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas())
    assert rows_of(url_filter.decide(df)) == sorted(con.sql(SQL["op1_url_decisions"]).fetchall(), key=repr)
    assert url_filter.decide(df.limit(0)).count() == 0


def test_mixing_weights():
    tokens = [10**6, 10**4, 10**4]
    a = mixing.exponent(tokens, entropy=0.9, repeats=1e9)
    w = mixing.weights(tokens, a)
    entropy = lambda w: -sum(x * np.log(x) for x in w) / np.log(3)
    assert entropy(w) >= 0.9 and entropy(mixing.weights(tokens, a + 2**-20)) < 0.9
    b = mixing.exponent(tokens, entropy=0.9, repeats=3.0)
    rate = lambda e: max(x * sum(tokens) / n for x, n in zip(mixing.weights(tokens, e), tokens, strict=True))
    assert b > a and rate(b) <= 3 + 1e-9 and rate(b - 2**-20) > 3
    assert mixing.exponent([5, 5]) == 1.0 and mixing.exponent([7]) == 1.0


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 20)), "en", "big" if i < 300 else f"s{i % 3}", 1) for i in range(330)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, block_tokens=200)
    per = defaultdict(list)
    for r in out.collect():
        per[r.source].append(r)
    for s, n, _, part in mixing.plan(mixing.counted(docs), block_tokens=200):
        taken = 20 * len(per[s])
        assert part <= taken < part + 20
        epochs = defaultdict(list)
        for r in per[s]:
            epochs[r.mix_epoch].append(r.doc_id)
        assert all(len(v) == len(set(v)) for v in epochs.values()) and all(20 * len(epochs[e]) == n for e in range(max(epochs)))
    bad = odd(spark)
    got = mixing.mix(bad)
    assert got.columns == [*bad.columns, "mix_epoch", "mix_block", "mix_place"]
    assert {r.doc_id for r in got.collect()} <= {None, 4, 5}
    names = ["mix_epoch", "Mix_Block", "row", "s", "__b", "size", "turn", "tokens"]
    clash = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    again = mixing.mix(clash, block_tokens=200)
    assert again.columns == [*clash.columns, "mix_epoch_", "mix_block_", "mix_place"] and all(tuple(r)[5:13] == tuple(range(8)) for r in again.collect())
    assert rows_of(again.select("doc_id", "mix_epoch_", "mix_block_", "mix_place")) == rows_of(out.select("doc_id", "mix_epoch", "mix_block", "mix_place"))
    long = frame(spark, ["word " * 250_000, "few words"])
    assert sorted(r.doc_id for r in mixing.mix(long, entropy=0.0).collect()) == [0, 1]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(bad.where("doc_id = 2")).count() == 0
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    # the registered query's parameters
    want = sorted(con.sql(SQL["op2_mixture"]).fetchall(), key=repr)
    assert rows_of(mixing.mix(docs).select("doc_id", "source", "mix_epoch", "mix_block", "mix_place")) == want


@pytest.mark.parametrize("bits", [8, 20, 64])
def test_quotient_filter(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << min(bits, 62), 3000, dtype=np.uint64)
    values = np.concatenate([values, values[:500], np.repeat(values[:1], 300)])
    parts = np.array_split(values, 5)
    filters = [quotient_dedup.QuotientFilter.load(quotient_dedup.QuotientFilter.of(p, bits=bits).dump()) for p in parts]
    got, counts = quotient_dedup.QuotientFilter.merge(filters).items()
    want, n = np.unique(values, return_counts=True)
    assert (got == want).all() and (counts == n).all()
    one = filters[0]
    seen, m = np.unique(parts[0], return_counts=True)
    for v, k in list(zip(seen.tolist(), m.tolist(), strict=True))[:200]:
        assert one.count(v) == k
    missing = next(v for v in range(1 << min(bits, 12)) if v not in set(seen.tolist())) if bits > 8 else None
    assert missing is None or one.count(missing) == 0
    empty = quotient_dedup.QuotientFilter.of(np.zeros(0, np.uint64), bits=bits)
    assert len(quotient_dedup.QuotientFilter.load(empty.dump()).items()[0]) == 0


def test_exact_duplicates(spark):
    docs = odd(spark, [(6, "", "en", "s0", 0), (7, "one", "en", "s0", 3), (8, "one ", "en", "s0", 4), (9, "x" * 300_000, "en", "s0", 1), (10, "x" * 300_000, "en", "s0", 1), (None, "one", "en", "s0", 1)])
    assert rows_of(quotient_dedup.duplicates(docs)) == [(10, 9), (6, 2), (7, 4)]
    # digests that name several texts, as if by chance
    with pytest.MonkeyPatch.context() as m:
        m.setattr(F, "xxhash64", lambda c: F.length(c).cast("bigint") % 3)
        assert rows_of(quotient_dedup.duplicates(docs, 3, digest=lambda c: F.lit("same"))) == [(10, 9), (6, 2), (7, 4)]
    assert quotient_dedup.duplicates(docs.limit(0)).count() == 0


def align(a, b):
    return line_dedup.patience(list(a), list(b))


def test_patience():
    assert align("abcd", "abcd") == [(i, i) for i in range(4)]
    assert align("xabcy", "abc") == [(1, 0), (2, 1), (3, 2)]
    assert align("abc", "xyz") == [] and align("", "a") == []
    assert align("aXbYc", "abc") == [(0, 0), (2, 1), (4, 2)]
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcdefghij", k=rng.randint(0, 12)) for _ in range(2))
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:], strict=False))
        if len(set(a)) == len(a) and len(set(b)) == len(b):  # without repeats: a longest common subsequence
            table = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
            assert len(got) == table[-1, -1]


def test_line_dedup(spark):
    block = "this is a line of some length\nand this one follows it closely"
    texts = [
        f"first start here\n{block}\nfirst end",
        f"second start\n{block}\n\nsecond end",
        block,
        "and this one follows it closely\nthis is a line of some length",  # other order: one line alone is too short
        "nothing shared in this document at all",
        f"  {block}  \nmore",
    ]
    docs = frame(spark, texts)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert got == {0: texts[0], 1: "second start\n\nsecond end", 3: texts[3], 4: texts[4], 5: "more"}
    many = frame(spark, [f"own line number {i} of this document\n{block}" for i in range(40)])  # more holders than a rare line has
    got = {r.doc_id: r.text for r in line_dedup.dedup(many).collect()}
    assert all(block not in got[i] for i in range(1, 40)) and block in got[0]
    bad = odd(spark, [(6, f"{block}\nown", "en", "s0", 1), (7, block, "en", "s0", 1), (7, block, "en", "s0", 1)])
    out = line_dedup.dedup(bad)
    assert out.columns == bad.columns and out.count() == bad.count() - 2
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def plain_patience(a, b):
    """Aligned places, straight from the definition: equal ends, then lines unique on both sides in a longest increasing run, then what lies between.

    Of several longest runs, and of several ways to a place, that counts whose last place is the smallest in b.
    """
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    best, order = [], lambda run: (len(run), -run[-1][1])
    for k, (i, j) in enumerate(unique):
        best.append(max((best[m] for m in range(k) if unique[m][1] < j), key=order, default=[]) + [(i, j)])
    if not best:
        return []
    chain = max(best, key=order)
    out, x, y = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += [(x + u, y + v) for u, v in plain_patience(a[x:i], b[y:j])] + ([(i, j)] if i < len(a) else [])
        x, y = i + 1, j + 1
    return out


def plain_dedup(texts, min_block):
    """What line dedup leaves, by aligning every document with all earlier ones."""
    out = {}
    for d, text in enumerate(texts):
        late = [(k, x.strip(" \t\r")) for k, x in enumerate(text.split("\n")) if x.strip(" \t\r")]
        gone = set()
        for e in texts[:d]:
            pairs = plain_patience([x for x in (y.strip(" \t\r") for y in e.split("\n")) if x], [x for _, x in late])
            block = []
            for k, (i, j) in enumerate(pairs):
                block = [*block, j] if k and pairs[k - 1] == (i - 1, j - 1) else [j]
                if pairs[k + 1 : k + 2] != [(i + 1, j + 1)] and sum(len(late[x][1]) for x in block) >= min_block:
                    gone.update(late[x][0] for x in block)
        left = [x for k, x in enumerate(text.split("\n")) if k not in gone]
        if not gone or any(x.strip(" \t\r") for x in left):
            out[d] = "\n".join(left)
    return out


def test_plain_patience():
    """The kernel is the definition, repeated lines and other orders included."""
    rng = random.Random(4)
    for _ in range(500):
        a, b = (rng.choices("abcdefghijklmnop", k=rng.randint(0, 14)) for _ in range(2))
        assert align(a, b) == plain_patience(a, b)


@pytest.mark.parametrize("rare, hub", [(8, 2048), (2, 3)])
def test_line_dedup_later_holders(spark, rare, hub):
    p, q, r = ("\n".join(f"{name} line {k} of a paragraph of more than forty characters" for k in range(3)) for name in "pqr")
    # the first holder has the blocks in another order than all the others, the ones after differ in what follows
    texts = [f"{p}\n{q}", *(f"own {i}\n{q}\n{p}" for i in range(12))]
    texts += [f"{r}\nfirst", *(f"{r}\ntail {k % 3}\nown {k}" for k in range(12))]
    rng = random.Random(9)
    lines = [f"shared line number {k} of forty characters and some" for k in range(6)] + [f"short {k}" for k in range(3)]
    texts += ["\n".join([f"d{i}", *sorted(rng.sample(lines, 6))]) for i in range(40)]
    texts.append("\n".join(f"line {k} of a very long text, {k % 7}" for k in range(20_000)))
    texts.append(texts[-1].replace("line 500 of", "changed 500 of"))
    want = plain_dedup(texts[:-2], line_dedup.MIN_BLOCK)
    got = {x.doc_id: x.text for x in line_dedup.dedup(frame(spark, texts), rare=rare, hub=hub).collect()}
    assert got.pop(len(texts) - 2) == texts[-2] and got.pop(len(texts) - 1) == f"changed 500 of a very long text, {500 % 7}"
    assert got == want and got[5] == "own 4" and got[17] == "own 3"


def test_line_dedup_hot_line(spark):
    """A line that all of very many documents share."""
    hot = "a licence line of more than forty characters in every document"
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{hot}\nown text of document "), F.col("id")).alias("text"), F.lit("u").alias("gone"), F.lit("v").alias("row"), F.lit("w").alias("__id"))
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == 50_000
    assert [r.doc_id for r in out.where(F.col("text").contains("licence")).collect()] == [0]
    assert {tuple(r)[2:] for r in out.where("doc_id < 3").collect()} == {("u", "v", "w")}
    ranks = line_dedup.ranked(spark.range(3000).select((F.col("id") % 2).alias("line"), F.col("id"))).collect()
    assert all(r["rank"] == r["id"] // 2 + 1 for r in ranks)


def toxic_rows(rng, n):
    out = []
    for i in range(n):
        w = words(rng, 60)
        y = i % 4 == 0
        for _ in range(3 if y else 0):
            w[rng.randrange(60)] = rng.choice(["grumbly", "snarkous", "vilefoo"]) + rng.choice(["", "ish", "est"])
        out.append((i, " ".join(w), int(y)))
    return out


def brute_marginals(unary, chain):
    n = len(unary)
    p, z = np.zeros(n), 0.0
    for m in range(1 << n):
        y = [m >> k & 1 for k in range(n)]
        s = np.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(chain[a, b] for a, b in zip(y, y[1:], strict=False)))
        z += s
        p += s * np.array(y)
    return p / z


def test_forward_backward():
    rng = np.random.default_rng(0)
    unary, chain = rng.normal(size=14) * 2, rng.normal(size=(2, 2))
    bounds = np.array([0, 5, 6, 14])
    want = np.concatenate([brute_marginals(unary[a:b], chain) for a, b in zip(bounds, bounds[1:], strict=False)])
    for piece in (512, 3, 1, 2):
        got, _ = toxic_crf.marginals(unary, bounds, chain, piece=piece)
        assert np.allclose(got, want)
    unary, bounds = rng.normal(size=30_000) * 3, np.array([0, 11, 2000, 2512, 30_000])
    whole, cut = (toxic_crf.marginals(unary, bounds, chain, pairs=True, piece=p) for p in (1 << 40, 512))
    assert np.allclose(whole[0], cut[0]) and np.allclose(whole[1], cut[1])
    assert len(toxic_crf.marginals(np.zeros(0), np.zeros(1, np.int64), chain)[0]) == 0


def test_toxic(spark):
    rng = random.Random(5)
    model = toxic_crf.train(toxic_rows(rng, 400))
    test = toxic_rows(rng, 200)
    found = toxic_crf.tag(pa.array([t for _, t, _ in test]), model)
    assert {f[0] for f in found} == {i for i, _, y in test if y}
    for row, _, spans in found:
        assert all(test[row][1][s:e].startswith(("grumbly", "snarkous", "vilefoo")) for s, e, _ in spans)
    # spans by brute force: chains of a dozen tokens, every labelling summed up
    short = [(i, "\n".join(" ".join(t.split()[k : k + 12]) for k in range(0, 36, 12))) for i, t, _ in test[:24]]
    found = {f[0]: f[2] for f in toxic_crf.tag(pa.array([t for _, t in short]), model)}
    for row, (_, t) in enumerate(short):
        want, at = [], 0
        for line in t.split("\n"):
            tok = line.split()
            raw = np.frombuffer(line.encode(), np.uint8)
            columns = toxic_crf._columns(_text.tokens(raw, np.array([0, len(raw)])), toxic_crf.BITS)
            p = brute_marginals(model.weights[columns].sum(0) + model.bias, model.chain)
            spot = at
            open_ = None
            for w, q in zip(tok, p, strict=True):
                if q >= toxic_crf.THRESHOLD:
                    open_ = [open_[0] if open_ else spot, spot + len(w), max(q, open_[2] if open_ else 0)]
                elif open_:
                    want.append(open_)
                    open_ = None
                spot += len(w) + 1
            if open_:
                want.append(open_)
            at += len(line) + 1
        got = found.get(row, [])
        assert [s[:2] for s in got] == [tuple(x[:2]) for x in want] and np.allclose([s[2] for s in got], [x[2] for x in want])
    long = "plain words of a text " * 60_000 + "grumbly end"
    assert [[s[:2] for s in f[2]] for f in toxic_crf.tag(pa.array([long]), model)] == [[(len(long) - 11, len(long) - 4)]]
    bad = odd(spark, [(6, "Ünï grumbly … end", "en", "s0", 1)])
    got = toxic_crf.spans(bad, model).collect()
    assert [(r.doc_id, [(s.start, s.stop) for s in r.spans]) for r in got] == [(6, [(4, 11)])]
    assert toxic_crf.spans(bad.limit(0), model).count() == 0
    none = toxic_crf.fit(bad, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxic_crf.spans(bad, none).count() == 0


def quality_rows(rng, n):
    return [(i, " ".join(x + (rng.choice(["###", "$$$"]) if i % 3 == 0 else "") for x in words(rng, 50)), int(i % 3 != 0)) for i in range(n)]


def test_quality(spark):
    rng = random.Random(2)
    model = quality_embeddings.train(quality_rows(rng, 300))
    test = quality_rows(rng, 200)
    p = quality_embeddings.probabilities(pa.array([t for _, t, _ in test]), *model.folded(), model.sizes)
    assert np.mean((p >= 0.5) == [y for _, _, y in test]) > 0.97
    # folded weights give the softmax over averaged vectors
    for (_, t, _), q in list(zip(test, p, strict=True))[:20]:
        (ids, share), = quality_embeddings._bags([t], quality_embeddings.BITS, model.sizes)
        z = model.layer @ (share @ model.vectors[ids]) + model.bias
        assert abs(q - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4
    bad = odd(spark, [(6, test[1][1], "en", "s0", 1), (7, test[0][1], "en", "s0", 1)])
    got = quality_embeddings.keep(bad, model)
    assert got.columns == bad.columns
    ids = [r.doc_id for r in got.collect()]
    assert 6 in ids and not {1, 2, 3, 7} & set(ids)
    assert quality_embeddings.keep(bad.limit(0), model).count() == 0
    none = quality_embeddings.fit(bad, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality_embeddings.keep(bad, none).count() == bad.count()


def plain_quality(text, model):
    """The model applied feature by feature: vectors averaged, layer, softmax."""
    top, base = 1 << 64, _text._P
    value = lambda b: sum((x + 1) * pow(base, i, top) for i, x in enumerate(b)) % top
    mixed = lambda x: int(_text.mix(np.array([x % top], np.uint64))[0])
    raw = bytes(max(x, 32) for x in text.encode())
    tokens = [w for w in raw.split(b" ") if w]
    word = [mixed(value(w)) for w in tokens]
    found = list(word)
    found += [mixed(1 if x == y else mixed(x * 3 + y)) for x, y in zip(word, word[1:], strict=False)]
    for k, n in enumerate(model.sizes):
        # a border may be the first or last byte
        found += [mixed(value(raw[i : i + n]) + (k + 1) * 0x9E3779B97F4A7C15) for i in range(len(raw) - n + 1) if min(raw[i + 1 : i + n - 1]) > 32]
    if not found:
        return 0.0
    shift = 64 - (len(model.vectors).bit_length() - 1)
    z = model.layer @ np.mean([model.vectors[x >> shift] for x in found], axis=0) + model.bias
    return 1 / (1 + np.exp(z[0] - z[1]))


def test_quality_memory():
    """A worker holds the features of a piece of its batch only, and returns small batches, with each row once."""
    import tracemalloc

    rng = random.Random(6)
    one = " ".join(words(rng, 300))
    texts = [f"{i} {one}" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["doc_id", "text"])
    folded = np.random.default_rng(0).normal(size=1 << 10).astype(np.float32)
    tables, _text._powers[:] = list(_text._powers), [np.ones(1, np.uint64)] * 2
    tracemalloc.start()
    out = list(quality_embeddings._kept(iter([batch]), 1, folded, 0.0, quality_embeddings.SIZES, 0.5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    _text._powers[:] = tables
    assert sum(len(t) for t in texts) > 4e6 and most < 40e6
    assert all(b.num_rows <= quality_embeddings.PIECE_ROWS for b in out)
    p = [quality_embeddings.probabilities(pa.array([t]), folded, 0.0, quality_embeddings.SIZES)[0] for t in texts]
    assert [i for b in out for i in b.column(0).to_pylist()] == [i for i, x in enumerate(p) if x >= 0.5]
    assert not list(quality_embeddings._kept(iter([batch.slice(0, 0)]), 1, folded, 0.0, quality_embeddings.SIZES, 0.5))
    every = quality_embeddings._kept(iter([batch]), 1, None, 0.0, quality_embeddings.SIZES, 0.5)
    assert sum(b.num_rows for b in every) == 3000


def test_plain_quality():
    rng = random.Random(3)
    model = quality_embeddings.train(quality_rows(rng, 60), epochs=1)
    texts = ["", " ", "a", "same same same", "Ünï ##\n\tcode  漢字漢字 end", "x" * 50, *(t for _, t, _ in quality_rows(rng, 12))]
    got = quality_embeddings.probabilities(pa.array(texts), *model.folded(), model.sizes)
    assert np.allclose(got, [plain_quality(t, model) for t in texts], atol=1e-4)
    long = " ".join(texts[-12:] * 3000)
    assert quality_embeddings.probabilities(pa.array([long]), *model.folded(), model.sizes)[0] > 0


def near_texts(rng):
    texts = [words(rng, rng.choice([3, 10, 40, 200])) for _ in range(80)]
    for _ in range(60):
        w = list(rng.choice(texts[:40]))
        for _ in range(rng.randint(0, len(w) // 8)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        texts.append(w)
    return [" ".join(w) for w in texts] + ["", "solo", "solo"]


def plain_pairs(texts):
    """By brute force, all pairs at 0.5 or above."""
    grams = [set(jaccard_join.gram_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 2)[0][0].tolist()) for t in texts]
    out = {}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if grams[a] & grams[b] and (j := len(grams[a] & grams[b]) / len(grams[a] | grams[b])) >= 0.5:
                out[a, b] = j
    return out, grams


def plain_classes(n, pairs):
    """{document: (smallest of its class, links)} of the documents in pairs."""
    root, links = list(range(n)), [0] * n
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return {i: (root[i], links[i]) for i in range(n) if links[i]}


@pytest.mark.parametrize("block, tile", [(4096, 1024), (3, 2)])
def test_jaccard_classes(spark, monkeypatch, block, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(4)
    texts = near_texts(rng)
    texts += [texts[3], texts[50]] * 3
    base = words(rng, 30)
    texts += [" ".join(base)] * 7 + [" ".join([*base[:-1], "other"])] * 5 + [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(9)]
    texts.append(" ".join(words(rng, 30_000)))
    texts.append(texts[-1] + " end")
    want, grams = plain_pairs(texts)
    docs = frame(spark, [*texts, None])
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.classes(docs, block=block).collect()}
    assert got == plain_classes(len(texts), want)
    first = {}
    for i, g in enumerate(grams):
        if g:
            first.setdefault(frozenset(g), i)
    found = {(r.doc_id, r.other_doc_id): r.jaccard for r in jaccard_join.pairs(docs, block=block).collect()}
    chosen = set(first.values())
    assert found == pytest.approx({k: v for k, v in want.items() if v < 1 and chosen >= set(k)})
    assert {r.doc_id: r.first_doc_id for r in jaccard_join.members(docs).collect()} == {i: first[frozenset(g)] for i, g in enumerate(grams) if g}
    if tile > 2:
        assert {r.doc_id for r in jaccard_join.one_of_each(docs).collect()} == {i for i in range(len(texts) + 1) if got.get(i, (i,))[0] == i}


def test_jaccard_odd(spark):
    bad = odd(spark)
    assert jaccard_join.classes(bad).count() == 0 and jaccard_join.pairs(bad).count() == 0
    kept = jaccard_join.one_of_each(bad)
    assert kept.columns == bad.columns and kept.count() == bad.count()
    assert jaccard_join.classes(bad.limit(0)).count() == 0 and jaccard_join.one_of_each(bad.limit(0)).count() == 0
    # a doc_id of two texts is in the class of both
    rng = random.Random(5)
    x, y = (" ".join(words(rng, 40)) for _ in range(2))
    clash = ", ".join(f"{c} int" for c in ("row", "__gone", "same", "class_id", "links"))
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in [(1, x), (2, x), (2, y), (2, y), (3, y), (4, x + " more"), (9, "alone in this")]], f"doc_id int, text string, {clash}")
    assert sorted(jaccard_join.classes(docs).collect()) == [(1, 1, 2), (2, 1, 3), (3, 1, 1), (4, 1, 2)]
    assert sorted(jaccard_join.one_of_each(docs).collect()) == [(1, x, 1, 2, 3, 4, 5), (9, "alone in this", 1, 2, 3, 4, 5)]


@pytest.mark.parametrize("long", ["{:020x}", "https://example.org/{:016x}/index", "漢字漢字漢字漢字{:x}"])
def test_blocks_of_long_changes(long):
    rng = random.Random(8)
    short = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    met = 0
    for _ in range(200):
        texts = [w := [rng.choice(short) for _ in range(200)], list(w)]
        for at in range(0, 196, 14):
            for t in texts:
                t[at] = long.format(rng.randrange(1 << 60))
        sets = [jaccard_join.gram_sets(raw := np.frombuffer(" ".join(t).encode(), np.uint8), np.array([0, len(raw)]), 2)[0] for t in texts]
        assert len(np.intersect1d(sets[0][0], sets[1][0])) >= 0.5 * len(np.union1d(sets[0][0], sets[1][0]))
        a, b = (jaccard_join.block_keys(h, rank, jaccard_join.SKETCH, jaccard_join.SMALL, 0.5) for h, rank in sets)
        met += len(np.intersect1d(a, b)) > 0
    assert met == 200


def test_samples():
    rng = np.random.default_rng(3)
    ranks = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    for shared, own in ((200, 100), (20, 10), (2, 1), (40000, 20000)):  # at the threshold
        pairs = [(c := ranks(shared), np.concatenate([c, ranks(own)]), np.concatenate([c, ranks(own)])) for _ in range(50)]
        assert jaccard_join.alike(*(np.array([jaccard_join.sample(p[k]) for p in pairs]) for k in (1, 2)), 0.5).all()
    apart = [[jaccard_join.sample(ranks(3000)) for _ in range(50)] for _ in range(2)]
    assert not jaccard_join.alike(*map(np.array, apart), 0.5).any()


def test_large_group(spark):
    rng = random.Random(6)
    base = words(rng, 60)
    texts = []
    for i in range(1100):  # more than a tile holds
        w = list(base)
        w[rng.randrange(60)] = f"n{i}"
        texts.append(" ".join(w))
    got = jaccard_join.classes(frame(spark, texts), block=200).collect()
    assert len(got) == 1100 and all(r.class_id == 0 and r.links == 1099 for r in got)


def test_r_tree():
    rng = np.random.default_rng(1)
    points = rng.poisson(2.0, (500, 16))
    points[250:] = np.maximum(0, points[:250] + rng.integers(-1, 2, (250, 16)) * (rng.random((250, 16)) < 0.2))
    n = points.sum(1)
    points = points.astype(np.uint8)
    tree = jaccard_join.RTree(points, n, fanout=4)
    for q in range(0, 500, 17):
        bound = np.minimum(points, points[q]).sum(1) >= 0.8 / 1.8 * (n + n[q]) - 1e-9
        size = (n >= 0.8 * n[q]) & (0.8 * n <= n[q])
        assert sorted(tree.search(points[q], int(n[q]), 0.8).tolist()) == np.flatnonzero(bound & size).tolist()


def test_html():
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/x>More links here</a></nav><p>" + "plain words of the story " * 8 + "</p><p>" + "further <b>bold</b> words &amp; more<br>text " * 6 + "</p><footer><a>Imprint</a></footer><script>var a='<p>no</p>'</script></body>"
    found = html_extract.blocks(page)
    assert [b[1:] for b in found] == [(4, 4), (40, 0), (36, 0), (1, 1)]
    text = html_extract.text_of(page)
    assert text.startswith("plain words") and "bold words & more text" in text and "Home" not in text and "Imprint" not in text and "no" not in text.split()
    for broken in (None, "", "   ", "<", "<p", "a < b", "<!-- x", "<script>never closed"):
        assert isinstance(html_extract.text_of(broken), str)
    assert html_extract.blocks("one <b>two</b><div>three</div>") == [("one two", 2, 0), ("three", 1, 0)]
    assert html_extract.blocks("a<!-- x --> b<?php y ?> c <![CDATA[ d ]]> </ e <my_tag> f < g") == [("a b c e my_tag> f g", 7, 0)]
    assert html_extract.blocks("<SCRIPT>x</script ><title>t</TITLE>y<head>in</head>z<head>open") == [("y z", 2, 0), ("open", 1, 0)]
    assert html_extract.blocks("x &#" + "1" * 5000 + "; &amp;") == [("x &#" + "1" * 5000 + "; &amp;", 3, 0)]


def test_plain_extraction():
    """Pages of known blocks: features and tree followed row by row."""
    rng = random.Random(7)
    for _ in range(60):
        parts, known = [], []
        for _ in range(rng.randint(0, 9)):
            plain, linked = words(rng, rng.choice([0, 1, 5, 30, 60])), words(rng, rng.choice([0, 0, 1, 4]))
            if not plain and not linked:
                continue
            tag = rng.choice(["p", "div", "li", "h1", "td"])
            parts.append(f"<{tag} class='x'>{' '.join(plain)} {'<b>' if rng.random() < 0.2 else ''}" + (f"<a href='/y'>{' '.join(linked)}</a>" if linked else "") + f"</{tag.upper()}>")
            known.append((" ".join([*plain, *linked]), len(plain) + len(linked), len(linked)))
        page = "<html><head><title>t</title></head><body>" + "<script>no</script>".join(parts)
        assert html_extract.blocks(page) == known
        want = []
        for k, (text, *_) in enumerate(known):
            row = [x for j in (k - 1, k, k + 1) for x in ((known[j][1], known[j][2] / known[j][1]) if 0 <= j < len(known) else (0, 0))]
            node = html_extract.tree()
            while len(node) > 1:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            if node[0] >= 0.5:
                want.append(text)
        assert html_extract.text_of(page) == "\n".join(want)


@pytest.mark.parametrize("piece", ["<head>", "<script ", "<script>", "<!--", "<!", "</", "<a ", "<style></", "&#1", "< ", "</script", "<p>word", "<a>"])
def test_html_time(piece):
    import time

    page = piece * (2_000_000 // len(piece))
    began = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - began < 6


def test_html_extract(spark):
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (3, "<p>" + "word " * 40 + "</p>", 1, "x"), (3, "<p>" + "word " * 40 + "</p>", 1, "x"), (None, "<p>hi", 1, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, blocks int, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == 5 and sorted(len(r.text) for r in got if r.page_id == 3) == [199, 199]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_tree():
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = (x[:, 0] > 0.5) & (x[:, 2] <= 0.3)
    assert (html_extract.classify(html_extract.grow(x, y.astype(float)), x) == y).mean() > 0.99


def brute_covered(items, seq, length, coverage, least):
    """Tokens of seq in a stretch that some item holds and that exceeds a limit."""
    out = [False] * len(seq)
    for item in items:
        for i in range(len(seq)):
            for k in range(len(item)):
                m = 0
                while i + m < len(seq) and k + m < len(item) and seq[i + m] == item[k + m]:
                    m += 1
                if m >= length or m >= max(least, coverage * len(item)):
                    out[i : i + m] = [True] * m
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdef"])
def test_automaton(letters):
    rng = random.Random(9)
    for _ in range(150):
        items = [rng.choices(letters, k=rng.randint(1, 9)) for _ in range(rng.randint(1, 4))]
        items += [x[k : k + rng.randint(1, 5)] for x in list(items) for k in [rng.randrange(len(x))]]  # items within items
        items.append(rng.choices(letters, k=5) + rng.choice(items) + rng.choices(letters, k=30))
        seq = rng.choices(letters, k=12) + rng.choice(items) + rng.choices(letters, k=4) + ["zz"] + rng.choice(items)
        limits = rng.choice([(6, 0.8, 2), (4, 1.0, 1), (100, 0.5, 3), (7, 0.7, 5)])
        for k in (len(items), 2):  # together, and in parts
            spans = []
            for a in range(0, len(items), k):
                automaton = decontaminate.Automaton.of([(a + i, " ".join(x)) for i, x in enumerate(items[a : a + k])])
                spans += decontaminate.spans_of(pa.array([" ".join(seq)]), automaton, *limits).get(0, [])
            begins = np.cumsum([0] + [len(x) + 1 for x in seq])
            got = [any(s <= x < e for s, e, *_ in spans) for x in begins[:-1]]
            assert got == brute_covered(items, seq, *limits)
            for s, e, item, m in decontaminate.joined(spans):  # the item holds a stretch of the span of that length
                inside = " ".join(seq)[s:e].split()
                assert any(inside[x : x + m] == items[item][y : y + m] for x in range(len(inside) - m + 1) for y in range(len(items[item]) - m + 1))


def test_nested_items():
    lead = "x1 x2 a b c d e f x3 x4"
    items = [(1, "a b c d e f"), (2, lead + "".join(f" y{k}" for k in range(100)))]
    text = f"zz yy {lead} qq rr"
    for used in (items, items[:1]):
        spans = decontaminate.spans_of(pa.array([text]), decontaminate.Automaton.of(used))
        assert [text[s:e] for s, e, *_ in spans[0]] == ["a b c d e f"] and spans[0][0][2] == 1


def test_automaton_size():
    import tracemalloc

    rng = random.Random(1)
    items = [(i, " ".join(words(rng, 60, 30_000))) for i in range(1500)]
    tracemalloc.start()
    automaton = decontaminate.Automaton.of(items)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(len(t) for _, t in items)
    assert held < 10 * size and most < 60 * size and len(automaton.length) > 90_000


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [words(rng, 40), words(rng, 6), words(rng, 30)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, "")], "item_id bigint, text string")
    automaton = decontaminate.fit(bench)
    lead = " ".join(words(rng, 20, 10**6))
    texts = [
        f"{lead} {' '.join(items[0]).upper()}, tail",
        f"{lead} {' '.join(items[1])}! tail",  # short item, all of it
        f"{lead} {' '.join(items[2][5:17])} tail",  # twelve tokens: below both limits
        f"{lead} {' '.join(items[2][5:18])} tail",  # thirteen
        " ".join(items[0]),
        lead,
    ]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, automaton).collect()}
    assert set(got) == {0, 1, 3, 4} and got[0].clean_text == f"{lead} , tail" and got[0].spans[0].item_id == 0 and got[4].clean_text == ""
    assert texts[1][got[1].spans[0].start : got[1].spans[0].stop] == " ".join(items[1])
    kept = {r.doc_id: r.text for r in decontaminate.clean(docs, automaton).collect()}
    assert set(kept) == {0, 1, 2, 3, 5} and kept[2] == texts[2] and kept[5] == lead
    bad = odd(spark)
    assert decontaminate.clean(bad, automaton).count() == bad.count() and decontaminate.contaminated(bad, automaton).count() == 0
    assert decontaminate.clean(docs, decontaminate.fit(bench.limit(0))).count() == len(texts)
    parts = decontaminate.fit(bench, part_bytes=150)
    assert len(parts) > 1 and rows_of(decontaminate.contaminated(docs, parts)) == rows_of(decontaminate.contaminated(docs, automaton))
    clash = docs.withColumnRenamed("source", "spans").withColumnRenamed("lang", "spans_")
    assert rows_of(decontaminate.clean(clash, parts)) == rows_of(decontaminate.clean(docs, automaton))
    long = f"{lead} " * 5000 + " ".join(items[0])
    assert [r.clean_text for r in decontaminate.contaminated(frame(spark, [long]), automaton).collect()] == [f"{lead} " * 5000]
    assert decontaminate.clean(docs.limit(0), automaton).count() == 0


def test_minimisers():
    rng = np.random.default_rng(0)
    for n, w in ((50, 7), (200, 26), (5, 7), (30, 1)):
        h = rng.integers(0, 40, n).astype(np.uint64)
        want = sorted({i for a in range(n - w + 1) for i in range(a, a + w) if h[i] == h[a : a + w].min()})
        assert suffix_dedup.minimisers(h, w).tolist() == want


@pytest.mark.parametrize("group_rows", [200_000, 3])
def test_repeats(spark, group_rows):
    rng = random.Random(11)
    texts = [words(rng, rng.choice([10, 60, 150, 400])) for _ in range(30)]
    for n in (49, 50, 51, 80, 120):  # passages moved into other documents, several times
        passage = words(rng, n)
        for _ in range(3):
            t = rng.choice(texts)
            k = rng.randrange(len(t))
            t[k:k] = passage
    texts += [list(texts[3]), ["same"] * 130, ["same"] * 90]
    own = words(rng, 70)
    texts.append(own + words(rng, 9) + own)  # repeated in one document only
    texts.append(words(rng, 20_000) + texts[4])
    long = words(rng, 55)
    texts += [long * 300, words(rng, 5) + long + words(rng, 5)]  # one place in a document, hundreds in another
    texts = [" ".join(t) for t in texts]
    holders, seqs = defaultdict(set), [hashes(t).tolist() for t in texts]
    for i, s in enumerate(seqs):
        for k in range(len(s) - 49):
            holders[tuple(s[k : k + 50])].add(i)
    want = {}
    for i, s in enumerate(seqs):
        c = np.zeros(len(s), bool)
        for k in range(len(s) - 49):
            if len(holders[tuple(s[k : k + 50])]) > 1:
                c[k : k + 50] = True
        if c.any():
            want[i] = c.tolist()
    docs = frame(spark, texts)
    got = {}
    for r in suffix_dedup.repeats(docs, group_rows=group_rows).collect():
        c = got.setdefault(r.doc_id, [False] * len(seqs[r.doc_id]))
        c[r.start_token : r.stop_token] = [True] * (r.stop_token - r.start_token)
        assert r.other_doc_id != r.doc_id
    assert got == want
    bad = odd(spark, [(6, texts[3], "en", "s0", 1), (6, "short", "en", "s0", 1), (7, texts[3], "en", "s0", 1)])
    assert {r.doc_id for r in suffix_dedup.repeats(bad, group_rows=group_rows).collect()} == {6, 7}
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


def test_streamed_groups():
    """Groups of suffixes split into batches are found as if they were whole."""
    rng = np.random.default_rng(0)
    n, window = 400, 4
    key = np.sort(rng.integers(0, 4, n))
    doc = rng.integers(0, 50, n)
    passages = (rng.integers(0, 30, (n, window)) + 100 * key[:, None]) * (rng.random((n, window)) < 0.8)
    schema = ["key", "doc_id", "place", "passages"]
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(np.arange(n, dtype=np.int32) + 10), pa.array([p.astype("<u8").tobytes() for p in passages], pa.binary())], schema)
    spans = lambda pieces: sorted(r for b in suffix_dedup._extend(iter(pieces), 9, window) for r in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))
    assert spans([batch.slice(k, 37) for k in range(0, n, 37)]) == spans([batch]) == spans([batch.slice(k, 1) for k in range(n)])
    rows = [pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc)], ["k", "d"])]
    order = np.lexsort((doc, key))
    flat = rows[0].take(pa.array(order))
    want = [r for r in zip(key[order].tolist(), doc[order].tolist(), strict=True)]
    single = {k for k in set(key.tolist()) if len(set(doc[key == k].tolist())) < 2}
    got = [r for b in suffix_dedup.shared_rows(iter([flat.slice(k, 9) for k in range(0, n, 9)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted(r for r in want if r[0] not in single)


def test_shared_rows_small():
    def run(rows, step):
        b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["k", "d"])
        return sorted(r for x in suffix_dedup.shared_rows(iter([b.slice(k, step) for k in range(0, len(rows), step)])) for r in zip(*(c.to_pylist() for c in x.columns), strict=True))

    rng = random.Random(0)
    for _ in range(300):
        rows = sorted((rng.randrange(5), rng.randrange(3)) for _ in range(rng.randint(1, 14)))
        want = sorted(r for r in rows if len({d for k, d in rows if k == r[0]}) > 1)
        assert run(rows, rng.randint(1, 5)) == want


