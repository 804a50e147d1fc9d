import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from quillspark.llm import _spark, decontaminate, line_dedup, quality_embeddings
from quillspark.llm.sql import SQL

from .helpers import SCHEMA, words
from .test_operators import brute_covered, plain_classes, plain_dedup, plain_pairs, plain_quality


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents of every kind, labels and a benchmark."""
    rng = random.Random(21)
    out = tmp_path_factory.mktemp("data")
    item = words(rng, 30)
    line = "a line that many documents of this corpus share with others"
    rows, labels = [], []
    for i in range(240):
        w = words(rng, 60)
        bad = i % 6 == 5
        text = " ".join(x + ("###" if bad else "") for x in w)
        if i % 10 == 1:
            text = f"{line}\n{text}"
        if i == 50:
            text += " " + " ".join(item)
        rows.append((i, text, "en", f"s{i % 3 if i % 4 else 0}", len(text)))
        labels.append((i, int(not bad), 0))
    near = rows[2][1].split()
    near[7] = "changed"
    rows.append((240, " ".join(near), "en", "s1", 1))
    rows.append((241, rows[4][1], "en", "s1", 1))
    con = duckdb.connect()
    for name, data, columns in (("documents", rows, ["doc_id", "text", "lang", "source", "n_chars"]), ("labels", labels, ["doc_id", "quality", "toxic"]), ("benchmark", [(0, " ".join(item))], ["item_id", "text"])):
        con.register("t", pd.DataFrame(data, columns=columns))
        con.sql(f"COPY t TO '{out}/{name}.parquet'")
        con.unregister("t")
    return str(out)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    docs = _spark.read(spark, folder, "documents")
    kept = corpus_pipeline.quality(spark, docs, folder)
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i in range(240) if i % 6 != 5} | {240, 241}
    assert len(clean - ids) <= 2 and len(ids - clean) <= 2
    lined = corpus_pipeline.lines(spark, kept, folder)
    texts = {r.doc_id: r.text for r in lined.collect()}
    shared = [i for i in sorted(ids) if i % 10 == 1 and i < 240]
    assert "a line that" in texts[shared[0]] and all("a line that" not in texts[i] for i in shared[1:])
    assert ids - set(texts) == {241}  # all of its lines stand in an earlier document
    one = corpus_pipeline.near_duplicates(spark, lined, folder)
    assert set(texts) - {r.doc_id for r in one.collect()} == {240}
    free = corpus_pipeline.decontamination(spark, one, folder)
    assert free.columns == docs.columns and free.count() == one.count()
    after = {r.doc_id: r.text for r in free.collect()}
    assert len(after[50].split()) == 60 and sum(after[i] != texts[i] for i in after) == 1


def test_run_by_brute_force(spark, folder):
    """run() is the stages one after the other, each worked out from its definition."""
    docs = _spark.read(spark, folder, "documents")
    model = quality_embeddings.fit(docs, _spark.read(spark, folder, "labels"))
    rows = sorted(r for r in docs.collect() if plain_quality(r.text, model) >= quality_embeddings.THRESHOLD)
    lined = plain_dedup([r.text for r in rows], line_dedup.MIN_BLOCK)
    rows = [(rows[k].doc_id, t, rows[k].source) for k, t in lined.items()]
    classes = plain_classes(len(rows), plain_pairs([t for _, t, _ in rows])[0])
    rows = [r for k, r in enumerate(rows) if classes.get(k, (k,))[0] == k]
    item = duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchone()[0].split()
    clean = []
    for i, t, s in rows:
        gone = brute_covered([item], t.split(), decontaminate.LENGTH, decontaminate.COVERAGE, decontaminate.LEAST)
        clean.append((i, " ".join(w for w, g in zip(t.split(" "), gone, strict=True) if not g) if any(gone) else t, s))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([c for c in clean if c[1]], columns=["doc_id", "text", "source"]))
    want = sorted(con.sql(SQL["op2_mixture"]).fetchall())
    got = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r) for r in got.select("doc_id", "source", "mix_epoch", "mix_block", "mix_place").collect()) == want
    texts = {i: t.strip() for i, t, _ in clean}
    assert all(r.text.strip() == texts[r.doc_id] for r in got.collect())


def test_empty_and_odd(spark, folder):
    from .helpers import odd

    for docs in (spark.createDataFrame([], SCHEMA), odd(spark)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, folder)
            kept = docs.collect()
            ids = {r.doc_id for r in kept}
            assert docs.columns[: len(before.columns)] == before.columns and ids <= {r.doc_id for r in before.collect()}
            if name == "quality classifier":
                assert not ids & {1, 2, 3}  # null, empty and blank


def test_own_output(spark, folder):
    """The last stage takes rows that have gone through it already."""
    docs = _spark.read(spark, folder, "documents").limit(20)
    once = corpus_pipeline.mixture(spark, docs, folder)
    twice = corpus_pipeline.mixture(spark, once, folder)
    assert twice.columns == [*once.columns, "mix_epoch_", "mix_block_", "mix_place_"] and twice.count() > 0
