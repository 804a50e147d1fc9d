import io
import math
import random
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.operators import indexing
from quillspark.plans import search
from quillspark.plans.parser import And, Not, Or, QueryError, Term, parse
from quillspark.sources import jsonl
from quillspark.streaming import ingest


def index_of(spark, docs, fields=("title", "body"), segment_docs=1 << 30):
    rows = [(i, *d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"{f} string" for f in fields))
    return indexing.build(df, list(fields), segment_docs=segment_docs)


def found(index, query, **kw):
    return [(r.doc_id, r.score) for r in search.ranked(index, query, **kw).collect()]


E2E = [("Rust Programming", "Rust is a systems programming language"), ("Python Guide", "Python is great for scripting"), ("Rust Web", "Build web applications with Rust")]


def test_term(spark):
    assert found(index_of(spark, E2E), "rust") == [(2, 0.654624), (0, 0.630143)]


def test_or_tie(spark):
    docs = [("Rust", "systems language"), ("Python", "scripting language"), ("Go", "compiled language")]
    assert found(index_of(spark, docs), "rust OR python") == [(0, 0.980829), (1, 0.980829)]


def test_and(spark):
    docs = [("Rust Web", "build web apps with rust"), ("Rust CLI", "build cli tools with rust"), ("Python Web", "build web apps with python")]
    assert found(index_of(spark, docs), "rust web") == [(0, 1.29251)]
    assert found(index_of(spark, docs), "rust missing") == []


def test_no_hits_and_errors(spark):
    index = index_of(spark, [("Hello", "World")])
    assert found(index, "nonexistent") == []
    for q in ("", "(unclosed", "NOT hello", "hello OR NOT world"):
        with pytest.raises(QueryError):
            found(index, q)
    with pytest.raises(ValueError):
        found(index, "hello", limit=-1)


def test_paging(spark):
    index = index_of(spark, [(f"Doc {i}", "common term here") for i in range(20)])
    a, b = found(index, "common", limit=5), found(index, "common", limit=5, offset=5)
    assert len(a) == len(b) == 5 and not {x for x, _ in a} & {x for x, _ in b}
    assert a + b == found(index, "common", limit=10)
    assert search.counts(index, "common", limit=5).first().asDict() == {"total_hits": 5, "total_matches": 20}


def test_segments_and_merge(spark):
    index = index_of(spark, [("rust programming",), ("rust web",), ("rust fast",), ("python slow",)], ("body",), segment_docs=2)
    assert found(index, "rust") == [(2, 1.203973), (0, 0.693147), (1, 0.693147)]
    assert found(indexing.merge(index), "rust") == [(0, 0.356675), (1, 0.356675), (2, 0.356675)]


def test_merge_counts(spark):
    merged = indexing.merge(index_of(spark, [("alpha one",), ("beta two",), ("gamma three",)], ("body",), segment_docs=1))
    assert indexing.stats(merged).first().asDict() == {"total_docs": 3, "total_segments": 1, "total_terms": 6}


def test_dictionary(spark):
    index = index_of(spark, [("zebra apple mango banana cherry",), ("apple banana date",), ("cherry date elderberry fig",)], ("body",))
    rows = indexing.dictionary(index).orderBy("term_id").collect()
    assert [r.term_id for r in rows] == list(range(8)) and rows[0].term == "apple" and rows[0].df == 2


def test_blocks(spark):
    index = index_of(spark, [(f"common term doc{i}",) for i in range(200)], ("body",))
    rows = indexing.blocks(index).where("term = 'common'").orderBy("block_id").collect()
    assert [(r.postings, r.last_doc_id) for r in rows] == [(128, 127), (72, 199)]
    assert indexing.block_of(index, "common", 128).first()[0] == 199


def test_seek(spark):
    index = index_of(spark, [("a",), ("a",), ("b",), ("a",), ("a",)], ("body",))
    assert [indexing.seek(index, "a", k).first()[0] for k in (2, 4, 5)] == [3, 4, None]


def test_gaps(spark):
    index = index_of(spark, [("x" if i in (100, 105, 200, 201, 500) else "y",) for i in range(501)], ("body",))
    rows = indexing.gaps(index).where("term = 'x'").orderBy("doc_id").collect()
    assert [r.gap for r in rows] == [100, 5, 95, 1, 299]
    back = indexing.ungap(indexing.gaps(index))
    assert back.where("doc_id <> decoded").count() == 0


def test_counts(spark):
    index = index_of(spark, [("rust rust rust programming", None), ("Hello", "World is great"), (None, None)])
    assert {(r.term, r.tf) for r in index.postings.where("doc_id = 0").collect()} == {("rust", 3), ("programming", 1)}
    assert {r.doc_id: r.dl for r in index.docs.collect()} == {0: 4, 1: 4, 2: 0}
    assert math.isclose(index.segments.first().avgdl, 8 / 3)


def test_empty(spark):
    index = index_of(spark, [])
    assert found(index, "a OR b") == [] and found(index, "a b") == []
    assert indexing.stats(index).first().total_docs == 0


def test_written_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index = indexing.write(index_of(spark, E2E, segment_docs=2), path)
    assert index.segments.count() == 2
    open_ = search.SearchIndex(spark, path)
    got = open_.search("rust web")
    assert [h["doc_id"] for h in got.hits] == [2] and got.hits[0]["title"] == "Rust Web" and got.total_matches == 1
    stats = open_.stats()
    assert stats["total_docs"] == 3 and stats["index_size_bytes"] > 0
    with pytest.raises(FileNotFoundError):
        indexing.open_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        open_.search("  ")


def test_jsonl(spark, tmp_path):
    lines = ['{"title": "Test Doc", "body": "search engine test"}', "", "  ", "{bad", '{"title": 5, "body": "plain"}', "[1]"]
    raw = jsonl.from_lines(spark, lines)
    assert jsonl.counters(raw).first().asDict() == {"documents": 3, "malformed": 1, "blank": 2}
    assert [r.value for r in jsonl.rejects(raw).collect()] == ["{bad"]
    docs = jsonl.with_ids(jsonl.documents(raw).select(*(jsonl.text_field(F.col("doc"), f).alias(f) for f in ("title", "body"))))
    rows = sorted((r.doc_id, r.title, r.body) for r in docs.collect())
    assert rows == [(0, "Test Doc", "search engine test"), (1, None, "plain"), (2, None, None)]


def test_lines_are_json_as_a_whole(spark, tmp_path):
    bad = ["1 2", "4451718024887799 27.65.93.188", '"a" b', '{"a":1} x', "[1]]", "1,2", "1], [2", '"a', "\\"]
    good = ["1", " [1] ", "null", '"a"', '{"a": [1, {}]}']
    raw = jsonl.from_lines(spark, bad + good)
    assert jsonl.counters(raw).first().asDict() == {"documents": len(good), "malformed": len(bad), "blank": 0}
    assert [r.value for r in jsonl.rejects(raw).collect()] == bad
    assert [r.d for r in jsonl.documents(raw).select(F.to_json("doc").alias("d")).collect()] == ["1", "[1]", "null", '"a"', '{"a":[1,{}]}']


def test_ingest_rejects_as_its_sql(spark, tmp_path):
    import duckdb

    from quillspark.plans import catalogue

    texts = ["1 2", "x", "[1]", "\n", "\t ", " ", "\u00a0", "", None]
    rows = [(5 * k + 2, "s", t) for k, t in enumerate(texts)] + [(0, "s", "a"), (1, "s", "b"), (3, "s", 'c"'), (4, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()["ingest_rejects"]).fetchall()
    assert [tuple(r) for r in catalogue.queries()["ingest_rejects"](spark, str(tmp_path)).collect()] == want


def test_stream(spark, tmp_path):
    path = str(tmp_path / "index")
    a = jsonl.from_lines(spark, ['{"body": "rust programming"}', '{"body": "rust web"}'])
    b = jsonl.from_lines(spark, ['{"body": "rust fast"}', '{"body": "python slow"}'])
    assert ingest.append(a, path, ["body"], 0, 0) == 2
    for _ in range(2):  # a repeated batch overwrites itself
        ingest.append(b, path, ["body"], 1, 1 << 40)
    assert found(ingest.open_stream(spark, path), "rust") == [(1 << 40, 1.203973), (0, 0.693147), (1, 0.693147)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "x.jsonl").write_text('{"body": "alpha beta"}\n')
    writer = ingest.stream(spark.readStream.text(str(source)), str(tmp_path / "live"), ["body"], str(tmp_path / "mark"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert len(found(ingest.open_stream(spark, str(tmp_path / "live")), "alpha")) == 1


def test_presentation(spark):
    df = spark.createDataFrame([(None, "x" * 250), ("", "y"), ("T", None)], "title string, body string")
    rows = df.select(search.title("title", "body"), search.snippet("body"), search.brief("body")).collect()
    assert rows[0][0] == "x" * 250 and rows[0][1] == "x" * 200 + "..." and len(rows[0][2]) == 200
    assert rows[1][0] == "" and rows[1][1] == "y" and rows[2][1] == ""


def brute(docs, query, n_all=None):
    """Scores of a query by the definition, for one segment."""
    toks = [d.split() for d in docs]
    n = len(docs)
    length = [len(t) for t in toks]
    average = sum(length) / n
    quant = [0 if not x else max(1, round(2 ** (min(255, int(math.log2(x + 1) * 16)) / 16) - 1)) for x in length]
    df = Counter(w for t in toks for w in set(t))

    def term(w):
        if n >= 1000 and df[w] / n > 0.5:
            return None
        idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
        return {i: idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * quant[i] / average)) for i, t in enumerate(toks) if (c := t.count(w))}

    def run(q):
        if isinstance(q, Term):
            return term(q.text) or {}
        if isinstance(q, Or):
            out = defaultdict(float)
            plain = all(isinstance(p, Term) for p in q.parts)
            for p in q.parts:
                for i, s in run(p).items():
                    out[i] = out[i] + s if plain else max(out[i], s)
            return out
        keep, out = None, defaultdict(float)
        for p in q.parts:
            if isinstance(p, Not):
                continue
            r = term(p.text) if isinstance(p, Term) else run(p)
            if r is None:
                continue
            keep = set(r) if keep is None else keep & set(r)
            for i, s in r.items():
                out[i] += s
        keep = keep or set()
        for p in q.parts:
            if isinstance(p, Not):
                bad = {i for i, t in enumerate(toks) if p.part.text in t} if isinstance(p.part, Term) else set(run(p.part))
                keep -= bad
        return {i: out[i] for i in keep}

    return run(parse(query) if isinstance(query, str) else query)


@pytest.mark.parametrize("query", ["a", "a b", "a OR b OR c", "a a b", "(a OR b) c", "(a b) OR (c d)", "a NOT b", "a NOT (b c)", "(a OR b) (c OR d) NOT e", "a OR (b NOT c)"])
def test_against_brute_force(spark, query):
    rng = random.Random(7)
    docs = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) for _ in range(60)]
    want = {i: round(s, 5) for i, s in brute(docs, query).items()}
    got = {i: round(s, 5) for i, s in found(index_of(spark, [(d,) for d in docs], ("body",)), query, limit=100)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-5 for i in want)


def test_common_terms_are_left_out(spark):
    docs = [("the x" if i % 2 else "the y",) for i in range(1000)]
    index = index_of(spark, docs, ("body",))
    assert found(index, "the") == []
    assert found(index, "the x") == found(index, "x")
    assert found(index, "x NOT the") == []


def test_batch_equals_single(spark):
    index = index_of(spark, E2E)
    rows = search.batch(index, {1: "rust", 2: "python OR web OR web"}).collect()
    for i, q in ((1, "rust"), (2, "python OR web OR web")):
        assert [(r.doc_id, r.score) for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)] == found(index, q)
    with pytest.raises(ValueError):
        search.batch(index, {1: "a AND b"})


def test_server_and_cli(spark, tmp_path, capsys):
    import json
    import threading
    import urllib.request

    from quillspark import cli, server

    source = tmp_path / "in.jsonl"
    source.write_text('{"title": "Rust Web", "body": "build <b> apps"}\n{bad\n\n{"title": "Go", "body": "rust tools"}\n')
    path = str(tmp_path / "index")
    assert cli.main(["index", "--input", str(source), "--output", path, "--batch-size", "1"]) == 0
    assert "2 documents, 1 malformed" in capsys.readouterr().out
    assert cli.main(["merge", "--index", path, "--output", path + "2"]) == 0
    assert cli.main(["search", "--index", path + "2", "rust", "web"]) == 0
    assert "Rust Web" in capsys.readouterr().out
    assert cli.main(["search", "--index", path, "(rust"]) == 1
    assert cli.main(["stats", "--index", path]) == 0
    assert "2 documents, 2 segments" in capsys.readouterr().out
    assert cli.shown({"rank": 2, "score": 0.5, "value": '{"id": "7", "n": 3, "place": "here"}'}) == ["2. [0.5000] (untitled)", "   place: here"]
    assert cli.shown({"rank": 1, "score": 1.0, "title": "T", "body": "b" * 201})[1] == "   " + "b" * 200 + "..."
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sys, "stdin", io.StringIO('{"title": "Rust Book"}\n{bad\n{"body": "more rust"}\n'))
        m.setattr(cli.staged, "__defaults__", (2,))
        assert cli.main(["index", "--input", "-", "--output", path, "--append"]) == 0
    said = capsys.readouterr()
    assert "2 documents, 1 malformed lines, 3 segments" in said.out and "not JSON: {bad" in said.err
    assert cli.main(["merge", "--index", path]) == 0 and "1 segments" in capsys.readouterr().out
    assert cli.main(["search", "--index", path, "rust"]) == 0 and "4 documents in" in capsys.readouterr().out
    path += "2"
    http = server.serve(search.SearchIndex(spark, path), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{p}").read().decode()
    try:
        found = json.loads(get("/api/search?q=rust&limit=5"))
        assert found["total_matches"] == 2 and len(found["hits"]) == 2
        assert json.loads(get("/api/stats"))["total_docs"] == 2 and json.loads(get("/health"))["status"] == "ok"
        assert "build &lt;b&gt; apps" in get("/search?q=web") and "2 documents" in get("/")
        for bad in ("/api/search?q=", "/api/search?q=(x", "/nothing"):
            with pytest.raises(urllib.error.HTTPError):
                get(bad)
    finally:
        http.shutdown()


def test_estimate_and_ranges(spark):
    from quillspark.plans.planner import estimate

    index = index_of(spark, [("a b",), ("a",), ("b c",), ("c",)], ("body",), segment_docs=2)
    for q, n in (("a", 2), ("a OR c", 4), ("(a OR b) c", 2), ("a NOT b", 2), ("zz a", 0)):
        assert estimate(index, parse(q)).first()[0] == n
    ids = spark.createDataFrame([(0,), (3,), (9,), (None,)], "doc_id bigint")
    assert {(r.doc_id, r.segment_id) for r in indexing.segment_of(index, ids).collect()} == {(0, 0), (3, 1), (9, None), (None, None)}
    page = search.as_json(search.hits(index, "c")).collect()
    assert '"doc_id":3' in page[0].hit and page[0]["rank"] == 1


def test_append_and_merge_in_place(spark, tmp_path):
    path = str(tmp_path / "index")
    parts = [[("rust programming",), ("rust web",)], [("rust fast",), ("python slow",)], [("",)]]
    for p in parts:
        index = indexing.append(index_of(spark, p, ("body",)), path)
    assert sorted((r.segment_id, r.doc_count, r.min_doc_id) for r in index.segments.collect()) == [(0, 2, 0), (1, 2, 2), (2, 1, 4)]
    lazily = index_of(spark, [d for p in parts for d in p], ("body",), segment_docs=2)
    assert found(index, "rust") == found(lazily, "rust")
    merged = indexing.merge_in_place(spark, path)
    assert merged.segment_count == 1 and found(merged, "rust") == found(indexing.merge(lazily), "rust")
    assert {p.name for p in tmp_path.iterdir()} == {"index"}
    again = indexing.merge_in_place(spark, path)
    assert again.segment_count == 1 and indexing.stats(again).first().asDict() == {"total_docs": 5, "total_segments": 1, "total_terms": 6}


def test_plans_of_a_written_index(spark, tmp_path):
    docs = [("common word" if i % 2 else f"common other w{i}",) for i in range(3000)]
    index = indexing.write(index_of(spark, docs, ("body",), segment_docs=1000), str(tmp_path / "index"))
    page = search.hits(index, "word OR w10")
    page.collect()
    plan = page._jdf.queryExecution().executedPlan().toString()
    # words and the page travel, postings and documents stay where they are
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan and "PartitionFilters" in plan and "bucket#" in plan


def test_files_of_a_written_index(spark, tmp_path):
    """Files grow with the tasks that write them, not with the segments."""
    docs = [(f"common other w{i}",) for i in range(1500)]
    lazily = index_of(spark, docs, ("body",), segment_docs=5)
    index = indexing.write(lazily, str(tmp_path / "index"))
    files = len(list((tmp_path / "index" / "docs").rglob("*.parquet")))
    assert files <= lazily.docs.rdd.getNumPartitions() * 5  # of 300 segments, 64 to a folder
    assert len(list((tmp_path / "index" / "postings").rglob("*.parquet"))) <= lazily.docs.rdd.getNumPartitions() * indexing.BUCKETS
    assert index.segments.count() == 300 and found(index, "w7 OR w1400") == found(lazily, "w7 OR w1400")
    assert [h.body for h in search.hits(index, "w1400").collect()] == ["common other w1400"]
    plan = search.hits(index, "w1400")._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in plan and "__folder" in plan
    merged = indexing.merge_in_place(spark, str(tmp_path / "index"))
    assert merged.segment_count == 1 and "__folder" not in search.hits(merged, "w1400").columns
    assert [h.body for h in search.hits(merged, "w1400").collect()] == ["common other w1400"]


@pytest.mark.parametrize("query", ["a NOT the", "a NOT (b c)", "c OR (a b)", "(b OR c) a", "a b c", "a OR b OR c"])
def test_texts_are_read_once(spark, query):
    """A search without a written index splits each text once, however often its words take part."""
    reads = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rng = random.Random(3)
    docs = [" ".join(rng.choices(["a", "b", "c", "d", "the"], k=rng.randint(0, 6))) for _ in range(40)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id bigint, body string").mapInArrow(counting, "doc_id bigint, body string")
    got = found(indexing.build(df, ["body"]), query, limit=100)
    assert reads.value == 40
    want = brute(docs, query)
    assert {i for i, _ in got} == set(want) and all(abs(s - want[i]) < 2e-5 for i, s in got)


def test_terms_are_worked_out_once(spark):
    plan = index_of(spark, E2E).postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and plan.count("sort_array(") == 1  # one split for each field


def test_batch_and_estimate_read_once(spark):
    from quillspark.plans.planner import estimate

    index = index_of(spark, E2E)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (search.batch(index, {1: "rust OR web"}), estimate(index, parse("rust web")), indexing.seek(index, "rust", 1))]
    assert all("split(" not in p for p in plans)


def test_codecs(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2097151, 2097152, 268435455, 268435456, (1 << 32) - 1]
    df = spark.createDataFrame([(values,), ([],)], "v array<bigint>")
    whole = df.select("v", F.unhex(F.array_join(F.transform("v", lambda x: F.hex(scoring.vbyte(x))), "")).alias("data"))
    assert all(r.v == r.back for r in whole.select("v", scoring.vbyte_numbers(F.col("data")).alias("back")).collect())
    one = spark.range(1).select(*(F.hex(scoring.vbyte(F.lit(v).cast("bigint"))).alias(f"v{v}") for v in (0, 5, 127, 128, 300))).first()
    assert list(one) == ["80", "85", "FF", "0081", "2C82"]
    index = index_of(spark, [("x" if i % 3 == 0 else "y x x",) for i in range(700)], ("body",))
    back = indexing.decoded(indexing.encoded(index))
    assert sorted(map(tuple, back.collect())) == sorted((r.segment_id, r.term, r.doc_id, r.tf) for r in index.postings.collect())


def test_decoding_is_linear(spark):
    """No function of an element goes over all elements: the work of a full block was cubic."""
    index = index_of(spark, [("x",) for _ in range(300)], ("body",))
    plan = indexing.decoded(indexing.encoded(index))._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in plan.split("Aggregate")[0] and plan.count("Window [") == 1
    v = spark.createDataFrame([([3] * 9000,)], "v array<bigint>").select(F.unhex(F.array_join(F.transform("v", lambda x: F.hex(scoring.vbyte(x))), "")).alias("data"))
    assert v.select(F.size(scoring.vbyte_numbers(F.col("data")))).first()[0] == 9000


def test_terms_are_not_worked_out_again(spark):
    from quillspark.plans import catalogue

    index = index_of(spark, [("a b",), ("a",), ("b c",), ("c",)], ("body",), segment_docs=2)
    splits = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert splits(indexing.blocks(index)) == 2  # postings, and lengths for the segments
    assert splits(catalogue.queries()["merge_equals_single"](spark, "/root/testdata/sf0.001")) == 1  # counting documents needs no terms
