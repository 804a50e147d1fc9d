"""python -m quillspark.cli index|merge|search|stats ..."""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from itertools import islice
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import indexing
from quillspark.plans.parser import QueryError
from quillspark.plans.search import SearchIndex, format_bytes, format_duration
from quillspark.sources import jsonl
from quillspark.sources.shared import shared_folder

#: Lines of standard input that are held at once, and lines that aren't JSON of which a warning tells, at most.
STDIN_ROWS, WARNINGS = 50_000, 10


TITLES, BODIES = ("title", "name", "subject"), ("body", "text", "content", "description")


def shown(hit: dict, size: int = 200) -> list[str]:
    """Lines of a hit: rank, score and title, then a snippet, else the first string field that isn't an id."""
    fields = hit
    if isinstance(hit.get("value"), str):  # the document as it came
        try:
            whole = json.loads(hit["value"])
            fields = whole if isinstance(whole, dict) else hit
        except ValueError:
            pass
    text = lambda names: next((fields[n] for n in names if isinstance(fields.get(n), str)), None)
    head, body = text(TITLES), text(BODIES)
    out = [f"{hit['rank']}. [{hit['score']:.4f}] {'(untitled)' if head is None else head}"]
    if body is not None:
        out.append("   " + body[:size] + ("..." if len(body) > size else ""))
    elif head is None:
        rest = ((k, v) for k, v in fields.items() if isinstance(v, str) and k not in ("id", "value"))
        out += [f"   {k}: {v[:size]}" for k, v in rest][:1]
    return out


def staged(spark: SparkSession, stream: IO[str], rows: int = STDIN_ROWS) -> DataFrame:
    """The lines of a stream, held a bounded number at a time and written to the shared folder as they come."""
    path = f"{shared_folder(spark).rstrip('/')}/stdin-{uuid.uuid4().hex}"
    k = 0
    while part := list(islice(stream, rows)):
        jsonl.from_lines(spark, (x.rstrip("\n") for x in part)).coalesce(1).write.text(f"{path}/part={k:08d}")
        k += 1
    return spark.read.schema("value string").text(f"{path}/part=*") if k else jsonl.from_lines(spark, [])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    sub = parser.add_subparsers(dest="command", required=True)
    make = sub.add_parser("index", help="index JSON lines")
    make.add_argument("--input", required=True, help="files, or - for standard input")
    make.add_argument("--output", required=True)
    make.add_argument("--fields", default="title,body")
    make.add_argument("--batch-size", type=int, default=indexing.SEGMENT_DOCS)
    make.add_argument("--append", action="store_true", help="add segments to an index that is there")
    for name in ("merge", "stats", "search"):
        one = sub.add_parser(name)
        one.add_argument("--index", required=True)
        if name == "merge":
            one.add_argument("--output", help="where the merged index goes; without it, it takes the place of the old one")
        if name == "search":
            one.add_argument("--limit", type=int, default=10)
            one.add_argument("query", nargs="+")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if a.command == "index":
        began = time.perf_counter()
        fields = [f.strip() for f in a.fields.split(",")]
        raw = staged(spark, sys.stdin) if a.input == "-" else jsonl.lines(spark, a.input)
        docs = jsonl.with_ids(jsonl.documents(raw).select("value", *(jsonl.text_field(F.col("doc"), f).alias(f) for f in fields)))
        index = indexing.build(docs, fields, segment_docs=a.batch_size)
        index = indexing.append(index, a.output) if a.append else indexing.write(index, a.output)
        for line in jsonl.rejects(raw).limit(WARNINGS).collect():
            print(f"not JSON: {line.value[:200]}", file=sys.stderr)
        n, took = jsonl.counters(raw).first(), time.perf_counter() - began
        print(f"{n.documents} documents, {n.malformed} malformed lines, {index.segment_count} segments, {took:.1f} s, {n.documents / took:.0f} documents/s")
    elif a.command == "merge" and a.output:
        indexing.write(indexing.merge(indexing.open_index(spark, a.index)), a.output)
    elif a.command == "merge":
        print(f"{indexing.merge_in_place(spark, a.index).segment_count} segments")
    elif a.command == "stats":
        s = SearchIndex(spark, a.index).stats()
        print(f"{s['total_docs']} documents, {s['total_segments']} segments, {s['total_terms']} terms, {format_bytes(s['index_size_bytes'])}")
    else:
        try:
            found = SearchIndex(spark, a.index).search(" ".join(a.query), a.limit)
        except (QueryError, ValueError) as e:
            print(e, file=sys.stderr)
            return 1
        print(f"{found.total_matches} documents in {format_duration(found.took_ms)}")
        for h in found.hits:
            print("\n".join(shown(h)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
