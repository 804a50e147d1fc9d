"""Times of the headline queries as one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from quillspark.operators import indexing  # noqa: E402
from quillspark.plans import search  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = {
    "term": "that",
    "and_2": "from that",
    "and_rare": "ther heent",
    "and_mixed": "this with",
    "or_2": "from OR ther",
    "not": "that NOT from",
    "and_3": "that from with",
    "common_term": "the",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp()
    times: dict[str, float] = {}

    def timed(name: str, f):
        began = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    try:
        docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
        index = timed("index_build", lambda: indexing.write(indexing.build(docs, ["text"]), f"{folder}/index"))
        # the first build also starts the session's threads and compiles code
        index = timed("index_build_warm", lambda: indexing.write(indexing.build(docs, ["text"]), f"{folder}/index"))
        n = index.docs.count()
        search.ranked(index, "warm OR up").collect()
        for name, q in QUERIES.items():
            timed(name, lambda q=q: search.ranked(index, q).collect())
        timed("batch_8", lambda: search.batch(index, {k: " OR ".join(q.replace(" NOT ", " ").replace(" OR ", " ").split()) for k, q in enumerate(QUERIES.values())}).collect())
        timed("no_index", lambda: search.ranked(indexing.build(docs, ["text"]), "from OR ther OR pour").collect())
        times["docs_per_second"] = round(n / times["index_build_warm"], 1)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    value = round(sum(v for k, v in times.items() if k != "docs_per_second"), 3)
    print(json.dumps({"metric": "search_bench_total", "value": value, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cores": int(CPUS)}))


if __name__ == "__main__":
    main()
