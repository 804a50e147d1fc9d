"""Small documents for the operators' tests."""

import random

import numpy as np

from quillspark.llm import _text

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def hashes(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _text.tokens(raw, np.array([0, len(raw)])).hash


#: Rows that every operator must bear: nulls, empty and blank text, repeated rows, odd characters.
ODD = [(None, "a text without a number", "en", "s0", 3), (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "  \n\t ", "en", None, 0), (4, "one", "en", "s1", 3), (4, "one", "en", "s1", 3), (5, "Ünïcödé — “quotes” … 漢字 😀 \u0000 end", "de", "s0", 9)]


def odd(spark, extra=()):
    """The odd rows, with columns whose names clash with those that operators use themselves."""
    rows = [(*r, 7, "k", 1, "v") for r in [*ODD, *extra]]
    return spark.createDataFrame(rows, SCHEMA + ", id int, key string, `first` int, label string")
