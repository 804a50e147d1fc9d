import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import _text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB3 _-.éÉ “漢\n", max_size=30)), max_size=8))
def test_tokens(texts):
    raw, off = _text.buffers(pa.array(texts, pa.string()))
    t = _text.tokens(raw, off)
    low = _text.lower(raw) if len(raw) else raw
    got = [[low[s:e].tobytes().decode() for s, e in zip(t.start[a:b], t.end[a:b], strict=True)] for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
    want = [re.findall(r"[a-z0-9é漢]+", (x or "").lower()) for x in texts]
    assert got == want
    by_word = {}
    for word, h in zip([w for g in got for w in g], t.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_lower_keeps_length():
    text = "ÀÉÖßÞ×ÑΑΩПЯ Straße"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert _text.lower(raw).tobytes().decode() == "àéößþ×ñαωпя straße"


def test_grams_and_chunks():
    h = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    g = _text.grams(h, 3)
    assert len(g) == 5 and g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 3
    raw, off = _text.buffers(pa.array(["ab", "c" * 50, "", "d"]))
    assert [(a, b) for a, b, _, _ in _text.chunks(raw, off, 10)] == [(0, 1), (1, 2), (2, 4)]
