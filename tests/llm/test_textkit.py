import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import textkit
from lexmill.llm.winnowing import anchors


def split(text, kind):
    word = rb"[0-9A-Za-z\x80-\xff]+" if kind is textkit.ALNUM else rb"[\x21-\xff]+"
    return re.findall(word, text.encode())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.sampled_from(["ALNUM", "BLANK"]))
def test_words(texts, name):
    kind = getattr(textkit, name)
    column = pa.array(texts, pa.string())
    i = 0
    seen = {}
    for w in textkit.words(column, kind, fold=False):
        assert w.first == i
        for k in range(len(w.ptr) - 1):
            raw = (texts[i] or "").encode()
            a, b = w.ptr[k], w.ptr[k + 1]
            got = [raw[s:e] for s, e in zip(w.start[a:b], w.end[a:b])]
            assert got == split(texts[i] or "", kind)
            for x, h in zip(got, w.hash[a:b]):
                assert seen.setdefault(x, h) == h
            i += 1
    assert i == len(texts) and len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_slices_and_offsets(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("ab c\n") for _ in range(r.randint(0, 60))) for _ in range(50)] + ["x" * 400_000 + " yy"]
    whole = np.concatenate([w.hash for w in textkit.words(pa.array(texts))])
    monkeypatch.setattr(textkit, "slices", lambda o: ((i, i + 1) for i in range(len(o) - 1)))
    assert np.array_equal(whole, np.concatenate([w.hash for w in textkit.words(pa.array(["skip", *texts]).slice(1))]))


def test_grams_and_minima():
    r = np.random.default_rng(2)
    h = r.integers(0, 6, 200).astype(np.uint64)
    for k in (1, 2, 3, 7, 25):
        g = textkit.grams(h, k)
        same = {}
        for i in range(len(g)):
            assert same.setdefault(tuple(h[i : i + k]), g[i]) == g[i]
        assert len(set(same.values())) == len(same)
    for w in (1, 2, 5, 26):
        got = textkit.window_argmin(h, w)
        assert got.tolist() == [max(range(i, i + w), key=lambda p: (-int(h[p]), p)) for i in range(len(h) - w + 1)]


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(3)
    h = r.integers(0, 9, 300).astype(np.uint64)
    ptr = np.array([0, 100, 100, 103, 300])
    a = anchors(h, ptr, 3, 4)
    seen, count = {}, 0
    for i in range(len(a.row)):
        for p in range(a.begin[i], a.begin[i + 1]):
            first = ptr[a.row[i]] + a.start[p]
            key = tuple(h[first : first + 6])
            assert seen.setdefault(key, (a.hash[i], a.window[p])) == (a.hash[i], a.window[p])
            count += 1
    assert count == (100 - 5) + (197 - 5)
