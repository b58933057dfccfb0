import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import near_dedup
from lexmill.llm.textkit import words

from .helpers import docs, edited, prose, rows, vocabulary


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def tokens(text):
    out = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text.lower())
    return out.split()


def brute(table, least=near_dedup.SIMILARITY):
    known = [(i, tokens(t)) for i, t in table if i is not None and t is not None and tokens(t)]
    parent = {i: i for i, _ in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for (i, a), (j, b) in combinations(known, 2):
        if 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) and 2 * lcs(a, b) >= least * (len(a) + len(b)):
            pairs.add((min(i, j), max(i, j)))
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {(i, root(i)) for i in parent if root(i) != i}, pairs


def found(df):
    return {(r["doc_id"], r["kept_doc_id"]) for r in near_dedup.duplicates(df).collect()}


def corpus(seed, n=60):
    r, vocab = random.Random(seed), vocabulary(400, seed)
    table = []
    for i in range(n):
        base = prose(r, vocab, r.randint(20, 120))
        table.append((len(table), base))
        for _ in range(r.choice([0, 0, 1, 2])):
            table.append((len(table), edited(r, base, vocab, r.randint(0, max(1, len(base.split()) // 12)))))
    return table


def test_against_brute_force(spark):
    table = corpus(1)
    got, (want, _) = found(docs(spark, table)), brute(table)
    assert len(got & want) >= 0.95 * len(want)
    assert not {i for i, _ in got} - {i for i, _ in want}


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs with one word in six or seven replaced, evenly spread: the hardest that still count."""
    r, vocab = random.Random(5), vocabulary(3000, 5)
    table = []
    for i in range(150):
        base = prose(r, vocab, 100).split()
        other = [r.choice(vocab) if k % 6 == i % 6 else w for k, w in enumerate(base)]
        table += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = brute(table)[0]
    assert len(want) == 150 and len(found(docs(spark, table)) & want) >= 0.9 * len(want)


def test_bucket_of_two_groups_keeps_both(spark):
    """Many copies of two texts with a common half: none of one group hides the other."""
    r, vocab = random.Random(2), vocabulary(900, 2)
    half = prose(r, vocab, 40)
    a, b = half + " " + prose(r, vocab, 40), half + " " + prose(r, vocab, 40)
    table = [(i, edited(r, a if i % 2 else b, vocab, 2)) for i in range(80)]
    got = found(docs(spark, table))
    assert got == brute(table)[0]
    assert {k for _, k in got} == {0, 1}


def test_word_order_counts(spark):
    r, vocab = random.Random(3), vocabulary(500, 3)
    x, y = prose(r, vocab, 50), prose(r, vocab, 50)
    table = [(1, f"{x} {y}"), (2, f"{y} {x}")]
    assert found(docs(spark, table)) == brute(table)[0] == set()


def test_odd_rows(spark):
    long = prose(random.Random(4), vocabulary(2000, 4), 60_000)
    table = [(1, None), (2, ""), (3, "  ...  "), (None, "some words that are here"), (4, "one"), (5, "One!"), (6, "two"), (7, long), (8, long + " end"), (9, "x y"), (10, "X, y"), (10, "X, y"), (11, "unlike anything else in here")]
    assert found(docs(spark, table)) == {(5, 4), (8, 7), (10, 9)}
    assert found(docs(spark, [])) == set()


def test_same_id_with_two_texts_joins_both(spark):
    assert found(docs(spark, [(1, "alpha beta gamma"), (2, "delta epsilon zeta"), (3, "alpha beta gamma"), (3, "delta epsilon zeta")])) == {(2, 1), (3, 1)}


def test_clashing_columns(spark):
    df = docs(spark, [(1, "a b c d e"), (2, "a b c d e")]).selectExpr("*", "1 as id", "2 as h", "3 as n", "4 as hub", "5 as sketches", "6 as tokens", "7 as kept_doc_id")
    assert rows(near_dedup.duplicates(df)) == [(2, 1)]


def test_common_in_order():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 25))] for _ in range(2))
        assert near_dedup.common_in_order(near_dedup.masks(a), len(a), b, 60) == lcs(a, b)
        both = len(a) + len(b)
        for least in (0.5, 0.8):
            assert near_dedup.similar(near_dedup.masks(a), len(a), b, least) == (2 * lcs(a, b) >= least * both)


def test_sketches_are_of_least_kmers_in_text_order():
    def one(text):
        w = next(words(pa.array([text])))
        return near_dedup.sketch(w.hash, w.ptr)[0]

    a, b = one("a b c d e f"), one("a b c d e f")
    assert (a == b).all()
    # The same k-mers in other places in the text: blocks swapped.
    x, y = one("p q r s t u v w"), one("t u v w p q r s")
    assert (x == y).mean() < 0.5
    # A repeat is another labelled k-mer.
    assert not (one("k l m k l m k l m") == one("k l m k l m")).all()


def test_sketch_does_not_depend_on_neighbours():
    texts = ["one two three four five", "", "six seven", "eight nine ten eleven twelve thirteen"]
    w = next(words(pa.array(texts)))
    together = near_dedup.sketch(w.hash, w.ptr)
    for i, t in enumerate(texts):
        v = next(words(pa.array([t])))
        assert (near_dedup.sketch(v.hash, v.ptr)[0] == together[i]).all() or not t
    assert SequenceMatcher and np.unique(together[[0, 2, 3], 0]).size == 3


def candidates(texts):
    """The sketches and parts of each text, as what two of them can agree in."""
    got = next(near_dedup._sketch_rows(near_dedup.SIMILARITY)(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])])))
    return [set(x) for x in got.column(3).to_pylist()]


def changed(r, base, vocab, kind, changes):
    """base with words at random places replaced, inserted or deleted."""
    if kind == "insert":
        at = set(r.sample(range(len(base) + changes), changes))
        left = iter(base)
        return [r.choice(vocab) if k in at else next(left) for k in range(len(base) + changes)]
    at = set(r.sample(range(len(base)), changes))
    return [r.choice(vocab) if k in at else w for k, w in enumerate(base) if k not in at or kind == "replace"]


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
@pytest.mark.parametrize("n", [5, 7, 10, 11, 15, 30, 100, 200])
def test_candidates_at_the_least_similarity(kind, n):
    r, vocab = random.Random(n), vocabulary(3000, n)
    most = {"replace": n // 5, "insert": n // 2, "delete": n // 3}[kind]
    caught = 0
    for _ in range(8):
        texts = []
        for _ in range(50):
            base = prose(r, vocab, n).split()
            texts += [" ".join(base), " ".join(changed(r, base, vocab, kind, most))]
        some = candidates(texts)
        caught += sum(not a.isdisjoint(b) for a, b in zip(some[::2], some[1::2]))
    assert caught >= (400 if kind == "replace" and n <= near_dedup.SHORT else 0.9 * 400)


def test_short_texts(spark):
    """Every two similar texts of few words."""
    r, vocab = random.Random(7), vocabulary(4000, 7)
    table = []
    for i in range(120):
        base = prose(r, vocab, 2 + i % 9).split()
        kind = r.choice(["replace", "insert", "delete"])
        most = {"replace": len(base) // 5, "insert": len(base) // 2, "delete": len(base) // 3}[kind]
        other = changed(r, base, vocab, kind, most)
        if len(other) <= near_dedup.SHORT:
            table += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    assert found(docs(spark, table)) == brute(table)[0]


def test_bits_apart_are_words_apart():
    r, vocab = random.Random(8), vocabulary(300, 8)
    for n in (3, 40, 900):
        a = prose(r, vocab, n)
        b = edited(r, a, vocab, n // 3)
        x, y = near_dedup.bit_sets(next(words(pa.array([a, b])))).view(np.uint64)
        apart = sum((int(p) ^ int(q)).bit_count() for p, q in zip(x, y))
        assert apart <= len(tokens(a)) + len(tokens(b)) - 2 * lcs(tokens(a), tokens(b))
