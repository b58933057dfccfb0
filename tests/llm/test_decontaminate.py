import random

import numpy as np
import pytest

from lexmill.llm import decontaminate

from .helpers import docs, prose, rows, vocabulary
from .test_near_dedup import tokens


def items(spark, table):
    return spark.createDataFrame(table, "item_id long, text string")


def best_overlap(item, doc):
    """The best run at any shift, every pair of words compared."""
    best = None
    for shift in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(lo, hi)]
        for a in range(len(same)):
            n = score = 0
            for b in range(a, len(same)):
                n += same[b]
                score += 1 if same[b] else -4
                if n >= min(decontaminate.LEAST_WORDS, len(item)) and score >= 0:
                    key = (n, n / (b + 1 - a))
                    best = max(best or key, key)
    return best


def found(df, benchmark, **kwargs):
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(df, benchmark, **kwargs).collect()}


def planted(seed):
    """Items within documents, with words replaced: none, or one in seven or more."""
    r, vocab = random.Random(seed), vocabulary(2000, seed)
    bench = [(i, prose(r, vocab, r.randint(14, 40))) for i in range(30)]
    table = []
    for i in range(60):
        body = prose(r, vocab, r.randint(30, 90)).split()
        if i % 2:
            piece = bench[i // 2][1].split()
            step = r.choice([7, 9, 100])
            piece = [r.choice(vocab) if k % step == step - 1 else w for k, w in enumerate(piece)]
            at = r.randrange(len(body))
            body[at:at] = piece
        table.append((i, " ".join(body)))
    return table, bench


@pytest.mark.parametrize("words", [decontaminate.BROADCAST_WORDS, 0])
def test_against_brute_force(spark, words):
    table, bench = planted(3)
    got = found(docs(spark, table), items(spark, bench), broadcast_words=words)
    want = {(i, j) for i, t in table for j, u in bench if best_overlap(tokens(u), tokens(t))}
    assert len(want) >= 28 and set(got) <= want and len(got) >= 0.95 * len(want)
    for r in got.values():
        assert r["n_same"] >= 12 and r["identity"] == r["n_same"] / r["n_words"] >= 0.8


def test_both_ways_agree(spark):
    table, bench = planted(4)
    bench += [(100, "five words are quite enough"), (101, "six words are also just fine"), (102, "too short an item")]
    table += [(100, "here five words are quite enough and six words are also just fine. Too short an item"), (101, None), (102, "")]
    assert rows(decontaminate.overlaps(docs(spark, table), items(spark, bench))) == rows(decontaminate.overlaps(docs(spark, table), items(spark, bench), broadcast_words=0))
    assert {j for i, j in found(docs(spark, table), items(spark, bench)) if i == 100} == {100, 101}


def test_items_of_a_few_words_match_the_same_words_only(spark):
    bench = [(1, "too short an item"), (2, "Yes"), (3, ""), (4, "too short an item")]
    table = [(1, "Too short -- an item!"), (2, "here is too short an item indeed"), (3, "yes"), (4, "yes yes"), (5, None), (6, "")]
    for words in (0, 10**6):
        got = decontaminate.overlaps(docs(spark, table), items(spark, bench), broadcast_words=words)
        assert rows(got, "doc_id", "item_id", "n_words", "n_same", "identity") == [(1, 1, 4, 4, 1.0), (1, 4, 4, 4, 1.0), (3, 2, 1, 1, 1.0)]


def test_substitutions_within_every_window(spark):
    """Every fifth word replaced: 0.8 of the words agree, and no six in a row do."""
    r, vocab = random.Random(8), vocabulary(2000, 8)
    item = prose(r, vocab, 40).split()
    doc = [f"new{k}" if k % 5 == 2 else w for k, w in enumerate(item)]
    got = found(docs(spark, [(1, " ".join(doc))]), items(spark, [(1, " ".join(item))]))
    assert got[1, 1]["n_same"] == 32


def test_clean_documents_stay(spark):
    r, vocab = random.Random(9), vocabulary(60, 9)
    table = [(i, prose(r, vocab, 400)) for i in range(20)]
    bench = [(i, prose(r, vocab, 25)) for i in range(20)]
    want = {(i, j) for i, t in table for j, u in bench if best_overlap(tokens(u), tokens(t))}
    assert set(found(docs(spark, table), items(spark, bench))) == want == set()


def test_odd_rows(spark):
    r, vocab = random.Random(10), vocabulary(2000, 10)
    a = prose(r, vocab, 20)
    long = prose(r, vocab, 120_000) + " " + a
    table = [(1, a), (1, a), (None, a), (2, None), (3, ""), (4, long), (5, a.upper().replace(" ", ", "))]
    bench = [(1, a), (1, a), (None, a), (2, None), (3, ""), (4, a)]
    got = found(docs(spark, table), items(spark, bench))
    assert set(got) == {(d, i) for d in (1, 4, 5) for i in (1, 4)}
    assert got[4, 1]["doc_word"] == 120_000
    assert found(docs(spark, []), items(spark, bench)) == {} == found(docs(spark, table), items(spark, []))


def test_clashing_columns(spark):
    df = docs(spark, [(1, prose(random.Random(1), vocabulary(99), 20))]).selectExpr("*", "1 as id", "2 as k", "3 as item_id", "4 as h")
    bench = df.selectExpr("doc_id as item_id", "text", "9 as doc_id", "1 as id")
    assert rows(decontaminate.overlaps(df.drop("item_id"), bench), "doc_id", "item_id") == [(1, 1)]


def test_longest_run_of_a_shift_counts():
    """Not only the run of the best score: every run of one shift, compared with all pairs of ends."""
    r = random.Random(12)
    texts = [(23, range(10, 13)), (40, range(2, 40, 5)), (16, (5, 10)), (20, (4, 9, 14))]
    texts += [(n, r.sample(range(n), r.randint(0, n // 3))) for n in (r.randint(5, 40) for _ in range(300))]
    some = 0
    for n, replaced in texts:
        item, doc = np.arange(n), np.concatenate([[900, 901], np.arange(n), [902]])
        doc[2 + np.array(list(replaced), dtype=int)] = 999
        same, best = item == doc[2 : n + 2], None
        for a in range(n):
            for b in range(a + 1, n + 1):
                agreeing = int(same[a:b].sum())
                if agreeing >= min(decontaminate.LEAST_WORDS, n) and 5 * agreeing >= 4 * (b - a):
                    best = max(best or (0, 0, 0), (agreeing, a - b, -a))
        assert decontaminate.overlap(item, doc, 2) == (best and (-best[2], -best[1], best[0]))
        some += best is not None
    assert some > 100 and decontaminate.overlap(np.arange(23), np.where(np.arange(23) // 3 == 4, 99, np.arange(23)), 0) is not None
