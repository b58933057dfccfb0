import random

from lexmill.llm import substring_dedup
from lexmill.llm.substring_dedup import LEAST

from .helpers import docs, prose, rows, vocabulary


def brute(table):
    """Every run of LEAST words of every document, looked up among those of all others."""
    where = {}
    known = [(i, t.lower().split()) for i, t in table if i is not None and t is not None]
    for i, w in known:
        for k in range(len(w) - LEAST + 1):
            where.setdefault(tuple(w[k : k + LEAST]), set()).add(i)
    out = set()
    for i, w in known:
        run = None
        for k in range(len(w) - LEAST + 2):
            owners = where.get(tuple(w[k : k + LEAST]), set()) if k <= len(w) - LEAST else set()
            if owners - {i}:
                late = any(o < i for o in owners)
                run = (run[0], k, run[2] or late) if run else (k, k, late)
            elif run:
                out.add((i, run[0], run[1] - run[0] + LEAST, run[2]))
                run = None
    return out


def found(df):
    got = substring_dedup.repeats(df).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


def planted(seed):
    r, vocab = random.Random(seed), vocabulary(500, seed)
    passages = [prose(r, vocab, n) for n in (LEAST - 1, LEAST, LEAST + 1, 60, 90, 200)]
    table = []
    for i in range(50):
        parts = [prose(r, vocab, r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages).split()
            a = r.choice([0, 0, 10])
            parts += [" ".join(p[a:]), prose(r, vocab, r.randint(1, 40))]
        table.append((i, "\n".join(parts)))
    return table


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        table = planted(seed)
        want = brute(table)
        assert found(docs(spark, table)) == want and len(want) > 20


def test_lowest_length(spark):
    r, vocab = random.Random(7), vocabulary(5000, 7)
    for n, hits in ((LEAST - 1, 0), (LEAST, 2)):
        p = prose(r, vocab, n)
        table = [(1, prose(r, vocab, 30) + " " + p + " " + prose(r, vocab, 9)), (2, p)]
        assert len(found(docs(spark, table))) == hits


def test_periodic_texts(spark):
    """Equal k-grams everywhere: ties among the least hashes."""
    table = [(1, "a " * 400), (2, "a " * 70 + "b " * 70), (3, "a b " * 120), (4, "b a " * 30)]
    assert found(docs(spark, table)) == brute(table)


def test_odd_rows(spark):
    r, vocab = random.Random(9), vocabulary(3000, 9)
    p, long = prose(r, vocab, 80), prose(r, vocab, 60_000)
    table = [(1, None), (2, ""), (3, "short text"), (None, p), (4, p), (5, long + " " + p), (6, p.upper()), (6, p.upper()), (7, prose(r, vocab, 30) + " " + long)]
    assert found(docs(spark, table)) == brute([*table[:6], table[6], table[8]])
    assert found(docs(spark, [])) == set()


def test_repeats_within_one_document_alone_do_not_count(spark):
    p = prose(random.Random(1), vocabulary(900), 70)
    assert found(docs(spark, [(1, f"{p} and {p}"), (2, "else")])) == set()


def test_clashing_columns(spark):
    p = prose(random.Random(1), vocabulary(900), 70)
    df = docs(spark, [(1, p), (2, p)]).selectExpr("*", "1 as id", "2 as h", "3 as start", "4 as windows", "5 as hs")
    assert rows(substring_dedup.repeats(df)) == [(1, 0, 70, False), (2, 0, 70, True)]
