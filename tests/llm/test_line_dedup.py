import random

from lexmill.llm import line_dedup

from .helpers import docs, rows


def brute(table, w=line_dedup.W):
    """First places of all runs of w lines, then everything later goes."""
    first, out = {}, {}
    for i, text in sorted(table):
        lines = [x for x in text.split("\n") if x]
        drop = set()
        for k in range(len(lines) - w + 1):
            run = tuple(lines[k : k + w])
            if run in first:
                drop |= set(range(k, k + w))
            else:
                first[run] = (i, k)
        kept, k = [], 0
        for x in text.split("\n"):
            if not x or k not in drop:
                kept.append(x)
            k += bool(x)
        out[i] = ("\n".join(kept), len(drop))
    return sorted((i, *x) for i, x in out.items())


def test_against_brute_force(spark):
    r = random.Random(1)
    pool = [f"line {k} é" for k in range(40)]
    table = [(i, "\n".join(r.choice(["", *pool[i % 3 :: 3]]) for _ in range(r.randint(0, 30)))) for i in range(80)]
    for w in (1, 2, 4):
        assert rows(line_dedup.dedup(docs(spark, table), window=w).select("doc_id", "text", "lines_removed")) == sorted(brute(table, w), key=repr)


def test_odd_rows(spark):
    long = "\n".join(f"row {k}" for k in range(30_000))
    table = [(1, "a\nb\nc"), (2, "x\n\na\n\nb\ny"), (3, None), (None, "a\nb"), (4, ""), (5, long), (6, long), (7, "a\nb"), (7, "a\nb"), (8, "b\na"), (9, "\n\n")]
    got = {(r["doc_id"], r["text"]): r["lines_removed"] for r in line_dedup.dedup(docs(spark, table)).collect()}
    assert got[1, "a\nb\nc"] == 0 and got[2, "x\n\n\ny"] == 2 and got[3, None] == 0 and got[None, "a\nb"] == 0 and got[4, ""] == 0
    assert got[5, long] == 0 and got[6, ""] == 30_000 and got[7, ""] == 2 and got[8, ""] == 2 and got[9, "\n\n"] == 0
    assert line_dedup.dedup(docs(spark, table)).count() == len(table) and line_dedup.dedup(docs(spark, [])).count() == 0


def test_repeat_within_a_text(spark):
    assert rows(line_dedup.dedup(docs(spark, [(1, "a\nb\nc\na\nb")])).select("text", "lines_removed")) == [("a\nb\nc", 2)]


def test_clashing_columns(spark):
    df = docs(spark, [(1, "a\nb"), (2, "a\nb")]).selectExpr("*", "1 as id", "2 as h", "3 as LINES_REMOVED", "4 as c0", "named_struct('a', array(1)) as v")
    got = line_dedup.dedup(df)
    assert got.columns == [c for c in df.columns if c != "LINES_REMOVED"] + ["lines_removed"]
    assert rows(got, "doc_id", "text", "lines_removed") == [(1, "a\nb", 0), (2, "", 2)]


def test_hot_line_either_way_of_joining(spark, monkeypatch):
    """A third of all lines are one line; the list of deletions goes to the texts, or both meet."""
    table = [(i, f"only {i}\nthe same\nalso {i}") for i in range(200)]
    want = sorted(brute(table), key=repr)
    assert rows(line_dedup.dedup(docs(spark, table)).select("doc_id", "text", "lines_removed")) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert rows(line_dedup.dedup(docs(spark, table)).select("doc_id", "text", "lines_removed")) == want
    assert sorted(n for *_, n in want) == [0] + [1] * 199
