import hashlib
from math import floor

from lexmill.llm import mixing

from .helpers import docs, rows


def brute(table, weights, default=1.0, budget=None):
    tokens = {}
    for _, text, _, source, _ in table:
        n = len([w for w in (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w])
        tokens[source] = tokens.get(source, 0) + n
    w = {s: weights.get(s, default) for s, n in tokens.items() if n}
    goal = sum(tokens.values()) if budget is None else budget
    out = []
    for row in table:
        s = row[3]
        rate = goal * w[s] / sum(w.values()) / tokens[s] if tokens[s] else 1.0
        key = str(row[0]) if row[0] is not None else row[1] or ""
        draw = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:8], 16) / 2**32
        n = floor(rate) + (draw < rate - floor(rate))
        out += [(*row, k + 1) for k in range(n)]
    return sorted(out, key=repr)


TABLE = [(i, "w " * (1 + i % 7) + "\nend\tx", "en", f"src{i % 5}", i) for i in range(200)] + [(500, "a b", "en", None, 3), (501, "", "en", "void", 0), (502, None, None, "void", None), (None, "no id", "en", "src1", 5), (3, "twice", "en", "src3", 1), (3, "twice", "en", "src3", 1)]


def test_against_brute_force(spark):
    assert rows(mixing.mix(docs(spark, TABLE), copy_col="copy")) == brute(TABLE, mixing.WEIGHTS)
    got = rows(mixing.mix(docs(spark, TABLE), {"src0": 9.0, "src4": 0.0}, 0.5, 5000, copy_col="copy"))
    assert got == brute(TABLE, {"src0": 9.0, "src4": 0.0}, 0.5, 5000)


def test_join_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rows(mixing.mix(docs(spark, TABLE), copy_col="copy")) == brute(TABLE, mixing.WEIGHTS)


def test_shares_meet_the_weights(spark):
    table = [(i, "w " * 20, "en", "src0" if i % 10 else "src1", 1) for i in range(3000)]
    got = mixing.mix(docs(spark, table), {"src0": 1.0, "src1": 3.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["src1"] / sum(n.values()) - 0.75) < 0.03 and abs(sum(n.values()) - 3000) < 120


def test_columns_and_empty(spark):
    df = docs(spark, TABLE).selectExpr("*", "1 as rate", "2 as tokens", "3 as mix_source", "4 as COPY")
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix(df, copy_col="copy").columns == [*df.columns[:-1], "copy"]
    assert mixing.mix(docs(spark, [])).count() == 0
