import numpy as np
import pytest

from lexmill.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, table):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in table], SCHEMA)


def brute(table, least=embed_dedup.COSINE):
    good = [(i, np.array(v, dtype=np.float32)) for i, v in table if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent = {i: i for i, _ in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b):
                u, v = a.astype(float), b.astype(float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least - 1e-6:
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {(i, root(i)) for i in parent if root(i) != i}


def found(df, **kwargs):
    return {(r["vec_id"], r["kept_vec_id"]) for r in embed_dedup.duplicates(df, **kwargs).collect()}


def table_of(seed, groups=80, dim=64):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = r.normal(size=dim)
        for _ in range(r.integers(1, 5)):
            # Cosines of two copies around 0.93 to 1.
            out.append((len(out), (base + r.normal(size=dim) * r.choice([0, 0.1, 0.18])).tolist()))
    return out


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    table = table_of(1)
    want, got = brute(table), found(vectors(spark, table))
    assert len(got & want) >= 0.95 * len(want) and len(want) > 50
    assert not {i for i, _ in got} - {i for i, _ in want}


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(2)
    table = []
    for i in range(300):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = embed_dedup.COSINE + 0.002
        table += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    assert len(found(vectors(spark, table))) >= 0.9 * 300


def test_large_bucket_across_batches(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    table = [(i, (base + r.normal(size=8) * 0.01).tolist()) for i in range(3000)]
    assert found(vectors(spark, table)) == {(i, 0) for i in range(1, 3000)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, None), (2, []), (3, [0, 0, 0]), (4, [nan, 1, 2]), (5, [inf, 1, 2]), (None, [1, 2, 3]), (6, [1, None, 3]), (7, [1, 2, 3]), (8, [2, 4, 6]), (8, [2, 4, 6]), (9, [1, 2]), (10, [-1, -2, -3]), (11, [-0.0, 1, 0]), (12, [0.0, 1, 0])]
    assert found(vectors(spark, table)) == {(8, 7), (12, 11)}
    assert found(vectors(spark, [])) == set()


def test_clashing_columns(spark):
    df = vectors(spark, [(1, [1, 2]), (2, [1, 2])]).selectExpr("*", "1 as id", "2 as h", "3 as unit", "4 as whole", "5 as u")
    assert found(df) == {(2, 1)}
