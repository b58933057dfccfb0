import random

from lexmill.llm import sharding

from .helpers import docs


def brute(sizes, capacity):
    """Best fit decreasing, one group at a time, over a plain list of bins."""
    rooms, out = [], {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        fits = [(room, b) for b, room in enumerate(rooms) if room is not None and room >= size] if size <= capacity else []
        if fits:
            _, b = min(fits)
            rooms[b] -= size
        else:
            b = len(rooms)
            rooms.append(capacity - size if size <= capacity else None)
        out[key] = b
    return out


def packed(sizes, capacity):
    counts = {}
    for size, _ in sizes:
        counts[size] = counts.get(size, 0) + 1
    runs = list(sharding.pack(sorted(counts.items(), reverse=True), capacity))
    out, seen = {}, {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        seen[size] = seen.get(size, 0) + 1
        out[key] = max((rank, b) for s, rank, b in runs if s == size and rank <= seen[size])[1]
    return out


def test_pack_is_best_fit_decreasing():
    r = random.Random(1)
    for capacity in (1, 7, 64, 65, 100, 5000):
        for _ in range(20):
            sizes = [(r.randint(0, capacity + capacity // 5 + 1), k) for k in range(r.randint(1, 120))]
            assert packed(sizes, capacity) == brute(sizes, capacity)


def test_shards(spark):
    r = random.Random(2)
    table = [(i % 70, "x" * r.randint(0, 60)) for i in range(150)] + [(None, "abc"), (None, "é"), (200, None), (201, "y" * 5000)]
    got = sharding.shards(docs(spark, table), 100).collect()
    assert len(got) == len(table)
    size, at = {}, {}
    for x in got:
        key = "null" if x["doc_id"] is None else f"={x['doc_id']}"
        size[key] = size.get(key, 0) + len((x["text"] or "").encode())
        at.setdefault(key, set()).add(x["shard"])
    assert all(len(s) == 1 for s in at.values())
    assert {k: next(iter(s)) for k, s in at.items()} == brute([(n, k) for k, n in size.items()], 100)


def test_ties_have_one_order(spark):
    table = [(i, "same size") for i in range(40)]
    a, b = (sorted((x["doc_id"], x["shard"]) for x in sharding.shards(docs(spark, t).repartition(n), 30).collect()) for t, n in ((table, 1), (table[::-1], 6)))
    assert a == b and max(s for _, s in a) == 13


def test_frequent_size_is_ranked_in_parts(spark):
    """As many bins, as full, as without parts; every group in one of them, and the same in every run."""
    r = random.Random(3)
    sizes = [(7, k) for k in range(300)] + [(r.randint(0, 40), k) for k in range(300, 360)]
    groups = spark.createDataFrame([(f"{k:04}", n) for n, k in sizes], "key string, size long")
    want = brute([(n, f"{k:04}") for n, k in sizes], 100)
    once, again = ({x["key"]: x["shard"] for x in sharding.assign(g, 100, ranked=20).collect()} for g in (groups, groups.repartition(5)))
    assert once == again and set(once) == set(want)
    size = {f"{k:04}": n for n, k in sizes}
    fill = lambda at: sorted((s, sorted(size[k] for k in at if at[k] == s)) for s in set(at.values()))
    assert fill(once) == fill(want)


def test_empty_and_clashing_columns(spark):
    assert sharding.shards(docs(spark, [])).count() == 0
    df = docs(spark, [(1, "a"), (2, "b")]).selectExpr("*", "1 as key", "2 as size", "3 as SHARD", "4 as rank")
    got = sharding.shards(df)
    assert got.columns == [*docs(spark, []).columns, "key", "size", "rank", "shard"] and {r["shard"] for r in got.collect()} == {0}
