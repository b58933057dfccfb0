import random

from lexmill.llm import url_filter

from .helpers import rows


def pages(spark, table):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(table)], "page_id long, url string, html string")


def brute(links, hosts, trusted, blocked, damping=url_filter.DAMPING, least=url_filter.TOLERANCE):
    """links: (src, dst) with repeats, none within a host. What each round adds, until it is less than least to all."""
    ways = [{}, {}]
    for a, b in links:
        ways[0].setdefault(a, []).append(b)
        ways[1].setdefault(b, []).append(a)
    added = [{h: float(h in seeds) for h in hosts} for seeds in (trusted, blocked)]
    total = [dict(x) for x in added]
    while True:
        new = [dict.fromkeys(hosts, 0.0) for _ in ways]
        for way, old, to in zip(ways, added, new):
            for a, others in way.items():
                for b in others:
                    to[b] += damping * old[a] / len(others)
        if max(x for to in new for x in to.values()) < least:
            return total
        for whole, to in zip(total, new):
            for h in hosts:
                whole[h] += to[h]
        added = new


def test_against_brute_force(spark):
    r = random.Random(1)
    names = [f"h{i}.net" for i in range(30)] + ["example.org", "www.example.org", "casino-win.com", "x.spam-farm.io"]
    table, links = [], []
    for _ in range(120):
        src = r.choice(names)
        to = [r.choice(names) for _ in range(r.randint(0, 5))]
        links += [(src, d) for d in to if d != src]
        table.append((f"https://{src.upper()}:8080/a?b=http://no.where/", "".join(f"<a href='//{d}/x'>y</a><A HREF = \"http://{d}\">" for d in to)))
        links += [(src, d) for d in to if d != src]
    hosts = {url.split("//")[1].split(":")[0].lower() for url, _ in table} | {d for _, d in links}
    trust, distrust = brute(links, hosts, {"example.org", "www.example.org"}, {"casino-win.com", "x.spam-farm.io"})
    got = {x["host"]: x for x in url_filter.host_scores(pages(spark, table)).collect()}
    assert set(got) == hosts
    for h in hosts:
        assert abs(got[h]["trust"] - trust[h]) < 2e-6 and abs(got[h]["distrust"] - distrust[h]) < 2e-6
        bad = h in ("casino-win.com", "x.spam-farm.io") or (distrust[h] >= url_filter.LEAST and distrust[h] > trust[h])
        assert got[h]["verdict"] == ("block" if bad else "trust" if trust[h] >= url_filter.LEAST else "neutral")


def test_odd_rows(spark):
    table = [(None, "<a href='http://a.com'>"), ("", None), ("not a url", "x"), ("https://b.com/", None), ("https://b.com/", ""), ("https://b.com/", ""), ("http://user:pw@C.com:99/x#y", "<a href='/local'><a href='http://casino-win.com/'>"), ("ftp://example.org", "<a href='mailto:x@y.z'>")]
    got = [(r["host"], r["verdict"]) for r in sorted(url_filter.filtered(pages(spark, table)).collect(), key=lambda r: r["page_id"])]
    assert got == [(None, "block"), (None, "block"), (None, "block"), ("b.com", "neutral"), ("b.com", "neutral"), ("b.com", "neutral"), ("c.com", "block"), ("example.org", "trust")]
    assert url_filter.filtered(pages(spark, [])).count() == 0


def test_clashing_columns(spark):
    df = pages(spark, [("https://b.com/", "")]).selectExpr("*", "1 as host", "2 as TRUST", "3 as kind", "4 as src")
    got = url_filter.filtered(df)
    assert got.columns == ["page_id", "url", "html", "kind", "src", "host", "trust", "distrust", "verdict"]
    assert rows(got, "host", "kind") == [("b.com", 3)]


def test_long_chain(spark):
    """Distrust reaches back along a chain as far as its damping lets it count."""
    table = [(f"http://h{i}.net/", f"<a href='http://h{i + 1}.net'>" if i < 40 else "<a href='http://casino-win.com'>") for i in range(41)]
    got = {x["host"]: x for x in url_filter.host_scores(pages(spark, table)).collect()}
    for i in range(41):
        assert abs(got[f"h{i}.net"]["distrust"] - 0.85 ** (41 - i)) < 2e-6
        assert got[f"h{i}.net"]["verdict"] == ("block" if 0.85 ** (41 - i) >= url_filter.LEAST else "neutral")
