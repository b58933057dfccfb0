"""URL filters by propagation of trust and distrust over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, without

#: Domains whose hosts are trusted to begin with, themselves and those below them.
TRUSTED = ("example.org",)
#: Labels that block a host, wherever they stand in its name.
BLOCKED = ("cheap-pills", "casino-win", "spam-farm", "ads-track", "free-bets", "adult-x")
DAMPING = 0.85
#: Least part of a seed's own score at which a host counts as trusted or distrusted.
LEAST = 0.01
#: Scores are added up until a round adds less than this to every host.
TOLERANCE = 1e-6
HOST = "^[ \\t\\r\\n]*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@ \\t\\r\\n]+)"
LINK = "(?i)href[ \\t\\r\\n]*=[ \\t\\r\\n]*[\"']?[ \\t\\r\\n]*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\"'> \\t\\r\\n]*@)?([^/?#:@\"'<> \\t\\r\\n]+)"


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def is_trusted(host: Column, domains: Sequence[str]) -> Column:
    found = F.lit(False)
    for d in domains:
        found = found | (host == d) | host.endswith("." + d)
    return found


def is_blocked(host: Column, labels: Sequence[str]) -> Column:
    return F.exists(F.split(host, "\\."), lambda x: x.isin(list(labels))) if labels else F.lit(False)


def host_scores(pages: DataFrame, trusted: Sequence[str] = TRUSTED, blocked: Sequence[str] = BLOCKED, *, url_col: str = "url", html_col: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, least: float = LEAST) -> DataFrame:
    """(host, trust, distrust, verdict) for each host of a page or a link.

    Trust is personalised PageRank: it starts at the trusted seeds and flows along
    links, in proportion to their number. Distrust starts at the blocked seeds and
    flows against links, to those who link there. Both are in parts of one seed's
    start, after rounds rounds. Links within a host don't count; what reaches a host
    without links is lost.

    verdict: block for blocked hosts and those whose distrust is at least least and
    above their trust; trust from least on; else neutral. A host that is a trusted
    and a blocked seed is a blocked one.
    """
    page = pages.select(host_of(F.col(url_col)).alias("src"), F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)).alias("links"))
    raw = page.filter("src is not null").select("src", F.explode_outer("links").alias("dst")).select("src", F.lower("dst").alias("dst"))
    edges = cut(raw.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")))
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst").filter("dst is not null")).distinct()
    blocks = is_blocked(F.col("host"), blocked)
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("T").alias("kind"), (is_trusted(F.col("host"), trusted) & ~blocks).alias("on")), F.struct(F.lit("D").alias("kind"), blocks.alias("on")))).alias("s")).select("host", "s.kind", F.when(F.col("s.on"), 1.0).otherwise(0.0).alias("t"))
    seeds = cut(seeds)
    links = edges.filter("dst is not null and dst <> src")
    out = links.groupBy("src").agg(F.sum("n").alias("all")).select(F.col("src").alias("host"), F.lit("T").alias("kind"), "all")
    into = links.groupBy("dst").agg(F.sum("n").alias("all")).select(F.col("dst").alias("host"), F.lit("D").alias("kind"), "all")
    flows = links.select(F.col("src").alias("host"), F.lit("T").alias("kind"), F.col("dst").alias("to"), "n").union(links.select(F.col("dst").alias("host"), F.lit("D").alias("kind"), F.col("src").alias("to"), "n"))
    flows = cut(flows.join(out.union(into), ["host", "kind"]).select("host", "kind", "to", (F.col("n") / F.col("all")).alias("p")))
    # r: the score so far; d: what the last round added.
    state = seeds.select("host", "kind", F.col("t").alias("r"), F.col("t").alias("d"))
    top = 0.0 if flows.isEmpty() else 1.0
    while top:
        moved = state.filter("d > 0").join(flows, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (damping * F.col("d") * F.col("p")).alias("d"))
        added = moved.select("host", "kind", F.col("d").alias("r"), "d").union(state.select("host", "kind", "r", F.lit(0.0)))
        after = cut(added.groupBy("host", "kind").agg(F.sum("r").alias("r"), F.sum("d").alias("d")))
        top = after.agg(F.max("d")).first()[0]
        if top < tolerance:
            break
        state = after
    wide = state.groupBy("host").agg(F.sum(F.when(F.col("kind") == "T", F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "D", F.col("r")).otherwise(0.0)).alias("distrust"))
    verdict = F.when(blocks | ((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))), "block").when(F.col("trust") >= least, "trust").otherwise("neutral")
    return wide.select("host", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"), verdict.alias("verdict"))


def filtered(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", **kwargs) -> DataFrame:
    """pages, with the host and the scores and verdict of the host; columns with these names are replaced.

    Pages whose URL has no host, or null, have a null host and verdict block. Null
    and empty html has no links; html of any length is read to the end. Each
    repeated row counts its links again. A host with equal trust and distrust isn't
    blocked for that. No pages give no rows.
    """
    scores = host_scores(pages, url_col=url_col, html_col=html_col, **kwargs).withColumnRenamed("host", "__host")
    kept = without(pages, "host", "trust", "distrust", "verdict")
    joined = pages.select(*kept).withColumn("__page_host", host_of(F.col(url_col))).join(scores, F.col("__page_host") == F.col("__host"), "left")
    names = [c for c in pages.columns if c.lower() not in {"host", "trust", "distrust", "verdict"}]
    return joined.select(*(F.col(f"`{c}`") for c in names), F.col("__page_host").alias("host"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.coalesce("verdict", F.lit("block")).alias("verdict"))


def sql(trusted: Sequence[str] = TRUSTED, blocked: Sequence[str] = BLOCKED) -> str:
    """The query over pages in SQL."""

    def q(s: str) -> str:
        return "'" + s.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n").replace("'", "''") + "'"

    block = f"list_has_any(string_split(host, '.'), [{', '.join(map(q, blocked))}])"
    trust = "(" + " OR ".join(f"host = {q(d)} OR ends_with(host, {q('.' + d)})" for d in trusted) + f") AND NOT {block}"
    return f"""
WITH RECURSIVE page AS MATERIALIZED (SELECT *, nullif(lower(regexp_extract(url, {q(HOST)}, 1)), '') AS h FROM pages)
, raw AS (SELECT h AS src, lower(unnest(regexp_extract_all(html, {q(LINK)}, 1))) AS dst FROM page WHERE h IS NOT NULL)
, edges AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS n FROM raw WHERE src <> dst GROUP BY 1, 2)
, hosts AS (SELECT h AS host FROM page WHERE h IS NOT NULL UNION SELECT dst FROM raw)
, flows AS MATERIALIZED (SELECT src AS host, 'T' AS kind, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM edges
  UNION ALL SELECT dst, 'D', src, n / sum(n) OVER (PARTITION BY dst) FROM edges)
, s0 AS (SELECT host, 'T' AS kind, CASE WHEN {trust} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM hosts
  UNION ALL SELECT host, 'D', CASE WHEN {block} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM hosts)
, d AS (SELECT 0 AS k, host, kind, r FROM s0 WHERE r > 0
  UNION ALL SELECT k, host, kind, r FROM (SELECT *, max(r) OVER () AS top FROM (
    SELECT d.k + 1 AS k, f.dst AS host, f.kind, sum({DAMPING}::DOUBLE * d.r * f.p) AS r FROM d JOIN flows f ON d.host = f.host AND d.kind = f.kind GROUP BY 1, 2, 3)) WHERE top >= {TOLERANCE})
, wide AS (SELECT host, sum(CASE WHEN kind = 'T' THEN r ELSE 0 END) AS trust, sum(CASE WHEN kind = 'D' THEN r ELSE 0 END) AS distrust FROM d GROUP BY 1)
SELECT page_id, url, h AS host, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust,
  CASE WHEN h IS NULL OR {block} OR (distrust >= {LEAST} AND distrust > trust) THEN 'block' WHEN trust >= {LEAST} THEN 'trust' ELSE 'neutral' END AS verdict
FROM page LEFT JOIN wide ON page.h = wide.host
"""
