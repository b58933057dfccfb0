import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.llm import queries

from .helpers import docs


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def canon(names, found):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, tmp_path, name):
    """On a table with nulls, repeats and odd texts; the driver compares the large ones."""
    table = [(i, f"l{i % 7}\nl{i % 5}\n\nshared a\nshared b\nl{i % 3}", "en", f"src{i % 6}", i) for i in range(60)] + [(70, "", "en", "src1", 0), (71, "a\nb\n", "en", "void", 3)]
    docs(spark, table).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    html = "<a href='https://example.org/'>x</a><a href='//casino-win.net/a'>y</a>"
    pages = [(i, f"https://h{i % 9}.net/{i}", html * (i % 3) + f"<a href='http://h{i % 4}.net'>") for i in range(40)] + [(50, "nothing", "x"), (51, "http://www.example.org", "<a href='http://h1.net'>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(queries.ORACLE[name])
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon([d[0] for d in want.description], want.fetchall())
