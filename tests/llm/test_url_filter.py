import duckdb
import pytest

from tessera.llm import url_filter
from tests.llm.helpers import table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.b", "", "block"), ("a.b", "", "allow"), (None, "/x", "block"), ("A.B.C", "/é", "allow")]
URLS = [None, "", "no scheme", "://", "http://", "https://X.Example.COM/en/712?q#f", "http://example.com/en/8", "http://com", "http://com/en/", "ftp://notcom/en/", "http://a.b?x", "http://q.a.b/y", "http://a.b.c/é/1", "http://user@h:80#x", "x://y://z/en/", "http://" + "a." * 3000 + "com/en/" + "p" * 5000, "http://com/en\n/"]


def judged(spark, urls, rules=RULES, extra=False):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string").repartition(3)
    r = spark.createDataFrame(rules, "host string, path string, action string")
    return {x.page_id: tuple(x)[1:] for x in url_filter.judge(pages, r).collect()}


def test_rules(spark):
    got = judged(spark, URLS)
    assert len(got) == len(URLS)
    assert got[0] == got[1] == got[2] == got[4] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[5] == ("x.example.com", "/en/712", "example.com/en/7", "allow")
    assert got[6][2:] == ("com/en/", "block") and got[7] == ("com", "", None, "allow") and got[8][3] == "block"
    assert got[9][2] is None
    assert got[10] == ("a.b", "", "a.b", "block") and got[11][3] == "block"
    assert got[12][2:] == ("a.b.c/é", "allow")
    assert got[13][:2] == ("user@h:80", "") and got[14][:2] == ("y:", "//z/en/")
    assert got[15][3] == "block"


def test_many_shapes(spark, monkeypatch):
    rules = [*RULES, *((f"{'z.' * n}com", "/" * m, "block") for n in range(9) for m in range(9))]
    few = judged(spark, URLS, rules)
    assert len({(h.count("."), len(p)) for h, p, _ in rules if h}) > url_filter.LITERAL_SHAPES
    monkeypatch.setattr(url_filter, "LITERAL_SHAPES", 1000)
    assert few == judged(spark, URLS, rules) and few[5][2:] == ("example.com/en/7", "allow")


def test_no_rules_and_no_pages(spark):
    assert judged(spark, URLS[5:7], [])[0][2:] == (None, "allow")
    assert judged(spark, []) == {}


def test_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "http://com/en/")] * 3 + [(None, "http://com/en/")] * 2, "page_id bigint, url string")
    r = spark.createDataFrame(RULES, "host string, path string, action string")
    rows = url_filter.judge(pages, r).collect()
    assert len(rows) == 5 and all(x.verdict == "block" for x in rows)


@pytest.mark.parametrize("n", [1])
def test_query_matches_sql(spark, tmp_path, n):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate([*URLS, "http://q.example.net/de/8", "http://net/de/8", "http://w.org/es/"])], "page_id bigint, url string, html string")
    d = table(tmp_path, "pages", pages)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    assert sorted(map(str, con.sql(url_filter.ORACLE).fetchall())) == sorted(str(tuple(r)) for r in url_filter.op10_url_filters(spark, d).collect())
