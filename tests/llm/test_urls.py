import duckdb

from tidemark.llm import urls as U
from tidemark.llm.queries import QUERIES, SQL


def link(u):
    return f"<html><head><link rel='canonical' href=\"{u}\"></head><p>x"


PAGES = [
    (1, "https://A.Example.ORG/es/1?x=1", "<p>"), (2, "http://a.example.org/en/12#y", "<p>"), (3, "http://example.org", "<p>"), (4, "http://example.org/de/", None), (5, None, "<p>"), (6, "no scheme", "<p>"), (7, "", "<p>"),
    (8, "http://b.com/de/1", "<p>"), (9, "http://x.net/1", link("http://b.com/de/1")), (10, "http://y.net/2", link("HTTP://x.net/1?q")), (11, "http://z.net/", link("/away")), (12, "http://z.net/away", '<META content="0; URL=http://b.com/de/9" http-equiv=refresh>'),
    (13, "http://w.net/", link("http://v.org/ok")), (14, "http://t.net/", link("http://b.com/de/77")), (14, "http://t.net/", link("//u.org/")), (15, "http://notorg/es/", "<p>"), (16, "http://q.net/a/b", link("c")), (17, "http://q.net/a/c", link("http://b.com/de/1")),
    (18, "ftp://Ünicode.ORG/É", "<p>"), (19, "http://k.net/" + "x" * 50_000, "<p>" * 50_000), (None, "http://b.com/fr/de/", "<p>"),
]


def test_query_agrees_with_sql(spark, tmp_path):
    spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(SQL["op9_url_filter"]).fetchall(), key=str)
    said = {r[0]: r[3:] for r in got}
    assert said[1] == ("example.org/es/", "block") and said[2] == ("example.org/en/1", "block") and said[3] == (None, "allow") and said[4] == ("org/", "allow")
    assert [said[i] for i in (9, 10, 11, 12, 16, 17)] == [(None, "block")] * 6  # through their aliases
    assert said[13] == (None, "allow") and said[14] == (None, "allow")  # an alias that is allowed goes first
    assert said[5] == said[6] == said[7] == said[15] == (None, "allow")


def test_redirect_table_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "")], "page_id int, url string, html string")
    moved = spark.createDataFrame([("http://a.net/", "http://m.net/"), ("http://m.net/", "http://c.com/de/"), (None, "http://c.com/de/")], "src string, dst string")
    rules = spark.createDataFrame(U.RULES, "rule_host string, rule_path string, verdict string")
    assert U.judge(pages, rules, redirects=moved).first().verdict == "block"
    assert U.judge(pages, rules.limit(0), redirects=moved).first().verdict == "allow"
    assert U.judge(pages.limit(0), rules).count() == 0
