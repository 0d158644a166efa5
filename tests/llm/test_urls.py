import duckdb
import pandas as pd

from strandflow.llm import queries, url_filter

PAGES = [
    (0, "http://a.example.net/x", '<link rel="canonical" href="https://www.example.org/es/9">'),
    (1, "https://b.example.net/y?q=1#f", "<META http-equiv=refresh content='0; URL=http://a.example.net/x'>"),
    (2, "http://shop.com/fr/1", '<link rel=canonical href="http://a.example.net/x">'),
    (3, "http://c.net/p/q", '<link href="/root" rel="canonical">'),
    (4, "http://c.net/root", None),
    (5, "HTTP://X.COM/de/1", ""),
    (6, "http://sub.Example.ORG/en/17", "<p>"),
    (7, "http://example.org", "<link rel='canonical' href='//d.net/z'>"),
    (8, None, '<link rel="canonical" href="http://a.example.net/x">'),
    (9, "no address", '<link rel="canonical" href="http://a.example.net/x">'),
    (10, "http://d.net/z", '<link rel="canonical" href="http://com/de/5">'),
    (10, "http://d.net/z", '<link rel="canonical" href="http://com/de/5">'),
    (11, "http://notexample.org.net/en/1", "<link rel=stylesheet href=x>"),
    (12, "http://e.net/a/b", '<link rel="canonical" href="c">'),
    (13, "http://e.net/a/c", '<link rel="canonical" href="http://f.com/de/">'),
    (None, "http://e.net/a/c", None),
    # An address in a query, the word canonical in another attribute, a reference, dots, places in a page, other schemes.
    (20, "http://s.net/x", "<link rel=canonical href='/login?next=http://b.com/de/p'>"),
    (21, "http://s.net/y", '<link rel="stylesheet" href="http://b.com/de/canonical/site.css">'),
    (22, "http://s.net/z", '<link title="rel=canonical" rel=icon href="http://b.com/de/">'),
    (23, "http://s.net/r", "<link rel=canonical href='http://s.net/t?a=1&amp;b=2'>"),
    (24, "http://s.net/t?a=1&b=2", "<LINK\nREL='next Canonical' title='a>b' href=http://b.com/de/q>"),
    (25, "http://s.net/d/e/f", '<link rel="canonical" href="../../u/./v/../w">'),
    (26, "http://s.net/u/w", "<meta content='5;url=http://b.com/x/../de/' http-equiv='Refresh'>"),
    (27, "http://s.net/top", '<link rel="canonical" href="#http://b.com/de/">'),
    (28, "http://s.net/mail", '<link rel="canonical" href="mailto:x@b.com/de/">'),
    (29, "http://s.net/named", "<meta name=refresh content='0;url=http://b.com/de/'><link rel=canonical>"),
    (30, "http://s.net/q", '<link rel="canonical" href="?a=1">'),
    (31, "http://s.net/q?a=1", '<link rel="canonical" href="http://b.com/de/"><link rel="canonical" href="http://shop.com/fr/">'),
    (32, "http://s.net/up", '<link rel=canonical href="/a/b/c/../../..//../k">'),
    (33, "http://s.net/k", "<link rel=canonical href=http://b.com/de/k>"),
]


def test_aliases_and_rules(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' address", "'x' verdict", "'x' component", "'x' node")
    out = url_filter.judged(df, queries.URL_RULES)
    found = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in out.collect()}
    verdict = {k[0]: v for k, v in found.items()}
    # 0, 1 and 2 are aliases of a blocked page; 2 has a rule that allows, which shields them all.
    assert verdict[2] == ("com/fr/", "allow") and verdict[0] == (None, "allow") and verdict[1] == (None, "allow")
    assert verdict[3] == (None, "allow") and verdict[5] == ("com/de/", "block") and verdict[6] == ("example.org/en/1", "block")
    # No path begins with a slash here: no rule; its alias d.net/z leads to a blocked address.
    assert verdict[7] == (None, "block") and verdict[10] == (None, "block")
    assert verdict[12] == (None, "block") and verdict[13] == (None, "block") and verdict[None] == (None, "block")
    assert found[8, "", ""] == (None, "allow") and found[9, "", ""] == (None, "allow")
    # 23 is an alias of 24, 25 of 26, 30 of 31 and 32 of 33, which lead to blocked addresses; the others have no such link.
    assert {i for i in range(20, 34) if verdict[i] == (None, "block")} == {23, 24, 25, 26, 30, 31, 32, 33}
    assert (11, "notexample.org.net", "/en/1") in found and (5, "x.com", "/de/1") in found
    assert out.count() == len(PAGES)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.sql(queries.OP5_SQL).fetchall()
    got = [tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, got))


def test_long_pages(spark):
    rows = [(1, "http://s.net/", "<link " + 'a="b" ' * 20_000 + "rel=canonical href=http://b.com/de/>"), (2, "http://s.net/2", '<link "' * 20_000), (3, "http://s.net/3", "<" * 300_000)]
    out = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES)
    assert {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_redirects_given_besides(spark):
    df = spark.createDataFrame([(1, "http://q.net/1", None), (2, "http://q.net/2", None)], "page_id long, url string, html string")
    given = spark.createDataFrame([("http://q.net/1", "http://q.com/de/"), (None, None)], "url string, target string")
    out = {r.page_id: r.verdict for r in url_filter.judged(df, queries.URL_RULES, given).collect()}
    assert out == {1: "block", 2: "allow"}


def test_no_pages(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string, html string"), queries.URL_RULES).count() == 0


def test_queries_equal_their_sql(spark):
    from helpers import oracle_rows, rows

    for name in queries.ORACLE:
        assert rows(queries.QUERIES[name](spark, "/root/testdata/sf0.01")) == oracle_rows(queries.ORACLE[name], "/root/testdata/sf0.01")
    # Decisions are carried over.
    out = queries.url_links(spark, "/root/testdata/sf0.01")
    assert out.where("verdict = 'block' and rule is null").count() > 0
