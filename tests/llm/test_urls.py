"""Verdicts against the checking SQL on made pages with links; hosts, paths and rules one by one."""

import random

import pytest

from floodspark.llm.oracles import REDIRECT_EQUIVALENCE
from floodspark.llm.urls import judge

duckdb = pytest.importorskip("duckdb")


def rows_of(frame):
    return sorted(map(str, map(tuple, frame.collect())))


def test_against_sql(spark):
    pd = pytest.importorskip("pandas")
    rng = random.Random(1)
    hosts = ["a.example.net", "www.a.example.net", "b.example.com", "m.b.example.com", "c.org", "x.net", "y.io", "EN.Example.COM", "blog.z.io"]
    url = lambda: (rng.choice(["http", "https"]) + "://" + rng.choice(hosts)
                   + rng.choice(["/en/1", "/de/2", "/fr/3", "/q", "/q.html", "/q/", "", "/de/"]) + rng.choice(["", "?a=b", "#x"]))
    rows = []
    for i in range(120):
        html = f'<head><LINK data-x="1" rel="canonical" href="{url()}">' if rng.random() < 0.4 else ""
        html += f"<meta http-equiv=refresh content='0;url={url()}'>" if rng.random() < 0.3 else ""
        rows.append((i, url(), html))
    rows += [(500, None, None), (501, "nourl", ""), (502, "://", ""), (0, rows[0][1], rows[0][2])]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert rows_of(judge(spark.createDataFrame(rows, "page_id long, url string, html string"))) == sorted(map(str, con.execute(REDIRECT_EQUIVALENCE).fetchall()))


def test_decisions_reach_aliases(spark):
    pages = [(1, "http://s.net/a", '<link rel="canonical" href="http://alias.io/a">'), (2, "http://alias.io/a", ""), (3, "https://www.alias.io/a/?u=1", ""),
             (4, "http://other.io/a", ""), (5, "http://t.net/b", '<link rel="canonical" href="http://k.io/b">'),
             (6, "http://k.org/fr/b", '<link rel=canonical href=http://k.io/b>'), (7, "http://k.io/b", ""), (8, "http://to.io/", "<meta http-equiv='refresh' content='0; url=http://bad.net/x'>")]
    found = {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: ("net/", "block"), 6: ("org/fr/", "allow"),
                     7: (None, "allow"), 8: (None, "block")}


def test_hosts_paths_and_longest_rule(spark):
    urls = ["HTTP://A.Example.NET/en/x?y", "http://example.net/e", "http://xexample.net/en/", "http://example.com/de/1", "http://sub.example.com/de", "http://o.org/fr/",
            "http://o.org", "no scheme/en/", None, "x://h?q://z/fr/", "a://b.net#f/en/"]
    found = {r.page_id: tuple(r)[1:5] for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert found == {0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/e", "net/", "block"), 2: ("xexample.net", "/en/", "net/", "block"),
                     3: ("example.com", "/de/1", "example.com/de/", "block"), 4: ("sub.example.com", "/de", None, "allow"), 5: ("o.org", "/fr/", "org/fr/", "allow"),
                     6: ("o.org", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("h", "", None, "allow"), 10: ("b.net", "", None, "allow")}


def test_added_redirects_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://q.io/1", "x", 1)], "page_id long, url string, component string, node int")
    redirects = spark.createDataFrame([("http://q.io/1", "http://w.net/"), (None, "http://w.net/"), ("http://q.io/1", None)], "source string, target string")
    assert judge(pages, redirects=redirects).first().verdict == "block"
    assert judge(pages).first().verdict == "allow"
    assert judge(pages.limit(0)).count() == 0


def test_every_tag_and_relative_links_count(spark):
    link = lambda href, rel="canonical": f'<link rel="{rel}" href="{href}">'
    to = lambda url: f'<meta http-equiv="Refresh" content="0; URL={url}">'
    pages = [(1, "http://s.net/a/b?q", link("/up")), (2, "http://s.net/c/d", link("//p1.io/x")), (3, "http://s.net/e/", to("//p2.io/y")),
             (4, "http://s.net/f", link("http://p3.io/1") + link("http://p4.io/1") + to("http://p5.io/1") + to("http://p6.io/1")),
             (5, "http://s.net/g", link("http://p7.io/1", "alternate canonical")), (6, "http://s.net/h", "<link href = 'http://p8.io/1' rel = canonical>"),
             (7, "http://s.net/i", '<base href="http://p9.io/k/l"><link rel=canonical href=../m>'), (8, "http://s.net/j", link("http://no.io/1", "alternate")),
             (9, "http://s.net/k", '<link title="a href=http://no.io/2" rel=canonical href="http://p10.io/1">'), (10, "http://s.net/l", link("mailto:a@no.io")),
             (11, "http://r.io/a/b", to("../c/./d")), (12, "http://r.io/c/d", link("http://bad.net/")), (13, "http://r.io", to("e?u=http://no.io/3")),
             (14, "http://r.io/e", to("http://bad.net/")), (15, "http://s.net/m", "<meta http-equiv=refresh content='0 ; \"http://p11.io/1\"'>")]
    blocked = ["http://p1.io/x", "http://p2.io/y", *(f"http://p{k}.io/1" for k in (3, 4, 5, 6, 7, 8, 10, 11)), "http://p9.io/m"]
    clean = ["http://no.io/1", "http://no.io/2", "http://no.io/3", "http://p9.io/k/l"]
    rows = pages + [(100 + k, u, "") for k, u in enumerate(blocked)] + [(200 + k, u, "") for k, u in enumerate(clean)]
    found = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {u: found[100 + k].verdict for k, u in enumerate(blocked)} == dict.fromkeys(blocked, "block")
    assert {u: found[200 + k].verdict for k, u in enumerate(clean)} == dict.fromkeys(clean, "allow")
    assert found[1].component == "s.net/a/b" and [found[k].verdict for k in (11, 13)] == ["block", "block"]
