"""URL filter: rules, links out of pages, decisions over components of aliases."""

import pytest

from keelson.llm import url_filter
from keelson.llm.url_filter import Rule

SCHEMA = "page_id long, url string, html string"


def judged(spark, rows, redirects=None, rules=url_filter.RULES, clashes=()):
    pages = spark.createDataFrame(rows, SCHEMA)
    for name in clashes:
        pages = pages.selectExpr("*", f"'x' as `{name}`")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "from_url string, to_url string, extra int")
    found = url_filter.judge_urls(pages, redirects, rules).collect()
    return sorted([tuple(r) for r in found], key=repr)


def canonical(target):
    return f'<html><head><link rel="canonical" href="{target}"></head></html>'


def test_hosts_paths_and_the_longest_rule(spark):
    rows = [
        (1, "http://a.com/x", None),
        (2, "https://Example.COM/en/1?q=/fr/#t", None),
        (3, "https://www.example.com/en/1", None),
        (4, "http://notexample.com/en/", None),
        (5, "http://x.net/es/", None),
        (6, "http://x.net/es", None),
        (7, "http://com", None),
        (8, "http://net/fr/1#/a", None),
        (9, "http://a.com?x=/en/", None),
        (10, None, None),
        (11, "a.com/x", None),
        (12, "", ""),
        (13, "//a.com/x", None),
        (14, "x://y://z.net/fr/", None),
        (15, "http://a.com:80/x", None),
        (15, "http://a.com:80/x", None),
    ]
    got = {r[0]: r[1:] for r in judged(spark, rows, clashes=("node", "own", "allow", "rule", "from_url"))}
    assert got == {
        1: ("a.com", "/x", "com/", "allow"),
        2: ("example.com", "/en/1", "example.com/en/", "block"),
        3: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        4: ("notexample.com", "/en/", "com/", "allow"),
        5: ("x.net", "/es/", "net/es/", "block"),
        6: ("x.net", "/es", None, "allow"),
        7: ("com", "", None, "allow"),
        8: ("net", "/fr/1", "net/fr/", "block"),
        9: ("a.com", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("", "", None, "allow"),
        12: ("", "", None, "allow"),
        13: ("", "", None, "allow"),
        14: ("y:", "//z.net/fr/", None, "allow"),
        15: ("a.com:80", "/x", None, "allow"),
    }


def test_blocks_reach_aliases_and_explicit_allows_go_first(spark):
    rows = [
        # A chain of canonical links that ends in a blocked URL no page has.
        (1, "http://a.org/1#part", canonical("http://a.org/2")),
        (2, "http://A.org/2", '<meta content="0; URL=\'http://b.org/3\'" http-equiv=Refresh>'),
        (3, "http://b.org/3", canonical("http://c.net/fr/x")),
        # The same, with an allowed member: nobody without a rule is blocked, the blocked one is.
        (4, "http://d.org/4", canonical("http://d.com/")),
        (5, "http://e.net/es/5", canonical("http://d.org/4")),
        (6, "http://f.org/6", canonical("http://d.org/4")),
        # Aliases among themselves.
        (7, "http://g.org/7", canonical("http://g.org/8")),
    ]
    got = {r[0]: r[3:] for r in judged(spark, rows)}
    assert got == {
        1: (None, "block"),
        2: (None, "block"),
        3: (None, "block"),
        4: (None, "allow"),
        5: ("net/es/", "block"),
        6: (None, "allow"),
        7: (None, "allow"),
    }


def test_given_redirects_and_one_large_component(spark):
    rows = [(i, f"http://a.org/{i}", None) for i in range(300)]
    redirects = [(f"http://a.org/{i}", "http://hub.org", 1) for i in range(299)]
    redirects += [("http://hub.org/#x", "http://x.net/fr/", 1), (None, "http://a.org/299", 1), ("junk", "http://a.org/299", 1)]
    got = {r[0]: r[4] for r in judged(spark, rows, redirects)}
    assert got == {i: "block" if i < 299 else "allow" for i in range(300)}


@pytest.mark.parametrize(
    "html, target",
    [
        ('<link href="/b?x=1&amp;y=2" rel="nofollow Canonical" />', "http://a.org/b?x=1&y=2"),
        ('<base href="http://z.org/d/"><link rel=canonical href=e>', "http://z.org/d/e"),
        ("<meta http-equiv='refresh' content='5;url=../up'>", "http://a.org/up"),
        ('<link rel="canonical" title="a > b" href="//q.org">', "http://q.org"),
        ('<link rel="canonical" don\'t href="http://q.org/">', "http://q.org/"),
        ('<!-- <link rel="canonical" href="/b"> -->', None),
        ('<script>"<link rel=canonical href=/b>"</script>', None),
        ('<meta http-equiv="refresh" content="30">', None),
        ('<link rel="alternate" href="/canonical">', None),
        ('<link rel="canonical" href="http://[">', None),
        ('<link rel="canonical">', None),
        ("", None),
    ],
)
def test_links_of_pages(spark, html, target):
    pages = spark.createDataFrame([(1, "http://a.org/x/y", html + "<p>text" * 3)], SCHEMA)
    assert [r["to_url"] for r in url_filter.page_links(pages).collect()] == ([target] if target else [])


def test_an_empty_table_and_equal_rules(spark):
    assert judged(spark, []) == []
    rules = [Rule("a.org", "/x", False), Rule("a.org", "/x", True)]
    assert judged(spark, [(1, "http://a.org/x", None)], rules=rules)[0][4] == "allow"
    with pytest.raises(ValueError):
        judged(spark, [(1, "http://a.org/x", None)], rules=rules * 1_000)
