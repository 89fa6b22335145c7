import pytest
from pyspark.sql import functions as F

from careledger.llm.url_filters import Rule, absolute_url, canonical_url, host_of, judge, page_edges, path_of

RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "bad.net", ""),
    Rule("allow", "good.net", "/ok"),
)


@pytest.fixture(scope="module")
def judged(spark):
    def run(rows, edges=()):
        pages = spark.createDataFrame(
            [(*r, "x", "y") for r in rows], "page_id long, url string, html string, component string, verdict string"
        )
        links = page_edges(pages)
        if edges:
            links = links.union(spark.createDataFrame(list(edges), "source string, target string"))
        return {r.page_id: r for r in judge(pages, links, RULES).collect()}

    return run


def test_parts_of_a_url(spark):
    urls = ["HTTP://A.Example.ORG/x/Y?q#f", "nothing", None, "s://h?x/y", "s://h#/p", "a://b://c/d", "x://", "\n://H/p\nq"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    found = [(r[0], r[1]) for r in df.select(host_of(F.col("u")), path_of(F.col("u"))).collect()]
    assert found == [
        ("a.example.org", "/x/Y"), ("", ""), ("", ""), ("h", ""), ("h", ""), ("b:", "//c/d"), ("", ""), ("h", "/p\nq"),
    ]


def test_the_longest_rule_wins(judged):
    rows = [(1, "http://a.example.org/es/1", ""), (2, "http://example.org/en", ""), (3, "http://myexample.org/es/", ""), (4, "http://org/x", ""), (5, "http://xorg/x", "")]
    found = judged(rows)
    assert {k: (r.rule, r.verdict) for k, r in found.items()} == {
        1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: ("org/", "allow"), 4: ("org/", "allow"), 5: (None, "allow"),
    }


def test_blocks_reach_aliases_unless_one_is_allowed(judged):
    to = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://one.com/", to("http://bad.net/a")),
        (2, "http://two.com/", '<meta http-equiv="refresh" content="0; url=http://one.com/">'),
        (3, "http://bad.net/a", "<p>"),
        (4, "http://three.com/", to("http://bad.net/b")),
        (5, "http://good.net/ok", to("http://three.com/")),
        (6, "http://bad.net/b", None),
        (7, "http://four.com/", ""),
    ]
    found = judged(rows)
    assert {k: r.verdict for k, r in found.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow",
    }
    assert found[2].decided_by == "alias" and found[2].rule is None and found[6].decided_by == "rule"


def test_relative_targets(spark):
    """The examples of RFC 3986, 5.4, for http, and some odd ones."""
    base = "http://a/b/c/d;p?q"
    want = {
        "g:h": None, "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
        "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
        "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", "": base, ".": "http://a/b/c/", "./": "http://a/b/c/",
        "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g",
        "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
        "..g": "http://a/b/c/..g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x",
        "/l?to=http://x/": "http://a/l?to=http://x/", "https://X/y": "https://X/y", "mailto:x": None,
    }
    df = spark.createDataFrame([(t, base) for t in want] + [("g", "http://h"), ("g", "none")], "t string, u string")
    found = [r[0] for r in df.select(absolute_url(F.col("t"), F.col("u"))).collect()]
    assert dict(zip(want, found)) == want and found[-2:] == ["http://h/g", None]


def test_blocks_reach_relative_and_canonical_targets(judged):
    to = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://one.com/a/b", to("../c")),
        (2, "http://one.com/c", '<meta http-equiv="refresh" content="0; url=//bad.net/x">'),
        (3, "http://two.com/", to("https://www.three.com/y/?utm_source=z")),
        (4, "https://three.com/y", to("/z")),
        (5, "https://m.three.com/z", to("http://bad.net/")),
        (6, "http://four.com/", to("/z")),
    ]
    assert {k: r.verdict for k, r in judged(rows).items()} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow",
    }


def test_long_chains_of_redirects(judged):
    rows = [(i, f"http://h{i}.com/", "") for i in range(40)] + [(40, "http://bad.net/", "")]
    chain = [(f"http://h{i}.com/", f"http://h{i + 1}.com/") for i in range(39)] + [("http://h39.com/", "http://bad.net/")]
    assert {r.verdict for r in judged(rows, chain).values()} == {"block"}


def test_server_redirects_make_aliases(spark):
    urls = ["http://www.A.com/x.html?utm_source=f#top", "https://a.com/x/", "https://m.a.com/x?ref=1&page=2", "plain"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(canonical_url(F.col("u"))).collect()] == [
        "https://a.com/x", "https://a.com/x", "https://a.com/x?page=2", "plain",
    ]


def test_odd_rows(judged, spark):
    found = judged([(1, None, None), (2, "", ""), (3, "no scheme", "<link"), (None, "http://bad.net", ""), (5, "http://bad.net", "")])
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("", "", None, "allow")
    assert found[3].verdict == "allow" and found[None].verdict == found[5].verdict == "block"
    assert len(judged([])) == 0


def edges_of(spark, url, html):
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    return {r.target for r in page_edges(pages).collect() if r.source == url} - {canonical(spark, url)}


def canonical(spark, url):
    return spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("""<meta http-equiv="refresh" content="0; url='http://bad.net/x'">""", {"http://bad.net/x"}),
        ("""<meta content='5;URL="http://bad.net/x" ' http-equiv=Refresh>""", {"http://bad.net/x"}),
        ("""<meta http-equiv=refresh content="30">""", set()),
        ("""<link rel="alternate  canonical" href=http://bad.net/x>""", {"http://bad.net/x"}),
        ("""<link rel="canonicals" href="http://bad.net/x"><link rel=canonical data-href="http://bad.net/y">""", set()),
        ("""<base href="http://bad.net/a/"><base href="http://no.net/"><link rel=canonical href="b">""", {"http://bad.net/a/b"}),
        ("""<base target=_top><link href="b" rel=canonical>""", {"http://one.com/p/b"}),
        ("""<base href="/q/"><link href="b" rel=canonical>""", {"http://one.com/q/b"}),
        ("""<!-- <link rel=canonical href="http://bad.net/x"> -->""", set()),
        ("""<!-- <link rel=canonical href="http://bad.net/x">""", set()),
        ("""<script>'<link rel=canonical href="http://bad.net/x">'</script><STYLE> <link rel=canonical href=/no>""", set()),
        ("""<!-- --><link rel=canonical href="http://bad.net/x"><!-- -->""", {"http://bad.net/x"}),
        ("""<link rel=canonical href=" http://bad.net/x?a=1&amp;b=2&#38;c&#x2F;&nbsp;&amp;lt;&#0; ">""", {"http://bad.net/x?a=1&b=2&c/&nbsp;&lt;&#0;"}),
        ("""<link rel=canonical href="">""", set()),
        ("""<link rel=canonical href="/a&#128077;&#xD800;&#9999999;&">""", {"http://one.com/a👍&#xD800;&#9999999;&"}),
    ],
)
def test_links_of_a_page(spark, html, want):
    assert edges_of(spark, "http://one.com/p/q", html) == want


def test_many_null_urls(judged):
    found = judged([(i, None, "") for i in range(500)] + [(900, "http://bad.net", "")])
    assert len(found) == 501 and found[900].verdict == "block"
    assert all(found[i].verdict == "allow" and found[i].alias is None for i in range(500))
