"""Verdicts of web addresses against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from swipelake.llm import urls
from swipelake.llm.components import components

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"), ("Deep.Example.org", "/a/b", "block"), ("org", "/a/bb", "allow"),
]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def longest(host, path, rules):
    fits = [
        (len(h + p), len(h), v == "allow", h.lower() + p, v)
        for h, p, v in rules
        if host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else (None, None)


def node(url):
    host, path = split_url(url)
    rest = url.split("://", 1)[1] if host else ""
    rest = rest.split("#")[0]
    return (host, path, rest[rest.find("?") :] if "?" in rest else "") if host else None


def plain(pages, edges, rules=RULES):
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    verdicts = {}
    for pair in edges:
        ends = [node(u) if u is not None else None for u in pair]
        if None not in ends:
            group[find(ends[0])] = find(ends[1])
            for end in ends:
                verdicts[end] = longest(*end[:2], rules)[1]
    seen = {}
    for end, verdict in verdicts.items():
        seen.setdefault(find(end), set()).add(verdict)
    made = []
    for id_, url, *_ in pages:
        host, path = split_url(url)
        rule, verdict = longest(host, path, rules)
        if verdict is None:
            known = seen.get(find(node(url)), set()) if host and node(url) in verdicts else set()
            verdict = "block" if "block" in known and "allow" not in known else "allow"
        made.append((id_, host, path, rule, verdict))
    return sorted(made, key=repr)


def judged(spark, pages, redirects=None, rules=RULES):
    frame = spark.createDataFrame(
        [(*p, 1, "x", True) for p in pages], "page_id long, url string, html string, row int, rule string, verdict boolean"
    )
    held = spark.createDataFrame(rules, "host string, path string, verdict string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "from_url string, to_url string")
    found = urls.judge_pages(frame, held, redirects)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "decided_by"]
    return sorted((tuple(r)[:5] for r in found.collect()), key=repr), found


ADDRESSES = [
    "http://example.com/en/1", "http://www.example.com/en/1", "HTTPS://WWW.Example.Com/EN/1?x=1#y", "http://a.net/es/",
    "http://a.net/es", "net://es/", "http://net/fr/x", "http://notnet/fr/x", "http://x.org/a/bb", "http://deep.example.org/a/bb",
    "http://very.deep.example.org/a/b", "http://com", "http://com?x://net/es/", "no scheme net/es/", "", "://net/es/1", "http:///es/",
    "http://user@a.net:80/es/", "http://a.net/es/\n?q", "http://exämple.NET/fr/ü", None, "x" * 40_000, "http://" + "a." * 300 + "net/es/",
]


def test_own_rules(spark):
    pages = [(i, u, None) for i, u in enumerate(ADDRESSES)]
    got, _ = judged(spark, pages)
    assert got == plain(pages, [])
    assert {r[3] for r in got} >= {None, "net/es/", "net/fr/", "com/", "example.com/en/", "www.example.com/en/", "deep.example.org/a/b"}


def test_blocks_reach_aliases_and_allows_come_first(spark):
    canonical = '<head><LINK href="{}" Rel="canonical"></head>'
    pages = [
        (1, "http://a.org/1", canonical.format("http://b.net/es/1")),
        (2, "http://a.org/2?x=1", "<link rel='canonical' href='/1'>"),
        (3, "https://a.org/1#top", None),
        (4, "http://a.org/4", '<meta http-equiv="refresh" content="0; url=http://c.com/x?a=1&amp;b=2">'),
        (5, "http://a.org/5", canonical.format("4")),
        (6, "http://d.org/dir/6", '<link rel="canonical" href="7">'),
        (7, "http://d.org/dir/7", '<meta content="5;URL=\'//b.net/fr/1\'" http-equiv=refresh>'),
        (8, "http://www.example.com/en/8", canonical.format("http://b.net/es/1")),
        (9, "http://e.org/9", canonical.format("#here")),
        (10, "http://e.org/10", '<link rel="stylesheet" href="http://b.net/es/1"><a href="http://b.net/es/1">'),
        (11, "http://c.com/x?a=1&b=2", canonical.format("http://b.net/fr/9")),
        (12, None, canonical.format("http://b.net/es/1")),
        (13, "http://f.org/13", None),
        (14, "http://f.org/14", canonical.format("mailto")),
    ]
    edges = [
        ("http://a.org/1", "http://b.net/es/1"), ("http://a.org/2?x=1", "http://a.org/1"), ("http://a.org/4", "http://c.com/x?a=1&b=2"),
        ("http://a.org/5", "http://a.org/4"), ("http://d.org/dir/6", "http://d.org/dir/7"), ("http://d.org/dir/7", "http://b.net/fr/1"),
        ("http://www.example.com/en/8", "http://b.net/es/1"), ("http://c.com/x?a=1&b=2", "http://b.net/fr/9"),
        ("http://f.org/13", "http://f.org/14"), ("http://f.org/14", "http://f.org/mailto"),
    ]
    got, found = judged(spark, pages, [("http://f.org/13", "http://f.org/14"), (None, "http://b.net/es/1"), ("x", "y")])
    assert got == plain(pages, edges)
    verdicts = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in found.collect()}
    # The allowed alias 8 frees its component; 6 and 7 are blocked; 4 and 5 reach an allowed address.
    assert verdicts[1] == verdicts[2] == verdicts[3] == ("allow", "default") and verdicts[8] == ("allow", "rule")
    assert verdicts[6] == verdicts[7] == ("block", "alias") and verdicts[4][0] == verdicts[5][0] == "allow"


def test_random_redirects_equal_plain_code(spark):
    draw = random.Random(4)
    hosts = ["a.org", "b.org", "net", "x.net", "example.com", "m.example.com"]

    def address():
        return f"http://{draw.choice(hosts)}{draw.choice(['/es/', '/en/', '/'])}{draw.randrange(60)}"

    pages = [(i % 90, address(), None) for i in range(150)] * 2
    edges = [(address(), address()) for _ in range(140)]
    rules = [("net", "/es/", "block"), ("example.com", "/en/1", "block"), ("b.org", "/en/", "allow")]
    got, found = judged(spark, pages, edges, rules)
    assert got == plain(pages, edges, rules)
    assert {r["decided_by"] for r in found.collect()} == {"rule", "alias", "default"}


def test_many_rules_of_one_host_are_not_paired(spark):
    rules = [("net", f"/{i:05}", "block") for i in range(3000)] + [("net", "/00007", "allow"), ("a.net", "/0", "allow")]
    pages = [(i, f"http://{'a.' * (i % 2)}net/{i:05}/x", None) for i in range(400)]
    got, _ = judged(spark, pages, None, rules)
    assert got == plain(pages, [], rules)
    places = spark.createDataFrame([(i, *split_url(u)) for i, u, _ in pages], "row long, host string, path string")
    held = spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("rule", F.concat("host", "path"))
    assert urls.fitting_rules(places, held).count() == 400


def test_sql_twin_follows_links_too(spark):
    """The SQL of the registered query on planted links, which the given pages lack."""
    import duckdb

    from swipelake.llm.twins import judge_pages

    canonical = '<html><link rel="canonical" href="{}"></html>'
    pages = [
        (1, "http://a.org/1", canonical.format("http://b.net/es/1")),
        (2, "http://a.org/x/2?x=1", canonical.format("../1") + canonical.format("/1")),
        (3, "http://a.org/4", '<meta http-equiv="refresh" content="0; url=http://c.org/x?a=1&amp;b=2">'),
        (4, "http://c.org/x?a=1&b=2", canonical.format("http://www.example.com/en/1")),
        (5, "http://c.org/y", canonical.format("http://example.com/en/1") + canonical.format("//b.net/fr/2")),
        (6, "http://d.com/y", None),
        (7, None, canonical.format("http://example.com/en/1")),
    ]
    _, found = judged(spark, pages)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    rows = con.execute(judge_pages(RULES)).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    assert {r[5] for r in rows} == {"rule", "alias", "default"}


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge_pages(nothing, rules).count() == 0
    got, _ = judged(spark, [(1, "http://net/es/", None), (None, "http://net/es/", None)], None, [("x", None, "block")])
    assert got == [(1, "net", "/es/", None, "allow"), (None, "net", "/es/", None, "allow")]


@pytest.mark.parametrize("rows_per_task", [10_000_000, 20])
def test_components_of_hubs_and_chains(spark, rows_per_task):
    """Salted or not: a hub, a chain and single links."""
    hub = [(1, n) for n in range(2, 150)]
    chain = [(n, n + 1) for n in range(1000, 1040)]
    links = spark.createDataFrame(hub + chain + [(500, 400), (400, 500)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links, rows_per_task=rows_per_task).collect()}
    want = {n: 1 for n in range(1, 150)} | {n: 1000 for n in range(1000, 1041)} | {400: 400, 500: 400}
    assert found == want
