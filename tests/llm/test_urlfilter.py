import sys

import pytest

from tallyspark.llm.queries import RULES
from tallyspark.llm.urlfilter import Rule, Trie, judge, trie_bytes

CASES = [
    ("http://a.example.com/en/1?x=1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://WWW.Example.COM/en/#f", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?en/", "example.com", "", None, "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("ftp://x.net/fr/a", "x.net", "/fr/a", "net/fr/", "block"),
    ("http://x.net/frx/a", "x.net", "/frx/a", None, "allow"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://xnet/es/", "xnet", "/es/", None, "allow"),
    ("no scheme.com/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄB.com/\u00e9", "Äb.com", "/é", "com/", "allow"),
    ("a://b://c.net/es/", "b:", "//c.net/es/", None, "allow"),
]


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["trie", "join"])
def test_cases(spark, limit):
    df = spark.createDataFrame([(i, c[0], "old", "old") for i, c in enumerate(CASES)] * 2, "page_id long, url string, host string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(df, RULES, max_broadcast_bytes=limit).collect())
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, (i, *c[1:]))) for i, c in enumerate(CASES) for _ in range(2)]
    assert judge(df.limit(0), RULES, max_broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["trie", "join"])
def test_part_of_a_segment_and_longest_wins(spark, limit):
    rules = [Rule("a.b/x", "block"), Rule("a.b/xy", "allow"), Rule("b/", "allow"), Rule("a.b/x/y/z", "block")]
    df = spark.createDataFrame([("http://a.b/x",), ("http://a.b/xyz",), ("http://c.a.b/x/y/zz",), ("http://b/q",), ("http://a.b/y",)], "url string")
    got = {r.url: r.rule for r in judge(df, rules, max_broadcast_bytes=limit).collect()}
    assert got == {"http://a.b/x": "a.b/x", "http://a.b/xyz": "a.b/xy", "http://c.a.b/x/y/zz": "a.b/x/y/z", "http://b/q": "b/", "http://a.b/y": "b/"}


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["trie", "join"])
def test_rule_tables_many_rules_of_a_host_and_long_urls(spark, limit):
    rules = [(f"big.org/p{i:05d}", "block") for i in range(3000)] + [("org/", "allow"), ("big.org/p", "allow"), (None, "block"), ("x.org/", None)]
    deep = "http://a." * 1 + "big.org/" + "seg/" * 300 + "?q"
    urls = ["http://big.org/p01234/x", "http://www.big.org/p0123", deep, "http://big.org/" + "y" * 20_000, "http://q.net/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.rule, r.verdict) for r in judge(df, spark.createDataFrame(rules, "entry string, verdict string"), max_broadcast_bytes=limit).collect()}
    assert [got[u] for u in urls] == [("big.org/p01234", "block"), ("big.org/p", "allow"), ("org/", "allow"), ("org/", "allow"), (None, "allow")]


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["trie", "join"])
def test_equal_entries_block(spark, limit):
    df = spark.createDataFrame([("http://a.b/",)], "url string")
    for rules in ([Rule("a.b/", "allow"), Rule("a.b/", "block")], [Rule("a.b/", "block"), Rule("a.b/", "allow")]):
        assert judge(df, rules, max_broadcast_bytes=limit).first().verdict == "block"


def test_tries_stay_within_the_bound_of_their_rules():
    rules = [Rule(f"a{i}.b{i % 97}.example.org/p{i}/q{i % 7}/r", "block") for i in range(4000)] + [Rule("x.y/", "allow")]
    trie, seen, size = Trie(rules), set(), 0
    heap = [trie.root]
    while heap:
        x = heap.pop()
        if id(x) not in seen:
            seen.add(id(x))
            size += sys.getsizeof(x)
            heap += [*x.keys(), *x.values()] if isinstance(x, dict) else list(x) if isinstance(x, tuple | set) else []
    assert size < trie_bytes(rules)


@pytest.mark.parametrize("limit", [1 << 30, 0], ids=["trie", "join"])
def test_five_thousand_segments(spark, limit):
    df = spark.createDataFrame([("http://a.b.big.org/" + "seg/" * 5000,), ("http://" + "a." * 3000 + "org/x/y/",)], "url string")
    rules = [Rule("org/", "allow"), Rule("org/x/y/", "block"), Rule("big.org/seg/seg/seg/s", "block")]
    got = {r.url[:20]: r.rule for r in judge(df, rules, max_broadcast_bytes=limit).collect()}
    assert sorted(got.values()) == ["big.org/seg/seg/seg/s", "org/x/y/"]
