"""URL rules and lists against plain look-ups, and the filters behind them."""

import random

import numpy as np
import pytest

from monthloom.llm import bloom_cascade, url_filter
from monthloom.llm.shipping import ship

RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False),
         ("a.com/de/x", True), ("com/de/xyz", False), ("com/de/xyz", True)]


def brute(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, allow in rules:
        own, sep, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(sep + tail):
            best = max(best or (), (len(rule), len(own), not allow, rule))
    if best:
        return host, path, best[3], "block" if best[2] else "allow"
    return host, path, None, "block" if host + path in listed else "allow"


def judged(spark, urls, rules=RULES, listed=()):
    ship(spark)
    table = spark.createDataFrame(list(enumerate(urls)), "id long, url string").repartition(3)
    rules = spark.createDataFrame(rules, "rule string, allow boolean")
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    rows = url_filter.judge(table, rules, keys).orderBy("id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


def some_urls(seed, n):
    draw = random.Random(seed)
    hosts = ["example.org", "Example.ORG", "b.example.org", "x.com", "a.com", "b.a.com", "nexample.org", "org", "y.net", ".org", "com.", "a..com"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/de/", "/fr/x#y", "/de/", "/de/xyz/1", "/de/x", "?a=://b/c", "#/es/", "/\U0001f600/é"]
    return [draw.choice(["http://", "https://", "", "x:"]) + draw.choice(hosts) + draw.choice(tails) for _ in range(n)]


def test_rules_and_list(spark):
    urls = [None, "", "://", "no scheme", "http://" + "a." * 3000 + "org/es/", "http://y.net/" + "p" * 50_000, *some_urls(1, 300)]
    listed = ["y.net/", "y.net/fr/x", "y.net/" + "p" * 50_000, "not/there", "org/"]
    assert judged(spark, urls, listed=listed) == [brute(u, RULES, set(listed)) for u in urls]


def test_empty_tables(spark):
    assert judged(spark, []) == []
    assert judged(spark, ["http://a.org/x", None], rules=[]) == [("a.org", "/x", None, "allow"), ("", "", None, "allow")]
    assert judged(spark, [None, "x"], listed=[""]) == [("", "", None, "block")] * 2


def test_other_columns_and_repeated_rows(spark):
    ship(spark)
    names = "id long, url string, host string, rule string, keys int, candidates string"
    table = spark.createDataFrame([(1, "http://a.org/x", "h", "r", 1, "c")] * 2 + [(None, "http://A.com/de/", "h", "r", 1, "c")], names)
    rules = spark.createDataFrame(RULES, "rule string, allow boolean")
    rows = url_filter.judge(table, rules, spark.createDataFrame([], "key string")).collect()
    assert sorted((r.id or 0, r.rule, r.verdict) for r in rows) == [(0, "com/de/", "block"), (1, "org/", "allow"), (1, "org/", "allow")]


@pytest.mark.parametrize("n, share", [(1, 1.0), (3000, 0.01), (3000, 0.5), (3000, 0.97), (500, 0.0)])
def test_cascade_is_exact(n, share):
    draw = random.Random(n)
    keys = bloom_cascade.digests([f"k{i}" for i in range(n)])
    listed = np.array([draw.random() < share for _ in range(n)])
    levels = bloom_cascade.cascade(keys[listed], keys[~listed])
    rows = [{"shard": 0, "level": i, "hashes": h, "words": w.tobytes()} for i, (w, h) in enumerate(levels)]
    assert (bloom_cascade._laid_out(rows, 1, 0, 1).holds(keys) == listed).all()
    if share == 0.5:
        assert len(levels) > 3  # false positives of both sides are encoded


def test_equal_digests_are_an_error():
    keys = bloom_cascade.digests(["a"])
    with pytest.raises(ValueError):
        bloom_cascade.cascade(keys, keys)


def test_many_shards_and_passes(spark, monkeypatch):
    """A list larger than one broadcast is looked up in several passes, with the same result."""
    monkeypatch.setattr(bloom_cascade, "SHARD_KEYS", 50)
    ship(spark)
    keys = [f"key {i}" for i in range(3000)]
    listed = set(keys[::3])
    universe = spark.createDataFrame([(k,) for k in keys + keys[:500] + [None]], "key string").repartition(5)
    made = bloom_cascade.build(universe, spark.createDataFrame([(k,) for k in [*listed, "outside", None]], "key string"))
    rows = spark.createDataFrame([(i, keys[i:i + 3] + [None]) for i in range(0, 3000, 2)] + [(-1, []), (-2, None)], "i int, keys array<string>")
    assert made.shards == 60 and len(made.parts(made.bytes() // 3)) > 2
    for most in (bloom_cascade.BROADCAST_BYTES, made.bytes() // 3):
        for r in made.mark(rows, "keys", "hit", most).collect():
            assert r.hit == (None if r["keys"] is None else [k in listed for k in r["keys"]])


def test_no_join(spark):
    ship(spark)
    table = spark.createDataFrame([(1, "http://a.org/x")], "id long, url string")
    rows = url_filter.judge(table, spark.createDataFrame(RULES, "rule string, allow boolean"), spark.createDataFrame([("y",)], "key string"))
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_thin_pages(spark):
    pages = spark.createDataFrame([
        ("http://A/x?1", "<p>" + "w " * 4 + "</p>"), ("http://a/x#2", "w " * 9), ("http://b/", None), ("http://c/", "w<br>" * 9), (None, "w"),
    ], "url string, html string")
    assert sorted(r.key for r in url_filter.thin_pages(pages, 8).collect()) == ["", "b/"]
