"""URL filter: allow and block rules and a block list, looked up in Bloom filter cascades.

A rule is a host and the beginning of a path (``example.org/es/``).  It fits its
host and all subdomains, for paths that start with the rule's.  What a URL could
be ruled by is enumerable: the last labels of its host, in the numbers of labels
that rules have, each with the beginning of its path, in the lengths that rules
have.  These candidates of all URLs are the key universe of two cascades, one
for the rules that allow and one for those that block; the longest candidate
held by either is the rule.  URLs without a rule are blocked if their key (host
and path) is on the block list, which is a third cascade over the keys of all
URLs, and allowed otherwise.  Rules and list are tables of any size and meet the
URLs in no join.

Defined results: a null URL or one without ``://`` has empty host and path, no
rule, and is judged by its empty key; of two equally long rules the one with the
longer host wins, of equal ones the one that blocks; rows with equal or null ids
are judged one by one; an empty table gives no rows; other columns are ignored.
Long URLs are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm import bloom_cascade
from monthloom.llm.words import count_words
from monthloom.session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THIN_WORDS = 100


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The (labels of the host, length of the path) that rules have: a short list of small numbers."""
    own = F.regexp_extract("rule", "^[^/]*", 0)
    labels = F.size(F.split(own, r"\."))
    found = rules.select(labels.alias("labels"), (F.length("rule") - F.length(own)).alias("length")).distinct().collect()
    return sorted((r["labels"], r["length"]) for r in found)


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """The rules that could fit, longest first; of equally long ones the longer host first."""
    made = [F.when(F.length("path") >= length, F.struct(
        F.length(own).alias("own"), F.concat(own, F.substring("path", 1, length)).alias("rule")))
        for labels, length in shapes for own in [F.substring_index("host", ".", -labels)]]
    if not made:
        return F.array().cast("array<string>")
    found = F.filter(F.array(*made), lambda c: c.isNotNull())
    order = F.array_sort(F.transform(found, lambda c: F.struct(
        (-F.length(c["rule"])).alias("n"), (-c["own"]).alias("own"), c["rule"].alias("rule"))))
    return F.array_distinct(F.transform(order, lambda c: c["rule"]))


def judge(urls: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, url) with host, path, rule, listed and verdict; ``rules`` is (rule, allow), ``listed`` one column of keys."""
    shapes = _shapes(rules)
    rows = urls.select("id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("candidates", _candidates(shapes)).withColumn("keys", F.array(F.concat("host", "path")))
    rows = written(rows, "urls")
    universe = written(rows.select(F.explode("candidates").alias("key")).distinct(), "candidates")
    allowing = bloom_cascade.build(universe, rules.filter("allow").select("rule"))
    blocking = bloom_cascade.build(universe, rules.filter("NOT allow").select("rule"))
    blocked = bloom_cascade.build(rows.select(F.col("keys")[0]), listed)
    rows = allowing.mark(rows, "candidates", "allowed_by")
    rows = blocking.mark(rows, "candidates", "blocked_by")
    rows = blocked.mark(rows, "keys", "on_list")
    place = F.array_position(F.zip_with("allowed_by", "blocked_by", lambda a, b: a | b), F.lit(True))
    rule = F.when(place > 0, F.get("candidates", (place - 1).cast("int")))
    by_list = F.col("on_list")[0]
    return rows.select(
        "id", "url", "host", "path", rule.alias("rule"), by_list.alias("listed"),
        F.when(F.when(place > 0, F.get("blocked_by", (place - 1).cast("int"))).otherwise(by_list), "block").otherwise(
            "allow").alias("verdict"))


def thin_pages(pages: DataFrame, least: int = THIN_WORDS) -> DataFrame:
    """(key): hosts and paths whose pages all hold fewer words than that outside of tags, a block list from the pages."""
    n = count_words(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    own = F.concat(host(F.col("url")), path(F.col("url")))
    return pages.groupBy(own.alias("key")).agg(F.max(n).alias("n")).filter(F.col("n") < least).select("key")
