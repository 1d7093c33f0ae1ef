"""Quality rules per document and host verdicts shrunk by an empirical beta prior.

Every document is measured by column expressions and judged by two rules: at
least 20 words, and at most 30 % of the words in 8-word windows that occur
twice or more.  Failures are counted per host (the ``source`` column).  The
rates of all hosts give a beta prior by the method of moments; a host's rate is
shrunk towards it, so a host with few documents needs more evidence.  Hosts
whose shrunk rate is above the limit are rejected with all their documents.

Only counts per host are shuffled, combined on the map side.  The verdicts
come back as the list of rejected hosts: broadcast while it is short, joined
by key beyond that.

Defined results: a null text has no words and fails; texts of any length are
measured whole; documents with a null source form a host of their own; repeated
rows count as often as they occur; an empty table gives no rows; other columns
are ignored by the table and kept by the filter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.words import let, words
from monthloom.session import written

LEAST_WORDS = 20
MOST_REPEATED = 30      # per cent of the words
WINDOW = 8
HOST_LIMIT = 0.5        # shrunk failure rate above which a host is rejected
FLAT_STRENGTH = 1000.0  # documents the prior counts for where hosts don't differ
BROADCAST_HOSTS = 10_000


def _repeated_words(ws: Column) -> Column:
    """Words covered by windows that occur more than once in the text."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    def starts(ordered: Column) -> Column:
        again = F.transform(ordered, lambda x, j: F.when(
            (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(again, lambda i: i.isNotNull()))

    def counted(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(
            let(let(ordered, starts), covered))

    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(let(hashes, counted))


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def measured(docs: DataFrame) -> DataFrame:
    """The input with a struct ``_quality`` of counts and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = docs.withColumn("_quality", let(words(F.col("text")), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _repeated_lines(text).cast("long").alias("n_dup_lines"),
        _repeated_words(ws).cast("long").alias("n_repeat_words"),
    )))
    q = F.col("_quality")
    failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])
    return counts.withColumn("_quality", q.withField("base_failed", failed))


def host_rates(rows: DataFrame) -> DataFrame:
    """Per host: documents, failures and the failure rate shrunk to the prior.

    ``rows`` needs ``source`` and ``_quality``.  With mean m and variance v of
    the hosts' rates the prior counts for m(1 - m)/v - 1 documents.  The rates of
    small hosts also vary by chance: of the variance over hosts, the mean of
    m(1 - m)/n is no difference between hosts and taken off.  Where nothing is
    left, hosts don't differ, and the prior counts for ``FLAT_STRENGTH``.
    """
    hosts = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_quality.base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("c"))
    chance = F.col("m") * (1 - F.col("m"))
    prior = prior.withColumn("between", F.col("v") - chance * F.col("c"))
    # a variance of nothing but rounding is none
    prior = prior.select("m", F.when(
        F.col("between") > 1e-9, F.least(F.greatest(chance / F.col("between") - 1, F.lit(0.0)), F.lit(FLAT_STRENGTH))
    ).otherwise(F.lit(FLAT_STRENGTH)).alias("strength"))
    shrunk = hosts.withColumn("_prior", prior.select(F.struct("m", "strength")).scalar())
    strength = F.col("_prior.strength")
    return shrunk.select("source", "n", "failed", (
        (F.col("failed") + F.col("_prior.m") * strength) / (F.col("n") + strength)).alias("rate"))


def judged(rows: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Measured rows with ``kept``; they are read twice, so pass a written table."""
    rejected = written(host_rates(rows).filter(F.col("rate") > host_limit).select(
        F.col("source").alias("_host"), F.lit(True).alias("_rejected")), "hosts")
    if rejected.count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    return rows.join(rejected, F.col("source").eqNullSafe(F.col("_host")), "left").withColumn(
        "kept", ~F.col("_quality.base_failed") & F.col("_rejected").isNull()).drop("_host", "_rejected")


def quality_table(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) per document."""
    rows = written(measured(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_quality"), "quality")
    return judged(rows).select("doc_id", "_quality.*", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; the text is measured once."""
    whole = docs.select(F.struct("*").alias("doc"), "text", "source")
    return judged(written(measured(whole).select("doc", "source", "_quality"), "quality", compression="zstd")).filter("kept").select("doc.*")
