"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet each source's token target and stay within
the limit, the ones closest to one copy each (in relative entropy) are
exponential in the document's size: min(limit, exp(a x)), with one number a per
source.  It is the root of a monotone function, found for all sources at once
by Newton steps inside a shrinking bracket.  A step is one aggregate over the
table of (source, size, number of documents), not over documents.  Its sums are
decimals, so they don't depend on the order of rows and reruns agree.

Rates become copies by cumulative rounding from the longest documents to the
shortest, so a source misses its target by a fraction of one long document at
most; three corrections by the copy of one fitting document bring it closer.
Documents of one source and size are dealt to cells of some hundred by a hash,
and the copies of a cell go to its documents in hash order.  The running sums
have two levels: cells within chunks of ``CHUNK_CELLS``, and chunks within a source.
A window over a source thus sees its distinct sizes and a millionth of its
documents.  Targets are settled in a window over the table of sources.

Defined results: a null or empty text has size 0 and is taken once (0 words);
texts of any length are counted whole; the null source comes last; repeated rows
are documents of their own; an empty table gives no rows; extra columns are
ignored.  Sources whose tilt isn't found in ``MOST_STEPS`` steps stop the job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.words import count_words
from monthloom.session import written

WEIGHTS = (1, 2, 3)
LIMIT = 3               # copies of a document, and target against size of a source
CELL_DOCUMENTS = 256
CHUNK_CELLS = 4096
TOLERANCE = 1e-9        # of the logarithm of tokens against target
MOST_STEPS = 60
CORRECTIONS = 3
BROADCAST_ROWS = 500_000  # numbers of copies that are broadcast to the texts; beyond, both are joined by key
_EXACT = "decimal(38,8)"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(no_source, source_key, source_size, target) from rows with size.

    The share of a source below its limit is level * weight.  In the order of
    limit / weight, the level that would hold if all sources before were at
    their limit rises up to the true one and falls after it.
    """
    sums = sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    # rows of these windows are sources, not documents
    place = F.row_number().over(Window.orderBy("no_source", "source_key"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sums.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * limit)
    filling = Window.orderBy(F.col("most") / F.col("weight"), "no_source", "source_key")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    ) / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.select("no_source", "source_key", "source_size", F.least(
        F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, limit: int) -> Column:
    """Copies expected of a document; a null tilt stands for the limit."""
    return F.when(size == 0, F.lit(1.0)).when(tilt.isNull(), F.lit(float(limit))).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.least(tilt * size / mean, F.lit(math.log(limit) + 1)))))


def tilts(cells: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(no_source, source_key, mean, tilt): the dual variable of every source.

    ``cells`` is a written table (no_source, source_key, size, n).  Each step
    is written as well, which keeps the plan short and survives lost executors.
    """
    keys = ["no_source", "source_key"]
    ranges = cells.filter("size > 0").groupBy(*keys).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    share = F.col("target") / F.col("source_size")
    unit = F.col("least") / F.col("mean")  # of the shortest document
    state = written(targets.join(ranges, keys).select(
        *keys, "mean", "target", (share >= limit).alias("full"),
        (F.least(F.log(F.greatest(share, F.lit(1e-300))), F.lit(0.0)) / unit).alias("low"),
        (F.lit(math.log(limit)) / unit).alias("high"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("miss"),
    ), "tilts")
    for _ in range(MOST_STEPS):
        x, rate = F.col("size"), _rate(F.col("tilt"), F.col("size"), F.col("mean"), limit)
        tokens = F.col("n") * x * rate
        slope = F.when(rate < limit, tokens * x / F.col("mean")).otherwise(F.lit(0.0))
        sums = cells.filter("size > 0").join(state.filter("not full"), keys).groupBy(*keys).agg(
            F.sum(tokens.cast(_EXACT)).cast("double").alias("_tokens"), F.sum(slope.cast(_EXACT)).cast("double").alias("_slope"))
        miss = F.log(F.greatest(F.col("_tokens"), F.lit(1e-8))) - F.log("target")
        newton = F.col("tilt") - F.col("miss") * F.col("_tokens") / F.col("_slope")
        middle = (F.col("low") + F.col("high")) / 2
        inside = (F.col("_slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        state = written(
            state.join(sums, keys, "left").withColumn("miss", F.coalesce(miss, F.lit(0.0)))
            .withColumn("low", F.when(F.col("miss") < 0, F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(F.col("miss") > 0, F.col("tilt")).otherwise(F.col("high")))
            .withColumn("tilt", F.when(F.abs("miss") <= TOLERANCE, F.col("tilt"))
                        .when(inside, newton).otherwise(middle))
            .drop("_tokens", "_slope"), "tilts")
        if not state.filter((F.abs("miss") > TOLERANCE) & (F.col("high") - F.col("low") > 1e-13)).limit(1).count():
            break
    else:
        raise RuntimeError(f"the tilts of some sources are not settled after {MOST_STEPS} steps")
    return state.select(*keys, "mean", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def _corrected(groups: DataFrame, targets: DataFrame, parts: list[str], limit: int) -> DataFrame:
    """One copy more or less in each source, of the size nearest to what it misses its target by."""
    keys = parts[:2]
    sums = groups.groupBy(*keys).agg(F.sum(F.col("_copies") * F.col("size")).alias("_taken"))
    missing = sums.join(targets, keys).select(*keys, (F.col("target") - F.col("_taken")).alias("_missing"))
    step = F.signum("_missing").cast("long")
    after = F.col("_copies") + step
    away = F.abs(F.abs("_missing") - F.col("size"))
    fits = (F.col("size") > 0) & (away < F.abs("_missing")) & (after >= 0) & (after <= F.col("n") * limit)
    chosen = groups.join(missing, keys).filter(fits).groupBy(*keys).agg(
        F.min(F.struct(away.alias("away"), F.col("size"), F.col("part"), step.alias("step"))).alias("_best"))
    return groups.join(chosen, keys, "left").withColumn("_copies", F.col("_copies") + F.when(
        (F.col("size") == F.col("_best.size")) & (F.col("part") == F.col("_best.part")), F.col("_best.step")
    ).otherwise(F.lit(0))).drop("_best")


def _rounded(groups: DataFrame, cell: list[str]) -> DataFrame:
    """Copies of every cell: differences of the rounded running sum from the longest size down, exact in billionths."""
    exact = "decimal(38,0)"
    rows = groups.withColumns({
        "_mass": (F.col("rate") * F.col("n")).cast(exact), "chunk": F.floor(F.col("part") / CHUNK_CELLS)})
    chunks = rows.groupBy(*cell, "chunk").agg(F.sum("_mass").cast(exact).alias("_chunk_mass"))
    down = Window.partitionBy(*cell[:-1]).orderBy(F.col("size").desc(), "chunk")
    before = (F.sum("_chunk_mass").over(down) - F.col("_chunk_mass")).alias("_before")
    rows = rows.join(chunks.select(*cell, "chunk", before), [*cell, "chunk"])
    upto = F.col("_before") + F.sum("_mass").over(Window.partitionBy(*cell, "chunk").orderBy("part"))
    given, earlier = (F.floor((m + 500_000_000) / 1_000_000_000).cast("long") for m in (upto, upto - F.col("_mass")))
    return rows.select(*cell, "part", "n", (given - earlier).alias("_copies"))


def mix(docs: DataFrame, id_column: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(id, size, source_size, target, copies, taken) per row of ``docs``."""
    keys, cell = ["no_source", "source_key"], ["no_source", "source_key", "size"]
    sized = written(docs.select(
        F.col(id_column).alias("id"), F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"), count_words(F.col("text")).alias("size"),
    ).withColumn("place", F.xxhash64("id")), "sizes")
    cells = written(sized.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = written(source_targets(
        cells.select(*keys, (F.col("size") * F.col("n")).alias("size")), weights, limit), "targets")
    rates = cells.join(tilts(cells, targets, limit), keys, "left").withColumn(
        "rate", _rate(F.col("tilt"), F.col("size"), F.col("mean"), limit)
    ).select(*cell, F.ceil(F.col("n") / CELL_DOCUMENTS).alias("parts"), F.round(F.col("rate") * 1e9).cast("long").alias("rate"))
    dealt = sized.join(rates, cell).withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")))
    dealt = written(dealt.drop("parts"), "dealt")
    parts = [*cell, "part"]
    groups = dealt.groupBy(*cell, "part", "rate").agg(F.count(F.lit(1)).alias("n"))
    groups = written(_rounded(groups, cell), "groups")
    for _ in range(CORRECTIONS):
        groups = written(_corrected(groups, targets, parts, limit), "groups")
    order = Window.partitionBy(*cell, "part").orderBy("place", "id")
    rows = dealt.withColumn("_rank", F.row_number().over(order)).join(groups, parts).join(targets, keys)
    copies = F.floor(F.col("_copies") / F.col("n")) + (F.col("_rank") <= F.col("_copies") % F.col("n")).cast("long")
    return rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("long")).select(
        F.col("id").alias(id_column), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    numbered = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    numbered = written(numbered, "numbered", compression="zstd")
    copies = mix(numbered.select("row", "doc.text", "doc.source"), "row", weights, limit).select("row", "copies")
    copies = written(copies, "copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    return numbered.join(copies, "row").filter("copies > 0").select(
        "doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
