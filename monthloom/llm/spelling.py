"""Spelling variants: words one edit apart, found by dense tiles of code-point matrices.

Two words are near if they differ by one inserted, deleted or replaced code
point, which is the case exactly if the lengths of their common prefix and
common suffix add up to the longer length minus one or more.  A single edit
leaves the first or the last half of the shorter word whole, so words are
grouped by their length (and that of words one shorter) with their first, and
again with their last, half.  A group is cut into blocks of at most ``BLOCK``
words; every pair of its blocks is a tile, in which padded matrices of code
points, aligned left and right, are compared as a whole.  A pair that meets in
both of its groups counts in the first.  Out of a tile come, for each word, the
number of its near words and the most frequent one, never the pairs.

A group of any size is spread over its tiles; nothing is capped.  Very long
words make smaller blocks, so a tile's matrices stay bounded.

Defined results: a null text has no words; a null document id counts as empty in
the digest that decides which letters go; rows with equal ids are separate
occurrences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.arrow import whole_groups
from monthloom.session import written

RUN = r"[A-Za-zÀ-ÿ]+"
BLOCK = 2048
BLOCK_POINTS = 1 << 20       # code points of a block
TILE_POINTS = 1 << 23        # code points compared at once
TASK_PAIRS = 8_000_000       # pairs of words that a task is planned for
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = ["size", "side", "half", "a", "b"]
_FIRST, _LAST = 0, 1


def word_counts(docs: DataFrame, least_length: int, least_count: int, every: int | None = None) -> DataFrame:
    """(word, n): frequent words; one in ``every`` runs loses a letter, chosen by the digest of its document and itself."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if every is not None:
        digest = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word"))
        runs = runs.withColumn("h", digest).select(F.when(F.col("h") % every == 0, _without(
            F.col("word"), (F.col("h") % F.length("word")).cast("int"))).otherwise(F.col("word")).alias("word"))
    return runs.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= least_count)


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


# ----------------------------------------------------------------------- tiles


def _points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded at the right, the same from the end, and the lengths."""
    sizes = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flat = flat.astype(np.uint8) if len(flat) and flat.max() < 256 else flat
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.zeros((2, len(words), width), dtype=flat.dtype)
    left[row, place] = flat
    right[row, np.repeat(sizes, sizes) - 1 - place] = flat
    return left, right, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of a with every row of b; rows that are equal give 0."""
    return (a[:, None, :] != b[None]).argmax(axis=2)


def _near_in_tile(one, other, size: int, side: int):
    """Pairs (rows of one, rows of other) of words one edit apart, in chunks of bounded size."""
    step = max(1, TILE_POINTS // max(1, len(other[2]) * one[0].shape[1]))
    for at in range(0, len(one[2]), step):
        part = slice(at, at + step)
        before, after = _common(one[0][part], other[0]), _common(one[1][part], other[1])
        longer = np.maximum(one[2][part][:, None], other[2][None])
        # pairs that share their first half meet in its group, and only there
        yield at, (before + after >= longer - 1) & ((before >= size // 2) == (side == _FIRST))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, best_n, best): for each word with near words in a tile, their number and the most frequent."""
    for group in whole_groups(batches, _KEYS):
        size, side, a, b = (group.column(k)[0].as_py() for k in ("size", "side", "a", "b"))
        words, n = group.column("word").to_pylist(), group.column("n").to_numpy()
        # from the most frequent, so that the first hit of a row is its best
        order = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])))
        block = group.column("block").to_numpy()[order]
        words, n = [words[k] for k in order], n[order]
        points = _points(words, size + 1)
        found: dict[int, tuple[int, int]] = {}

        def add(rows, counts, best):
            for r, c, w in zip(rows.tolist(), counts.tolist(), best.tolist()):
                known = found.get(r, (0, w))
                found[r] = (known[0] + c, min(known[1], w))

        short = points[2] == size
        for mine, others in (((block == a) & short, (block == b)), ((block == a) & ~short, (block == b) & short)):
            mine, others = np.flatnonzero(mine), np.flatnonzero(others)
            if a == b:
                if not short[mine].all():
                    continue  # those pairs were met from the shorter side
            if not len(mine) or not len(others):
                continue
            one, other = tuple(p[mine] for p in points), tuple(p[others] for p in points)
            for at, near in _near_in_tile(one, other, size, side):
                near &= mine[at:at + len(near)][:, None] != others[None]
                rows = np.flatnonzero(near.any(axis=1))
                add(mine[at + rows], near[rows].sum(axis=1), others[near[rows].argmax(axis=1)])
                if a == b:  # pairs of short words are seen from both sides already
                    near = near & ~short[others][None]
                columns = np.flatnonzero(near.any(axis=0))
                add(others[columns], near[:, columns].sum(axis=0), mine[at + near[:, columns].argmax(axis=0)])
        if found:
            rows = sorted(found)
            best = [found[r][1] for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([words[r] for r in rows]), pa.array([found[r][0] for r in rows], type=pa.int64()),
                pa.array(n[best], type=pa.int64()), pa.array([words[k] for k in best]),
            ], names=["word", "near", "best_n", "best"])


def _grouped(words: DataFrame) -> DataFrame:
    """Each word in its groups: by the size of the shorter words, with the first and the last half of that size."""
    length = F.length("word")
    rows = words.withColumn("size", F.explode(F.array(length - 1, length))).withColumn("side", F.explode(F.array(F.lit(_FIRST), F.lit(_LAST))))
    half = (F.col("size") / 2).cast("int")
    part = F.when(F.col("side") == _FIRST, F.substring(F.col("word"), F.lit(1), half)).otherwise(
        F.substring(F.col("word"), length - half + 1, half))
    return rows.select("word", "n", "size", "side", F.xxhash64(part).alias("half"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has near words, from (word, n) with distinct words."""
    rows = written(_grouped(words), "halves")
    own = (F.length("word") == F.col("size")).cast("long")
    groups = rows.groupBy("size", "side", "half").agg(F.sum(own).alias("short"), F.count(F.lit(1)).alias("all"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_POINTS) / (F.col("size") + 1))))
    groups = written(groups.filter("short > 0 AND all > 1").withColumn("blocks", F.ceil(F.col("all") / most).cast("int")), "groups")
    pairs = groups.agg(F.sum(F.col("short").cast("double") * F.col("all"))).first()[0] or 0.0
    dealt = rows.join(groups, ["size", "side", "half"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "word"), "blocks").cast("int"))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "size", "side", "half", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "word", "n")
    # the work of a tile is in its pairs, not in its bytes
    tasks = max(1, math.ceil(pairs / TASK_PAIRS), int(words.sparkSession.sparkContext.defaultParallelism))
    found = tiled.repartition(tasks, *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(
        _tiles, "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("top")
    ).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


# ----------------------------------------------------------------------- forms


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    A word's form is its most frequent near word, if that is ``times`` as
    frequent; the root is reached by following forms.  Counts grow by that
    factor with every step, so the number of steps is known beforehand, and
    each join doubles them.
    """
    if times < 2:
        raise ValueError("forms have to be more frequent than their words")
    words = written(words.select("word", "n"), "words")
    joined = words.join(near_words(words), "word", "left")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
                         F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    rows = written(rows, "forms")
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, times)))
    for _ in range(math.ceil(math.log2(steps))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
