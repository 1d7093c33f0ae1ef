"""Histogram trees: boosting with L1 and L2 on leaves, grown by level, by best leaf or symmetrically.

Columns are cut at quantiles once.  A split is chosen from sums of gradients and
curvatures per (node, column, bin): the gain of cutting after a bin is
``s(left) + s(right) - s(node)`` with ``s = soft(G, l1)^2 / (H + l2)``, and a leaf is worth
``-soft(G, l1) / (H + l2)``.  With squared loss a row's curvature is its weight, one.

Large tables are grown by Spark: one aggregate per level gives the sums of all
open nodes, windows over bins (a bounded number) give the running sums, and one
row per open node comes back.  Tables of at most ``SMALL_CELLS`` numbers are
grown by arrays inside one task instead, with the same choices; fits of many
settings then run side by side (``many_fits``).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions import maths
from monthloom.session import written

SMALL_CELLS = 4_000_000
KEEP_EVERY = 8         # trees between two written tables of running predictions
CHUNK_CELLS = 1 << 21  # sums looked at at once by the array version
TIE = 1e-9             # share by which a gain may fall short of the best and still count as equal


@dataclass(frozen=True)
class Growth:
    """How trees are grown; ``leaves`` bounds a tree grown by best leaf first, ``columns`` is per node."""

    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    leaves: int = 0
    symmetric: bool = False
    least_rows: float = 1.0
    least_gain: float = 0.0
    row_share: float = 1.0
    columns: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in arrays: column (-1 for a leaf), threshold, left child (the right one follows), value."""

    base: float
    roots: list[int]
    column: list[int]
    threshold: list[float]
    left: list[int]
    value: list[float]
    depth: int

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> "Trees":
        return Trees(**json.loads(text))

    def first(self, n: int) -> "Trees":
        """The first n trees."""
        return replace(self, roots=self.roots[:n])


# --------------------------------------------------------------------- scoring


def _array(values, kind: str) -> Column:
    return maths.constant(np.asarray(values, dtype=float if kind == "double" else int).tolist(), f"array<{kind}>")


def predicted(values: Column, trees: Trees) -> Column:
    """The prediction for an array of column values, as one expression that walks the node table.

    Its size does not depend on the number of nodes.
    """
    if not trees.roots:
        return F.lit(trees.base)
    steps = F.sequence(F.lit(1), F.lit(max(trees.depth, 1)))
    held = F.struct(
        values.alias("x"), _array(trees.column, "int").alias("column"), _array(trees.left, "int").alias("left"),
        _array(trees.threshold, "double").alias("threshold"), _array(trees.value, "double").alias("value"))

    def walked(row: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            right = (F.get(row["x"], F.get(row["column"], node)) > F.get(row["threshold"], node)).cast("int")
            return F.when(F.get(row["column"], node) < 0, node).otherwise(F.get(row["left"], node) + right)

        return F.aggregate(_array(trees.roots, "int"), F.lit(float(trees.base)),
                           lambda total, root: total + F.get(row["value"], F.aggregate(steps, root, down)))

    return maths.once(held, walked)


def predict_arrays(x: np.ndarray, trees: Trees) -> np.ndarray:
    """(trees, rows): what every tree adds, for a matrix of column values."""
    column, left, threshold = np.array(trees.column), np.array(trees.left), np.array(trees.threshold)
    node = np.repeat(np.array(trees.roots, dtype=np.int64)[:, None], len(x), axis=1)
    rows = np.arange(len(x))[None]
    for _ in range(trees.depth):
        at = column[node]
        node = np.where(at < 0, node, left[node] + (x[rows, np.maximum(at, 0)] > threshold[node]))
    return np.array(trees.value)[node]


# --------------------------------------------------------------- array version


def _soft(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _worth(g, h, how: Growth):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + how.l2 > 0, _soft(g, how.l1) ** 2 / (h + how.l2), 0.0)


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every column, each a value that occurs."""
    shares = np.arange(1, bins) / bins
    found = []
    for k in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, k], shares, method="inverted_cdf"))
        found.append(cuts)
    return found


class _Histogram:
    """Rows as places in one line of all bins of all columns."""

    def __init__(self, x: np.ndarray, edges: list[np.ndarray]):
        sizes = np.array([len(e) + 1 for e in edges])
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.cells = int(sizes.sum())
        self.owner = np.repeat(np.arange(len(edges)), sizes)
        self.last = np.zeros(self.cells, dtype=bool)
        self.last[self.first + sizes - 1] = True
        self.edges = edges
        self.codes = np.stack([self.first[k] + np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)

    def threshold(self, cell: int) -> float:
        k = int(self.owner[cell])
        return float(self.edges[k][cell - self.first[k]])

    def left_sums(self, rows, local, n, weights):
        """(n, cells): the sum over rows of each node up to each bin of each column."""
        at = (local[:, None] * self.cells + self.codes[rows]).ravel()
        sums = np.bincount(at, weights=np.repeat(weights, self.codes.shape[1]), minlength=n * self.cells).reshape(n, self.cells)
        running = np.cumsum(sums, axis=1)
        before = np.where(self.first > 0, running[:, np.maximum(self.first - 1, 0)], 0.0)
        return running - before[:, self.owner]

    def gains(self, rows, local, n, g, h, how: Growth, totals):
        gl, hl = self.left_sums(rows, local, n, g), self.left_sums(rows, local, n, h)
        gt, ht = (t[:, None] for t in totals)
        gain = _worth(gl, hl, how) + _worth(gt - gl, ht - hl, how) - _worth(gt, ht, how)
        if how.symmetric:
            gain[:, self.last] = -np.inf
            return gain
        fits = (hl >= how.least_rows) & (ht - hl >= how.least_rows) & ~self.last
        return np.where(fits, gain, -np.inf)


class _Grown:
    """Node arrays that trees are added to."""

    def __init__(self):
        self.column, self.threshold, self.left, self.value, self.depth = [], [], [], [], 0

    def leaf(self, value: float) -> int:
        self.column.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.value.append(float(value))
        return len(self.value) - 1

    def split(self, node: int, column: int, threshold: float, low: float, high: float) -> int:
        self.column[node], self.threshold[node] = int(column), float(threshold)
        self.left[node] = self.leaf(low)
        self.leaf(high)
        return self.left[node]

    def trees(self, base: float, roots: list[int]) -> Trees:
        return Trees(float(base), roots, self.column, self.threshold, self.left, self.value, self.depth)


def _first_best(gain: np.ndarray) -> np.ndarray:
    """For each row the first of the cells with the best gain, whatever the order of a sum."""
    best = gain.max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        return (gain >= best - TIE * np.abs(best)).argmax(axis=1)


def _leaf_value(g, h, how: Growth):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + how.l2 > 0, -_soft(g, how.l1) / (h + how.l2), 0.0)


def _totals(local, n, g, h):
    return np.bincount(local, weights=g, minlength=n), np.bincount(local, weights=h, minlength=n)


def _node_columns(draw, n: int, d: int, share: float) -> np.ndarray | None:
    """Which columns each node may use."""
    count = max(1, math.ceil(share * d - 1e-9))
    if count >= d:
        return None
    return draw.random((n, d)).argsort(axis=1).argsort(axis=1) < count


def grow_levels(hist: _Histogram, rows, root, g, h, roots: int, how: Growth, draw, grown: _Grown) -> list[int]:
    """Some trees at once, level by level: ``root`` names the tree of each entry of ``rows``."""
    gt, ht = _totals(root, roots, g, h)
    ids = np.array([grown.leaf(v) for v in _leaf_value(gt, ht, how)])
    made, local = ids.tolist(), root
    for level in range(how.depth):
        if not len(rows):
            break
        n = len(ids)
        per, best, cell = max(1, CHUNK_CELLS // hist.cells), np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
        order = np.argsort(local, kind="stable")
        rows, local, g, h = rows[order], local[order], g[order], h[order]
        total, chunks = np.zeros(hist.cells), range(0, n, per)
        for a in chunks:
            b = min(n, a + per)
            part = slice(*np.searchsorted(local, [a, b]))
            gain = hist.gains(rows[part], local[part] - a, b - a, g[part], h[part], how, (gt[a:b], ht[a:b]))
            allowed = _node_columns(draw, b - a, len(hist.edges), how.columns)
            if how.symmetric:
                total += gain.sum(axis=0)
                continue
            if allowed is not None:
                gain = np.where(allowed[:, hist.owner], gain, -np.inf)
            cell[a:b] = _first_best(gain)
            best[a:b] = gain[np.arange(b - a), cell[a:b]]
        if how.symmetric:
            cell[:], best[:] = _first_best(total[None])[0], total.max()
        going = best > how.least_gain
        if not going.any():
            break
        # rows of split nodes move to the left or the right child
        keep = going[local]
        rows, local, g, h = rows[keep], local[keep], g[keep], h[keep]
        number = np.cumsum(going) - 1
        right = hist.codes[rows, hist.owner[cell[local]]] > cell[local]
        local = 2 * number[local] + right
        split = np.flatnonzero(going)
        gt, ht = _totals(local, 2 * len(split), g, h)
        values = _leaf_value(gt, ht, how)
        ids = np.array([child for k, node in enumerate(split) for first in [grown.split(
            ids[node], hist.owner[cell[node]], hist.threshold(cell[node]), values[2 * k], values[2 * k + 1])] for child in (first, first + 1)])
        grown.depth = max(grown.depth, level + 1)
    return made


def grow_best_first(hist: _Histogram, rows, g, h, how: Growth, draw, grown: _Grown) -> int:
    """One tree whose best leaf is split next, until it has ``leaves``."""
    def candidates(nodes, sides, level):
        """(gain, node, rows, cell, level) for each of some leaves that can be split."""
        if how.depth and level >= how.depth:
            return []
        local = np.repeat(np.arange(len(nodes)), [len(s) for s in sides])
        own = np.concatenate(sides)
        gain = hist.gains(rows[own], local, len(nodes), g[own], h[own], how, _totals(local, len(nodes), g[own], h[own]))
        allowed = _node_columns(draw, len(nodes), len(hist.edges), how.columns)
        if allowed is not None:
            gain = np.where(allowed[:, hist.owner], gain, -np.inf)
        cells = _first_best(gain)
        return [(gain[k, c], node, side, int(c), level) for k, (node, side, c) in enumerate(zip(nodes, sides, cells))
                if gain[k, c] > how.least_gain]

    root = grown.leaf(_leaf_value(g.sum(), h.sum(), how))
    open_, leaves = candidates([root], [np.arange(len(rows))], 0), 1
    while leaves < how.leaves and open_:
        best = max(range(len(open_)), key=lambda k: (open_[k][0], -open_[k][1]))
        _, node, own, cell, level = open_.pop(best)
        right = hist.codes[rows[own], hist.owner[cell]] > cell
        sides = [own[~right], own[right]]
        values = [_leaf_value(g[s].sum(), h[s].sum(), how) for s in sides]
        first = grown.split(node, hist.owner[cell], hist.threshold(cell), *values)
        grown.depth, leaves = max(grown.depth, level + 1), leaves + 1
        if leaves < how.leaves:
            open_ += candidates([first, first + 1], sides, level + 1)
    return root


def boost_arrays(x: np.ndarray, y: np.ndarray, how: Growth) -> Trees:
    """Boosting on squared loss from the mean of the target."""
    hist, draw, grown = _Histogram(x, edges_of(x, how.bins)), np.random.default_rng(how.seed), _Grown()
    base, roots = float(y.mean()), []
    score = np.full(len(y), base)
    for _ in range(how.rounds):
        rows = np.arange(len(y))
        if how.row_share < 1:
            rows = np.flatnonzero(draw.random(len(y)) < how.row_share)
        g, h = (score - y)[rows], np.ones(len(rows))
        if how.leaves:
            root = grow_best_first(hist, rows, g, h, how, draw, grown)
        else:
            root = grow_levels(hist, rows, np.zeros(len(rows), dtype=np.int64), g, h, 1, how, draw, grown)[0]
        for k in range(root, len(grown.value)):
            grown.value[k] *= how.step
        score += predict_arrays(x, replace(grown.trees(0.0, [root])))[0]
        roots.append(root)
    return grown.trees(base, roots)


def forest_arrays(x: np.ndarray, y: np.ndarray, how: Growth, at_once: int = 10) -> Trees:
    """A forest of ``rounds`` trees on bootstrap samples; what a tree adds is its mean over their number.

    Every tree has its own seed, so a smaller forest is the beginning of a larger one.
    """
    hist, grown, roots = _Histogram(x, edges_of(x, how.bins)), _Grown(), []
    how = replace(how, l1=0.0, l2=0.0)
    for begin in range(0, how.rounds, at_once):
        some = range(begin, min(begin + at_once, how.rounds))
        rows, root, weight = [], [], []
        for k, tree in enumerate(some):
            n = np.random.default_rng([how.seed, tree]).poisson(1.0, len(y))
            own = np.flatnonzero(n)
            rows.append(own)
            root.append(np.full(len(own), k))
            weight.append(n[own].astype(float))
        rows, root, weight = (np.concatenate(v) for v in (rows, root, weight))
        draw = np.random.default_rng([how.seed, begin, 1])
        roots += grow_levels(hist, rows, root, -y[rows] * weight, weight, len(some), how, draw, grown)
    return grown.trees(0.0, roots)


# --------------------------------------------------------------- Spark version


def _soft_column(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def _worth_column(g: Column, h: Column, how: Growth) -> Column:
    held = h + how.l2
    soft = _soft_column(g, how.l1)
    return F.when(held > 0, soft * soft / held).otherwise(0.0)


def edges(rows: DataFrame, n: int, bins: int) -> list[list[float]]:
    """Quantiles of every column of the array ``x`` by mergeable sketches; a bounded list each."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(k)), shares, 10_000).alias(f"q{k}") for k in range(n)]).first()
    return [sorted(set(q or [])) for q in found]


def binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """The rows with ``bins``, the number of cuts below each value."""
    held = maths.constant([[float(v) for v in c] for c in cuts], "array<array<double>>")
    return rows.withColumn("bins", F.zip_with("x", held, lambda v, c: F.size(F.filter(c, lambda e: e < v)).cast("short")))


def _node_of(grown: _Grown, root: int, cuts: list[list[float]]) -> Column:
    """The node of a tree in which a row ends, from its bins."""
    if grown.column[root] < 0:
        return F.lit(root)
    own = range(root, len(grown.value))
    column = _array([grown.column[k] for k in own], "int")
    left = _array([grown.left[k] for k in own], "int")
    place = [cuts[grown.column[k]].index(grown.threshold[k]) if grown.column[k] >= 0 else 0 for k in own]
    cell = _array(place, "int")

    def down(node: Column, _: Column) -> Column:
        at = node - root
        right = (F.get("bins", F.get(column, at)) > F.get(cell, at)).cast("int")
        return F.when(F.get(column, at) < 0, node).otherwise(F.get(left, at) + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(grown.depth, 1))), F.lit(root), down)


def _sums(rows: DataFrame, nodes: list[int]) -> DataFrame:
    """(node, column, bin, g, h): one aggregate for all open nodes."""
    cells = rows.filter(F.col("node").isin(nodes)).select("node", "g", F.posexplode("bins").alias("column", "bin"))
    return cells.groupBy("node", "column", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).cast("double").alias("h"))


def _candidates(sums: DataFrame, how: Growth) -> DataFrame:
    """(node, column, bin, gain, sums of both sides) of every cut that is allowed."""
    upto = Window.partitionBy("node", "column").orderBy("bin")
    whole = Window.partitionBy("node", "column")
    cut = sums.select("node", "column", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
                      F.sum("g").over(whole).alias("gt"), F.sum("h").over(whole).alias("ht"))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = _worth_column(F.col("gl"), F.col("hl"), how) + _worth_column(gr, hr, how) - _worth_column(F.col("gt"), F.col("ht"), how)
    return cut.select("node", "column", "bin", gain.alias("gain"), "gl", "hl", gr.alias("gr"), hr.alias("hr"))


def _best(rows: DataFrame, nodes: list[int], how: Growth) -> dict[int, dict]:
    """The best cut of each open node that has one."""
    found = _candidates(_sums(rows, nodes), how).filter((F.col("hl") >= how.least_rows) & (F.col("hr") >= how.least_rows))
    if how.columns < 1:
        n = rows.select(F.size("bins")).first()[0]
        allowed = _node_columns(np.random.default_rng([how.seed, *nodes]), len(nodes), n, how.columns)
        if allowed is not None:
            pairs = [(F.col("node") == k) & F.col("column").isin(np.flatnonzero(a).tolist()) for k, a in zip(nodes, allowed)]
            found = found.filter(reduce(or_, pairs))
    top = F.max("gain").over(Window.partitionBy("node"))
    found = found.withColumn("top", top).filter(F.col("gain") >= F.col("top") - TIE * F.abs("top"))
    first = F.min(F.struct("column", "bin", (-F.col("gain")).alias("loss"), "gl", "hl", "gr", "hr")).alias("best")
    best = {r["node"]: r["best"].asDict() for r in found.groupBy("node").agg(first).collect()}
    return {k: v for k, v in best.items() if -v["loss"] > how.least_gain}


def _best_for_all(rows: DataFrame, nodes: list[int], cuts: list[list[float]], how: Growth) -> tuple[int, int] | None:
    """The one cut that gains most over all open nodes together."""
    grid = rows.sparkSession.createDataFrame([(k, list(range(len(c) + 1))) for k, c in enumerate(cuts)], "column int, bins array<int>")
    grid = grid.select("column", F.explode("bins").alias("bin")).withColumn("node", F.explode(_array(nodes, "int")))
    # a node without rows in a bin still has a value for the cut after it
    filled = grid.join(_sums(rows, nodes), ["node", "column", "bin"], "left").fillna(0.0, ["g", "h"])
    last = Window.partitionBy("node", "column")
    found = _candidates(filled, how).withColumn("last", F.max("bin").over(last)).filter("bin < last")
    gains = found.groupBy("column", "bin").agg(F.sum("gain").alias("gain"))
    gains = gains.withColumn("top", F.max("gain").over(Window.partitionBy()))  # one row per cut
    top = gains.filter(F.col("gain") >= F.col("top") - TIE * F.abs("top")).orderBy("column", "bin").first()
    return (top["column"], top["bin"]) if top is not None and top["gain"] > how.least_gain else None


def _grow(rows: DataFrame, cuts, how: Growth, grown: _Grown) -> int:
    """One tree from (bins, g); returns its root."""
    def worth(g, h):
        return float(_leaf_value(np.float64(g or 0), np.float64(h or 0), how))

    def placed():
        return rows.withColumn("node", _node_of(grown, root, cuts))

    total = rows.agg(F.sum("g"), F.count(F.lit(1))).first()
    root, depth = grown.leaf(worth(total[0], total[1])), grown.depth
    grown.depth = 0  # of this tree, while it grows
    open_ = {root: 0}
    if how.symmetric:
        for level in range(how.depth):
            cut = _best_for_all(placed(), list(open_), cuts, how)
            if cut is None:
                break
            sides = placed().withColumn("right", (F.get("bins", F.lit(cut[0])) > cut[1]).cast("int")).groupBy("node", "right").agg(
                F.sum("g").alias("g"), F.count(F.lit(1)).alias("h")).collect()
            sums = {(r["node"], r["right"]): (r["g"], r["h"]) for r in sides}
            first = [grown.split(node, cut[0], cuts[cut[0]][cut[1]], worth(*sums.get((node, 0), (0, 0))), worth(*sums.get((node, 1), (0, 0))))
                     for node in open_]
            open_ = {f + k: level + 1 for f in first for k in (0, 1)}
            grown.depth = level + 1
    else:
        leaves, found = 1, {}
        while open_ or found:
            if open_:
                found.update({k: (v, open_[k]) for k, v in _best(placed(), list(open_), how).items()})
                open_ = {}
            if how.leaves:
                if leaves >= how.leaves or not found:
                    break
                going = [min(found, key=lambda k: (found[k][0]["loss"], k))]
            else:
                going = sorted(found)
            for node in going:
                best, level = found.pop(node)
                first = grown.split(node, best["column"], cuts[best["column"]][best["bin"]],
                                    worth(best["gl"], best["hl"]), worth(best["gr"], best["hr"]))
                leaves, grown.depth = leaves + 1, max(grown.depth, level + 1)
                if not how.depth or level + 1 < how.depth:
                    open_ |= {first: level + 1, first + 1: level + 1}
    grown.depth = max(depth, grown.depth)
    return root


def boost_spark(rows: DataFrame, how: Growth) -> Trees:
    """The same from (x, label), with one job per level; running predictions are written every few trees."""
    n = rows.select(F.size("x")).first()[0]
    cuts = edges(rows, n, how.bins)
    base = float(rows.agg(F.avg("label")).first()[0])
    state = written(binned(rows, cuts).select("bins", "label", F.lit(base).alias("score")), "binned")
    grown, roots, new = _Grown(), [], []
    for k in range(how.rounds):
        added = [F.get(_array(grown.value, "double"), _node_of(grown, r, cuts)) for r in new]
        current = state.withColumn("score", sum(added, F.col("score")))
        if len(new) == KEEP_EVERY:
            state, new = written(current, "boosted"), []
            current = state
        own = current.select("bins", (F.col("score") - F.col("label")).alias("g"))
        if how.row_share < 1:
            own = own.filter(F.pmod(F.xxhash64("bins", "g", F.lit(how.seed + k)), F.lit(1 << 20)) < how.row_share * (1 << 20))
        root = _grow(own, cuts, how, grown)
        for at in range(root, len(grown.value)):
            grown.value[at] *= how.step
        roots.append(root)
        new.append(root)
    return grown.trees(base, roots)


def node_rows(trees: Trees) -> list[tuple]:
    """(tree, node, column, threshold, low, high, value) of the node table."""
    ends = [*trees.roots[1:], len(trees.value)]
    return [(t, k, trees.column[k], trees.threshold[k], trees.left[k], trees.left[k] + 1 if trees.left[k] >= 0 else -1, trees.value[k])
            for t, (a, b) in enumerate(zip(trees.roots, ends)) for k in range(a, b)]
