"""Gradient-boosted trees grown by relations, all folds at once.

A fold's rows never meet in one task.  Each level of a tree is one pass: tasks add up
the gradients of the rows they read by fold, class, node, feature and bin, only these
sums are shuffled, and window functions over the bins find the best split of every
node.  The driver holds the trees, whose size does not grow with the rows.  Gradients
are whole numbers of 2**-30, so that sums, and with them the trees, are the same for
any partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

UNIT = float(1 << 30)
#: Trees whose part of the scores is computed on the way, before the scores are written anew.
PENDING = 10


@dataclass
class Settings:
    """Rounds of trees (one a class), their depth, step, penalty on leaf values, bins of a feature, rows of a leaf at least."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.06
    penalty: float = 1.0
    bins: int = 32
    least_rows: int = 20


@dataclass
class Tree:
    """Nodes in the order of a heap: feature (-1: a leaf) and last bin to the left, value, and what its split gains."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def root(cls, depth: int) -> Tree:
        size = (2 << depth) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            at[inner] = 2 * here + 1 + (bins[inner, self.feature[here]] > self.cut[here])


@dataclass
class Boosted:
    """By fold: the bins' upper edges of each feature, the classes' first scores, and the trees of each round by class."""

    features: list[str]
    classes: int
    edges: dict[int, list[np.ndarray]]
    start: dict[int, np.ndarray]
    trees: dict[int, list[list[Tree]]] = field(default_factory=dict)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it; unknown values have the last bin."""
    out = np.empty(x.shape, np.int64)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), len(e), np.searchsorted(e, x[:, j], side="left"))
    return out


def gradients(scores: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the multinomial loss, in whole units."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return np.rint(g * w[:, None] * UNIT).astype(np.int64), np.rint(p * (1 - p) * w[:, None] * UNIT).astype(np.int64)


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """[node, feature, bin, (g, h, n)] sums of rows."""
    width = bins.shape[1]
    cell = (node[:, None] * width + np.arange(width)) * size + bins
    out = np.zeros((nodes * width * size, 3), np.int64)
    flat = cell.ravel()
    for k, v in enumerate((g, h, np.ones(len(g), np.int64))):
        np.add.at(out[:, k], flat, np.repeat(v, width))
    return out.reshape(nodes, width, size, 3)


def quantiles(known: DataFrame, width: int, at: list[float], accuracy: int = 10_000) -> dict[int, list[list[float]]]:
    """By fold and feature (x0, x1, ...): the values at the shares ``at``, one for each, exact for any number of rows; none of a feature without values.

    Approximate ones bound each of them; what lies below its bounds is counted, and only
    the few values in between are shuffled and sorted.  Bounds that do not hold it are
    dropped, and the whole feature is sorted.
    """
    clean = lambda j: F.when(~F.isnan(f"x{j}"), F.col(f"x{j}"))
    near = [min(max(q + side * 2 / accuracy, 0.0), 1.0) for side in (-1, 1) for q in at]
    out: dict[int, list[list[float]]] = {}
    asked: dict[tuple[int, int], tuple] = {}
    for r in known.groupBy("fold").agg(*[F.count(clean(j)).alias(f"n{j}") for j in range(width)], *[F.percentile_approx(clean(j), near, accuracy).alias(f"e{j}") for j in range(width)]).collect():  # a row a fold
        out[r["fold"]] = [[float("nan")] * len(at) if r[f"n{j}"] else [] for j in range(width)]
        for j in range(width):
            if r[f"n{j}"]:
                asked[r["fold"], j] = (list(range(len(at))), [max(int(np.ceil(q * r[f"n{j}"])), 1) for q in at], r[f"e{j}"][: len(at)], r[f"e{j}"][len(at) :])
    while asked:
        sent = known.sparkSession.sparkContext.broadcast(asked)

        def counted(batches, sent=sent):
            for batch in batches:
                folds, rows = batch.column(0).to_numpy(), []
                for (f, j), (places, ranks, lows, highs) in sent.value.items():
                    x = batch.column(1 + j).to_numpy(zero_copy_only=False)[folds == f]
                    x = np.sort(x[~np.isnan(x)])
                    begins, ends = np.searchsorted(x, lows, side="left"), np.searchsorted(x, highs, side="right")
                    for k, rank, begin, end in zip(places, ranks, begins.tolist(), ends.tolist(), strict=True):
                        rows.append((f, j, k, rank, None, begin))
                        rows += [(f, j, k, rank, v, n) for v, n in zip(*map(np.ndarray.tolist, np.unique(x[begin:end], return_counts=True)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64()))], names=["fold", "feature", "place", "rank", "x", "n"])

        cells = known.select("fold", *[clean(j).alias(f"x{j}") for j in range(width)]).mapInArrow(counted, "fold int, feature int, place int, rank long, x double, n long")
        cells = cells.groupBy("fold", "feature", "place", "rank", "x").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("fold", "feature", "place").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0))
        hit = cells.withColumn("upto", upto).groupBy("fold", "feature", "place", "rank").agg(F.min(F.when(F.col("upto") >= F.col("rank"), F.col("x"))).alias("x"), F.max(F.when(F.col("x").isNull(), F.col("n"))).alias("below"))
        again: dict[tuple[int, int], tuple] = {}
        for r in hit.collect():  # a row a fold, feature and share
            f, j, k = r["fold"], r["feature"], r["place"]
            if r["x"] is not None and r["below"] < r["rank"]:
                out[f][j][k] = r["x"]
            else:
                for a, v in zip(again.setdefault((f, j), ([], [], [], [])), (k, r["rank"], -np.inf, np.inf), strict=True):
                    a.append(v)
        asked = again
    return out


def fit(rows: DataFrame, fold: str, features: list[str], label: str, weight: str | None = None, classes: int = 3, settings: Settings | None = None) -> Boosted:
    """Trees of every fold, for labels 0 to classes - 1; rows with a null label are left out."""
    s = settings or Settings()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.where(F.col(label).isNotNull()).select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("y"), w.alias("w"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    known, read = files.written_at(known, "boosting")
    found = known.groupBy("fold").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("y") == k, F.col("w"))).alias(f"p{k}") for k in range(classes)]).collect()
    points = quantiles(known, len(features), [i / s.bins for i in range(1, s.bins)])
    model = Boosted(features, classes, {}, {})
    mean = {}
    for r in found:  # a row a fold
        model.edges[r["fold"]] = [np.unique(p) for p in points[r["fold"]]]
        model.start[r["fold"]] = np.log([max((r[f"p{k}"] or 0) / r["w"], 1e-9) for k in range(classes)])
        model.trees[r["fold"]] = []
        mean[r["fold"]] = r["w"] / r["n"]
    sc = rows.sparkSession.sparkContext
    edges = sc.broadcast((model.edges, model.start, mean))

    def prepare(batches):
        edges_, start, mean_ = edges.value
        for frame in batches:
            for f, part in frame.groupby("fold"):
                bins = binned(part[[f"x{j}" for j in range(len(features))]].to_numpy(float), edges_[f])
                yield pd.DataFrame({"fold": part["fold"], "y": part["y"], "w": part["w"] / mean_[f], "bins": list(bins.astype(np.int32)), "scores": [start[f]] * len(part)})

    table, where = files.written_at(known.mapInPandas(prepare, "fold int, y int, w double, bins array<int>, scores array<double>"), "boosting")
    files.drop_folder(rows.sparkSession, read)
    done = 0
    for _ in range(s.rounds):
        growing = {f: [Tree.root(s.depth) for _ in range(classes)] for f in model.trees}
        for level in range(s.depth):
            pending = {f: trees[done:] for f, trees in model.trees.items()}
            if not grow(table, growing, pending, len(features), classes, level, s):
                break
        for f, trees in growing.items():
            model.trees[f].append(trees)
        if len(next(iter(model.trees.values()), [])) - done >= PENDING:
            pending = sc.broadcast({f: trees[done:] for f, trees in model.trees.items()})

            def scored(batches, pending=pending):
                for frame in batches:
                    for f, part in frame.groupby("fold"):
                        total = np.array(part["scores"].tolist()) + values(np.array(part["bins"].tolist()), pending.value[f], classes)
                        yield part.assign(scores=list(total))

            table, new = files.written_at(table.mapInPandas(scored, table.schema), "boosting")
            files.drop_folder(rows.sparkSession, where)
            where, done = new, len(next(iter(model.trees.values())))
    files.drop_folder(rows.sparkSession, where)
    return model


def values(bins: np.ndarray, rounds: list[list[Tree]], classes: int) -> np.ndarray:
    """Sums of the trees' values by class."""
    out = np.zeros((len(bins), classes))
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.value[tree.nodes(bins)]
    return out


def grow(table: DataFrame, growing: dict[int, list[Tree]], pending: dict[int, list[list[Tree]]], width: int, classes: int, level: int, s: Settings) -> bool:
    """Splits the nodes of one level in all folds and classes; whether any was split."""
    first, nodes, size = (1 << level) - 1, 1 << level, s.bins + 1
    sent = table.sparkSession.sparkContext.broadcast((growing, pending))

    def add_up(batches):
        trees, before = sent.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy()
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            bins = batch.column(3).flatten().to_numpy().reshape(len(folds), width).astype(np.int64)
            scores = batch.column(4).flatten().to_numpy().reshape(len(folds), classes)
            for f in np.unique(folds).tolist():
                own = np.flatnonzero(folds == f)
                g, h = gradients(scores[own] + values(bins[own], before[f], classes), y[own], w[own])
                for k, tree in enumerate(trees[f]):
                    node = tree.nodes(bins[own]) - first
                    open_ = np.flatnonzero(node >= 0)  # others are leaves of a level before
                    if len(open_):
                        part = histogram(bins[own[open_]], node[open_], g[open_, k], h[open_, k], nodes, size)
                        sums[f, k] = sums[f, k] + part if (f, k) in sums else part
        for (f, k), total in sums.items():
            node, feature, bin_ = np.nonzero(total[..., 2])
            cells = total[node, feature, bin_]
            n = len(node)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f), pa.int32()), pa.array(np.full(n, k), pa.int32()), pa.array(node, pa.int32()), pa.array(feature, pa.int32()), pa.array(bin_, pa.int32()), *(pa.array(cells[:, i]) for i in range(3))], names=["fold", "class", "node", "feature", "bin", "g", "h", "n"])

    cells = table.mapInArrow(add_up, "fold int, class int, node int, feature int, bin int, g long, h long, n long").groupBy("fold", "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    by = ["fold", "class", "node"]
    w = Window.partitionBy(*by, "feature")
    left = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({f"l{c}": F.sum(c).over(left) for c in "ghn"} | {f"t{c}": F.sum(c).over(w) for c in "ghn"})
    worth = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + s.penalty)
    rest = {c: F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn"}
    gain = worth(F.col("lg"), F.col("lh")) + worth(rest["g"], rest["h"]) - worth(F.col("tg"), F.col("th"))
    may = (F.col("ln") >= s.least_rows) & (rest["n"] >= s.least_rows) & (gain > 1e-9)
    best = cells.withColumn("gain", F.when(may, gain)).groupBy(*by).agg(F.max("tg").alias("tg"), F.max("th").alias("th"), F.max_by(F.struct("feature", "bin", "lg", "lh", "gain"), F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("feature"), -F.col("bin")))).alias("cut"))
    split = False
    value = lambda g, h: -s.rate * (g / UNIT) / (h / UNIT + s.penalty)
    for r in best.collect():  # a row a node
        tree, at = growing[r["fold"]][r["class"]], first + r["node"]
        tree.value[at] = value(r["tg"], r["th"])
        if r["cut"] is not None:
            cut, split = r["cut"], True
            tree.feature[at], tree.cut[at], tree.gain[at] = cut["feature"], cut["bin"], cut["gain"]
            tree.value[2 * at + 1], tree.value[2 * at + 2] = value(cut["lg"], cut["lh"]), value(r["tg"] - cut["lg"], r["th"] - cut["lh"])
    return split


def predict(rows: DataFrame, model: Boosted, fold: str) -> DataFrame:
    """rows of the model's folds with ``probabilities``, one for each class."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    folds = F.col(fold).isin([int(f) for f in model.edges]) if model.edges else F.lit(False)
    names = [f"_x{j}" for j in range(len(model.features))]

    def run(batches):
        m = sent.value
        for frame in batches:
            for f, part in frame.groupby("_fold"):
                bins = binned(part[names].to_numpy(float), m.edges[f])
                scores = m.start[f] + values(bins, m.trees[f], m.classes)
                e = np.exp(scores - scores.max(axis=1, keepdims=True))
                yield part.drop(columns=["_fold", *names]).assign(probabilities=list(e / e.sum(axis=1, keepdims=True)))

    known = rows.where(folds).select("*", F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(n) for c, n in zip(model.features, names, strict=True)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return known.mapInPandas(run, f"{kinds}, probabilities array<double>")
