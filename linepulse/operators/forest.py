"""Random forest for the batch status with out-of-bag predictions: one fit, and no batch is judged by a tree that has seen it.

Trees come in groups.  A group draws its rows, about ``SHARE`` of them, by a hash of the row's key, and each of its trees gives these rows Poisson weights, again
from a hash; a row that the group did not draw votes with the group's trees.  Everything a tree is made of (bins of categories, class weights, splits) comes
from the rows of its group, so a row's own label has no part in its prediction, and nothing depends on how rows are partitioned.

Bins are a parameter.  Values of a text column are ordered by the label rate among the group's rows and cut into ``bins`` parts of about equal
weight (a column with at most ``bins`` values keeps them all); at every node its bins are ordered anew by the node's own label rate, which gives the best of all
subsets for two classes.  So memory doesn't grow with a vocabulary.  Numbers are cut at quantiles.

Growth is by levels for all trees at once: tasks count (node, feature, bin, class) over their rows, the counts of a tree are added in one task, which chooses
its splits, and only the splits (at most one row a node) come to the driver.  Counts are integers, so the sums are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.session import shared_dir, ship_package

SHARE = 0.632              # of the rows, drawn by a group
GROUP_TREES = 4
GRID = 512                 # steps of a label rate
FEW_VALUES = 50_000        # a table of at most so many values is sent to all tasks
MISSING = "nan"
CHUNK = 65_536             # rows that a task works on at once
MOST_BINS = 64             # room for the bins of a node in a table of steps


def bag_of(key: str, groups: int, seed: int):
    """Bit g: does group g draw the row?"""
    out = F.lit(0).cast("long")
    for g in range(groups):
        drawn = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(g)), F.lit(1000)) < int(1000 * SHARE)
        out = out.bitwiseOR(F.when(drawn, F.lit(1 << g).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


_POISSON = np.cumsum(np.exp(-1 / SHARE) * np.cumprod(np.append(1.0, 1 / SHARE / np.arange(1, 16))))
_EDGES = np.arange(65_536) / 65_536
_SURE = np.searchsorted(_POISSON, _EDGES).astype(np.uint8)        # numbers by the first 16 bits; 255 where the other bits decide
_SURE[np.searchsorted(_POISSON, _EDGES + (1 / 65_536 - 2.0 ** -53)) != _SURE] = 255


def poisson_weights(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1 / SHARE) numbers of rows by their hashes."""
    x = h.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + seed) & (2 ** 64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    w = _SURE.take((x >> np.uint64(48)).view(np.int64))
    rest = np.flatnonzero(w == 255)
    w[rest] = np.searchsorted(_POISSON, (x[rest] >> np.uint64(11)).astype(np.float64) / 2 ** 53)
    return w.astype(np.int64)


def chunks(batches):
    """The batches, small ones together."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def byte_rows(column, width: int) -> np.ndarray:
    """A binary column of equal lengths, without nulls, as rows of bytes."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[first:first + len(column) * width].reshape(-1, width)


def best_split(counts: np.ndarray, weights: np.ndarray, category: bool) -> tuple[float, int, np.ndarray]:
    """(gain, mask of the bins that go right, raw counts of the right side) for raw counts (bins x classes) under class weights; gain 0: no split."""
    used = np.flatnonzero(counts.sum(axis=1))
    if len(used) < 2:
        return 0.0, 0, counts[:0].sum(axis=0)
    w = counts[used] * weights
    size = w.sum(axis=1)
    if category:
        order = np.argsort(w[:, -1] / size, kind="stable")
        used, w = used[order], w[order]
    left = np.cumsum(w, axis=0)[:-1]
    right = w.sum(axis=0) - left
    nl, nr, total = left.sum(axis=1), right.sum(axis=1), w.sum(axis=0)
    gain = (left ** 2).sum(axis=1) / nl + (right ** 2).sum(axis=1) / nr - (total ** 2).sum() / total.sum()
    at = int(np.argmax(gain > gain.max() - 1e-9 * total.sum()))
    if gain[at] <= 1e-9 * total.sum():
        return 0.0, 0, counts[:0].sum(axis=0)
    goes = used[at + 1:]
    if not category:                      # bins between that no row of the node has go with the nearer side above
        goes = np.arange(used[at] + 1, len(counts))
    return float(gain[at]), int(sum(1 << int(b) for b in goes)), counts[goes].sum(axis=0)


class Trees:
    """Split tables of all trees, nodes numbered as in a heap (root 1)."""

    def __init__(self, n: int, depth: int, classes: int, groups: int):
        self.depth, self.classes, self.groups = depth, classes, groups
        self.feature = np.full((n, 2 << depth), -1, dtype=np.int16)
        self.mask = np.zeros((n, 2 << depth), dtype=np.int64)
        self.counts = np.zeros((n, 2 << depth, classes), dtype=np.int64)
        self.weights = np.ones((n, classes))
        self.open = {(t, 1) for t in range(n)}

    def steps(self, tree: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """The feature that a node above this level asks for (0 at a leaf), and the next node by node and bin (a leaf stays)."""
        node = np.arange(1 << levels)
        f, split = self.feature[tree, node], (self.feature[tree, node] >= 0)[:, None]
        right = (self.mask[tree, node][:, None] >> np.arange(MOST_BINS)) & 1
        return np.where(f >= 0, f, 0).astype(np.int64), np.where(split, 2 * node[:, None] + right, node[:, None]).ravel()

    @staticmethod
    def place(steps: tuple[np.ndarray, np.ndarray], rows: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row (its bins by feature) after so many levels."""
        asked, following = steps
        flat, first = rows.ravel(), np.arange(0, rows.size, rows.shape[1])
        at = np.ones(len(rows), dtype=np.int64)
        for _ in range(levels):
            b = flat.take(first + asked.take(at))
            at *= MOST_BINS
            at += b
            at = following.take(at)
        return at

    def leaf_shares(self, tree: int) -> np.ndarray:
        w = self.counts[tree] * self.weights[tree]
        return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def chosen_features(tree: int, node: int, n: int, slots: int, seed: int) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, tree, node]).permutation(n)[:slots])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/forest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def category_bins(rows: DataFrame, columns: Sequence[str], groups: int, bins: int, last: int) -> tuple[DataFrame, dict[int, int]]:
    """f, v, b: the bins (a byte for each group) of every value of the text columns, by the rate of label ``last``; and the columns' numbers of values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("v")) for k, c in enumerate(columns)]))
    drawn = [F.col("_bag").bitwiseAND(F.lit(1 << g).cast("long")) != 0 for g in range(groups)]
    known = F.col("_y") >= 0
    stats = rows.select(pairs.alias("x"), "_bag", "_y").select("x.f", "x.v", "_bag", "_y").groupBy("f", "v").agg(
        F.array(*[F.count(F.when(d & known, 1)) for d in drawn]).alias("n"),
        F.array(*[F.count(F.when(d & (F.col("_y") == F.lit(last)), 1)) for d in drawn]).alias("last"))
    stats = _written(stats, "values")
    sizes = {r["f"]: r["c"] for r in stats.groupBy("f").agg(F.count(F.lit(1)).alias("c")).collect()}
    own = {}                                  # the values of columns that keep them all
    for f, c in sizes.items():
        if c <= bins:
            own[f] = {r["v"]: i for i, r in enumerate(stats.where(F.col("f") == f).select("v").orderBy("v").collect())}
    # weight of each step of the label rate in each group: at most GRID + 1 rows a column and group
    steps = F.transform(F.arrays_zip("n", "last"), lambda x: F.floor(GRID * x["last"] / F.greatest(x["n"], F.lit(1))).cast("int"))
    grid = stats.where(~F.col("f").isin(*own) if own else F.lit(True)).select("f", F.posexplode(F.arrays_zip("n", steps.alias("q")))).select(
        "f", F.col("pos").alias("g"), F.col("col.q").alias("q"), F.col("col.n").alias("n")).groupBy("f", "g", "q").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros((len(columns), groups, GRID + 1))
    for r in grid:
        weight[r["f"], r["g"], r["q"]] += r["n"]
    before = np.cumsum(weight, axis=2) - weight / 2
    part = np.minimum((before * bins / np.maximum(weight.sum(axis=2, keepdims=True), 1)).astype(np.int64), bins - 1)

    def run(batches):
        for batch in batches:
            out = []
            for f, v, n, last in zip(*[c.to_pylist() for c in batch.columns]):
                if f in own:
                    out.append(bytes([own[f][v]] * groups))
                else:
                    n, last = np.array(n), np.array(last)
                    out.append(part[f, np.arange(groups), GRID * last // np.maximum(n, 1)].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["f", "v", "b"])

    return stats.select("f", "v", "n", "last").mapInArrow(run, "f int, v string, b binary"), sizes


def out_of_bag(feats: DataFrame, key: str, label: str, categories: Sequence[str], numbers: Sequence[str], num_trees: int = 100, max_depth: int = 8,
               bins: int = 32, seed: int = 42, most_classes: int = 100) -> DataFrame:
    """``feats`` with ``predicted`` and ``n_votes`` (trees that did not see the row; 0: the most common label of the others).

    Labels are balanced as n / (classes * n of the class) within each tree's rows; a node sees the square root of the number of features, drawn by a hash; rows
    without a label are predicted by all trees.  ``bins``: at most 62.
    """
    spark = feats.sparkSession
    ship_package(spark)
    if not 2 <= bins <= 62:
        raise ValueError("2 to 62 bins")
    names = [r[0] for r in feats.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(most_classes + 1).collect()]
    if len(names) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    if not names:
        return feats.select("*", F.lit(None).cast("string").alias("predicted"), F.lit(0).alias("n_votes"))
    groups = max(1, min(-(-num_trees // GROUP_TREES), 60))
    y = F.lit(-1)
    for i, name in enumerate(names):
        y = F.when(F.col(label) == name, i).otherwise(y)
    k, n_cat = len(feats.columns), len(categories)
    rows = feats.select("*", F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), bag_of(key, groups, seed).alias("_bag"), y.alias("_y"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"_t{i}") for i, c in enumerate(categories)],
                        *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_v{i}") for i, c in enumerate(numbers)])
    cuts = rows.agg(*[F.percentile_approx(f"_v{i}", [j / bins for j in range(1, bins)], 10_000).alias(f"c{i}") for i in range(len(numbers))],
                    *[F.count(F.when(F.col("_y") == i, 1)).alias(f"y{i}") for i in range(len(names))]).first()
    total = np.array([cuts[f"y{i}"] for i in range(len(names))], dtype=np.int64)
    bins_of, sizes = category_bins(rows, [f"_t{i}" for i in range(n_cat)], groups, bins, len(names) - 1) if n_cat else (None, {})
    binned = rows
    for i in range(n_cat):
        one = bins_of.where(F.col("f") == i).select(F.col("v").alias(f"_t{i}"), F.col("b").alias(f"_b{i}"))
        binned = binned.join(F.broadcast(one) if sizes.get(i, 0) <= FEW_VALUES else one, f"_t{i}")
    # numbers are cut by the tasks that read the rows: as an expression of Spark, with the bags beside it, the cuts make one method too long to be compiled
    edges = [np.array(sorted(set(cuts[f"c{i}"] or [])), dtype=np.float64) for i in range(len(numbers))]
    inner = ["_h", "_bag", "_y", *[f"_b{i}" for i in range(n_cat)], *[f"_v{i}" for i in range(len(numbers))]]
    binned = _written(binned.select(*feats.columns, *inner), "rows")

    n_features = n_cat + len(numbers)
    slots = max(1, int(n_features ** 0.5))
    trees = Trees(num_trees, max_depth, len(names), groups)
    n_classes = len(names)

    def opened(batch, first: int):
        """hash, bag, label and a function (group, rows) -> bins (rows x features) of a batch whose inner columns begin at ``first``."""
        h, bag, lab = (batch.column(first + i).to_numpy() for i in range(3))
        cats = [byte_rows(batch.column(first + 3 + i), groups) for i in range(n_cat)]
        nums = [np.searchsorted(edges[i], batch.column(first + 3 + n_cat + i).to_numpy()).astype(np.uint8) for i in range(len(numbers))]
        return h, bag, lab, lambda g, at: np.column_stack([*[x[at, g] for x in cats], *[x[at] for x in nums]])

    def grown(level: int) -> None:
        width = 1 << level
        chosen = np.full((num_trees, width, slots), -1, dtype=np.int64)
        for t, node in trees.open:
            chosen[t, node - width] = chosen_features(t, node, n_features, slots, seed)
        wanted = sorted({t for t, _ in trees.open})

        def count(batches):
            held = {t: np.zeros(width * slots * bins * n_classes, dtype=np.int64) for t in wanted}
            steps = {t: trees.steps(t, level) for t in wanted}
            for batch in chunks(batches):
                h, bag, lab, bins_at = opened(batch, 0)
                for g in sorted({t // GROUP_TREES % groups for t in wanted}):
                    mine = np.flatnonzero((bag >> g & 1).astype(bool) & (lab >= 0))
                    rows_g, h_g, lab_g = bins_at(g, mine), h[mine], lab[mine].astype(np.int64)
                    for t in wanted:
                        if t // GROUP_TREES % groups != g:
                            continue
                        w = poisson_weights(h_g, t, seed)
                        some = np.flatnonzero(w)
                        at = trees.place(steps[t], rows_g.take(some, axis=0), level) - width
                        here = np.flatnonzero((at >= 0) & (chosen[t, :, 0] >= 0).take(at, mode="clip"))
                        some, at = some.take(here), at.take(here)
                        w, first, of = w.take(some), some * n_features, lab_g.take(some)
                        for s in range(slots):
                            b = rows_g.ravel().take(first + chosen[t, :, s].take(at))
                            cell = ((at * slots + s) * bins + b) * n_classes + of
                            held[t] += np.bincount(cell, w, minlength=len(held[t])).astype(np.int64)
            some = {t: np.flatnonzero(x) for t, x in held.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.astype("<i8").tobytes() for a in some.values()], pa.binary()),
                                              pa.array([held[t][a].astype("<i8").tobytes() for t, a in some.items()], pa.binary())], names=["tree", "cells", "n"])

        def choose(batches):
            held = {}
            for batch in batches:
                for t, cells, n in zip(*[c.to_pylist() for c in batch.columns]):
                    x = held.setdefault(t, np.zeros(width * slots * bins * n_classes, dtype=np.int64))
                    x[np.frombuffer(cells, "<i8")] += np.frombuffer(n, "<i8")
            out = []
            for t, x in held.items():
                x = x.reshape(width, slots, bins, n_classes)
                weights = trees.weights[t]
                if level == 0:
                    n = x[0, 0].sum(axis=0)
                    weights = np.where(n > 0, n.sum() / (np.maximum(n, 1) * max((n > 0).sum(), 1)), 0.0)
                for node in np.flatnonzero(chosen[t, :, 0] >= 0):
                    here = x[node, 0].sum(axis=0)
                    found = max(((*best_split(x[node, s], weights, chosen[t, node, s] < n_cat), chosen[t, node, s]) for s in range(slots)), key=lambda z: z[0])
                    gain, mask, right, f = found
                    out.append((t, int(node) + width, int(f) if gain > 0 else -1, mask, here.astype("<i8").tobytes(), (right if gain > 0 else 0 * here).astype("<i8").tobytes()))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["tree", "node", "feature", "mask", "here", "right"])

        parts = max(min(num_trees, spark.sparkContext.defaultParallelism), 1)
        counted = binned.select(*inner).mapInArrow(count, "tree int, cells binary, n binary")
        splits = counted.repartition(parts, "tree").mapInArrow(choose, "tree int, node int, feature int, mask long, here binary, right binary").collect()   # a row for each open node
        trees.open = set()
        for r in splits:
            t, node, here, right = r["tree"], r["node"], np.frombuffer(r["here"], "<i8"), np.frombuffer(r["right"], "<i8")
            trees.counts[t, node] = here
            if level == 0:
                trees.weights[t] = np.where(here > 0, here.sum() / (np.maximum(here, 1) * max((here > 0).sum(), 1)), 0.0)
            if r["feature"] < 0:
                continue
            trees.feature[t, node], trees.mask[t, node] = r["feature"], r["mask"]
            for child, n in ((2 * node, here - right), (2 * node + 1, right)):
                trees.counts[t, child] = n
                if level + 1 < max_depth and (n > 0).sum() > 1:
                    trees.open.add((t, child))

    for level in range(max_depth):
        if not trees.open:
            break
        grown(level)

    def predict(batches):
        shares, steps = [trees.leaf_shares(t) for t in range(num_trees)], [trees.steps(t, max_depth) for t in range(num_trees)]
        for batch in chunks(batches):
            h, bag, lab, bins_at = opened(batch, k)
            score, votes = np.zeros((batch.num_rows, n_classes)), np.zeros(batch.num_rows, dtype=np.int64)
            last = None
            for t in range(num_trees):
                g = t // GROUP_TREES % groups
                if g != last:
                    free = np.flatnonzero(((bag >> g & 1) == 0) | (lab < 0))
                    rows_g, last = bins_at(g, free), g
                if len(free) and trees.counts[t, 1].any():
                    score[free] += shares[t].take(trees.place(steps[t], rows_g, max_depth), axis=0)
                    votes[free] += 1
            others = total - (np.arange(n_classes) == lab[:, None])
            said = np.where(votes > 0, score.argmax(axis=1), others.argmax(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array([names[i] for i in said], pa.string()), pa.array(votes.astype(np.int32))],
                                             names=[*batch.schema.names[:k], "predicted", "n_votes"])

    shape = feats.select("*", F.lit("").alias("predicted"), F.lit(0).alias("n_votes")).schema
    return binned.mapInArrow(predict, shape)
