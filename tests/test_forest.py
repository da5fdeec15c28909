"""The out-of-bag forest: a row's own label has no part in its prediction, category splits are the best of all subsets, bins stay fixed."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linepulse.operators import forest

SHAPE = "batch_id long, product string, operator string, hour int, status string"


def rows(n, products=6, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        p = draw.randrange(products)
        late = (p % 3 == 0) != (draw.random() < 0.1)
        out.append((i, f"p{p}" if i % 50 else None, f"o{draw.randrange(3)}", draw.randrange(24) if i % 40 else None, None if i % 31 == 0 else "DELAY" if late else "ON TIME"))
    return out


def predictions(spark, data, **with_):
    df = spark.createDataFrame(data, SHAPE).repartition(3)
    got = forest.out_of_bag(df, "batch_id", "status", ["product", "operator"], ["hour"], **{"num_trees": 24, "max_depth": 4, **with_}).collect()
    return {r["batch_id"]: (r["predicted"], r["n_votes"], r["status"]) for r in got}


def test_own_label_has_no_part(spark):
    data = rows(300)
    got = predictions(spark, data)
    assert sorted(got) == list(range(300))
    right = np.mean([p == s for p, _, s in got.values() if s])
    assert right > 0.8 > max(np.mean([s == x for _, _, s in got.values() if s]) for x in ("DELAY", "ON TIME"))
    assert all(n == 24 for _, n, s in got.values() if s is None)
    assert np.mean([n > 0 for _, n, _ in got.values()]) > 0.9
    for i in (7, 8, 64):
        flipped = [(*r[:4], {"DELAY": "ON TIME", "ON TIME": "DELAY"}[r[4]]) if r[0] == i else r for r in data]
        assert predictions(spark, flipped)[i][:2] == got[i][:2]


def test_partitioning_changes_nothing(spark):
    data = rows(200)
    a = predictions(spark, data)
    assert predictions(spark, data[::-1]) == a


@pytest.mark.parametrize("seed", range(6))
def test_category_splits_are_the_best_subsets(seed):
    draw = np.random.default_rng(seed)
    counts = draw.integers(0, 9, (7, 2))
    weights = np.array([1.0, 1.7])

    def gain(right):
        w = counts * weights
        r, left = w[list(right)].sum(axis=0), np.delete(w, list(right), axis=0).sum(axis=0)
        if not r.sum() or not left.sum():
            return 0.0
        t = w.sum(axis=0)
        return (left ** 2).sum() / left.sum() + (r ** 2).sum() / r.sum() - (t ** 2).sum() / t.sum()

    best = max(gain(s) for n in range(1, 7) for s in itertools.combinations(range(7), n))
    found, mask, right = forest.best_split(counts, weights, True)
    goes = [b for b in range(7) if mask >> b & 1]
    assert abs(found - best) < 1e-9 and abs(gain(goes) - best) < 1e-9 and (counts[goes].sum(axis=0) == right).all()
    found, mask, _ = forest.best_split(counts, weights, False)
    assert abs(found - max(gain(range(k, 7)) for k in range(1, 7))) < 1e-9


def test_large_vocabulary_in_fixed_bins(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("batch_id"), F.concat(F.lit("p"), (F.col("id") % 50_000).cast("string")).alias("product"),
                               F.when(F.pmod(F.xxhash64(F.col("id") % 50_000), F.lit(10)) < 4, "DELAY").otherwise("ON TIME").alias("status"))
    got = forest.out_of_bag(df, "batch_id", "status", ["product"], [], num_trees=8, max_depth=3, bins=32)
    right = got.where("n_votes > 0").agg(F.avg((F.col("predicted") == F.col("status")).cast("double"))).first()[0]
    assert right > 0.6           # the twin of a row, where a group has drawn it, tells its label


def test_weights_and_bags_are_the_hashes(spark):
    h = np.arange(100_000, dtype=np.int64) * 7919
    w = forest.poisson_weights(h, 3, 42)
    assert abs(w.mean() - 1 / forest.SHARE) < 0.03 and abs(w.var() - 1 / forest.SHARE) < 0.05
    assert (forest.poisson_weights(h[::-1].copy(), 3, 42) == w[::-1]).all() and (forest.poisson_weights(h, 4, 42) != w).any()


def test_no_labels_and_one_class(spark):
    assert {p for p, *_ in predictions(spark, [(*r[:4], None) for r in rows(20)]).values()} == {None}
    assert {p for p, *_ in predictions(spark, [(*r[:4], "ON TIME") for r in rows(20)]).values()} == {"ON TIME"}
