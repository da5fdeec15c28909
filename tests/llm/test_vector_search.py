import random

import numpy as np
import pytest

from linepulse.llm import vector_search

SHAPE = "vec_id long, embedding array<float>, label int, shard int, v string, block int"


def brute(rows, k, every):
    """(query, rank, vec_id, score) by all pairs in Python integers."""
    vectors = {}
    for i, e, *_ in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = [int(np.clip(np.floor(64 * float(np.float32(x))), -2 ** 24, 2 ** 24)) for x in e]
        vectors.setdefault(i, v)
    out = set()
    for q, a in vectors.items():
        if q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q)[:k]
        out |= {(q, at + 1, i, -s) for at, (s, i) in enumerate(found)}
    return out


def answers(spark, rows, **with_):
    df = spark.createDataFrame([(*r, 1, 2, "v", 3) for r in rows], SHAPE).repartition(3)
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(df, **with_).collect()]


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, monkeypatch, seed):
    draw = random.Random(seed)
    hot = [draw.gauss(0, 0.2) for _ in range(12)]
    rows = [(i, hot if i % 3 == 0 else [draw.gauss(0, 0.2) * (50 if i % 41 == 0 else 1) for _ in range(12)]) for i in range(0, 400)]
    rows += [(2 ** 53 + 1, hot), (2 ** 53 + 20, [draw.gauss(0, 0.2) for _ in range(12)]), (-40, [0.0] * 12), (1001, None), (None, hot), (1003, [1.0, None] + hot[2:]),
             (1004, [float("nan")] * 12), (1020, [float("inf")] * 12), (1040, []), (1060, [3e38, -3e38]), (1005, [1.0]), *[(20, rows_20) for rows_20 in [hot]]]
    rows = [r for k, r in enumerate(rows) if not (r[0] == 20 and k < 400)]
    monkeypatch.setattr(vector_search, "LEAST_SHARD", 64)
    got = answers(spark, rows, k=7, queries=10)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 7, 20)


def test_fewer_candidates_than_k_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    got = answers(spark, rows)
    assert sorted(got) == [(0, 1, 1, 64 * 64 * 5), (0, 2, 2, 0)]


def test_no_rows(spark):
    for rows in ([], [(0, None)], [(None, [1.0])]):
        assert answers(spark, rows) == []


def test_cells_hold_their_vectors_and_spare_reading():
    draw = np.random.default_rng(3)
    v = draw.normal(0, 9, (5000, 32)).round().astype(np.int64)
    v[::700] *= 40                                               # far outside
    cells = vector_search.Cells(v.min(0), v.max(0), v.mean(0), v.std(0))
    of = cells.of(v)
    assert (np.abs(v - cells.middles(of)) <= cells.usual + cells.further(of)).all()
    shard = vector_search.Shard(np.arange(5000), of, v, cells)
    q = v[:300]
    low, high = shard.bounds(q)
    exact = q @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    for i, (place, score) in enumerate(shard.best(q, 21)):
        want = np.lexsort((np.arange(5000), -exact[i]))[:21]
        assert (place == want).all() and (score == exact[i][want]).all()
    assert shard.read < 0.1 * 300 * 5000
