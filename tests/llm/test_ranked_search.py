import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd_rows import SHAPE, none, odd, rows  # noqa: F401

from linepulse.llm import ranked_search

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, k):
    """Sorted (item, rank, doc_id, score) over all documents and items."""
    found = [(i, w) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_terms = len(found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    of = {}
    for i, t in items:
        if i is not None:
            of.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in of.items():
        scores = []
        for i, w in found:
            tf, m = Counter(w), 100 - 50 + 50 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, at + 1, None if no else i, -s) for at, (s, no, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def answers(docs, items, **with_):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked_search.search(docs, items, **with_).collect()), key=str)


ITEMS = [(1, "stone river cloud"), (2, "Naïve CAFÉ 東京"), (3, None), (4, "... !"), (None, "stone"), (5, "word1 word2 word976 of7 the"), (6, "lantern"), (6, "paper copper"),
         (2 ** 53 + 1, "12345 garden signal signal winter")]


def test_odd_rows(spark, odd):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in rows()], ITEMS, 9)
    assert want and answers(odd, items, k=9) == want


@pytest.mark.parametrize("seed", range(2))
def test_slices_bundles_and_waves(spark, monkeypatch, seed):
    draw = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(["common", *draw.choices(vocabulary, weights, k=draw.randrange(0, 60))])) for i in range(500)]
    docs += [(1000 + i, "t3 t50 t60") for i in range(60)]                       # ties
    items = [(i, " ".join(["common", *draw.choices(vocabulary, weights, k=draw.randrange(1, 25))])) for i in range(30)]
    monkeypatch.setattr(ranked_search, "SLICE", 90)
    got = answers(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=7, bundle=8, wave=100)
    assert got == brute(docs, items, 7)


def test_stages_drop_accumulators_and_keep_the_best(monkeypatch):
    draw = random.Random(2)
    n, size = 3000, np.full(3000, 40, dtype=np.int64)
    terms = [b"rare", b"mid", b"often", b"always"]
    df = np.array([60, 500, 1500, 2500])
    docs = [np.sort(np.array(draw.sample(range(n), int(x)), dtype=np.int64)) for x in df]
    impact = ranked_search.impacts(np.ones(1, dtype=np.int64), size[:1], n, 40 * n)[0]
    plan = ranked_search.Plan(terms, [(0, 7, t) for t in terms], df, np.full(4, impact), n, 40 * n, 1, 5)
    plan.owner = np.arange(4)
    plan.ahead = {0: [np.array([float((plan.weight[s:] * impact).sum())]) for s in range(5)]}
    now, held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3)), []
    for s in range(4):
        now = ranked_search.add(plan, s, 0, now, (docs[s], np.full(len(docs[s]), s), np.full(len(docs[s]), plan.weight[s] * impact)))
        held.append(len(now[0]))
    score = np.zeros(n, dtype=np.int64)
    for s in range(4):
        score[docs[s]] += plan.weight[s] * impact
    best = np.lexsort((np.arange(n), -score))[:5]
    got = dict(zip(now[1], now[2]))
    assert all(got[d] == score[d] for d in best) and held[-1] < 0.2 * (score > 0).sum()


def test_no_documents_or_items(spark, none):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert answers(none, items) == []
    docs = spark.createDataFrame([(1, "stone")], "doc_id long, text string")
    assert answers(docs, spark.createDataFrame([], "item_id long, text string")) == []
    assert answers(docs, spark.createDataFrame([(1, "other words")], "item_id long, text string")) == []
