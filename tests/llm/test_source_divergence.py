import random
import re
from collections import Counter, defaultdict

import numpy as np
from odd_rows import none, odd, rows  # noqa: F401

from linepulse.llm import source_divergence
from linepulse.llm.common import written

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(docs, top=200):
    """All rows, in Python integers."""
    df, count, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))
        langs[lang].add(source)
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= 3]

        def weights(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10 ** 9 * (of[t] + 1) // (n + len(kept)) for t in kept}

        whole = weights(sum((count[lang, s] for s in sources), Counter()))
        p = {s: weights(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for at, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, at + 1))
    return out


def answers(df, **with_):
    got = [tuple(r[c] for c in COLUMNS) for r in source_divergence.audit(df, **with_).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_odd_rows(spark, odd):  # noqa: F811
    assert answers(odd) == brute([(r[1], r[2], r[3]) for r in rows()])


def test_many_levels_blocks_and_sources(spark, monkeypatch):
    draw = random.Random(5)
    vocabulary = [a + b for a in "abcdefghijklmnopqrst" for b in "uvwxyzéß東"]
    docs = []
    for i in range(300):
        own = draw.sample(vocabulary, 40)
        docs.append((" ".join(draw.choices(own, k=draw.randrange(200))), draw.choice(["en", "de"]), "hot" if i % 3 == 0 else f"s{draw.randrange(9)}"))
    docs += [("!!! 12", "en", "empty"), (None, "xx", "a"), ("one two", "xx", "b"), (None, "xx", None)]
    tables = source_divergence.joint_tables
    monkeypatch.setattr(source_divergence, "joint_tables", lambda v, g: tables(v, g, terms=16, sources=3))
    monkeypatch.setattr(source_divergence, "HELD", 100)
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)
    assert answers(df, top=7) == brute(docs, 7)


def test_no_rows(spark, none):  # noqa: F811
    assert answers(none) == set()


def test_product_is_the_matrix_product():
    draw = np.random.default_rng(1)
    a, b = (draw.random((50, 30)) < 0.2), (draw.random((50, 17)) < 0.2)
    got = np.zeros((30, 17), dtype=int)
    for i, j, n in source_divergence.product(np.nonzero(a), np.nonzero(b), 50, tile=8):
        got[i, j] = n
    assert (got == a.T.astype(int) @ b.astype(int)).all()


def test_joint_tables_count_terms(spark):
    docs = [("x x y z", "en", "a"), ("x y y w", "en", "b"), ("x y z w", "en", "a")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    partial = written(source_divergence.partial_counts(df), "test")
    groups = source_divergence.groups_of(partial)
    vectors = source_divergence.term_vectors(partial, groups, 2, 1)
    got = {(r["c"], r["d"]): r["n"] for r in source_divergence.joint_tables(vectors, groups).collect()}
    assert got == {(3, 1): 1, (2, 2): 1, (1, 1): 1}      # x, y, w; z is only in a
