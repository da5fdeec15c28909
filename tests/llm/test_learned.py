import random
import zlib

import numpy as np
import pytest
from odd_rows import none, odd  # noqa: F401

from linepulse.llm import language_id, toxicity
from linepulse.llm.common import fold

SYLLABLES = {"en": "the and ing tion er wh".split(), "de": "sch ung ein ß ü keit".split(), "fr": "eau que è tion ment aux".split()}


def prose(lang, draw, n=60):
    s = SYLLABLES[lang]
    return " ".join("".join(draw.choice(s) for _ in range(draw.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        lang = draw.choice(list(SYLLABLES))
        text, toxic = prose(lang, draw), int(draw.random() < 0.2)
        if toxic:
            words = text.split()
            for w in ("grobol", "vexkind" if lang == "en" else "zorpal"):
                words.insert(draw.randrange(len(words)), w + (draw.choice("xyz") if lang != "en" else ""))
            text = " ".join(words)
        rows.append((i, text, lang, "s", len(text)))
        if draw.random() < 0.7:
            marks.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {i: int("grobol" in t) for i, t, *_ in rows}
    return docs, labels, truth


def test_language_on_held_out_rows(corpus, spark):
    docs, _, _ = corpus
    got = language_id.identify(docs)
    held = docs.select("doc_id", "lang").join(got, "doc_id").where("held_out").collect()
    assert len(held) > 60 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    # a prediction follows from the text alone
    model = language_id.train(docs)
    changed = docs.selectExpr("doc_id + 100000 AS doc_id", "text", "'xx' AS lang", "'t' AS source", "n_chars")
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    b = {r["doc_id"] - 100000: (r["lang_pred"], r["score"]) for r in language_id.predict(changed, model).collect()}
    assert a == b


def test_held_out_rows_teach_nothing(corpus, spark):
    docs, labels, _ = corpus
    spoiled = docs.selectExpr("doc_id", "IF(pmod(crc32(cast(doc_id AS string)), 5) = 0, 'qqqq zzzz grobol', text) AS text",
                              "IF(pmod(crc32(cast(doc_id AS string)), 5) = 0, 'zz', lang) AS lang", "source", "n_chars")
    a, b = language_id.train(docs), language_id.train(spoiled)
    assert a["languages"] == b["languages"] and (a["weights"] == b["weights"]).all()
    flipped = labels.selectExpr("doc_id", "quality", "IF(pmod(crc32(cast(doc_id AS string)), 5) = 0, 1 - toxic, toxic) AS toxic")
    x = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    y = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert x == y


def test_language_of_odd_rows(odd, none, corpus):
    model = language_id.train(corpus[0])
    for m in (model, None):
        got = language_id.predict(odd, m).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        letterless = {0, 1, 2, 15, 16}
        assert all((r["lang_pred"] == "und") == (m is None or r["doc_id"] in letterless) for r in got if r["doc_id"] is not None)
    assert language_id.identify(none).collect() == []
    assert language_id.in_known_language(none).collect() == []
    assert {r["doc_id"] for r in language_id.in_known_language(odd.selectExpr("doc_id", "text", "cast(null AS string) AS lang", "source", "n_chars")).collect()} == \
        {r["doc_id"] for r in odd.collect()} - letterless
    kept = language_id.in_known_language(odd)
    assert kept.columns == odd.columns and not {0, 1, 2, 16} & {r["doc_id"] for r in kept.collect()}


def test_ftrl_keeps_weights_at_zero_and_temperature_lowers_loss(monkeypatch):
    monkeypatch.setattr(language_id, "L1", 0.5)      # at its true value weights of rare terms stay at zero
    draw = np.random.default_rng(0)
    model = language_id.FTRL(50, 2)
    for _ in range(400):
        y = int(draw.integers(2))
        at = np.append(draw.choice(np.arange(2, 50), 5, replace=False), [y, 50])
        model.learn(np.sort(at), np.ones(7), y)
    w = model.weights(np.arange(51))
    assert w[0, 0] > 0.1 and w[1, 1] > 0.1 and (w[2:50] == 0).mean() > 0.2
    logits = draw.normal(size=(300, 3)) * 8
    labels = np.array([draw.choice(3, p=p) for p in language_id.softmax(logits / 4)])
    assert 3 < language_id.temperature(logits, labels) < 5.5


def unit_vectors(draw, n, n_terms, most):
    out = []
    for _ in range(n):
        t = np.sort(draw.choice(n_terms, draw.integers(0, most), replace=False))
        v = draw.random(len(t)) + 0.1
        out.append((t, v / np.sqrt(v @ v) if len(t) else v))
    return out


@pytest.mark.parametrize("common", [0, 7, 200])
def test_search_is_exact(common, monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON", common)
    draw = np.random.default_rng(common)
    vectors = unit_vectors(draw, 500, 80, 12)
    vectors += vectors[:60]                         # ties
    index = toxicity.Index(vectors, 80)
    dense = np.zeros((len(vectors), 80))
    for i, (t, v) in enumerate(vectors):
        dense[i, t] = v
    for but in (None, list(range(len(vectors)))):
        for q, (near, found) in enumerate(index.nearest(vectors, toxicity.K, but)):
            cosines = np.round(dense @ dense[q], 5)
            if but:
                cosines[q] = 0
            want = [i for i in np.lexsort((np.arange(len(vectors)), -cosines)) if cosines[i] > 0][:toxicity.K]
            assert np.allclose(found, cosines[want], atol=2e-5) and len(near) == len(want)
            assert np.allclose(cosines[near], found, atol=2e-5)


def test_search_skips_blocks():
    draw = np.random.default_rng(8)
    vectors = []
    for i in range(1280):                            # twenty groups with terms of their own
        t = np.sort(np.append(draw.choice(np.arange(20 + 30 * (i % 20), 50 + 30 * (i % 20)), 6, replace=False), draw.choice(20, 4, replace=False)))
        v = np.where(t < 20, 0.3, 1) * (draw.random(len(t)) + 0.5)
        vectors.append((t, v / np.sqrt(v @ v)))
    index = toxicity.Index(vectors, 620)
    index.nearest(vectors[:200], toxicity.K)
    assert index.opened < 0.5 * 200 * index.n_blocks


def brute_scores(docs, labels):
    """Scores of all texts in plain Python: dense cosines, votes, calibration by the other examples."""
    found = {i: toxicity.terms_of(t or "") for i, t in docs}
    known = {i: y for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 5 and i in found}
    ids = sorted(known)
    terms = {t for i in ids for t in found[i]}
    idf = {t: np.log((1 + len(docs)) / (1 + sum(t in set(w) for w in found.values()))) ** toxicity.POWER for t in terms}

    def vector(words):
        v = {t: words.count(t) * idf[t] for t in set(words) & terms if idf[t] > 0}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    examples = {i: vector(found[i]) for i in ids}

    def highest(words, but=None):
        best = None
        for part in toxicity.passages([t for t in words if t in terms]):
            v = vector(part)
            near = sorted(((-round(sum(x * e.get(t, 0) for t, x in v.items()), 5), i) for i, e in examples.items() if i != but))[:toxicity.K]
            near = [(-c, known[i]) for c, i in near if c < 0]
            if near:
                w = [1 / (toxicity.DISTANCE + 1 - c) for c, _ in near]
                vote = sum(a * y for a, (_, y) in zip(w, near)) / sum(w)
                best = vote if best is None else max(best, vote)
        return best

    own = {i: highest(found[i], i) for i in ids}
    some = [i for i in ids if own[i] is not None]
    curve = toxicity.isotonic(np.array([own[i] for i in some]), np.array([known[i] for i in some], dtype=float), np.ones(len(some)))
    rest = [known[i] for i in ids if own[i] is None]
    base = (sum(rest) + sum(known.values()) / len(known)) / (len(rest) + 1)
    same = {}
    for i in ids:
        same.setdefault(tuple(sorted((t, round(x, 9)) for t, x in examples[i].items())), []).append(known[i])
    out = {}
    for i, words in found.items():
        v = tuple(sorted((t, round(x, 9)) for t, x in vector(words).items()))
        best = highest(words)
        out[i] = np.mean(same[v]) if v and v in same else base if best is None else float(np.interp(best, *curve))
    return out


def test_scores_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PASSAGE", 20)
    draw = random.Random(21)
    docs = [(i, " ".join(["grobol" if i % 4 == 0 and k % 9 == 3 else prose("en", draw, 1)[:-1] for k in range(draw.randrange(5, 70))])) for i in range(90)]
    docs += [(100, docs[0][1]), (101, ""), (102, None), (103, "zzzzzz qqqqqq"), (104, docs[8][1] + " " + docs[8][1])]
    labels = [(i, int(i % 4 == 0)) for i in range(80)]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    want = brute_scores(docs, labels)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_ids_beside_null_stay_whole(spark):
    rows = [(2 ** 53 + 1, "the stone and the river"), (None, "the stone"), (2 ** 53 + 3, "a cloud")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for got in (toxicity.toxicity(df, marks), toxicity.toxicity(df, spark.createDataFrame([(2 ** 53 + 1, 1), (2 ** 53 + 3, 0)], "doc_id long, toxic int")), language_id.identify(df)):
        assert {r["doc_id"] for r in got.collect()} == {r[0] for r in rows}


def test_isotonic_is_monotone_and_pools():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert x.tolist() == [0.1, 0.1, 0.2, 0.3, 0.4, 0.4] and y.tolist() == [0, 0, 0.5, 0.5, 1, 1]


def test_toxicity_on_held_out_rows(corpus, odd, none, spark):
    docs, labels, truth = corpus
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    hit = next(r for r in got if r["predicted"] == 1)
    assert hit["evidence"] and all(0 < e["cosine"] <= 1 + 1e-9 for e in hit["evidence"])
    kept = toxicity.without_toxic(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]} and kept.columns == docs.columns
    # odd rows, labels with nulls and repeats, no labels, no rows
    marks = spark.createDataFrame([(3, 1), (3, 1), (4, None), (None, 1), (6, 0), (7, 0), (9, 2)], "doc_id long, toxic int")
    for m in (marks, marks.limit(0)):
        got = toxicity.toxicity(odd, m).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.without_toxic(odd, m).columns == odd.columns
    assert toxicity.toxicity(none, marks).collect() == []


def test_rare_marks_have_neighbours(spark):
    draw = random.Random(3)
    texts = {i: prose("en", draw, 30) for i in range(1, 60)}
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 5][:16]       # eight of a class, each toxic one with a mark of its own
    for k, i in enumerate(learned[:8]):
        texts[i] += f" {'bcdfghjk'[k]}{'lmnpqrst'[k]}uxx"
    labels = spark.createDataFrame([(i, int(k < 8)) for k, i in enumerate(learned)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*texts.items(), (1000, texts[learned[0]])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[1000]["predicted"] == 1 and got[1000]["evidence"][0]["doc_id"] == learned[0] and got[1000]["evidence"][0]["cosine"] == 1
    assert all(r["evidence"] for r in got.values())
    assert 1000 not in {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}


def test_fold_is_crc32(spark):
    import zlib
    ids = [0, 5, 17, 123456, -4]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold().alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)
