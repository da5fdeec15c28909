"""Operator 5: language identification by sparse multinomial logistic regression on character n-grams.

Features: TF-IDF (1 + log of the count, times the idf, unit length) of hashed character n-grams of sizes ``SIZES`` over
letters and word ends.  The idf comes from one pass over all training documents: every task sums document frequencies
of its rows, and one row per hash (2^BITS) is summed over the tasks.

Model: one weight vector per language, fitted by follow-the-regularised-leader (FTRL-proximal) with an elastic
net: the L1 part keeps weights at exactly zero until their evidence is larger, the L2 part shrinks them.  The fit runs in one
task on at most ``PER_LANGUAGE`` training documents of each language (the documented bound; drawn by a digest of the id), of
which every fifth is kept aside to fit the temperature that calibrates the probabilities.

Learning uses text and lang of training rows only; a prediction sees the text alone.  Texts are scored whole, row by row, with the
model (2^BITS weights a language) sent to the tasks.

Rows: null text, or one without a letter, is ``und`` with score 0; null lang is never learned; repeated rows are scored
each for itself; with nothing to learn from every row is ``und``; an empty table gives no rows; ties between languages go to the
first in code point order; further columns are not read.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.llm.common import fold, in_pandas, make_room, ship, whole_text, written
from linepulse.llm.ngrams import SPACE, bounded_sample, codes, hashed

SIZES = (1, 2, 3)
BITS = 16
PER_LANGUAGE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1     # learning rate, its smoothing, elastic net
SEED = "language-id"


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashes of a text and their counts; None without a letter."""
    c = codes(text)
    if not (c != SPACE).any():
        return None
    n = np.bincount(hashed(c, SIZES, BITS), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / np.sqrt(v @ v)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FTRL:
    """Multinomial FTRL-proximal; the last row is the bias, which is not penalised."""

    def __init__(self, n_features: int, n_classes: int):
        self.z = np.zeros((n_features + 1, n_classes))
        self.n = np.zeros((n_features + 1, n_classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        bias = at == len(self.z) - 1
        w[bias] = -z[bias] * ALPHA / (BETA + np.sqrt(n[bias]))
        return w

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(v @ w)
        error[label] -= 1
        g = v[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[str, str]], languages: list[str], idf: np.ndarray) -> dict:
    """Model from (text, lang) rows in a fixed order: weights (float32), bias, temperature."""
    known = {x: i for i, x in enumerate(languages)}
    data = []
    for text, lang in rows:
        if (terms := term_counts(text)) is not None:
            data.append((np.append(terms[0], 1 << BITS).astype(np.int32), np.append(weighted(*terms, idf), 1.0).astype(np.float32), known[lang]))
    aside = [d for i, d in enumerate(data) if i % 5 == 4] or data
    learned = [d for i, d in enumerate(data) if i % 5 != 4] or data
    model = FTRL(1 << BITS, len(languages))
    draw = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(learned)):
            model.learn(*learned[i])
    w = model.weights(np.arange((1 << BITS) + 1))
    logits = np.array([v @ w[at] for at, v, _ in aside]).reshape(len(aside), len(languages))
    labels = np.array([d[2] for d in aside], dtype=int)
    return {"languages": languages, "weights": w[:-1].astype(np.float32), "bias": w[-1].astype(np.float32), "idf": idf.astype(np.float32),
            "temperature": temperature(logits, labels)}


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b, g = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every hash over all training rows, and the number of rows."""
    def run(batches):
        df, rows = np.zeros(1 << BITS, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                if (terms := term_counts(text)) is not None:
                    df[terms[0]] += 1
                    rows += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"h": np.append(at, -1), "df": np.append(df[at], rows)})

    df, rows = np.zeros(1 << BITS, dtype=np.int64), 0
    for r in in_pandas(train.select("text"), run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).collect():   # one row per hash
        if r["h"] < 0:
            rows = r["df"]
        else:
            df[r["h"]] = r["df"]
    return df, rows


def train(docs: DataFrame) -> dict | None:
    """The model of ``docs`` (columns doc_id, text, lang), or None with nothing to learn from."""
    labelled = docs.where(F.col("lang").isNotNull() & (fold() != 0)).select("doc_id", whole_text().alias("text"), "lang")
    drawn, sizes = bounded_sample(labelled, "doc_id", "lang", PER_LANGUAGE, SEED)
    if not sizes:
        return None
    languages = sorted(sizes)
    df, rows = document_frequencies(labelled)
    idf = np.log((1 + rows) / (1 + df)) + 1

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        found = pd.concat(batches, ignore_index=True).sort_values(["doc_id", "lang", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(fit(list(zip(found["text"], found["lang"])), languages, idf))]})

    # at most PER_LANGUAGE documents of each language
    one = drawn.limit(PER_LANGUAGE * len(languages)).coalesce(1)
    made = written(in_pandas(one, run, "model binary"), "language-model").first()
    return pickle.loads(made["model"]) if made else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    def run(batches):
        for pdf in batches:
            found = [score(model, t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_pandas(src, run, "doc_id long, lang_pred string, score double")


def score(model: dict | None, text: str) -> tuple[str, float]:
    terms = term_counts(text)
    if model is None or terms is None:
        return "und", 0.0
    v = weighted(*terms, model["idf"])
    p = softmax((v.astype(np.float32) @ model["weights"][terms[0]] + model["bias"]).astype(float) / model["temperature"])
    best = int(p.argmax())
    return model["languages"][best], float(p[best])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not ``und``: those with a letter, also where no language was learned; nothing is shuffled."""
    model = train(docs.select("doc_id", "text", "lang"))

    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make_room()
        for texts in batches:
            yield pd.Series([score(model, t)[0] != "und" if model else term_counts(t) is not None for t in texts])

    ship(docs.sparkSession)
    return docs.where(F.pandas_udf(known, "boolean")(whole_text()))
