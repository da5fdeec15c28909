"""Operator 3: toxicity by the nearest labelled examples under exact TF-IDF cosine, with block-max inverted indexes.

Terms: the first ``PREFIX`` letters of each word (longer runs than ``RUN`` letters, as in scripts without spaces, are cut into pieces of that size), weighted by
tf * idf ^ ``POWER``; idf = ln((1 + N) / (1 + df)) counted over all documents.  Examples: at most ``PER_CLASS`` labelled documents of each class, drawn by
a digest of the id from rows that are not held out (the documented bound of the index), each one vector of its whole text.

Queries: a text is cut into passages, two or four of a short text and pieces of about ``PASSAGE`` words of a long one (whole texts, nothing is left out), and
each passage finds its K nearest examples, so that marks count in a long text as in a short one.

Index: examples are ordered by their heaviest frequent term, so that blocks of ``BLOCK`` are alike.  Lists of the ``COMMON`` longest-listed terms, which reach
nearly every block, are dense rows, scored for many passages by one matrix product.  All other terms have inverted lists with the greatest weight
of each block.  A block whose greatest dense score plus the greatest weights of the passage's other terms stays below the K-th best score is
skipped: the ``FIRST`` blocks of the highest bounds are opened, then those whose bound reaches the K-th best of then.  Nothing is approximate but the 32-bit sums: the K nearest are those of all examples, by cosines to
five decimals (ties: the earlier example).

Score: neighbours vote, weighted by 1 / (DISTANCE + 1 - cosine); a text's vote is the highest of its passages, whose neighbours are its evidence.  The examples'
own votes (themselves left out) calibrate votes to the rate of the label by isotonic regression, with the classes at their true
sizes.  A text whose term vector points where an example's does takes the label of such examples; a text without neighbours
takes the rate of such examples.

Labels, language, source and id are no input of a score.  Texts are read twice, for the idf and for the scores; the index, bounded by the examples, is
sent to the tasks that search.

Rows: null and empty texts have no terms; null labels are not learned from, a doc_id with several labels takes the largest, one
with several texts the least; repeated rows are scored each for itself; with no labels every score is 0; an empty table gives no rows; further columns are
not read.
"""

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.llm.common import fold, in_arrow, make_room, per_worker, ship, whole_text, written
from linepulse.llm.ngrams import bounded_sample

PREFIX = 4
RUN = 24
PASSAGE = 200         # words of a passage of a long text
SHORT, LEAST = 160, 15     # a text of so many words has four passages, a longer one two at least; words of the shortest passages
POWER = 1.5           # of the idf
PER_CLASS = 2000      # labelled examples of each class at most
K = 20
BLOCK = 64
COMMON = 1024         # terms with dense lists
FIRST = 12            # blocks opened at first; then all that may still hold one of the nearest
DISTANCE = 0.05
ROWS = 96             # passages scored at a time
MARGIN = 1e-5         # above the error of 32-bit scores; cosines below it count as 0
SEED = "toxicity"
WORD = re.compile(r"[^\W\d_]+")
SPACED = {c: " " for c in range(128) if not chr(c).isalpha()}      # parts the words of plain ASCII as WORD does


def terms_of(text: str) -> list[str]:
    """The terms of a text, in order."""
    lower = text.lower()
    words = lower.translate(SPACED).split() if lower.isascii() else WORD.findall(lower)
    if max(map(len, words), default=0) <= RUN:
        return [w[:PREFIX] for w in words]
    return [p for w in words for p in ([w[:PREFIX]] if len(w) <= RUN else [w[i:i + PREFIX] for i in range(0, len(w), PREFIX)])]


def passages(terms: list) -> list[list]:
    """Terms of a text in passages of about the same size."""
    n = max(1, round(len(terms) / PASSAGE), min(4 if len(terms) <= SHORT else 2, round(len(terms) / LEAST)))
    step = max(-(-len(terms) // n), 1)
    return [terms[i:i + step] for i in range(0, max(len(terms), 1), step)]


def counted(terms) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and their counts."""
    t = np.sort(np.asarray(terms, dtype=np.int64))
    begin = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else t
    return t[begin], np.diff(np.append(begin, len(t)))


def direction(vector: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Equal for count vectors that point the same way."""
    terms, counts = vector
    return terms.tobytes() + (counts // np.gcd.reduce(counts)).tobytes() if len(terms) else b""


def unit(vector: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF unit vector of counts; terms without weight are left out."""
    terms, counts = vector
    v = counts * idf[terms]
    some = v > 0
    terms, v = terms[some], v[some]
    return terms, v / np.sqrt(v @ v) if len(v) else v


class Index:
    """Block-max inverted index over unit vectors: exact K nearest by cosine."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        n = len(vectors)
        self.n_blocks = max(-(-n // BLOCK), 1)
        size = self.n_blocks * BLOCK
        df = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *[t for t, _ in vectors]]), minlength=n_terms)
        common = np.sort(np.argsort(-df, kind="stable")[:COMMON])
        self.place = np.full(n_terms, -1, dtype=np.int64)
        self.place[common] = np.arange(len(common))
        heaviest = [max(((w, t) for t, w in zip(ts, ws) if self.place[t] >= 0), default=(0.0, -1))[1] for ts, ws in vectors]
        order = np.lexsort((np.arange(n), heaviest)) if n else np.zeros(0, dtype=np.int64)
        self.example = np.concatenate([order, np.full(size - n, -1, dtype=np.int64)])     # place -> example
        self.slot = np.empty(n, dtype=np.int64)
        self.slot[order] = np.arange(n)
        vectors = [vectors[i] for i in order]
        term = np.concatenate([np.zeros(0, dtype=np.int64), *[t for t, _ in vectors]])
        weight = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
        at = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        dense = self.place[term] >= 0
        self.dense = np.zeros((len(common), size), dtype=np.float32)
        self.dense[self.place[term[dense]], at[dense]] = weight[dense]
        # inverted lists by (term, block)
        cell = term[~dense] * self.n_blocks + at[~dense] // BLOCK
        by = np.argsort(cell, kind="stable")
        self.doc, self.posted = at[~dense][by].astype(np.int32), weight[~dense][by].astype(np.float32)
        self.start = np.searchsorted(cell[by], np.arange(n_terms * self.n_blocks + 1)).astype(np.int32)
        self.highest = np.zeros((n_terms, self.n_blocks), dtype=np.float32)
        np.maximum.at(self.highest.reshape(-1), cell[by], self.posted)
        self.opened = 0            # blocks opened so far

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Examples and cosines of the k nearest with a positive cosine of each vector, nearest first; ``but`` are left out."""
        out = []
        for at in range(0, len(vectors), ROWS):
            out += self._nearest(vectors[at:at + ROWS], k, but[at:at + ROWS] if but else None)
        return out

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of a few vectors at once: each is a row of the scores."""
        n = len(vectors)
        row = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors]).astype(np.float32)
        place = self.place[term]
        dense = place >= 0
        q = np.zeros((n, len(self.dense)), dtype=np.float32)
        q[row[dense], place[dense]] = weight[dense]
        scores = q @ self.dense
        if but:
            scores[np.arange(n), self.slot[but]] = -4      # below anything the rest can add
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        if len(term):
            highest = self.highest[term]
            bound = scores.reshape(n, self.n_blocks, BLOCK).max(axis=2)
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            bound[row[begin]] += np.add.reduceat(highest * weight[:, None], begin)
            may = (bound > 0) & (bound >= self._kth(scores, k)[:, None] - MARGIN)
            first = may & (bound >= np.partition(bound, -FIRST, axis=1)[:, -FIRST, None]) if self.n_blocks > FIRST else may
            self._open(scores, first, highest, row, term, weight)
            rest = may & ~first
            some = np.flatnonzero(rest.any(axis=1))
            if len(some):
                rest[some] &= bound[some] >= self._kth(scores[some], k)[:, None] - MARGIN
                self._open(scores, rest, highest, row, term, weight)
        of, near = np.nonzero(scores >= np.maximum(self._kth(scores, k) - np.float32(MARGIN), np.float32(MARGIN))[:, None])
        cosine, example = np.round(scores[of, near].astype(np.float64), 5), self.example[near]
        by = np.lexsort((example, -cosine, of))
        cosine, example = cosine[by], example[by]
        begin = np.searchsorted(of, np.arange(n + 1)).tolist()
        return [(example[b:min(b + k, e)], cosine[b:min(b + k, e)]) for b, e in zip(begin, begin[1:])]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each row, 0 where there are no more than k."""
        return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(len(scores), dtype=np.float32)

    def _open(self, scores: np.ndarray, blocks: np.ndarray, highest: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Add what the lists of the terms hold in the opened blocks of their rows."""
        self.opened += int(blocks.sum())
        i, block = np.nonzero(blocks[row] & (highest > 0))
        cell = term[i] * self.n_blocks + block
        begin = self.start[cell]
        count = self.start[cell + 1] - begin
        end = np.cumsum(count)
        where = np.repeat(begin - end + count, count) + np.arange(end[-1] if len(end) else 0)
        np.add.at(scores.reshape(-1), np.repeat(row[i] * scores.shape[1], count) + self.doc[where], np.repeat(weight[i], count) * self.posted[where])


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    w = 1 / (DISTANCE + 1 - cosines)
    return float(w @ labels / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function nearest to (x, y) under weights: pooled adjacent violators."""
    xs, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at, w)
    pools = []
    for a, value, n in zip(xs, np.bincount(at, w * y) / weight, weight):
        pools.append([a, a, value, n])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, hi, v, m = pools.pop()
            p = pools[-1]
            p[1], p[2], p[3] = hi, (p[2] * p[3] + v * m) / (p[3] + m), p[3] + m
    return np.array([e for p in pools for e in (p[0], p[1])]), np.array([p[2] for p in pools for _ in (0, 1)])


class Model:
    """Terms, their idf, the examples (texts as term counts) and the calibration.  What searches is made in the tasks (``Searcher``)."""

    def __init__(self, ids, labels, vectors, terms, idf, class_weights):
        self.ids, self.labels, self.vectors, self.terms, self.idf = ids, labels, vectors, terms, idf
        self.weight = np.where(labels == 1, class_weights[1], class_weights[0])

    def calibration(self, at: np.ndarray, votes: np.ndarray) -> tuple[tuple, float]:
        """The curve from the votes of examples ``at`` by the others, and the rate of those without neighbours."""
        none = np.ones(len(self.ids), dtype=bool)
        none[at] = False
        curve = isotonic(votes, self.labels[at].astype(float), self.weight[at]) if len(at) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        weight, labels = self.weight, self.labels
        return curve, float((weight[none] @ labels[none] + (weight @ labels) / weight.sum()) / (weight[none].sum() + 1))


class Searcher:
    """The search of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.number = {t: i for i, t in enumerate(model.terms)}
        self.index = Index([unit(v, model.idf) for v in model.vectors], len(model.terms))
        same = {}
        for i, v, y in zip(model.ids, model.vectors, model.labels):
            if len(v[0]):
                same.setdefault(direction(v), []).append((int(i), 1.0, int(y)))
        self.same = {d: (sum(y for *_, y in found) / len(found), found[:3]) for d, found in same.items()}

    def known(self, text: str) -> list[int]:
        return [n for n in map(self.number.get, terms_of(text)) if n is not None]

    def votes(self, texts: list[list[int]], but: list[int] | None = None) -> list[tuple[float | None, list[tuple]]]:
        """The highest vote of each text's passages, and the three nearest examples of that passage."""
        parts, of = [], []
        for i, terms in enumerate(texts):
            found = [unit(counted(p), self.model.idf) for p in passages(terms)]
            parts += found
            of += [i] * len(found)
        out: list = [(None, [])] * len(texts)
        m = self.model
        near = self.index.nearest(parts, K, [but[i] for i in of] if but else None)
        for i, (examples, cosines) in zip(of, near):
            if len(examples):
                v = vote(m.labels[examples], cosines)
                if out[i][0] is None or v > out[i][0]:
                    out[i] = v, [(int(m.ids[e]), float(c), int(m.labels[e])) for e, c in zip(examples[:3], cosines[:3])]
        return out

    def scores(self, texts: list[str], curve: tuple, base: float) -> list[tuple[float, list[tuple]]]:
        out = []
        for at in range(0, len(texts), ROWS):
            known = [self.known(t) for t in texts[at:at + ROWS]]
            for terms, (found, evidence) in zip(known, self.votes(known)):
                same = self.same.get(direction(counted(terms))) if evidence else None
                if same:
                    out.append((same[0], (same[1] + [e for e in evidence if e not in same[1]])[:3]))
                else:
                    out.append((base if found is None else float(np.interp(found, *curve)), evidence))
        return out


class Packed:
    """A model on its way to the tasks, and its calibration."""

    def __init__(self, model: Model):
        self.data = pickle.dumps(model, protocol=5)
        self.token = hashlib.blake2b(self.data, digest_size=16).hexdigest()
        self.curve, self.base = (np.array([0.0, 1.0]), np.array([0.0, 1.0])), 0.0


@per_worker
def held() -> dict:
    return {}


def searcher(packed: Packed) -> Searcher:
    """A worker's search of the model, made once; only that of the last model is kept."""
    kept = held()
    if packed.token not in kept:
        kept.clear()
        kept[packed.token] = Searcher(pickle.loads(packed.data))
    return kept[packed.token]


def examples(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """doc_id, y, text of the drawn examples, and the number of labelled rows of each class."""
    marked = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .where((fold() != 0) & F.col("y").isin(0, 1)))
    drawn, sizes = bounded_sample(marked, "doc_id", "y", PER_CLASS, SEED)
    few = F.broadcast(drawn.limit(2 * PER_CLASS))      # ids of at most PER_CLASS rows a class
    found = docs.select("doc_id", whole_text().alias("text")).join(few, "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), sizes


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Packed | None:
    """The model, or None without labels."""
    found, sizes = examples(docs, labels, label)

    def run(batches):
        for batch in batches:
            terms = [terms_of(t) for t in batch.column(2).to_pylist()]
            counts = [Counter(t) for t in terms]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.string())), pa.array([list(c) for c in counts], pa.list_(pa.string())),
                                              pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["doc_id", "y", "terms", "found", "n"])

    # written, so that the index and the examples' votes come from the same rows
    texts = written(in_arrow(found.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text"), run,
                             "doc_id long, y int, terms array<string>, found array<string>, n array<long>"), "toxic-examples")
    rows = texts.select("doc_id", "y", "found", "n").orderBy("doc_id").toArrow()       # at most PER_CLASS examples a class
    if not rows.num_rows:
        return None
    lists = rows.column("found").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    number = np.empty(len(names), dtype=np.int64)
    number[order] = np.arange(len(names))
    codes, n = number[coded.indices.to_numpy()] if names else np.zeros(0, dtype=np.int64), rows.column("n").combine_chunks().flatten().to_numpy()
    begin = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    vectors = []
    for b, e in zip(begin[:-1], begin[1:]):
        by = np.argsort(codes[b:e])
        vectors.append((codes[b:e][by], n[b:e][by]))
    terms = [names[i] for i in order]
    ids, labels_of = rows.column("doc_id").to_numpy(), rows.column("y").to_numpy()
    per = [sizes.get(c, 0) / max(int((labels_of == c).sum()), 1) for c in (0, 1)]
    packed = Packed(Model(ids, labels_of, vectors, terms, inverse_frequencies(docs, terms), per))
    packed.curve, packed.base = pickle.loads(packed.data).calibration(*own_votes(texts, packed))
    return packed


def inverse_frequencies(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """idf of the terms over all documents."""
    def run(batches):
        number = {t: i for i, t in enumerate(terms)}
        df, rows = np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            found = [n for t in batch.column(0).to_pylist() for n in map(number.get, set(terms_of(t))) if n is not None]
            df += np.bincount(np.array(found, dtype=np.int64), minlength=len(terms))
            rows += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], names=["term", "df"])

    total = in_arrow(docs.select(whole_text().alias("text")), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()   # a row a term
    df = np.zeros(len(terms) + 1)
    df[total["term"].to_numpy()] = total["df"].to_numpy()
    return np.log((1 + df[-1]) / (1 + df[:-1])) ** POWER


def own_votes(texts: DataFrame, packed: Packed) -> tuple[np.ndarray, np.ndarray]:
    """The examples' numbers and votes, themselves left out."""
    def run(batches):
        for batch in batches:
            s = searcher(packed)
            at = np.searchsorted(s.model.ids, batch.column(0).to_numpy()).tolist()
            votes = [v for v, _ in s.votes([[s.number[t] for t in terms] for terms in batch.column(1).to_pylist()], at)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(votes, pa.float64())], names=["at", "vote"])

    parts = 2 * texts.sparkSession.sparkContext.defaultParallelism
    got = in_arrow(texts.select("doc_id", "terms").repartition(parts), run, "at long, vote double", ("toxicity",)).where("vote IS NOT NULL").orderBy("at").toArrow()
    return got["at"].to_numpy(), got["vote"].to_numpy()


EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def score_documents(docs: DataFrame, packed: Packed | None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row."""
    shape = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,label:int>>"

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = searcher(packed).scores(texts, packed.curve, packed.base) if packed else [(0.0, [])] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in out], pa.float64()), pa.array([int(p >= 0.5) for p, _ in out], pa.int32()),
                                              pa.array([[{"doc_id": d, "cosine": c, "label": y} for d, c, y in e] for _, e in out], EVIDENCE)],
                                             names=["doc_id", "held_out", "score", "predicted", "evidence"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), whole_text().alias("text"))
    return in_arrow(src, run, shape, ("toxicity",))


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; rows are scored where they are, nothing is shuffled."""
    packed = fit(docs, labels, label)
    if packed is None:
        return docs

    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make_room("toxicity")
        for texts in batches:
            yield pd.Series([p >= 0.5 for p, _ in searcher(packed).scores(list(texts), packed.curve, packed.base)])

    ship(docs.sparkSession)
    return docs.where(~F.pandas_udf(toxic, "boolean")(whole_text()))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    return score_documents(docs, fit(docs, labels, label))
