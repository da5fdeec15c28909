"""Operator 11: ranked lexical search by pipelined term partitioning.

Every item (a query text) scores every document by integer contributions of the terms they share:

  w = floor(1000 * ln((2 N + 2) / (2 df + 1))),  m = 50 + (50 n N) div L,  score = sum over shared terms of w * ((10^9 tf) div (1000 tf + 20 m))

The index is partitioned by term: ``OWNERS`` stages own the items' terms, the rarest first, with about as many postings each.  Bundles of items travel
through the stages and carry their accumulators, pairs of document and partial score, with them: at each stage the bundle's accumulators are
cogrouped with the postings of the terms the stage owns, and the contributions are added.  The last stage hands over the best of each
item.  Accumulators live in slices of documents, so a bundle at a stage is as many independent tasks as there are slices.

An accumulator is dropped, or not opened, only if it can't be among the k best: scores never fall, so the k-th best partial score of a slice is a lower
bound, and partial score plus the most that the stages ahead can add (their terms' weights times their greatest impact in the table) is an upper one.

Documents are read once for each wave of items; a wave's terms (about ``WAVE`` at most, with W waves for W * WAVE item terms) are the dictionary that its tasks
hold.  Postings are written as arrays, a row for a slice.  Weights and greatest impacts, one row a term of the wave, come to the driver.

Rows: null texts have no terms; documents without terms count for nothing; repeated rows are documents of their own (their doc_id may come twice);
a null doc_id is ranked after all others of its score; items without an id or terms give no rows, rows of one item_id add up their terms;
ties go to the smaller doc_id; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepulse.llm.common import beside, in_arrow, whole_text, written

K = 50
OWNERS = 4           # stages
BUNDLE = 256         # items of a bundle, about
WAVE = 1_000_000     # item terms of a wave, about
SLICE = 16384        # documents of a slice
POSTINGS = 2_000_000 # postings of a slice, about
IMPACT = 1_000_000_000
MOST = 2 ** 63 - 1

# every byte that is no letter or digit becomes a space, A-Z their lower case; bytes of characters beyond ASCII stay
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SLICES = "slice long, n_docs long, n_terms long, doc_ids binary, no_id binary, sizes binary, doc binary, term binary, tf binary"
BLOCKS = "slice long, bundle int, doc_ids binary, no_id binary, doc binary, term binary, gain binary"
CARRIED = "slice long, bundle int, item binary, doc binary, score binary"
FOUND = "item_id long, doc_id long, score long"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORDS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (bytes): the distinct terms of every item."""
    def run(batches):
        for batch in batches:
            found = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([w for _, w in found], pa.binary())], names=["item_id", "term"])

    src = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    return in_arrow(src, run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Slices of documents with the occurrences of ``terms`` (by their place in the list), a row each."""
    def run(batches):
        number = {t: i for i, t in enumerate(terms)}
        count = 0

        def row():
            nonlocal count
            count += 1
            arrays = (np.array(ids, "<i8"), np.array(no_id, bool), np.array(sizes, "<i8"), np.concatenate([np.zeros(0, "<i4"), *doc]), np.concatenate([np.zeros(0, "<i4"), *term]), np.concatenate([np.zeros(0, "<i8"), *tf]))
            place = (TaskContext.get().partitionId() << 33) + count
            return pa.RecordBatch.from_arrays([pa.array([place]), pa.array([n_docs]), pa.array([n_terms]), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                                              names=["slice", "n_docs", "n_terms", "doc_ids", "no_id", "sizes", "doc", "term", "tf"])

        n_docs = n_terms = held = 0
        ids, no_id, sizes, doc, term, tf = [], [], [], [], [], []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if not found:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(found)
                at, n = np.unique(np.array([p for p in map(number.get, found) if p is not None], "<i4"), return_counts=True)
                if len(at):
                    doc.append(np.full(len(at), len(ids), "<i4"))
                    term.append(at)
                    tf.append(n.astype("<i8"))
                    ids.append(i or 0)
                    no_id.append(i is None)
                    sizes.append(len(found))
                    held += len(at)
                if len(ids) >= SLICE or held >= POSTINGS:
                    yield row()
                    n_docs = n_terms = held = 0
                    ids, no_id, sizes, doc, term, tf = [], [], [], [], [], []
        if n_docs:
            yield row()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(src, run, SLICES)


def numbers(row, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[column], kind)


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), in 64-bit integers."""
    if len(size) and 50 * int(size.max()) * n_docs > MOST:
        m = np.array([50 + 50 * int(n) * n_docs // n_terms for n in size], dtype=np.int64)
    else:
        m = 50 + 50 * size * n_docs // n_terms
    return IMPACT * tf // (1000 * tf + 20 * m)


def statistics(slices: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """term, df, most (its greatest impact in any document)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                term = numbers(row, "term", "<i4")
                size = numbers(row, "sizes", "<i8")[numbers(row, "doc", "<i4")]
                gain = impacts(numbers(row, "tf", "<i8"), size, n_docs, n_terms)
                some, at, df = np.unique(term, return_inverse=True, return_counts=True)
                most = np.zeros(len(some), dtype=np.int64)
                np.maximum.at(most, at, gain)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(df), pa.array(most)], names=["term", "df", "most"])

    return in_arrow(slices.select("sizes", "doc", "term", "tf"), run, "term long, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


def owners(df: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The stage of each term, the rarest first; -1 for terms that add nothing."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    stage = np.empty(len(df), dtype=np.int64)
    stage[order] = np.minimum(before * n // max(int(df.sum()), 1), n - 1)
    return np.where(weight > 0, stage, -1)


class Plan:
    """What the tasks of a wave need to know: term weights and owners, and which items of which bundle hold a term."""

    def __init__(self, terms: list[bytes], of_items: list, df: np.ndarray, most: np.ndarray, n_docs: int, n_terms: int, n_bundles: int, k: int):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        self.owner = owners(df, self.weight, OWNERS)
        number = {t: i for i, t in enumerate(terms)}
        self.items = {}                    # bundle -> item ids
        holds = {}                         # bundle -> (item places, term numbers)
        for bundle, item, term in of_items:
            ids, rows = self.items.setdefault(bundle, {}), holds.setdefault(bundle, ([], []))
            rows[0].append(ids.setdefault(item, len(ids)))
            rows[1].append(number[term])
        self.holds = {b: tuple(np.array(x, dtype=np.int64) for x in rows) for b, rows in holds.items()}
        self.items = {b: np.array(list(ids), dtype=np.int64) for b, ids in self.items.items()}
        # the most that the stages from s on can add to an item
        self.ahead = {}
        for b, (item, term) in self.holds.items():
            gain = self.weight[term] * most[term]
            self.ahead[b] = [np.bincount(item, gain * (self.owner[term] >= s), minlength=len(self.items[b])) * (1 + 1e-9) for s in range(OWNERS + 1)]


def blocks(slices: DataFrame, plan: Plan, stage: int) -> DataFrame:
    """The postings that a stage owns, as contributions: a row for each slice and bundle."""
    def run(batches):
        used = {b: np.isin(np.arange(len(plan.weight)), term) for b, (_, term) in plan.holds.items()}
        for batch in batches:
            for row in batch.to_pylist():
                doc, term = numbers(row, "doc", "<i4"), numbers(row, "term", "<i4")
                own = plan.owner[term] == stage
                doc, term, tf = doc[own], term[own], numbers(row, "tf", "<i8")[own]
                gain = plan.weight[term] * impacts(tf, numbers(row, "sizes", "<i8")[doc], plan.n_docs, plan.n_terms)
                order = np.argsort(term, kind="stable")
                last = stage == OWNERS - 1
                for b in plan.items:
                    mine = order[used[b][term[order]]]
                    cells = [row["doc_ids"] if last else b"", row["no_id"] if last else b"", doc[mine].tobytes(), term[mine].tobytes(), gain[mine].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([row["slice"]]), pa.array([b], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]],
                                                     names=["slice", "bundle", "doc_ids", "no_id", "doc", "term", "gain"])

    return in_arrow(slices.where("length(term) > 0").select("slice", "doc_ids", "no_id", "sizes", "doc", "term", "tf"), run, BLOCKS)


def add(plan: Plan, stage: int, bundle: int, carried: tuple, block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of a bundle in a slice after a stage; accumulators that can't win are gone."""
    item, doc, score = carried
    at, term, gain = block
    n_items = len(plan.items[bundle])
    width = int(max(doc.max(initial=-1), at.max(initial=-1))) + 1
    total = np.zeros((n_items, width), dtype=np.int64)
    total[item, doc] = score
    k = plan.k

    def least(scores):           # the k-th best of each item, 0 if there are fewer
        return np.partition(scores, width - k, axis=1)[:, width - k] if width >= k else np.zeros(n_items, dtype=np.int64)

    open_to_new = plan.ahead[bundle][stage] >= least(total) if len(item) else np.ones(n_items, dtype=bool)
    had = total > 0
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    held_by, held = plan.holds[bundle]
    order = np.argsort(held, kind="stable")
    lo, hi = np.searchsorted(held[order], term[begin]), np.searchsorted(held[order], term[begin], side="right")
    for b, e, x, y in zip(begin, np.append(begin[1:], len(term)), lo, hi):
        items, docs = held_by[order[x:y]], at[b:e]
        total[np.ix_(items, docs)] += gain[b:e]
    total[~(had | open_to_new[:, None])] = 0
    keep = (total > 0) & (total + plan.ahead[bundle][stage + 1][:, None] >= least(total)[:, None])
    item, doc = np.nonzero(keep)
    return item, doc, total[item, doc]


def through(carried: DataFrame, block: DataFrame, plan: Plan, stage: int) -> DataFrame:
    """Bundles and their accumulators after a stage; after the last one the k best of each item in each slice."""
    last = stage == OWNERS - 1

    def owner(key, left, right):
        place, bundle = (x.as_py() for x in key)
        rows = left.to_pylist()
        now = tuple(numbers(rows[0], c, k) for c, k in (("item", "<i4"), ("doc", "<i4"), ("score", "<i8"))) if rows else tuple(np.zeros(0, t) for t in ("<i4", "<i4", "<i8"))
        row = right.to_pylist()[0]
        item, doc, score = add(plan, stage, bundle, now, tuple(numbers(row, c, k) for c, k in (("doc", "<i4"), ("term", "<i4"), ("gain", "<i8"))))
        if not last:
            return pa.table({"slice": pa.array([place]), "bundle": pa.array([bundle], pa.int32()), "item": pa.array([item.astype("<i4").tobytes()], pa.binary()),
                             "doc": pa.array([doc.astype("<i4").tobytes()], pa.binary()), "score": pa.array([score.tobytes()], pa.binary())})
        ids, no_id = numbers(row, "doc_ids", "<i8"), numbers(row, "no_id", bool)
        order = np.lexsort((ids[doc], no_id[doc], -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        best = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item)))) < plan.k
        item, doc, score = item[best], doc[best], score[best]
        return pa.table({"item_id": pa.array(plan.items[bundle][item]), "doc_id": pa.array(ids[doc], mask=no_id[doc]), "score": pa.array(score)})

    return beside(carried, block, ["slice", "bundle"], owner, FOUND if last else CARRIED)


def search_wave(docs: DataFrame, of_items: DataFrame, n_bundles: int, k: int) -> DataFrame | None:
    """item_id, doc_id, score: the k best of every slice for the items of a wave; None if no document has a term."""
    spark = docs.sparkSession
    # a row for each term of an item: the bounded dictionary of the wave
    rows = of_items.select("bundle", "item_id", "term").orderBy("bundle", "item_id", "term").collect()
    rows = [(r["bundle"], r["item_id"], bytes(r["term"])) for r in rows]
    terms = sorted({t for _, _, t in rows})
    slices = written(postings(docs, terms), "search-postings")
    n_docs, n_terms = slices.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs or not terms:
        return None
    df, most = np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
    for r in statistics(slices, n_docs, n_terms).collect():        # at most a row for each term of the wave
        df[r["term"]], most[r["term"]] = r["df"], r["most"]
    plan = Plan(terms, rows, df, most, n_docs, n_terms, n_bundles, k)
    carried = spark.createDataFrame([], CARRIED)
    for stage in range(OWNERS):
        carried = through(carried, blocks(slices, plan, stage), plan, stage)
    return carried


def search(docs: DataFrame, items: DataFrame, k: int = K, bundle: int = BUNDLE, wave: int = WAVE) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    of = written(item_terms(items), "search-items")
    n_items, n_rows = of.agg(F.count_distinct("item_id"), F.count(F.lit(1))).first()
    n_bundles, n_waves = max(-(-n_items // bundle), 1), max(-(-n_rows // wave), 1)
    n_bundles = max(n_bundles, n_waves)
    of = of.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int"))
    found = docs.sparkSession.createDataFrame([], FOUND)
    for at in range(n_waves if n_rows else 0):
        part = search_wave(docs, of.where(F.pmod("bundle", F.lit(n_waves)) == at), n_bundles, k)
        found = found if part is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(words)) AS BIGINT) AS l FROM d WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS size, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, total GROUP BY term),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * (({IMPACT} * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * n) // l)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
