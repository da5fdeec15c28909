"""Operator 13: exact top-k search by inner product with vector-approximation files.

Vectors become integers, floor(SCALE * x).  Every dimension is cut into 2 ^ BITS cells of one width around its mean; the first and last cell reach to the
dimension's ends.  The approximation file holds, for each vector, the numbers of its cells, a byte a dimension, beside the exact vector.

A query scans the cells of a shard first: with c the middle of a vector's cells and r half their widths, its score lies in q.c - |q|.r .. q.c + |q|.r.  Only
vectors whose upper bound reaches the (k+1)-th highest lower bound stay.  Their exact vectors are read in the order of the upper bounds, and
reading ends when the (k+1)-th best exact score is above every bound that is left.  Bounds carry the error of 32-bit sums, exact scores are
64-bit integers, so the result is exact whatever the cells are; bad cells only make more vectors be read.

Shape of the job: classes of equal vectors (an element's k+1 least ids stand for all its rows, because ties go to the smaller id) are dealt by hash to
shards of at most about ``SHARD``, queries to blocks of about ``QUERIES``, and one task searches one block in one shard.  A shard gives its k best of each query; the
k best of these are ranked.  Neither a query, a hot vector nor a shard depends on the size of the table.

Rows: null vectors and those with null or non-finite components take no part, nor do rows without an id; an id with several rows
counts once, with the least of its vectors; components are held at +-2^24; a shorter vector counts as filled with zeros, an empty one as all zeros; ties go to the
smaller id; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepulse.llm.common import beside, in_arrow, written

K = 20
EVERY = 20         # rows whose id is divisible by this are queries
SCALE = 64
BITS = 5           # 2 ^ BITS cells a dimension
SPREAD = 4.0       # cells cover this many standard deviations on either side; the outer ones reach further
SHARD = 65536      # classes of a shard, about
LEAST_SHARD = 4096
QUERIES = 4096     # queries of a block, about
TILE = 256         # queries whose bounds are held at a time
MOST = 1 << 24


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (32-bit integers as bytes) of the rows that take part."""
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            bad = np.bincount(row[~np.isfinite(flat)], minlength=len(n)) > 0
            bad |= lists.is_null().to_numpy(zero_copy_only=False) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.nan_to_num(np.clip(np.floor(scale * flat), -MOST, MOST)).astype("<i4")
            data, end = whole.tobytes(), 4 * np.cumsum(n)
            good = np.flatnonzero(~bad)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array([data[end[i] - 4 * n[i]:end[i]] for i in good], pa.binary())], names=["vec_id", "v"])

    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return in_arrow(src, run, "vec_id long, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Byte strings as rows of integers, filled with zeros."""
    found = [np.frombuffer(b, "<i4") for b in column.to_pylist()]
    out = np.zeros((len(found), width), dtype=np.int64)
    for row, x in zip(out, found):
        row[:len(x)] = x
    return out


class Cells:
    """The cells of every dimension: edges from the table's own spread."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int = BITS):
        n = 1 << bits
        self.low, self.high = low.astype(np.int64), high.astype(np.int64)
        first = np.maximum(self.low, np.floor(mean - SPREAD * deviation).astype(np.int64))
        last = np.minimum(self.high, np.ceil(mean + SPREAD * deviation).astype(np.int64))
        self.width = np.maximum(-(-(last - first + 1) // n), 1)
        self.first, self.n = first, n
        # the integers of cell i: begin[i] .. end[i]
        begin = first[:, None] + self.width[:, None] * np.arange(n)
        end = begin + self.width[:, None] - 1
        begin[:, 0] = np.minimum(begin[:, 0], self.low)
        end[:, -1] = np.maximum(end[:, -1], self.high)
        self.middle, self.reach = (begin + end) / 2, (end - begin) / 2
        self.usual = (self.width - 1) / 2

    def of(self, v: np.ndarray) -> np.ndarray:
        """The approximation of vectors: cell numbers."""
        return np.clip((v - self.first) // self.width, 0, self.n - 1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return self.middle[np.arange(cells.shape[1]), cells]

    def further(self, cells: np.ndarray) -> np.ndarray:
        """How much wider than usual the cells of a vector are (half widths); only outer cells are."""
        return np.maximum(self.reach[np.arange(cells.shape[1]), cells] - self.usual, 0)


def spread(rows: DataFrame) -> Cells | None:
    """The cells of a table of integer vectors, from counts, sums and ends of every dimension; None without rows."""
    def run(batches):
        n = np.zeros(0)
        total, square, low, high = (np.zeros(0) for _ in range(4))
        count = 0
        for batch in batches:
            found = [np.frombuffer(b, "<i4") for b in batch.column(0).to_pylist()]
            width = max([len(x) for x in found] + [len(n)])
            n, total, square, low, high = (np.append(x, np.zeros(width - len(x))) for x in (n, total, square, low, high))
            for length in {len(x) for x in found} - {0}:
                v = np.array([x for x in found if len(x) == length], dtype=np.float64)
                n[:length] += len(v)
                total[:length] += v.sum(0)
                square[:length] += (v * v).sum(0)
                low[:length], high[:length] = np.minimum(low[:length], v.min(0)), np.maximum(high[:length], v.max(0))
            count += len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(n)), -1), pa.int64()), *[pa.array(np.append(x, count)) for x in (total, square, low, high)]],
                                         names=["at", "total", "square", "low", "high"])

    # a row a dimension; cells take in zero, the filling of shorter vectors
    got = in_arrow(rows.select("v"), run, "at long, total double, square double, low double, high double").groupBy("at").agg(
        F.sum("total").alias("total"), F.sum("square").alias("square"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    count = sum(r["total"] for r in got if r["at"] < 0)
    if not count:
        return None
    total, square, low, high = (np.array([r[x] for r in got if r["at"] >= 0]) for x in ("total", "square", "low", "high"))
    mean = total / count
    return Cells(low, high, mean, np.sqrt(np.maximum(square / count - mean ** 2, 0)))


class Shard:
    """Part of the approximation file, searched by bounds."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, exact: np.ndarray, of: Cells):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact, self.of = ids[order], exact[order], of
        cells = cells[order]
        self.middle = of.middles(cells).astype(np.float32)
        far = of.further(cells)
        self.wide = np.flatnonzero(far.any(axis=1))
        self.far = far[self.wide].astype(np.float32)
        self.greatest = np.abs(self.exact).max(initial=0)
        self.read = 0           # exact vectors read so far

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores of some queries."""
        size = np.abs(q).astype(np.float64)
        x = q.astype(np.float32) @ self.middle.T
        slack = (size @ self.of.usual)[:, None]
        # rounding of 32-bit products and sums, relative to the sum of the absolute products
        slack = slack + 1e-6 * (q.shape[1] + 4) * (size.sum(axis=1) * (np.abs(self.middle).max(initial=0) + 1))[:, None]
        low, high = (x - slack).astype(np.float64), (x + slack).astype(np.float64)
        if len(self.wide):
            more = size @ self.far.T.astype(np.float64) * (1 + 1e-9)
            low[:, self.wide] -= more
            high[:, self.wide] += more
        return low, high

    def best(self, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and exact scores of the k best of each query, best first, ties by the smaller id."""
        out = []
        for at in range(0, len(q), TILE):
            some = q[at:at + TILE]
            low, high = self.bounds(some)
            k_here = min(k, low.shape[1])
            least = np.partition(low, low.shape[1] - k_here, axis=1)[:, low.shape[1] - k_here]
            for i, v in enumerate(some):
                may = np.flatnonzero(high[i] >= least[i])
                out.append(self._read(v, may, high[i][may], k_here))
        return out

    def _read(self, q: np.ndarray, may: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-bound, kind="stable")
        may, bound = may[order], bound[order]
        exact_in_doubles = float(self.greatest) * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2 ** 53
        place, score, at, step = may[:0], np.zeros(0, dtype=np.int64), 0, 2 * k
        while at < len(may) and not (len(score) == k and bound[at] < score[-1]):
            now = may[at:at + step]
            v = self.exact[now]
            found = (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if exact_in_doubles else v @ q
            place, score = np.append(place, now), np.append(score, found)
            first = np.lexsort((place, -score))[:k]        # places rise with ids
            place, score = place[first], score[first]
            self.read += len(now)
            at, step = at + step, step * 2
        return place, score


def approximations(rows: DataFrame, cells: Cells, k: int) -> DataFrame:
    """id, ids, cells, v: a row for each distinct vector, with the k + 1 least ids of its rows."""
    order = Window.partitionBy("v").orderBy("vec_id")
    classes = rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    width = len(cells.low)

    def run(batches):
        for batch in batches:
            v = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in cells.of(v)], pa.binary()), batch.column(1)], names=["ids", "cells", "v"])

    return in_arrow(classes.select("ids", "v"), run, "ids array<long>, cells binary, v binary")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    shape = "query_id long, vec_id long, score long"
    rows = written(integers(vectors, scale), "va-vectors")
    cells = spread(rows)
    if cells is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    file = written(approximations(rows, cells, k), "va-file")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n_classes, n_queries = file.count(), asked.count()
    wanted = min(max(n_classes // (2 * spark.sparkContext.defaultParallelism), LEAST_SHARD), shard)
    n_shards, n_blocks = -(-n_classes // min(wanted, shard)), -(-n_queries // queries)
    width = len(cells.low)

    def everywhere(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))

    left = file.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(n_shards)).cast("int")).withColumn("block", everywhere(n_blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(n_blocks, 1))).cast("int")).withColumn("shard", everywhere(n_shards))

    def search(key, part, some):
        found = [[], [], []]
        if part.num_rows and some.num_rows:
            lists = part.column("ids").combine_chunks()
            flat, begin = lists.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            first = flat[begin[:-1]]
            order = np.argsort(first, kind="stable")
            approximate = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(part.num_rows, width)
            index = Shard(first, approximate, matrix(part.column("v"), width), cells)
            own = some.column("query_id").to_numpy()
            for query, (place, score) in zip(own, index.best(matrix(some.column("q"), width), k + 1)):
                at = order[place]
                n = begin[at + 1] - begin[at]
                ids = flat[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                score = np.repeat(score, n)[ids != query]
                ids = ids[ids != query]
                best = np.lexsort((ids, -score))[:k]
                for to, x in zip(found, (np.full(len(best), query), ids[best], score[best])):
                    to.append(x)
        columns = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)) for x in found]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    near = beside(left, right.select("block", "shard", "query_id", "q"), ["shard", "block"], search, shape)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
