"""Operator 7: mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources a document belongs to): rows and words.
2. Targets: the sources share ``share`` of all words by weight; a target stops at ``passes`` times its source's words
   and the excess is shared again by weight until none is above.
3. A flow network takes the words of each pattern to the quotas of its sources: start -> pattern, one arc per pass with
   the pattern's words as capacity and a cost that rises with every repetition; pattern -> source; source -> end with the
   target as capacity.  Successive shortest paths give the cheapest largest flow.
4. Every document of a pattern is taken ``flow div words`` times; for the rest, documents in the order of a seeded
   digest are taken once more until the next one would go beyond it, and then the one document more whose size is
   nearest to what is left, if that comes nearer.

What reaches the driver is one row per pattern (at most ``MAX_PATTERNS``; more raise an error instead of being dropped).
The running sum of step 4 is not taken over a whole pattern, of which a hot one may hold a third of all rows: sums per
digest bucket (65,536 a pattern, summed map-side) find the bucket where the rest ends, and only that bucket is summed row by
row.  The decision is then one comparison per document against its pattern's row, with no shuffle of documents.

Rows: null text has size 0; a null source is a source of its own, last in order; documents with no source at all (an empty
array) are never taken; rows equal in id and text share one decision; an empty table gives no rows.  Sizes and digests are written to the shared folder once, so that all steps and reruns see the same rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linepulse.llm.common import whole_text, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = "mix-1"
MAX_PATTERNS = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[int], total: float, passes: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``passes`` times its size, the excess shared again."""
    caps = [passes * s for s in sizes]
    full: set[int] = set()
    while True:
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        if not open_weight:
            return [float(c) for c in caps]
        rate = (total - sum(caps[i] for i in full)) / open_weight
        above = {i for i, w in enumerate(weights) if i not in full and rate * w > caps[i]}
        if not above:
            return [float(caps[i]) if i in full else rate * w for i, w in enumerate(weights)]
        full |= above


def min_cost_flow(words: list[int], members: list[list[int]], quotas: list[int], costs: list[int]) -> list[list[int]]:
    """flow[p][j]: words of pattern p for its j-th source.  costs: of each pass, rising."""
    n_p, n_s = len(words), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    to, left, cost, arcs = [], [], [], [[] for _ in range(n_p + n_s + 2)]

    def arc(a: int, b: int, capacity: int, c: int) -> int:
        for x, y, cap, z in ((a, b, capacity, c), (b, a, 0, -c)):
            arcs[x].append(len(to))
            to.append(y), left.append(cap), cost.append(z)
        return len(to) - 2

    for p, w in enumerate(words):
        for c in costs:
            arc(start, p, w, c)
    used = [[arc(p, n_p + s, w * len(costs), 0) for s in members[p]] for p, w in enumerate(words)]
    for s, q in enumerate(quotas):
        arc(n_p + s, end, q, 0)
    height = [0] * (n_p + n_s + 2)      # all costs are 0 or more at first
    while True:
        far, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in arcs[x]:
                if left[e] > 0:
                    nd = d + cost[e] + height[x] - height[to[e]]
                    if nd < far.get(to[e], nd + 1):
                        far[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if end not in far:
            break
        most = max(far.values())
        height = [h + far.get(x, most) for x, h in enumerate(height)]
        push, x = None, end
        while x != start:
            push = left[via[x]] if push is None else min(push, left[via[x]])
            x = to[via[x] ^ 1]
        x = end
        while x != start:
            left[via[x]] -= push
            left[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return [[left[e ^ 1] for e in row] for row in used]


def _keyed(docs: DataFrame, sources: str, seed: str, id_col: str, text_col: str) -> DataFrame:
    """_row (the columns of ``docs``), _size, _pattern and _key, the seeded order of a pattern's documents.

    The order is by a digest of the id; rows with equal ids follow by size and digest of the text, and equal rows
    share one key and so one decision.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if docs.schema[sources].dataType.typeName() == "array":
        member = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array().cast("array<string>"))))
    else:
        member = F.array(F.col(sources).cast("string"))
    text, ident = whole_text(text_col), F.col(id_col)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(ident.cast("string"), F.lit(""))))
    keyed = docs.select(row, n_words(text).alias("_size"), member.alias("_pattern"), digest.alias("_h"), ident.alias("_id"), F.xxhash64(text).alias("_t"))
    return keyed.select("_row", "_size", "_pattern", F.struct(
        F.col("_h").alias("h"), F.col("_id").alias("id"), F.col("_size").alias("size"), F.col("_t").alias("t")).alias("_key"))


def plan(base: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """One row per pattern: words, whole passes, rest, and size and target of its first source."""
    found = base.groupBy("_pattern").agg(F.sum("_size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(x is None, x or "") for x in r["_pattern"]])
    names = sorted({x for r in found for x in r["_pattern"]}, key=lambda x: (x is None, x or ""))
    at = {x: i for i, x in enumerate(names)}
    members = [[at[x] for x in r["_pattern"]] for r in found]
    words = [r["words"] for r in found]
    sizes = [0] * len(names)
    for w, m in zip(words, members):
        for s in m:
            sizes[s] += w
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(words), passes)
    flow = min_cost_flow(words, members, [int(t + 0.5) for t in wanted], [k * k for k in range(passes)])
    rows = []
    for r, m, f in zip(found, members, flow):
        whole, rest = divmod(sum(f), r["words"]) if r["words"] else (0, 0)
        rows.append((r["_pattern"], whole, rest, sizes[m[0]] if m else 0, wanted[m[0]] if m else 0.0))
    schema = "p array<string>, whole long, rest long, source_size long, target double"
    return base.sparkSession.createDataFrame(rows, schema).coalesce(1)


def thresholds(base: DataFrame, planned: DataFrame) -> DataFrame:
    """The plan's rows with ``until``, the last key taken once more, and ``extra``, the key taken beside those."""
    bucket = F.substring("_key.h", 1, 4)
    planned = F.broadcast(planned)
    ahead = Window.partitionBy("_pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = (base.groupBy("_pattern", bucket.alias("bucket")).agg(F.sum("_size").alias("n"), F.max("_key").alias("top"))
            .withColumn("upto", F.sum("n").over(ahead)))
    sums = sums.join(planned, F.col("_pattern").eqNullSafe(F.col("p"))).where("rest > 0")
    inside, beyond = F.col("upto") <= F.col("rest"), F.col("upto") > F.col("rest")
    per = sums.groupBy(F.col("p").alias("q")).agg(
        F.max(F.when(inside, F.col("top"))).alias("top"), F.max(F.when(inside, F.col("upto"))).alias("before"),
        F.min(F.when(beyond, F.col("bucket"))).alias("cut"))
    first = written(planned.join(per, F.col("p").eqNullSafe(F.col("q")), "left").drop("q"), "mix-buckets")
    in_cut = base.join(F.broadcast(first), F.col("_pattern").eqNullSafe(F.col("p")) & (bucket == F.col("cut")))
    running = F.sum("_size").over(Window.partitionBy("p").orderBy("_key"))     # equal keys together
    in_cut = in_cut.withColumn("upto", F.coalesce("before", F.lit(0)) + running).where(inside)
    more = in_cut.groupBy(F.col("p").alias("q")).agg(F.max("_key").alias("last"), F.max("upto").alias("reached"))
    second = written(first.join(F.broadcast(more), F.col("p").eqNullSafe(F.col("q")), "left").select(
        "p", "whole", "rest", "source_size", "target", F.coalesce("last", "top").alias("until"),
        F.coalesce("reached", "before", F.lit(0)).alias("reached")), "mix-until")
    lack = F.col("rest") - F.col("reached")
    off = F.abs(F.col("_size") - lack)
    others = base.join(F.broadcast(second), F.col("_pattern").eqNullSafe(F.col("p"))).where(
        (lack > 0) & (off < lack) & (F.col("until").isNull() | (F.col("_key") > F.col("until"))))
    best = others.groupBy(F.col("p").alias("q")).agg(F.min_by("_key", F.struct(off, F.col("_key"))).alias("extra"))
    return written(second.join(F.broadcast(best), F.col("p").eqNullSafe(F.col("q")), "left").select(
        "p", "whole", "source_size", "target", "until", "extra"), "mix-cut")


def _decided(keyed: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows with _copies; ``cut`` has one row per pattern, at most MAX_PATTERNS."""
    more = F.coalesce(F.col("_key") <= F.col("until"), F.lit(False)) | F.coalesce(F.col("_key") == F.col("extra"), F.lit(False))
    return (keyed.join(F.broadcast(cut.select("p", "whole", "until", "extra", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))),
                       F.col("_pattern").eqNullSafe(F.col("p")))
            .withColumn("_copies", (F.col("whole") + more.cast("long"))).drop("p", "whole", "until", "extra"))


def mix(docs: DataFrame, sources: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
        seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, pattern, source_size and target (of its first source), copies, taken of every row.

    ``sources``: a string column, or an array of strings where sources overlap.  ``weights`` repeat over the sources in
    code point order, null last.
    """
    base, cut = _solve(docs.select(id_col, text_col, sources), sources, weights, share, passes, seed, id_col, text_col)
    return _decided(base, cut).select(
        F.col("_key.id").alias("doc_id"), F.col("_size").alias("size"), F.col("_pattern").alias("pattern"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def _solve(docs, sources, weights, share, passes, seed, id_col, text_col) -> tuple[DataFrame, DataFrame]:
    base = written(_keyed(docs, sources, seed, id_col, text_col).select("_pattern", "_size", "_key"), "mix-base")
    return base, thresholds(base, plan(base, weights, share, passes))


def mixed_corpus(docs: DataFrame, sources: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
                 seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as many times as it is taken; no document is shuffled."""
    _, cut = _solve(docs.select(id_col, text_col, sources), sources, weights, share, passes, seed, id_col, text_col)
    keyed = _keyed(docs, sources, seed, id_col, text_col)
    out = _decided(keyed, cut).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select("_row.*")


def contract(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# the contract's query in DuckDB's SQL
ORACLE = r"""
WITH b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, 2 * sum(size)::BIGINT AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM b GROUP BY source
), r AS (   -- sources in the order in which their targets stop
  SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, (1.5 * (SELECT sum(size) FROM b))::DOUBLE AS total
  FROM s WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)
), f AS (   -- the first source that is not stopped
  SELECT min(k) AS k FROM r WHERE (total - caps_before) / w_left * w <= cap
), g AS (
  SELECT (SELECT (total - caps_before) / w_left FROM r, f WHERE r.k = f.k) AS rate
), t AS (
  SELECT source, words, CASE WHEN k < (SELECT k FROM f) THEN cap::DOUBLE ELSE (SELECT rate FROM g) * w END AS target FROM r
), p AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target + 0.5)::BIGINT // words ELSE 0 END AS whole,
         CASE WHEN words > 0 THEN floor(target + 0.5)::BIGINT % words ELSE 0 END AS rest FROM t
), c AS (
  SELECT b.*, p.words, p.target, p.whole, p.rest, sum(size) OVER (PARTITION BY b.source ORDER BY h, doc_id, size) AS upto
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source
), d AS (
  SELECT *, rest > 0 AND upto <= rest AS prefix FROM c
), e AS (
  SELECT *, rest - coalesce(max(upto) FILTER (prefix) OVER (PARTITION BY source), 0) AS lack FROM d
), x AS (
  SELECT *, row_number() OVER (PARTITION BY source, (NOT prefix AND lack > 0 AND abs(size - lack) < lack)
                               ORDER BY abs(size - lack), h, doc_id) = 1 AND NOT prefix AND lack > 0 AND abs(size - lack) < lack AS extra FROM e
)
SELECT doc_id, size, words::BIGINT AS source_size, target, (size * (whole + CASE WHEN prefix OR extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
