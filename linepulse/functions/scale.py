"""Scale helpers: distributed dense numbering, skew-split sequence windows, grand totals.

None of these moves a whole table, group or partition through the driver or a single task:

- ``dense_index``   global 1..n numbering in a total order.  A range-partitioned sort spreads the
                    rows over many tasks; per-partition row counts (one row per partition, a proven
                    bound) give each partition its offset.  The sorted frame is checkpointed to the
                    shared folder first, so the counts and the numbering read identical partitions
                    even if executors are lost and tasks re-run.
- ``seq_number`` / ``seq_lag`` / ``seq_lead``
                    ROW_NUMBER / LAG / LEAD within a group, split into sub-groups by a *bucket*
                    (e.g. the start minute of the day) that is monotone in the ordering.  The window
                    runs per (group, bucket); the boundary rows are patched from a per-bucket
                    aggregate (partial aggregation, so a hot group costs nothing extra) that is
                    ordered per group on its own (at most one row per bucket).  A group holding a
                    third of all rows is therefore processed by many tasks, not one.
- ``with_total``    attaches a grand total computed by a global aggregate: exactly one row,
                    broadcast, so the size is proven.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linepulse.session import shared_dir


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def range_tag(df: DataFrame, order: Sequence, partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by ``order``; tag each row with its partition and position.

    Lazy: the tags are only stable once the frame is materialised (checkpoint or written table).
    """
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(k).asc_nulls_last() for k in order]
    return (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_lp_pid", F.spark_partition_id())
              .withColumn("_lp_pos", F.monotonically_increasing_id()))


def partition_offsets(tagged: DataFrame) -> DataFrame:
    """Rows before each partition (one row per partition of the range sort)."""
    counts = tagged.groupBy("_lp_pid").agg(F.count(F.lit(1)).alias("_lp_n"))
    w = Window.orderBy("_lp_pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_lp_pid", F.coalesce(F.sum("_lp_n").over(w), F.lit(0)).alias("_lp_off"))


def apply_offsets(tagged: DataFrame, offsets: DataFrame, name: str) -> DataFrame:
    """1-based global number from a materialised tagged frame and its partition offsets."""
    # one row per partition: bounded by the partition count, so broadcasting it is safe
    out = tagged.join(F.broadcast(offsets), "_lp_pid")
    local = F.col("_lp_pos") - F.shiftleft(F.col("_lp_pid").cast("long"), 33)
    return out.withColumn(name, F.col("_lp_off") + local + F.lit(1)).drop("_lp_pid", "_lp_pos", "_lp_off")


def dense_index(df: DataFrame, order: Sequence, name: str, partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in the total order ``order`` (ascending, nulls last), distributed.

    The tagged frame is checkpointed to the shared folder so the counts and the numbering read
    identical partitions (also after executor loss)."""
    shared_dir(df.sparkSession)
    tagged = range_tag(df, order, partitions).checkpoint(eager=True)
    return apply_offsets(tagged, partition_offsets(tagged), name)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    if not keys:
        raise ValueError("a split window needs at least one bucket column")
    r = right.select(*[F.col(k).alias(f"_lp_k_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[f"_lp_k_{k}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_lp_k_{k}" for k in keys])


def _plain_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with one column of plain equality for each key: its text behind a mark, or the mark of NULL.

    A join and a window on these columns need the same distribution, so the rows are shuffled once for both (a
    null-safe join hashes on other expressions than a window over the keys does).
    """
    names = [f"_lp_e_{n}" for n in range(len(keys))]
    return df.select("*", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("0")).alias(n) for k, n in zip(keys, names)]), names


def _beside(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> tuple[DataFrame, list[str]]:
    """``df`` joined to a per-bucket table on plain key columns, which stay for the window."""
    if not keys:
        raise ValueError("a split window needs at least one bucket column")
    left, names = _plain_keys(df, keys)
    right, _ = _plain_keys(small, keys)
    return left.join(right.drop(*keys), names, how), names


def seq_number(df: DataFrame, part: Sequence[str], order: Sequence, bucket: Sequence[str], name: str,
               descending: bool = False) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY part ORDER BY order) computed per (part, bucket).

    ``bucket`` columns must be the leading columns of ``order`` (same direction).
    """
    part, bucket = _cols(part), _cols(bucket)
    ordered = [(F.col(o).desc() if descending else F.col(o).asc()) if isinstance(o, str) else o for o in order]
    counts = df.groupBy(*part, *bucket).agg(F.count(F.lit(1)).alias("_lp_n"))
    if not part and len(bucket) > 1 and not descending:
        # a global order: the bucket table is itself numbered by the same split (recursively)
        offsets = (seq_cumsum(counts, [], bucket, bucket[:-1], "_lp_n", "_lp_up", exclusive=True)
                   .drop("_lp_n").withColumnRenamed("_lp_up", "_lp_off"))
    else:
        bo = [F.col(b).desc() if descending else F.col(b).asc() for b in bucket]
        wb = Window.partitionBy(*part).orderBy(*bo).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*part, *bucket, F.coalesce(F.sum("_lp_n").over(wb), F.lit(0)).alias("_lp_off"))
    joined, plain = _beside(df, offsets, part + bucket)
    wi = Window.partitionBy(*plain).orderBy(*ordered)
    return joined.withColumn(name, F.row_number().over(wi) + F.col("_lp_off")).drop("_lp_off", *plain)


def _shift(df: DataFrame, part, order, bucket, cols: Sequence[str], names: Sequence[str], lead: bool) -> DataFrame:
    part, bucket = _cols(part), _cols(bucket)
    ordered = [F.col(o).asc() if isinstance(o, str) else o for o in order]
    okey = F.struct(*[F.col(o) for o in order if isinstance(o, str)])
    vals = F.struct(*[F.col(x) for x in cols])
    edge = (F.min_by(vals, okey) if lead else F.max_by(vals, okey)).alias("_lp_edge")
    edges = df.groupBy(*part, *bucket).agg(edge)
    if not part and len(bucket) > 1:
        # a global order: the neighbour of each bucket comes from the same split one level up,
        # so no window ever runs over all buckets in a single partition
        neighbours = (_shift(edges, [], list(bucket), list(bucket[:-1]), ["_lp_edge"], ["_lp_up"], lead)
                      .drop("_lp_edge").withColumnRenamed("_lp_up", "_lp_nb"))
    else:
        wb = Window.partitionBy(*part).orderBy(*[F.col(b) for b in bucket])
        nb = (F.lead if lead else F.lag)("_lp_edge").over(wb)
        neighbours = edges.select(*part, *bucket, nb.alias("_lp_nb"))
    joined, plain = _beside(df, neighbours, part + bucket, "left")
    wi = Window.partitionBy(*plain).orderBy(*ordered)
    wcount = Window.partitionBy(*plain)
    rn = F.row_number().over(wi)
    at_edge = (rn == F.count(F.lit(1)).over(wcount)) if lead else (rn == F.lit(1))
    fn = F.lead if lead else F.lag
    for x, nm in zip(cols, names):
        joined = joined.withColumn(nm, F.when(at_edge, F.col("_lp_nb").getField(x)).otherwise(fn(x).over(wi)))
    return joined.drop("_lp_nb", *plain)


def seq_lag(df, part, order, bucket, cols, names) -> DataFrame:
    """LAG(col) OVER (PARTITION BY part ORDER BY order), split by ``bucket`` (see module doc)."""
    return _shift(df, part, order, bucket, _cols(cols), _cols(names), lead=False)


def seq_lead(df, part, order, bucket, cols, names) -> DataFrame:
    """LEAD(col) OVER (PARTITION BY part ORDER BY order), split by ``bucket``."""
    return _shift(df, part, order, bucket, _cols(cols), _cols(names), lead=True)


def with_total(df: DataFrame, col: str, total: str = "_total") -> DataFrame:
    """Attach SUM(col) over the whole frame as a column (one-row broadcast)."""
    tot = df.agg(F.sum(col).alias(total))
    return df.crossJoin(F.broadcast(tot))


def seq_cumsum(df: DataFrame, part, order, bucket, col: str, name: str, exclusive: bool = False) -> DataFrame:
    """Running SUM(col) within ``part`` in ``order`` (ROWS frame), split by ``bucket``.

    Sums of the earlier buckets come from a per-(part, bucket) aggregate; the window then only
    runs inside one (part, bucket).  ``exclusive`` leaves the current row out.
    """
    part, bucket = _cols(part), _cols(bucket)
    ordered = [F.col(o).asc() if isinstance(o, str) else o for o in order]
    sums = df.groupBy(*part, *bucket).agg(F.sum(col).alias("_lp_s"))
    if not part and len(bucket) > 1:
        before = (seq_cumsum(sums, [], bucket, bucket[:-1], "_lp_s", "_lp_up", exclusive=True)
                  .drop("_lp_s").withColumnRenamed("_lp_up", "_lp_before"))
    else:
        wb = Window.partitionBy(*part).orderBy(*[F.col(b) for b in bucket]).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*part, *bucket, F.coalesce(F.sum("_lp_s").over(wb), F.lit(0)).alias("_lp_before"))
    joined, plain = _beside(df, before, part + bucket)
    end = -1 if exclusive else Window.currentRow
    wi = Window.partitionBy(*plain).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, end)
    inner = F.coalesce(F.sum(col).over(wi), F.lit(0))
    return joined.withColumn(name, F.col("_lp_before") + inner).drop("_lp_before", *plain)
