"""Operator 1: document fingerprints by winnowing, in DataFrame functions only.

A text is taken as its words; the hash of every ``K`` successive words is rolled up from the hashes of its halves
(pairs of words, pairs of pairs), and of every ``W`` successive hashes the smallest is chosen, of equal ones the rightmost.
A chosen hash keeps its position (the number of its first word), so a fingerprint is a list of hash@position and any passage of
``GUARANTEE`` = W + K - 1 words that two texts share is found: its hash is chosen in both, at the kept positions.
Hash (32 bits) and position (31 bits, counted down) are one number; its minimum is the smallest hash at its rightmost place.
Sliding hashes and sliding minima are built by doubling, so each word costs a few steps whatever K and W are.

Edited text: the last half (floor) of the code points replaced by the beginning of the next document in descending doc_id,
after the last the first.  Documents are dealt by id bucket (``SPAN`` ids); the next document comes from a window inside the bucket,
and only the last document of each bucket fetches the first of the next bucket that is not empty.  No window runs over all documents:
buckets are linked by ``seq_lag``, which splits itself by super-buckets.  Texts are shuffled once.

Rows: null text is empty; an empty text, or one without words, has the empty fingerprint; a text with fewer than K words has one
hash of them all, one with few words a single window; texts of any length are fingerprinted whole; rows with
equal doc_id follow each other by digest of the text, null doc_id comes last; a single document is its own next; an
empty table gives no rows; further columns are not read.  The likeness of two empty fingerprints is 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linepulse.functions.scale import seq_lag
from linepulse.llm.common import whole_text

K = 4            # words a hash covers; a power of two
W = 4            # hashes a window covers; a power of two
GUARANTEE = W + K - 1
SPAN = 256       # ids a bucket covers
LAST = (1 << 31) - 1
LOWEST = -(1 << 56)   # the bucket of null ids, below every other


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def pairs(xs: Column, n: Column, step: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(xs[i], xs[i + step]) for every i of an array of n elements."""
    return F.zip_with(F.slice(xs, F.lit(1), n - step), F.slice(xs, F.lit(step + 1), n - step), f)


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def chosen(text: Column) -> Column:
    """The chosen numbers (hash * 2^31 + LAST - position) of a text, by position."""
    def number(h: Column, i: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(LAST).cast("long") - i)

    def roll(hs: Column, n: Column, step: int) -> Column:
        if step == K:
            return windows(hs, n)
        return let(pairs(hs, n, step, lambda a, b: F.xxhash64(a, b)), lambda x: roll(x, n - step, step * 2))

    def windows(hs: Column, n: Column) -> Column:
        return let(F.transform(hs, number), lambda v: F.when(n <= W, F.array(F.array_min(v))).otherwise(least(v, n, 1)))

    def least(v: Column, n: Column, step: int) -> Column:
        if step == W:
            return F.array_distinct(v)
        return let(pairs(v, n, step, lambda a, b: F.least(a, b)), lambda x: least(x, n - step, step * 2))

    def fingerprint(hs: Column) -> Column:
        n = F.size(hs)
        short = F.array(number(F.xxhash64(hs), F.lit(0).cast("long")))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < K, short).otherwise(roll(hs, n, 1))

    return let(word_hashes(text), fingerprint)


def as_string(numbers: Column) -> Column:
    """hash@position, ... of chosen numbers."""
    return F.array_join(F.transform(numbers, lambda v: F.concat(
        F.lower(F.hex(F.shiftright(v, 31))), F.lit("@"), (F.lit(LAST).cast("long") - v.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in all hashes of two fingerprints."""
    def hashes(x: Column) -> Column:
        return F.array_distinct(F.transform(x, lambda v: F.shiftright(v, 31)))

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(both.cast("double") / (F.size(x) + F.size(y) - both))

    return let(hashes(a), lambda x: let(hashes(b), lambda y: share(x, y)))


def edited(text: Column, following: Column) -> Column:
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row; row by row, nothing is shuffled."""
    return docs.select(F.col(id_col), as_string(chosen(whole_text(text_col))).alias("fingerprint"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    bucket = F.coalesce(F.floor(F.col("doc_id") / SPAN).cast("long"), F.lit(LOWEST))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("bucket", bucket)
    # ids only: each bucket's next one below that has documents; below the lowest comes the highest
    buckets = rows.select("bucket").distinct().withColumn("sup", F.floor(F.col("bucket") / SPAN).cast("long")).withColumn(
        "top", F.floor(F.col("sup") / SPAN).cast("long"))
    highest = rows.agg(F.max("bucket")).first()[0]
    below = seq_lag(buckets, [], ["top", "sup", "bucket"], ["top", "sup"], ["bucket"], ["below"]).select(
        "bucket", F.coalesce("below", F.lit(highest).cast("long")).alias("below"))

    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    walked = rows.withColumn("following", F.lead("text").over(order)).withColumn("nth", F.row_number().over(order))
    heads = walked.where("nth = 1").select(F.col("bucket").alias("below"), F.col("text").alias("head"))
    tails = (walked.where("following IS NULL").select("doc_id", "text", "bucket").join(below, "bucket").join(heads, "below")
             .select("doc_id", "text", F.col("head").alias("following"), chosen(F.col("text")).alias("own"), chosen(F.col("head")).alias("next")))
    own = walked.select("doc_id", "text", "bucket", "following", chosen(F.col("text")).alias("own"))
    inner = (own.withColumn("next", F.lead("own").over(order)).where("following IS NOT NULL")
             .select("doc_id", "text", "following", "own", "next"))
    both = inner.unionByName(tails).select("doc_id", "text", "own", "next", edited(F.col("text"), F.col("following")).alias("edit"))
    done = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "own", "next",
                       chosen(F.col("edit")).alias("changed"))
    return done.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
