"""Operator 8: near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct ``WORDS``-word shingles (A-Z lower-cased; fewer words: the whole sequence is the one
shingle), as 64-bit hashes of whole shingles.  Two collections of ``GROUPS`` signatures of ``HASHES`` minhashes each are computed,
2 * GROUPS * HASHES minhashes; every pair (i of the first, j of the second) makes one table key, so GROUPS ^ 2 tables of
2 * HASHES minhashes cost about the square root of their minhashes.  A link of similarity s is missed with probability below
2 * (1 - s ^ HASHES) ^ GROUPS: 1.6e-5 at 0.85 and less above (and 5.8e-6 by the sketch of step 4, its exact binomial tail: 2.2e-5 in all).  Keys are only formed from signatures that another class has too, so a text
without relatives makes none.

1. Documents with equal sets (by 128 bits) become one class with a number of its own; copies are never paired.
2. Classes are dealt by table key.  In each bucket every class meets one hub (there are ``HUBS`` orders in which hubs are chosen, by the
   table's number), never all others; the meeting pairs are verified, and their components are formed.
3. In buckets that still hold several components one hub of each meets one of the largest, another one each round, while this merges anything and brings a
   tenth of the buckets into one component (at most 1 + ``ROUNDS`` rounds); this only saves work of step 4.
4. What a bucket still holds apart meets pairwise: classes of different components that have not met, each pair in the first
   table that both share.  A bucket in one component, such as a large group of near copies, has no such pair.  No bucket is capped.
   Groups of texts that are alike but not enough are told apart by a sketch inside the join: ``SKETCH`` further minhashes of
   4 bits; a pair goes on to verification unless it agrees in fewer than a linked pair does but once in 170,000 times.
   Pairs that it rejects are formed and compared inside the join, but are not among its output rows.
5. Every pair is verified on the full sets, after an exact test of their sizes: SHARE * |union| <= 100 * |both|.

Texts are read whole by numpy inside tasks; all joining, grouping and verifying is done by Spark, and the steps are written
to the shared folder, so a lost executor repeats one step's tasks; a step's folder is removed once no later step reads it.

Rows: null and empty texts, and texts without words, have no shingles and are linked with nothing; repeated rows share their result, rows of one
doc_id with different texts each have their own; a null doc_id is linked with nothing and kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepulse.llm.common import dropped, few, in_pandas, whole_text, written
from linepulse.llm.components import components

WORDS = 5
SHARE = 85        # per cent of the union
HASHES = 5        # minhashes of a signature
GROUPS = 20       # signatures of a collection
# of the pipeline's stage: links from 0.80 on, missed with probability below 2 * (1 - 0.8 ^ 4) ^ 23 = 1.1e-5
STAGE_SHARE, STAGE_HASHES, STAGE_GROUPS = 80, 4, 23
HUBS = 4
SKETCH = 512      # minhashes of a sketch, 16 in a number
SIGMAS = 4.5      # standard deviations below the mean agreement of a pair that is just linked
COLUMNS = 1 << 15   # shingles hashed at a time
ROUNDS = 2        # further rounds in which components of mixed buckets meet through one hub each, at most
SIGNATURES = "doc_id long, text_key long, n_shingles long, digest binary, first array<long>, second array<long>"
SETS = "digest binary, shingles array<long>"


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes (unsigned 64-bit) of a text."""
    from xxhash import xxh3_64_intdigest
    found = text.encode("utf-8", "replace").lower().split()      # bytes: A-Z and the six ASCII white characters only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxh3_64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = len(h) - words + 1
    x = h[:n].copy()
    for j in range(1, words):
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x += h[j:j + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return np.unique(x ^ (x >> np.uint64(29)))


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions, from a fixed seed."""
    draw = np.random.default_rng(20).integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    return draw[:, 0] << np.uint64(1) | np.uint64(1), draw[:, 1].copy()


def minhashes(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), COLUMNS):
        np.minimum(low, (x[at:at + COLUMNS] * a[:, None] + b[:, None]).min(axis=1), out=low)
    return low


def signatures(low: np.ndarray, groups: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """The two collections: groups of ``hashes`` minhashes, each folded to one number."""
    x = np.zeros(2 * groups, dtype=np.uint64)
    for column in low.reshape(2 * groups, hashes).T:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + column
    x = x.view(np.int64)
    return x[:groups], x[groups:]


def digest_of(x: np.ndarray) -> bytes | None:
    """Name of a class: 128 bits of its set."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def signed(docs: DataFrame, words: int, groups: int, hashes: int) -> DataFrame:
    def run(batches):
        import pandas as pd
        a, b = hash_family(2 * groups * hashes)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                x = shingles(text, words)
                first, second = signatures(minhashes(x, a, b), groups, hashes) if len(x) else (None, None)
                out.append((len(x), digest_of(x), first, second))
            n, digest, first, second = zip(*out) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_shingles": n, "digest": digest, "first": first, "second": second})

    return in_pandas(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text")), run, SIGNATURES)


def keys(classes: DataFrame, groups: int) -> DataFrame:
    """c, n, i, j, key, order: the table keys of classes, from signatures that at least two classes have."""
    def tagged(column: str, side: int):
        return F.transform(column, lambda s, i: F.struct(F.lit(side).alias("side"), i.alias("at"), s.alias("s")))

    sides = F.concat(tagged("first", 0), tagged("second", 1))
    one = classes.select("c", F.col("n_shingles").alias("n"), F.explode(sides).alias("x")).select("c", "n", "x.side", "x.at", "x.s")
    common = one.groupBy("side", "at", "s").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    kept = one.join(common, ["side", "at", "s"], "left_semi")
    # at most GROUPS signatures a side
    of = kept.groupBy("c", "n").agg(*[F.collect_list(F.when(F.col("side") == side, F.struct("at", "s"))).alias(x) for side, x in enumerate("ab")])
    pairs = F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.struct(
        a["at"].alias("i"), b["at"].alias("j"), F.xxhash64(a["s"], b["s"], a["at"] * groups + b["at"]).alias("key"), (a["at"] % HUBS).alias("order")))))
    return of.select("c", "n", F.explode(pairs).alias("x")).select("c", "n", "x.i", "x.j", "x.key", "x.order")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """c, shingles: the full sets of the wanted classes, from the text of one document each."""
    def run(batches):
        import pandas as pd
        for pdf in batches:
            found = [shingles(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"digest": [digest_of(x) for x in found], "shingles": [x.view(np.int64) for x in found]})

    of = classes.select("c", "digest", "doc_id").join(wanted, "c", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    return in_pandas(texts.select("text"), run, SETS).dropDuplicates(["digest"]).join(of.select("digest", "c"), "digest").select("c", "shingles")


def sketched(sets: DataFrame, wanted: DataFrame, skip: int) -> DataFrame:
    """c, sketch of the wanted classes, from their full sets.  skip: hash functions used already."""
    def run(batches):
        import pandas as pd
        a, b = (x[skip:] for x in hash_family(skip + SKETCH))
        places = np.arange(16, dtype=np.uint64) * np.uint64(4)
        for pdf in batches:
            out = []
            for x in pdf["shingles"]:
                low = minhashes(np.asarray(x, dtype=np.int64).view(np.uint64), a, b) >> np.uint64(20) & np.uint64(15)
                out.append((low.reshape(-1, 16) << places).sum(axis=1, dtype=np.uint64).view(np.int64))
            yield pd.DataFrame({"c": pdf["c"], "sketch": out})

    return in_pandas(sets.join(wanted, "c", "left_semi"), run, "c long, sketch array<long>")


def agreement(x: str, y: str):
    """Number of equal 4-bit minhashes of two sketches."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for k in range(SKETCH // 16):
        z = F.get(x, k).bitwiseXOR(F.get(y, k))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        total = total + (16 - F.bit_count(z.bitwiseAND(ones)))
    return total


def least_agreement(share: int) -> int:
    p = share / 100 + (1 - share / 100) / 16
    return int(SKETCH * p - SIGMAS * (SKETCH * p * (1 - p)) ** 0.5)


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    left = sets.select(F.col("c").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("c").alias("v"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(right, "v").join(left, "u").select("u", "v", F.size("x").alias("n"), F.size("y").alias("m"), both.alias("both"))
    return found.where(100 * F.col("both") >= share * (F.col("n") + F.col("m") - F.col("both"))).select("u", "v")


def mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    apart = placed.groupBy("key").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("key")
    return placed.join(apart, "key", "left_semi")


def renamed(placed: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """``placed`` with its components named anew by ``found`` (node, component; n rows)."""
    return placed.join(few(found.select(F.col("node").alias("k"), "component"), n), "k", "left").withColumn("k", F.coalesce("component", "k")).drop("component")


def meetings(placed: DataFrame, share: int, at: int) -> DataFrame:
    """key, k, fk, u, v: in each mixed bucket one hub of every component meets one of the largest (fk); ``at``: another choice of hubs."""
    dealt = placed.repartition("key")
    hubs = dealt.groupBy("key", "k").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("c", "key", F.lit(at)).alias("h"), F.col("c"), F.col("n"))).alias("x"))
    first = F.max(F.struct("size", "k", F.col("x.c").alias("c"), F.col("x.n").alias("n"))).over(Window.partitionBy("key"))      # a row for each component
    return hubs.withColumn("first", first).where(F.col("k") != F.col("first.k")).select(
        "key", "k", F.col("first.k").alias("fk"), F.least("x.c", "first.c").alias("u"), F.greatest("x.c", "first.c").alias("v"),
        (100 * F.least("x.n", "first.n") >= share * F.greatest("x.n", "first.n")).alias("may"))


def linked_classes(classes: DataFrame, docs: DataFrame, words: int, share: int, groups: int, hashes: int) -> DataFrame:
    """node, component (numbers of classes) of all classes that have a link."""
    tables = keys(classes, groups)
    dealt = tables.select("c", "n", "key", "order")
    shared = dealt.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("c", "order").alias("h"), F.col("c"), F.col("n"))).alias("hub")).where("size > 1")
    members = written(tables.join(shared, "key").select("key", "c", "n", "i", "j", F.col("hub.c").alias("hub"), F.col("hub.n").alias("hub_n")), "near-buckets")

    def sizes_agree(n: str, m: str):
        return 100 * F.least(n, m) >= share * F.greatest(n, m)

    met = members.where(F.col("c") != F.col("hub")).where(sizes_agree("n", "hub_n")).select(
        F.least("c", "hub").alias("u"), F.greatest("c", "hub").alias("v")).distinct()
    met = written(met, "near-pairs")
    sets = written(sets_of(docs, classes, members.select("c").distinct(), words), "near-sets")
    links = written(verified(met, sets, share), "near-links")

    # buckets that still hold more than one component: their hubs meet, first in all buckets, then in those that are left
    found = components(links)
    n_found = found.count()
    placed = renamed(members.select("key", "c", "n", "i", "j", "hub", F.col("c").alias("k")), found, n_found)
    read = [members, found]      # what ``placed`` is made from
    done = [met, sets, links]    # what is read until the end
    before = None
    for at in range(1 + ROUNDS):
        hubs = written(meetings(placed, share, at), "near-hubs")
        pairs = written(hubs.where("may").select("u", "v").distinct().join(met, ["u", "v"], "left_anti"), "near-more-pairs")
        more = written(verified(pairs, sets, share), "near-more-links")
        met = met.unionByName(pairs)
        done += [pairs, more]
        joined = components(hubs.join(more, ["u", "v"]).select(F.col("k").alias("u"), F.col("fk").alias("v")))
        n_joined = joined.count()
        links = links.unionByName(more)
        apart = renamed(renamed(hubs, joined, n_joined).withColumnsRenamed({"k": "_k", "fk": "k"}), joined, n_joined).where("_k <> k").select("key").distinct()
        apart = written(apart, "near-apart")
        n_apart = apart.count()
        placed = written(renamed(placed.join(few(apart, n_apart), "key", "left_semi"), joined, n_joined), "near-placed")
        dropped(hubs, joined, apart, *read)
        read = [placed]
        if not n_joined or before is not None and 10 * n_apart > 9 * before:
            break
        before = n_apart

    # what is still apart meets pairwise
    rest = placed.where("c <> hub").join(classes.select("c", "first", "second"), "c")
    sketches = written(sketched(sets, rest.select("c").distinct(), 2 * groups * hashes), "near-sketches")
    rest = rest.join(sketches, "c").select("key", "i", "j", "c", "n", "k", "first", "second", "sketch")
    a, b = rest.alias("a"), rest.alias("b")      # the same columns on both sides: these wide rows are dealt once

    def earlier(x: str, at: str):      # do both have a signature in common before this one?
        same = F.zip_with(F.slice(f"a.{x}", F.lit(1), F.col(at)), F.slice(f"b.{x}", F.lit(1), F.col(at)), lambda p, q: p == q)
        return F.exists(same, lambda z: z)

    same_table = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("key", "i", "j")]
    more = a.join(b, same_table + [F.col("a.c") < F.col("b.c"), F.col("a.k") != F.col("b.k"), sizes_agree("a.n", "b.n"),
                                   agreement("a.sketch", "b.sketch") >= least_agreement(share), ~earlier("first", "a.i"), ~earlier("second", "a.j")]).select(
        F.col("a.c").alias("u"), F.col("b.c").alias("v")).distinct().join(met, ["u", "v"], "left_anti")
    more = written(more, "near-more")
    dropped(placed, sketches)
    links = written(links.unionByName(verified(more, sets, share)), "near-all-links")
    dropped(more, *done)
    found = components(links)
    dropped(links)
    return found


def grouped(docs: DataFrame, words: int, share: int, groups: int, hashes: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row."""
    base = written(signed(docs, words, groups, hashes), "near-signatures")
    linkable = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = linkable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    classes = linkable.select("doc_id", "digest", "n_shingles", "first", "second").join(least, ["doc_id", "digest"], "left_semi").dropDuplicates(["digest"])
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "near-classes")      # numbered once, as written
    found = linked_classes(classes, docs, words, share, groups, hashes)
    # a component is shown as the least doc_id of its classes
    placed = classes.select("c", "digest", "doc_id").join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    shown = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = placed.join(shown, "component").select("digest", "component_id")
    rows = base.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = rows.join(of_class, "digest", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE, groups: int = GROUPS, hashes: int = HASHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return grouped(docs, words, share, groups, hashes).drop("text_key")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of links of STAGE_SHARE per cent or more; a row is known by its doc_id and text."""
    gone = grouped(docs, WORDS, STAGE_SHARE, STAGE_GROUPS, STAGE_HASHES).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_gone_key"]), "left_anti")
