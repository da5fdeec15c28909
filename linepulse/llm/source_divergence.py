"""Operator 12: how the sources of a language differ in their words, by one-hot level products.

Terms are runs of letters (A-Z lower-cased; every character beyond ASCII counts as one).  Each language keeps the terms of at least ``LEAST_DOCS`` of its
documents.  A group (language, source) that has a term c times out of N kept occurrences gives it p = 1 + floor(SCALE * (c + 1) / (N + V)), with
V the number of kept terms; the divergence of p from q at a term is floor((p - q)^2 / q).  Sums over all terms of every ordered pair of
sources, and each group's terms that stand out most from its language, are ranked.

The price of a term depends only on its two counts.  So the terms of a language are rows of an indicator matrix with one column
for each (source, count level), and this matrix, transposed, times itself holds every joint table: how many terms have count c in source a and
count d in source b.  ``joint_tables`` computes the product in blocks: rows of terms of about the same total (few levels a block), column
blocks of ``SOURCES`` sources, dense tiles of ``COLUMNS`` columns, exact in 32-bit floats because a block has under 2^24 rows; the blocks' tables
are added as integers.  Only counts above 0 have columns; level 0 follows from the margins:

  sum f = sum over cells n * (f(c,d) - f(c,0) - f(0,d) + f(0,0)) + sum over c of n_a(c) * (f(c,0) - f(0,0)) + the same for d + V * f(0,0)

Texts are read once: tasks count the terms of each group, spilling partial counts when they hold ``HELD`` of them, and all else works on
counts.  A hot source is counted by many tasks; no window or group holds more than a term's sources, a block of
terms, or one language's sources.

Rows: null texts, languages and sources are read as ''; texts without terms still make their group; repeated rows are documents of
their own, doc_id is not read; ties go to the smaller item by code point; a language without kept terms gives pairs of value 0; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepulse.llm.common import in_arrow, ship, written

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200          # ranks of the part 'term'
HELD = 250_000     # counts a task holds before it passes them on
TERMS = 8192       # rows of a block, about
SOURCES = 32       # sources of a column block
COLUMNS = 1024     # columns of a dense tile
FEW_GROUPS = 100_000   # groups up to this number are sent to all tasks

# every byte that is no letter becomes a space, A-Z their lower case; bytes of characters beyond ASCII stay
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: counts of parts of the table; the empty term marks that the group occurs."""
    def run(batches):
        def table():
            langs, sources, terms, n, d = [], [], [], [], []
            for (lang, source), (count, seen) in held.items():
                langs += [lang] * (len(count) + 1)
                sources += [source] * (len(count) + 1)
                terms += [b"", *count]
                n += [0, *count.values()]
                d += [0, *map(seen.__getitem__, count)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                                               pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                count, seen = held.setdefault((lang, source), ({}, {}))
                before = len(count)
                words = text.encode("utf-8", "replace").translate(LETTERS).split()
                for w in words:
                    count[w] = count.get(w, 0) + 1
                for w in set(words):
                    seen[w] = seen.get(w, 0) + 1
                size += len(count) - before
                if size >= HELD:
                    yield table()
                    size = 0
        if held:
            yield table()

    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return in_arrow(src, run, "lang string, source string, term string, n long, docs long")


def groups_of(partial: DataFrame) -> DataFrame:
    """lang, source, s: the groups, numbered within their language."""
    found = partial.where("term = ''").select("lang", "source").distinct()
    return found.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def near(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join: sent to all tasks if it has few rows (counted), else left to Spark."""
    return F.broadcast(df) if rows <= FEW_GROUPS else df


def term_vectors(partial: DataFrame, groups: DataFrame, n_groups: int, least_docs: int) -> DataFrame:
    """lang, term, total, at (source numbers and counts above 0): a row for each kept term.  One shuffle, by term."""
    numbered = partial.where("term <> ''").join(near(groups, n_groups), ["lang", "source"]).select("lang", "term", "s", "n", "docs")
    by_source = numbered.repartition("lang", "term").groupBy("lang", "term", "s").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # at most one entry for each source of the language
    return by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("s", "n")).alias("at")).where(
        F.col("docs") >= least_docs).drop("docs")


def sizes(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, s, v, n, n_lang: of every group its kept occurrences and its language's, and the language's number of kept terms."""
    langs = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    of = vectors.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.s").alias("s")).agg(F.sum("x.n").alias("n"))
    return groups.join(langs, "lang", "left").join(of, ["lang", "s"], "left").na.fill(0, ["v", "n_lang", "n"])


def product(a: tuple, b: tuple, rows: int, tile: int = COLUMNS):
    """Cells (column of a, column of b, number) above 0 of the transposed indicator matrix a times b.  a, b: row and column numbers of their ones."""
    def tiles(x):
        order = np.argsort(x[1], kind="stable")
        row, column = x[0][order], x[1][order]
        last = column[-1] + 1 if len(column) else 0
        for at in range(0, last, tile):
            lo, hi = np.searchsorted(column, [at, at + tile])
            m = np.zeros((rows, min(tile, last - at)), dtype=np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            yield at, m

    for at, m in tiles(a):
        for to, w in tiles(b):
            p = m.T @ w
            i, j = np.nonzero(p)
            yield i + at, j + to, p[i, j].astype(np.int64)


def joint_tables(vectors: DataFrame, groups: DataFrame, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """lang, a, c, b, d, n: the number of terms with count c > 0 in source a and count d > 0 in source b, for a < b."""
    height = vectors.withColumn("height", F.floor(F.log2("total")).cast("int"))
    parts = height.groupBy("lang", "height").agg(F.ceil(F.count(F.lit(1)) / terms).cast("int").alias("parts"))
    blocks = groups.groupBy("lang").agg((F.floor(F.max("s") / sources) + 1).cast("int").alias("blocks"))
    dealt = height.join(parts, ["lang", "height"]).join(blocks, "lang").select(
        "lang", "height", F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"), "at", "blocks", F.array_distinct(F.transform("at", lambda x: F.floor(x["s"] / sources).cast("int"))).alias("mine"))
    # a row goes to every pair of its own column blocks
    pairs = F.explode(F.flatten(F.transform("mine", lambda i: F.transform(F.filter("mine", lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    sent = dealt.withColumn("ij", pairs).select("lang", "height", "part", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), F.filter(
        "at", lambda x: F.floor(x["s"] / sources).isin(F.col("ij.i"), F.col("ij.j"))).alias("at"))

    def multiply(key, part):
        lang, _, _, i, j = (k.as_py() for k in key)
        lists = part.column("at").combine_chunks()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        s, n = flat.field("s").to_numpy().astype(np.int64), flat.field("n").to_numpy()
        order = np.lexsort((n, s))
        row, s, n = row[order], s[order], n[order]
        new = np.append(True, (np.diff(s) != 0) | (np.diff(n) != 0))
        column = np.cumsum(new) - 1
        source, level = s[new], n[new]
        mine = [(row[s // sources == k], column[s // sources == k]) for k in (i, j)]
        cells = [np.zeros(0, dtype=np.int64)] * 3, []
        for x, y, count in product(*mine, len(lists)):
            ordered = source[x] < source[y]
            cells[1].append((x[ordered], y[ordered], count[ordered]))
        x, y, count = (np.concatenate(c) for c in zip(*cells[1])) if cells[1] else cells[0]
        return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "a": pa.array(source[x], pa.int32()), "c": pa.array(level[x]), "b": pa.array(source[y], pa.int32()),
                         "d": pa.array(level[y]), "n": pa.array(count)})

    ship(vectors.sparkSession)
    tables = sent.groupBy("lang", "height", "part", "i", "j").applyInArrow(multiply, "lang string, a int, c long, b int, d long, n long")
    return tables.groupBy("lang", "a", "c", "b", "d").agg(F.sum("n").alias("n"))


def weight(count, n, v):
    """p of a count in a group."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({n} + {v} as decimal(20,0))")


def price(p: str, q: str):
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})").cast("decimal(20,0)")


def pair_part(vectors: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """lang, source, item, value of every ordered pair of a language's sources."""
    known = groups.select("lang", "s", "v", F.col("n").alias("size")).where("v > 0").withColumn("p0", weight("0L", "size", "v"))

    def side(x: str):
        return near(known.select("lang", F.col("s").alias(x), F.col("size").alias(f"n_{x}"), F.col("p0").alias(f"p0_{x}"), *([F.col("v")] if x == "a" else [])), n_groups)

    half = joint_tables(vectors, groups)
    cells = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("d").alias("c"), F.col("a").alias("b"), F.col("c").alias("d"), "n"))
    cells = cells.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).withColumn("p", weight("c", "n_a", "v")).withColumn("q", weight("d", "n_b", "v"))
    inner = F.col("n") * (price("p", "q") - price("p", "p0_b") - price("p0_a", "q") + price("p0_a", "p0_b"))
    joint = cells.groupBy("lang", "a", "b").agg(F.sum(inner.cast("decimal(38,0)")).alias("value"))

    levels = vectors.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.s").alias("s"), F.col("x.n").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    levels = written(levels, "divergence-levels")
    pairs = known.select("lang", F.col("s").alias("a"), F.col("size").alias("n_a"), F.col("p0").alias("p0_a"), "v").join(
        known.select("lang", F.col("s").alias("b"), F.col("size").alias("n_b"), F.col("p0").alias("p0_b")), "lang").where("a <> b")
    of_a = pairs.join(levels.withColumnRenamed("s", "a"), ["lang", "a"]).withColumn("p", weight("c", "n_a", "v")).select(
        "lang", "a", "b", (F.col("m") * (price("p", "p0_b") - price("p0_a", "p0_b"))).cast("decimal(38,0)").alias("value"))
    of_b = pairs.join(levels.withColumnRenamed("s", "b"), ["lang", "b"]).withColumn("q", weight("c", "n_b", "v")).select(
        "lang", "a", "b", (F.col("m") * (price("p0_a", "q") - price("p0_a", "p0_b"))).cast("decimal(38,0)").alias("value"))
    none = pairs.select("lang", "a", "b", (F.col("v") * price("p0_a", "p0_b")).cast("decimal(38,0)").alias("value"))
    margins = of_a.unionByName(of_b).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    total = none.unionByName(joint).unionByName(margins).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))

    names = groups.select("lang", "s", "source", "v")
    every = names.select("lang", F.col("s").alias("a"), "source").join(names.select("lang", F.col("s").alias("b"), F.col("source").alias("item")), "lang").where("a <> b")
    return every.join(total, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def term_part(vectors: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """lang, source, item, value of every term that a group has more than its language."""
    one = vectors.select("lang", F.col("term").alias("item"), "total", F.explode("at").alias("x")).select("lang", "item", "total", F.col("x.s").alias("s"), F.col("x.n").alias("c"))
    priced = one.join(near(groups.select("lang", "s", "source", "v", "n", "n_lang"), n_groups), ["lang", "s"]).withColumn("p", weight("c", "n", "v")).withColumn("q", weight("total", "n_lang", "v"))
    return priced.where("p > q").select("lang", "source", "item", price("p", "q").cast("long").alias("value"))


def ranked(part: DataFrame, name: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = part.withColumn("rank", F.row_number().over(order))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    partial = written(partial_counts(docs), "divergence-counts")
    groups = written(groups_of(partial), "divergence-groups")
    n_groups = groups.count()
    vectors = written(term_vectors(partial, groups, n_groups, least_docs), "divergence-terms")
    groups = written(sizes(vectors, groups), "divergence-sizes")
    return ranked(pair_part(vectors, groups, n_groups), "pair").unionByName(ranked(term_part(vectors, groups, n_groups), "term", top))


ORACLE = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
ng AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
nl AS (SELECT lang, sum(n) AS total FROM cl GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST({SCALE} * (CAST(coalesce(c.n, 0) AS HUGEINT) + 1) // (coalesce(ng.total, 0) + vs.v) AS HUGEINT) AS p
  FROM g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source),
ql AS (SELECT lang, term, 1 + CAST({SCALE} * (CAST(n AS HUGEINT) + 1) // (total + v) AS HUGEINT) AS q FROM cl JOIN nl USING (lang) JOIN vs USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, CAST((p.p - q) * (p.p - q) // q AS BIGINT) AS value FROM p JOIN ql USING (lang, term) WHERE p.n > 0 AND p.p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= {TOP}
"""
