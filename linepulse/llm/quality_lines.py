r"""Operator 2: line-first quality rules, in DataFrame functions only.

Every line (split at \n) that has a word is judged by itself:

- punctuation: it must end in a closing mark (``CLOSING``), quotes and brackets behind it allowed;
- navigation: separators (``| > » › · •``) between words, at least one for every three words, and two or more;
- boilerplate: a phrase of ``PHRASES`` in a line of at most ``PHRASE_WORDS`` words;
- symbols: more than one character of ``SYMBOLS`` in eleven;
- shouting: eight or more capital letters, and more of them than other characters (without white space).

Lines that fail are removed; a document whose removed lines hold more than ``MAX_LOST`` of its characters (without white
space) is rejected, as is one that fails the base rules (fewer than ``MIN_WORDS`` words, or more than 30 % of the words in
8-word windows that the text holds twice or more).

Everything is computed inside the row by array functions: no shuffle, and a long text costs time in proportion
to its length (the sort of the repeated windows only runs for texts that have some).

Rows: null text is empty: no words, no lines, rejected; white space only likewise; repeated rows are judged each for itself;
an empty table gives no rows; further columns are kept, but ours take the place of those with the same name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepulse.llm.common import whole_text
from linepulse.llm.winnowing import let, pairs

MIN_WORDS = 20
MAX_REPEATED = 30      # per cent of the words
WINDOW = 8
MAX_LOST = 0.5
SYMBOLS = "#*$%&|<>"
PHRASE_WORDS = 20
# phrases of pages around a text (fixed values)
PHRASES = ["accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "follow us on",
           "lorem ipsum", "privacy policy", "read more", "share this", "sign in to", "sign up for", "skip to content", "subscribe to", "terms of use"]
CLOSING = r"""[.!?…:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
WHITE = " \t\n\x0b\x0c\r"


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def n_solid(line: Column) -> Column:
    """Characters without white space."""
    return F.length(_without(line, WHITE))


def n_symbols(line: Column) -> Column:
    return F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))


def line_passes(line: Column, symbols: Column | None = None) -> Column:
    """Does a line with a word pass all line rules?  What costs more is read only where it matters."""
    symbols = n_symbols(line) if symbols is None else symbols
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    marks, capitals = F.regexp_count(line, F.lit("[|>»›·•]")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    phrase = let(F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in PHRASES]))
    return (((symbols == 0) | (symbols * 11 <= n_solid(line)))
            & line.rlike(CLOSING)
            & let(marks, lambda n: (n < 2) | (n * 3 < n_words))
            & let(capitals, lambda n: (n < 8) | (n * 2 <= n_solid(line)))
            & ~(phrase & (n_words <= PHRASE_WORDS)))


def repeated_words(words: Column) -> Column:
    """Number of words that lie in windows of WINDOW words found twice or more."""
    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("int").alias("last"))
        return F.aggregate(starts, zero, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]

    def starts(found: Column) -> Column:     # (hash, start), sorted: equal hashes are neighbours
        def shared(p: Column, i: Column) -> Column:
            return ((i > 0) & (F.get(found, i - 1)["h"] == p["h"])) | F.coalesce(F.get(found, i + 1)["h"] == p["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(found, shared), lambda p: p["i"]))

    def count(hs: Column) -> Column:
        found = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(found, lambda x: covered(starts(x))))

    def windows(ws: Column) -> Column:
        return F.when(F.size(ws) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: roll(hs, F.size(ws), 1)))

    def roll(hs: Column, n: Column, step: int) -> Column:     # hashes of 2, 4, ... successive words
        if step == WINDOW:
            return count(hs)
        return let(pairs(hs, n, step, lambda a, b: F.xxhash64(a, b)), lambda x: roll(x, n - step, step * 2))

    return let(words, windows)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with what the rules find: the counts, the lines kept as ``clean_text``, and the verdict."""
    text = whole_text(text_col)
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + f(x))
    out = docs.withColumns({"_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), "_lines": F.filter(F.split(text, "\n"), has_word)})
    judged = F.transform("_lines", lambda x: let(n_symbols(x), lambda n: F.struct(x.alias("line"), n.alias("symbols"), line_passes(x, n).alias("ok"))))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": total(F.col("_words"), F.length),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")), "_judged": judged})
    out = out.withColumns({
        # symbols are word characters: lines without words have none
        "n_symbols": total(F.col("_judged"), lambda x: x["symbols"]),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        "clean_text": F.array_join(F.transform(F.filter("_judged", lambda x: x["ok"]), lambda x: x["line"]), "\n"),
        "_bad": F.filter("_judged", lambda x: ~x["ok"])})
    out = out.withColumns({"n_removed": F.size("_bad").cast("long"),
                           "kept_chars": F.col("word_chars") - total(F.col("_bad"), lambda x: n_solid(x["line"]))})
    lost = F.col("word_chars") - F.col("kept_chars")
    return out.withColumn("kept", ~F.col("base_failed") & (lost <= MAX_LOST * F.col("word_chars"))).drop("_words", "_lines", "_judged", "_bad")


def contract(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                          "n_lines", "n_removed", "kept_chars")


# the same in DuckDB's SQL
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
), s AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), r AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM s) GROUP BY doc_id
), l AS (
  SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS solid, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(x, '[|>»›·•]')) AS marks,
         len(regexp_extract_all(x, '\p{Lu}')) AS capitals
  FROM (SELECT doc_id, unnest(ls) AS x FROM d)
), k AS (
  SELECT doc_id, count(*)::BIGINT AS n_kept, sum(solid)::BIGINT AS kept_chars FROM l
  WHERE regexp_matches(x, '[.!?…:;]["''”’»)\]]*[\x20\x09-\x0D]*$') AND NOT (marks >= 2 AND marks * 3 >= words)
    AND NOT (words <= 20 AND regexp_matches(lower(x), 'PHRASES'))
    AND symbols * 11 <= solid AND NOT (capitals >= 8 AND capitals * 2 > solid)
  GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len(ls)::BIGINT - coalesce(n_kept, 0) AS n_removed, coalesce(kept_chars, 0) AS kept_chars
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars - kept_chars <= 0.5 * word_chars AS kept, n_lines, n_removed, kept_chars FROM b
""".replace("PHRASES", "|".join(PHRASES))
