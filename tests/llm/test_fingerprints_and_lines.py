import hashlib
import re

from odd_rows import none, odd  # noqa: F401
from pyspark.sql import functions as F

from linepulse.llm import quality_lines, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def brute_winnow(hashes, w=winnowing.W):
    """(hash, position) by the definition: least of each window, rightmost of equals."""
    if not hashes:
        return []
    picked = []
    for s in range(max(1, len(hashes) - w + 1)):
        window = hashes[s:s + w]
        at = s + max(i for i, h in enumerate(window) if h == min(window))
        if (hashes[at], at) not in picked:
            picked.append((hashes[at], at))
    return picked


def parse(fp):
    return [(int(a, 16), int(b)) for a, b in (x.split("@") for x in fp.split(","))] if fp else []


def test_winnowing_follows_the_definition(spark):
    texts = [" ".join("abcde"[(i * i + k) % 5] for i in range(n)) for k in range(3) for n in (0, 1, 3, 4, 5, 7, 8, 30, 90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = df.select("doc_id", winnowing.word_hashes(F.col("text")).alias("h")).collect()
    hashed = {}
    for r in grams:
        n = len(r["h"])
        spans = [r["h"]] if 0 < n < winnowing.K else [r["h"][i:i + winnowing.K] for i in range(n - winnowing.K + 1)]
        rows_ = [(i, s) for i, s in enumerate(spans)]
        if not rows_:
            hashed[r["doc_id"]] = []
            continue
        g = spark.createDataFrame(rows_, "i int, h array<long>")
        value = F.xxhash64("h") if n < winnowing.K else F.xxhash64(F.xxhash64(F.col("h")[0], F.col("h")[1]), F.xxhash64(F.col("h")[2], F.col("h")[3]))
        hashed[r["doc_id"]] = [x["v"] for x in g.select("i", value.bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")).orderBy("i").collect()] if n in (0, 3, 4, 8, 30) else None
    for r in winnowing.fingerprints(df).collect():
        if hashed[r["doc_id"]] is not None:
            assert parse(r["fingerprint"]) == brute_winnow(hashed[r["doc_id"]])


def test_shared_passages_are_found(spark):
    passage = " ".join(f"p{i}" for i in range(winnowing.GUARANTEE))
    a, b = f"x1 x2 x3 {passage} x4 x5 x6 x7 x8 x9", f"y1 y2 y3 y4 y5 {passage} y6"
    fa, fb = [{h for h, _ in parse(r["fingerprint"])} for r in winnowing.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert fa & fb


def test_edits_of_odd_rows(odd, none):
    got = winnowing.compare_edits(odd).collect()
    docs = [r for r in odd.collect()]
    assert len(got) == len(docs)
    ordered = sorted(docs, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    # distinct ids: the edit follows from the next id; ties may stand in either order
    by_id = {}
    for r, nxt in zip(ordered, ordered[1:] + ordered[:1]):
        t, f = r["text"] or "", nxt["text"] or ""
        half = len(t) // 2
        by_id.setdefault(r["doc_id"], []).append(hashlib.sha256((t[:len(t) - half] + f[:half]).encode()).hexdigest())
    single = {d for d, x in by_id.items() if len(x) == 1 and d is not None and d not in (5, 6, 7)}
    for r in got:
        assert r["n_chars"] is not None and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] in single:
            assert r["edited_sha256"] == by_id[r["doc_id"]][0]
    prints = {}
    texts = {}
    for r in docs:
        texts.setdefault(r["text"] or "", set()).add(r["doc_id"])
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[6] and prints[7] <= prints[6]          # equal texts
    assert winnowing.compare_edits(none).collect() == []


def test_next_document_over_sparse_ids(spark):
    ids = [-70_000, -3, 0, 5, 255, 256, 1_000, 70_000, 1 << 40]
    df = spark.createDataFrame([(i, f"text {i} " + "abc " * 10) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in winnowing.compare_edits(df).collect()}
    down = sorted(ids, reverse=True)
    for i, j in zip(down, down[1:] + down[:1]):
        t, f = f"text {i} " + "abc " * 10, f"text {j} " + "abc " * 10
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[:len(t) - half] + f[:half]).encode()).hexdigest()
    one = winnowing.compare_edits(df.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            for s in starts:
                covered.update(range(s, s + 8))
    lines, known, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in known
        known.add(x)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_line_counts(spark, odd, none):
    texts = ["a b c d e f g h a b c d e f g h", "x " * 30, "l1\nl1\n \n\nl1 \nl2", "# $ | <>", "w " * 7, "a b c d e f g h i j a b c d e f g h i j k"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for d in (df, odd.select("doc_id", "text", "n_words", "digest")):
        got = quality_lines.clean(d).collect()
        assert len(got) == d.count()
        for r in got:
            want = brute_counts(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r["base_failed"] and r["kept"])
    assert quality_lines.contract(quality_lines.clean(none)).collect() == []


def test_line_rules(spark):
    good = "The lantern stood by the river until the morning came and nobody moved it. "
    bad = {"navigation": "Home | News | Sport | About | Contact.", "closing": "no mark at the end of this line", "shouting": "BUY NOW TODAY EVERYTHING!!",
           "symbols": "a&&& b%%% c$$$.", "boilerplate": "Read more."}
    lines = spark.createDataFrame([("good", good.strip()), ("good", "“Is it so?”"), ("good", "Das ist, wie gesagt, Öl."), *bad.items()], "kind string, line string")
    for r in lines.select("kind", quality_lines.line_passes(F.col("line")).alias("ok")).collect():
        assert r["ok"] == (r["kind"] == "good"), r
    docs = spark.createDataFrame([(1, good * 3), (2, good * 3 + "\n" + bad["closing"]), (3, good + "\n" + "\n".join([bad["closing"] + str(i) for i in range(9)]))], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality_lines.clean(docs.withColumn("text", F.regexp_replace("text", "stood", F.concat(F.lit("stood"), F.col("doc_id"))))).collect()}[3] is False
    assert {r["doc_id"]: r["n_removed"] for r in quality_lines.clean(docs).collect()} == {1: 0, 2: 1, 3: 9}
