import hashlib
import random
import re
from array import array
from collections import Counter

import pytest
from odd_rows import SHAPE, rows, sentence
from pyspark.sql import functions as F
from test_groups import reachable
from test_learned import brute_scores

import corpus_pipeline
from linepulse.llm import bpe_automaton, mixing, toxicity
from linepulse.llm.common import DOC_COLUMNS, table, tokenizer_file, written

SF = "/root/testdata/sf0.001"


def survivors(docs, share=80):
    """The ids that stay when one document of each component of links of ``share`` per cent stays, over all pairs."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up)) for i, t in docs}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    place = reachable(ids, links)
    return {i for i in ids if place[i] == i}


def test_run_equals_plain_python(spark, tmp_path):
    draw = random.Random(4)
    docs = [(i, sentence(i, 60 + i) + f" own{i}" + (" grobol vexkind" * 4 if i % 6 == 0 else ""), ["en", "de"][i % 2], ["a", "b", "c"][i % 3]) for i in range(72)]
    for i in range(10):                                   # copies on both sides of 0.80
        words = docs[5 * i + 1][1].split()
        for at in draw.sample(range(5, len(words) - 5), i % 5):
            words[at] = f"x{i}{at}"
        docs.append((100 + i, " ".join(words), "en", "b"))
    docs += [(200, "12345 ...", "en", "a"), (201, None, "en", "a"), (202, "", "de", None)]
    labels = [(i, int(i % 6 == 0)) for i in range(0, 72) if i % 7]
    spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    scores = brute_scores([(i, t) for i, t, *_ in docs], labels)
    left = [d for d in docs if scores[d[0]] < 0.5]
    assert {i for i in range(0, 72, 6)} & {d[0] for d in left} == set() and len(left) > 60
    left = [d for d in left if any(c.isalpha() for c in d[1] or "")]
    stay = survivors([d[:2] for d in left])
    left = {d[0]: d for d in left if d[0] in stay}
    taken = Counter(r["doc_id"] for r in got)
    assert set(taken) <= set(left) and max(taken.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d[1])) for i, d in left.items()}
    total = Counter()
    for i, d in left.items():
        total[d[3]] += size[i]
    weight, quota = dict(zip(sorted(total), (5, 2, 1))), {}
    open_, rest = set(total), 1.5 * sum(total.values())
    while True:                                           # targets stop at twice a source's size
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            quota[s], rest = 2 * total[s], rest - 2 * total[s]
        open_ -= over
    quota |= share
    for s in total:
        assert abs(sum(n * size[i] for i, n in taken.items() if left[i][3] == s) - quota[s]) <= max(size.values())
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for r in got:
        ids = library.encode(left[r["doc_id"]][1], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == array("I", ids).tobytes()
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]][1].encode()).hexdigest()


def test_stages_keep_what_their_operators_decide(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        count = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        if name == "toxicity":
            want = {r["doc_id"]: 1 for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect() if not r["predicted"]}
        elif name == "language_id":
            want = {r["doc_id"]: 1 for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
        elif name == "near_dedup":
            want = {i: 1 for i in survivors([(r["doc_id"], r["text"]) for r in docs.collect()])}
        elif name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
        else:
            want = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
            assert out.where(F.col("ids_sha256") != F.sha2("ids", 256)).count() == 0
        assert count == want
        if name != "bpe_automaton":
            assert out.columns == DOC_COLUMNS
        docs = out


@pytest.mark.parametrize("n", [None, 0])
def test_odd_and_empty_tables(spark, tmp_path, n):
    data = rows() if n is None else []
    spark.createDataFrame(data, SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (4, 1, 1)][:len(data)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == bool(data)
    assert not {0, 1, 2, 7, 8} & {r["doc_id"] for r in got}
    texts = {r[0]: r[1] for r in data}
    for r in got:
        if r["doc_id"] not in (None, 6):
            assert bpe_automaton.load(bpe_automaton.tokenizer_file("byte_bpe_50k.json")).decode(bytes(r["ids"])) == texts[r["doc_id"]]
