import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from odd_rows import none, odd, rows  # noqa: F401

from linepulse.llm import bpe_automaton, chunks, huffman_ids, token_counts
from linepulse.llm.common import tokenizer_file

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


def odd_texts(n=3000, seed=3):
    draw = random.Random(seed)
    far = [chr(c) for c in [*range(0x250), *range(0x300, 0x400), *range(0x1e00, 0x2070), 0x3000, 0x1680, 0x4e00, 0x1f600, 0x200d, 0xfeff, 0x130, 0x3a3, 0x1100, 0x1161, 0xac00, 0x58b, 0x378]]
    out = ["", " ", "\n\n", "x" * 3000 + "the" * 500, "<|endoftext|>", "a<|endoftext|> b <|startoftext|>", "Two <|EndOfText|> words, DON'T They're.", "<|ENDOFTEXT|>", "A B... c--d e_f 'll x's"]
    for i in range(n):
        s = "".join(draw.choice(far if draw.random() < .5 else " \n\tabcdethinserÉéÀœß'smt<|endoftext|>!?0123.,-*$") for _ in range(draw.randint(0, 30)))
        out.append(s + "<|endoftext|>  x" if i % 40 == 0 else s)
    return out


def test_chunked_library_equals_the_library():
    count, pack = chunks.counter(BYTES), chunks.packer(WORDS, "I")
    a, w = chunks.library(BYTES), chunks.library(WORDS)
    for t in odd_texts():
        assert count(t) == len(a.encode(t, add_special_tokens=False).ids)
        assert pack(t) == array("I", w.encode(t, add_special_tokens=False).ids).tobytes()


def test_automaton_equals_the_library():
    mine, theirs = bpe_automaton.load(BYTES), chunks.library(BYTES)
    for t in odd_texts(seed=4):
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == array("I", ids).tobytes()
        assert mine.decode(mine.encode(t)) == theirs.decode(ids, skip_special_tokens=False)


def plain_merges(word, rank):
    parts = list(word)
    while True:
        best = min(((rank[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rank), default=None)
        if best is None:
            return parts
        r = best[0]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == r:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_against_plain_merging(seed):
    """Random merge lists over three letters, with pairs of equal parts; every word up to seven letters."""
    draw = random.Random(seed)
    labels, merges = ["a", "b", "c"], []
    while len(merges) < 7:
        u, v = draw.choice(labels), draw.choice(labels)
        if u + v not in labels:
            labels.append(u + v)
            merges.append((u, v))
    number = {x: i for i, x in enumerate(labels)}
    byte_ids = [0] * 256
    for c in "abc":
        byte_ids[ord(c)] = number[c]
    automaton = bpe_automaton.Automaton(byte_ids, [(number[u], number[v], number[u + v]) for u, v in merges], len(labels))
    encoder = bpe_automaton.Encoder(automaton, [x.encode() for x in labels], max_table=50)
    rank = {m: i for i, m in enumerate(merges)}
    for n in range(8):
        for k in range(3 ** n if n < 6 else 400):
            word = "".join("abc"[k // 3 ** i % 3] if n < 6 else draw.choice("abc") for i in range(n))
            assert [labels[i] for i in encoder.encode(word.encode())] == plain_merges(word, rank)


def test_bpe_rows(odd, none):
    theirs = chunks.library(BYTES)
    got = bpe_automaton.digests(bpe_automaton.round_trip(odd)).collect()
    apart = bpe_automaton.digests(bpe_automaton.decode_documents(bpe_automaton.encode_documents(odd)))
    assert sorted(map(str, apart.collect())) == sorted(map(str, got))
    want = sorted((r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest(), len(theirs.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["decoded_sha256"], r["n_tokens"]) for r in got) == want
    assert bpe_automaton.digests(bpe_automaton.round_trip(none)).collect() == []


def test_counts_and_cache(spark, odd, none, tmp_path, monkeypatch):
    theirs, path = chunks.library(BYTES), str(tmp_path / "cache")
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(theirs.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())

    def run():
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd, path).collect())

    assert run() == want
    stored = spark.read.parquet(path).count()
    assert stored == len({r[1] or "" for r in rows()})
    assert run() == want and spark.read.parquet(path).count() == stored          # all known: nothing is appended
    more = spark.createDataFrame([(1, "one"), (2, "a new text")], "doc_id long, text string")
    assert token_counts.count_tokens(more, path).count() == 2 and spark.read.parquet(path).count() == stored + 1
    # stored counts are used, and only those of this version of the tokenizer
    monkeypatch.setattr(token_counts, "version_of", lambda _: "other")
    token_counts.count_tokens(more, path).collect()
    assert spark.read.parquet(path).where("version = 'other'").count() == 2
    assert token_counts.count_tokens(none, str(tmp_path / "empty")).collect() == []


def test_code_lengths_are_optimal():
    draw = np.random.default_rng(5)
    for n, limit in ((2, 4), (5, 3), (6, 4), (9, 4)):
        counts = draw.integers(1, 100, n)
        lengths = huffman_ids.code_lengths(counts, limit).astype(int)
        assert lengths.max() <= limit and sum(2.0 ** -lengths) <= 1

        def best(i, room, counts=np.sort(counts)[::-1], limit=limit):      # all assignments of falling counts to rising lengths
            if room < 0:
                return float("inf")
            if i == len(counts):
                return 0
            return min(counts[i] * k + best(i + 1, room - (1 << (limit - k))) for k in range(1, limit + 1))

        assert (counts * lengths).sum() == best(0, 1 << limit)
    assert huffman_ids.code_lengths(np.array([0, 7, 0]), 4).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(9, dtype=int), 3)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_bits_round_trip(n):
    draw = np.random.default_rng(n)
    counts = np.concatenate([[0, 0], draw.zipf(1.3, 500).clip(1, 10 ** 9)])
    lengths = huffman_ids.code_lengths(counts, 12)
    ids = draw.integers(2, 502, n).astype(np.uint16)
    docs = [(5, n // 3), (None, n - n // 3)]
    payload = huffman_ids.build_block(docs, [ids[:n // 3], ids[n // 3:]], lengths, huffman_ids.canonical_codes(lengths))
    names, sizes, back = huffman_ids.parse_block(payload, huffman_ids.decode_table(lengths, 12), 12)
    assert names == [5, None] and sizes.tolist() == [x for _, x in docs] and (back == ids).all()


def test_file_round_trip(spark, odd, none, tmp_path, monkeypatch):
    theirs = chunks.library(WORDS)
    for block in (40, huffman_ids.BLOCK_IDS):
        monkeypatch.setattr(huffman_ids, "BLOCK_IDS", block)
        got = huffman_ids.round_trip(odd, path=str(tmp_path / f"ids{block}")).collect()
        got.sort(key=lambda r: r["start"])
        assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((r[0] is not None, r[0] or 0) for r in rows())
        at, left = 0, [(r[0], array("I", [*theirs.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows()]
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
            found = next(x for x in left if x[0] == r["doc_id"] and len(x[1]) == r["n_tokens"] and zlib.crc32(x[1].tobytes()) == r["ids_crc32"])
            left.remove(found)
    assert huffman_ids.round_trip(none, path=str(tmp_path / "none")).collect() == []
