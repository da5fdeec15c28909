"""Operator 10: token ids in a canonical length-limited Huffman file.

File format, a folder with two Parquet tables:

``codebook``  one row: ``limit`` (longest code, bits), ``lengths`` (binary, one unsigned byte per id: the length of its
              canonical code, 0: the id does not occur).  Codes follow from lengths: shorter first, then by id.
``blocks``    ``part``, ``block`` (number in its part), ``before`` (ids of the part before the block), ``n_ids``,
              ``payload`` (binary).  Parts ascend by doc_id, and so do the blocks of a part.  A payload stands alone:
              a header of five unsigned 32-bit integers (documents, ids, ids between checkpoints, checkpoints, bytes
              of the bit stream), the documents' ids (signed 64-bit; a bitmap of nulls follows) and lengths (unsigned
              32-bit), the checkpoints (unsigned 32-bit bit offsets into the stream) and the bit stream, most
              significant bit first.

Writing: the texts are encoded once and written, with each task's counts of ids; their sum (one row per id, bounded
by the vocabulary) gives the code lengths, by package-merge; then a range sort by doc_id and one pass that packs blocks.  A block
holds whole documents and is closed at ``BLOCK_IDS`` ids, so a task holds one block at a time.

Reading: all checkpoint segments of a block are decoded side by side by one table lookup per id.  Ids before a part
come from the sums of ``n_ids`` (one row per part).  A bit stream is shorter than 2^32 bits.

Rows: null text is the empty text and holds the end id only; rows with equal doc_id follow one another, ordered by
their ids; null doc_id comes first; an empty table gives empty files and no rows; only the id and the text are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepulse.llm.chunks import packer
from linepulse.llm.common import in_pandas, run_path, tokenizer_file, whole_text, written

LIMIT = 18              # bits of the longest code
BLOCK_IDS = 1 << 17     # ids at which a block is closed
STEP = 128              # ids between checkpoints
BLOCK_SCHEMA = "part int, block int, before long, n_ids long, payload binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``limit`` bits (package-merge)."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need codes longer than {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n = len(leaves)
    levels, weight = [], np.empty(0, dtype=np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, weight])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)                       # per item of the merged list: a leaf?
        merged = both[at]
        even = len(merged) // 2 * 2
        weight = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())            # the lightest `used` leaves get one bit more
        depth[:used] += 1
        take = 2 * (take - used)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        ids = np.flatnonzero(lengths == n)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset of each id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    if len(ids):
        c, word, shift = codes[ids], starts >> 6, 64 - (starts & 63) - n
        inside = np.where(shift >= 0, c << np.maximum(shift, 0).astype(np.uint64), c >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat(inside, first)
        over = np.flatnonzero(shift < 0)            # at most one code crosses the end of a word
        words[word[over] + 1] += c[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], starts


def decode_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``limit`` bits: the id that it begins with, and the bits that id takes."""
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    n = lengths[order].astype(np.int64)
    spans = np.left_shift(1, limit - n)
    sym = np.zeros(1 << limit, dtype=np.uint32)
    bits = np.ones(1 << limit, dtype=np.uint8)
    filled = int(spans.sum())
    sym[:filled], bits[:filled] = np.repeat(order, spans), np.repeat(n, spans)
    return sym, bits


def unpack(stream: bytes, checkpoints: np.ndarray, n_ids: int, step: int, table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """All ids of a bit stream; the segments between checkpoints are decoded side by side."""
    sym, bits = table
    data = np.frombuffer(stream + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]     # the 32 bits from each byte on
    lanes, last, mask = len(checkpoints), len(stream) * 8, (1 << limit) - 1
    out = np.empty((step, lanes), dtype=np.uint32)
    at = checkpoints.astype(np.uint32)
    for i in range(step):
        window = ahead[at >> 3] >> (32 - limit - (at & 7)) & mask
        out[i] = sym[window]
        at = np.minimum(at + bits[window], last)
    return out.T.reshape(-1)[:n_ids]


def build_block(docs: list[tuple], arrays: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """docs: (doc_id or None, number of ids)."""
    ids = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    stream, starts = pack(ids, lengths, codes)
    checkpoints = starts[::STEP].astype("<u4")
    head = np.array([len(docs), len(ids), STEP, len(checkpoints), len(stream)], dtype="<u4")
    names = np.array([0 if d is None else d for d, _ in docs], dtype="<i8")
    nulls = np.packbits(np.array([d is None for d, _ in docs], dtype=bool))
    sizes = np.array([n for _, n in docs], dtype="<u4")
    return b"".join(x.tobytes() for x in (head, names, nulls, sizes, checkpoints)) + stream


def parse_block(payload: bytes, table: tuple[np.ndarray, np.ndarray], limit: int) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids (None: null), number of ids of each, all ids."""
    n_docs, n_ids, step, n_check, n_stream = (int(x) for x in np.frombuffer(payload, "<u4", 5))
    at = 20
    names = np.frombuffer(payload, "<i8", n_docs, at)
    at += 8 * n_docs
    nulls = np.unpackbits(np.frombuffer(payload, np.uint8, (n_docs + 7) // 8, at))[:n_docs]
    at += (n_docs + 7) // 8
    sizes = np.frombuffer(payload, "<u4", n_docs, at)
    at += 4 * n_docs
    checkpoints = np.frombuffer(payload, "<u4", n_check, at)
    at += 4 * n_check
    ids = unpack(payload[at:at + n_stream], checkpoints, n_ids, step, table, limit)
    return [None if z else int(d) for d, z in zip(names, nulls)], sizes, ids


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (16- or 32-bit little-endian, by the vocabulary's size) of every row, the end id last.

    Each task adds one row without ids: how often it wrote each id (``counts``, signed 64-bit).
    """
    code = id_code(tokenizer)

    def run(batches):
        import pandas as pd
        ids = packer(tokenizer_file(tokenizer), code)
        end, total = np.array([end_id], dtype=code).tobytes(), np.zeros(0, dtype=np.int64)
        for pdf in batches:
            found = [ids(t) + end for t in pdf["text"]]
            n = np.bincount(np.frombuffer(b"".join(found), dtype=code), minlength=len(total))
            n[:len(total)] += total
            total = n
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": found, "counts": None})
        yield pd.DataFrame({"doc_id": [None], "ids": [None], "counts": [total.astype("<i8").tobytes()]})

    return in_pandas(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), run,
                     "doc_id long, ids binary, counts binary", ("chunks",))


@lru_cache(maxsize=4)
def vocabulary(tokenizer: str) -> int:
    from linepulse.llm.chunks import library
    return library(tokenizer_file(tokenizer)).get_vocab_size(with_added_tokens=True)


def id_code(tokenizer: str) -> str:
    return "H" if vocabulary(tokenizer) <= 1 << 16 else "I"


def count_ids(encoded: DataFrame) -> DataFrame:
    """id, n over all rows, from the counts of the tasks."""
    def run(batches):
        import pandas as pd
        for pdf in batches:
            for counts in pdf["counts"]:
                n = np.frombuffer(counts, "<i8")
                at = np.flatnonzero(n)
                yield pd.DataFrame({"id": at, "n": n[at]})

    return in_pandas(encoded.where("counts IS NOT NULL").select("counts"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, limit: int = LIMIT,
              id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all documents below ``path``; returns the path."""
    spark, code = docs.sparkSession, id_code(tokenizer)
    encoded = written(encode_texts(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    counts = np.zeros(max(vocabulary(tokenizer), end_id + 1), dtype=np.int64)
    for row in count_ids(encoded).collect():      # at most one row per id of the vocabulary
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(limit, lengths.tobytes())], "limit int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches):
        import pandas as pd
        codes = canonical_codes(lengths)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        names, arrays, n = [], [], 0

        def row():
            return pd.DataFrame({"part": [part], "block": [block], "before": [before], "n_ids": [n], "payload": [build_block(names, arrays, lengths, codes)]})

        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"].astype(object), pdf["ids"]):
                ids = np.frombuffer(ids, dtype=code)
                names.append((None if pd.isna(doc_id) else int(doc_id), len(ids)))
                arrays.append(ids)
                n += len(ids)
                if n >= BLOCK_IDS:
                    yield row()
                    block, before, names, arrays, n = block + 1, before + n, [], [], 0
        if names:
            yield row()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = encoded.where("ids IS NOT NULL").withColumn("h", F.xxhash64("ids"))
    ordered = (keyed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "ids").select("doc_id", "ids"))
    in_pandas(ordered, run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (unsigned 32-bit little-endian) of every document of the files."""
    book = spark.read.parquet(f"{path}/codebook").first()
    limit, lengths = book["limit"], np.frombuffer(book["lengths"], dtype=np.uint8)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    first, total = {}, 0
    for row in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():   # one row per part
        first[row["part"]], total = total, total + row["n"]

    def run(batches):
        import pandas as pd
        table = decode_table(lengths, limit)
        for pdf in batches:
            for part, before, payload in zip(pdf["part"], pdf["before"], pdf["payload"]):
                names, sizes, ids = parse_block(payload, table, limit)
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                yield pd.DataFrame({
                    "doc_id": pd.array(names, dtype="Int64"), "start": starts + (first[part] + before), "n_tokens": sizes.astype(np.int64),
                    "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)]})

    return in_pandas(blocks.select("part", "before", "payload"), run, "doc_id long, start long, n_tokens long, ids binary")


def digests(read: DataFrame) -> DataFrame:
    """The contract's columns from what was read back."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, path: str | None = None) -> DataFrame:
    path = write_ids(docs, path or run_path(docs.sparkSession, "huffman-ids"), tokenizer, end_id)
    return digests(read_ids(docs.sparkSession, path))
