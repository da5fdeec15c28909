"""Operator 4: token counts through a digest cache.

The cache is a table of (version, digest, n_tokens): the sha-256 of the tokenizer's file and of the
normalised content (null as empty; the text is otherwise taken as it is, because the file has no normaliser
under which other texts would be the same).  A run joins the digests of its documents to the cache, encodes
each distinct digest that is missing once, appends the new counts and joins all counts to the documents.

Equal texts meet in a map-side aggregate before anything is shuffled, so thousands of copies cost one text;
the count table has one row per digest, and a hot digest on the documents' side is light (id and digest) and is
split by the adaptive skew join.  The cache is appended by Spark's own committer: a run that is lost leaves no
part of it, and a digest that two runs append at once is read once.

Rows: null text counts as empty (0 bytes, 0 tokens); repeated rows each get their row; empty tables give an
empty result and append nothing; only the id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepulse.llm.chunks import counter
from linepulse.llm.common import in_pandas, run_path, tokenizer_file, whole_text, written

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
LIMIT = 1024   # tokens beyond which a document is over the limit


def version_of(tokenizer: str) -> str:
    """Digest of the tokenizer's file."""
    with open(tokenizer_file(tokenizer), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; empty where there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """digest, n_tokens of (digest, text) rows, by the tokenizers library."""
    def run(batches):
        import pandas as pd
        count = counter(tokenizer_file(tokenizer))
        for pdf in batches:
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": [count(t) for t in pdf["text"]]})

    return in_pandas(texts, run, "digest binary, n_tokens long", ("chunks",))


def fill_cache(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", text_col: str = "text") -> DataFrame:
    """Append the counts of the distinct texts that the cache lacks; return the whole cache of this version."""
    spark, version = docs.sparkSession, version_of(tokenizer)
    texts = docs.select(whole_text(text_col).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    cache = read_cache(spark, cache_path, version)
    if not cache.isEmpty():
        # a table of digests only: after this join no text of a known digest is moved
        missing = written(texts.select("digest").distinct().join(cache, "digest", "left_anti"), "digest-misses")
        texts = texts.join(missing, "digest", "left_semi")
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    counts = encode_counts(distinct, tokenizer)
    counts.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return read_cache(spark, cache_path, version)


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer: str = "byte_bpe_50k.json",
                 id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.  Without ``cache_path`` the run has a cache of its own."""
    cache = fill_cache(docs, cache_path or run_path(docs.sparkSession, "token-cache"), tokenizer, text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t")).select(
        "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"))
    return keyed.join(cache, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
