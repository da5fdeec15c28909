"""From documents to token ids: a pipeline of five of the text operators.

Each stage works on all rows that its predecessor kept, is written as Parquet below the cluster's shared folder and read again.

1. toxicity: documents predicted toxic go;
2. language: documents without letters go (also where no language could be learned, documents with letters stay);
3. near-duplicates: of each group of documents (linked by five-word shingles, similarity 0.80 or more) the one with the least doc_id stays;
4. mixing: documents are kept, repeated or left out until their sources are near their targets;
5. token ids: every row is encoded and decoded; doc_id and the ids with their digests come out.

Rows with null or empty texts have no letters and go in stage 2.  Repeated rows are treated alike by every stage.  An empty
table gives an empty result.  Columns beyond those of documents are dropped on entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepulse.llm import bpe_automaton, language_id, mixing, near_dedup, toxicity
from linepulse.llm.common import DOC_COLUMNS, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs.select(*DOC_COLUMNS), table(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.in_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_corpus(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip(docs).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                                                 F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe_automaton", encode),
]

# nearest neighbours, a trained classifier and MinHash are not expressible in SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
