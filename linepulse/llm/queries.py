"""The registered queries of the text operators: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linepulse.llm import bpe_automaton, chat, huffman_ids, language_id, mixing, near_dedup, quality_lines, ranked_search, source_divergence, token_counts, toxicity, vector_search, winnowing
from linepulse.llm.common import table


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edits(table(spark, sf_dir, "documents"))


def op2_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.contract(quality_lines.clean(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.round_trip(turns.unionByName(extra))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(mixing.mix(table(spark, sf_dir, "documents")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(bpe_automaton.round_trip(table(spark, sf_dir, "documents")))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.round_trip(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline     # beside this package, at the repository's top
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_winnowing, op2_quality_lines, op3_toxicity, op4_token_counts, op5_language_id, op6_chat_formatting, op7_mixing, op8_near_dedup, op9_bpe_automaton,
                                    op10_huffman_ids, op11_ranked_search, op12_source_divergence, op13_vector_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_lines": quality_lines.ORACLE, "op6_chat_formatting": chat.ORACLE, "op7_mixing": mixing.ORACLE,
            "op11_ranked_search": ranked_search.ORACLE, "op12_source_divergence": source_divergence.ORACLE, "op13_vector_search": vector_search.ORACLE}
