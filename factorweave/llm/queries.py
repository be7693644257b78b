"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, exact_dedup, fixity, jaccard_join, line_dedup, lm_scoring, ngram_quality, packing, pii, piece_transducer, ranked_search, simhash_join, wrapper_induction


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "lang", "text", "n_entities")


def op3_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.drill(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.quality_report(table(spark, sf_dir, "documents"))


def op5_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.extract(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), subwords=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.simhash_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_pii_surrogates": op2_pii_surrogates,
        "op3_merkle_fixity_audit": op3_merkle_fixity_audit,
        "op4_quality_rules": op4_quality_rules,
        "op5_piece_transducer": op5_piece_transducer,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_wrapper_induction": op7_wrapper_induction,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_line_dedup": op9_line_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
        "op12_ranked_search": op12_ranked_search,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_merkle_fixity_audit": fixity.SQL, "op1_ngram_jaccard_join": jaccard_join.SQL, "op6_exact_dedup": exact_dedup.SQL, "op11_conversation_prefix_trie": conversation_trie.SQL, "op12_ranked_search": ranked_search.SQL}
