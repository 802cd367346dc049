"""The registered queries of this subpackage: opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_wrapper, license_scan, line_dedup, near_dup, oracles, prefix_trie, quality_rules, sentencepiece_codec, substring_dedup, toxicity, url_filter, vector_codes

#: Where the vocabulary file lies; a parameter of the operator.
PIECE_MODEL = "piece_bpe_32k.model"
#: Verdict, host and path of the rules on URLs of pages.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_decode(docs, piece_model(), digests=True)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_wrapper.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that no repeated window covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality_signals(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, read back from its formatted turns."""
    return chat_format.conversation_digests(chat_format.probe(table(spark, sf_dir, "conversations")))


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document, and whether it is the one that stays."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keeper")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in each document."""
    found = license_scan.license_summary(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_license_words", F.round("best_dice", 6).alias("best_dice"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of each document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page's URL."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_table(spark, URL_RULES))
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of each whole vector, and the digest of the codebooks."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_substring_dedup, op3_toxicity, op4_line_dedup, op5_quality_rules, op6_sentencepiece, op7_chat_format, op8_minhash_near_dup, op9_license_scan, op10_decontamination, op11_url_filter, op12_vector_codes, op13_prefix_trie]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": oracles.op2(), "op4_line_dedup": oracles.op4(), "op5_quality_rules": oracles.op5(), "op7_chat_format": oracles.op7(), "op9_license_scan": oracles.op9(), "op10_decontamination": oracles.op10(), "op11_url_filter": oracles.op11(URL_RULES), "op12_vector_codes": oracles.op12(), "op13_prefix_trie": oracles.op13()}
