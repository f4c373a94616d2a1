"""The training-data queries by name, with production parameters over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import (
    op1_chat_tree, op2_decontaminate, op3_language, op4_token_files, op5_token_counts, op6_lines, op7_licenses, op8_mix, op9_simhash, op10_quality,
    op11_lexical, op12_lloyd, op13_toxicity, oracles,
)
from changelens.llm.common import scratch, table

TOKENIZER = "word_bpe_49k.json"
CHAT_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """Where the tokenizer file is; looked up when a query runs, so that the others need no tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, as a prefix tree of tokens, read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    turns = turns.union(spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema))
    out, tokenizer = scratch(spark, "chat"), tokenizer_path(CHAT_TOKENIZER)
    op1_chat_tree.build(turns, out, tokenizer)
    return op1_chat_tree.digests(op1_chat_tree.read_conversations(spark, out, tokenizer))


def op2_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it covers by tiles, in any order."""
    return op2_decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and page by fused evidence."""
    found = op3_language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    return found.select("doc_id", "page_id", "host", "declared", "text_language", "language", "confidence", "accepted")


def op4_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in Arrow files in id order, read back."""
    out = op4_token_files.sequences_dir(spark)
    index = op4_token_files.write_sequences(table(spark, sf_dir, "documents"), out, tokenizer_path(TOKENIZER))
    return op4_token_files.read_documents(index, out).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op5_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    return op5_token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op6_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted lines of all documents and digests of what is left."""
    found = op6_lines.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.md5("clean_text").alias("clean_md5"), F.length("clean_text").alias("clean_chars"))


def op7_licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return op7_licenses.scan(table(spark, sf_dir, "documents"))


def op8_mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document under square-root weights of the sources."""
    return op8_mix.mixed(table(spark, sf_dir, "documents")).drop("k1", "k2")


def op9_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return op9_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents with its verdict under the newest policy."""
    found = op10_quality.ledger(table(spark, sf_dir, "documents"))
    kept = op10_quality.apply_policy(found, "v2")
    return kept.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           f"bits & {op10_quality.mask('base')} != 0 AS base_failed", "kept", "bits")


def op11_lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return op11_lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lloyd_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds."""
    return op12_lloyd.report(*op12_lloyd.cluster(table(spark, sf_dir, "embeddings")))


def op13_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents by a lexicon learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return op13_toxicity.toxicity(docs, op13_toxicity.learn(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_tree": op1_chat_tree_query,
    "op2_decontaminate": op2_decontaminate_query,
    "op3_language": op3_language_query,
    "op4_token_files": op4_token_files_query,
    "op5_token_counts": op5_token_counts_query,
    "op6_lines": op6_lines_query,
    "op7_licenses": op7_licenses_query,
    "op8_mix": op8_mix_query,
    "op9_simhash": op9_simhash_query,
    "op10_quality_rules": op10_quality_query,
    "op11_lexical": op11_lexical_query,
    "op12_lloyd": op12_lloyd_query,
    "op13_toxicity": op13_toxicity_query,
}
ORACLE: dict[str, str] = {
    "op1_chat_tree": oracles.conversations_sql(),
    "op6_lines": oracles.lines_sql(),
    "op7_licenses": oracles.licenses_sql(),
    "op8_mix": oracles.mix_sql(),
    "op10_quality_rules": oracles.quality_sql(),
    "op11_lexical": oracles.search_sql(),
    "op12_lloyd": oracles.clusters_sql(),
}
