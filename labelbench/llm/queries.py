"""The registered queries of this subpackage, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import align, bestfit, chat, embdedup, lm, mixing, packing, quality, rules, sharding, simhash, substring, trie
from . import sql as S
from .common import crc_mod

QUALITY_AT = 0.3  # fixed by the contract


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    labels = read_table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    out = quality.score(docs, quality.train(docs, labels), carry=("held_out",))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"), "n_passages")


def op2_kneser_ney_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 10) == 0).alias("held_out"))
    return lm.score(docs, lm.train(docs.filter("not held_out")), carry=("held_out",))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op4_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document: 1 MiB of text at most, one document above it alone."""
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), limit_bytes=S.SHARD_BYTES)


def op5_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_chats(turns.unionByName(extra))
    back = out.withColumn("turns", chat.read_back(F.col("formatted"))) \
        .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", F.col("bad_turn").cast("bigint").alias("bad_turn"))


def op8_pca_tiled_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents")).drop("group")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, sf_dir, "documents"))


def aligned_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.token_alignment(read_table(spark, sf_dir, "documents"), *aligned_paths())[0].withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_hierarchical_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(read_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


QUERIES = {f.__name__: f for f in (
    op1_attention_quality, op2_kneser_ney_lm, op3_bm25_packing, op4_extendible_hash_shards, op5_super_kmer_dedup, op6_line_first_rules, op7_chat_format, op8_pca_tiled_dedup, op9_golay_simhash, op10_curriculum_mix,
    op11_token_alignment, op12_prefix_trie, op13_hierarchical_best_fit)}

SQL = {"op2_kneser_ney_lm": S.KNESER_NEY, "op4_extendible_hash_shards": S.SHARDS, "op5_super_kmer_dedup": S.SUBSTRING, "op6_line_first_rules": S.RULES, "op7_chat_format": S.CHAT, "op8_pca_tiled_dedup": S.EMBEDDINGS, "op10_curriculum_mix": S.MIX, "op12_prefix_trie": S.TRIE}
