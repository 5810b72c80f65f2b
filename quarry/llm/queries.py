"""The queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents
from quarry.llm import language, lines, mixing, trie
from quarry.llm.alignment import align_tokens
from quarry.llm.fingerprints import edit_fingerprints, encoded, likeness
from quarry.llm.jaccard import jaccard_join
from quarry.llm.licenses import scan_licenses
from quarry.llm.packing import pack_documents
from quarry.llm.quality import held_out, score, train
from quarry.llm.sharding import assign_shards
from quarry.llm.substring import substring_dedup
from quarry.llm.tiff import media_features, text_media
from quarry.sources.tables import spread

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cut = lines.line_dedup(docs)
    return cut.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(text_media(documents(spark, sf_dir)))


def op5_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), "doc_id", SHARDS)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select(
        "doc_id",
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.round("_weight", 6).alias("weight"),
        F.round("_probability", 6).alias("probability"),
        F.col("_selected").alias("selected"),
    )


def op9_scaled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = edit_fingerprints(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded("sketch").alias("fingerprint"),
        encoded("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir), "doc_id")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("digest")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(spread(documents(spark, sf_dir), "doc_id"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_substring_dedup, op3_line_dedup, op4_tiff_media, op5_table_sharding, op6_license_scan, op7_quality_classifier, op8_source_mixing, op9_scaled_fingerprint, op10_best_fit_packing, op11_language_id, op12_conversation_trie, op13_token_alignment)}
ORACLES: dict[str, str] = {"op3_line_dedup": lines.ORACLE, "op8_source_mixing": mixing.oracle(), "op12_conversation_trie": trie.ORACLE}
