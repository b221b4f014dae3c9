"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm import alignment, bpe, fingerprints, minhash, packing, quality, rules, sharding, simhash, toxicity, urls, warc, whitening
from turfline.llm.common import documents, labels


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    line = F.array_join(F.filter(entries, lambda x: ~F.startswith(x, F.lit("last-modified="))), " ")
    return resolved.select("record_id", "canonical_url", "ts", "response_id", "response_ts", "outcome", line.alias("header_line"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("long").alias("n_segments"))


def op8_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprint(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op9_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


_ALL = (
    op1_minhash_near_dedup, op2_harmonic_packing, op3_warc_revisits, op4_rendezvous_sharding, op5_site_quality,
    op6_bpe_merge_replay, op7_toxic_segments, op8_improbable_features, op9_ngram_quality_rules, op10_url_rules,
    op11_token_alignment, op12_embedding_whitening, op13_simhash_ball,
)
QUERIES = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {"op3_warc_revisits": warc.SQL, "op4_rendezvous_sharding": sharding.SQL, "op10_url_rules": urls.SQL}
