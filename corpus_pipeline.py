"""A corpus pipeline of four stages: toxic documents go, poor ones go, one of each group of near copies stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept; run() writes each stage's
result as Parquet in the shared checkpoint folder and reads it again, so a lost executor never repeats earlier stages.

Odd rows: a null, empty or blank text scores like any text without words (it is neither toxic nor, by itself, poor), is
nobody's copy, and packs as the end token alone. A null doc_id has no label; such rows are told apart by their texts, as
are rows that share a doc_id. Rows that repeat doc_id and text are copies, of which near-dedup keeps one. Further columns,
whatever their names, go through all stages but packing, which gives its own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turfline.llm import minhash, packing, quality, toxicity
from turfline.llm.common import documents, labels, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality classifier", keep_good), ("minhash near-dedup", near_dedup), ("packing", pack)]

#: Trained models, hashing and a tokenizer aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Without documents every stage keeps none; without labels all stay until near-dedup."""
    place_of = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        place = f"{place_of}/{k}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
