"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.storage import cut, forget, shared_folder

__all__ = ["bound_batches", "cut", "documents", "forget", "labels", "likely", "marked", "sampled_texts", "shared_folder", "texts"]

#: Bytes of one Arrow batch: what a Python worker holds at a time follows from it, whatever the texts' lengths.
BATCH_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, never reach an operator."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bound_batches(spark: SparkSession) -> None:
    """Long texts make Arrow batches large; a bound in bytes holds for any of them. It is the session's setting, which is only ever lowered."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


_LEAST, _MOST = 1 << 24, 1 << 30  # slots of a bitmap: 2 to 128 MB
_EACH = 16  # slots for each id


def marked(rows: DataFrame, ids: DataFrame, column: str = "doc_id", own: str = "doc_id", mark: str = "__near") -> DataFrame:
    """rows with a boolean column: true for every row whose own number is in a column of ids, and for one in _EACH of the others at most.

    A bitmap of the ids is broadcast, as large as their count asks for; beyond _MOST slots there is none and every row is marked.
    ids is read twice. So what follows has to be exact, and shuffles little where ids are few.
    """
    slots = max(_LEAST, 1 << (_EACH * ids.count()).bit_length())
    if slots > _MOST:
        return rows.withColumn(mark, F.lit(True))
    slot = lambda c: F.pmod(F.coalesce(F.col(c), F.lit(-1)), F.lit(slots))
    bitmap = ids.groupBy(F.bitmap_bucket_number(slot(column)).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(column))).alias("__bits"))
    place = F.bitmap_bit_position(slot(own))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(slot(own)) == F.col("__bucket"), "left")
    return met.withColumn(mark, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits")


def likely(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose doc_id may be in a column of ids: all that are, and few others; see marked()."""
    return marked(rows, ids, column).where("__near").drop("__near")


def sampled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids, a bounded table of distinct doc_ids, with the text of each: of rows that share a doc_id the text of the least hash."""
    rows = texts(docs).join(F.broadcast(ids.select("doc_id")), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.join(F.broadcast(ids), "doc_id")
