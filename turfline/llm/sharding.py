"""Rendezvous hashing of records over weighted shards, and gapless slots in each shard. DataFrame functions only.

Every shard draws an exponential variate from a hash of the key and its own number, divided by its weight; the least
wins. One more shard only wins keys for itself, so no record moves between the others.

Scale: a record is a small row (its text stays where it is). Equal rows are counted before anything else and come
back at the end, so a key that repeats is one row meanwhile. Slots follow from a range partitioning by (shard, key):
each partition numbers its own rows, and sums over partitions, a row for each, say where it begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.common import cut

SHARDS = 24
_BLOCK = 10_000  # copies of one row that come back from one row


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that a key goes to. A null key counts as a key of its own."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    shards = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights)])

    def draw(shard: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), shard["shard"].cast("string"))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / F.lit(float(1 << 52))) / shard["weight"]).alias("draw"), shard["shard"].alias("shard"))

    return F.array_min(F.transform(shards, draw))["shard"]


def place(rows: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """rows with shard, slot and grown_shard: where weights put a row, its number there, where the longer list `grown` puts it.

    Slots are gapless from 0 and follow the order of the key (null first) and then of the other columns, which must be
    orderable. Rows that repeat get a slot each. An empty table gives an empty table. Columns named shard, slot or
    grown_shard are replaced; names that begin with __ are the operator's own.
    """
    rows = rows.drop("shard", "slot", "grown_shard")
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__copies"))
    placed = counted.select("*", rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), grown).alias("grown_shard"))
    order = ["shard", key, *[c for c in columns if c != key]]
    dealt = cut(placed.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part", "shard").agg(F.sum("__copies").alias("__rows"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", "shard", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", "shard").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__before") + F.coalesce(F.sum("__copies").over(inside), F.lit(0))
    numbered = dealt.join(parts, ["__part", "shard"]).select(*columns, "shard", "grown_shard", "__copies", first.alias("__first"))
    copies = F.col("__copies")
    blocks = numbered.select("*", F.explode(F.sequence(F.lit(0), copies - 1, F.lit(_BLOCK))).alias("__block"))
    each = F.sequence(F.col("__block"), F.least(F.col("__block") + _BLOCK, copies) - 1)
    return blocks.select("*", F.explode(each).alias("__copy")).select(*columns, "shard", (F.col("__first") + F.col("__copy")).alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs, by the law `key`.

    size: the text's UTF-8 bytes, none for a null, and 8. text_crc32: of these bytes. grown_shard: with one more shard
    of the mean weight. Other columns of docs are ignored.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(rows, "doc_id", weights, [*weights, sum(weights) / len(weights)])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents
),
summed AS (
  SELECT doc_id, size, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) AS text_crc32
  FROM sized, crc_table
),
keys AS (SELECT DISTINCT doc_id FROM documents),
draws AS (
  SELECT k.doc_id, s.shard, -ln((CAST('0x' || substr(md5(coalesce(CAST(k.doc_id AS VARCHAR), 'null') || ':' || CAST(s.shard AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS draw
  FROM keys k, (SELECT unnest(range(25)) AS shard) s
),
placed AS (
  SELECT doc_id, CAST(first(shard ORDER BY draw, shard) FILTER (WHERE shard < 24) AS INT) AS shard, CAST(first(shard ORDER BY draw, shard) AS INT) AS grown_shard
  FROM draws GROUP BY doc_id
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id NULLS FIRST, s.size, s.text_crc32) - 1 AS slot, p.grown_shard
FROM summed s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""
