"""Retail star tables seen as runners: an order is a race, its lines are runners. Once as DataFrames, once as SQL.

race: order key; track: the customer's nation; horse, jockey, trainer: part, supplier, brand; position: by extended price,
none where there is no discount. Stalls, classes, headgear, prices and days since the last run are unknown here and there. Races start every three minutes from noon, so some fall within the betting deadline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.operators import chrono, clean

GOINGS = ("Firm", "Good", "Good to Soft", "Soft", "Heavy", "Standard")
#: By line number and part; the last stands for nothing known.
HEADGEAR = ("None", "Blinkers", "Tongue Tie", "Cheek Pieces", "visor", "Hood", "first time Blinker", None)
ROW_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line, before duplicates go, dealt by race: lines meet their parts while they are narrow, then move once, by the key of all race windows. AQE picks the joins."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nations = t("nation").select("n_nationkey", "n_name")
    customers = t("customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    parts = t("part").select("p_partkey", "p_brand", "p_size")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").withColumn("race_id", F.col("l_orderkey").cast("string"))
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = lines.join(orders.withColumn("race_id", key.cast("string")), "race_id")
    return rows.select(
        "race_id",
        day.alias("race_date"),
        (F.datediff(day, F.lit("1970-01-01")) * F.lit(1440) + 720 + key % 160 * 3).cast("long").alias("race_minute"),
        F.col("n_name").alias("track"),
        F.col("l_partkey").cast("string").alias("horse"),
        F.col("l_suppkey").cast("string").alias("jockey"),
        F.col("p_brand").alias("trainer"),
        *ROW_ORDER,
        "l_discount",
        F.col("l_quantity").cast("double").alias("official_rating"),
        (112.0 + F.col("p_size")).alias("weight_lbs"),
        (2 + F.col("p_size") % 10).cast("int").alias("age"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linenumber").cast("int")).alias("stall"),
        F.when((key + F.col("l_linenumber")) % 9 != 0, F.substring("o_orderpriority", 1, 1).cast("int") + F.col("p_size") % 3).cast("int").alias("class"),
        F.element_at(F.array(*map(F.lit, GOINGS)), (key % 6 + 1).cast("int")).alias("going"),
        (1000.0 + key % 13 * 200).cast("double").alias("distance_m"),
        F.when(F.col("l_returnflag") == "A", "None").otherwise(F.element_at(F.array(*map(F.lit, HEADGEAR)), ((F.col("l_linenumber") + F.col("l_partkey")) % 8 + 1).cast("int"))).alias("headgear"),
        F.when((F.col("l_tax") != 0) & (key % 7 != 0), 1.0 + 100.0 * F.col("l_tax")).alias("forecasted_odds"),
        F.when(F.col("l_partkey") % 7 != 0, ((F.col("l_partkey") * 13 + key) % 120).cast("int")).alias("days_since_last_time_out"),
        F.when(F.col("o_orderstatus") == "F", "Maiden Stakes").when(F.col("o_orderstatus") == "O", "Handicap Hurdle").otherwise("Novice").alias("type"),
    )


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners with positions and targets; of a horse's rows in a race the first stays."""
    first = Window.partitionBy("race_id", "horse").orderBy(*ROW_ORDER)
    kept = entries(spark, sf_dir).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    race = Window.partitionBy("race_id")
    place = F.row_number().over(race.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"))
    number = F.row_number().over(race.orderBy(*ROW_ORDER))
    field = F.count("horse").over(race)
    out = kept.withColumns({"pos": F.when(F.col("l_discount") != 0, place.cast("double")), "row_no": number.cast("int"), "runners": field.cast("int")})
    moment = F.col("race_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("race_minute") % 1440).cast("int"))
    out = clean.with_target(out).withColumns({"course": F.col("track"), "race_datetime": moment.cast("timestamp_ntz"), "date_of_race": F.col("race_date").cast("timestamp_ntz")})
    return chrono.with_places(out).drop(*ROW_ORDER, "l_discount", "_k")


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as raw cards of text: odd column names, dates in three forms, bad dates and times, non-finishers, odds that aren't numbers, weights in stones."""
    key, day = F.col("race_id").cast("long"), F.col("race_date")
    minute = F.col("race_minute") % 1440
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    text = lambda c: F.col(c).cast("string")
    return entries(spark, sf_dir).select(
        F.when(key % 17 == 0, "bad").when(key % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd MMM yyyy")).alias("Date of Race!"),
        F.when(key % 23 == 0, "xx").when(key % 19 != 0, F.concat(two(minute / 60), F.lit(":"), two(minute % 60))).alias(" Time"),
        F.col("track").alias("Track"),
        F.col("horse").alias("Horse"),
        F.col("type").alias("Type"),
        F.when(F.col("l_discount") == 0, "PU").otherwise(text("l_linenumber")).alias("Pos"),
        F.when(F.col("l_linenumber") % 5 == 0, "SCRATCHED").when(F.col("l_linenumber") % 5 == 1, " - ").when(F.col("l_linenumber") % 5 == 2, "evens").otherwise(text("l_suppkey")).alias("Forecasted (Odds)"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat((F.col("l_partkey") % 10 + 5).cast("string"), F.lit("-"), (F.col("l_partkey") % 14).cast("string"))).when(F.col("l_partkey") % 3 == 1, text("l_partkey")).otherwise("x").alias("Weight"),
        F.when(key % 4 != 0, (key % 20).cast("string")).alias("Distance f"),
        F.when(key % 4 != 1, (key % 100).cast("string")).alias("Rate %"),
        F.col("l_linenumber").cast("int").alias("file_idx"),
        (key * 100_000_000 + F.col("l_suppkey") * 1000 + F.floor(F.col("l_extendedprice") * 100).cast("long") % 1000).alias("row_idx"),
    )


_GOING_LIST = ", ".join(f"'{g}'" for g in GOINGS)
_GEAR_LIST = ", ".join(f"'{g}'" if g else "NULL" for g in HEADGEAR)
#: WITH clause that gives `entries` and `runners`; queries go on after it.
SQL = f"""WITH entries AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS race_id, CAST(o_orderdate AS DATE) AS race_date,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 1440 + 720 + o_orderkey % 160 * 3 AS BIGINT) AS race_minute,
         n_name AS track, CAST(l_partkey AS VARCHAR) AS horse, CAST(l_suppkey AS VARCHAR) AS jockey, p_brand AS trainer,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, CAST(l_quantity AS DOUBLE) AS official_rating, CAST(112 + p_size AS DOUBLE) AS weight_lbs,
         CAST(2 + p_size % 10 AS INT) AS age, CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_linenumber AS INT) END AS stall,
         CASE WHEN (o_orderkey + l_linenumber) % 9 <> 0 THEN CAST(CAST(o_orderpriority[1] AS INT) + p_size % 3 AS INT) END AS class,
         [{_GOING_LIST}][CAST(o_orderkey % 6 + 1 AS INT)] AS going, CAST(1000 + o_orderkey % 13 * 200 AS DOUBLE) AS distance_m,
         CASE WHEN l_returnflag = 'A' THEN 'None' ELSE [{_GEAR_LIST}][CAST((l_linenumber + l_partkey) % 8 + 1 AS INT)] END AS headgear,
         CASE WHEN l_tax <> 0 AND o_orderkey % 7 <> 0 THEN 1.0::DOUBLE + 100.0::DOUBLE * l_tax END AS forecasted_odds,
         CASE WHEN l_partkey % 7 <> 0 THEN CAST((l_partkey * 13 + o_orderkey) % 120 AS INT) END AS days_since_last_time_out,
         CASE o_orderstatus WHEN 'F' THEN 'Maiden Stakes' WHEN 'O' THEN 'Handicap Hurdle' ELSE 'Novice' END AS type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
), first_rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id, horse ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM entries) WHERE k = 1
), placed_rows AS (
  SELECT *, CASE WHEN l_discount <> 0 THEN CAST(row_number() OVER (PARTITION BY race_id ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS DOUBLE) END AS pos,
         CAST(row_number() OVER (PARTITION BY race_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS row_no, CAST(count(horse) OVER (PARTITION BY race_id) AS INT) AS runners
  FROM first_rows
), paid_rows AS (
  SELECT *, CASE WHEN runners >= 8 THEN 3 WHEN runners >= 5 THEN 2 ELSE 0 END AS num_places, CAST(coalesce(pos = 1, false) AS INT) AS won FROM placed_rows
), runners AS (
  SELECT *, CAST(won = 1 OR coalesce(pos <= num_places AND pos < 99, false) AS INT) AS placed, track AS course FROM paid_rows
)"""
