"""Point-in-time histories: for each runner, what was known of its horse, jockey or trainer before betting closed.

An entity's records are numbered in the order of races. A runner sees the last N records that were filed in earlier
races, those of its own race never, less those at or after its deadline: such records aren't seen but take a place. So
what a runner sees is one range of numbers, and counts over it are differences of running sums; only features that need
the records themselves collect them.

Scale: rows move once, to their entity, whose windows follow its past in order. Entities of more rows than a chunk holds
go another way: numbering uses counts by (entity, day) and numbers within a day, and frames run over chunks of the
entity's rows, each with the last records of the chunk before as context. So no window holds more than a chunk, an entity
with a third of all rows is split like any other, and what a runner collects is bounded by N. Counts of entities come
from a pass over `counted`, so that should be stored or cheap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.config import HistoryConfig
from turfline.functions.storage import store

ORDER = ("race_datetime", "race_id", "row_no")
SLOTS = 1 << 16  # that keys are counted in before any is counted by itself
_HELPERS = ("_key", "_seq", "_first", "_place")


def seconds(moment: Column) -> Column:
    """Seconds since 1970 of a timestamp's own clock, whatever the zone."""
    return day(moment).cast("long") * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def day(moment: Column) -> Column:
    return F.datediff(F.to_date(moment), F.lit("1970-01-01"))


def eligible(df: DataFrame) -> DataFrame:
    """Rows of races with two runners at least; others leave no trace."""
    return df.withColumn("_size", F.count("*").over(Window.partitionBy("race_id"))).where("_size >= 2").drop("_size")


def record(fields: Sequence[str]) -> Column:
    """What is filed of a run: when, and the fields wanted. A missing position is 99; headgear None; won and placed are truths."""
    made: Mapping[str, Column] = {"day": day(F.col("race_datetime")), "position": F.coalesce(F.col("pos"), F.lit(99.0)), "won": F.col("won") == 1, "placed": F.col("placed") == 1}
    return F.struct(seconds(F.col("race_datetime")).alias("at"), *[made.get(f, F.col(f)).alias(f) if f in made else F.col(f) for f in fields])


def _keyed(df: DataFrame, entity: str, key: Column | None) -> DataFrame:
    """df with _key, the entity or what key makes of it. Rows without a key go."""
    return df.withColumn("_key", F.col(entity) if key is None else key).where("_key is not null")


def _parted(df: DataFrame, counted: DataFrame, size: int) -> tuple[DataFrame | None, DataFrame | None]:
    """df's rows of keys that have at most `size` rows in counted, and those of the others; None for none.

    Keys are counted in slots first, which shuffles some numbers from each task: no key of a slot with few rows has many.
    """
    slot = F.pmod(F.xxhash64("_key"), F.lit(SLOTS)).alias("_slot")
    slots = counted.groupBy(slot).agg(F.count("*").alias("n")).collect()  # SLOTS numbers at most
    full = [(x["_slot"],) for x in slots if x["n"] > size]
    if not full:
        return df, None
    keys = counted.select("_key", slot).join(F.broadcast(df.sparkSession.createDataFrame(full, "_slot long")), "_slot", "left_semi").groupBy("_key").agg(F.count("*").alias("n"))
    large = store(keys.where(F.col("n") > size))
    n = large.agg(F.sum("n")).first()[0]
    if n is None:
        return df, None
    large = F.broadcast(large.select("_key"))  # few, as each stands for more than `size` rows
    return None if n == sum(x["n"] for x in slots) else df.join(large, "_key", "left_anti"), df.join(large, "_key", "left_semi")


def _by_day(rows: DataFrame) -> DataFrame:
    """Numbered rows of keys too large for one window."""
    rows = rows.withColumn("_day", F.to_date("race_datetime"))
    counts = rows.groupBy("_key", "_day").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_key").alias("_e"), F.col("_day").alias("_d"), before.alias("_before"))
    inside = Window.partitionBy("_key", "_day")
    rows = rows.withColumns({"_inside": F.row_number().over(inside.orderBy(*ORDER)), "_race": F.rank().over(inside.orderBy(*ORDER[:2]))})
    joined = rows.join(starts, (F.col("_key") == F.col("_e")) & (F.col("_day") == F.col("_d")))
    return joined.withColumns({"_seq": F.col("_before") + F.col("_inside"), "_first": F.col("_before") + F.col("_race")}).drop("_e", "_d", "_before", "_inside", "_race", "_day")


def _at_once(rows: DataFrame) -> DataFrame:
    """The same of keys that a window holds."""
    own = Window.partitionBy("_key")
    return rows.withColumns({"_seq": F.row_number().over(own.orderBy(*ORDER)).cast("long"), "_first": F.rank().over(own.orderBy(*ORDER[:2])).cast("long")})


def numbered(df: DataFrame, entity: str, key: Column | None = None, config: HistoryConfig = HistoryConfig(), counted: DataFrame | None = None) -> DataFrame:
    """df with _key, the entity (or what key makes of it), _seq, the number of each row among its key's rows in order, and _first, that of its race's first row.

    Rows without a key go. counted: rows with the same keys as df that are cheaper to read.
    """
    whole, large = _parted(rows := _keyed(df, entity, key), rows if counted is None else _keyed(counted, entity, key), config.chunk_rows)
    return reduce(DataFrame.unionByName, [f(x) for f, x in ((_at_once, whole), (_by_day, large)) if x is not None])


def _spread(rows: DataFrame, keep: int, config: HistoryConfig) -> DataFrame:
    """Numbered rows with _place (chunk, own): all rows of a race in one chunk of their key, and copies (own false) where races of a later chunk see them."""
    size = max(config.chunk_rows, keep)
    chunk = lambda n: F.floor(n / size)
    own = chunk(F.col("_first") - 1)
    chunks = F.array_distinct(F.array(own, chunk(F.col("_seq")), chunk(F.col("_seq") + (keep - 1))))
    return rows.withColumn("_chunk", F.explode(chunks)).withColumn("_place", F.struct(F.col("_chunk").alias("chunk"), (F.col("_chunk") == own).alias("own"))).drop("_chunk")


@dataclass(frozen=True)
class _Layout:
    """Rows whose windows go by `by`, in `order`; those of a race by `race`."""

    rows: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    race: tuple[str, ...]


def _layouts(df: DataFrame, entity: str, keep: int, config: HistoryConfig, key: Column | None, counted: DataFrame | None) -> list[_Layout]:
    whole, large = _parted(rows := _keyed(df, entity, key), rows if counted is None else _keyed(counted, entity, key), max(config.chunk_rows, keep))
    out = []
    if whole is not None:
        out.append(_Layout(whole.withColumn("_place", F.struct(F.lit(True).alias("own"))), ("_key",), ORDER, ("_key", *ORDER[:2])))
    if large is not None:
        by = ("_key", "_place.chunk")
        out.append(_Layout(_spread(_by_day(large), keep, config), by, ("_first", "_seq"), (*by, "_first")))
    return out


def with_history(df: DataFrame, entity: str, keep: int, fields: Sequence[str], name: str, config: HistoryConfig = HistoryConfig(), key: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """df's rows that have the entity (or what key makes of it), with `name`: the array of records that each sees, oldest first. counted: rows with the same keys that are cheaper to read."""
    return reduce(DataFrame.unionByName, [_seen(x, keep, fields, name, config) for x in _layouts(df, entity, keep, config, key, counted)])


def _seen(x: _Layout, keep: int, fields: Sequence[str], name: str, config: HistoryConfig) -> DataFrame:
    last = F.collect_list(record(fields)).over(Window.partitionBy(*x.by).orderBy(*x.order).rowsBetween(-keep, -1))
    race = Window.partitionBy(*x.race).orderBy(x.order[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = x.rows.withColumn("_last", last).withColumn("_seen", F.first("_last").over(race)).where("_place.own")  # as the race's first row has it
    seen = F.col("_seen")
    if config.deadline_minutes is not None:
        deadline = seconds(F.col("race_datetime")) - 60 * config.deadline_minutes
        seen = F.slice(seen, F.lit(1), F.size(F.filter(seen["at"], lambda at: at < deadline)))
    return out.withColumn(name, seen).drop("_seen", "_last", *_HELPERS)


def with_counts(df: DataFrame, entity: str, keep: int, within_days: Sequence[int], config: HistoryConfig = HistoryConfig(), key: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """df's rows that have the entity (or what key makes of it), with `_seen_<days>`: n, won and placed of the records that each sees of so many days. counted: as in with_history()."""
    if config.deadline_minutes is not None and config.deadline_minutes < 0:
        raise ValueError("a deadline after the race")
    return reduce(DataFrame.unionByName, [_counts(x, keep, within_days, config.deadline_minutes) for x in _layouts(df, entity, keep, config, key, counted)])


def _counts(x: _Layout, keep: int, within_days: Sequence[int], deadline: int | None) -> DataFrame:
    chunk = Window.partitionBy(*x.by)
    order = chunk.orderBy(*x.order)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    won, placed = (F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)) for c in ("won", "placed"))
    sums = F.struct(F.count("*").over(so_far).alias("n"), F.sum(won).over(so_far).alias("won"), F.sum(placed).over(so_far).alias("placed"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "won", "placed")])
    rows = x.rows if "_first" in x.rows.columns else x.rows.withColumn("_first", F.rank().over(chunk.orderBy(*ORDER[:2])).cast("long"))
    rows = rows.withColumns({"_at": seconds(F.col("race_datetime")), "_on": day(F.col("race_datetime")), "_sums": sums})
    upto = lambda by, n: F.coalesce(F.max("_sums").over(chunk.orderBy(by).rangeBetween(Window.unboundedPreceding, -n)), none)
    rows = rows.withColumns({
        "_evicted": F.coalesce(F.lag("_sums", keep + 1).over(order), none),
        "_upto": upto("_first", 1) if deadline is None else upto("_at", 60 * deadline + 1),
        **{f"_before_{d}": upto("_on", d + 1) for d in within_days},
    })
    race = Window.partitionBy(*x.race).orderBy(x.order[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_evicted", F.first("_evicted").over(race)).where("_place.own")
    made = {}
    for d in within_days:
        low, high = F.greatest("_evicted", f"_before_{d}"), F.col("_upto")
        made[f"_seen_{d}"] = F.when(high["n"] > low["n"], F.struct(*[(high[c] - low[c]).alias(c) for c in ("n", "won", "placed")])).otherwise(none)
    return rows.withColumns(made).drop("_sums", "_evicted", "_upto", "_at", "_on", *[f"_before_{d}" for d in within_days], *_HELPERS)
