"""Raw cards to typed runners: names, duplicates, times, race types, targets, odds; checks, profile and schema report."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline import config as C

DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy", "yyyy-MM-dd HH:mm:ss")
TIME_FORMATS = ("HH:mm", "HH:mm:ss", "H:mm")


def standard_name(name: str) -> str:
    """Letters, digits, spaces and % stay; % becomes pct and a space an underscore; lower case."""
    return re.sub(r"[^A-Za-z0-9\s%]", "", name).strip().replace("%", "pct").replace(" ", "_").lower()


def standardize_names(df: DataFrame, leave: Sequence[str] = ("file_idx", "row_idx")) -> DataFrame:
    return df.toDF(*[c if c in leave else standard_name(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order; null keys are equal. Keys that df lacks don't count; without any, df stays."""
    present = [k for k in keys if k in df.columns]
    if not present:
        return df
    place = F.row_number().over(Window.partitionBy(*present).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def with_times(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Typed date_of_race and race_datetime; rows without a date, a time or their combination go."""
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(F.col("date_of_race").cast("string")), F.lit(f))) for f in formats])
    df = df.withColumn("_day", day).where("_day is not null and time is not null")
    moment = F.concat_ws(" ", F.date_format("_day", "yyyy-MM-dd"), F.trim("time"))
    when = F.coalesce(*[F.try_to_timestamp(moment, F.lit(f"yyyy-MM-dd {t}")) for t in TIME_FORMATS])
    return df.withColumns({"date_of_race": F.col("_day").cast("timestamp_ntz"), "race_datetime": when.cast("timestamp_ntz")}).drop("_day").where("race_datetime is not null")


def race_id(date: Column, track: Column, time: Column) -> Column:
    """yyyy-MM-dd_TRACK_time; a missing track reads NAN."""
    return F.concat_ws("_", F.date_format(date, "yyyy-MM-dd"), F.coalesce(F.upper(F.trim(track)), F.lit("NAN")), F.trim(time))


def race_type(text: Column) -> Column:
    """Jumps if a jump word occurs, else Flat if a flat word does, else Unknown."""
    low = F.lower(F.trim(text))
    any_of = lambda words: F.coalesce(low.rlike("|".join(map(re.escape, words))), F.lit(False))
    return F.when(any_of(C.JUMP_WORDS), "Jumps").when(any_of(C.FLAT_WORDS), "Flat").otherwise("Unknown")


def number(text: Column) -> Column:
    """A double, null where the text isn't one; NaN counts as null."""
    x = text.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def odds(text: Column) -> Column:
    return F.when(~F.trim(text.cast("string")).isin(*C.ODDS_SENTINELS), number(text))


def position_of(columns: Sequence[str], required: bool = True) -> Column | None:
    """From the first position column; else 1 or 99 from the first winner column. Raises ValueError if required and neither is there."""
    for c in C.POSITION_COLUMNS:
        if c in columns:
            return number(F.col(c))
    for c in C.WINNER_COLUMNS:
        if c in columns:
            text = F.col(c).cast("string")
            return F.when(F.coalesce(text.isin(*C.WINNER_TRUE), F.lit(False)), F.lit(1.0)).otherwise(F.lit(99.0))
    if required:
        raise ValueError(f"no column tells positions or winners; expected one of {C.POSITION_COLUMNS + C.WINNER_COLUMNS}")
    return None


def with_target(df: DataFrame, scoring: bool = False) -> DataFrame:
    """pos (double) and won (0 or 1). When scoring, cards without results get null pos and won 0."""
    pos = position_of(df.columns, required=not scoring)
    pos = F.lit(None).cast("double") if pos is None else pos
    return df.withColumn("pos", pos).withColumn("won", F.coalesce(F.col("pos") == 1, F.lit(False)).cast("int"))


def weight_lbs(text: Column) -> Column:
    """'11-7' is 11 stone 7; a number is pounds; else null."""
    t = F.trim(text.cast("string"))
    part = lambda k: F.try_element_at(F.split(t, "-"), F.lit(k)).try_cast("double")
    return F.when(t.rlike(r"^\d+-\d+$"), part(1) * 14 + part(2)).otherwise(number(t))


#: Columns of raw cards that hold numbers, and whole ones.
NUMBERS = ("official_rating", "days_since_last_time_out", "betfair_sp", "industry_sp", "sp_fav", "distance_f", "distance_m", "weight_lbs")
WHOLE = ("age", "class", "stall", "runners")


def prepare_inputs(df: DataFrame, default_distance: float | None = 2000.0) -> DataFrame:
    """weight_lbs, distance_m and course where they can be told from weight, distance_f and track; numbers typed where they are text."""
    made: dict[str, Column] = {c: number(F.col(c)) if c in NUMBERS else number(F.col(c)).cast("int") for c, t in df.dtypes if t == "string" and c in NUMBERS + WHOLE}
    if "weight_lbs" not in df.columns and "weight" in df.columns:
        made["weight_lbs"] = weight_lbs(F.col("weight"))
    if "distance_m" not in df.columns:
        metres = number(F.col("distance_f")) * 201.168 if "distance_f" in df.columns else F.lit(None).cast("double")
        made["distance_m"] = metres if default_distance is None else F.coalesce(metres, F.lit(default_distance))
    if "course" not in df.columns and "track" in df.columns:
        made["course"] = F.col("track")
    return df.withColumns(made) if made else df


def clean(raw: DataFrame, scoring: bool = False) -> DataFrame:
    """All steps from raw cards with standard names to runners, duplicates of (date, time, track, horse) gone, the first kept."""
    order = [c for c in ("file_idx", "row_idx") if c in raw.columns] or [F.lit(0)]
    df = with_times(keep_first(raw, ["date_of_race", "time", "track", "horse"], order))
    if "track" not in df.columns:
        raise ValueError("cards need a track")
    more = {"race_id": race_id(F.col("date_of_race"), F.col("track"), F.col("time"))}
    if "type" in df.columns:
        more["race_category"] = race_type(F.col("type"))
    if "forecasted_odds" in df.columns:
        more["forecasted_odds"] = odds(F.col("forecasted_odds"))
    return with_target(df.withColumns(more), scoring)


def duplicate_runners(df: DataFrame) -> DataFrame:
    """(race_id, horse) pairs that occur more than once, with their counts."""
    return df.groupBy("race_id", "horse").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def out_of_order(df: DataFrame, order: Sequence[str] = ("file_idx", "row_idx")) -> int:
    """How many rows have an earlier race_datetime than the row before, in an order within each file."""
    first, rest = order[0], order[1:]
    return df.withColumn("_before", F.lag("race_datetime").over(Window.partitionBy(first).orderBy(*rest))).where("race_datetime < _before").count()


def validate(df: DataFrame, earliest: str = "2000-01-01") -> dict[str, object]:
    """Raises ValueError on nulls in critical columns, targets outside 0 and 1, or no winner; returns warnings and counts."""
    critical = [c for c in ("race_id", "race_datetime", "horse", "won") if c in df.columns]
    x = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in critical],
        F.count_if(~F.col("won").isin(0, 1)).alias("odd_targets"),
        F.coalesce(F.sum("won"), F.lit(0)).alias("winners"),
        F.count_if(F.col("race_datetime") < F.lit(earliest).cast("timestamp_ntz")).alias("too_early"),
        F.count("*").alias("rows"),
        *([F.avg("runners").alias("field")] if "runners" in df.columns else [F.lit(None).cast("double").alias("field")]),
    ).first()
    bad = [c for c in critical if x[f"null_{c}"]]
    if bad:
        raise ValueError(f"nulls in critical columns: {bad}")
    if x.odd_targets:
        raise ValueError("won has values other than 0 and 1")
    if not x.winners:
        raise ValueError("no winner")
    rate, expected = 100 * x.winners / x.rows, 100 / x.field if x.field else None
    doubled = duplicate_runners(df).count()
    warnings = [w for w, on in (("early dates", x.too_early), ("duplicate runners", doubled), ("win rate differs from field sizes", expected is not None and abs(rate - expected) > 2)) if on]
    return {"rows": x.rows, "winners": x.winners, "win_rate": rate, "expected_win_rate": expected, "duplicate_runners": doubled, "warnings": warnings}


def win_rates(df: DataFrame) -> DataFrame:
    """One row: the percent of runners that won, and what field sizes would make of it."""
    return df.agg((100.0 * F.avg("won")).alias("win_rate_pct"), (100.0 / F.avg("runners")).alias("expected_pct"))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, races, horses, tracks, first and last day, winners and win rate in percent."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("race_id").alias("n_races"),
        F.countDistinct("horse").alias("n_horses"),
        F.countDistinct("track").alias("n_tracks"),
        F.min("race_datetime").alias("first_race"),
        F.max("race_datetime").alias("last_race"),
        F.sum("won").cast("long").alias("n_winners"),
        (100.0 * F.avg("won")).alias("win_rate_pct"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent of each value, in one pass; the window holds a row for each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("pct", 100.0 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """k and n_distinct for each column, by its place from 0; nulls don't count, and a column without values has no row.

    Pairs of column and value, as 96 bits of hash, are made distinct in each task and then over all tasks: no column has a
    branch of its own, however many there are. approximate: mergeable sketches in one pass, good to about 1 %.
    """
    value = lambda c, t: F.col(c) + F.lit(0.0).cast(t) if t in ("double", "float") else F.col(c)  # noqa: E731 - one zero for both signs
    if approximate:
        sketch = lambda c, t: F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(value(c, t))), F.lit(14)))
        row = df.agg(*[sketch(c, t).alias(f"d{k}") for k, (c, t) in enumerate(df.dtypes)])
        return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("n_distinct")) for k in range(len(df.columns))])))
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.xxhash64(value(c, t)).alias("a"), F.hash(value(c, t)).alias("b"))) for k, (c, t) in enumerate(df.dtypes)]
    return df.select(F.explode(F.array(*pairs)).alias("p")).where("p is not null").select("p.*").distinct().groupBy("k").agg(F.count("*").alias("n_distinct"))


def schema_report(df: DataFrame, approximate: bool = False) -> DataFrame:
    """A row for each column: its type, nulls, percent of nulls (2 places) and distinct values; see distinct_counts()."""
    kinds = dict(df.dtypes)
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"n{k}") for k, c in enumerate(df.columns)])
    lines = [
        F.struct(
            F.lit(k).alias("k"),
            F.lit(c).alias("column_name"),
            F.lit(kinds[c]).alias("data_type"),
            F.col(f"n{k}").alias("n_null"),
            F.coalesce(F.round(F.try_divide(100.0 * F.col(f"n{k}"), F.col("_n")), 2), F.lit(0.0)).alias("null_pct"),
        )
        for k, c in enumerate(df.columns)
    ]
    return row.select(F.inline(F.array(*lines))).join(distinct_counts(df, approximate), "k", "left").select("column_name", "data_type", "n_null", "null_pct", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def missing_over(df: DataFrame, percent: float = 10.0) -> DataFrame:
    """Columns with more than so many percent of nulls, the worst first."""
    return schema_report(df).where(F.col("null_pct") > percent).orderBy(F.desc("null_pct"), "column_name")


def column_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by the part of their names before the first underscore."""
    out: dict[str, list[str]] = {}
    for c in sorted(columns):
        out.setdefault(c.split("_")[0], []).append(c)
    return out


def drop_leakage(df: DataFrame, parts: Sequence[str] = C.LEAKAGE_PARTS, names: Sequence[str] = C.LEAKAGE_NAMES, strict: bool = False) -> DataFrame:
    """Without columns that tell results; infinite numbers become null. strict: raises on nulls in ids and on infinities instead."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    infinite = lambda c: F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)) | F.isnan(c)
    if strict:
        critical = [c for c in ("race_id", "date_of_race", "horse", "won") if c in df.columns]
        x = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in critical], *[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"inf_{c}") for c in numbers]).first()
        bad = [c for c, n in x.asDict().items() if n]
        if bad:
            raise ValueError(f"nulls or infinities: {bad}")
    leaky = [c for c in df.columns if any(p in c.lower() for p in parts) or c.lower() in names]
    return df.drop(*leaky).select(*[F.when(~infinite(c), F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns if c not in leaky])


#: Parts of names that look like results; the detector only reports. Fixed values.
SUSPICIOUS_PARTS = (
    "winning_distance", "sp_win_return", "ew_return", "betfair_win_return", "place_return", "betfair_lay_return", "ip_min", "ip_max", "final", "result",
    "actual", "outcome", "betfair_sp", "industry_sp",
)


def suspicious_names(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in SUSPICIOUS_PARTS)]


MISSING = -999.0  # what a model reads for an unknown number


def model_inputs(df: DataFrame, columns: Sequence[str], categorical: Sequence[str], prefix: str = "") -> DataFrame:
    """df with prefix + name for each of the columns: categories as text with 'missing' for null, everything else as numbers with MISSING; absent columns are unknown."""
    of = lambda c: F.col(c) if c in df.columns else F.lit(None)
    kinds = dict(df.dtypes)
    value = lambda c: number(of(c)) if kinds.get(c) == "string" else of(c).cast("double")
    return df.withColumns({f"{prefix}{c}": F.coalesce(of(c).cast("string"), F.lit("missing")) if c in categorical else F.coalesce(value(c), F.lit(MISSING)) for c in columns})
