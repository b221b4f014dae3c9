"""Chronological features of a runner from its histories, by array expressions. Names and defaults are fixed by the domain.

Each group is a function from nothing to {name: Column} over a row with `hist` (the horse's records, oldest first), arrays
made from it, or counts of a jockey's or trainer's records, and the runner's own columns. A first-timer, whose `hist` is
empty, gets the group's defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline import config as C
from turfline.functions import arrays as A
from turfline.functions.storage import store
from turfline.operators import elo as E
from turfline.operators import history as H

#: The fields of a record that each group of horse features reads.
FIELDS: dict[str, tuple[str, ...]] = {
    "form": ("position", "won", "placed"), "streaks": ("position", "won", "placed"), "rating_trend": ("official_rating",), "class_movement": ("class",),
    "recency": ("day", "won", "placed", "headgear"), "specialisation": ("position", "won", "placed", "going", "distance_m", "course"), "momentum": ("position",),
    "combinations": ("won", "placed", "jockey", "trainer"),
}
DAYS = (14, 30, 90)
D = C.FeatureConfig().default_position
_hist = lambda: F.col("hist")
_new = lambda: F.size("hist") == 0
_last = lambda name: F.try_element_at("hist", F.lit(-1))[name]
_flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
_true = lambda v: v


def _or(default: Column, x: Column) -> Column:
    return F.when(_new(), default).otherwise(x)


def finishers(x: Column) -> Column:
    """The positions of finishers."""
    return F.filter(x, lambda p: p < 99)


def _runs_since(passed: Column) -> Column:
    """Records after the latest that passes; all if none does."""
    at = F.array_position(F.reverse(F.transform(passed, lambda v: F.coalesce(v, F.lit(False)))), F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size("hist")).cast("long")


def _shared(groups: Sequence[str]) -> list[dict[str, Column]]:
    """Arrays that several features read, in steps: each is made once for a row."""
    have = {f for g in groups for f in FIELDS[g]}
    first = {f"_{f}": _hist()[f] for f in ("position", "won", "placed", "official_rating") if f in have}
    second: dict[str, Column] = {}
    if "form" in groups or "momentum" in groups:
        ends = lambda k: A.last(F.col("_position"), k)
        second |= {f"_last_{k}": finishers(ends(k)) for k in (3, 5, 10, 15)}
        second |= {f"_older_{k}": finishers(F.when(F.size("hist") >= 2 * k, F.slice("_position", -2 * k, k))) for k in (3, 5)}
    if "rating_trend" in groups:
        second["_rated_5"] = A.last(F.col("_official_rating"), 5)
    if "class_movement" in groups:
        second["_class_5"] = F.filter(F.transform(A.last(_hist()["class"], 5), lambda c: c.cast("double")), lambda c: c.isNotNull())
    if "specialisation" in groups:
        second["_surface"] = F.filter("hist", lambda r: r["going"] == F.col("going"))
        second["_distance"] = F.filter("hist", lambda r: F.abs(r["distance_m"] - F.col("distance_m")) < C.FeatureConfig().similar_distance_m)
        second["_course"] = F.filter("hist", lambda r: r["course"] == F.col("course"))
    third = {f"{x}_places": finishers(F.col(x)["position"]) for x in ("_surface", "_distance", "_course") if x in second}
    return [x for x in (first, second, third) if x]


def form() -> dict[str, Column]:
    out: dict[str, Column] = {}
    won, placed, position = (F.col(f"_{x}") for x in ("won", "placed", "position"))
    for k in (5, 10, 15, 20):
        out[f"win_rate_last_{k}"] = A.share(A.last(won, k), _true)
    for k in (5, 10, 15):
        out[f"place_rate_last_{k}"] = A.share(A.last(placed, k), _true)
        out[f"avg_pos_last_{k}"] = F.coalesce(A.mean(F.col(f"_last_{k}")), F.lit(D))
    for k in (5, 10):
        p = F.col(f"_last_{k}")
        out[f"top3_finish_rate_last_{k}"] = A.share(A.last(position, k), lambda x: x <= 3)
        out[f"median_pos_last_{k}"] = F.coalesce(A.median(p), F.lit(D))
        out[f"best_pos_last_{k}"] = F.coalesce(F.array_min(p), F.lit(D))
        out[f"worst_pos_last_{k}"] = F.coalesce(F.array_max(p), F.lit(D))
    out["win_rate_career"] = A.share(won, _true)
    out["place_rate_career"] = A.share(placed, _true)
    out["pos_consistency"] = A.deviation(F.col("_last_10"))
    out["finishing_position_variance"] = A.variance(F.col("_last_10"))
    out["last_race_won"] = _flag(_last("won"))
    out["last_race_placed"] = _flag(_last("placed"))
    recent, older = F.col("_last_3"), F.col("_older_3")
    better = (F.size(recent) > 0) & (F.size(older) > 0) & (A.mean(recent) < A.mean(older))
    out["improving_form"] = _flag((F.size("hist") >= 6) & better)
    out["pos_improvement_vs_last"] = _or(F.lit(0.0), _last("position") - F.coalesce(A.mean(F.col("_last_5")), F.lit(D)))
    return out


def streaks() -> dict[str, Column]:
    won, placed, position = (F.col(f"_{x}") for x in ("won", "placed", "position"))
    return {
        "win_streak": _runs_since(F.transform(won, lambda v: ~v)),
        "races_since_win": _runs_since(won),
        "races_since_place": _runs_since(placed),
        "races_since_top3": _runs_since(F.transform(position, lambda p: p <= 3)),
    }


def rating_trend() -> dict[str, Column]:
    now, rated, five = F.col("official_rating"), F.col("_official_rating"), F.col("_rated_5")
    peak = F.array_max(rated)
    return {
        "or_rolling_avg_3": _or(now, A.mean(A.last(rated, 3))),
        "avg_official_rating_last_5": _or(now, A.mean(five)),
        "avg_official_rating_last_10": _or(now, A.mean(A.last(rated, 10))),
        "or_change_vs_last_race": _or(F.lit(0.0), now - _last("official_rating")),
        "or_momentum_short_term": _or(F.lit(0.0), now - A.mean(five)),
        "or_trend_last_5": A.slope(five),
        "or_volatility_last_5": A.deviation(five),
        "or_peak_in_career": _or(now, peak),
        "or_decline_from_peak": _or(F.lit(0.0), now - peak),
    }


def class_movement() -> dict[str, Column]:
    now, seen = F.col("class").cast("double"), F.col("_class_5")
    return {
        "avg_class_last_5": A.mean(seen),
        "moving_up_in_class": _flag(now > A.mean(seen)),
        "moving_down_in_class": _flag(now < A.mean(seen)),
        "class_change_vs_last": F.coalesce(now - F.try_element_at(seen, F.lit(-1)), F.lit(0.0)),
    }


def older_form() -> dict[str, Column]:
    return form() | {"pos_consistency": A.deviation(F.col("_last_5")), "last_race_won": _flag(_last("position") == 1)}


def older_class_movement() -> dict[str, Column]:
    """One unknown class among the last three leaves both flags at 0."""
    three = A.last(_hist()["class"], 3)
    known = F.when(F.forall(three, lambda c: c.isNotNull()), A.mean(F.transform(three, lambda c: c.cast("double"))))
    now = F.col("class").cast("double")
    return class_movement() | {"moving_up_in_class": _flag(now > known), "moving_down_in_class": _flag(now < known)}


def recency() -> dict[str, Column]:
    days = _hist()["day"]
    today = H.day(F.col("race_datetime"))
    within = lambda d: lambda x: today - x <= d
    out = {f"runs_last_{d}_days": A.count_where(days, within(d)).cast("long") for d in (30, 60, 90)}
    gap = F.try_divide((_last("day") - F.try_element_at("hist", F.lit(1))["day"]).cast("double"), F.size("hist") - 1)
    out["avg_days_between_races"] = F.when(F.size("hist") >= 2, gap).otherwise(F.lit(C.FeatureConfig().default_days_between))
    out["headgear_change"] = _flag(~_new() & (F.col("headgear") != _last("headgear")))
    out["headgear_first_time"] = _flag((F.col("headgear") != "None") & (_last("headgear") == "None"))
    out["total_career_runs"] = F.size("hist").cast("long")
    out["career_win_pct"] = A.share(F.col("_won"), _true)
    out["career_place_pct"] = A.share(F.col("_placed"), _true)
    return out


def _going_value(going: Column) -> Column:
    scale = F.create_map(*[F.lit(x) for pair in C.GOING_CHANGE.items() for x in pair])
    return F.coalesce(F.try_element_at(scale, going), F.lit(C.GOING_CHANGE_DEFAULT))


def specialisation() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name in ("surface", "distance", "course"):
        x, places = F.col(f"_{name}"), F.col(f"_{name}_places")
        out[f"{name}_experience"] = F.size(x).cast("long")
        out[f"{name}_win_rate"] = A.share(x["won"], _true)
        out[f"{name}_place_rate"] = A.share(x["placed"], _true)
        out["avg_pos_at_distance" if name == "distance" else f"{name}_avg_position"] = F.coalesce(A.mean(places), F.lit(D))
        if name != "distance":
            out[f"{name}_consistency"] = A.deviation(places)
    out["course_best_position"] = F.coalesce(F.array_min("_course_places"), F.lit(D))
    now, before = _going_value(F.col("going")), _going_value(_last("going"))
    out["going_change"] = _flag(~_new() & (F.col("going") != _last("going")))
    out["going_deterioration"] = _flag(~_new() & (now < before))
    out["going_improvement"] = _flag(~_new() & (now > before))
    moved = F.col("distance_m") - _last("distance_m")
    out["actual_distance_change_m"] = _or(F.lit(0.0), moved)
    out["distance_change_pct"] = F.when(_last("distance_m") > 0, moved / _last("distance_m")).otherwise(F.lit(0.0))
    return out


def momentum() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for k in (3, 5):
        out[f"position_momentum_{k}_races"] = F.when(~_new(), F.coalesce(A.mean(F.col(f"_older_{k}")) - A.mean(F.col(f"_last_{k}")), F.lit(0.0)))
    out["recent_form_trend"] = _or(F.lit(0.0), F.coalesce(A.rising_mean(F.col("_last_5")), F.lit(D)))
    p = F.col("_last_10")
    out["consistency_score"] = F.when(F.size(p) > 1, 1 - F.least(F.try_divide(A.deviation(p), A.mean(p)), F.lit(1.0))).otherwise(F.lit(0.0))
    return out


def combinations() -> dict[str, Column]:
    out: dict[str, Column] = {}
    same = lambda who: lambda r: r[who] == F.col(who)
    both = lambda who, what: lambda r: (r[who] == F.col(who)) & r[what]
    for who in ("jockey", "trainer"):
        out[f"{who}_horse_combo_runs"] = A.count_where(_hist(), same(who)).cast("long")
        out[f"{who}_horse_combo_wins"] = A.count_where(_hist(), both(who, "won")).cast("long")
        out[f"{who}_horse_combo_places"] = A.count_where(_hist(), both(who, "placed")).cast("long")
    return out


def people(who: str) -> dict[str, Column]:
    """Recent form of a jockey or trainer, from what it has seen of so many days."""
    runs = "rides" if who == "jockey" else "runners"
    out: dict[str, Column] = {}
    for d in DAYS:
        seen = F.col(f"_seen_{d}")
        out[f"{who}_form_wins_{d}d"] = seen["won"]
        out[f"{who}_{runs}_{d}d"] = seen["n"]
        out[f"{who}_places_{d}d"] = seen["placed"]
    return out


def field_quality() -> dict[str, Column]:
    """Against the other runners of the race: means and medians leave the runner out, spread doesn't."""
    race = Window.partitionBy("race_id")
    out: dict[str, Column] = {}
    for c, avg, med in (("official_rating", "field_quality_avg_or", "field_quality_median_or"), ("weight_lbs", "weight_vs_field_avg", "weight_vs_field_median")):
        x = F.col(c)
        others = A.without_one(F.collect_list(x).over(race), x)
        mean = F.try_divide(F.sum(x).over(race) - F.coalesce(x, F.lit(0.0)), F.count(x).over(race) - F.when(x.isNull(), 0).otherwise(1))
        out[avg], out[med] = (mean, A.median(others)) if c == "official_rating" else (x - mean, x - A.median(others))
    rating = F.col("official_rating")
    out["field_quality_std_or"] = F.coalesce(F.stddev_samp(rating).over(race), F.lit(0.0))
    out["field_quality_range"] = F.max(rating).over(race) - F.min(rating).over(race)
    return out


HORSE_GROUPS: dict[str, Callable[[], dict[str, Column]]] = {
    "form": form, "streaks": streaks, "rating_trend": rating_trend, "class_movement": class_movement, "recency": recency,
    "specialisation": specialisation, "momentum": momentum, "combinations": combinations,
}

_OLDER_GROUPS = HORSE_GROUPS | {"form": older_form, "class_movement": older_class_movement}


def with_places(df: DataFrame) -> DataFrame:
    """num_places, the places paid by the number of horses in the race, and placed."""
    field = F.count("horse").over(Window.partitionBy("race_id"))
    df = df.withColumn("num_places", F.when(field >= 8, 3).when(field >= 5, 2).otherwise(0))
    return df.withColumn("placed", _flag((F.col("won") == 1) | F.coalesce((F.col("pos") <= F.col("num_places")) & (F.col("pos") < 99), F.lit(False))))


def prepare(df: DataFrame, config: C.HistoryConfig = C.HistoryConfig()) -> DataFrame:
    """Defaults for missing inputs, places paid, placed, and the betting deadline."""
    fill = {"official_rating": 60.0, "weight_lbs": 140.0, "distance_m": 2000.0, "going": "Good", "headgear": "None", "course": "Unknown"}
    made = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in fill.items()}
    df = df.withColumns(made | {c: F.lit(None).cast(t) for c, t in (("class", "int"), ("pos", "double")) if c not in df.columns})
    if "row_no" not in df.columns:
        order = [c for c in ("file_idx", "row_idx") if c in df.columns] or ["horse"]
        df = df.withColumn("row_no", F.row_number().over(Window.partitionBy("race_id").orderBy(*order)))
    if "placed" not in df.columns:
        df = with_places(df)
    return df.withColumn("betting_deadline", F.col("race_datetime") - F.expr(f"INTERVAL {config.deadline_minutes or 0} MINUTES"))


def horse_features(df: DataFrame, groups: Sequence[str] = tuple(HORSE_GROUPS), config: C.HistoryConfig = C.HistoryConfig(), key: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """df's rows that have a horse (or what key makes of it), with the features of the named groups. Without key, races of one runner go first. counted: as in history."""
    fields = [f for f in dict.fromkeys(f for g in HORSE_GROUPS for f in FIELDS[g]) if any(f in FIELDS[g] for g in groups)]
    rows = H.with_history(H.eligible(df) if key is None else df, "horse", config.horse, fields, "hist", config, key, counted)
    steps, defined = _shared(groups), _OLDER_GROUPS if config.older_features else HORSE_GROUPS
    for made in [*steps, {k: v for g in groups for k, v in defined[g]().items()}]:
        rows = rows.withColumns(made)
    return rows.drop("hist", *[c for made in steps for c in made])


def people_features(df: DataFrame, who: str, config: C.HistoryConfig = C.HistoryConfig(), key: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """The same for the jockey or trainer, whose form is told by counts alone."""
    keep = config.jockey if who == "jockey" else config.trainer
    return H.with_counts(H.eligible(df) if key is None else df, who, keep, DAYS, config, key, counted).withColumns(people(who)).drop(*[f"_seen_{d}" for d in DAYS])


def names() -> list[str]:
    """Of all features here."""
    return [*[c for g in HORSE_GROUPS.values() for c in g()], *people("jockey"), *people("trainer"), *field_quality(), "horse_elo_pre_race", "elo_implied_prob"]


def with_field(df: DataFrame) -> DataFrame:
    """df with _field: whether the race has two runners at least."""
    return df.withColumn("_field", F.count("*").over(Window.partitionBy("race_id")) >= 2)


def _joined(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows with the columns that made has of them, by race and number; all joins of rows share one exchange of theirs."""
    other = made.withColumnsRenamed({"race_id": "_race", "row_no": "_no"})
    return rows.join(other, rows["race_id"].eqNullSafe(other["_race"]) & rows["row_no"].eqNullSafe(other["_no"]), "left").drop("_race", "_no")


def with_all_features(base: DataFrame, rated: DataFrame, config: C.HistoryConfig = C.HistoryConfig(), elo: C.EloConfig = C.EloConfig()) -> DataFrame:
    """All rows of base with the features of all histories and of the field, and rated's columns.

    base: prepare()'s result, stored, best with_field(); rated: of elo.ratings. Rows of single-runner races, or without horse,
    jockey or trainer, have nulls; they go through the windows under keys of their own, with nothing to see. What jockeys,
    trainers and ratings give is stored apart, some numbers for each row, and joined before the rows move to their horses
    and from there to their races.
    """
    rows = base if "_field" in base.columns else store(with_field(base))
    alone = F.concat(F.lit("\0"), F.coalesce("race_id", F.lit("")), F.lit("\0"), F.col("row_no").cast("string"))
    key = lambda who: F.coalesce(F.when(F.col("_field"), F.col(who).cast("string")), alone)
    made = [store(people_features(rows, who, config, key(who)).select("race_id", "row_no", *people(who))) for who in ("jockey", "trainer")]
    made.append(rated.where("race_id is not null").select("race_id", "row_no", "horse_elo_pre_race", E.implied_probability(F.col("horse_elo_pre_race"), elo).alias("elo_implied_prob")))
    whole = reduce(_joined, made, rows)
    whole = horse_features(whole, config=config, key=key("horse"), counted=rows).withColumns(field_quality())
    full = F.col("_field") & F.col("horse").isNotNull() & F.col("jockey").isNotNull() & F.col("trainer").isNotNull()
    return whole.select(*[c for c in base.columns if c != "_field"], *[F.when(full, F.col(c)).alias(c) for c in names()])


def chronological(df: DataFrame, config: C.HistoryConfig = C.HistoryConfig(), elo: C.EloConfig = C.EloConfig(), initial: DataFrame | None = None) -> DataFrame:
    """All rows of df with all chronological features; rows of single-runner races, or without horse, jockey or trainer, have nulls."""
    base = store(with_field(prepare(df, config)))
    return with_all_features(base, E.ratings(base, elo, initial), config, elo)
