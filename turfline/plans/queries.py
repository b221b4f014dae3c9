"""The registered queries over the star tables' runners, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline import config as C
from turfline.functions.storage import shared_folder, store
from turfline.operators import chrono, clean, derived, elo, history, selection
from turfline.plans import features, star, state
from turfline.plans import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ("race_id", "row_no")


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.startswith("WITH") else f"{star.SQL} {sql}"
        return f

    return add


# -- cleaning ---------------------------------------------------------------------------------------------------------


@_query("SELECT race_id, horse, jockey, l_linenumber, official_rating FROM first_rows")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_first(star.entries(spark, sf_dir), ["race_id", "horse"], star.ROW_ORDER).select("race_id", "horse", "jockey", "l_linenumber", "official_rating")


@_query(
    "SELECT DISTINCT race_id, strftime(race_date, '%Y-%m-%d') || '_' || upper(track) || '_' || lpad(CAST(race_minute % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(race_minute % 60 AS VARCHAR), 2, '0') AS card_id FROM runners"
)
def race_id_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.date_format("race_datetime", "HH:mm")
    return star.runners(spark, sf_dir).select("race_id", clean.race_id(F.col("date_of_race"), F.col("track"), time).alias("card_id")).distinct()


@_query("SELECT race_id, CASE WHEN type = 'Handicap Hurdle' THEN 'Jumps' WHEN type = 'Maiden Stakes' THEN 'Flat' ELSE 'Unknown' END AS race_category, count(*) AS n_rows FROM runners GROUP BY ALL")
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.runners(spark, sf_dir).groupBy("race_id", clean.race_type(F.col("type")).alias("race_category")).agg(F.count("*").alias("n_rows"))


@_query("SELECT race_id, row_no, pos, won, num_places, placed FROM runners")
def target_won_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.runners(spark, sf_dir).select("race_id", "row_no", "pos", "won", "num_places", "placed")


@_query(
    "SELECT count(*) AS n_rows, count(DISTINCT race_id) AS n_races, count(DISTINCT horse) AS n_horses, count(DISTINCT track) AS n_tracks, min(race_minute) AS first_minute, max(race_minute) AS last_minute, CAST(sum(won) AS BIGINT) AS n_winners, round(100.0 * avg(won), 6) AS win_rate_pct FROM runners"
)
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = clean.profile(star.runners(spark, sf_dir))
    minute = lambda c: F.floor(history.seconds(F.col(c)) / 60).cast("long")
    return p.select("n_rows", "n_races", "n_horses", "n_tracks", minute("first_race").alias("first_minute"), minute("last_race").alias("last_minute"), "n_winners", F.round("win_rate_pct", 6).alias("win_rate_pct"))


#: All columns of runners; those that SQL has under another name count the same values there.
_KINDS = {
    "race_id": "string", "race_date": "date", "race_minute": "bigint", "track": "string", "horse": "string", "jockey": "string", "trainer": "string", "official_rating": "double",
    "weight_lbs": "double", "age": "int", "stall": "int", "class": "int", "going": "string", "distance_m": "double", "headgear": "string", "forecasted_odds": "double",
    "days_since_last_time_out": "int", "type": "string", "pos": "double", "row_no": "int", "runners": "int", "won": "int", "course": "string", "race_datetime": "timestamp_ntz",
    "date_of_race": "timestamp_ntz", "num_places": "int", "placed": "int",
}
_SAME = {"race_datetime": "race_minute", "date_of_race": "race_date"}
_REPORT = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({_SAME.get(c, c)}) AS n_null, round(100.0 * (count(*) - count({_SAME.get(c, c)})) / count(*), 2) AS null_pct, count(DISTINCT {_SAME.get(c, c)}) AS n_distinct FROM runners"
    for c, t in _KINDS.items()
)


@_query(_REPORT)
def schema_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.schema_report(star.runners(spark, sf_dir))


@_query("SELECT type, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM runners GROUP BY type")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.distribution(star.runners(spark, sf_dir), "type").withColumn("pct", F.round("pct", 6))


_KEY = "CAST(race_id AS BIGINT)"


@_query(
    f""", raw AS (
  SELECT *, {_KEY} AS key, lpad(CAST(race_minute % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(race_minute % 60 AS VARCHAR), 2, '0') AS clock,
         CASE {_KEY} % 3 WHEN 0 THEN strftime(race_date, '%d/%m/%Y') WHEN 1 THEN strftime(race_date, '%Y-%m-%d') ELSE strftime(race_date, '%d %b %Y') END AS written FROM entries
), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY written, clock, track, horse ORDER BY l_linenumber, key, l_suppkey, CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000) AS nth FROM raw WHERE key % 17 <> 0 AND key % 19 <> 0 AND key % 23 <> 0) WHERE nth = 1)
SELECT strftime(race_date, '%Y-%m-%d') || '_' || upper(track) || '_' || clock AS race_id, horse, race_minute, CASE type WHEN 'Handicap Hurdle' THEN 'Jumps' WHEN 'Maiden Stakes' THEN 'Flat' ELSE 'Unknown' END AS race_category,
       CASE WHEN l_discount <> 0 THEN l_linenumber::DOUBLE END AS pos, CAST(l_discount <> 0 AND l_linenumber = 1 AS INT) AS won, CASE WHEN l_linenumber % 5 > 2 THEN l_suppkey::DOUBLE END AS forecasted_odds,
       CASE l_partkey % 3 WHEN 0 THEN (l_partkey % 10 + 5) * 14 + l_partkey % 14 WHEN 1 THEN l_partkey END::DOUBLE AS weight_lbs, round(CASE WHEN key % 4 <> 0 THEN key % 20 * 201.168::DOUBLE ELSE 2000 END, 6) AS distance_m,
       CASE WHEN key % 4 <> 1 THEN CAST(key % 100 AS VARCHAR) END AS rate_pct, track AS course FROM once"""
)
def cleaned_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cards of text through all cleaning: names, first of duplicates, times, race ids, types, positions, targets, odds, weights, distances."""
    rows = clean.prepare_inputs(clean.clean(clean.standardize_names(star.raw_cards(spark, sf_dir))))
    minute = F.floor(history.seconds(F.col("race_datetime")) / 60).cast("long").alias("race_minute")
    return rows.select("race_id", "horse", minute, "race_category", "pos", "won", "forecasted_odds", "weight_lbs", F.round("distance_m", 6).alias("distance_m"), "rate_pct", "course")


@_query("SELECT race_id, horse, count(*) AS n_rows FROM entries GROUP BY race_id, horse HAVING count(*) > 1")
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.duplicate_runners(star.entries(spark, sf_dir))


@_query("SELECT round(100.0 * sum(won) / count(*), 6) AS win_rate_pct, round(100.0 * count(*) / sum(runners), 6) AS expected_pct FROM runners")
def win_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.win_rates(star.runners(spark, sf_dir)).select(F.round("win_rate_pct", 6).alias("win_rate_pct"), F.round("expected_pct", 6).alias("expected_pct"))


@_query(f", p AS ({_REPORT}) SELECT * FROM p WHERE null_pct > 10")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.missing_over(store(star.runners(spark, sf_dir)))


@_query("SELECT race_id, row_no, horse, won, CASE WHEN runners > 1 THEN round(official_rating / (runners - 1), 6) END AS ratio FROM runners")
def leakage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result columns go, infinities become null."""
    rows = star.runners(spark, sf_dir).select(*KEY, "horse", "won", "pos", "official_rating", "runners")
    made = rows.withColumns({"Betfair_SP_Forecast": F.lit(2.0), "ip_max": F.col("pos"), "ratio": F.when(F.col("runners") > 1, F.col("official_rating") / (F.col("runners") - 1)).otherwise(F.lit(float("inf")))})
    left = clean.drop_leakage(made.drop("official_rating", "runners"))
    return left.withColumn("ratio", F.round("ratio", 6))


# -- race windows -----------------------------------------------------------------------------------------------------


#: CTEs that end in `field_quality`.
_FIELD = """, field_pairs AS (SELECT a.race_id, a.row_no, avg(b.official_rating) AS o_avg, median(b.official_rating) AS o_med, avg(b.weight_lbs) AS w_avg, median(b.weight_lbs) AS w_med FROM base a JOIN base b ON a.race_id = b.race_id AND a.row_no <> b.row_no GROUP BY ALL),
field_quality AS (SELECT base.race_id, base.row_no, round(o_avg, 6) AS field_quality_avg_or, round(o_med, 6) AS field_quality_median_or, round(weight_lbs - w_avg, 6) AS weight_vs_field_avg, round(weight_lbs - w_med, 6) AS weight_vs_field_median,
round(coalesce(stddev_samp(official_rating) OVER (PARTITION BY base.race_id), 0), 6) AS field_quality_std_or, round(max(official_rating) OVER (PARTITION BY base.race_id) - min(official_rating) OVER (PARTITION BY base.race_id), 6) AS field_quality_range FROM base JOIN field_pairs USING (race_id, row_no))"""


@_query(f"{O.BASE}{_FIELD} SELECT * FROM field_quality")
def field_quality_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chrono.field_quality()
    return _rounded(history.eligible(star.runners(spark, sf_dir)).withColumns(made), list(made))


def _rounded(df: DataFrame, columns: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*key, *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def _derived(rows: DataFrame, *groups: str) -> DataFrame:
    """The columns of derived groups, applied one after the other to rows."""
    names: list[str] = []
    for g in groups:
        steps = derived.LEGACY_MARKET if g == "legacy_market" else g
        names += derived.names_of(steps, rows.columns)
        rows = derived.apply(rows, steps)
    return _rounded(rows, names)


RUNNER_COLUMNS = (
    "race_id", "race_date", "race_minute", "track", "horse", "jockey", "trainer", "official_rating", "weight_lbs", "age", "stall", "class", "going", "distance_m", "headgear",
    "forecasted_odds", "days_since_last_time_out", "type", "pos", "row_no", "runners", "won", "num_places", "course", "placed", "race_datetime", "date_of_race",
)
_TEXTS = {"race_id", "track", "horse", "jockey", "trainer", "going", "headgear", "type", "course"}


@_query("SELECT a.race_id, a.row_no, round((count(*) FILTER (WHERE b.official_rating < a.official_rating) + (1 + count(*) FILTER (WHERE b.official_rating = a.official_rating)) / 2) / count(b.official_rating), 6) AS pct_rank FROM runners a JOIN runners b USING (race_id) GROUP BY a.race_id, a.row_no")
def rank_pct_in_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.runners(spark, sf_dir).select(*KEY, F.round(F.expr(derived.percent_rank("official_rating")), 6).alias("pct_rank"))


@_query("SELECT race_id, row_no, rating_rank, CAST(rating_rank <= 3 AS INT) AS is_top3 FROM (SELECT *, rank() OVER (PARTITION BY race_id ORDER BY official_rating DESC) AS rating_rank FROM runners)")
def rank_desc_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = star.runners(spark, sf_dir).withColumn("rating_rank", F.expr(derived.min_rank("official_rating", descending=True)))
    return ranked.select(*KEY, "rating_rank", (F.col("rating_rank") <= 3).cast("int").alias("is_top3"))


@_query(
    ", tops AS (SELECT race_id, list(pos ORDER BY pos DESC) FILTER (WHERE pos IS NOT NULL) AS x, count(*) AS n FROM runners GROUP BY race_id) SELECT race_id, CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE x[1] - x[2] END AS gap FROM tops"
)
def second_best_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.runners(spark, sf_dir).withColumn("_place", F.expr("row_number() OVER (PARTITION BY race_id ORDER BY pos DESC NULLS LAST, row_no)"))
    return rows.select("race_id", F.expr(derived.second_gap("pos")).alias("gap")).distinct()


@_query(O.select(["temporal"], "runners"))
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(star.runners(spark, sf_dir), "temporal")


@_query(O.select(["track"], "runners", [c for c in O.columns("track") if c not in ("track_frequency", "class_filled")]))
def going_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(derived.with_global_statistics(star.runners(spark, sf_dir)), "track")


@_query(O.select(["market"], "runners"))
def market_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(star.runners(spark, sf_dir), "market")


@_query("SELECT race_id, row_no, row_number() OVER card AS race_number_on_card, count(race_id) OVER (PARTITION BY track, race_date) AS total_races_on_card FROM runners WINDOW card AS (PARTITION BY track, race_date ORDER BY race_minute, race_id, row_no)")
def card_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.apply(star.runners(spark, sf_dir), "temporal").select(*KEY, "race_number_on_card", "total_races_on_card")


# -- histories --------------------------------------------------------------------------------------------------------


HORSE_SQL: dict[str, tuple[str, str]] = {}


def _stored(spark: SparkSession, sf_dir: str, config: C.HistoryConfig = C.HistoryConfig()) -> DataFrame:
    """Prepared runners of races of two at least, which histories read more than once."""
    return store(history.eligible(chrono.prepare(star.runners(spark, sf_dir), config)))


_SEEN = f"{O.BASE}{O.seen('horse', 30)}"


def _horse_query(name: str, group: str, aggregates: str, result: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(chrono.horse_features(_stored(spark, sf_dir), (group,), key=F.col("horse")), list(chrono.HORSE_GROUPS[group]()))

    run.__name__ = name
    HORSE_SQL[group] = aggregates, result
    _query(f"{_SEEN}{O.part(name, 'horse', aggregates, result)} SELECT * FROM {name}")(run)


def _share(c: str, k: int | None = None) -> str:
    return f"avg({c})" + (f" FILTER (WHERE back <= {k})" if k else "")


def _fin(f: str, k: int) -> str:
    return f"{f}(p) FILTER (WHERE back <= {k} AND p < 99)"


_horse_query(
    "horse_form_last_k",
    "form",
    ", ".join(
        [f"{_share('w', k)} AS w{k}" for k in (5, 10, 15, 20)] + [f"{_share('q', k)} AS q{k}, {_fin('avg', k)} AS a{k}" for k in (5, 10, 15)]
        + [f"avg(CAST(p <= 3 AS INT)) FILTER (WHERE back <= {k}) AS t{k}, {_fin('median', k)} AS m{k}, {_fin('min', k)} AS lo{k}, {_fin('max', k)} AS hi{k}" for k in (5, 10)]
        + ["avg(w) AS wc, avg(q) AS qc, var_pop(p) FILTER (WHERE back <= 10 AND p < 99) AS v10, max(w) FILTER (WHERE back = 1) AS w1, max(q) FILTER (WHERE back = 1) AS q1, max(p) FILTER (WHERE back = 1) AS p1, avg(p) FILTER (WHERE back <= 3 AND p < 99) AS r3, avg(p) FILTER (WHERE back BETWEEN 4 AND 6 AND p < 99) AS o3"]
    ),
    ", ".join(
        [f"round(coalesce(w{k}, 0), 6) AS win_rate_last_{k}" for k in (5, 10, 15, 20)] + [f"round(coalesce(q{k}, 0), 6) AS place_rate_last_{k}, round(coalesce(a{k}, 10), 6) AS avg_pos_last_{k}" for k in (5, 10, 15)]
        + [f"round(coalesce(t{k}, 0), 6) AS top3_finish_rate_last_{k}, coalesce(m{k}, 10) AS median_pos_last_{k}, coalesce(lo{k}, 10) AS best_pos_last_{k}, coalesce(hi{k}, 10) AS worst_pos_last_{k}" for k in (5, 10)]
        + ["round(coalesce(wc, 0), 6) AS win_rate_career, round(coalesce(qc, 0), 6) AS place_rate_career, round(sqrt(coalesce(v10, 0)), 6) AS pos_consistency, round(coalesce(v10, 0), 6) AS finishing_position_variance, coalesce(w1, 0) AS last_race_won, coalesce(q1, 0) AS last_race_placed, CAST(coalesce(n_seen >= 6 AND r3 < o3, false) AS INT) AS improving_form, round(CASE WHEN n_seen IS NULL THEN 0 ELSE p1 - coalesce(a5, 10) END, 6) AS pos_improvement_vs_last"]
    ),
)
_horse_query(
    "horse_streaks",
    "streaks",
    "min(back) FILTER (WHERE w = 0) AS lost, min(back) FILTER (WHERE w = 1) AS won_at, min(back) FILTER (WHERE q = 1) AS placed_at, min(back) FILTER (WHERE p <= 3) AS top_at",
    ", ".join(f"coalesce({c} - 1, n_seen, 0) AS {n}" for c, n in (("lost", "win_streak"), ("won_at", "races_since_win"), ("placed_at", "races_since_place"), ("top_at", "races_since_top3"))),
)
_horse_query(
    "rating_trend",
    "rating_trend",
    "avg(o) FILTER (WHERE back <= 3) AS o3, avg(o) FILTER (WHERE back <= 5) AS o5, avg(o) FILTER (WHERE back <= 10) AS o10, max(o) FILTER (WHERE back = 1) AS o1, max(o) AS peak, regr_slope(o, -back) FILTER (WHERE back <= 5) AS slope, stddev_pop(o) FILTER (WHERE back <= 5) AS sd",
    "round(coalesce(o3, official_rating), 6) AS or_rolling_avg_3, round(coalesce(o5, official_rating), 6) AS avg_official_rating_last_5, round(coalesce(o10, official_rating), 6) AS avg_official_rating_last_10, coalesce(official_rating - o1, 0) AS or_change_vs_last_race, round(coalesce(official_rating - o5, 0), 6) AS or_momentum_short_term, round(CASE WHEN n_seen >= 2 THEN slope ELSE 0 END, 6) AS or_trend_last_5, round(coalesce(sd, 0), 6) AS or_volatility_last_5, coalesce(peak, official_rating) AS or_peak_in_career, coalesce(official_rating - peak, 0) AS or_decline_from_peak",
)
_horse_query(
    "class_movement",
    "class_movement",
    "avg(c) FILTER (WHERE back <= 5) AS c5, arg_min(c, back) FILTER (WHERE back <= 5 AND c IS NOT NULL) AS c1",
    "round(c5, 6) AS avg_class_last_5, CAST(coalesce(class > c5, false) AS INT) AS moving_up_in_class, CAST(coalesce(class < c5, false) AS INT) AS moving_down_in_class, CAST(coalesce(class - c1, 0) AS DOUBLE) AS class_change_vs_last",
)
_horse_query(
    "recency_counts",
    "recency",
    "count(*) FILTER (WHERE days <= 30) AS d30, count(*) FILTER (WHERE days <= 60) AS d60, count(*) FILTER (WHERE days <= 90) AS d90, (max(days) - min(days)) / nullif(count(*) - 1, 0) AS gap, max(h) FILTER (WHERE back = 1) AS h1, avg(w) AS wc, avg(q) AS qc",
    "coalesce(d30, 0) AS runs_last_30_days, coalesce(d60, 0) AS runs_last_60_days, coalesce(d90, 0) AS runs_last_90_days, round(CASE WHEN n_seen >= 2 THEN gap ELSE 21 END, 6) AS avg_days_between_races, CAST(coalesce(headgear <> h1, false) AS INT) AS headgear_change, CAST(coalesce(headgear <> 'None' AND h1 = 'None', false) AS INT) AS headgear_first_time, coalesce(n_seen, 0) AS total_career_runs, round(coalesce(wc, 0), 6) AS career_win_pct, round(coalesce(qc, 0), 6) AS career_place_pct",
)
_SCALE = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.GOING_CHANGE.items()) + f" ELSE {C.GOING_CHANGE_DEFAULT} END"
_SUBSETS = (("surface", "g = a_going"), ("distance", "abs(d - a_distance) < 200"), ("course", "k = a_course"))
_horse_query(
    "specialisation_rates",
    "specialisation",
    ", ".join(f"count(*) FILTER (WHERE {x}) AS {n}_n, avg(w) FILTER (WHERE {x}) AS {n}_w, avg(q) FILTER (WHERE {x}) AS {n}_q, avg(p) FILTER (WHERE {x} AND p < 99) AS {n}_a, stddev_pop(p) FILTER (WHERE {x} AND p < 99) AS {n}_s, min(p) FILTER (WHERE {x} AND p < 99) AS {n}_b" for n, x in _SUBSETS)
    + ", max(g) FILTER (WHERE back = 1) AS g1, max(d) FILTER (WHERE back = 1) AS d1",
    ", ".join(f"coalesce({n}_n, 0) AS {n}_experience, round(coalesce({n}_w, 0), 6) AS {n}_win_rate, round(coalesce({n}_q, 0), 6) AS {n}_place_rate, round(coalesce({n}_a, 10), 6) AS {'avg_pos_at_distance' if n == 'distance' else n + '_avg_position'}" + ("" if n == "distance" else f", round(coalesce({n}_s, 0), 6) AS {n}_consistency") for n, _ in _SUBSETS)
    + f", coalesce(course_b, 10) AS course_best_position, CAST(coalesce(going <> g1, false) AS INT) AS going_change, CAST(coalesce(g1 IS NOT NULL AND {_SCALE.format('going')} < {_SCALE.format('g1')}, false) AS INT) AS going_deterioration, CAST(coalesce(g1 IS NOT NULL AND {_SCALE.format('going')} > {_SCALE.format('g1')}, false) AS INT) AS going_improvement, coalesce(distance_m - d1, 0) AS actual_distance_change_m, round(coalesce((distance_m - d1) / d1, 0), 6) AS distance_change_pct",
)
_horse_query(
    "position_momentum",
    "momentum",
    ", ".join(f"avg(p) FILTER (WHERE back <= {k} AND p < 99) AS r{k}, avg(p) FILTER (WHERE back BETWEEN {k + 1} AND {2 * k} AND p < 99) AS o{k}" for k in (3, 5))
    + ", list(p ORDER BY back DESC) FILTER (WHERE back <= 5 AND p < 99) AS l5, stddev_pop(p) FILTER (WHERE back <= 10 AND p < 99) AS s10, avg(p) FILTER (WHERE back <= 10 AND p < 99) AS a10, count(*) FILTER (WHERE back <= 10 AND p < 99) AS n10",
    ", ".join(f"round(CASE WHEN n_seen IS NULL THEN NULL WHEN n_seen >= {2 * k} THEN coalesce(o{k} - r{k}, 0) ELSE 0 END, 6) AS position_momentum_{k}_races" for k in (3, 5))
    + ", round(CASE WHEN n_seen IS NULL THEN 0 WHEN l5 IS NULL THEN 10 ELSE list_sum(list_transform(l5, lambda x, i: x * i)) / (len(l5) * (len(l5) + 1) / 2) END, 6) AS recent_form_trend, round(CASE WHEN n10 > 1 THEN 1 - least(s10 / a10, 1) ELSE 0 END, 6) AS consistency_score",
)
_horse_query(
    "combo_stats",
    "combinations",
    ", ".join(f"count(*) FILTER (WHERE {c} = a_{n}) AS {n}_n, count(*) FILTER (WHERE {c} = a_{n} AND w = 1) AS {n}_w, count(*) FILTER (WHERE {c} = a_{n} AND q = 1) AS {n}_p" for c, n in (("j", "jockey"), ("t", "trainer"))),
    ", ".join(f"coalesce({n}_n, 0) AS {n}_horse_combo_runs, coalesce({n}_w, 0) AS {n}_horse_combo_wins, coalesce({n}_p, 0) AS {n}_horse_combo_places" for n in ("jockey", "trainer")),
)


_OLDER = ("pos_consistency", "last_race_won", "moving_up_in_class", "moving_down_in_class", "races_since_win", "win_rate_last_20")
_OLDER_SQL = (
    "var_pop(p) FILTER (WHERE back <= 5 AND p < 99) AS v5, max(p) FILTER (WHERE back = 1) AS p1, avg(c) FILTER (WHERE back <= 3) AS c3, count(*) FILTER (WHERE back <= 3 AND c IS NULL) AS holes, min(back) FILTER (WHERE w = 1) AS won_at, avg(w) AS wc",
    "round(sqrt(coalesce(v5, 0)), 6) AS pos_consistency, CAST(coalesce(p1 = 1, false) AS INT) AS last_race_won, CAST(coalesce(holes = 0 AND class > c3, false) AS INT) AS moving_up_in_class, CAST(coalesce(holes = 0 AND class < c3, false) AS INT) AS moving_down_in_class, coalesce(won_at - 1, n_seen, 0) AS races_since_win, round(coalesce(wc, 0), 6) AS win_rate_last_20",
)


@_query(f"{O.BASE}{O.seen('horse', 20, None)}{O.part('older', 'horse', *_OLDER_SQL)} SELECT * FROM older")
def older_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the older generation's histories what it defines otherwise: 20 records, no deadline."""
    rows = _stored(spark, sf_dir, C.OLDER_HISTORY)
    return _rounded(chrono.horse_features(rows, ("form", "streaks", "class_movement"), C.OLDER_HISTORY, F.col("horse")), list(_OLDER))


def _people_sql(who: str) -> tuple[str, str]:
    runs = "rides" if who == "jockey" else "runners"
    parts = ", ".join(f"count(*) FILTER (WHERE days <= {d} AND w = 1) AS w{d}, count(*) FILTER (WHERE days <= {d}) AS n{d}, count(*) FILTER (WHERE days <= {d} AND q = 1) AS q{d}" for d in (14, 30, 90))
    return parts, ", ".join(f"coalesce(w{d}, 0) AS {who}_form_wins_{d}d, coalesce(n{d}, 0) AS {who}_{runs}_{d}d, coalesce(q{d}, 0) AS {who}_places_{d}d" for d in (14, 30, 90))


_KEEP = {"jockey": 100, "trainer": 150}


@_query(f"{O.BASE}{O.seen('jockey', 100)}{O.part('form', 'jockey', *_people_sql('jockey'))} SELECT * FROM form")
def jockey_form_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chrono.people_features(_stored(spark, sf_dir), "jockey", key=F.col("jockey")).select(*KEY, *chrono.people("jockey"))


@_query(f"{O.BASE}{O.seen('trainer', 150)}{O.part('form', 'trainer', *_people_sql('trainer'))} SELECT * FROM form")
def trainer_form_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chrono.people_features(_stored(spark, sf_dir), "trainer", key=F.col("trainer")).select(*KEY, *chrono.people("trainer"))


# -- derived from histories ----------------------------------------------------------------------------------------------


def _history_sql(groups: Sequence[str] = (), people: Sequence[str] = (), field: bool = False, elo: bool = False, rows: str = "base", join: str = "JOIN") -> str:
    """CTEs that end in `f`: rows joined with the features of horse groups, people, the field and ratings."""
    sql, parts = O.BASE, []
    if groups:
        sql += O.seen("horse", 30) + "".join(O.part(f"p_{g}", "horse", HORSE_SQL[g][0], O.unrounded(HORSE_SQL[g][1])) for g in groups)
        parts += [f"p_{g}" for g in groups]
    for who in people:
        sql += O.seen(who, _KEEP[who]) + O.part(f"p_{who}", who, *_people_sql(who))
        parts.append(f"p_{who}")
    if field:
        sql, parts = sql + O.unrounded(_FIELD), [*parts, "field_quality"]
    if elo:
        sql, parts = sql + O.RATINGS, [*parts, "(SELECT race_id, row_no, horse_elo_pre_race, elo_implied_prob FROM ratings) AS p_elo"]
    return f"{sql}, f AS (SELECT * FROM {rows} {' '.join(f'{join} {x} USING (race_id, row_no)' for x in parts)})"


def _history_rows(spark: SparkSession, sf_dir: str, groups: Sequence[str] = (), people: Sequence[str] = ()) -> DataFrame:
    rows = stored = _stored(spark, sf_dir)
    for who in people:
        rows = chrono.people_features(rows, who, key=F.col(who), counted=stored)
    return chrono.horse_features(rows, groups, key=F.col("horse"), counted=stored) if groups else rows


def _history_query(name: str, derive: Sequence[str], groups: Sequence[str], people: Sequence[str] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _derived(_history_rows(spark, sf_dir, groups, people), *derive)

    run.__name__ = name
    _query(f"{_history_sql(groups, people)} {O.select(derive, 'f')}")(run)


_history_query("age_weight_relative", ("age_weight",), ("recency",))
_history_query("field_composition", ("field",), ("recency",))
_history_query("headgear_flags", ("headgear",), ("recency",))
_history_query("class_vs_field", ("class",), ("class_movement",))
_history_query("history_flags", ("specialist", "form_trend", "recency", "rating_momentum"), ("form", "streaks", "rating_trend", "recency", "specialisation"))
_history_query("strike_rates", ("people",), ("combinations",), ("jockey", "trainer"))

_ALL = tuple(chrono.HORSE_GROUPS)


@_query(O.recursive(f"{star.SQL} {_history_sql(_ALL, ('jockey', 'trainer'), True, True)} {O.select(['people', 'interactions'], 'f', list(O.columns('interactions')))}"))
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chrono.chronological(star.runners(spark, sf_dir)).where("horse_elo_pre_race is not null")
    made = derived.apply(derived.apply(rows, "people"), "interactions")
    return _rounded(made, derived.names_of("interactions", made.columns))


@_query(O.recursive(f"{star.SQL} {_history_sql(('form',), (), True, True)}, priced AS (SELECT *, CASE WHEN CAST(race_id AS BIGINT) % 5 <> 0 THEN forecasted_odds * (0.5 + stall / 4.0::DOUBLE) END AS betfair_sp FROM f) {O.select(['legacy_market'], 'priced')}"))
def legacy_market_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older generation's features, over made starting prices that whole races lack."""
    price = F.when(F.col("race_id").cast("long") % 5 != 0, F.col("forecasted_odds") * (0.5 + F.col("stall") / 4.0))
    rows = chrono.chronological(star.runners(spark, sf_dir)).where("horse_elo_pre_race is not null").withColumn("betfair_sp", price)
    return _derived(rows, "legacy_market")


# -- ratings ----------------------------------------------------------------------------------------------------------


@_query("SELECT race_id, row_no, round(pow(10, (1400 + 8 * official_rating) / 400) / sum(pow(10, (1400 + 8 * official_rating) / 400)) OVER (PARTITION BY race_id), 6) AS win_prob FROM runners")
def elo_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.runners(spark, sf_dir).select(*KEY, F.round(elo.implied_probability(1400 + 8 * F.col("official_rating")), 6).alias("win_prob"))


_FIRST = """, base AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n FROM runners), scored AS (
  SELECT race_id, row_no, n, pos, count(*) FILTER (WHERE pos IS NULL) OVER (PARTITION BY race_id) AS missing FROM base WHERE n >= 2),
beaten AS (SELECT a.*, (SELECT count(*) FROM scored b WHERE b.race_id = a.race_id AND b.pos > a.pos) AS behind FROM scored a)
SELECT race_id, row_no, round(CASE WHEN pos IS NULL THEN 0 ELSE (behind + 2 * missing) / (n - 1) END, 6) AS actual_score FROM beaten"""


@_query(_FIRST)
def elo_actual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.eligible(star.runners(spark, sf_dir)).select(*KEY, F.round(elo.actual_score().cast("double"), 6).alias("actual_score"))


@_query(_FIRST.replace("WHEN pos IS NULL THEN 0 ELSE", "WHEN pos IS NULL THEN (2 * missing - 1) / (n - 1) ELSE"))
def elo_actual_score_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older generation's score, in which non-finishers beat each other."""
    score = elo.actual_score(C.EloConfig(mode="legacy")).cast("double")
    return history.eligible(star.runners(spark, sf_dir)).select(*KEY, F.round(score, 6).alias("actual_score"))


_RATED = O.recursive(f"{star.SQL} {O.BASE}{O.RATINGS}")


@_query(f"{_RATED} SELECT race_id, row_no, round(horse_elo_pre_race, 4) AS horse_elo_pre_race, round(elo_implied_prob, 6) AS elo_implied_prob FROM ratings")
def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elo.ratings(star.runners(spark, sf_dir))
    return rows.select(*KEY, F.round("horse_elo_pre_race", 4).alias("horse_elo_pre_race"), F.round(elo.implied_probability(F.col("horse_elo_pre_race")), 6).alias("elo_implied_prob"))


@_query(f"{_RATED} {O.select(['elo'], 'ratings')}")
def elo_in_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elo.ratings(star.runners(spark, sf_dir))
    return _derived(rows.withColumn("elo_implied_prob", elo.implied_probability(F.col("horse_elo_pre_race"))), "elo")


@_query(f"{_RATED}, last AS (SELECT horse, arg_max(post, run) AS elo FROM ratings GROUP BY horse) SELECT count(*) AS n_horses, round(avg(elo), 4) AS mean_elo, round(stddev_pop(elo), 4) AS std_elo, round(min(elo), 4) AS min_elo, round(max(elo), 4) AS max_elo FROM last")
def elo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = elo.summary(elo.after_all(chrono.prepare(star.runners(spark, sf_dir))))
    return x.select("n_horses", *[F.round(c, 4).alias(c) for c in ("mean_elo", "std_elo", "min_elo", "max_elo")])


_ENTITIES = " UNION ALL ".join(f"SELECT '{who}' AS who, {who} AS entity, least(count(*), {keep}) AS n_records, {'any_value(round(elo, 4))' if who == 'horse' else 'CAST(NULL AS DOUBLE)'} AS elo FROM counted {'LEFT JOIN last USING (horse)' if who == 'horse' else ''} GROUP BY {who}" for who, keep in (("horse", 30), ("jockey", 100), ("trainer", 150)))


@_query(f"{_RATED}, last AS (SELECT horse, arg_max(post, run) AS elo FROM ratings GROUP BY horse), counted AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY race_id) AS field_n FROM runners) WHERE field_n > 1) {_ENTITIES}")
def state_after_daily_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entity holds once the last two days are merged, one by one, into the state of all results before: the same as a state of everything."""
    runners = store(star.runners(spark, sf_dir))
    day = F.to_date("race_datetime")
    last = sorted(x[0] for x in runners.select(day).distinct().orderBy(F.desc(runners.select(day).columns[0])).limit(2).collect())
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    state.save(runners.where(day < last[0]), folder)
    for d in (*last, last[-1]):  # one of them twice
        state.merge(spark, folder, runners.where(day == d))
    return state.holdings(state.read(spark, folder)).withColumn("elo", F.round("elo", 4))


# -- selection --------------------------------------------------------------------------------------------------------

_NUMBERS = (
    "official_rating", "weight_lbs", "age", "stall", "class", "distance_m", "forecasted_odds", "days_since_last_time_out", "pos", "row_no", "runners", "won", "num_places", "placed",
)


@_query(
    """, n AS (SELECT count(*) AS n FROM runners), cuts AS (SELECT CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT) AS test_at, CAST(floor(floor(n * (1 - 0.15::DOUBLE)) * (1 - 0.15::DOUBLE)) AS BIGINT) AS val_at FROM n)
SELECT race_id, row_no, CASE WHEN place < val_at THEN 'train' WHEN place < test_at THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY race_minute, race_id, horse) - 1 AS place FROM runners), cuts"""
)
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_split(star.runners(spark, sf_dir)).select(*KEY, "split")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(var_pop({c}), 6) AS variance, CAST(var_pop({c}) <= 0.000001 AS INT) AS is_low FROM runners" for c in _NUMBERS))
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    threshold = C.SelectionConfig().variance_threshold
    return selection.variances(star.runners(spark, sf_dir), _NUMBERS).select("column_name", F.round("variance", 6).alias("variance"), (F.col("variance") <= threshold).cast("int").alias("is_low"))


@_query(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS correlation FROM runners" for k, b in enumerate(_NUMBERS) for a in _NUMBERS[:k]))
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.correlations(star.runners(spark, sf_dir), _NUMBERS).withColumn("correlation", F.round("correlation", 6))


@_query(", counts AS (SELECT track, count(*) AS n_rows FROM runners GROUP BY track) SELECT track, n_rows, round(sum(n_rows) OVER (ORDER BY n_rows DESC, track) / sum(n_rows) OVER (), 6) AS cumulative_share FROM counts")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = star.runners(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n_rows"))
    ranked = selection.cumulative(counts.select(F.col("track").alias("feature"), F.col("n_rows").cast("double").alias("importance")))
    return ranked.select(F.col("feature").alias("track"), F.col("importance").cast("long").alias("n_rows"), F.round("cumulative_share", 6).alias("cumulative_share"))


#: Columns that the rules see, in order, with three made ones: a copy at another scale, one without variance, a near copy.
_OFFERED = (
    "official_rating", "weight_lbs", "age", "stall", "class", "going", "distance_m", "headgear", "forecasted_odds", "days_since_last_time_out", "type", "pos", "runners", "num_places", "placed",
    "rating_twice", "flat", "weight_and_age",
)
_LEAKY = ("pos", "num_places", "placed")
_JUDGED = [c for c in _OFFERED if c not in (*_LEAKY, "going", "headgear", "type")]
_RULES_SQL = f""", r AS (SELECT *, 2 * official_rating AS rating_twice, 1::DOUBLE AS flat, weight_lbs + age / 1000::DOUBLE AS weight_and_age FROM runners),
v AS ({" UNION ALL ".join(f"SELECT {k} AS place, '{c}' AS c, var_pop({c}) AS vp, var_samp({c}) AS vs FROM r" for k, c in enumerate(_JUDGED))}),
pairs AS ({" UNION ALL ".join(f"SELECT '{a}' AS l, '{b}' AS r, abs(corr({a}, {b})) AS x FROM r" for k, b in enumerate(_JUDGED) for a in _JUDGED[:k] if "flat" not in (a, b))}),
settings AS (SELECT * FROM (VALUES ('latest', 0.98::DOUBLE, false), ('older', 0.999::DOUBLE, true)) AS t(rule, most, whichever)),
low AS (SELECT rule, c FROM v, settings WHERE vp < 0.000001 OR (vp = 0.000001 AND NOT whichever)),
near AS (SELECT rule, whichever, l, r FROM pairs, settings WHERE x > most),
members AS (SELECT rule, r AS head, r AS member FROM near WHERE NOT whichever UNION SELECT rule, r, l FROM near WHERE NOT whichever),
ranked AS (SELECT rule, member, row_number() OVER (PARTITION BY rule, head ORDER BY vs DESC, member <> head, place) AS k FROM members JOIN v ON member = c),
gone AS (SELECT rule, member AS c FROM ranked WHERE k > 1 UNION SELECT rule, r FROM near WHERE whichever),
names AS (SELECT unnest({list(_OFFERED)}) AS column_name)
SELECT rule, column_name, CASE WHEN column_name IN {_LEAKY} THEN 'leakage' WHEN (rule, column_name) IN (SELECT (rule, c) FROM low) THEN 'low_variance' WHEN (rule, column_name) IN (SELECT (rule, c) FROM gone) THEN 'correlated' ELSE 'kept' END AS fate
FROM names, settings"""


@_query(_RULES_SQL)
def selection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's fate by the rules alone, of the latest selector and of the older one."""
    made = {"rating_twice": 2 * F.col("official_rating"), "flat": F.lit(1.0), "weight_and_age": F.col("weight_lbs") + F.col("age") / 1000.0}
    frame = store(star.runners(spark, sf_dir).withColumns(made))  # each rule goes over it some times
    fates = []
    for rule, config in (("latest", replace(C.SelectionConfig(), use_model=False)), ("older", C.OLDER_SELECTION)):
        chosen = selection.Selector(config).fit(frame)
        fates += [(rule, c, f) for f in ("leakage", "low_variance", "correlated") for c in chosen.report[f]] + [(rule, c, "kept") for c in chosen.kept]
    return spark.createDataFrame(fates, "rule string, column_name string, fate string")


@_query(", counts AS (SELECT track, count(*) AS n FROM runners GROUP BY track), shares AS (SELECT track, n, sum(n) OVER (ORDER BY n DESC, track) / sum(n) OVER () AS share FROM counts) SELECT track FROM shares WHERE share <= 0.5::DOUBLE OR n = (SELECT max(n) FROM counts WHERE NOT EXISTS (SELECT 1 FROM shares WHERE share <= 0.5::DOUBLE))")
def cumulative_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tracks by their runners the first that make half of all, the one that crosses it left out."""
    counts = star.runners(spark, sf_dir).groupBy(F.col("track").alias("feature")).agg(F.count("*").cast("double").alias("importance"))
    return spark.createDataFrame([(x,) for x in selection.within_cumulative(counts, 0.5)], "track string")


_CAST = ("going", "headgear", "stall", "class", "forecasted_odds", "pos")


@_query("SELECT race_id, row_no, " + ", ".join(f"coalesce({c}, 'missing') AS in_{c}" if c in ("going", "headgear") else f"coalesce(CAST({c} AS DOUBLE), -999) AS in_{c}" for c in _CAST) + ", CAST(-999 AS DOUBLE) AS in_absent FROM runners")
def model_input_casting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clean.model_inputs(star.runners(spark, sf_dir), (*_CAST, "absent"), ("going", "headgear"), "in_")
    return made.select(*KEY, *[f"in_{c}" for c in (*_CAST, "absent")])


@_query()
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the selector keeps of the whole feature table, with its own settings, and each column's fate."""
    split = store(selection.with_split(store(features.build(star.runners(spark, sf_dir)))))
    config = replace(C.SelectionConfig(), permutation=False)  # a report that decides nothing
    chosen = selection.Selector(config).fit(split.where("split = 'train'"), split.where("split = 'val'"))
    r = chosen.report
    fate = [(c, f) for f in ("leakage", "low_variance", "correlated", "unimportant") for c in r[f]] + [(c, "kept") for c in chosen.kept]
    return spark.createDataFrame(fate, "column_name string, fate string")


_CHRONO_SQL = _history_sql(_ALL, ("jockey", "trainer"), True, True, "(SELECT * REPLACE (ifnull(headgear, 'None') AS headgear) FROM runners)", "LEFT JOIN")
_TABLE_SQL = "(SELECT * EXCLUDE (weight_vs_field_median) FROM f)"  # the derived feature of this name takes the place of the field's
for _g in derived.GROUPS:
    _TABLE_SQL = O.add(_g, _TABLE_SQL)
_CHRONO_RESULTS = [*[x for _, x in HORSE_SQL.values()], *[_people_sql(who)[1] for who in _KEEP], _FIELD.rsplit(" FROM ", 1)[0].split("SELECT ")[-1]]
_TABLE_COLUMNS = [c for c in RUNNER_COLUMNS if c not in ("pos", "race_datetime", "date_of_race", "race_date")] + ["horse_elo_pre_race", "elo_implied_prob"]
_TABLE_COLUMNS += [c for x in _CHRONO_RESULTS for c in O.names_of(x) if c != "weight_vs_field_median"] + [c for g in derived.GROUPS for c in O.columns(g)]


@_query(O.recursive(f"{star.SQL} {_CHRONO_SQL} SELECT race_date, {', '.join(f'round({c}, 6) AS {c}' if c not in _TEXTS else c for c in _TABLE_COLUMNS)} FROM {_TABLE_SQL}"))
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chronological and derived features of all runners."""
    made = features.build(star.runners(spark, sf_dir)).drop("race_datetime", "date_of_race", "betting_deadline")
    return made.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


FLAGSHIP = "field_quality_loo"
