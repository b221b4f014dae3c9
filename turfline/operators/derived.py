"""Derived features: projections and race or card windows, as declarative rules (name, inputs, expression).

A rule applies where its inputs are columns; its expression is SQL that both Spark and ANSI engines read, or a pair where
calendars differ. Groups run in order, since later rules read earlier outputs; each step of a group is one select, and
steps share the race's exchange. All flags are 0 for unknown. Deviations and slopes are compared to nine places, so that the
order of a sum never decides a flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline import config as C

Rule = tuple[str, str, str | tuple[str, str]]
RACE = "OVER (PARTITION BY race_id)"


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INT)"


def _flags(*rows: tuple[str, str, str]) -> list[Rule]:
    return [(name, needs, flag(condition)) for name, needs, condition in rows]


def percent_rank(x: str) -> str:
    """Average-tie rank over the number of known values; null for null."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY race_id ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY race_id, {x}) - 1) / 2.0D) / count({x}) {RACE} END"


def min_rank(x: str, descending: bool = False) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY race_id ORDER BY {x} {'DESC' if descending else 'ASC'} NULLS LAST) AS BIGINT) END"


def _map(column: str, scale: dict[str, float], default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in scale.items()) + f" ELSE {default}D END"


_D = "date_of_race"
TEMPORAL: list[list[Rule]] = [
    [
        ("day_of_week", _D, ("weekday(date_of_race)", "CAST(isodow(race_date) - 1 AS INT)")),
        ("day_of_month", _D, ("dayofmonth(date_of_race)", "CAST(day(race_date) AS INT)")),
        ("month", _D, ("month(date_of_race)", "CAST(month(race_date) AS INT)")),
        ("quarter", _D, ("quarter(date_of_race)", "CAST(quarter(race_date) AS INT)")),
        ("year", _D, ("year(date_of_race)", "CAST(year(race_date) AS INT)")),
        ("week_of_year", _D, ("weekofyear(date_of_race)", "CAST(week(race_date) AS INT)")),
        ("day_of_year", _D, ("dayofyear(date_of_race)", "CAST(dayofyear(race_date) AS INT)")),
        ("hour_of_day", "race_datetime", ("hour(race_datetime)", "CAST(race_minute % 1440 // 60 AS INT)")),
        ("race_number_on_card", "race_datetime track", ("CAST(row_number() OVER (PARTITION BY track, date_of_race ORDER BY race_datetime, race_id, row_no) AS BIGINT)", "row_number() OVER (PARTITION BY track, race_date ORDER BY race_minute, race_id, row_no)")),
        ("total_races_on_card", "track", ("count(race_id) OVER (PARTITION BY track, date_of_race)", "count(race_id) OVER (PARTITION BY track, race_date)")),
    ],
    _flags(
        ("is_weekend", "day_of_week", "day_of_week >= 5"),
        ("is_monday", "day_of_week", "day_of_week = 0"),
        ("is_friday", "day_of_week", "day_of_week = 4"),
        ("is_summer", "month", "month BETWEEN 5 AND 9"),
        ("is_winter", "month", "month IN (11, 12, 1, 2)"),
        ("is_spring", "month", "month BETWEEN 3 AND 5"),
        ("is_autumn", "month", "month BETWEEN 9 AND 11"),
        ("flat_season", "month", "month BETWEEN 3 AND 10"),
        ("jumps_season", "month", "month >= 10 OR month <= 4"),
        ("is_morning", "hour_of_day", "hour_of_day < 12"),
        ("is_afternoon", "hour_of_day", "hour_of_day BETWEEN 12 AND 17"),
        ("is_evening", "hour_of_day", "hour_of_day >= 17"),
        ("is_first_race", "race_number_on_card", "race_number_on_card = 1"),
        ("is_last_race", "race_number_on_card", "race_number_on_card = total_races_on_card"),
    )
    + [("race_position_pct", "race_number_on_card", "CAST(race_number_on_card AS DOUBLE) / total_races_on_card")],
]

TRACK: list[list[Rule]] = [
    [
        ("going_firmness_index", "going", _map("going", C.GOING_FIRMNESS, C.GOING_FIRMNESS_DEFAULT)),
        ("track_rarity", "track_frequency", "1.0D / (track_frequency + 1)"),
        ("is_high_class", "class_filled", flag("class_filled >= 5")),
        ("is_low_class", "class_filled", flag("class_filled <= 2")),
        *_flags(
            ("is_soft_ground", "going", "lower(going) LIKE '%soft%' OR lower(going) LIKE '%heavy%' OR lower(going) LIKE '%yielding%'"),
            ("is_good_ground", "going", "lower(going) LIKE '%good%'"),
            ("is_firm_ground", "going", "lower(going) LIKE '%firm%'"),
            ("is_sprint", "distance_m", "distance_m < 1400"),
            ("is_mile", "distance_m", "distance_m BETWEEN 1400 AND 1800"),
            ("is_middle_distance", "distance_m", "distance_m BETWEEN 1800 AND 2400"),
            ("is_staying", "distance_m", "distance_m >= 2400"),
            ("is_handicap", "type", "lower(type) LIKE '%handicap%'"),
            ("is_maiden", "type", "lower(type) LIKE '%maiden%'"),
            ("is_stakes", "type", "lower(type) LIKE '%stakes%' OR lower(type) LIKE '%grade%' OR lower(type) LIKE '%group%' OR lower(type) LIKE '%listed%'"),
            ("is_novice", "type", "lower(type) LIKE '%novice%'"),
        ),
        ("distance_km", "distance_m", "distance_m / 1000"),
        ("distance_furlongs", "distance_m", "distance_m / 201.168D"),
    ]
]

AGE_WEIGHT: list[list[Rule]] = [
    [
        ("age_squared", "age", "CAST(age * age AS DOUBLE)"),
        ("age_cubed", "age", "CAST(age * age * age AS DOUBLE)"),
        *_flags(
            ("is_young_horse", "age", "age < 4"), ("is_prime_age", "age", "age BETWEEN 3 AND 6"), ("is_veteran", "age", "age > 8"),
            ("is_aged_3", "age", "age = 3"), ("is_aged_4", "age", "age = 4"), ("is_aged_5_plus", "age", "age >= 5"),
        ),
        ("weight_vs_field_median", "weight_lbs", f"weight_lbs - median(weight_lbs) {RACE}"),
        ("weight_vs_field_min", "weight_lbs", f"weight_lbs - min(weight_lbs) {RACE}"),
        ("weight_vs_field_max", "weight_lbs", f"weight_lbs - max(weight_lbs) {RACE}"),
        ("weight_percentile_in_race", "weight_lbs", percent_rank("weight_lbs")),
        ("is_top_weight", "weight_lbs", flag(f"weight_lbs = max(weight_lbs) {RACE}")),
        ("is_bottom_weight", "weight_lbs", flag(f"weight_lbs = min(weight_lbs) {RACE}")),
        ("or_percentile_in_race", "official_rating", percent_rank("official_rating")),
        ("or_vs_field_median", "official_rating", f"official_rating - median(official_rating) {RACE}"),
        ("or_vs_field_min", "official_rating", f"official_rating - min(official_rating) {RACE}"),
        ("or_vs_field_max", "official_rating", f"official_rating - max(official_rating) {RACE}"),
        ("is_top_rated", "official_rating", flag(f"official_rating = max(official_rating) {RACE}")),
        ("is_bottom_rated", "official_rating", flag(f"official_rating = min(official_rating) {RACE}")),
        ("weight_per_or_unit", "weight_lbs official_rating", "weight_lbs / nullif(official_rating + 1, 0)"),
        ("age_times_experience", "age total_career_runs", "CAST(age * total_career_runs AS DOUBLE)"),
        ("runs_per_year_of_age", "age total_career_runs", "CAST(total_career_runs AS DOUBLE) / nullif(age + 1, 0)"),
    ]
]

FIELD: list[list[Rule]] = [
    [
        *_flags(("field_size_small", "runners", "runners < 8"), ("field_size_medium", "runners", "runners BETWEEN 8 AND 14"), ("field_size_large", "runners", "runners >= 15")),
        ("log_field_size", "runners", "ln(1.0D + runners)"),
        ("field_or_range", "official_rating", f"max(official_rating) {RACE} - min(official_rating) {RACE}"),
        ("field_competitiveness", "official_rating", f"stddev_samp(official_rating) {RACE} / nullif(avg(official_rating) {RACE} + 1, 0)"),
        ("avg_age_of_field", "age", f"avg(age) {RACE}"),
        ("age_vs_field_avg", "age", f"age - avg(age) {RACE}"),
        ("is_youngest_in_race", "age", flag(f"age = min(age) {RACE}")),
        ("is_oldest_in_race", "age", flag(f"age = max(age) {RACE}")),
        ("avg_experience_of_field", "total_career_runs", f"avg(total_career_runs) {RACE}"),
        ("experience_vs_field_avg", "total_career_runs", f"total_career_runs - avg(total_career_runs) {RACE}"),
        ("is_most_experienced", "total_career_runs", flag(f"total_career_runs = max(total_career_runs) {RACE}")),
        ("is_least_experienced", "total_career_runs", flag(f"total_career_runs = min(total_career_runs) {RACE}")),
        ("stall_filled", "stall", f"coalesce(CAST(stall AS DOUBLE), median(stall) {RACE})"),
    ],
    [
        ("is_low_stall", "stall_filled", flag("stall_filled <= 5")),
        ("is_high_stall", "stall_filled", flag("stall_filled > 10")),
        ("stall_vs_field_size", "stall_filled runners", "stall_filled / nullif(runners + 1, 0)"),
    ],
]

MARKET: list[list[Rule]] = [
    [
        ("log_forecasted_odds", "forecasted_odds", "ln(1.0D + forecasted_odds)"),
        ("implied_prob_forecast", "forecasted_odds", "1.0D / nullif(forecasted_odds + 0.001D, 0)"),
        ("forecast_rank", "forecasted_odds", min_rank("forecasted_odds")),
    ],
    [
        ("is_forecast_favorite", "forecast_rank", flag("forecast_rank = 1")),
        ("is_forecast_outsider", "forecast_rank runners", flag("forecast_rank > 0.75D * runners")),
    ],
]

SPECIALIST: list[list[Rule]] = [
    [
        rule
        for name in ("course", "distance", "surface")
        for rule in _flags(
            (f"{name}_specialist", f"{name}_experience", f"{name}_experience >= 3"),
            (f"{name}_novice", f"{name}_experience", f"{name}_experience = 0"),
            (f"has_{name}_win", f"{name}_win_rate", f"{name}_win_rate > 0"),
        )
    ],
    _flags(
        ("double_specialist", "course_specialist distance_specialist surface_specialist", "course_specialist = 1 AND distance_specialist = 1"),
        ("triple_specialist", "course_specialist distance_specialist surface_specialist", "course_specialist = 1 AND distance_specialist = 1 AND surface_specialist = 1"),
    ),
]

FORM_TREND: list[list[Rule]] = [
    [
        ("place_to_win_ratio", "win_rate_last_5 place_rate_last_5", "CASE WHEN win_rate_last_5 > 0 THEN place_rate_last_5 / win_rate_last_5 ELSE place_rate_last_5 * 5 END"),
        *_flags(
            ("has_recent_win", "win_rate_last_5", "win_rate_last_5 > 0"),
            ("has_recent_place", "place_rate_last_5", "place_rate_last_5 > 0"),
            ("on_winning_streak", "win_streak", "win_streak > 0"),
            ("long_winning_streak", "win_streak", "win_streak >= 2"),
            ("long_dry_spell", "races_since_win", "races_since_win > 10"),
            ("very_long_dry_spell", "races_since_win", "races_since_win > 20"),
            ("recent_winner", "races_since_win", "races_since_win <= 3"),
            ("is_consistent", "pos_consistency", "round(pos_consistency, 9) < 2"),
            ("is_inconsistent", "pos_consistency", "round(pos_consistency, 9) > 4"),
            ("improving_form_binary", "improving_form", "improving_form = 1"),
        ),
    ]
]

_SINCE = "days_since_last_time_out"
RECENCY: list[list[Rule]] = [
    [
        ("log_days_since_last", _SINCE, f"ln(1.0D + {_SINCE})"),
        ("log_avg_days_between", "avg_days_between_races", "ln(1.0D + avg_days_between_races)"),
        *_flags(
            ("fresh_horse", _SINCE, f"{_SINCE} >= 60"), ("very_fresh", _SINCE, f"{_SINCE} >= 90"), ("quick_return", _SINCE, f"{_SINCE} <= 7"),
            ("very_quick_return", _SINCE, f"{_SINCE} <= 3"), ("optimal_rest", _SINCE, f"{_SINCE} BETWEEN 14 AND 30"), ("layoff_0_14_days", _SINCE, f"{_SINCE} <= 14"),
            ("layoff_15_30_days", _SINCE, f"{_SINCE} BETWEEN 15 AND 30"), ("layoff_31_60_days", _SINCE, f"{_SINCE} BETWEEN 31 AND 60"), ("layoff_61_plus_days", _SINCE, f"{_SINCE} > 60"),
            ("frequent_runner", "runs_last_30_days", "runs_last_30_days >= 3"), ("infrequent_runner", "runs_last_30_days", "runs_last_30_days = 0"),
        ),
    ]
]

PEOPLE: list[list[Rule]] = [
    [
        ("jockey_strike_rate_14d", "jockey_form_wins_14d", "CASE WHEN jockey_rides_14d > 0 THEN CAST(jockey_form_wins_14d AS DOUBLE) / jockey_rides_14d ELSE 0.0D END"),
        ("trainer_strike_rate_14d", "trainer_form_wins_14d", "CASE WHEN trainer_runners_14d > 0 THEN CAST(trainer_form_wins_14d AS DOUBLE) / trainer_runners_14d ELSE 0.0D END"),
        ("jockey_horse_combo_rate", "jockey_horse_combo_runs", "CASE WHEN jockey_horse_combo_runs > 0 THEN CAST(jockey_horse_combo_wins AS DOUBLE) / jockey_horse_combo_runs ELSE 0.0D END"),
        *_flags(
            ("proven_combination", "jockey_horse_combo_runs", "jockey_horse_combo_runs >= 3"),
            ("winning_combination", "jockey_horse_combo_runs", "jockey_horse_combo_wins > 0 AND jockey_horse_combo_runs >= 2"),
            ("jockey_busy", "jockey_rides_14d", "jockey_rides_14d > 20"), ("jockey_quiet", "jockey_rides_14d", "jockey_rides_14d < 5"),
            ("trainer_busy", "trainer_runners_14d", "trainer_runners_14d > 10"), ("trainer_quiet", "trainer_runners_14d", "trainer_runners_14d < 3"),
        ),
    ],
    [
        rule
        for who in ("jockey", "trainer")
        for rule in _flags(
            (f"{who}_in_form", f"{who}_strike_rate_14d", f"{who}_strike_rate_14d > 0.15D"),
            (f"{who}_hot_streak", f"{who}_strike_rate_14d", f"{who}_strike_rate_14d > 0.25D"),
            (f"{who}_cold_streak", f"{who}_strike_rate_14d", f"{who}_strike_rate_14d < 0.05D"),
        )
    ],
]

_E = "horse_elo_pre_race"


def second_gap(x: str) -> str:
    """Of the race's best from its second best: 0 for a single runner, null for more of whom at most one is known."""
    best = f"max({x}) {RACE}"
    below = f"max(CASE WHEN _place > 1 THEN {x} END) {RACE}"
    return f"CASE WHEN count(*) {RACE} < 2 THEN 0.0D ELSE {best} - {below} END"


ELO: list[list[Rule]] = [
    [("_place", _E, f"row_number() OVER (PARTITION BY race_id ORDER BY {_E} DESC NULLS LAST, row_no)")],
    [
        ("elo_vs_field_avg", _E, f"{_E} - avg({_E}) {RACE}"),
        ("elo_vs_field_median", _E, f"{_E} - median({_E}) {RACE}"),
        ("elo_vs_field_max", _E, f"{_E} - max({_E}) {RACE}"),
        ("elo_percentile_in_race", _E, percent_rank(_E)),
        ("elo_rank_in_race", _E, min_rank(_E, descending=True)),
        ("_gap", _E, second_gap(_E)),
        *_flags(("elo_high", _E, f"{_E} >= 1600"), ("elo_mid", _E, f"{_E} BETWEEN 1400 AND 1600"), ("elo_low", _E, f"{_E} < 1400")),
        ("log_elo_prob", "elo_implied_prob", "ln(1.0D + elo_implied_prob)"),
        *_flags(("elo_prob_strong", "elo_implied_prob", "elo_implied_prob > 0.25D"), ("elo_prob_weak", "elo_implied_prob", "elo_implied_prob < 0.05D")),
    ],
    [
        *_flags(("is_elo_favorite", "elo_rank_in_race", "elo_rank_in_race = 1"), ("is_elo_top3", "elo_rank_in_race", "elo_rank_in_race <= 3")),
        ("elo_advantage_over_second", "_gap", "CASE WHEN elo_rank_in_race = 1 THEN _gap ELSE 0.0D END"),
    ],
]

RATING_MOMENTUM: list[list[Rule]] = [
    _flags(
        ("or_improving", "or_change_vs_last_race", "or_change_vs_last_race > 0"), ("or_declining", "or_change_vs_last_race", "or_change_vs_last_race < 0"),
        ("or_stable", "or_change_vs_last_race", "or_change_vs_last_race = 0"), ("or_big_jump", "or_change_vs_last_race", "or_change_vs_last_race > 5"),
        ("or_big_drop", "or_change_vs_last_race", "or_change_vs_last_race < -5"), ("or_uptrend", "or_trend_last_5", "round(or_trend_last_5, 9) > 0.5D"),
        ("or_downtrend", "or_trend_last_5", "round(or_trend_last_5, 9) < -0.5D"), ("or_momentum_positive", "or_momentum_short_term", "or_momentum_short_term > 0"),
        ("or_momentum_negative", "or_momentum_short_term", "or_momentum_short_term < 0"),
    )
]

HEADGEAR: list[list[Rule]] = [
    [
        *_flags(
            ("has_headgear", "headgear", "headgear <> 'None'"), ("has_blinkers", "headgear", "lower(headgear) LIKE '%blinker%'"), ("has_visor", "headgear", "lower(headgear) LIKE '%visor%'"),
            ("has_cheekpieces", "headgear", "lower(headgear) LIKE '%cheek%'"), ("has_hood", "headgear", "lower(headgear) LIKE '%hood%'"), ("has_tongue_tie", "headgear", "lower(headgear) LIKE '%tongue%'"),
            ("first_time_gear", "headgear_first_time", "headgear_first_time = 1"), ("gear_changed", "headgear_change", "headgear_change = 1"),
        )
    ]
]

CLASS: list[list[Rule]] = [
    [
        *_flags(("up_in_class", "moving_up_in_class", "moving_up_in_class = 1"), ("down_in_class", "moving_down_in_class", "moving_down_in_class = 1")),
        ("class_vs_field_avg", "class", f"class - avg(class) {RACE}"),
    ]
]

INTERACTIONS: list[list[Rule]] = [
    [
        ("elo_squared", _E, f"{_E} * {_E}"), ("elo_times_course_exp", f"{_E} course_experience", f"{_E} * course_experience"),
        ("elo_times_distance_exp", f"{_E} distance_experience", f"{_E} * distance_experience"), ("elo_per_day_since_last", f"{_E} {_SINCE}", f"{_E} / nullif({_SINCE} + 1, 0)"),
        ("field_quality_squared", "field_quality_avg_or", "field_quality_avg_or * field_quality_avg_or"),
        ("or_times_field_quality", "official_rating field_quality_avg_or", "official_rating * field_quality_avg_or"),
        ("or_squared", "official_rating", "official_rating * official_rating"), ("or_times_surface_wr", "official_rating surface_win_rate", "official_rating * surface_win_rate"),
        ("or_per_weight", "official_rating weight_lbs", "official_rating / nullif(weight_lbs + 1, 0)"), ("wr_times_experience", "win_rate_last_5 total_career_runs", "win_rate_last_5 * total_career_runs"),
        ("age_times_career_runs", "age total_career_runs", "CAST(age * total_career_runs AS DOUBLE)"), ("age_times_rating", "age official_rating", "age * official_rating"),
        ("course_times_distance_exp", "course_experience distance_experience", "CAST(course_experience * distance_experience AS DOUBLE)"),
        ("jockey_trainer_combined_form", "jockey_strike_rate_14d trainer_strike_rate_14d", "(jockey_strike_rate_14d + trainer_strike_rate_14d) / 2"),
        ("jockey_times_trainer_form", "jockey_strike_rate_14d trainer_strike_rate_14d", "jockey_strike_rate_14d * trainer_strike_rate_14d"),
        ("distance_change_squared", "actual_distance_change_m", "actual_distance_change_m * actual_distance_change_m"), ("distance_change_abs", "actual_distance_change_m", "abs(actual_distance_change_m)"),
    ]
]

#: Features of the older generation that read starting prices.
LEGACY_MARKET: list[list[Rule]] = [
    [
        ("bsp_rank", "betfair_sp", min_rank("betfair_sp")),
        ("implied_prob_bsp", "betfair_sp", "1.0D / nullif(betfair_sp, 0)"),
        ("log_betfair_sp", "betfair_sp", "ln(1.0D + betfair_sp)"),
        ("odds_drift_forecast_to_bsp", "betfair_sp forecasted_odds", "betfair_sp - forecasted_odds"),
        ("odds_gap_to_favorite", "betfair_sp", f"betfair_sp - min(betfair_sp) {RACE}"),
        ("or_vs_field_quality", "official_rating field_quality_avg_or", "official_rating - field_quality_avg_or"),
        ("is_winner", "won", flag("won = 1")),
        ("prime_age", "age", flag("age BETWEEN 3 AND 5")),
    ],
    [
        ("market_book_percentage", "implied_prob_bsp", f"coalesce(sum(implied_prob_bsp) {RACE}, 0.0D)"),
        ("is_favorite", "bsp_rank sp_fav", flag("sp_fav = 1")),
        ("is_favorite", "bsp_rank", flag("bsp_rank = 1")),
        ("is_second_favorite", "bsp_rank", flag("bsp_rank = 2")),
        ("is_outsider", "bsp_rank runners", flag("bsp_rank > 0.75D * runners")),
        ("odds_drift_pct", "odds_drift_forecast_to_bsp", "odds_drift_forecast_to_bsp / nullif(forecasted_odds, 0)"),
        ("odds_shortened", "odds_drift_forecast_to_bsp", flag("odds_drift_forecast_to_bsp < 0")),
        ("odds_drifted", "odds_drift_forecast_to_bsp", flag("odds_drift_forecast_to_bsp > 0")),
        ("fav_prob_concentration", "implied_prob_bsp", f"CASE WHEN sum(implied_prob_bsp) {RACE} > 0 THEN max(implied_prob_bsp) {RACE} / sum(implied_prob_bsp) {RACE} ELSE 0.0D END"),
        ("value_signal_elo_vs_bsp", "implied_prob_bsp elo_implied_prob", "elo_implied_prob - implied_prob_bsp"),
        ("above_average_runner", "or_vs_field_quality", flag("or_vs_field_quality > 0")),
    ],
    [
        ("weak_favorite", "is_favorite betfair_sp", flag("is_favorite = 1 AND betfair_sp > 4")),
        ("place_to_win_ratio", "win_rate_last_5 place_rate_last_5", "CASE WHEN win_rate_last_5 > 0 THEN place_rate_last_5 / win_rate_last_5 END"),
    ],
]

GROUPS: dict[str, list[list[Rule]]] = {
    "temporal": TEMPORAL, "track": TRACK, "age_weight": AGE_WEIGHT, "field": FIELD, "market": MARKET, "specialist": SPECIALIST, "form_trend": FORM_TREND,
    "recency": RECENCY, "people": PEOPLE, "elo": ELO, "rating_momentum": RATING_MOMENTUM, "headgear": HEADGEAR, "class": CLASS, "interactions": INTERACTIONS,
}


def with_global_statistics(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """track_frequency and class_filled, from counts and the median of fit_on, else of all rows (which then sees the future)."""
    source = df if fit_on is None else fit_on
    if "track" in df.columns:
        counts = source.groupBy("track").agg(F.count("*").alias("track_frequency"))
        df = df.drop("track_frequency").join(counts, "track", "left")
    if "class" in df.columns:
        middle = source.agg(F.median("class")).first()[0]
        df = df.withColumn("class_filled", F.coalesce(F.col("class").cast("double"), F.lit(middle).cast("double")))
    return df


def applicable(steps: Sequence[Sequence[Rule]], columns: Sequence[str]) -> list[list[Rule]]:
    """The rules of each step whose inputs are there by then; of rules with one name the first."""
    have, out = set(columns), []
    for step in steps:
        fit: dict[str, Rule] = {}
        for rule in step:
            if set(rule[1].split()) <= have:
                fit.setdefault(rule[0], rule)
        out.append(list(fit.values()))
        have |= set(fit)
    return out


def apply(df: DataFrame, group: str | Sequence[Sequence[Rule]]) -> DataFrame:
    """df with the features of a group whose inputs it has; names that it had already are replaced."""
    steps = applicable(GROUPS[group] if isinstance(group, str) else group, df.columns)
    helpers = [r[0] for step in steps for r in step if r[0].startswith("_")]
    for step in steps:
        made = {name: F.expr(text if isinstance(text, str) else text[0]) for name, _, text in step}
        df = df.select(*[c for c in df.columns if c not in made], *[v.alias(k) for k, v in made.items()])
    return df.drop(*helpers)


def names_of(group: str | Sequence[Sequence[Rule]], columns: Sequence[str]) -> list[str]:
    steps = applicable(GROUPS[group] if isinstance(group, str) else group, columns)
    return [r[0] for step in steps for r in step if not r[0].startswith("_")]


#: Groups that read nothing but what a runner came with.
EARLY = ("temporal",)


def early_groups(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Global statistics and EARLY groups: made while rows are narrow, since their windows go by card and not by race."""
    df = with_global_statistics(df, fit_on)
    for g in EARLY:
        df = apply(df, g)
    return df


def all_groups(df: DataFrame, legacy: bool = False, fit_on: DataFrame | None = None, early: bool = False) -> DataFrame:
    """early: df has early_groups() already."""
    df = df if early else early_groups(df, fit_on)
    for g in GROUPS:
        if g not in EARLY:
            df = apply(df, g)
    return apply(df, LEGACY_MARKET) if legacy else df
