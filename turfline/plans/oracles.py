"""SQL for the registered queries' comparison, written from the features' definitions, apart from the rules that the engine runs.

A group is a list of steps; a step names its columns with their SQL, `~` before those that are doubles. A later step may
read an earlier one's columns. Unknown is 0 in flags: CASE takes its ELSE.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

Step = Mapping[str, str]


def _yes(**conditions: str) -> dict[str, str]:
    return {name: f"CASE WHEN {c} THEN 1 ELSE 0 END" for name, c in conditions.items()}


def _share_of_race(x: str) -> str:
    """Average rank of x in its race as a share of the known ones: those below, half of the others that are equal, and itself."""
    upto = f"count({x}) OVER (PARTITION BY race_id ORDER BY {x} RANGE UNBOUNDED PRECEDING)"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE ({upto} - (count({x}) OVER (PARTITION BY race_id, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY race_id) END"


def _better(x: str, order: str) -> str:
    """One more than there are better known values in the race."""
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE rank() OVER (PARTITION BY race_id ORDER BY {x} {order} NULLS LAST) END"


def _against(x: str, f: str) -> str:
    return f"{x} - {f}({x}) OVER (PARTITION BY race_id)"


def _is(x: str, f: str) -> str:
    return f"{x} = {f}({x}) OVER (PARTITION BY race_id)"


def _days(low: int | None, high: int | None) -> str:
    d = "days_since_last_time_out"
    return " AND ".join(x for x in (low is not None and f"{d} >= {low}", high is not None and f"{d} <= {high}") if x)


GROUPS: dict[str, list[Step]] = {
    "temporal": [
        {
            "day_of_week": "CAST((dayofweek(race_date) + 6) % 7 AS INT)",
            **{name: f"CAST(date_part('{part}', race_date) AS INT)" for name, part in (("day_of_month", "day"), ("month", "month"), ("quarter", "quarter"), ("year", "year"), ("week_of_year", "week"), ("day_of_year", "doy"))},
            "hour_of_day": "CAST((race_minute // 60) % 24 AS INT)",
            "race_number_on_card": "count(*) OVER (PARTITION BY track, race_date ORDER BY race_minute, race_id, row_no ROWS UNBOUNDED PRECEDING)",
            "total_races_on_card": "count(*) OVER (PARTITION BY track, race_date)",
        },
        {
            **_yes(
                is_weekend="day_of_week IN (5, 6)", is_monday="day_of_week = 0", is_friday="day_of_week = 4", is_summer="month IN (5, 6, 7, 8, 9)", is_winter="month IN (11, 12, 1, 2)",
                is_spring="month IN (3, 4, 5)", is_autumn="month IN (9, 10, 11)", flat_season="month IN (3, 4, 5, 6, 7, 8, 9, 10)", jumps_season="month IN (10, 11, 12, 1, 2, 3, 4)",
                is_morning="hour_of_day IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)", is_afternoon="hour_of_day IN (12, 13, 14, 15, 16, 17)", is_evening="hour_of_day IN (17, 18, 19, 20, 21, 22, 23)",
                is_first_race="race_number_on_card = 1", is_last_race="race_number_on_card = total_races_on_card",
            ),
            "~race_position_pct": "race_number_on_card / total_races_on_card",
        },
    ],
    "track": [
        {
            "track_frequency": "count(*) OVER (PARTITION BY track)",
            "~class_filled": "ifnull(class::DOUBLE, (SELECT median(class) FROM runners))",
            "~going_firmness_index": "ifnull(map {'Heavy': 1::DOUBLE, 'Soft': 2, 'Yielding': 3, 'Good to Soft': 4, 'Good to Yielding': 4.5, 'Good': 5, 'Good to Firm': 6, 'Firm': 7, 'Standard': 5, 'Standard to Slow': 3, 'Slow': 2, 'Fast': 6}[going], 5)",
            **_yes(
                is_soft_ground="regexp_matches(going, 'Soft|Heavy|Yielding', 'i')", is_good_ground="contains(lower(going), 'good')", is_firm_ground="contains(lower(going), 'firm')",
                is_sprint="distance_m < 1400", is_mile="distance_m >= 1400 AND distance_m <= 1800", is_middle_distance="distance_m >= 1800 AND distance_m <= 2400", is_staying="distance_m >= 2400",
                is_handicap="contains(lower(type), 'handicap')", is_maiden="contains(lower(type), 'maiden')", is_stakes="regexp_matches(type, 'Stakes|Grade|Group|Listed', 'i')", is_novice="contains(lower(type), 'novice')",
            ),
            "~distance_km": "distance_m / 1000",
            "~distance_furlongs": "distance_m / 201.168::DOUBLE",
        },
        {"~track_rarity": "1 / (track_frequency + 1)", **_yes(is_high_class="class_filled >= 5", is_low_class="class_filled <= 2")},
    ],
    "age_weight": [
        {
            "~age_squared": "pow(age, 2)",
            "~age_cubed": "pow(age, 3)",
            **_yes(
                is_young_horse="age <= 3", is_prime_age="age IN (3, 4, 5, 6)", is_veteran="age >= 9", is_aged_3="age = 3", is_aged_4="age = 4", is_aged_5_plus="age >= 5",
                is_top_weight=_is("weight_lbs", "max"), is_bottom_weight=_is("weight_lbs", "min"), is_top_rated=_is("official_rating", "max"), is_bottom_rated=_is("official_rating", "min"),
            ),
            **{f"~weight_vs_field_{f}": _against("weight_lbs", f) for f in ("median", "min", "max")},
            **{f"~or_vs_field_{f}": _against("official_rating", f) for f in ("median", "min", "max")},
            "~weight_percentile_in_race": _share_of_race("weight_lbs"),
            "~or_percentile_in_race": _share_of_race("official_rating"),
            "~weight_per_or_unit": "weight_lbs / (official_rating + 1)",
            "~age_times_experience": "total_career_runs * age::DOUBLE",
            "~runs_per_year_of_age": "total_career_runs / (1 + age)",
        }
    ],
    "field": [
        {
            **_yes(
                field_size_small="runners <= 7", field_size_medium="runners >= 8 AND runners <= 14", field_size_large="runners > 14", is_youngest_in_race=_is("age", "min"), is_oldest_in_race=_is("age", "max"),
                is_most_experienced=_is("total_career_runs", "max"), is_least_experienced=_is("total_career_runs", "min"),
            ),
            "~log_field_size": "ln(runners + 1)",
            "~field_or_range": "max(official_rating) OVER (PARTITION BY race_id) - min(official_rating) OVER (PARTITION BY race_id)",
            "~field_competitiveness": "stddev_samp(official_rating) OVER (PARTITION BY race_id) / (1 + avg(official_rating) OVER (PARTITION BY race_id))",
            "~avg_age_of_field": "avg(age) OVER (PARTITION BY race_id)",
            "~age_vs_field_avg": _against("age", "avg"),
            "~avg_experience_of_field": "avg(total_career_runs) OVER (PARTITION BY race_id)",
            "~experience_vs_field_avg": _against("total_career_runs", "avg"),
            "~stall_filled": "ifnull(stall::DOUBLE, median(stall) OVER (PARTITION BY race_id))",
        },
        {**_yes(is_low_stall="stall_filled <= 5", is_high_stall="stall_filled > 10"), "~stall_vs_field_size": "stall_filled / (1 + runners)"},
    ],
    "market": [
        {"~log_forecasted_odds": "ln(forecasted_odds + 1)", "~implied_prob_forecast": "1 / (0.001::DOUBLE + forecasted_odds)", "forecast_rank": _better("forecasted_odds", "ASC")},
        _yes(is_forecast_favorite="forecast_rank = 1", is_forecast_outsider="4 * forecast_rank > 3 * runners"),
    ],
    "specialist": [
        {
            **{k: v for what in ("course", "distance", "surface") for k, v in _yes(**{f"{what}_specialist": f"{what}_experience > 2", f"{what}_novice": f"{what}_experience = 0", f"has_{what}_win": f"{what}_win_rate > 0"}).items()},
            **_yes(double_specialist="least(course_experience, distance_experience) > 2", triple_specialist="least(course_experience, distance_experience, surface_experience) > 2"),
        }
    ],
    "form_trend": [
        {
            "~place_to_win_ratio": "place_rate_last_5 * CASE WHEN win_rate_last_5 > 0 THEN 1 / win_rate_last_5 ELSE 5 END",
            **_yes(
                has_recent_win="win_rate_last_5 > 0", has_recent_place="place_rate_last_5 > 0", on_winning_streak="win_streak >= 1", long_winning_streak="win_streak > 1", long_dry_spell="races_since_win >= 11",
                very_long_dry_spell="races_since_win >= 21", recent_winner="races_since_win < 4", is_consistent="round(pos_consistency, 9) < 2", is_inconsistent="round(pos_consistency, 9) > 4", improving_form_binary="improving_form <> 0",
            ),
        }
    ],
    "recency": [
        {
            "~log_days_since_last": "ln(days_since_last_time_out + 1)",
            "~log_avg_days_between": "ln(avg_days_between_races + 1)",
            **_yes(
                fresh_horse=_days(60, None), very_fresh=_days(90, None), quick_return=_days(None, 7), very_quick_return=_days(None, 3), optimal_rest=_days(14, 30), layoff_0_14_days=_days(None, 14),
                layoff_15_30_days=_days(15, 30), layoff_31_60_days=_days(31, 60), layoff_61_plus_days=_days(61, None), frequent_runner="runs_last_30_days > 2", infrequent_runner="runs_last_30_days = 0",
            ),
        }
    ],
    "people": [
        {
            "~jockey_strike_rate_14d": "ifnull(jockey_form_wins_14d / nullif(jockey_rides_14d, 0), 0)",
            "~trainer_strike_rate_14d": "ifnull(trainer_form_wins_14d / nullif(trainer_runners_14d, 0), 0)",
            "~jockey_horse_combo_rate": "ifnull(jockey_horse_combo_wins / nullif(jockey_horse_combo_runs, 0), 0)",
            **_yes(
                proven_combination="jockey_horse_combo_runs > 2", winning_combination="jockey_horse_combo_runs > 1 AND jockey_horse_combo_wins > 0", jockey_busy="jockey_rides_14d > 20", jockey_quiet="jockey_rides_14d < 5",
                trainer_busy="trainer_runners_14d > 10", trainer_quiet="trainer_runners_14d < 3",
            ),
        },
        {k: v for who in ("jockey", "trainer") for k, v in _yes(**{f"{who}_in_form": f"{who}_strike_rate_14d > 0.15::DOUBLE", f"{who}_hot_streak": f"{who}_strike_rate_14d > 0.25", f"{who}_cold_streak": f"{who}_strike_rate_14d < 0.05::DOUBLE"}).items()},
    ],
    "elo": [
        {
            **{f"~elo_vs_field_{f}": _against("horse_elo_pre_race", g) for f, g in (("avg", "avg"), ("median", "median"), ("max", "max"))},
            "~elo_percentile_in_race": _share_of_race("horse_elo_pre_race"),
            "elo_rank_in_race": _better("horse_elo_pre_race", "DESC"),
            "two_best": "list_reverse_sort(list(horse_elo_pre_race) FILTER (WHERE horse_elo_pre_race IS NOT NULL) OVER (PARTITION BY race_id))[1:2]",
            "~log_elo_prob": "ln(elo_implied_prob + 1)",
            **_yes(
                elo_high="horse_elo_pre_race >= 1600", elo_mid="horse_elo_pre_race >= 1400 AND horse_elo_pre_race <= 1600", elo_low="horse_elo_pre_race < 1400", elo_prob_strong="elo_implied_prob > 0.25",
                elo_prob_weak="elo_implied_prob < 0.05::DOUBLE",
            ),
        },
        {**_yes(is_elo_favorite="elo_rank_in_race = 1", is_elo_top3="elo_rank_in_race < 4"), "~elo_advantage_over_second": "CASE WHEN coalesce(elo_rank_in_race, 0) <> 1 OR count(*) OVER (PARTITION BY race_id) = 1 THEN 0 ELSE two_best[1] - two_best[2] END"},
    ],
    "rating_momentum": [
        _yes(
            or_improving="or_change_vs_last_race > 0", or_declining="or_change_vs_last_race < 0", or_stable="or_change_vs_last_race = 0", or_big_jump="or_change_vs_last_race > 5", or_big_drop="-or_change_vs_last_race > 5",
            or_uptrend="round(or_trend_last_5, 9) > 0.5", or_downtrend="round(or_trend_last_5, 9) < -0.5", or_momentum_positive="or_momentum_short_term > 0", or_momentum_negative="or_momentum_short_term < 0",
        )
    ],
    "headgear": [
        _yes(
            has_headgear="headgear IS NOT NULL AND headgear <> 'None'", has_blinkers="headgear ILIKE '%Blinker%'", has_visor="headgear ILIKE '%Visor%'", has_cheekpieces="headgear ILIKE '%Cheek%'", has_hood="headgear ILIKE '%Hood%'",
            has_tongue_tie="headgear ILIKE '%Tongue%'", first_time_gear="headgear_first_time <> 0", gear_changed="headgear_change <> 0",
        )
    ],
    "class": [{**_yes(up_in_class="moving_up_in_class <> 0", down_in_class="moving_down_in_class <> 0"), "~class_vs_field_avg": _against("class", "avg")}],
    "interactions": [
        {
            "~elo_squared": "pow(horse_elo_pre_race, 2)", "~elo_times_course_exp": "course_experience * horse_elo_pre_race", "~elo_times_distance_exp": "distance_experience * horse_elo_pre_race",
            "~elo_per_day_since_last": "horse_elo_pre_race / (1 + days_since_last_time_out)", "~field_quality_squared": "pow(field_quality_avg_or, 2)", "~or_times_field_quality": "field_quality_avg_or * official_rating",
            "~or_squared": "pow(official_rating, 2)", "~or_times_surface_wr": "surface_win_rate * official_rating", "~or_per_weight": "official_rating / (1 + weight_lbs)", "~wr_times_experience": "total_career_runs * win_rate_last_5",
            "~age_times_career_runs": "total_career_runs * age::DOUBLE", "~age_times_rating": "official_rating * age", "~course_times_distance_exp": "distance_experience * course_experience::DOUBLE",
            "~jockey_trainer_combined_form": "trainer_strike_rate_14d / 2 + jockey_strike_rate_14d / 2", "~jockey_times_trainer_form": "trainer_strike_rate_14d * jockey_strike_rate_14d",
            "~distance_change_squared": "pow(actual_distance_change_m, 2)", "~distance_change_abs": "greatest(actual_distance_change_m, -actual_distance_change_m)",
        }
    ],
    "legacy_market": [
        {
            "bsp_rank": _better("betfair_sp", "ASC"), "~implied_prob_bsp": "CASE WHEN betfair_sp <> 0 THEN 1 / betfair_sp END", "~log_betfair_sp": "ln(betfair_sp + 1)", "~odds_drift_forecast_to_bsp": "betfair_sp - forecasted_odds",
            "~odds_gap_to_favorite": _against("betfair_sp", "min"), "~or_vs_field_quality": "official_rating - field_quality_avg_or",
            "~place_to_win_ratio": "CASE WHEN win_rate_last_5 > 0 THEN place_rate_last_5 / win_rate_last_5 END",
            **_yes(is_winner="won = 1", prime_age="age IN (3, 4, 5)"),
        },
        {
            "~market_book_percentage": "ifnull(sum(implied_prob_bsp) OVER (PARTITION BY race_id), 0)",
            "~odds_drift_pct": "(betfair_sp - forecasted_odds) / nullif(forecasted_odds, 0)",
            "~fav_prob_concentration": "ifnull(max(implied_prob_bsp) OVER (PARTITION BY race_id) / nullif(sum(implied_prob_bsp) OVER (PARTITION BY race_id), 0), 0)",
            "~value_signal_elo_vs_bsp": "elo_implied_prob - implied_prob_bsp",
            **_yes(
                is_favorite="bsp_rank = 1", is_second_favorite="bsp_rank = 2", is_outsider="4 * bsp_rank > 3 * runners", odds_shortened="betfair_sp < forecasted_odds", odds_drifted="betfair_sp > forecasted_odds",
                above_average_runner="or_vs_field_quality > 0", weak_favorite="bsp_rank = 1 AND betfair_sp > 4",
            ),
        },
    ],
}


def columns(group: str) -> dict[str, bool]:
    """Names of a group's columns, and whether they are doubles."""
    return {c.lstrip("~"): c[0] == "~" for step in GROUPS[group] for c in step if c != "two_best"}


def add(group: str, source: str) -> str:
    """A subquery of all columns of source and those of a group."""
    for step in GROUPS[group]:
        made = ", ".join(f"{sql} AS {name.lstrip('~')}" for name, sql in step.items())
        source = f"(SELECT *, {made} FROM {source})"
    return source


def select(groups: Sequence[str], source: str, wanted: Sequence[str] | None = None) -> str:
    """race_id, row_no and the wanted columns of groups, all by default; doubles to six places."""
    kinds: dict[str, bool] = {}
    for group in groups:
        source = add(group, source)
        kinds |= columns(group)
    names = kinds if wanted is None else wanted
    return f"SELECT race_id, row_no, {', '.join(f'round({c}, 6) AS {c}' if kinds[c] else c for c in names)} FROM {source}"


# -- histories --------------------------------------------------------------------------------------------------------

#: The runners of races with two at least, numbered in the order of races for each entity.
BASE = ", base AS (SELECT * REPLACE (ifnull(headgear, 'None') AS headgear) FROM (SELECT *, count(*) OVER (PARTITION BY race_id) AS n_in_race FROM runners) WHERE n_in_race >= 2)"


def seen(entity: str, keep: int, deadline: int | None = 5) -> str:
    """CTEs that end in <entity>_seen: a row for each visible record of each runner, back = 1 for the latest."""
    e, visible = entity, "" if deadline is None else f" AND b.race_minute < a.race_minute - {deadline}"
    return f""", {e}_rows AS (SELECT *, row_number() OVER (PARTITION BY {e} ORDER BY race_minute, race_id, row_no) AS seq FROM base),
{e}_firsts AS (SELECT *, min(seq) OVER (PARTITION BY {e}, race_id) AS first_seq FROM {e}_rows),
{e}_seen AS (
  SELECT a.race_id, a.row_no, row_number() OVER (PARTITION BY a.race_id, a.row_no ORDER BY b.seq DESC) AS back, coalesce(b.pos, 99) AS p, b.won AS w, b.placed AS q, b.official_rating AS o, b.class AS c, b.going AS g,
         b.distance_m AS d, b.course AS k, b.jockey AS j, b.trainer AS t, b.headgear AS h, date_diff('day', b.race_date, a.race_date) AS days, a.going AS a_going, a.distance_m AS a_distance, a.course AS a_course, a.jockey AS a_jockey, a.trainer AS a_trainer
  FROM {e}_firsts a JOIN {e}_firsts b ON a.{e} = b.{e} AND b.seq BETWEEN a.first_seq - {keep} AND a.first_seq - 1{visible}
)"""


def part(name: str, entity: str, aggregates: str, result: str) -> str:
    """CTEs that end in <name>: race_id, row_no and the result columns, over base with the aggregates of what each runner sees."""
    return f", {name}_agg AS (SELECT race_id, row_no, count(*) AS n_seen, {aggregates} FROM {entity}_seen GROUP BY race_id, row_no), {name} AS (SELECT base.race_id, base.row_no, {result} FROM base LEFT JOIN {name}_agg USING (race_id, row_no))"


def names_of(result: str) -> list[str]:
    return re.findall(r" AS (\w+)(?=, |,?\n|$)", result)


def unrounded(result: str) -> str:
    return re.sub(r"round\((.*?), 6\) AS", r"\1 AS", result)


#: Ratings by a recursion that takes, in each step, all races whose runners' earlier races are done. Ends in `ratings`; needs WITH RECURSIVE.
RATINGS = """, elo_rows AS MATERIALIZED (
  SELECT race_id, row_no, horse, pos, n_in_race - 1 AS rivals, row_number() OVER (PARTITION BY horse ORDER BY race_minute, race_id, row_no) AS run,
         count(*) FILTER (WHERE pos IS NULL) OVER (PARTITION BY race_id) AS missing, list(pos) OVER (PARTITION BY race_id) AS places FROM base
), elo_scored AS MATERIALIZED (
  SELECT race_id, row_no, horse, run, rivals, CASE WHEN pos IS NULL THEN 0 ELSE (len(list_filter(places, lambda x: x > pos)) + 2 * missing) / rivals END AS actual FROM elo_rows
), done(horse, run, race_id, row_no, pre, post) USING KEY (horse, run) AS (
  SELECT DISTINCT horse, 0::BIGINT, NULL::VARCHAR, 0, NULL::DOUBLE, 1500::DOUBLE FROM elo_scored
  UNION
  SELECT a.horse, a.run, a.race_id, a.row_no, a.before, least(2500, greatest(1000, a.rated + 0.005::DOUBLE * (1500 - a.rated)))
  FROM (
    SELECT r.horse, r.run, r.race_id, r.row_no, r.before, r.before + 32 * (r.actual - avg(1 / (1 + pow(10::DOUBLE, (o.before - r.before) / 400)))) AS rated
    FROM (SELECT s.*, d.post AS before, count(d.post) OVER (PARTITION BY s.race_id) AS ready FROM elo_scored s LEFT JOIN recurring.done d ON s.horse = d.horse AND s.run = d.run + 1
          WHERE NOT EXISTS (SELECT 1 FROM recurring.done x WHERE x.horse = s.horse AND x.run = s.run)) r
    JOIN (SELECT s.race_id, s.row_no, d.post AS before FROM elo_scored s JOIN recurring.done d ON s.horse = d.horse AND s.run = d.run + 1) o ON o.race_id = r.race_id AND o.row_no <> r.row_no
    WHERE r.ready = r.rivals + 1
    GROUP BY r.horse, r.run, r.race_id, r.row_no, r.before, r.actual
  ) a
), ratings AS (
  SELECT race_id, row_no, horse, run, pre AS horse_elo_pre_race, pow(10::DOUBLE, pre / 400) / sum(pow(10::DOUBLE, pre / 400)) OVER (PARTITION BY race_id) AS elo_implied_prob, post FROM done WHERE run > 0
)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
