import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from reference_model import fold

from turfline import config as C
from turfline.operators import chrono, derived, elo, history
from turfline.plans import features

START = datetime(2024, 1, 1, 12)
SCHEMA = (
    "race_id string, row_no int, race_datetime timestamp_ntz, date_of_race timestamp_ntz, track string, course string, horse string, jockey string, trainer string, pos double, won int, placed int,"
    "official_rating double, weight_lbs double, distance_m double, going string, headgear string, class int, age int, stall int, runners int, type string, forecasted_odds double"
)


def card(seed, races=120, horses=25, gaps=True):
    r = random.Random(seed)
    rows = []
    minute = 0
    for k in range(races):
        minute += r.choice([0, 2, 4, 200, 3000]) if gaps else 600
        field = r.sample(range(horses), r.choice([1, 2, 3, 5, 8]))
        order = r.sample(range(len(field)), len(field))
        at = START + timedelta(minutes=minute)
        for n, (h, p) in enumerate(zip(field, order, strict=True)):
            pos = None if r.random() < 0.1 else 99.0 if r.random() < 0.05 else float(p + 1)
            jockey = None if r.random() < 0.05 else f"j{r.randrange(6)}"
            rows.append((f"r{k:04}", n + 1, at, at.replace(hour=0, minute=0), f"t{k % 3}", f"t{k % 3}", f"h{h}", jockey, f"s{r.randrange(3)}", pos, int(pos == 1), int(pos in (1, 2)), 50.0 + r.randrange(40), 120.0 + r.randrange(30), r.choice([1000.0, 1150.0, 2400.0]), r.choice(["Good", "Soft", "odd"]), r.choice(["None", "Hood"]), r.choice([1, 2, None]), 3, n + 1, len(field), "Handicap", 3.5))
    return rows


def model(rows, keep):
    dicts = [dict(race_id=x[0], row_no=x[1], at=(x[2] - datetime(1970, 1, 1)).total_seconds(), horse=x[6], jockey=x[7], trainer=x[8], pos=x[9], won=x[10], placed=x[11]) for x in rows]
    return fold(dicts, keep, C.EloConfig())


def seconds_of(x):
    return (x - datetime(1970, 1, 1)).total_seconds()


@pytest.mark.parametrize("deadline", [5, 0, None])
@pytest.mark.parametrize("entity,keep,chunk", [("jockey", 7, 10), ("trainer", 9, 15), ("trainer", 1, 1), ("jockey", 100, 50_000)])
def test_counts_equal_the_fold(spark, entity, keep, chunk, deadline):
    """An entity rides several horses of a race here, so chunks and evictions fall inside races."""
    rows = card(4)
    column = {"jockey": 7, "trainer": 8}[entity]
    config = C.HistoryConfig(chunk_rows=chunk, deadline_minutes=deadline)
    got = history.with_counts(history.eligible(spark.createDataFrame(rows, SCHEMA)), entity, keep, (1, 14), config).collect()
    races = {}
    for x in rows:
        races.setdefault((x[2], x[0]), []).append(x)
    past, want = {}, {}
    for _, race in sorted(races.items()):
        if len(race) < 2:
            continue
        for x in race:
            if x[column] is not None:
                seen = [y for y in past.get(x[column], [])[-keep:] if deadline is None or seconds_of(y[2]) < seconds_of(x[2]) - 60 * deadline]
                want[x[:2]] = [tuple(sum(v) for v in zip((0, 0, 0), *[(1, y[10], y[11]) for y in seen if (x[3] - y[3]).days <= d], strict=True)) for d in (1, 14)]
        for x in race:
            past.setdefault(x[column], []).append(x)
    assert {(x.race_id, x.row_no): [tuple(x._seen_1), tuple(x._seen_14)] for x in got} == want


@pytest.mark.parametrize("entity,keep,chunk", [("horse", 4, 6), ("jockey", 7, 10), ("trainer", 9, 15), ("trainer", 150, 50_000)])
def test_histories_equal_the_fold(spark, entity, keep, chunk):
    rows = card(3)
    config = C.HistoryConfig(chunk_rows=chunk)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = history.with_history(history.eligible(frame), entity, keep, ("position", "won"), "seen", config).collect()
    want, _ = model(rows, {entity: keep})
    assert len(got) == sum(1 for x in want.values() if entity in x["seen"])
    for x in got:
        expected = [(99.0 if y["pos"] is None else y["pos"], y["won"] == 1) for y in want[(x.race_id, x.row_no)]["seen"][entity]]
        assert [(y.position, y.won) for y in x.seen] == expected


def test_ratings_equal_the_fold(spark):
    rows = card(5)
    want, final = model(rows, {"horse": 30})
    frame = spark.createDataFrame(rows, SCHEMA)
    rated = elo.ratings(frame)
    got = {(x.race_id, x.row_no): x for x in rated.collect()}
    assert set(got) == set(want)
    for k, x in got.items():
        a, b = x.horse_elo_pre_race, want[k]["elo"]
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-4)
    last = {x.horse: x.elo for x in elo.final_ratings(rated, frame).collect()}
    assert set(last) == set(final) and all(abs(last[h] - final[h]) < 1e-4 for h in final)
    chances = {}
    for x in frame.join(rated, ["race_id", "row_no"]).select("race_id", "horse_elo_pre_race", elo.implied_probability(F.col("horse_elo_pre_race")).alias("p")).collect():
        chances.setdefault(x.race_id, []).append((x.horse_elo_pre_race, x.p))
    for race in chances.values():  # runners without a rating count at the default one
        strengths = [10 ** ((1500 if e is None else e) / 400) for e, _ in race]
        assert all((p is None) == (e is None) and (p is None or abs(p - s / sum(strengths)) < 1e-9) for (e, p), s in zip(race, strengths, strict=True))
    assert any(abs(sum(p or 0 for _, p in race) - 1) < 1e-9 for race in chances.values())


def test_settled_races_leave_the_rounds(spark, monkeypatch):
    rows = card(7, races=160)
    frame = spark.createDataFrame(rows, SCHEMA).persist()
    report = []
    some = {(x.race_id, x.row_no): x.elo_after for x in elo.ratings(frame, report=report).collect()}
    assert report == sorted(report, reverse=True) and report[-1] < report[0] and sum(report) < 0.97 * len(report) * report[0]
    monkeypatch.setattr(elo, "SHARE", 2.0)  # none leaves
    full = {(x.race_id, x.row_no): x.elo_after for x in elo.ratings(frame).collect()}
    assert some.keys() == full.keys() and all(abs(some[k] - full[k]) < 1e-8 for k in full if full[k] is not None)


def test_spans_of_days_equal_all_at_once(spark, monkeypatch):
    """Each span goes on from the ratings before it, and a round goes over a span's rows alone."""
    rows = card(5, races=60)
    frame = spark.createDataFrame(rows, SCHEMA).persist()
    want, final = model(rows, {"horse": 30})
    monkeypatch.setattr(elo, "SPAN_ROWS", 90)
    report = []
    for x in elo.ratings(frame, report=report).collect():
        a, b = x.horse_elo_pre_race, want.pop((x.race_id, x.row_no))["elo"]
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-4)
    assert not want and max(report) < 0.7 * frame.count()
    last = {x.horse: x.elo for x in elo.after_all(frame).collect()}
    assert set(last) == set(final) and all(abs(last[h] - final[h]) < 1e-4 for h in final)


def test_spans_are_few_and_whole_days():
    assert elo._spans([]) == [] and elo._spans([("a", 5)]) == [("a", "a")]
    days = [(d, 1_500_000) for d in range(40)]
    spans = elo._spans(days)
    assert len(spans) <= elo.SPANS and spans[0][0] == 0 and spans[-1][1] == 39 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_legacy_scores_of_non_finishers(spark):
    frame = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 99.0)], "race_id string, row_no int, pos double")
    now = [x.s for x in frame.select("row_no", elo.actual_score().alias("s")).orderBy("row_no").collect()]
    old = [x.s for x in frame.select("row_no", elo.actual_score(C.EloConfig(mode="legacy")).alias("s")).orderBy("row_no").collect()]
    assert now == pytest.approx([5 / 3, 4 / 3, 0, 0])
    assert old == pytest.approx([5 / 3, 4 / 3, 1.0, 1.0])


def test_single_runner_races_leave_no_trace(spark):
    rows = [x for x in card(8) if x[0] != "r0000"]
    alone = [("r0000", 1, START - timedelta(days=9), START - timedelta(days=9), "t0", "t0", "h1", "j1", "s1", 1.0, 1, 1, 60.0, 130.0, 1000.0, "Good", "None", 1, 3, 1, 1, "x", 2.0)]
    a = chrono.horse_features(spark.createDataFrame(rows, SCHEMA)).orderBy("race_id", "row_no").collect()
    b = chrono.horse_features(spark.createDataFrame(rows + alone, SCHEMA)).orderBy("race_id", "row_no").collect()
    assert a == b


def test_later_results_never_change_earlier_features(spark):
    rows = card(11, races=60)
    late = sorted({x[2] for x in rows})[40]
    changed = [x if x[2] < late else (*x[:9], 1.0, 1, 1, *x[12:]) for x in rows]
    made = []
    for data in (rows, changed):
        frame = chrono.chronological(chrono.prepare(spark.createDataFrame(data, SCHEMA)))
        made.append([tuple(x) for x in frame.where(F.col("race_datetime") < F.lit(late)).drop("pos", "won", "placed").orderBy("race_id", "row_no").collect()])
    assert len(made[0]) == len(made[1]) > 0
    for x, y in zip(*made, strict=True):
        assert all(a == b or (isinstance(a, float) and abs(a - b) < 1e-4) for a, b in zip(x, y, strict=True))


def test_resume_equals_the_full_run(spark, tmp_path):
    rows = card(13, races=70)
    split = sorted({x[2] for x in rows})[45]
    old, new = [x for x in rows if x[2] < split], [x for x in rows if x[2] >= split]
    features.save_state(spark.createDataFrame(old, SCHEMA), str(tmp_path))
    got = features.resume(spark, str(tmp_path), spark.createDataFrame(new, SCHEMA))
    want = chrono.chronological(spark.createDataFrame(rows, SCHEMA)).where(F.col("race_datetime") >= F.lit(split))
    names = [c for c in want.columns if c in got.columns]
    a = got.select(names).orderBy("race_id", "row_no").collect()
    b = want.select(names).orderBy("race_id", "row_no").collect()
    assert len(a) == len(b) == len(new)
    for x, y in zip(a, b, strict=True):
        for c in names:
            assert x[c] == y[c] or abs(x[c] - y[c]) < 1e-4, c


def test_unconverged_ratings_raise(spark, monkeypatch):
    monkeypatch.setattr(elo, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        elo.ratings(spark.createDataFrame(card(5), SCHEMA))


def test_first_timer_defaults(spark):
    rows = [(f"r{k}", n, START, START, "t", "t", f"h{n}", "j", "s", float(n), int(n == 1), 0, 70.0, 130.0, 1000.0, "Good", "Hood", None, 4, n, 2, "x", None) for k in (0,) for n in (1, 2)]
    x = chrono.chronological(spark.createDataFrame(rows, SCHEMA)).where("row_no = 1").first()
    assert (x.win_rate_last_5, x.avg_pos_last_5, x.pos_consistency, x.races_since_win) == (0, 10, 0, 0)
    assert (x.or_peak_in_career, x.or_decline_from_peak, x.avg_days_between_races) == (70, 0, 21)
    assert (x.position_momentum_3_races, x.recent_form_trend, x.avg_class_last_5) == (None, 0, None)
    assert (x.headgear_change, x.going_change, x.distance_change_pct, x.surface_avg_position) == (0, 0, 0, 10)
    assert x.horse_elo_pre_race == 1500 and x.elo_implied_prob == pytest.approx(0.5)


def test_feature_table_has_all_columns(spark):
    made = features.build(spark.createDataFrame(card(2, races=30), SCHEMA).withColumn("days_since_last_time_out", F.lit(10)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("Scan") < 20
    have = set(made.columns)
    assert not {"pos", "position"} & have
    for name, rules in derived.GROUPS.items():
        assert set(derived.names_of(rules, [*made.columns])) <= have, name
    chronological = {c for g in chrono.HORSE_GROUPS.values() for c in g()} | set(chrono.people("jockey")) | set(chrono.people("trainer")) | set(chrono.field_quality()) | {"horse_elo_pre_race", "elo_implied_prob"}
    assert len(chronological) == 108 and chronological <= have
    assert sum(len(derived.names_of(g, made.columns)) for g in derived.GROUPS) + len({"track_frequency", "class_filled"} & have) == 191
    assert made.count() == len(card(2, races=30))


def test_a_best_without_a_known_second_has_no_gap(spark):
    races = {"two": [1500.0, None], "three": [1500.0, None, None], "none": [None, None], "alone": [1500.0], "both": [1500.0, 1620.0]}
    rows = [(race, k, x) for race, given in races.items() for k, x in enumerate(given)]
    frame = spark.createDataFrame(rows, "race_id string, row_no int, horse_elo_pre_race double").withColumn("elo_implied_prob", F.lit(0.5))
    got = {(x.race_id, x.row_no): x.elo_advantage_over_second for x in derived.apply(frame, derived.ELO).collect()}
    assert got == {("two", 0): None, ("two", 1): 0, ("three", 0): None, ("three", 1): 0, ("three", 2): 0, ("none", 0): 0, ("none", 1): 0, ("alone", 0): 0, ("both", 0): 0, ("both", 1): 120}


@pytest.mark.parametrize("chunk", [4, 12])
def test_large_and_small_entities_side_by_side(spark, chunk):
    """A jockey of nearly all rows goes by chunks, the others by windows of their own; counts may come from other rows with the same keys."""
    rows = [(*x[:7], "j0" if n % 4 else x[7], *x[8:]) for n, x in enumerate(card(6, races=60))]
    frame = history.eligible(spark.createDataFrame(rows, SCHEMA))
    made = []
    for size, counted in ((10_000, None), (chunk, None), (chunk, frame.select("jockey"))):
        config = C.HistoryConfig(chunk_rows=size)
        seen = {(x.race_id, x.row_no): x.seen for x in history.with_history(frame, "jockey", 3, ("position",), "seen", config, counted=counted).collect()}
        counts = {(x.race_id, x.row_no): (x._seen_14, x._first_of) for x in history.with_counts(frame.withColumn("_first_of", F.lit(1)), "jockey", 3, (14,), config, counted=counted).collect()}
        numbers = {(x.race_id, x.row_no): (x._key, x._seq, x._first) for x in history.numbered(frame, "jockey", config=config, counted=counted).collect()}
        made.append((seen, counts, numbers))
    assert made[0] == made[1] == made[2] and len(made[0][0]) > 100


def test_histories_move_rows_once(spark, tmp_path):
    """Of stored rows: to the horse. Day counts, numbers and chunks took five shuffles."""
    spark.createDataFrame(card(9), SCHEMA).write.parquet(f"{tmp_path}/rows")
    frame = chrono.prepare(spark.read.parquet(f"{tmp_path}/rows"))
    plan = chrono.horse_features(frame, ("form",), key=F.col("horse"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(_key") == 1


def test_star_rows_move_to_their_race_once(spark):
    from turfline.plans import star

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = star.runners(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(race_id") == 2  # lines and orders; none for the windows
