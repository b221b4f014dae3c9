import json
import math
import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from turfline import config as C
from turfline.operators import boosting, clean, derived, selection
from turfline.plans import star
from turfline.sources import files

HEADER = "Date of Race,Time,Track,Horse,Jockey,Trainer,Type,Pos,Runners,Forecasted Odds,Weight,Distance f,Rate %"


def cards(tmp_path):
    a = [
        HEADER,
        "2024-05-01,14:30,York ,Ann,J1,T1,Maiden Stakes,1,2,3.5,11-7,5,1",
        "2024-05-01,14:30,York ,Bob,,T1,Maiden Stakes,PU,2,SCRATCHED,130,8,2",
        "bad-date,14:30,York,Cat,J1,T1,x,1,2,-,x,,3",
        "2024-05-02,xx,York,Dan,J1,T1,x,1,2,-,x,,3",
        "2024-05-03, 15:00 ,,Eve,J1,T1,NH Flat,2,1,4,x,,3",
    ]
    b = [HEADER, "2024-05-01,14:30,York ,Ann,J9,T9,Maiden Stakes,2,2,9,10-0,5,1"]
    for name, lines in (("a.csv", a), ("b.csv", b)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    return [str(tmp_path / n) for n in ("a.csv", "missing.csv", "b.csv")]


def test_cards_become_runners(spark, tmp_path):
    raw = files.read_cards(spark, cards(tmp_path))
    named = clean.standardize_names(raw)
    assert {"date_of_race", "rate_pct", "distance_f"} <= set(named.columns)
    rows = {x.horse: x for x in clean.prepare_inputs(clean.clean(named)).collect()}
    assert set(rows) == {"Ann", "Bob", "Eve"}
    ann, bob, eve = rows["Ann"], rows["Bob"], rows["Eve"]
    assert (ann.jockey, ann.race_id, ann.race_category, ann.won, ann.weight_lbs) == ("J1", "2024-05-01_YORK_14:30", "Flat", 1, 161.0)
    assert ann.distance_m == pytest.approx(5 * 201.168) and ann.forecasted_odds == 3.5 and ann.course == "York "
    assert (bob.pos, bob.won, bob.forecasted_odds, bob.weight_lbs) == (None, 0, None, 130.0)
    assert (eve.race_id, eve.race_category, eve.weight_lbs, eve.distance_m) == ("2024-05-03_NAN_15:00", "Jumps", None, 2000.0)
    with pytest.raises(FileNotFoundError):
        files.read_cards(spark, ["/nowhere.csv"])


def test_targets_from_other_columns(spark):
    frame = spark.createDataFrame([("Y", "7"), ("0", "x"), (None, None)], "winner string, place string")
    assert [x.pos for x in clean.with_target(frame.select("winner")).collect()] == [1.0, 99.0, 99.0]
    assert [x.pos for x in clean.with_target(frame).collect()] == [7.0, None, None]
    with pytest.raises(ValueError):
        clean.with_target(frame.select(F.lit(1).alias("x")))
    assert clean.with_target(frame.select(F.lit(1).alias("x")), scoring=True).first().won == 0


def test_checks_and_reports(spark):
    runners = star.runners(spark, "/root/testdata/sf0.001")
    report = clean.validate(runners)
    assert report["rows"] == runners.count() and report["duplicate_runners"] == 0
    with pytest.raises(ValueError):
        clean.validate(runners.withColumn("won", F.lit(0)))
    with pytest.raises(ValueError):
        clean.validate(runners.withColumn("horse", F.lit(None).cast("string")))
    assert {x.column_name for x in clean.missing_over(runners, 4.0).collect()} == {"pos", "stall", "class", "headgear", "forecasted_odds", "days_since_last_time_out"}
    assert {x.column_name for x in clean.missing_over(runners, 20.0).collect()} < {"stall", "forecasted_odds"}
    assert clean.suspicious_names(["actual_distance_change_m", "age"]) == ["actual_distance_change_m"]
    assert clean.column_groups(["or_a", "or_b", "x"]) == {"or": ["or_a", "or_b"], "x": ["x"]}
    leaky = runners.withColumns({"Betfair_SP_x": F.lit(1.0), "ratio": F.lit(float("inf"))})
    left = clean.drop_leakage(leaky)
    assert not {"pos", "Betfair_SP_x"} & set(left.columns) and left.where("ratio is not null").count() == 0
    with pytest.raises(ValueError):
        clean.drop_leakage(leaky, strict=True)
    cast = clean.model_inputs(spark.createDataFrame([(None, "3"), ("a", "z")], "c string, n string"), ["c", "n", "gone"], ["c"]).collect()
    assert [tuple(x) for x in cast] == [("missing", 3.0, -999.0), ("a", -999.0, -999.0)]


def test_versions_and_lists(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", 0)], "speed int, horse string, won int")
    copy = files.save_versioned(frame, f"{tmp_path}/processed_race_data.parquet")
    assert os.path.basename(files.latest_version(spark, str(tmp_path))) == os.path.basename(copy)
    assert files.write_feature_names(frame, f"{tmp_path}/names.txt", header=False) == ["speed"]
    assert files.read_text(spark, f"{tmp_path}/names.txt") == "speed"
    files.write_report(spark, f"{tmp_path}/report.json", {"a": 1})
    assert json.loads(files.read_text(spark, f"{tmp_path}/report.json")) == {"a": 1}


def test_a_thousand_files_are_a_scan_for_each_header(spark, tmp_path):
    paths = []
    for k in range(1000):
        path = tmp_path / f"card {k}.csv"
        head, values = (("a,b", f"{k},x") if k % 3 else ("b,a", f"x,{k}")) if k % 5 else ("a,c", f"{k},z")
        path.write_text(f"{head}\n{values}\n{values}\n" if k % 100 else "" if k else f"\n{head}\n{values}\n\n{values}\n")
        paths.append(str(path))
    order = paths[500:] + [f"{tmp_path}/missing.csv"] + paths[:500]
    read = files.read_cards(spark, order)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("Relation [") == plan.count(" csv")
    rows = read.orderBy("file_idx", "row_idx").collect()
    kept = [k for k in [*range(500, 1000), *range(500)] if k % 100 or not k]
    assert [int(x.a) for x in rows] == [k for k in kept for _ in range(2)]
    assert all((x.b, x.c) == (("x", None) if k % 5 else (None, "z")) for x, k in zip(rows, [k for k in kept for _ in range(2)], strict=True))
    assert [order[x.file_idx] for x in rows[::2]] == [f"{tmp_path}/card {k}.csv" for k in kept]
    named = read.withColumns({"race_id": F.lit("r"), "horse": F.col("a").cast("int") % 7})
    first = clean.keep_first(named, ["race_id", "horse"], ["file_idx", "row_idx"]).collect()
    assert sorted(int(x.a) for x in first) == [501, 502, 503, 504, 505, 506, 507]


def test_rows_of_a_file_in_many_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "cards").mkdir()
    for name, low in (("b", 3000), ("a", 0)):
        (tmp_path / "cards" / f"{name}.csv").write_text("n,pad\n" + "".join(f"{k},{'x' * 40}\n" for k in range(low, low + 3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = files.read_cards(spark, [str(tmp_path / "cards"), str(tmp_path / "cards/a.csv")])
        assert read.select("row_idx.block").distinct().count() > 8
        rows = read.orderBy("file_idx", "row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(x.n) for x in rows] == [*range(6000), *range(3000)]


def test_saved_tables_follow_files_order_and_settings(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text("a\n1\n")
    two.write_text("a\n2\n")
    calls = []

    def table(paths, *settings):
        def make():
            calls.append(paths)
            return files.read_cards(spark, paths)

        return sorted(x.a for x in files.reuse_or_write(spark, f"{tmp_path}/cached.parquet", files.snapshot_key(spark, paths, *settings), make).collect())

    both = [str(one), str(two)]
    assert table(both, C.EloConfig()) == table(both, C.EloConfig()) == ["1", "2"] and len(calls) == 1
    one.write_text("a\n1\n3\n4\n")
    assert table(both, C.EloConfig()) == ["1", "2", "3", "4"] and len(calls) == 2
    stat = one.stat()
    one.write_text("a\n1\n3\n5\n")  # as many bytes, another time
    os.utime(one, ns=(stat.st_atime_ns, stat.st_mtime_ns + 5_000_000_000))
    assert table(both, C.EloConfig()) == ["1", "2", "3", "5"] and len(calls) == 3
    assert table(both[::-1], C.EloConfig()) and len(calls) == 4  # the order decides which of two equal rows stays
    assert table(both[::-1], C.EloConfig(k_factor=3.0)) and len(calls) == 5
    assert table([*both[::-1], f"{tmp_path}/three.csv"], C.EloConfig(k_factor=3.0)) and len(calls) == 6
    (tmp_path / "three.csv").write_text("a\n9\n")
    assert "9" in table([*both[::-1], f"{tmp_path}/three.csv"], C.EloConfig(k_factor=3.0)) and len(calls) == 7


def test_a_killed_job_serves_no_half_table(spark, tmp_path, monkeypatch):
    path, frame = f"{tmp_path}/table.parquet", spark.range(10).toDF("x")
    with pytest.raises(FileNotFoundError):
        files.current(spark, path)
    files.publish(frame, path, "old")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(files, "_swap", killed)  # between the table and its pointer
        files.reuse_or_write(spark, path, "new", lambda: frame.limit(3))
    assert files.current(spark, path).count() == 10
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises while the table is written
        files.reuse_or_write(spark, path, "new", lambda: frame.select(F.raise_error(F.lit("lost")).alias("x")))
    assert files.current(spark, path).count() == 10
    held = files.current(spark, path)
    assert files.reuse_or_write(spark, path, "new", lambda: frame.limit(4)).count() == 4
    assert held.count() == 10  # who reads the version before can go on
    files.publish(frame, path, "newer")
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == 2


def test_splits_are_chronological(spark):
    runners = star.runners(spark, "/root/testdata/sf0.001").limit(20)
    counts = {x.split: x["count"] for x in selection.with_split(runners).groupBy("split").count().collect()}
    assert counts == {"train": 14, "val": 3, "test": 3}
    with pytest.raises(ValueError):
        selection.validate_inputs(runners.drop("won"))
    selection.validate_inputs(runners)


def test_selection_rules(spark):
    rows = [(k, 2.0 * k, float(k * k % 7), 5.0, None if k % 3 else 1.0) for k in range(60)]
    frame = spark.createDataFrame(rows, "a int, b double, c double, flat double, holes double")
    columns = ["a", "b", "c", "flat", "holes"]
    assert selection.low_variance(frame, columns) == ["flat", "holes"]
    assert selection.correlated(frame, ["a", "b", "c"], 0.98) == ["a"]
    assert selection.correlated(frame, ["a", "b", "c"], 0.98, any_partner=True) == ["b"]
    table = lambda **x: spark.createDataFrame(list(x.items()), "feature string, importance double")
    assert selection.within_cumulative(table(x=0.6, y=0.39, z=0.01, o=0.0), 0.995) == ["x", "y"]
    assert selection.within_cumulative(table(x=1.0), 0.995) == ["x"]


def test_of_equal_variances_the_later_column_stays(spark):
    frame = spark.createDataFrame([(float(k), float(k), -float(k)) for k in range(20)], "a double, b double, c double")
    assert selection.correlated(frame, ["a", "b", "c"], 0.98) == ["a", "b"]


def test_selector(spark):
    runners = derived.apply(star.runners(spark, "/root/testdata/sf0.001"), "market")
    split = selection.with_split(runners).persist()
    train, val = split.where("split = 'train'"), split.where("split = 'val'")
    chosen = selection.Selector(C.SelectionConfig(trees=3, permutation_repeats=2)).fit(train, val)
    assert "pos" not in chosen.kept and "placed" not in chosen.kept and chosen.kept
    assert 0.5 <= chosen.report["train_auc"] <= 1 and 0 < chosen.report["val_auc"] <= 1 and 1 <= chosen.report["trees"] <= 3
    out = chosen.transform(split)
    assert out.columns == [c for c in (*C.ID_COLUMNS, "won", *chosen.kept) if c in split.columns]
    assert [x.importance for x in chosen.top(2).collect()] == sorted((x.importance for x in chosen.importances.collect()), reverse=True)[:2]
    losses = {x.feature: x.loss_mean for x in chosen.permuted.collect()}
    assert set(losses) == {x.feature for x in chosen.importances.collect()} and len(chosen.report["permutation"]) == len(losses)
    with pytest.raises(ValueError):
        selection.Selector().fit(train.drop("won"))


def test_validation_rows_stop_training(spark):
    noise = spark.range(2000).selectExpr("id", "cast(rand(1) < 0.3 as int) as won", "rand(2) as x", "rand(3) as y", "timestamp_ntz'2024-01-01 00:00:00' as race_datetime").persist()
    many = selection.Selector(C.SelectionConfig(trees=30, patience=3, permutation=False, cumulative_importance=1.0)).fit(noise.where("id < 1500").drop("id"), noise.where("id >= 1500").drop("id"))
    assert many.report["trees"] == boosting.best_prefix(many.report["val_auc_by_trees"], 3)[0] < 30
    own = selection.Selector(C.SelectionConfig(trees=30, patience=None, importance="gain", permutation=False, cumulative_importance=1.0)).fit(noise.where("id < 1500").drop("id"), noise.where("id >= 1500").drop("id"))
    assert own.report["trees"] < 30 and "val_auc_by_trees" not in own.report


def _forest(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler, VectorIndexer

    rows = spark.range(1500).selectExpr("id", "rand(2) as x", "rand(3) as y", "cast(id % 5 as double) as kind").withColumn("_label", (F.col("x") + F.rand(4) + F.when(F.col("kind").isin(1, 3), 0.5).otherwise(0.0) > 1.1).cast("double"))
    packed = VectorAssembler(inputCols=["x", "y", "kind"], outputCol="raw").transform(rows)
    shaped = VectorIndexer(inputCol="raw", outputCol="_features", maxCategories=6).fit(packed).transform(packed).select("id", "_label", "_features").persist()
    return GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=12, maxDepth=3, stepSize=0.3, seed=1).fit(shaped.where("id % 3 > 0")), shaped.where("id % 3 = 0")


def test_staged_aucs_and_split_counts_equal_brute_force(spark):
    model, val = _forest(spark)
    table = boosting.nodes(model).persist()
    curve = boosting.auc_curve(model, table, val)
    rows = val.collect()
    trees, labels = model.trees, [x["_label"] for x in rows]
    sums, wanted = [0.0] * len(rows), []
    for tree, weight in zip(trees, model.treeWeights, strict=True):
        sums = [s + weight * tree.predict(x["_features"]) for s, x in zip(sums, rows, strict=True)]
        bins = [int(boosting.BINS / (1 + math.exp(-2 * s))) for s in sums]
        good, bad = [b for b, y in zip(bins, labels, strict=True) if y], [b for b, y in zip(bins, labels, strict=True) if not y]
        wanted.append(sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)))
    assert curve == pytest.approx(wanted, abs=1e-12)
    for patience in (1, 2, 4, 50):
        best = at = 0
        while at < len(wanted) and at - best <= patience:
            best, at = at if wanted[at] > wanted[best] else best, at + 1
            if at - 1 - best >= patience:
                break
        assert boosting.best_prefix(curve, patience)[0] == best + 1
    part = boosting.first_trees(model, 5)
    assert part.getNumTrees == 5 and part.treeWeights == model.treeWeights[:5] and part.toDebugString.split("Tree 0", 1)[1] == model.toDebugString.split("Tree 0", 1)[1].split("  Tree 5")[0]
    counts = {x.feature: x.importance for x in boosting.split_counts(table, ["x", "y", "kind", "unused"]).collect()}
    found = [int(k) for k in re.findall(r"If \(feature (\d+)", model.toDebugString)]
    assert counts == {c: found.count(k) for k, c in enumerate(["x", "y", "kind", "unused"])} and counts["kind"] > 0


def test_distinct_counts_of_wide_tables_have_no_expand(spark):
    wide = spark.range(200).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(300)])
    plan = clean.schema_report(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    assert {x.column_name: x.n_distinct for x in clean.schema_report(wide).collect()} == {f"c{k}": min(k + 1, 200) for k in range(300)}
    odd = spark.createDataFrame([(0.0, None, "a"), (-0.0, None, ""), (float("nan"), None, None), (float("nan"), None, "a")], "x double, empty int, text string")
    assert {x.column_name: (x.n_null, x.n_distinct) for x in clean.schema_report(odd).collect()} == {"x": (0, 2), "empty": (4, 0), "text": (1, 2)}
    near = {x.column_name: x.n_distinct for x in clean.schema_report(wide.select("c3", "c90", "c299"), approximate=True).collect()}
    assert all(abs(near[f"c{k}"] - min(k + 1, 200)) <= 4 for k in (3, 90, 299))


def test_permutation_finds_what_matters(spark):
    rows = spark.range(3000).selectExpr("cast(rand(1) as double) as x", "rand(2) as y", "timestamp_ntz'2024-01-01 00:00:00' as race_datetime").withColumn("won", (F.col("x") > 0.6).cast("int")).persist()
    chosen = selection.Selector(C.SelectionConfig(trees=2, permutation_repeats=3)).fit(rows, rows)
    losses = {x.feature: x.loss_mean for x in chosen.permuted.collect()}
    assert losses["x"] > 0.4 and abs(losses["y"]) < 0.02
    chosen.config = replace(chosen.config, permutation_rows=1000)
    fewer = {x.feature: x.loss_mean for x in chosen.permutation_importance(rows, 1).collect()}
    assert abs(fewer["x"] - losses["x"]) < 0.1


def test_older_selector(spark):
    frame = spark.createDataFrame([(k, 2.0 * k, float(k % 5), 1e-7 * (k % 2), int(k % 3 == 0)) for k in range(60)], "a int, b double, c double, flat double, won int").withColumn("race_datetime", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    chosen = selection.Selector(C.OLDER_SELECTION).fit(frame)
    assert (chosen.kept, chosen.report["low_variance"], chosen.report["correlated"], chosen.importances) == (["a", "c"], ["flat"], ["b"], None)


def test_plans_stay_native(spark):
    from turfline.plans import queries

    for name in ("horse_form_last_k", "trainer_form_days", "field_composition"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
