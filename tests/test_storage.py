"""Stored rows: what comes back, what is left on disk, and the queries that go over them."""

import pytest
from pyspark.sql import functions as F
from test_chrono import SCHEMA, card

from turfline.functions import storage
from turfline.operators import chrono, selection
from turfline.plans import queries, state

SMALL = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getPath() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_stored_rows_come_back(spark):
    rows = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).withColumn("nothing", F.lit(None))
    folder = storage.new_folder(spark)
    got = storage.store(rows, folder)
    assert got.dtypes == rows.dtypes and sorted(got.collect()) == sorted(rows.collect())
    assert storage.store(rows.limit(2), folder).count() == 9
    storage.discard(spark, folder)
    assert not storage._path(spark, folder)[1].exists(storage._path(spark, folder)[0])


def test_a_store_removes_its_own_shuffle_files(spark):
    rows = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    storage.store(rows)
    assert not shuffle_files(spark) - before


def test_missing_report_makes_runners_once(spark):
    assert "l_orderkey" not in queries.missing_report(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


class _Seen(Exception):
    pass


@pytest.mark.parametrize("name,owner,method,place", [("selection_rules", selection.Selector, "fit", 1), ("state_after_daily_merges", state, "save", 0)])
def test_queries_go_over_stored_rows(spark, monkeypatch, name, owner, method, place):
    def caught(*args):
        raise _Seen(args[place].inputFiles())

    monkeypatch.setattr(owner, method, caught)
    with pytest.raises(_Seen) as seen:
        queries.QUERIES[name](spark, SMALL)
    assert seen.value.args[0] and all("/rows-" in x for x in seen.value.args[0])


def test_wide_rows_move_to_their_races_once(spark):
    """Behind the horses' histories; the ratings' join came after them, by race and number, and windows by race before and after."""
    rows = spark.createDataFrame(card(9, races=40), SCHEMA)
    base = storage.store(chrono.with_field(chrono.prepare(rows)))
    rated = base.select("race_id", "row_no", F.lit(1500.0).alias("horse_elo_pre_race"))
    plan = chrono.with_all_features(base, storage.store(rated))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange hashpartitioning(_key")]
    assert above.count("Exchange ") == 1 and "Join" not in above
