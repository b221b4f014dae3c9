"""State that is carried on day by day against state made from everything."""

import pytest
from compare import compare
from pyspark.sql import functions as F
from test_chrono import SCHEMA, card

from turfline import config as C
from turfline.plans import queries, state

SMALL = C.HistoryConfig(horse=3, jockey=4, trainer=5)  # so that records are evicted


def contents(spark, folder):
    tables = state.read(spark, folder)
    history = sorted((x.race_id, x.row_no, *(x[m] for m in state.MARKS)) for x in tables["history"].collect())
    rating = {x.horse: (x.elo, x.last_updated) for x in tables["rating"].collect()}
    return history, rating, sorted(tuple(x) for x in tables["days"].collect())


def test_daily_merges_equal_one_full_run(spark, tmp_path):
    rows = card(17, races=30)
    days = sorted({x[2].date() for x in rows})
    frame = spark.createDataFrame(rows, SCHEMA)
    day = F.to_date("race_datetime")
    step, whole = f"{tmp_path}/step", f"{tmp_path}/whole"
    first = days[len(days) - 4]
    state.save(frame.where(day < F.lit(first)), step, SMALL)
    assert state.merge(spark, step, frame.where(day == F.lit(first)), SMALL) == 1
    at = contents(spark, step)
    assert state.merge(spark, step, frame.where(day == F.lit(first)), SMALL) == 0 and contents(spark, step) == at  # twice
    assert state.merge(spark, step, frame.where(day >= F.lit(first)), SMALL) == 3  # the rest, with what was applied
    assert state.merge(spark, step, frame.limit(0), SMALL) == 0
    state.save(frame, whole, SMALL)
    (h1, r1, d1), (h2, r2, d2) = contents(spark, step), contents(spark, whole)
    assert h1 == h2 and d1 == d2 and r1.keys() == r2.keys()
    assert all(abs(r1[k][0] - r2[k][0]) < 1e-6 and r1[k][1] == r2[k][1] for k in r1)
    assert len(h1) < len(rows)  # races that nobody sees any more have gone
    with pytest.raises(ValueError, match="changed"):
        state.merge(spark, step, frame.where(day == F.lit(first)).withColumn("pos", F.lit(1.0)), SMALL)
    late = frame.where(day == F.lit(first)).withColumns({"race_datetime": F.col("race_datetime") - F.expr("INTERVAL 5000 DAYS"), "race_id": F.concat("race_id", F.lit("x"))})
    with pytest.raises(ValueError, match="come after"):
        state.merge(spark, step, late, SMALL)
    assert contents(spark, step)[0] == h1


def test_query_equals_its_sql(spark):
    assert compare(spark, queries.state_after_daily_merges, queries.SQL["state_after_daily_merges"], "/root/testdata/sf0.001") > 0
