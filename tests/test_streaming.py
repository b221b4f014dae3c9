import random
from datetime import timedelta

from test_chrono import SCHEMA, card, model

from turfline.streaming.form import ordered_form, recent_form


def test_stream_sees_what_the_fold_sees(spark, tmp_path):
    rows = [x for x in card(21, races=50)]
    sizes = {}
    for x in rows:
        sizes[x[0]] = sizes.get(x[0], 0) + 1
    rows = [x for x in rows if sizes[x[0]] >= 2]
    moments = sorted({x[2] for x in rows})
    want, _ = model(rows, {"trainer": 6})
    for k, part in enumerate((moments[:20], moments[20:])):
        spark.createDataFrame([x for x in rows if x[2] in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = recent_form(stream, "trainer", 6).writeStream.format("memory").queryName("forms").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = {(x.race_id, x.row_no): x for x in spark.table("forms").collect()}
    assert len(got) == len(rows)
    for k, x in got.items():
        seen = want[k]["seen"]["trainer"]
        assert x.runs == len(seen)
        assert abs(x.win_rate - (sum(y["won"] for y in seen) / len(seen) if seen else 0)) < 1e-9


def _run(spark, tmp_path, parts, name, **options):
    """Each part is a micro-batch; a result far in the future, of another trainer, then lets the watermark pass all others."""
    last = max(x[2] for part in parts for x in part)
    ends = [(f"end{k}", 1, last + timedelta(days=3000 + k), last, "t", "t", "h", "j", "nobody", 1.0, 1, 1, *parts[0][0][12:]) for k in (0, 1)]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = None
    for k, part in enumerate([*parts, ends[:1], ends[1:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if query is None:
            query = ordered_form(stream, "trainer", 6, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    query.stop()
    return {(x.race_id, x.row_no): x for x in spark.table(name).collect() if x.entity != "nobody"}, dropped


def test_shuffled_arrival_gives_what_the_fold_gives(spark, tmp_path):
    sizes, rows = {}, card(23, races=25)
    for x in rows:
        sizes[x[0]] = sizes.get(x[0], 0) + 1
    rows = [x for x in rows if sizes[x[0]] >= 2]
    want, _ = model(rows, {"trainer": 6})
    mixed = list(rows)
    random.Random(5).shuffle(mixed)
    got, dropped = _run(spark, tmp_path, [mixed[:20], mixed[20:]], "shuffled", delay="2000 days")
    assert len(got) == len(rows) and not dropped
    for k, x in got.items():
        seen = want[k]["seen"]["trainer"]
        assert x.runs == len(seen) and abs(x.win_rate - (sum(y["won"] for y in seen) / len(seen) if seen else 0)) < 1e-9


def test_results_later_than_the_delay_are_dropped_and_counted(spark, tmp_path):
    rows = [x for x in card(23, races=25)]
    rows = [x for x in rows if x[2] in sorted({x[2] for x in rows})[:12]]
    first = min(x[2] for x in rows)
    late = [(f"late{k}", 1, first - timedelta(days=40), *x[3:]) for k, x in enumerate(rows[:3])]
    got, dropped = _run(spark, tmp_path, [rows, late], "late", delay="1 minute")
    assert dropped == 3 and not any(k[0].startswith("late") for k in got) and len(got) == len(rows)
