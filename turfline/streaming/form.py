"""Recent form of an entity over a stream of results: the same records that history windows see, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turfline.operators.history import seconds

_STATE = "at array<long>, race array<string>, pos array<double>, won array<int>"
_OUT = "entity string, race_id string, row_no int, runs long, win_rate double, avg_pos double"


def recent_form(results: DataFrame, entity: str, keep: int, deadline_minutes: int = 5) -> DataFrame:
    """For each arriving result: how many of the entity's last `keep` records were visible, their win rate and mean position.

    results: race_id, row_no, race_datetime, the entity's column, pos, won; races arrive in order of time from one
    micro-batch to the next. Records of the same race, or at or after the deadline, aren't seen; a position of 99 or a
    null isn't averaged, and without any the mean is null. State is at most `keep` records of an entity, and those of its
    current race.
    """
    rows = results.where(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias("entity"), "race_id", "row_no", seconds(F.col("race_datetime")).alias("at"), F.col("pos").cast("double").alias("pos"), F.col("won").cast("int").alias("won"))

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = list(zip(*state.get, strict=True)) if state.exists else []
        new = pd.concat(list(frames)).sort_values(["at", "race_id", "row_no"])
        out = []
        for race, run in new.groupby("race_id", sort=False):
            at = int(run["at"].iloc[0])
            seen = [x for x in [x for x in past if x[1] != race][-keep:] if x[0] < at - 60 * deadline_minutes]
            finished = [x[2] for x in seen if x[2] < 99]
            for no in run["row_no"]:
                out.append((key[0], race, int(no), len(seen), sum(x[3] for x in seen) / len(seen) if seen else 0.0, sum(finished) / len(finished) if finished else None))
            past += [(at, race, 99.0 if pd.isna(p) else float(p), int(w)) for p, w in zip(run["pos"], run["won"], strict=True)]
            current = [x for x in past if x[1] == race]
            past = [x for x in past if x[1] != race][-keep:] + current
        state.update(tuple(list(c) for c in zip(*past, strict=True)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])

    return rows.groupBy("entity").applyInPandasWithState(update, _OUT, _STATE, "append", "NoTimeout")


_RECORD = "at long, race string, no int, pos double, won int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Of one entity: results that wait until the watermark passes them, and the last records of those that it passed."""

    def __init__(self, keep: int, deadline_minutes: int):
        self.keep, self.deadline = keep, 60 * deadline_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.past = handle.getListState("waiting", _RECORD), handle.getListState("past", _RECORD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), race, int(no), 99.0 if pd.isna(pos) else float(pos), int(won)) for frame in rows for at, race, no, pos, won in zip(frame["at"], frame["race_id"], frame["row_no"], frame["pos"], frame["won"].fillna(0), strict=True)]
        if new:
            self.waiting.appendList(new)
            for at in {x[0] for x in new}:
                self.handle.registerTimer(1000 * at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready, rest = [x for x in waiting if 1000 * x[0] <= upto], [x for x in waiting if 1000 * x[0] > upto]
        if not ready:  # an earlier timer of this batch took them
            return
        past, out = [tuple(x) for x in self.past.get()], []
        for (at, race), run in groupby(ready, key=lambda x: x[:2]):
            run = list(run)
            seen = [x for x in past[-self.keep :] if x[0] < at - self.deadline]
            finished = [x[3] for x in seen if x[3] < 99]
            out += [(key[0], race, x[2], len(seen), sum(y[4] for y in seen) / len(seen) if seen else 0.0, sum(finished) / len(finished) if finished else None) for x in run]
            past = (past + run)[-self.keep :]
        self.past.put(past)
        self.waiting.put(rest) if rest else self.waiting.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])

    def close(self) -> None:
        pass


def ordered_form(results: DataFrame, entity: str, keep: int, delay: str, deadline_minutes: int = 5) -> DataFrame:
    """recent_form() of results that arrive in any order: each waits until nothing before it can come any more.

    results may be up to `delay` (say, "2 hours") behind the newest one that arrived; later ones are dropped and counted in
    the query's numRowsDroppedByWatermark. A result is put out once the watermark passes its race, in the order of race_datetime,
    race_id and row_no, whatever the order of arrival. State is what waits, and `keep` records of an entity. Needs the
    RocksDB state store, which is set here where the session has none of its own.
    """
    spark = results.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = results.where(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias("entity"), "race_id", "row_no", seconds(F.col("race_datetime")).alias("at"), F.col("pos").cast("double").alias("pos"), F.col("won").cast("int").alias("won"))
    rows = rows.withColumn("moment", F.timestamp_seconds("at")).withWatermark("moment", delay)
    return rows.groupBy("entity").transformWithStateInPandas(_InOrder(keep, deadline_minutes), _OUT, "append", "EventTime")
