"""A keyed stateful operator that acts in event time, also for keys that have fallen silent.

Rows wait in a map by stretch of time, a stretch's rows in one entry, until the watermark has passed them: an entry for each second would
cost calls between Python and the state for each second. An event-time timer then hands a key's due rows, in order and a stretch at a time, to a fold, which
tells what it finds, what it carries on, and by which second it wants to be asked again, rows or none. A key whose fold carries nothing on leaves
no state. State lies in RocksDB and is restored from the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (key, state or None, [(second, values)], last settled second) -> (rows, state or None, second to be asked at or None)
Fold = Callable[[tuple, dict | None, list[tuple[int, tuple]], int], tuple[list[tuple], dict | None, int | None]]
#: Seconds of a stretch; rows of a key that a task holds before it puts them into the state.
STRETCH_S, HELD = 3600, 200_000


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of spark and those that streams need, so that nothing is switched
    under other queries: state in RocksDB, and one stateful operator a query, as only then are late rows exact."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "false")
    return own


class Settled(StatefulProcessor):
    def __init__(self, fold: Fold, by: tuple[str, ...], values: tuple[str, ...], output: tuple[str, ...]) -> None:
        self.fold, self.by, self.values, self.output = fold, by, values, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long", "rows string")
        self.carried = handle.getValueState("carried", "state string")

    def _wake(self, second: int) -> None:
        self.handle.registerTimer(second * 1000)

    def _rows(self, stretch: int) -> list[tuple[tuple, list[int]]]:
        """What waits of a stretch, as (by, values)."""
        if not self.waiting.containsKey((stretch,)):
            return []
        n = len(self.by)
        return [(tuple(row[:n]), row[n:]) for row in json.loads(self.waiting.getValue((stretch,))[0])]

    def _put(self, stretch: int, rows: list[tuple[tuple, list[int]]]) -> None:
        if rows:
            self.waiting.updateValue((stretch,), (json.dumps([[*at, *values] for at, values in rows], separators=(",", ":")),))
        else:
            self.waiting.removeKey((stretch,))

    def _add(self, frames: list[pd.DataFrame]) -> None:
        """Adds rows to those that wait; an entry of the state is read and written once."""
        sums = pd.concat(frames).groupby(list(self.by), sort=False)[list(self.values)].sum().reset_index()
        at = sums["sec"].astype("int64")
        self._wake(int(at.min()))
        for stretch, own in sums.groupby(at // STRETCH_S):
            found = dict(self._rows(int(stretch)))
            for where, values in zip(zip(*(own[c].tolist() for c in self.by), strict=True), zip(*(own[c].tolist() for c in self.values), strict=True), strict=True):
                found[where] = [int(x) + y for x, y in zip(values, found.get(where, [0] * len(values)), strict=True)]
            self._put(int(stretch), list(found.items()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held: list[pd.DataFrame] = []
        for frame in rows:
            held.append(frame[[*self.by, *self.values]])
            if sum(map(len, held)) >= HELD:
                self._add(held)
                held = []
        if any(map(len, held)):
            self._add(held)
        yield pd.DataFrame([], columns=list(self.output))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        settled = timerValues.getCurrentWatermarkInMs() // 1000
        stretches = sorted(int(x[0]) for x in self.waiting.keys())
        state = json.loads(self.carried.get()[0]) if self.carried.exists() else None
        again, ahead, upto = None, [], None
        for stretch in stretches:
            if stretch * STRETCH_S > settled:
                ahead.append(min(at[0] for at, _ in self._rows(stretch)))  # later ones wait for longer
                break
            rows, upto = self._rows(stretch), min(settled, (stretch + 1) * STRETCH_S - 1)
            due, later = sorted(x for x in rows if x[0][0] <= upto), [x for x in rows if x[0][0] > upto]
            found, state, again = self.fold(key, state, [(at[0], (*at[1:], *values)) for at, values in due], upto)
            if due:
                self._put(stretch, later)
            ahead += [at[0] for at, _ in later]
            yield pd.DataFrame(found, columns=list(self.output))
        if upto != settled:
            found, state, again = self.fold(key, state, [], settled)
            yield pd.DataFrame(found, columns=list(self.output))
        if state is None:
            self.carried.clear()
        else:
            self.carried.update((json.dumps(state),))
        ahead += [again] if again is not None else []
        if ahead:
            self._wake(max(min(ahead), settled + 1))

    def close(self) -> None:
        pass


def settled_fold(rows: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], values: tuple[str, ...], fold: Fold, schema: str, delay: str = "0 seconds") -> DataFrame:
    """What fold tells of a stream of rows (keys, sec, further columns of by, values), the values of equal rows added.

    A row is settled when the watermark, which lags `delay` behind the latest second of all keys, has passed it."""
    timed = rows.select(*keys, *by, *values).withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", delay)
    output = tuple(c.split()[0] for c in schema.split(","))
    return timed.groupBy(*keys).transformWithStateInPandas(Settled(fold, by, values, output), schema, "append", "eventTime")
