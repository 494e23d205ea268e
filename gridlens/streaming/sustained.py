"""Sustained windows on a stream: closed by a reset, by silence, or at the end of the stream.

An entity's state is one row: resets and hits so far, and the window that is open. Rows of
a micro-batch are taken in order; the order across micro-batches is that of arrival, and
no row is dropped for being late: the clock of the timers is the time a row arrives, which
never runs backwards. A timer closes the window of an entity that has been silent for
`idle_ms`. When a stream ends (availableNow, or a stop), the windows still open are
read from the state store itself, so that a stream may also go on later from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridlens.operators.islands import FIRE, HIT

WINDOW = ["island", "start", "stop", "fires", "max_abs", "max_signed"]
OUT = "entity string, island long, start long, stop long, fires long, max_abs double, max_signed double, closed string"
STATE = "resets long, hits long, open boolean, start long, stop long, fires long, max_abs double, max_signed double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SustainedProcessor(StatefulProcessor):
    """Rows (entity, seq, t, dev, bad, arrived) of an entity to its closed windows."""

    def __init__(self, hit: float = HIT, fire: int = FIRE, idle_ms: int = 3_600_000):
        self.hit, self.fire, self.idle_ms = hit, fire, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("sustained", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        arrived = int(frame["arrived"].max().timestamp() * 1000)
        frame = frame[frame["dev"].notna()].sort_values(["t", "seq"], kind="stable")
        held = tuple(self.state.get()) if self.state.exists() else (0, 0, False, None, None, None, None, None)
        closed, held = fold(frame["t"].to_numpy(np.int64), frame["dev"].to_numpy(np.float64), frame["bad"].to_numpy(bool), held, self.hit, self.fire)
        self.state.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held[2]:
            self.handle.registerTimer(arrived + self.idle_ms)
        yield out(key[0], closed, "reset")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            held = tuple(self.state.get())
            if held[2]:
                self.state.update((held[0], held[1], False, None, None, None, None, None))
                yield out(key[0], [(held[0], *held[3:])], "idle")

    def close(self) -> None:
        pass


def out(entity, windows: list[tuple], closed: str) -> pd.DataFrame:
    frame = pd.DataFrame(windows, columns=WINDOW).astype({"island": "int64", "start": "int64", "stop": "int64", "fires": "int64", "max_abs": "float64", "max_signed": "float64"})
    frame.insert(0, "entity", entity)
    return frame.assign(closed=closed)


def fold(t: np.ndarray, dev: np.ndarray, bad: np.ndarray, held: tuple, hit: float, fire: int) -> tuple[list[tuple], tuple]:
    """(windows that a reset closed, state after) of further rows in order."""
    resets, hits, open_, *window = held
    small = ~bad & (np.abs(dev) < hit)
    is_hit = ~bad & ~small
    island = np.cumsum(small)
    count = np.cumsum(is_hit)
    last = np.maximum.accumulate(np.where(small, count, 0))  # hits up to the latest reset
    run = count - last + np.where(island == 0, hits, 0)
    fired = np.flatnonzero(is_hit & (run >= fire))
    windows = {0: tuple(window)} if open_ else {}
    for i in np.unique(island[fired]):
        at = fired[island[fired] == i]
        size = np.abs(dev[at])
        top = at[len(at) - 1 - int(np.argmax(size[::-1]))]  # the last of equal ones
        new = (int(t[at[0]]), int(t[at].max()), len(at), float(size.max()), float(dev[top]))
        if i == 0 and open_:
            start, stop, fires, most, signed = window
            new = (start, max(stop, new[1]), fires + new[2], max(most, new[3]), new[4] if new[3] >= most else signed)
        windows[int(i)] = new
    total = int(island[-1]) if len(island) else 0
    closed = [(resets + i, *w) for i, w in sorted(windows.items()) if i < total]
    now = windows.get(total)
    left = int(run[-1]) if len(run) else hits
    return closed, (resets + total, left, now is not None, *(now or (None,) * 5))


def sustained_stream(stream: DataFrame, hit: float = HIT, fire: int = FIRE, idle_ms: int = 3_600_000) -> DataFrame:
    """Closed windows of `stream` (entity, seq, t in ms, dev, bad), each once, with what closed it: reset or idle."""
    timed = stream.select("entity", "seq", "t", "dev", "bad", F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds")
    return timed.groupBy("entity").transformWithStateInPandas(statefulProcessor=SustainedProcessor(hit, fire, idle_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that are open in the state of a stream that has ended, closed by its end."""
    state = spark.read.format("statestore").option("stateVarName", "sustained").load(checkpoint)
    v = lambda c: F.col(f"value.{c}").alias(c)
    return state.filter("value.open").select(F.col("key.entity").alias("entity"), v("resets").alias("island"), *[v(c) for c in WINDOW[1:]], F.lit("end").alias("closed"))


def run_to_end(stream: DataFrame, at: str, hit: float = HIT, fire: int = FIRE, idle_ms: int = 3_600_000) -> DataFrame:
    """All windows of what `stream` has to offer now: those closed in this and earlier runs at folder `at`, and those its end closes.

    The state store must be the RocksDB one (`spark.sql.streaming.stateStore.providerClass`).
    """
    spark = stream.sparkSession
    found = sustained_stream(stream, hit, fire, idle_ms)
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out").unionByName(still_open(spark, f"{at}/state"))
