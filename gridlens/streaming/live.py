"""The rolling and sustained rules on a stream, with bounded state for each entity.

Row windows do not run on streams, so a stateful processor keeps the last values
of an entity. Rows of a micro-batch are taken in order; nothing is dropped for
being late.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridlens.operators.rolling import BASELINE, DEVIATION, FLOOR, LEAST, MAD_SCALE, Z_ALARM

OUT = "event_id long, event_type string, base_n long, z_robust double, z_std double, stat_alarm boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]
STATE = "values array<double>"
# Rows of an entity that are sorted in memory, and rows of a frame put out or read back.
RUN, PIECE = 500_000, 10_000
ROW = np.dtype([("t_ms", "f8"), ("event_id", "i8"), ("value", "f8")])


def sorted_run(frames: list[pd.DataFrame]) -> np.ndarray:
    whole = np.empty(sum(map(len, frames)), ROW)
    for c in ROW.names:
        whole[c] = np.concatenate([f[c].astype("i8" if c == "event_id" else "f8").to_numpy() for f in frames])
    whole["t_ms"][np.isnan(whole["t_ms"])] = np.inf  # rows without a time come last
    return whole[np.lexsort((whole["event_id"], whole["t_ms"]))]


def read_back(path: str, n: int) -> Iterator[tuple]:
    with open(path, "rb") as f:
        for _ in range(0, n, PIECE):
            yield from np.fromfile(f, ROW, PIECE).tolist()


def in_order(frames: Iterator[pd.DataFrame], run: int = RUN) -> Iterator[tuple]:
    """(t_ms, event_id, value) of all frames by time and id; beyond `run` rows, sorted runs wait on local disk and are merged."""
    held, n, runs = [], 0, []
    with tempfile.TemporaryDirectory() as at:
        for frame in frames:
            held.append(frame[list(ROW.names)])
            n += len(frame)
            if n >= run:
                runs.append((f"{at}/{len(runs)}", n))
                sorted_run(held).tofile(runs[-1][0])
                held, n = [], 0
        last = sorted_run(held) if held else np.empty(0, ROW)
        tail = (r for i in range(0, len(last), PIECE) for r in last[i : i + PIECE].tolist())
        yield from heapq.merge(*[read_back(*r) for r in runs], tail, key=lambda r: r[:2])


class RollingProcessor(StatefulProcessor):
    """Robust z of `value` against the last 15 values of the entity."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()[0]) if self.state.exists() else []
        out = []
        for _, event_id, value in in_order(rows):
            z = zs = None
            alarm = False
            if held:
                mid, mean = median(held), sum(held) / len(held)
                mad = median(abs(x - mid) for x in held)
                std = (sum((x - mean) ** 2 for x in held) / len(held)) ** 0.5
                z, zs = abs(value - mid) / max(MAD_SCALE * mad, FLOOR), abs(value - mean) / max(std, FLOOR)
                alarm = len(held) >= LEAST and abs(value - mid) >= DEVIATION and (z >= Z_ALARM or zs >= Z_ALARM)
            out.append((int(event_id), key[0], len(held), z, zs, alarm))
            held = [*held, float(value)][-BASELINE:]
            if len(out) == PIECE:
                yield pd.DataFrame(out, columns=NAMES)
                out = []
        self.state.update((held,))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def rolling_stream(stream: DataFrame) -> DataFrame:
    """`stream` has event_id, event_type, value and t_ms."""
    return stream.groupBy("event_type").transformWithStateInPandas(statefulProcessor=RollingProcessor(), outputStructType=OUT, outputMode="Append", timeMode="None")


def day_windows(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows, smallest, largest and mean value of an entity for each tumbling UTC day. `stream` has event_type, value and ts.

    A day is held until the watermark, `late` behind the latest time seen, has passed its end;
    rows later than that are left out, as their day is closed.
    """
    days = stream.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 day").alias("day"))
    found = days.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    return found.select("event_type", F.unix_millis("day.start").alias("day_ms"), "n", "lo", "hi", "mean")
