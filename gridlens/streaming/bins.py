"""Counts over time on a stream whose rows come in any order.

An entity has at most `most` bins of one width, a day doubled as often as its span of time needs. Bins
lie on multiples of their width, so an early row opens bins before the others, and
doubling makes two neighbours one, whatever came first: the bins depend on the rows alone, not on their order.
They are map state, read from the state store when the stream has ended or paused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridlens.operators.series import DAY_MS

MOST = 24
OUT = "entity string, doublings int, lo long, hi long"


class BinProcessor(StatefulProcessor):
    """Rows (entity, t, kind) of an entity to counts by bin and kind; what it puts out is the span of its bins so far."""

    def __init__(self, most: int = MOST, width: int = DAY_MS):
        self.most, self.width = most, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "doublings int, lo long, hi long")
        self.bins = handle.getMapState("bins", "bin long, kind string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k, lo, hi = tuple(self.span.get()) if self.span.exists() else (0, None, None)
        before = k
        counts: dict[tuple[int, str], int] = {}
        for frame in rows:  # a frame at a time; of earlier ones only counts are held
            frame = frame[frame["t"].notna()]
            if not len(frame):
                continue
            at = np.floor_divide(frame["t"].to_numpy(np.int64), self.width << k)
            lo, hi = int(at.min()) if lo is None else min(lo, int(at.min())), int(at.max()) if hi is None else max(hi, int(at.max()))
            for (b, kind), n in frame.assign(b=at).groupby(["b", "kind"]).size().items():
                counts[int(b), kind] = counts.get((int(b), kind), 0) + int(n)
            while hi - lo >= self.most:
                k, lo, hi = k + 1, lo >> 1, hi >> 1
                counts = halved(counts)
        if lo is None:
            return
        held = {} if not self.bins.exists() else {(b, kind): n for (b, kind), (n,) in self.bins.iterator()}
        for _ in range(k - before):
            held = halved(held)
        if k > before:
            self.bins.clear()
            changed = {c: held.get(c, 0) + counts.get(c, 0) for c in held.keys() | counts.keys()}
        else:
            changed = {c: held.get(c, 0) + n for c, n in counts.items()}
        for c, n in changed.items():
            self.bins.updateValue(c, (n,))
        self.span.update((k, lo, hi))
        yield pd.DataFrame({"entity": [key[0]], "doublings": [k], "lo": [lo], "hi": [hi]})

    def close(self) -> None:
        pass


def halved(counts: dict[tuple[int, str], int]) -> dict[tuple[int, str], int]:
    """The counts of neighbouring bins as one."""
    out: dict[tuple[int, str], int] = {}
    for (b, kind), n in counts.items():
        out[b >> 1, kind] = out.get((b >> 1, kind), 0) + n
    return out


def run_to_end(stream: DataFrame, at: str, most: int = MOST, width: int = DAY_MS) -> DataFrame:
    """entity, bin_ms, width_ms, kind and n after what `stream` (entity, t, kind) has to offer now and at earlier runs at folder `at`.

    Rows without time are in no bin; rows without kind count under the empty one.
    """
    rows = stream.select("entity", "t", F.coalesce("kind", F.lit("")).alias("kind"))
    told = rows.groupBy("entity").transformWithStateInPandas(statefulProcessor=BinProcessor(most, width), outputStructType=OUT, outputMode="Append", timeMode="None")
    told.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return held(stream.sparkSession, f"{at}/state", width)


def held(spark: SparkSession, checkpoint: str, width: int = DAY_MS) -> DataFrame:
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    spans = read("span").select(F.col("key.entity").alias("entity"), F.expr(f"{width}L << value.doublings").alias("width_ms"))
    bins = read("bins").select(F.col("key.entity").alias("own__"), F.col("user_map_key.bin").alias("bin"), F.col("user_map_key.kind").alias("kind"), F.col("user_map_value.n").alias("n"))
    return bins.join(spans, F.col("own__").eqNullSafe(F.col("entity"))).select("entity", (F.col("bin") * F.col("width_ms")).alias("bin_ms"), "width_ms", "kind", "n")
