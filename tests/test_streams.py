"""Streams against batch operators: windows over micro-batches, silence, the end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlens.operators import islands
from gridlens.streaming import bins, live, sustained

SCHEMA = "entity string, seq long, t long, dev double, bad boolean"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sustained.ROCKS)
    return spark


def fed(spark, at, parts, **options):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{at}/in")
        found = sustained.run_to_end(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), str(at), **options)
    return sorted(tuple(r) for r in found.collect())


def test_windows_over_micro_batches(rocks, tmp_path):
    """A window open over a border, one closed by a reset later on, one still open at the end, and an entity that is silent in between."""
    dev = [0.0] * 3 + [20.0] * 10 + [-30.0] + [20.0] * 6 + [0.0] + [15.0] * 8
    rows = [("u", i, i * 10, v, i == 7) for i, v in enumerate(dev)]
    other = [("v", i, i, 50.0, False) for i in range(6)]
    rng = np.random.default_rng(0)
    parts = [rows[:9] + other, rows[9:12], rows[12:]]
    parts = [[p[i] for i in rng.permutation(len(p))] for p in parts]  # a micro-batch has no order
    found = fed(rocks, tmp_path, parts, hit=12.0, fire=4)
    assert found == [("u", 3, 60, 190, 13, 30.0, -30.0, "reset"), ("u", 4, 240, 280, 5, 15.0, 15.0, "end"), ("v", 0, 3, 5, 3, 50.0, 50.0, "end")]
    df = rocks.createDataFrame(rows + other, SCHEMA)
    batch = islands.windows(islands.runs(df, "dev", F.col("bad"), ["entity"], ["t", "seq"], hit=12.0, fire=4), "dev", "t", ["entity"], "seq")
    assert sorted((r["entity"], r["island"], r["start"], r["stop"], r["fires"], r["max_abs"], r["max_signed"]) for r in batch.collect()) == [r[:7] for r in found]


def test_silence_closes_a_window(rocks, tmp_path):
    """With no patience at all, an entity that a later run does not name has its window closed by the timer, once."""
    parts = [[("u", i, i, 50.0, False) for i in range(5)] + [("v", 0, 0, 1.0, False)], [("v", 1, 1, 1.0, False)], [("u", 9, 9, 50.0, False)]]
    found = fed(rocks, tmp_path, parts, hit=12.0, fire=3, idle_ms=0)
    assert [(r[0], r[1], r[2], r[3], r[4], r[7]) for r in found] == [("u", 0, 2, 4, 3, "idle"), ("u", 0, 9, 9, 1, "idle")]


@pytest.mark.parametrize("seed", range(6))
def test_fold_does_not_depend_on_batches(seed):
    rng = np.random.default_rng(seed)
    n = 300
    t, dev, bad = np.arange(n), rng.choice([0.0, 20.0, -20.0, 25.0], n, p=[0.1, 0.4, 0.3, 0.2]), rng.random(n) < 0.1
    start = (0, 0, False, None, None, None, None, None)
    whole = sustained.fold(t, dev, bad, start, 12.0, 4)
    held, closed = start, []
    cuts = [0, *sorted(rng.integers(0, n, 20).tolist()), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        more, held = sustained.fold(t[a:b], dev[a:b], bad[a:b], held, 12.0, 4)
        closed += more
    assert (closed, held) == whole


@pytest.mark.parametrize("order", [1, -1, 7])
def test_bins_do_not_depend_on_the_order(rocks, tmp_path, order):
    rng = np.random.default_rng(3)
    rows = [("u" if i % 3 else None, int(t), str(i % 2)) for i, t in enumerate(rng.integers(-5_000, 40_000, 200))] + [("u", None, "1"), ("u", 5, None)]
    rows = rows[::order] if abs(order) == 1 else [rows[i] for i in rng.permutation(len(rows))]
    for part in (rows[:30], rows[30:90], rows[90:]):
        rocks.createDataFrame(part, "entity string, t long, kind string").write.mode("append").parquet(f"{tmp_path}/in")
        found = bins.run_to_end(rocks.readStream.schema("entity string, t long, kind string").parquet(f"{tmp_path}/in"), str(tmp_path), most=5, width=100)
    want = {}
    for e in ("u", None):
        ts = [t for x, t, _ in rows if x == e and t is not None]
        width = next(100 << k for k in range(40) if max(ts) // (100 << k) - min(ts) // (100 << k) < 5)
        for x, t, kind in rows:
            if x == e and t is not None:
                want[e, t // width * width, width, kind or ""] = want.get((e, t // width * width, width, kind or ""), 0) + 1
    assert {(r["entity"], r["bin_ms"], r["width_ms"], r["kind"]): r["n"] for r in found.collect()} == want


def test_rows_of_a_micro_batch_are_taken_in_order_in_bounded_runs(monkeypatch):
    """More rows than a run holds: none is sorted with more than a run and a frame in memory."""
    rng = np.random.default_rng(4)
    rows = [(int(t), int(i), float(v)) for t, i, v in zip(rng.integers(0, 40, 1000), rng.permutation(1000), rng.normal(size=1000), strict=True)]
    frames = [pd.DataFrame(rows[k : k + 30], columns=["t_ms", "event_id", "value"]) for k in range(0, 1000, 30)]
    sizes, sort = [], live.sorted_run
    monkeypatch.setattr(live, "sorted_run", lambda held: sizes.append(sum(map(len, held))) or sort(held))
    assert list(live.in_order(iter(frames), run=100)) == sorted(rows) and max(sizes) <= 130 and len(sizes) > 5
    assert list(live.in_order(iter(frames))) == sorted(rows) and list(live.in_order(iter([]))) == []
