"""Worked cases of the rules: sustained runs, retention, anchors, knees, cells, sources."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlens.functions import scalars
from gridlens.operators import bounded, evidence, forensics, islands, rolling, sampling, series
from gridlens.sources import logs


def deviations(spark, parts):
    rows = [(v, q) for n, v, q in parts for _ in range(n)]
    return spark.createDataFrame([("u", i, i * 4000, float(v), q) for i, (v, q) in enumerate(rows)], "e string, seq int, t long, dev double, q int")


@pytest.mark.parametrize(
    "parts, fires",
    [
        ([(10, 0, 1), (80, 20, 1)], [(84, 6)]),
        ([(10, 0, 1), (20, 20, 1)], []),
        ([(5, 0, 1), (40, 20, 1), (10, 0, 0), (40, 20, 1)], [(89, 6)]),
        ([(40, 20, 1), (1, 0, 1), (40, 20, 1)], []),
        ([(80, 20, 1), (5, 0, 1), (80, 25, 1)], [(74, 6), (159, 6)]),
    ],
)
def test_sustained_windows(spark, parts, fires):
    runs = islands.runs(deviations(spark, parts), "dev", F.col("q") == 0, ["e"], ["seq"])
    found = islands.windows(runs, "dev", "t", ["e"], "seq").orderBy("start").collect()
    assert [(r["start"] // 4000, r["fires"]) for r in found] == fires


def test_window_cap_counts_what_it_drops(spark):
    runs = islands.runs(deviations(spark, [(75, 20, 1), (1, 0, 1)] * 51), "dev", F.col("q") == 0, ["e"], ["seq"])
    kept = islands.capped(islands.windows(runs, "dev", "t", ["e"], "seq"), ["e"]).collect()
    assert len(kept) == 48 and {r["dropped"] for r in kept} == {3}


def test_outlier_row_alarms(spark):
    rows = spark.createDataFrame([("u", i, v) for i, v in enumerate([10.0] * 9 + [-60.0])], "e string, seq int, v double")
    last = rolling.alarms(rolling.scores(rolling.baseline(rows, "v", ["e"], ["seq"]), "v"), "v").orderBy(F.desc("seq")).first()
    assert last["stat_alarm"] and last["z_robust"] >= 3


def test_cell_rule(spark):
    rows = spark.createDataFrame([([3.3] * 7 + [3.8],), ([3.30, 3.31, 3.30, 3.30, 3.31, 3.30, 3.30, 3.31],)], "c array<double>")
    r = rolling.cell_residuals(F.col("c"))
    found = rows.select(rolling.outlier_cell(r).alias("cell"), rolling.cell_alarm(r).alias("alarm")).collect()
    assert (found[0]["cell"], found[0]["alarm"], found[1]["alarm"]) == (8, True, False)


def kept_plainly(rows, cap, strata):
    """The rule of retention word by word: (kept ids by time, dropped) of rows (id, time, alarm)."""
    kept, dropped, times = [], 0, []
    for i, t, alarm in rows:
        times += [] if t is None else [t]
        if not alarm:
            continue
        if len(kept) < cap:
            kept.append((i, t))
            continue
        dropped += 1
        untimed = [k for k in kept if k[1] is None]
        if t is None:
            continue
        if untimed:
            kept[kept.index(untimed[0])] = (i, t)
            continue
        lo, hi = min(times), max(times)
        place = lambda x: min(strata - 1, max(0, (x - lo) * strata // (hi - lo))) if hi > lo else 0  # noqa: B023, E731
        n = [sum(place(k[1]) == s for k in kept) for s in range(strata)]
        top, low = max(k[1] for k in kept), min(k[1] for k in kept)
        ends = [next(k for k in kept if k[1] == top), next(k for k in kept if k[1] == low)]
        if n[place(t)] < cap // strata:
            fullest = max(s for s in range(strata) if n[s] == max(n))
            members = [k for k in kept if place(k[1]) == fullest]
            if n[fullest] > n[place(t)]:
                gone = ([k for k in members if k not in ends] or members)[-1]
                kept[kept.index(gone)] = (i, t)
        elif t > top:
            kept[kept.index(ends[0])] = (i, t)
        elif t < low:
            kept[kept.index(ends[1])] = (i, t)
    return [k[0] for k in sorted(kept, key=lambda k: (k[1] is None, k[1] or 0))], dropped


@pytest.mark.parametrize("seed", range(4))
def test_retention_is_that_of_the_rule(spark, seed):
    import random

    rng = random.Random(seed)
    rows = {e: [(i, None if rng.random() < 0.03 else [i * 10, rng.randrange(5000), 4000 - i * 3, i // 90][seed], rng.random() < 0.6) for i in range(400)] for e in ("a", None, "b")}
    df = spark.createDataFrame([(e, *r, "x") for e, rs in rows.items() for r in rs], "e string, seq long, t long, alarm boolean, lo string").withColumnRenamed("lo", "note").repartition(7)
    kept = sampling.retained_alarms(df, ["e"], ["seq"], "t", F.col("alarm"), chunk=F.expr("seq div 50"), cap=24, strata=6).collect()
    for e, rs in rows.items():
        ids, dropped = kept_plainly(rs, 24, 6)
        mine = [r for r in kept if r["e"] == e]
        assert [r["seq"] for r in mine] == ids and {r["dropped"] for r in mine} == {dropped}


def test_a_shelf_holds_no_more_than_its_places():
    import pyarrow as pa

    shelf, row = sampling.Shelf(40, 8), pa.record_batch({"x": [1]})
    for i in range(5000):
        slot = shelf.slot(float(i % 977), 0.0, float(min(i, 976)))
        if slot is not None:
            shelf.put(slot, float(i % 977), row)
    assert len(shelf.rows) == len(shelf.times) == 40 and shelf.dropped == 4960


def test_spread_keeps_both_ends(spark):
    df = spark.range(100).withColumn("g", F.lit(1))
    ids = sorted(r["id"] for r in sampling.spread(df, ["g"], ["id"], 5).collect())
    assert ids == [0, 24, 49, 74, 99]


def test_anchor_and_nearest(spark):
    pts = [(i, 0.0 if i < 22 else -45.0) for i in range(40)]
    bins = spark.createDataFrame([("u", t, y) for t, y in pts], "e string, bin_ms long, mean double")
    a = forensics.step_anchor(bins, ["e"]).first()
    assert (a["t"], a["step"]) == (22, -45.0)
    folded = spark.createDataFrame([(pts,)], "p array<struct<t:bigint,y:double>>").select(forensics.anchor_fold(F.col("p")).alias("a")).first()["a"]
    assert (folded["t"], folded["score"]) == (22, 45.0)
    grid = spark.createDataFrame([("u", 10), ("u", 13), ("v", 1)], "e string, t long")
    samples = spark.createDataFrame([("u", 8, 1.0), ("u", 12, 2.0)], "e string, t long, y double")
    near = {(r["e"], r["t"]): (r["near_ms"], r["near_y"]) for r in forensics.nearest(grid, samples, ["e"], "t", "y").collect()}
    assert near == {("u", 10): (8, 1.0), ("u", 13): (12, 2.0), ("v", 1): (None, 0.0)}


def test_knee(spark):
    days = spark.createDataFrame([("c", d, 0.8 + 0.0002 * d if d < 110 else 0.822 + 0.04 * (d - 110)) for d in range(140)], "e string, day long, y double")
    k = forensics.piecewise_knee(days, ["e"], "day", "y").first()
    assert abs(k["knee_x"] - 110) <= 1 and k["slope_ratio"] > 10
    c = forensics.chord_knee(days, ["e"], "day", "y").first()
    assert abs(c["knee_x"] - 110) <= 2


def test_cell_resistance(spark):
    r = spark.createDataFrame([([3.3, 3.3], [3.2, 3.25], 10.0)], "a array<double>, b array<double>, d double").select(forensics.cell_resistance(F.col("a"), F.col("b"), F.col("d")).alias("r")).first()["r"]
    assert [round(x, 6) for x in r] == [0.01, 0.005]


def test_series_merge_and_tiles(spark):
    part = lambda ts: spark.createDataFrame([("u", t, 1, 0.0, 2.0, 1.0) for t in ts], "e string, bin_ms long, n long, lo double, hi double, mean double")
    merged = series.merge([part([1, 2]), part([2, 9])], ["e"]).orderBy("bin_ms").collect()
    assert [(r["bin_ms"], r["n"]) for r in merged] == [(1, 1), (2, 2), (9, 1)]
    assert series.tiled_bins(part(range(100)), ["e"], 30).count() == 25


def test_scalars(spark):
    rows = spark.createDataFrame([("12abc",), ("-1.5e2x",), ("abc",), ("",), (None,), ("Infinity",)], "s string")
    found = rows.select(scalars.number(F.col("s")).alias("n"), scalars.number_or_infinite(F.col("s")).alias("i"), scalars.cell_label(F.col("s")).alias("c")).collect()
    assert [r["n"] for r in found] == [12.0, -150.0, None, None, None, None]
    assert found[5]["i"] == float("inf")
    assert spark.range(1).select(scalars.cell_label(F.lit("cell8")).alias("c")).first()["c"] == "Cell 8"


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = archive({"deep.csv": "t,v\n1,2\n"})
    data = archive({"a.csv": b"t,v\r\n1,2\r\n\r\n2,3", "__MACOSX/._a.csv": "x", "b.md": "no", "n.zip": inner, "k.csv": "시간,값\n1,2\n".encode("euc-kr"), "e.csv": ""})
    (tmp_path / "one.zip").write_bytes(data)
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    files = logs.archives(spark, str(tmp_path))
    status = {r["path"]: (r["status"], r["depth"]) for r in logs.catalog(files).collect()}
    assert status["a.csv"] == ("ready", 0) and status["n.zip/deep.csv"] == ("ready", 1) and status["b.md"][0] == "skipped" and status["e.csv"][0] == "cataloged" and status[""][0] == "error"
    found = [(r["path"], r["seq"], r["value"]) for r in logs.lines(files).filter("status = 'ready'").orderBy("path", "seq").collect()]
    assert found == [("a.csv", 0, "t,v"), ("a.csv", 1, "1,2"), ("a.csv", 3, "2,3"), ("k.csv", 0, "시간,값"), ("k.csv", 1, "1,2"), ("n.zip/deep.csv", 0, "t,v"), ("n.zip/deep.csv", 1, "1,2")]


def test_dialects():
    assert logs.dialect("C,x", "I,FPP") == "record"
    assert logs.dialect("Timestamp,U_Battery," + ",".join(f"U_Cell_{i}" for i in range(1, 9))) == "cells"
    assert logs.dialect("timestamp;v") == "generic" and logs.delimiter("a;b;c,d") == ";"


def test_record_rows_follow_the_last_header(spark):
    lines = ["C,h", "I,FPP,UNIT,1,T,MW", "D,FPP,UNIT,1,t1,5", "I,FPP,UNIT,2,MW,T", "D,FPP,UNIT,2,6,t2", "D,FPP,UNIT,2,7"]
    df = spark.createDataFrame([("z", "p", i, v) for i, v in enumerate(lines)], "archive string, path string, seq long, value string")
    assert [r["row"] for r in logs.record_rows(df).orderBy("seq").collect()] == [{"T": "t1", "MW": "5"}, {"MW": "6", "T": "t2"}, {"MW": "7", "T": ""}]


def test_budget_and_violations(spark):
    df = spark.createDataFrame([("g", 1, 30), ("g", 2, 30), ("g", 3, 30)], "g string, i int, n int")
    assert [(r["take"], r["cut"]) for r in evidence.budget(df, ["g"], ["i"], F.col("n"), 25, 60).orderBy("i").collect()] == [(25, True), (25, True), (10, True)]


def test_plain_files_are_split_and_headed(spark, tmp_path):
    from gridlens.sources import logs

    for name, count in (("a.csv", 3000), ("b.csv", 2)):
        (tmp_path / name).write_text("﻿timestamp,voltage_V,alarm_code\n" + "".join(f"2024-06-03 10:{i // 60 % 60:02d}:{i % 60:02d},{i},{'OV001' if i % 3 == 0 else '0'}\n" for i in range(count)) + 'x,"open,1\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = logs.text_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 2 and lines.filter("at is null").count() == 0
        rows = logs.headed_rows(lines, ["timestamp", "voltage_V", "alarm_code"]).collect()
        assert len(rows) == 3004 and sum(r["malformed"] for r in rows) == 2
        big = [r for r in rows if r["path"].endswith("a.csv") and not r["malformed"]]
        assert [int(r["voltage_V"]) for r in sorted(big, key=lambda r: (r["block"], r["at"]))] == list(range(3000))
        first = [r["value"] for r in lines.collect() if r["block"] == 0 and r["value"].startswith("timestamp")]
        assert len(first) == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_record_keeps_all_its_columns(spark):
    from gridlens.sources import logs

    names, values = [f"c{i}" for i in range(1500)], [str(i) for i in range(1500)]
    rows = [("z", "f", 0, "I,A,B,1," + ",".join(names)), ("z", "f", 1, "D,A,B,1," + ",".join(values))]
    got = logs.record_rows(spark.createDataFrame(rows, "archive string, path string, seq long, value string")).first()["row"]
    assert got == dict(zip(names, values, strict=True))


def test_chunks_change_nothing(spark):
    data = [(e, i, None if i % 7 == 3 else float((i * 37) % 23 - (i % 11 == 0) * 90)) for e in ("a", None) for i in range(90)]
    rows = spark.createDataFrame(data, "e string, seq long, v double")
    for at in ("seq div 3", "seq div 40", "seq div 1000", "if(seq < 50, 0, seq)"):
        whole = rolling.baseline(rows, "v", ["e"], ["seq"])
        cut = rolling.baseline(rows, "v", ["e"], ["seq"], chunk=F.expr(at))
        assert cut.columns == whole.columns
        assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
        late, cut = rolling.onset(rows, "v", ["e"], ["seq"]), rolling.onset(rows, "v", ["e"], ["seq"], chunk=F.expr(at))
        assert sorted(map(str, cut.collect())) == sorted(map(str, late.collect()))


@pytest.mark.parametrize("rows", [1, 6, 7, 10, 11, 53])
def test_adaptive_bins_are_those_of_an_online_merge(spark, rows):
    times = [i // 2 if i < 8 else i for i in range(rows)]
    bins = []
    for t in times:
        if bins and bins[-1][-1] == t:
            bins[-1].append(t)
        else:
            bins.append([t])
        if len(bins) > 6:
            bins = [[x for b in bins[i : i + 2] for x in b] for i in range(0, len(bins), 2)]
    df = spark.createDataFrame([("u", i, t, 1.0) for i, t in enumerate(times)], "e string, seq long, t long, v double")
    found = bounded.adaptive_bins(df, ["e"], ["t", "seq"], "t", "v", cap=6).orderBy("bin").collect()
    assert [(r["bin"], r["bin_ms"], r["n"]) for r in found] == [(i, b[0], len(b)) for i, b in enumerate(bins)]


def test_retained_events(spark):
    day = 86_400_000
    times = [None, *[i * day // 4 for i in range(500)], 0, 0]
    df = spark.createDataFrame([(e, i, t) for e in ("u", None) for i, t in enumerate(times)] + [("few", 0, 5), ("few", 0, 5)], "e string, seq long, t long")
    kept = bounded.retained(df, ["e"], ["seq"], "t", cap=100, first=20, bins=8, quota=4).collect()
    for e, seen in (("u", 503), (None, 503), ("few", 2)):
        mine = [r for r in kept if r["e"] == e]
        assert len(mine) <= 100 and {len(mine) + r["dropped"] for r in mine} == {seen}
    late = {r["seq"] for r in kept if r["e"] == "u"}
    assert set(range(20)) <= late and 500 in late
    assert bounded.retained(df.filter("false"), ["e"], ["seq"], "t").count() == 0


def test_flag_at(spark):
    samples = spark.createDataFrame([("u", 0, "first"), ("u", 50_000, "second"), ("u", 500_000, "far"), ("v", 0, "other")], "e string, t long, q string")
    asks = spark.createDataFrame([("u", 55_000), ("u", 60_000), ("u", 240_000), ("u", 300_000), ("w", 0), ("u", 275_000)], "e string, at long")
    found = {(r["e"], r["at"]): r["q"] for r in bounded.flag_at(asks, samples, ["e"], "at", "t", "q").collect()}
    assert found == {("u", 55_000): "first", ("u", 60_000): "second", ("u", 240_000): "second", ("u", 300_000): "far", ("w", 0): None, ("u", 275_000): "second"}


def test_flag_at_takes_many_tasks_and_one_pass(spark):
    """Against all pairs, on chunks shorter than the gaps; no frame runs to the end of an entity from each of its rows."""
    rng = random.Random(3)
    samples = [(e, rng.choice([None, *range(0, 4000, 7)]) if e else rng.randrange(0, 9000), rng.randrange(100)) for e in ("u", "v", None) for _ in range(60)]
    asks = [(e, i, rng.choice([None, *range(-500, 5000, 13)])) for e in ("u", "v", None, "w") for i in range(80)]

    def want(e, at):
        own = [(t, q) for k, t, q in samples if k == e and t is not None]
        if not own or at is None:
            return min(own)[1] if own else None
        near = [s for s in own if abs(s[0] - at) < 40]
        late, soon = min((s for s in own if s[0] >= at), default=None), max((s for s in own if s[0] <= at), default=None)
        return (min(near) if near else late if soon is None else soon if late is None or at - soon[0] <= late[0] - at else late)[1]

    found = bounded.flag_at(spark.createDataFrame(asks, "e string, i long, at long"), spark.createDataFrame(samples, "e string, t long, q long"), ["e"], "at", "t", "q", radius=40, chunk_ms=100)
    assert {(r["e"], r["i"]): r["q"] for r in found.collect()} == {(e, i): want(e, at) for e, i, at in asks}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_headers_are_carried_along_stretches(spark, tmp_path):
    """A header for every few rows, none for the first, one that is malformed; no join of rows with ranges of headers."""
    from gridlens.sources import telemetry

    lines, want, names = ["C,x", "D,a,b,1,lost"], [], None
    for i in range(120):
        if i % 7 in (0, 1) and i != 50:
            names = None if i == 14 else [f"N{i}", "M"]
            lines.append('I,a,b,1,"open' if i == 14 else f"I,a,b,1,N{i},M")
        lines.append(f'D,a,b,1,{i},"open' if i % 11 == 0 else f"D,a,b,1,{i},m")
        want.append((names or [], None if i % 11 == 0 else [str(i), "m"]))
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n")
    rows = telemetry.records(telemetry.lines(spark, str(tmp_path)), stretch=10)
    assert [(r["names"], r["cells"]) for r in rows.orderBy("block", "at").collect()] == want
    joins = [s for s in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in s]
    assert joins and not any(">" in s.replace("<=>", "") or "<" in s.replace("<=>", "") for s in joins)
