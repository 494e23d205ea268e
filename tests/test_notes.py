"""Notes, halved bins and chosen sources on worked cases."""

from pyspark.sql import functions as F

from gridlens.functions import notes
from gridlens.operators import evidence, series


def test_percent_and_ranges(spark):
    rows = [(0.1234, 0, 86_400_000), (0.5, 0, 5), (1.0, None, 5), (0.0005, 0, 0), (None, 0, None), (float("nan"), 0, 0), (float("inf"), 0, 0)]
    df = spark.createDataFrame(rows, "share double, lo long, hi long")
    got = df.select(notes.percent(F.col("share")).alias("p"), notes.day_range(F.col("lo"), F.col("hi")).alias("r")).collect()
    assert [r.p for r in got] == ["12.3%", "50%", "100%", "0.1%", "unknown", "unknown", "unknown"]
    assert [r.r for r in got] == ["1970-01-01 ~ 1970-01-02", "1970-01-01", "unknown", "1970-01-01", "unknown", "1970-01-01", "1970-01-01"]


def test_coverage_notes(spark):
    df = spark.createDataFrame([("x", 0, 10, 0, 10), ("y", 0, 5, 0, 10), ("z", None, None, 0, 10), ("w", 3, 3, 3, 3)], "s string, a long, b long, c long, d long")
    got = {r.s: r.n for r in df.select("s", notes.coverage_note(F.col("s"), (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("n")).collect()}
    assert got["x"] is None and "(50%)" in got["y"] and "alarms unknown" in got["z"] and "(unknown)" in got["w"]


def test_halved_bins_with_missing_signals(spark):
    rows = [("e", 0, 2, 1.0, 3.0, 2.0), ("e", 1, 6, 0.0, 9.0, 6.0), ("e", 2, 3, None, None, None), ("e", 3, 1, 4.0, 4.0, 4.0), ("e", 4, 0, None, None, None)]
    df = spark.createDataFrame(rows, "k string, bin_ms long, n long, s_min double, s_max double, s_mean double")
    got = [tuple(r) for r in series.halved(df, ["k"], ["s"]).orderBy("bin_ms").collect()]
    assert got == [("e", 0, 8, 0.0, 9.0, 5.0), ("e", 2, 4, 4.0, 4.0, 4.0), ("e", 4, 1, None, None, None)]
    assert series.halved(df.limit(0), ["k"], ["s"]).count() == 0


def test_taken_sources(spark):
    rows = [("a", 1, True, True, 0), ("a", 2, True, None, 9), ("b", 3, True, False, 3), ("b", 4, True, False, 2), ("c", 5, None, True, 9), ("c", 6, True, False, None), ("c", 7, True, False, 1), ("d", 8, False, True, 9)]
    df = spark.createDataFrame(rows, "g string, i int, ready boolean, selected boolean, score int")
    assert sorted((r.g, r.i, r.why) for r in evidence.taken(df, "g", "i").collect()) == [("a", 1, "chosen"), ("b", 3, "score"), ("c", 6, "first")]
