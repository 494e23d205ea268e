"""Ordered operations over chunks against the same over whole entities, and quantiles without a sort."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import bounded, forensics, islands, segments, stats

CHUNKS = ["seq div 3", "seq div 40", "0", "if(seq < 50, 0, seq)"]


def table(spark, n=130):
    rng = np.random.default_rng(4)
    rows = [(e, i, i * 1000 + int(rng.integers(0, 900)), None if rng.random() < 0.1 else float(rng.choice([0, 5, 20, -30])), bool(rng.random() < 0.2)) for e in ("a", None, "b") for i in range(n)]
    return spark.createDataFrame(rows, "e string, seq long, t long, v double, bad boolean").repartition(5)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("chunk", CHUNKS)
def test_runs_do_not_depend_on_chunks(spark, chunk):
    df = table(spark)
    whole = islands.runs(df, "v", F.col("bad"), ["e"], ["seq"], hit=12.0, fire=3)
    cut = islands.runs(df, "v", F.col("bad"), ["e"], ["seq"], hit=12.0, fire=3, chunk=F.expr(chunk))
    same(cut.select(whole.columns), whole)


def test_an_island_over_three_chunks(spark):
    """A run that begins in one chunk, fills the next, which has no reset, and ends in a third."""
    dev = [0.0] * 5 + [20.0] * 90 + [0.0] + [20.0] * 4
    df = spark.createDataFrame([("u", i, v, i in (40, 41)) for i, v in enumerate(dev)], "e string, seq long, v double, bad boolean")
    runs = islands.runs(df, "v", F.col("bad"), ["e"], ["seq"], chunk=F.expr("seq div 40"))
    found = islands.windows(runs, "v", "seq", ["e"], "seq").collect()
    assert [(r["island"], r["start"], r["stop"], r["fires"]) for r in found] == [(5, 81, 94, 14)]
    assert runs.orderBy(F.desc("seq")).first()["run"] == 4


@pytest.mark.parametrize("chunk", CHUNKS)
def test_running_previous_latest(spark, chunk):
    df, at = table(spark), F.expr(chunk)
    w = Window.partitionBy("e").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same(segments.running(df, ["e"], ["seq"], at, n=F.lit(1), s=F.col("v")), df.withColumns({"n": F.row_number().over(w).cast("long"), "s": F.coalesce(F.sum("v").over(upto), F.lit(0.0))}))
    same(segments.previous(df, ["e"], ["seq"], at, p=F.col("v")), df.withColumn("p", F.lag("v").over(w)))
    same(segments.latest(df, ["e"], ["seq"], at, q=F.col("v")), df.withColumn("q", F.last("v", ignorenulls=True).over(upto)))


def test_an_entity_is_many_tasks(spark):
    df = spark.range(6000).select(F.lit("u").alias("e"), F.col("id").alias("seq"), (F.col("id") % 40).cast("double").alias("v"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        runs = islands.runs(df, "v", F.lit(False), ["e"], ["seq"], chunk=F.expr("seq div 500"))
        busy = runs.select(F.spark_partition_id().alias("p")).distinct().count()
        assert busy > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize("chunk", CHUNKS[:3])
def test_operators_do_not_depend_on_chunks(spark, chunk):
    df, at = table(spark).filter("v is not null"), F.expr(chunk)
    same(forensics.transitions(df, ["e"], ["seq"], "v", "t", chunk=at).select("e", "seq", "di", "dv", "i0", "r"), forensics.transitions(df, ["e"], ["seq"], "v", "t").select("e", "seq", "di", "dv", "i0", "r"))
    same(bounded.adaptive_bins(df, ["e"], ["seq"], "t", "v", cap=8, chunk=at), bounded.adaptive_bins(df, ["e"], ["seq"], "t", "v", cap=8))
    same(bounded.retained(df, ["e"], ["seq"], "t", cap=40, first=9, bins=4, quota=2, chunk=at), bounded.retained(df, ["e"], ["seq"], "t", cap=40, first=9, bins=4, quota=2))
    gap = {r["e"]: (r["gap"], r["share"]) for r in stats.largest_gap(df, ["e"], ["seq"], "t", at).collect()}
    for e in ("a", None, "b"):
        t = sorted(r["t"] for r in df.collect() if r["e"] == e)
        assert gap[e] == (max(np.diff(t)), max(np.diff(t)) / (t[-1] - t[0]))
    grid, samples = df.filter("seq % 3 = 0").select("e", "t"), df.filter("seq % 7 = 1").select("e", "t", "v")
    same(forensics.nearest(grid, samples, ["e"], "t", "v", chunk="t div 7000"), forensics.nearest(grid, samples, ["e"], "t", "v"))


@pytest.mark.parametrize("quota, cap", [(1, 10), (1, 1)])
def test_quota_of_one(spark, quota, cap):
    """Lone rows and a quota of 1 divide by nothing."""
    df = spark.createDataFrame([("u", i, i * 86_400_000) for i in range(30)] + [("v", 0, 5)], "e string, seq long, t long")
    kept = bounded.retained(df, ["e"], ["seq"], "t", cap=cap, first=0, bins=16, quota=quota).collect()
    assert {r["e"]: r["dropped"] for r in kept} == {"u": 30 - sum(r["e"] == "u" for r in kept), "v": 0}


def quantile_cases():
    rng = np.random.default_rng(2)
    inf = math.inf
    return {
        "normal": rng.normal(size=900).tolist(),
        "wide": (10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500)).tolist(),
        "few": rng.integers(0, 4, 500).astype(float).tolist(),
        "one": [7.5],
        "ends": [inf, -inf, math.nan, 0.0, 1.0, 2.0, 1.7976931348623157e308, -1.7976931348623157e308],
        "endless": [inf] * 5 + [math.nan] * 4 + [-inf] * 3,
        "close": [1.0 + i * 2.0**-52 for i in range(40)] + [1e300],
        None: [1.0, 2.0, None, 3.0],
    }


@pytest.mark.parametrize("cells, few", [(4096, 100_000), (2, 0)])
def test_quantiles_are_those_of_sorted_groups(spark, cells, few):
    cases, ps = quantile_cases(), {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    df = spark.createDataFrame([(g, v) for g, vs in cases.items() for v in vs], "g string, v double").repartition(6)
    key = lambda v: (math.isnan(v), v)
    found = {r["g"]: r for r in stats.lower_quantiles(df, "v", ps, ["g"], cells=cells, few=few, passes=12 if cells > 2 else 3).collect()}
    assert found.keys() == cases.keys()
    for g, vs in cases.items():
        s = sorted((v for v in vs if v is not None), key=key)
        for name, p in {**ps, "max": 1.0}.items():
            want, got = s[math.floor(p * (len(s) - 1))], found[g][name]
            assert got == want or math.isnan(got) and math.isnan(want), (g, name)


def test_quantiles_move_no_rows(spark):
    """The plan exchanges counts only: every exchange lies above a partial aggregate."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 1000).cast("double").alias("v"))
    q = stats.lower_quantiles(df, "v", {"m": 0.5}, ["g"])
    assert sorted((r["g"], r["m"]) for r in q.collect()) == [(g, sorted(i * 37 % 1000 for i in range(1000) if i % 3 == g)[166 if g == 0 else 166]) for g in range(3)]
    assert "Window" not in q._jdf.queryExecution().toString() and "Sort" not in q._jdf.queryExecution().executedPlan().toString()
