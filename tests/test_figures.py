"""Figures: a reason exactly where one is unavailable, and the worked cases of common mode, resistance and knee."""

import json

import pytest
from pyspark.sql import functions as F

from gridlens.operators import evidence, figures, forensics

BINS = "entity string, bin_ms long, n long, lo double, hi double, mean double"
SAMPLES = "entity string, t long, quality int"


def bins(spark, drops, length=40, at=22, size=45.0):
    rows = [(e, i * 4000, 1, v, v, v) for e, drop in drops.items() for i in range(length) for v in [50.0 + 0.01 * (i % 3) - (size if drop and i >= at else 0.0)]]
    return spark.createDataFrame(rows, BINS)


def read(found):
    rows = {r["figure"]: r for r in found.collect()}
    for r in rows.values():
        assert r["available"] == (r["reason"] is None) and r["claim"]
    return rows


@pytest.mark.parametrize("drops, mode", [({"f": True, "p": True, "q": True}, "common"), ({"f": True, "p": False, "q": False}, "local"), ({"f": True}, "unknown")])
def test_common_mode(spark, drops, mode):
    b = bins(spark, drops)
    samples = spark.createDataFrame([("f", 87_000, 0), ("f", 0, 1)], SAMPLES)
    found, drawn = figures.grid_figures(b, samples, b.withColumn("mean", F.col("mean") - 50))
    rows = read(found)
    assert json.loads(rows["A-F4"]["stats"])["mode"] == mode
    assert all(r["available"] for r in rows.values()) and set(rows) == {f"A-F{i}" for i in range(1, 7)}
    stats = json.loads(rows["A-F1"]["stats"])
    assert stats["event_ms"] == 88_000 and stats["step"] < -44
    assert json.loads(rows["A-F5"]["stats"])["degraded"] is (True if stats["entity"] == "f" else False)
    assert drawn.filter("figure = 'A-F1'").count() == 40


def test_every_entity_is_compared(spark):
    """Eight entities of a wide range lie still in the window; ten of a smaller one move along and outvote them."""
    still, moving = {f"p{i}": True for i in range(8)}, {f"q{i}": True for i in range(10)}
    b = bins(spark, {"f": True}).unionAll(bins(spark, still, at=2, size=40.0)).unionAll(bins(spark, moving, size=30.0))
    found, drawn = figures.grid_figures(b, spark.createDataFrame([], SAMPLES), peer_ms=40_000)
    stats = json.loads(read(found)["A-F4"]["stats"])
    assert (stats["mode"], stats["peers"], stats["support"]) == ("common", 18, 10)
    assert drawn.filter("figure = 'A-F4'").select("series").distinct().count() == 19


def test_scope_is_half_open(spark):
    b = bins(spark, {"f": True, "p": False})
    found, _ = figures.grid_figures(b, spark.createDataFrame([], SAMPLES), scope=(0, 88_000))
    rows = read(found)
    assert json.loads(rows["A-F1"]["stats"])["event_ms"] < 88_000 and rows["A-F6"]["reason"] == "no column of deviations"


def test_no_series(spark):
    found, drawn = figures.grid_figures(spark.createDataFrame([], BINS), spark.createDataFrame([], SAMPLES))
    rows = read(found)
    assert len(rows) == 6 and not any(r["available"] for r in rows.values()) and drawn.count() == 0
    assert read(figures.generic_figures(spark.createDataFrame([], BINS)))["F1"]["reason"] == "too few points of a series"


EVENTS = "t long, i double, di double, soc double, t_mean double, r array<double>, bal array<double>"


def test_resistance_and_knee(spark):
    """The cell whose resistance rises is told from one with a lone spike, and its knee is found."""
    day = 86_400_000
    r = lambda d, c: 0.8 + (0.0002 * d if d < 110 else 0.022 + 0.004 * (d - 110)) if c == 8 else 0.8 + (0.5 if c == 5 and d == 20 else 0.0)
    rows = [(d * day, -20.0, -20.0, 50.0, 25.0, [r(d, c) for c in range(1, 9)], [0.1 if c == 2 else 0.0 for c in range(1, 9)]) for d in range(140)]
    events = spark.createDataFrame(rows, EVENTS)
    found, drawn = figures.battery_figures(events, events.select("t", F.lit(0.1).alias("v_range")))
    rows = read(found)
    assert json.loads(rows["B-F1"]["stats"])["cell"] == 8 and rows["B-F4"]["available"] and abs(json.loads(rows["B-F4"]["stats"])["knee_day"] - 110) <= 3
    assert json.loads(rows["B-F6"]["stats"])["cell"] == 2 and not rows["B-F5"]["available"]
    assert drawn.filter("figure = 'B-F6'").count() == 8


def test_no_events(spark):
    none = spark.createDataFrame([], EVENTS)
    found, _ = figures.battery_figures(none, spark.createDataFrame([], "t long, v_range double"))
    rows = read(found)
    assert len(rows) == 6 and not any(r["available"] for r in rows.values())


def test_dispatch_and_spans(spark):
    one = read(figures.generic_figures(bins(spark, {"f": True})))
    assert one["F1"]["available"]
    kinds = spark.createDataFrame([("generic",), ("record",)], "dialect string")
    by = {"generic": figures.generic_figures(bins(spark, {"f": True})), "cells": figures.generic_figures(bins(spark, {"f": False}))}
    assert [r["dialect"] for r in figures.dispatched(kinds, by).collect()] == ["generic"]
    drawn = spark.createDataFrame([("A", "s", 1.0, 0.0), ("A", "s", 9.0, 0.0), ("B", "s", 5.0, 0.0)], "figure string, series string, x double, y double")
    assert [tuple(r) for r in figures.spans_of(drawn, ["A"]).collect()] == [("A", 1.0, 9.0)]


def test_ledger_has_twelve_columns_and_a_cap(spark):
    parts = [spark.createDataFrame([(i, "x" * 500) for i in range(60)], "k int, derived string"), spark.createDataFrame([(i, "obs", "High") for i in range(60)], "k int, observation string, confidence string")]
    rows = figures.ledger(parts, ["k"]).orderBy("evidence_id").collect()
    assert len(rows) == 80 and rows[0].asDict().keys() == set(figures.LEDGER) and rows[0]["evidence_id"] == "E001"
    assert len(rows[0]["derived"]) == 400 and rows[0]["confidence"] == "Medium" and rows[79]["confidence"] == "High" and rows[79]["derived"] == ""
    assert figures.evidence_catalog(figures.ledger(parts, ["k"])).columns == ["evidence_id", "figure", "observation", "supports", "contradicts", "confidence"]


def test_snapshots_come_back(spark):
    cases = spark.createDataFrame([("a", "open", 3, [1, 2]), ("b", "shut", 4, [3])], "case_id string, state string, n int, series array<int>")
    history = evidence.snapshots(cases, ["case_id", "state"], heavy=["series"])
    assert [r.asDict() for r in evidence.reloaded(history, "b", "n int").collect()] == [{"case_id": "b", "state": "shut", "n": 4}]


def test_resistance_of_cells(spark):
    df = spark.createDataFrame([("u", 0, 0.0, [3.3, 3.3]), ("u", 1, 10.0, [3.2, 3.25]), ("u", 2, 11.0, [3.0, 3.0])], "e string, seq int, i double, c array<double>")
    found = forensics.cell_events(df, ["e"], ["seq"], "i", "c").collect()
    assert [(r["seq"], [round(x, 6) for x in r["r"]]) for r in found] == [(1, [0.01, 0.005])]
