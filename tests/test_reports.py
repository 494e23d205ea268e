"""The bounded text at every cap, budgets, contracts and containment."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridlens.operators import contracts, pack
from gridlens.operators.contracts import flag, listed, nullable, number, shape, text


@pytest.mark.parametrize("parts", [None, "3 sources not included"])
def test_room_at_every_cap(spark, parts):
    """At every cap the note and the text fit it, and one more character would not."""
    head = len(pack.NOTE) - 2
    sizes = [0, 1, 9, 60, 1150, 12_345]
    df = spark.createDataFrame([(n, c, parts) for n in sizes for c in [*range(0, 260), *range(n - 5, n + 120), n * 2]], "whole long, cap long, parts string")
    for r in df.select("*", pack.room(F.col("whole"), F.col("cap"), F.col("parts"), pack.NOTE, pack.CUT).alias("limit")).collect():
        def length(limit, n=r["whole"]):
            cut = n - limit
            said = [x for x in (parts, f"{cut:,} characters cut" if cut else None) if x]
            return limit + (head + len(", ".join(said)) + pack.GAP if said else 0)

        best = max((i for i in range(r["whole"] + 1) if length(i) <= r["cap"]), default=0) if r["whole"] < 2000 else None
        if best is not None:
            assert r["limit"] == best, r
        assert r["limit"] == 0 or length(r["limit"]) <= r["cap"]


@pytest.mark.parametrize("cap", [0, 1, 40, 150, 260, 333, 1000])
def test_text_under_its_cap(spark, cap):
    lines = [f"line {i} " + "x" * (i % 7) for i in range(30)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i long, v string").repartition(5)
    left = spark.createDataFrame([(None,)], "parts string")
    r = pack.bounded_text(df, ["i"], "v", F.lit(cap), left, chunk=F.expr("i div 4")).first()
    whole = "\n".join(lines)
    assert len(r["text"]) <= cap and r["whole"] == len(whole)
    assert r["text"] == whole if cap >= len(whole) else r["text"] == (f"[Note: left out for size: {r['cut_chars']:,} characters cut. Call what is left out unconfirmed.]\n\n" + whole[: len(whole) - r["cut_chars"]])[:cap]


def test_no_lines(spark):
    left = spark.createDataFrame([("2 groups not detailed",)], "parts string")
    r = pack.bounded_text(spark.createDataFrame([], "i long, v string"), ["i"], "v", F.lit(500), left).first()
    assert (r["whole"], r["cut_chars"]) == (0, 0) and r["text"].startswith("[Note") and r["text"].endswith("]\n\n")


def test_budget_is_spent_in_order(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 7, 4, 9])], "i long, n long").repartition(3)
    used = pack.spent(df, ["i"], F.col("n"), total=14, chunk=F.expr("i div 2")).orderBy("i").collect()
    assert [r["used"] for r in used] == [5, 0, 7, 2, 0]


def test_formats(spark):
    r = spark.range(1).select(pack.average(F.lit(10.0), F.lit(4)).alias("a"), pack.average(F.lit(0.0), F.lit(0)).alias("b"), pack.percent(F.lit(0.1234)).alias("c"), pack.percent(F.lit(None).cast("double")).alias("d"), pack.span(F.lit(0), F.lit(None).cast("long")).alias("e")).first()
    assert tuple(r) == ("2.50", "—", "12.3%", "—", "1970-01-01T00:00:00.000Z ~ —")


def test_contract_names_every_violation(spark):
    window = shape({"time": text(1, 20), "level": text(one_of=["high", "low"])}, {"note": nullable(text(0, 5))})
    rule = shape({"windows": listed(window, 1, 2), "n": number(0, whole=True)}, {"ok": flag()})
    good = {"windows": [{"time": "t", "level": "low", "note": None}], "n": 3}
    cases = [
        (good, []),
        ({**good, "ok": 1, "more": {}}, ["$.more is unknown", "$.ok is no flag"]),
        ({"windows": [], "n": -1.5}, ["$.n is below 0", "$.n is not whole", "$.windows has fewer than 1"]),
        ({"windows": [{"time": "", "level": "mid"}, {"level": "low", "note": "too long", "x": 1}, 7], "n": "3"}, ["$.n is no number", "$.windows has more than 2", "$.windows[0].level is none of its values", "$.windows[0].time is shorter than 1", "$.windows[1].note is longer than 5", "$.windows[1].time is missing", "$.windows[1].x is unknown", "$.windows[2] is no object"]),
        ({"windows": {"a": 1}, "n": None}, ["$.n is no number", "$.windows is no list"]),
        ([1], ["$ is no object"]),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(98, "{"), (99, None)]
    df = spark.createDataFrame(rows, "i int, j string")
    found = {r["i"]: r["v"] for r in df.select("i", contracts.violations(F.col("j"), rule).alias("v")).collect()}
    assert [found[i] for i in range(len(cases))] == [want for _, want in cases]
    assert found[98] == found[99] == ["$ is no JSON"]


def test_containment_against_all_pairs(spark):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [say(rng.randrange(0, 90)) for _ in range(60)] + [None, ""]
    findings = [t[3:60] for t in texts if t] + [say(rng.randrange(0, 60)) for _ in range(40)] + ["a", "b", "", " ", None, "z", "zz top", "ab"]
    df = spark.createDataFrame(list(enumerate(findings)), "i int, f string")
    ts = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["i"] for r in contracts.uncontained(df, ts, "f", "t").collect()}
    assert found == {i for i, f in enumerate(findings) if f is not None and f.strip(" ") and not any(t is not None and f.strip(" ")[:40] in t for t in texts)}


def test_contract_takes_a_value_from_its_text_once(spark):
    """However deep the contract is and however often its rules name a value."""
    rule = shape({"a": shape({"b": nullable(shape({"c": number(0, whole=True), "d": text(1, 9, substantive=True)})), "e": listed(text(1), 1, 3)})})
    df = spark.createDataFrame([('{"a":{"b":{"c":-1.5,"d":"TBD"},"e":["x",2]}}',)], "j string").select(contracts.violations(F.col("j"), rule).alias("v"))
    assert df.collect()[0]["v"] == ["$.a.b.c is below 0", "$.a.b.c is not whole", "$.a.b.d is a placeholder", "$.a.e[1] is no text"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse") == 1 and plan.count("$['a']") == 1 and plan.count("$['c']") == 1


def test_containment_broadcasts_no_strings(spark, tmp_path):
    """The strings of a table that is small on disk are many times its size."""
    spark.createDataFrame([(1, "a finding of some length", "another text")], "i int, f string, t string").write.parquet(f"{tmp_path}/c")
    c = spark.read.parquet(f"{tmp_path}/c")
    found = contracts.uncontained(c.select("i", "f"), c.select("t"), "f", "t")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["i"] for r in found.collect()] == [1]
