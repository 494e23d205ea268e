"""Plans of queries whose cost was cut, and their results on odd rows."""

import contextlib
import io
from datetime import datetime

from pyspark.sql import functions as F

from gridlens.operators import contracts
from gridlens.operators.contracts import flag, listed, nullable, number, shape, text
from gridlens.plans import catalog


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def test_date_scope_of_odd_lines_takes_one_shuffle(spark, tmp_path):
    """Equal and overlapping days count once, a line without day is no line, and lines without order are one group."""
    day = lambda d: datetime(2024, 2, d)
    lines = [(1, day(27)), (1, day(28)), (1, day(28)), (1, None), (2, None), (None, day(1)), (None, day(1)), (None, day(10)), (3, datetime(2023, 12, 30))]
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()["date_scope"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, "2024-02-27", "2024-03-01", 4), (None, "2024-02-01", "2024-02-12", 6), (3, "2023-12-30", "2024-01-01", 3)}
    assert plan(catalog.queries()["date_scope"](spark, str(tmp_path))).count("Exchange hashpartitioning") == 1


def test_contract_reads_objects_without_writing_them_again(spark):
    """Null, empty and odd members are told as ever, and no object is turned back into text for its keys."""
    rule = shape({"a": number(0, whole=True), "b": listed(nullable(text(1)), 1, 2)}, {"c": nullable(shape({"d": flag()})), "e": text()})
    cases = {
        '{"a":1,"b":["x",null]}': [],
        '{"a":null,"b":null,"c":null,"e":null}': ["$.a is no number", "$.b is no list", "$.e is no text"],
        '{"a":1e400,"b":[""],"c":{}}': ["$.a is not whole", "$.b[0] is shorter than 1", "$.c.d is missing"],
        '{"a":12345678901234567890.5,"b":{"0":1},"c":{"d":null,"":1}}': ["$.a is not whole", "$.b is no list", "$.c. is unknown", "$.c.d is no flag"],
        '{"a":true,"b":[[],{},1,"x"],"c":[],"x\\"y":{"z":[1,{"w":2}]}}': ["$.a is no number", "$.b has more than 2", "$.b[0] is no text", "$.b[1] is no text", "$.b[2] is no text", "$.c is no object", '$.x"y is unknown'],
        "{}": ["$.a is missing", "$.b is missing"],
        '{"a":1,"a":2,"b":["x"]}': ["$ is no JSON"],
        "null": ["$ is no object"],
        '"{}"': ["$ is no object"],
    }
    found = spark.createDataFrame(list(enumerate(cases)), "i int, j string").select("i", contracts.violations(F.col("j"), rule).alias("v"))
    assert [r["v"] for r in found.orderBy("i").collect()] == list(cases.values())
    said = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "map_keys" in said and "jsonobjectkeys" not in said and "json_object_keys" not in said
