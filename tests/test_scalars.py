"""The scalar functions on worked cases; each expected value follows from the rule's own definition."""

import pytest
from pyspark.sql import functions as F

from gridlens.functions import scalars
from gridlens.sources import logs

CASES = {}


def literal(name, cases, column, kind="string"):
    CASES[name] = (cases, column, kind)


literal("status_alarms", [("Charging", False), ("Fault", True), ("0", False), ("online", True), (" idle ", False), ("", False), ("discharging", False), ("TRIP", True)], logs.status_alarm, "boolean")
literal("code_alarms", [("0", False), ("OV001", True), ("ok", False), ("Normal", False), (" ", False), ("1", True)], logs.code_alarm, "boolean")
literal("quality_alarms", [("1", False), ("0", True), ("2", True), ("", False), (" 1 ", False)], logs.quality_alarm, "boolean")
literal("html_references", [("a &lt;b&gt; &amp;lt; c", "a <b> &lt; c"), ("&#65;&#x42;&apos;&quot;", "AB'\""), ("&nbsp;x&unknown;", " x&unknown;"), ("&#54620;&#x1F642;", "한\U0001f642"), ("R&D; 1 & 2", "R&D; 1 & 2"), ("", "")], scalars.html_references)
literal("html_lines", [("<p>a</p>\n\n <p>b  c</p>", "a \n b c"), ("x\ny", "x\ny"), ("<script>no()</script>t<style>p{}</style>", "t"), ("  ", "")], scalars.html_text)
literal("date_days", [("2025-08-19 and 2025/8/20", "2025-08-19,2025-08-20"), ("2025년 8월 3일 10시", "2025-08-03"), ("2025-02-30", ""), ("2025-08-19 2025-08-19", "2025-08-19"), ("none", "")], lambda c: F.array_join(F.transform(scalars.days_in(c), lambda d: F.date_format(d, "yyyy-MM-dd")), ","))
literal("zoned_timestamps", [("2025-08-19", 1755561600000), ("2025/08/19", 1755525600000), ("2025-08-19T10:00:00+10", 1755561600000), ("2025-08-19 10:00", 1755561600000), ("2025-08-19 00:00:00 UTC", 1755561600000)], lambda c: scalars.timestamp_ms(c, 600), "bigint")
literal("file_scores", [("BESS_log.csv|timestamp,voltage_V", 7), ("notes.pdf|", -5), ("data.dat|", 0), ("cell.tsv|soc", 4), ("readme|date", -2), ("x.CSV|temp,time", 5)], lambda c: scalars.source_score(F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2))), "int")
literal("byte_sizes", [("0", "0 B"), ("1023", "1023 B"), ("1024", "1.0 KB"), ("1536", "1.5 KB"), ("1048576", "1.00 MB"), ("1668409464", "1591.12 MB")], lambda c: scalars.byte_size(c.cast("long")))
literal("signed_sizes", [("-1", 4294967295), ("0", 0), ("7", 7), ("-2147483648", 2147483648)], lambda c: scalars.signed32(c.cast("long")), "bigint")
literal("cell_labels", [("8", "Cell 8"), ("cell8", "Cell 8"), ("Cell 08", "Cell 8"), ("cell_3", None), ("pack cell 4", "Cell 4"), ("pack 1", None), ("0", None), ("cell 0", None), (" 7 ", "Cell 7"), ("cell 99999999999", "Cell 99999999999"), ("cell 99999999999999999999", None), ("", None)], scalars.cell_label)
literal("escaped_html", [("<a href=\"x\">'&'</a>", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"), ("", "")], scalars.html_escape)
literal("prefix_numbers", [("12abc", 12.0), ("-1.5e3x", -1500.0), (".5", 0.5), ("abc", None), ("", None), ("+7.", 7.0)], scalars.number, "double")
literal("epochs_ms", [("1700000000", 1700000000000), ("1700000000123", 1700000000123)], lambda c: scalars.epoch_ms(c.cast("double")), "bigint")
literal("personal_data", [("a@b.co x@y.org a@b.co", "a@b.co,x@y.org"), ("nobody", ""), ("1@x.io 2@x.io 3@x.io 4@x.io", "1@x.io,2@x.io,3@x.io")], lambda c: F.array_join(scalars.pii(c, scalars.EMAIL), ","))
literal("phone_numbers", [("02-123-4567", "02-123-4567"), ("call 010-1234-5678.", "010-1234-5678"), ("x0101234567890123", ""), ("0311234567", "0311234567")], lambda c: F.array_join(scalars.pii(c, scalars.PHONE), ","))
literal("labels_and_addresses", [("담당자: Kim", "담당자:"), ("서울특별시 강남구 역삼동", "서울특별시 강남구 역삼동"), ("plain", "")], lambda c: F.array_join(F.concat(scalars.pii(c, scalars.LABEL), scalars.pii(c, scalars.ADDRESS)), ","))
literal("civil_day_starts", [("1755561600000", 1755525600000), ("1755525600000", 1755525600000), ("1755525599999", 1755439200000), ("0", -36000000), ("-1", -36000000)], lambda c: scalars.day_start_ms(c, 600), "bigint")
literal("civil_day_labels", [("1755561600000", "2025-08-19"), ("1755525599999", "2025-08-18"), ("1755525600000", "2025-08-19"), ("-86400000", "1969-12-31"), ("0", "1970-01-01")], lambda c: scalars.day_label(c, 600))
literal("placeholder_texts", [("Test", False), (" n/a ", False), ("없음", False), ("testing", True), ("", False), ("lorem ipsum", False), ("a cell rose", True), ("far too long a text", False)], lambda c: scalars.substantive(c, 12), "boolean")
literal("review_gate", [("a|high|b", True), (" |high|b", False), ("a||b", False), ("a|high|  ", False), ("a|high|", False)], lambda c: scalars.reviewed(*[F.split_part(c, F.lit("|"), F.lit(i)) for i in (1, 2, 3)]), "boolean")
literal("intake_gate", [("the second rack tripped twice at noon", True), ("too short", False), ("the second rack tripped, call 010-1234-5678", False), ("write to someone@example.com about the second rack", False)], lambda c: scalars.admitted(c, F.lit(True), F.lit(True)), "boolean")
literal("timestamps", [("2025-08-19T12:15:00Z", 1755605700000), ("2025/08/19 12:15:00", 1755569700000), ("2025-08-19 12:15:00+10:00", 1755569700000), ("2025-02-30 00:00:00.1239", 1740837600123), ("1700000000", None), ("", None), ("never", None)], lambda c: scalars.timestamp_ms(c, 600), "bigint")
literal("endless", [("Infinity", float("inf")), ("-Infinity x", float("-inf")), ("3d", 3.0), ("NaN", None)], scalars.number_or_infinite, "double")


@pytest.mark.parametrize("name", sorted(CASES))
def test_worked_cases(spark, name):
    cases, column, kind = CASES[name]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)] + [(len(cases), None)], "seq int, value string")
    found = rows.select("seq", column(F.col("value")).cast(kind).alias("r")).orderBy("seq").collect()
    assert [r["r"] for r in found][:-1] == [want for _, want in cases]


def test_delimited_lines(spark):
    rows = spark.createDataFrame(list(enumerate(['a,"x, y",3', 'b,"he said ""hi""", 4 ', 'c,"open', "d,,"])), "seq int, value string")
    found = logs.generic_rows(rows, ["k", "note", "n"]).orderBy("seq").collect()
    assert [(r["k"], r["note"], r["n"], r["malformed"]) for r in found] == [("a", "x, y", "3", False), ("b", 'he said "hi"', "4", False), ("", "", "", True), ("d", "", "", False)]
