"""From the lines of plain log files to typed rows of an entity, in three dialects.

Lines keep the place they come from: (path, block, at), the byte its split begins at
and the place in the split. A line feed is never part of a longer character in
UTF-8 or EUC-KR, so whether a file is UTF-8 is the conjunction over its lines, whatever splits
they are in: a partial aggregate, over all bytes. Headers are carried to the data rows along stretches
of lines; nothing puts a file in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.functions.scalars import number, timestamp_ms
from gridlens.operators import rolling, segments
from gridlens.sources.logs import CELLS, cells, code_alarm, quality_alarm, status_alarm

FEW = 100_000  # files of at most so many are broadcast (some 100 bytes each)
STRETCH = 1 << 17  # lines along which a header is carried by one task
# The first column of record rows, and by dialect the minutes east of UTC of times without zone.
OFFSET, EAST = 4, {"record": 600, "cells": 0, "generic": 0}
# Columns by their role, first choice first.
TIME, ALARM, STATUS = "(?i)^(timestamp|time|date)", "(?i)alarm|fault", "(?i)status"
RECORD_TIME, RECORD_ENTITY, RECORD_FLAG, HINT = ["MEASUREMENT_DATETIME", "INTERVAL_DATETIME"], ["FPP_UNITID", "PARTICIPANTID"], "MW_QUALITY_FLAG", "BESS"
# Names of temperatures, and the largest gap between pack and cells.
TEMPERATURE_NAMES, CLOSURE = ["T_", "Temp_", "Temperature_", "T"], 0.5


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at and the bytes of each line; a carriage return at its end goes."""
    rows = spark.read.option("lineSep", "\n").text(path)
    raw = F.regexp_replace("value", "\r$", "")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.when(F.col("value").endswith("\r"), raw).otherwise(F.col("value")).alias("value"))


def encodings(raw: DataFrame) -> DataFrame:
    """path, lines, foreign (lines that are no UTF-8) and encoding of each file."""
    found = raw.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(~F.is_valid_utf8("value")).alias("foreign"))
    return found.withColumn("encoding", F.when(F.col("foreign") == 0, "utf-8").otherwise("euc-kr"))


def decoded(raw: DataFrame, told: DataFrame, few: int = FEW) -> DataFrame:
    """Lines as text by the encoding of their file, with `replaced`: bytes of no character were replaced. A byte order mark goes."""
    foreign = told.filter("encoding <> 'utf-8'").select("path")
    n = foreign.count()
    mark = F.when(F.col("block") == 0, F.regexp_replace("value", "^\\ufeff", "")).otherwise(F.col("value"))
    plain = raw.select("path", "block", "at", mark.alias("value"), F.lit(False).alias("replaced"))
    if not n:
        return plain
    small = F.broadcast(foreign) if n <= few else foreign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.decode("euc-kr", "replace") for v in batch.column("value").to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(["�" in t for t in texts])], names=["path", "block", "at", "value", "replaced"])

    other = raw.join(small, "path", "left_semi").select("path", "block", "at", F.col("value").cast("binary").alias("value"))
    return plain.join(small, "path", "left_anti").unionByName(other.mapInArrow(run, "path string, block long, at long, value string, replaced boolean"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    raw = raw_lines(spark, path)
    return decoded(raw, encodings(raw))


def delimiter(header: Column) -> Column:
    """The one of , tab ; | that a header has most of; the first on ties."""
    n = {d: F.length(header) - F.length(F.replace(header, F.lit(d), F.lit(""))) for d in ",\t;|"}
    most, out = F.greatest(*n.values()), F.lit(",")
    for d in "|;\t,":
        out = F.when(n[d] == most, d).otherwise(out)
    return out


def cut(value: Column, by: Column) -> Column:
    """Cells of a line by its file's delimiter; null where a quote stays open."""
    return F.coalesce(*[F.when(by == d, cells(value, d)) for d in ",\t;|"])


def first_of(columns: Column, pattern: str) -> Column:
    return F.get(F.filter(columns, lambda c: c.rlike(pattern)), F.lit(0))


def profiles(found: DataFrame) -> DataFrame:
    """path, dialect, delimiter, columns, and the columns of time, entity and alarm of each file, from its first two lines that are not blank."""
    w = Window.partitionBy("path").orderBy("block", "at")
    top = found.filter(F.trim("value") != "").withColumn("n", F.row_number().over(w)).filter("n <= 2")
    two = top.groupBy("path").agg(F.max(F.when(F.col("n") == 1, F.col("value"))).alias("first"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("value"))), F.lit("")).alias("second"))
    d = two.withColumn("delimiter", delimiter(F.col("first")))
    names = F.transform(cut(F.col("first"), F.col("delimiter")), lambda c: F.upper(F.trim(c)))
    cellular = F.forall(F.array(*[F.lit(c) for c in ("TIMESTAMP", "U_BATTERY", *CELLS)]), lambda c: F.array_contains("names", c))
    record = F.col("first").startswith("C,") & F.col("second").startswith("I,")
    kind = F.when(record, "record").when(F.coalesce(cellular, F.lit(False)), "cells").otherwise("generic")
    out = d.withColumn("names", names).withColumn("dialect", kind).withColumn("delimiter", F.when(F.col("dialect") == "record", ",").otherwise(F.col("delimiter")))
    whole = F.when(F.col("dialect") == "record", F.expr(f"slice(head, {OFFSET + 1}, greatest(size(head) - {OFFSET}, 0))")).otherwise(F.col("head"))
    out = out.withColumn("head", F.coalesce(F.when(F.col("dialect") == "record", cells(F.col("second"))).otherwise(cut(F.col("first"), F.col("delimiter"))), F.array().cast("array<string>"))).withColumn("columns", whole)
    c = F.col("columns")
    has = lambda names: F.coalesce(*[F.when(F.array_contains(c, n), F.lit(n)) for n in names])
    time = F.when(F.col("dialect") == "record", has(RECORD_TIME)).when(F.col("dialect") == "cells", first_of(c, "(?i)^\\s*timestamp\\s*$")).otherwise(first_of(c, TIME))
    entity = F.when(F.col("dialect") == "record", has(RECORD_ENTITY))
    alarm = F.when(F.col("dialect") == "record", has([RECORD_FLAG])).when(F.col("dialect") == "generic", F.coalesce(first_of(c, ALARM), first_of(c, STATUS)))
    return out.select("path", "dialect", "delimiter", "columns", time.alias("time"), entity.alias("entity"), alarm.alias("alarm"))


def suggested(rows: DataFrame) -> DataFrame:
    """path, hint: the part of a name to filter by, where a file has an entity with it."""
    return rows.groupBy("path").agg(F.when(F.bool_or(F.contains(F.upper("entity"), F.lit(HINT))), F.lit(HINT)).alias("hint"))


def headed(found: DataFrame, told: DataFrame, few: int = FEW) -> DataFrame:
    """path, block, at, names, cells of the data rows of header-first files; cells is null for a malformed line."""
    w = Window.partitionBy("path").orderBy("block", "at")
    first = found.filter(F.trim("value") != "").withColumn("n", F.row_number().over(w)).filter("n = 1").select("path", F.struct("block", "at").alias("head__"))
    files = told.filter("dialect <> 'record'").join(first, "path").select("path", "delimiter", F.col("columns").alias("names"), "head__")
    own = found.join(F.broadcast(files) if files.count() <= few else files, "path").filter((F.struct("block", "at") != F.col("head__")) & (F.trim("value") != ""))
    return own.select("path", "block", "at", "names", cut(F.col("value"), F.col("delimiter")).alias("cells"))


def records(found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """path, block, at, names, cells of the D rows of record files, by the last I row before each.

    The last header is carried along the lines, in stretches of so many lines that are tasks; rows are not paired with headers.
    """
    own = lambda c: F.slice(c, F.lit(OFFSET + 1), F.greatest(F.size(c) - OFFSET, F.lit(0)))
    typed = found.filter(F.col("value").startswith("I,") | F.col("value").startswith("D,")).select("path", "block", "at", "value")
    header = F.when(F.col("value").startswith("I,"), own(F.coalesce(cells(F.col("value")), F.array().cast("array<string>"))))
    met = segments.latest(typed, ["path"], ["block", "at"], F.struct("block", F.expr(f"at div {stretch}").alias("part")), names=header)
    data = met.filter(F.col("value").startswith("D,") & F.col("names").isNotNull())
    # a line is cut once, however many of its cells are asked for
    return rolling.once(data, c__=cells(F.col("value"))).select("path", "block", "at", "names", F.when(F.col("c__").isNotNull(), own(F.col("c__"))).alias("cells"))


def field(name: str) -> Column:
    """A cell by the name of its column; empty where the row or the header lacks it."""
    return F.coalesce(F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1), F.lit(""))


def field_of(name: Column) -> Column:
    return F.coalesce(F.get("cells", F.array_position("names", name).cast("int") - 1), F.lit(""))


def watched(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`rows` without malformed ones, and what passes by on the way: rows and malformed ones, known once an action has run."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cells").isNull()).alias("malformed")).filter("cells is not null"), seen


def malformed(rows: DataFrame) -> DataFrame:
    """path, rows, malformed."""
    return rows.groupBy("path").agg(F.count("*").alias("rows"), F.count_if(F.col("cells").isNull()).alias("malformed"))


def keyed(rows: DataFrame, told: DataFrame, part: str = "") -> DataFrame:
    """Rows with entity (empty where a file has none), t_ms and alarm, by the columns that `profiles` found; `part` keeps the entities it is part of."""
    roles = told.select("path", "dialect", *[F.col(c).alias(f"{c}__") for c in ("time", "entity", "alarm")])
    own = rows.filter("cells is not null").join(roles, "path")
    zone = lambda d: timestamp_ms(field_of(F.col("time__")), EAST[d])
    t = F.when(F.col("dialect") == "record", zone("record")).otherwise(zone("generic"))
    v = field_of(F.col("alarm__"))
    status_only = F.col("alarm__").rlike(STATUS) & ~F.col("alarm__").rlike(ALARM)
    flag = F.when(F.col("alarm__").isNull(), False).when(F.col("dialect") == "record", quality_alarm(v)).when(status_only, status_alarm(v)).otherwise(code_alarm(v))
    out = own.select("path", "block", "at", "names", "cells", F.trim(field_of(F.col("entity__"))).alias("entity"), t.alias("t_ms"), flag.alias("alarm"))
    return out.filter(F.contains(F.lower("entity"), F.lit(part.lower()))) if part else out


def record_samples(rows: DataFrame) -> DataFrame:
    """Of keyed record rows with a time and a power: mw, quality (1 where untold), delta_mw (0 for an entity's first), scheduled and deviation."""
    named = rows.select("path", "block", "at", "entity", "t_ms", number(field("MEASURED_MW")).alias("mw"), F.coalesce(number(field(RECORD_FLAG)), F.lit(1.0)).alias("quality"), number(field("SCHEDULED_MW")).alias("scheduled"), number(field("DEVIATION_MW")).alias("deviation"))
    valid = named.filter("t_ms is not null and mw is not null")
    steps = segments.previous(valid, ["path", "entity"], ["block", "at"], F.col("block"), before__=F.col("mw"))
    return steps.withColumn("delta_mw", F.coalesce(F.col("mw") - F.col("before__"), F.lit(0.0))).drop("before__")


def generic_samples(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Of keyed rows with a time: the first cell with a number that is neither time nor alarm, and its column."""
    roles = told.select("path", F.col("time").alias("time__"), F.col("alarm").alias("alarm__"))
    pairs = F.arrays_zip("names", "cells")
    fit = F.filter(pairs, lambda p: ~p["names"].eqNullSafe(F.col("time__")) & ~p["names"].eqNullSafe(F.col("alarm__")) & number(p["cells"]).isNotNull())
    own = rows.filter("t_ms is not null").join(roles, "path").withColumn("hit", F.get(fit, F.lit(0)))
    return own.filter("hit is not null").select("path", "block", "at", "t_ms", F.col("hit.names").alias("signal"), number(F.col("hit.cells")).alias("value"))


def alias(*names: str) -> Column:
    """The first cell of several names that is not empty, as a number."""
    return number(F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names]))


def cell_rows(rows: DataFrame) -> DataFrame:
    """Of keyed cell rows with a time and all cells: the cells, pack, current, charge, temperatures, and the rule's residuals, outlier cell, score, closure and alarms.

    A row alarms where a cell stands out from the others, or where pack and cells differ by more than `CLOSURE`.
    """
    named = rows.select("path", "block", "at", "t_ms", F.array(*[number(field(f"U_Cell_{i}")) for i in range(1, 9)]).alias("cells"), alias("U_Battery").alias("pack"), alias("I_Battery").alias("i"), alias("SOC_Battery").alias("soc"), F.array_compact(F.array(*[alias(*[f"{p}{k}" for p in TEMPERATURE_NAMES]) for k in range(1, 5)])).alias("temperatures"))
    whole = named.filter(F.forall("cells", lambda v: v.isNotNull()) & F.col("t_ms").isNotNull())
    felt = whole.withColumn("vdev", rolling.cell_residuals(F.col("cells")))
    centred = felt.withColumn("centred", F.transform("vdev", lambda v: F.abs(v - rolling.median_of(F.col("vdev")))))
    scale = F.greatest(F.lit(rolling.MAD_SCALE) * rolling.median_of(F.col("centred")), F.lit(0.005))
    summed = F.aggregate("cells", F.lit(0.0), lambda a, v: a + v)
    out = centred.withColumns({"scale": scale, "top": F.array_max("centred"), "closure": F.col("pack") - summed})
    stands, open_ = F.col("top") >= F.greatest(F.lit(0.03), 3 * F.col("scale")), F.coalesce(F.abs("closure") > CLOSURE, F.lit(False))
    rule = F.concat_ws(" + ", F.when(stands, "VDEV"), F.when(open_, "CLOSURE"))
    return out.select("path", "block", "at", "t_ms", "cells", "pack", "i", "soc", "temperatures", "vdev", F.array_position("centred", F.col("top")).cast("int").alias("cell"), (F.col("top") / F.col("scale")).alias("score"), "closure", (stands | open_).alias("alarm"), rule.alias("rule"))


def cell_samples(rows: DataFrame) -> DataFrame:
    """Of `cell_rows`: range and spread of the voltages, current, charge, mean temperature and largest residual; what is untold is null."""
    mean = F.when(F.size("temperatures") > 0, F.aggregate("temperatures", F.lit(0.0), lambda a, v: a + v) / F.size("temperatures"))
    return rows.select("path", "block", "at", "t_ms", (F.array_max("cells") - F.array_min("cells")).alias("v_range"), rolling.cell_spread(F.col("cells")).alias("v_std"), "i", "soc", mean.alias("t_mean"), F.array_max(F.transform("vdev", lambda v: F.abs(v))).alias("vdev_max"))
