"""Queries of the sources: tables written as the log files of each dialect, then read back and put to the rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from gridlens.operators import rolling
from gridlens.session import shared_dir
from gridlens.sources import archives, telemetry

FIRST = "I,FPP,UNIT_MW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,FPP_UNITID,PARTICIPANTID,EVENT_ID,MEASURED_MW,MW_QUALITY_FLAG"
SECOND = "I,FPP,UNIT_MW,2,EVENT_ID,FPP_UNITID,MEASURED_MW,DEVIATION_MW,MW_QUALITY_FLAG,MEASUREMENT_DATETIME"
HOUR = "date_format(timestamp_millis(t_ms + 36000000), 'yyyy/MM/dd HH:mm:ss.SSS')"


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one file: rows before `turn` in the first layout, the others in the second one, each below its header."""
    seen = None
    for batch in batches:
        out = [] if seen is not None else ["C,SETP,WORLD,FPP,x"]
        for one, two, late in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "late")), strict=True):
            if late != seen:
                out.append(SECOND if late else FIRST)
                seen = late
            out.append(two if late else one)
        yield pa.record_batch({"value": pa.array(out, pa.string())})


def register(query, table, events, common: str, scored: str) -> None:
    def record_files(spark, sf_dir) -> str:
        """The events as record files of two layouts each: flag 0 for every seventh, an open quote for every 97th."""
        e = events(spark, sf_dir)
        flag = F.when(F.col("event_id") % 7 == 0, "0").otherwise("1")
        mw = F.col("value").cast("string")
        quoted = F.concat(F.lit('"'), F.expr(HOUR), F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(F.lit('"')))
        one = F.concat_ws(",", F.lit("D,FPP,UNIT_MW,1"), F.expr(HOUR), quoted, F.upper("event_type"), F.lit("OWNER"), F.col("event_id").cast("string"), mw, flag)
        two = F.concat_ws(",", F.lit("D,FPP,UNIT_MW,2"), F.col("event_id").cast("string"), F.upper("event_type"), mw, (F.col("value") - 250).cast("string"), flag, quoted)
        at = folder(spark, "records")
        dealt = e.select("event_id", "t_ms", one.alias("one"), two.alias("two"), (F.col("event_id") % 2000 >= 1000).alias("late")).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
        dealt.select("one", "two", "late").mapInArrow(with_headers, "value string").write.option("lineSep", "\r\n").text(at)
        return at

    def records(spark, sf_dir):
        found = telemetry.lines(spark, record_files(spark, sf_dir))
        return telemetry.records(found), telemetry.profiles(found)

    told = "event_id % 97 <> 0"

    @query(f"""{common} SELECT event_id, upper(event_type) AS entity, t_ms, value AS mw, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS quality, CASE WHEN event_id % 2000 >= 1000 THEN value - 250 END AS deviation, event_id % 7 = 0 AS alarm FROM e WHERE {told}""")
    def record_rows(spark, sf_dir):
        rows, profiles = records(spark, sf_dir)
        own = telemetry.keyed(rows, profiles)
        number = lambda c: telemetry.number(telemetry.field(c))
        return own.select(telemetry.field("EVENT_ID").cast("long").alias("event_id"), "entity", "t_ms", number("MEASURED_MW").alias("mw"), number("MW_QUALITY_FLAG").alias("quality"), number("DEVIATION_MW").alias("deviation"), "alarm")

    @query(f"{common} SELECT count(*) AS n, count_if(event_id % 97 = 0) AS malformed, 4::BIGINT AS files FROM e")
    def record_malformed(spark, sf_dir):
        rows, _ = records(spark, sf_dir)
        return telemetry.malformed(rows).agg(F.sum("rows").alias("n"), F.sum("malformed").alias("malformed"), F.count("*").alias("files"))

    @query(f"""{scored.replace("FROM events)", f"FROM events WHERE {told})")} SELECT upper(event_type) AS entity, count(*) AS n_rows, count_if(stat_alarm) AS stat_alarms, count_if(ramp_alarm) AS ramp_alarms FROM a GROUP BY 1""")
    def record_rule(spark, sf_dir):
        """From log lines to alarms: record files, headers, entity, time, power, rolling rules."""
        rows, profiles = records(spark, sf_dir)
        own = telemetry.keyed(rows, profiles).select("entity", "t_ms", telemetry.field("EVENT_ID").cast("long").alias("id"), telemetry.number(telemetry.field("MEASURED_MW")).alias("mw"))
        ruled = rolling.alarms(rolling.scores(rolling.baseline(own, "mw", ["entity"], ["t_ms", "id"], chunk=F.expr("t_ms div 604800000")), "mw"), "mw")
        return ruled.groupBy("entity").agg(F.count("*").alias("n_rows"), F.count_if("stat_alarm").alias("stat_alarms"), F.count_if("ramp_alarm").alias("ramp_alarms"))

    @query(f"""{common}, v AS (SELECT *, upper(event_type) AS entity, ntile(4) OVER (ORDER BY event_id) AS part FROM e)
    SELECT entity, sum(value) AS mw, count(*) AS n FROM v WHERE {told} AND entity LIKE '%IC%' GROUP BY 1""".replace("sum(value)", "round(sum(value), 4)"))
    def record_samples(spark, sf_dir):
        """The samples of entities with a part of a name in theirs; differences to the row before end where they begin."""
        rows, profiles = records(spark, sf_dir)
        s = telemetry.record_samples(telemetry.keyed(rows, profiles, part="ic"))
        ends = s.groupBy("path", "entity").agg(F.sum("mw").alias("mw"), F.count("*").alias("n"), (F.max_by("mw", F.struct("block", "at")) - F.min_by("mw", F.struct("block", "at"))).alias("way"), F.sum("delta_mw").alias("steps"))
        return ends.filter(F.abs(F.col("way") - F.col("steps")) < 1e-6).groupBy("entity").agg(F.round(F.sum("mw"), 4).alias("mw"), F.sum("n").alias("n"))

    @query("""WITH d AS (SELECT o_orderpriority, o_orderkey % 3 AS part, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT dialect, delimiter, time_col, alarm_col, count(*) AS files, sum(n)::BIGINT AS n FROM (
      SELECT 'generic' AS dialect, CASE part WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '|' END AS delimiter, CASE part WHEN 1 THEN 'Date' ELSE 'timestamp' END AS time_col, CASE part WHEN 0 THEN 'alarm_code' WHEN 1 THEN 'status' ELSE 'Fault' END AS alarm_col, n FROM d) GROUP BY ALL""")
    def file_profiles(spark, sf_dir):
        """The orders as header-first files of three delimiters, a file for each priority: dialect, delimiter and the columns' roles."""
        heads = [",timestamp,price,alarm_code", ";Date;status;price", "|timestamp|status|price|Fault"]
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t"))
        at = folder(spark, "orders")
        price = F.col("o_totalprice").cast("string")
        for k, head in enumerate(heads):
            d, state = head[0], F.lit("0")
            line = [F.concat_ws(d, "t", price, state), F.concat_ws(d, "t", state, price), F.concat_ws(d, "t", F.lit("OK"), price, state)][k]
            own = o.filter(F.col("o_orderkey") % 3 == k).select("o_orderpriority", line.alias("value"), F.lit(1).alias("n"))
            first = own.select("o_orderpriority").distinct().select("o_orderpriority", F.lit(head[1:]).alias("value"), F.lit(0).alias("n"))
            first.unionByName(own).repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "n").drop("n").write.partitionBy("o_orderpriority").text(f"{at}/part={k}")
        found = telemetry.lines(spark, at)
        told = telemetry.profiles(found)
        rows = telemetry.keyed(telemetry.headed(found, told), told).filter("t_ms is not null").groupBy("path").agg(F.count("*").alias("n"))
        return told.join(rows, "path").groupBy("dialect", "delimiter", F.col("time").alias("time_col"), F.col("alarm").alias("alarm_col")).agg(F.count("*").alias("files"), F.sum("n").alias("n"))

    @query("""SELECT source, count(*) AS n, 'utf-8' AS encoding, 0::BIGINT AS hours FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 0 GROUP BY 1
    UNION ALL SELECT source, count(*) + 1, 'euc-kr', 1 FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 1 GROUP BY 1""")
    def file_encodings(spark, sf_dir):
        """A file for each source, and one of EUC-KR whose only foreign bytes stand in its last line."""
        d = table(spark, sf_dir, "documents").filter("source is not null").select("source", (F.col("doc_id") % 2).alias("k"), F.concat(F.lit("line of document "), F.col("doc_id").cast("string")).alias("value"), F.lit(0).alias("n"))
        last = d.filter("k = 1").select("source", "k").distinct().select("source", "k", F.expr("cast(unhex('BDC3B0A320') as string)").alias("value"), F.lit(1).alias("n"))
        at = folder(spark, "encodings")
        d.unionByName(last).repartition("source", "k").sortWithinPartitions("source", "k", "n").drop("n").write.partitionBy("source", "k").text(at)
        raw = telemetry.raw_lines(spark, at)
        told = telemetry.encodings(raw)
        hours = telemetry.decoded(raw, told).groupBy("path").agg(F.count_if(F.trim("value") == "시간").alias("hours"), F.count_if("replaced").alias("replaced"))
        source = F.url_decode(F.regexp_extract("path", "source=([^/]*)/", 1)).alias("source")
        return told.join(hours, "path").filter("replaced = 0").select(source, F.col("lines").alias("n"), "encoding", "hours")

    cells = """WITH r AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS c, vec_id % 3 * 0.3 AS gap FROM embeddings WHERE len(embedding) >= 8),
    x AS (SELECT vec_id, i, c[i] AS v, (SELECT median(c[j]) FROM range(1, 9) t(j) WHERE j <> i) AS m FROM r, range(1, 9) s(i)),
    d AS (SELECT vec_id, i, v, v - m AS dev, v - m - median(v - m) OVER (PARTITION BY vec_id) AS cen FROM x),
    s AS (SELECT vec_id, greatest(1.4826 * median(abs(cen)), 0.005) AS scale, max(abs(cen)) AS top, max(v) - min(v) AS v_range, stddev_pop(v) AS v_std, max(abs(dev)) AS vdev_max FROM d GROUP BY 1),
    o AS (SELECT vec_id, min(i) AS cell FROM d JOIN s USING (vec_id) WHERE abs(cen) = top GROUP BY 1)"""

    def cell_files(spark, sf_dir):
        """The first eight components of the embeddings as the cells of a battery."""
        e = table(spark, sf_dir, "embeddings").filter("size(embedding) >= 8").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("c"))
        pack = F.aggregate("c", F.lit(0.0), lambda a, v: a + v) + F.col("vec_id") % 3 * F.lit(0.3)
        t = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        line = F.concat_ws(";", t, pack.cast("string"), F.col("vec_id").cast("string"), F.lit("50"), F.array_join(F.transform("c", lambda v: v.cast("string")), ";"), F.lit("20"), F.lit(""), F.lit("22"))
        head = ";".join(["Timestamp", "U_Battery", "I_Battery", "SOC_Battery", *[f"U_Cell_{i}" for i in range(1, 9)], "T_1", "T_2", "Temp_2"])

        def lines(batches):
            for k, batch in enumerate(batches):
                yield pa.record_batch({"value": pa.array(([] if k else [head]) + batch.column("value").to_pylist(), pa.string())})

        at = folder(spark, "cells")
        e.select(line.alias("value")).repartition(3, "value").mapInArrow(lines, "value string").write.text(at)
        found = telemetry.lines(spark, at)
        told = telemetry.profiles(found)
        return telemetry.cell_rows(telemetry.keyed(telemetry.headed(found, told), told))

    @query(f"""{cells} SELECT vec_id, cell::INT AS cell, round(top / scale, 6) AS score, round(gap, 6) AS closure, concat_ws(' + ', CASE WHEN top >= greatest(0.03, 3 * scale) THEN 'VDEV' END, CASE WHEN gap > 0.5 THEN 'CLOSURE' END) AS rule FROM r JOIN s USING (vec_id) JOIN o USING (vec_id)""")
    def cell_rule(spark, sf_dir):
        c = cell_files(spark, sf_dir)
        return c.select(F.col("i").cast("long").alias("vec_id"), "cell", F.round("score", 6).alias("score"), F.round("closure", 6).alias("closure"), "rule")

    @query(f"""{cells} SELECT vec_id, (1700000000 + vec_id) * 1000 AS t_ms, round(v_range, 6) AS v_range, round(v_std, 6) AS v_std, 50.0::DOUBLE AS soc, 21.0::DOUBLE AS t_mean, round(vdev_max, 6) AS vdev_max FROM s""")
    def cell_series_samples(spark, sf_dir):
        s = telemetry.cell_samples(cell_files(spark, sf_dir))
        return s.select(F.col("i").cast("long").alias("vec_id"), "t_ms", *[F.round(c, 6).alias(c) for c in ("v_range", "v_std")], "soc", "t_mean", F.round("vdev_max", 6).alias("vdev_max"))

    def archived(spark, sf_dir) -> str:
        e = events(spark, sf_dir)
        at = folder(spark, "archives")
        rows = e.select((F.col("user_id") % 3).cast("string").alias("archive"), F.concat("event_type", F.lit(".csv")).alias("entry"), F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string")).alias("value"), "t_ms", "event_id")
        archives.pack(rows, at, order=["t_ms", "event_id"])
        return at

    @query(f"{common} SELECT event_id, event_type, value, user_id % 3 AS archive, row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY t_ms, event_id) - 1 AS seq FROM e".replace("SELECT event_id, event_type, value, user_id % 3", "SELECT event_id, event_type, value, CAST(user_id % 3 AS VARCHAR)", 1))
    def archive_lines(spark, sf_dir):
        """The events as archives of an entry for each type, read back entry by entry."""
        found = archives.read(spark, archived(spark, sf_dir), all_sizes=True).filter("status in ('ready', 'cataloged')")
        part = lambda k: F.split_part("value", F.lit(","), F.lit(k))
        return found.select(part(1).cast("long").alias("event_id"), F.regexp_replace("path", r"\.csv$", "").alias("event_type"), part(2).cast("double").alias("value"), F.regexp_extract("archive", r"([^/]*)\.zip$", 1).alias("archive"), "seq")

    @query(f"{common} SELECT CAST(user_id % 3 AS VARCHAR) AS archive, event_type || '.csv' AS path, 0 AS depth, count(*) AS lines FROM e GROUP BY 1, 2")
    def archive_catalog(spark, sf_dir):
        """The entries that the archives' directories name, with the lines that each has."""
        at = archived(spark, sf_dir)
        lines = archives.read(spark, at, all_sizes=True).groupBy("archive", "path").agg(F.count("seq").alias("lines"))
        found = archives.read(spark, at, "catalog").filter("status in ('ready', 'cataloged') and bytes > 0").join(lines, ["archive", "path"])
        return found.select(F.regexp_extract("archive", r"([^/]*)\.zip$", 1).alias("archive"), "path", "depth", "lines")
