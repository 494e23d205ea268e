"""Queries on texts, snapshots, contracts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridlens.functions import scalars
from gridlens.operators import evidence
from gridlens.plans.texts import EMAIL, PHONE
from gridlens.session import shared_dir
from gridlens.streaming import live


def register(query, table) -> None:
    @query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '[ \t\x0b\f]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
    def html_text(spark, sf_dir):
        return table(spark, sf_dir, "pages").select("page_id", scalars.html_text(F.col("html")).alias("text"))

    @query(rf"SELECT doc_id, regexp_matches(text, '{EMAIL}') AS has_email, len(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS emails, len(list_distinct(regexp_extract_all(text, '{PHONE}'))) AS phones FROM documents")
    def pii_scan(spark, sf_dir):
        every = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
        return table(spark, sf_dir, "documents").select("doc_id", (F.size(every(scalars.EMAIL)) > 0).alias("has_email"), F.size(every(scalars.EMAIL)).cast("long").alias("emails"), F.size(every(scalars.PHONE)).cast("long").alias("phones"))

    @query("""WITH d AS (SELECT source, doc_id, length(text) AS size, least(length(text), 20000) AS want FROM documents), b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
    SELECT source, doc_id, CAST(greatest(0, least(want, 60000 - before)) AS BIGINT) AS take, greatest(0, least(want, 60000 - before)) < size AS cut FROM b""")
    def doc_budget(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("size"))
        b = evidence.budget(d, ["source"], ["doc_id"], F.col("size"), 20_000, 60_000)
        return b.select("source", "doc_id", F.col("take").cast("long").alias("take"), "cut")

    @query("""SELECT page_id, CAST(CASE WHEN regexp_matches(lower(url), 'bms|ess|pcs|ems|cell|alarm|fault|log') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(split_part(html, chr(10), 1)), 'time|timestamp|date') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(split_part(html, chr(10), 1)), 'volt|voltage|current|temp|soc|soh|alarm|fault|status') THEN 2 ELSE 0 END
    - CASE WHEN string_split(lower(url), '.')[-1] IN ('csv', 'txt', 'log', 'tsv', 'dat') THEN 0 ELSE 5 END AS INT) AS score FROM pages""")
    def source_score(spark, sf_dir):
        first = F.split_part("html", F.lit("\n"), F.lit(1))
        return table(spark, sf_dir, "pages").select("page_id", scalars.source_score(F.col("url"), first).alias("score"))

    @query("""WITH h AS (SELECT l_orderkey, unnest([CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + 1, CAST(l_shipdate AS DATE) + 2]) AS d FROM lineitem)
    SELECT l_orderkey, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day, count(DISTINCT d) AS days FROM h GROUP BY 1""")
    def date_scope(spark, sf_dir):
        """The hull of all days that an order's lines name in text."""
        day = F.col("l_shipdate").cast("date")
        told = F.format_string("shipped %s, expected %s, received %s", F.date_format(day, "yyyy-MM-dd"), F.date_format(F.date_add(day, 1), "yyyy/M/d"), F.date_format(F.date_add(day, 2), "yyyy년 M월 d일"))
        d = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(scalars.days_in(told)).alias("d"))
        text = lambda c: F.date_format(c, "yyyy-MM-dd")
        days = d.groupBy("l_orderkey").agg(F.collect_set("d").alias("ds"))  # a set of days an order: one shuffle, no table of (order, day) in a task
        return days.select("l_orderkey", text(F.array_min("ds")).alias("first_day"), text(F.array_max("ds")).alias("last_day"), F.size("ds").cast("long").alias("days"))

    @query("SELECT o_custkey AS case_id, 'new' AS state FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
    def snapshot_upsert(spark, sf_dir):
        old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("old").alias("state"))
        new = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("case_id")).distinct().withColumn("state", F.lit("new"))
        return evidence.upsert(old, new)

    @query("SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END) AS broken FROM customer")
    def contract_violations(spark, sf_dir):
        c = table(spark, sf_dir, "customer")
        broken = evidence.violations({"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})
        return c.select("c_custkey", F.array_join(broken, ",").alias("broken"))

    @query()
    def stream_equals_batch(spark, sf_dir):
        """Rows of the streaming rule over the events, run to the end."""
        provider = "spark.sql.streaming.stateStore.providerClass"
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        schema = table(spark, sf_dir, "events").schema
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select("event_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))
        run = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
        live.rolling_stream(stream).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{run}/out").select("event_id", "event_type", "base_n", F.round("z_robust", 6).alias("z_robust"), F.round("z_std", 6).alias("z_std"), "stat_alarm")

    @query("""WITH e AS (SELECT event_type, value, epoch_us(ts) // 1000 AS t_ms FROM events), w AS (SELECT max(t_ms) - 86400000 AS mark FROM e)
    SELECT event_type, t_ms // 86400000 * 86400000 AS day_ms, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean FROM e, w GROUP BY 1, 2, mark HAVING day_ms + 86400000 <= mark""")
    def stream_day_windows(spark, sf_dir):
        """The days that the watermark has closed once the stream has read all events."""
        schema = table(spark, sf_dir, "events").schema
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
        run = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
        live.day_windows(stream).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{run}/out").select("event_type", "day_ms", "n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")])
