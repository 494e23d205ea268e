"""Queries of notes, of bins combined where signals are missing, and of the sources taken when none is chosen."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import notes
from gridlens.operators import evidence, series

SIGNALS = ["a", "b"]


def register(query, table, events, common: str, queries: dict, sqls: dict) -> None:
    day = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN 'unknown' WHEN strftime(make_timestamp({0} * 1000), '%Y-%m-%d') = strftime(make_timestamp({1} * 1000), '%Y-%m-%d') THEN strftime(make_timestamp({0} * 1000), '%Y-%m-%d') ELSE strftime(make_timestamp({0} * 1000), '%Y-%m-%d') || ' ~ ' || strftime(make_timestamp({1} * 1000), '%Y-%m-%d') END"

    @query(f"""{common}, g AS (SELECT user_id, min(t_ms) AS d0, max(t_ms) AS d1, min(t_ms) FILTER (value > 100) AS e0, max(t_ms) FILTER (value > 100) AS e1 FROM e GROUP BY 1), s AS (SELECT *, CAST(e1 - e0 AS DOUBLE) / nullif(d1 - d0, 0) AS share FROM g)
    SELECT user_id, CASE WHEN coalesce(share, 0) < 1 THEN 'user ' || user_id || ': alarms ' || {day.format('e0', 'e1')} || ' of data ' || {day.format('d0', 'd1')} || ' (' || CASE WHEN share IS NULL THEN 'unknown' ELSE regexp_replace(printf('%.1f', floor(share * 1000 + 0.5) / 10), '\\.0$', '') || '%' END || '). Call what lies outside unconfirmed.' END AS note FROM s""")
    def coverage_notes(spark, sf_dir):
        high = F.when(F.col("value") > 100, F.col("t_ms"))
        g = events(spark, sf_dir).groupBy("user_id").agg(F.min("t_ms").alias("d0"), F.max("t_ms").alias("d1"), F.min(high).alias("e0"), F.max(high).alias("e1"))
        source = F.concat(F.lit("user "), F.col("user_id").cast("string"))
        return g.select("user_id", notes.coverage_note(source, (F.col("e0"), F.col("e1")), (F.col("d0"), F.col("d1"))).alias("note"))

    def half(source: str) -> str:
        one = ", ".join(f"min({s}_min) AS {s}_min, max({s}_max) AS {s}_max, sum({s}_mean * n) / sum(n) FILTER ({s}_mean IS NOT NULL) AS {s}_mean" for s in SIGNALS)
        return f"SELECT event_type, min(bin_ms) AS bin_ms, CAST(sum(n) AS BIGINT) AS n, {one} FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY bin_ms) - 1) // 2 AS pair FROM {source}) GROUP BY event_type, pair"

    @query(f"""{common}, b AS (SELECT event_type, t_ms // 86400000 * 86400000 AS bin_ms, count(*) AS n, {", ".join(f"min(value) FILTER ({c}) AS {s}_min, max(value) FILTER ({c}) AS {s}_max, avg(value) FILTER ({c}) AS {s}_mean" for s, c in zip(SIGNALS, ("user_id % 3 = 0", "user_id % 7 = 0 AND value > 80"), strict=True))} FROM e GROUP BY 1, 2),
    h AS ({half("b")}), q AS ({half("h")}) SELECT event_type, bin_ms, n, {", ".join(f"round({s}_{k}, 6) AS {s}_{k}" for s in SIGNALS for k in ("min", "max", "mean"))} FROM q""")
    def halved_bins(spark, sf_dir):
        """Days of two signals, of which either is missing on some, halved twice."""
        held = {"a": "user_id % 3 = 0", "b": "user_id % 7 = 0 and value > 80"}
        of = [f(F.when(F.expr(held[s]), F.col("value"))).alias(f"{s}_{k}") for s in SIGNALS for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
        bins = events(spark, sf_dir).groupBy("event_type", F.expr("t_ms div 86400000 * 86400000").alias("bin_ms")).agg(F.count("*").alias("n"), *of)
        for _ in range(2):
            bins = series.halved(bins, ["event_type"], SIGNALS)
        return bins.select("event_type", "bin_ms", "n", *[F.round(f"{s}_{k}", 6).alias(f"{s}_{k}") for s in SIGNALS for k in ("min", "max", "mean")])

    @query(f"""WITH s AS (SELECT p_partkey, p_brand, score, p_size % 5 <> 0 AS ready, p_partkey % 40 = 0 AS selected FROM ({sqls["file_scores"]}) JOIN part USING (p_partkey)),
    g AS (SELECT p_brand, bool_or(ready AND selected) AS chosen, bool_or(ready AND score >= 3) AS good, min(p_partkey) FILTER (ready) AS head FROM s GROUP BY 1)
    SELECT p_brand, p_partkey, score, CASE WHEN chosen THEN 'chosen' WHEN good THEN 'score' ELSE 'first' END AS why FROM s JOIN g USING (p_brand) WHERE ready AND CASE WHEN chosen THEN selected WHEN good THEN score >= 3 ELSE p_partkey = head END""")
    def taken_sources(spark, sf_dir):
        """Parts as sources of their brand: those chosen, or else the ready ones of score 3 or more, or else the first."""
        p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "p_size % 5 <> 0 as ready", "p_partkey % 40 = 0 as selected")
        return evidence.taken(queries["file_scores"](spark, sf_dir).join(p, "p_partkey"), "p_brand", "p_partkey").select("p_brand", "p_partkey", "score", "why")
