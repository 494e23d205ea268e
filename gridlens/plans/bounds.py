"""Queries of the bounded relations, with limits small enough to act on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.operators import bounded

KEPT = """, s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_ms, event_id) AS rk, count(*) OVER (PARTITION BY event_type) AS seen, min(t_ms) OVER (PARTITION BY event_type) AS lo, max(t_ms) OVER (PARTITION BY event_type) AS hi FROM e),
b AS (SELECT *, CASE WHEN rk > 10 THEN (t_ms - lo) // CAST(86400000 * pow(2, greatest(0, ceil(log2(((hi - lo) // 86400000 + 1) / 8.0)))) AS BIGINT) ELSE -1 END AS bin FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type, bin ORDER BY t_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type, bin) AS n FROM b),
q AS (SELECT p.*, greatest(3, 70 // o) AS k FROM p JOIN (SELECT event_type, count(DISTINCT bin) FILTER (bin >= 0) AS o FROM b GROUP BY 1) USING (event_type)),
kept AS (SELECT *, seen - count(*) OVER (PARTITION BY event_type) AS dropped FROM q WHERE seen <= 80 OR rk <= 10 OR n <= k OR list_contains([j * (n - 1) // (k - 1) for j in range(k)], i))"""


def register(query, table, events, common: str) -> None:
    entity, order = ["event_type"], ["t_ms", "event_id"]

    def kept(spark, sf_dir):
        return bounded.retained(events(spark, sf_dir), entity, order, "t_ms", cap=80, first=10, bins=8, quota=3, chunk=F.expr("t_ms div 604800000"))

    @query(f"{common}{KEPT} SELECT event_type, event_id, dropped FROM kept")
    def retained_events(spark, sf_dir):
        return kept(spark, sf_dir).select("event_type", "event_id", "dropped")

    @query(f"{common}{KEPT}, t AS (SELECT sum(kept)::BIGINT AS kept, sum(dropped)::BIGINT AS dropped FROM (SELECT event_type, count(*) AS kept, any_value(dropped) AS dropped FROM kept GROUP BY 1)) SELECT CAST(year(epoch_ms(k.t_ms)) AS INT) AS year, count(*) AS of_year, any_value(t.kept) AS kept, any_value(t.dropped) AS dropped, any_value(t.kept + t.dropped) AS seen FROM kept k, t GROUP BY 1")
    def retention_summary(spark, sf_dir):
        return bounded.retention_summary(kept(spark, sf_dir), entity, "t_ms")

    @query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1")
    def year_counts(spark, sf_dir):
        return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))

    @query(f"""{common}, r AS (SELECT *, t_ms // 3600000 AS h FROM e), n AS (SELECT *, h <> lag(h) OVER (PARTITION BY event_type ORDER BY h, event_id) AS turn FROM r), x AS (SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY h, event_id) AS r FROM n), l AS (SELECT *, max(r) OVER (PARTITION BY event_type) AS last FROM x),
g AS (SELECT l.*, (SELECT count(*) FROM range(20, 10000, 10) m(turn_at) WHERE turn_at BETWEEN r AND last) AS merges, CASE WHEN r <= 20 THEN r ELSE 11 + (r - 21) % 10 END AS p FROM l)
SELECT event_type, CAST(p >> merges AS BIGINT) AS bin, min(h) AS bin_ms, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean FROM g GROUP BY 1, 2""")
    def adaptive_bins(spark, sf_dir):
        hours = events(spark, sf_dir).withColumn("h", F.expr("t_ms div 3600000"))
        b = bounded.adaptive_bins(hours, entity, ["h", "event_id"], "h", "value", cap=20, chunk=F.expr("h div 168"))
        return b.select("event_type", "bin", "bin_ms", "n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")])

    @query(f"""{common}, c AS (SELECT user_id, event_type, count(*) AS n, min((t_ms, event_id)) AS met FROM e GROUP BY 1, 2), k AS (SELECT user_id FROM c GROUP BY 1 ORDER BY min(met), user_id LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY met) AS rn FROM c WHERE user_id IN (SELECT user_id FROM k)) SELECT user_id, event_type, n FROM r WHERE rn <= 3""")
    def category_counts_capped(spark, sf_dir):
        return bounded.category_counts(events(spark, sf_dir), "user_id", "event_type", order, values=3)

    @query(f"{common} SELECT user_id, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean FROM e WHERE isfinite(value) GROUP BY 1 ORDER BY min((t_ms, event_id)), 1 LIMIT 50")
    def first_metric_keys(spark, sf_dir):
        return bounded.first_metrics(events(spark, sf_dir), "user_id", "value", order).select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")])

    @query(f"{common}, u AS (SELECT CASE WHEN user_id % 9 = 0 THEN 'Bess ' ELSE 'unit ' END || user_id AS name, min(event_id) AS first, max(value) AS top FROM e GROUP BY 1) SELECT name FROM u WHERE name ILIKE '%bess%' OR top > 200 OR name IN (SELECT name FROM u ORDER BY first, name LIMIT 32)")
    def attached_entities(spark, sf_dir):
        name = F.concat(F.when(F.col("user_id") % 9 == 0, "Bess ").otherwise("unit "), F.col("user_id").cast("string"))
        u = events(spark, sf_dir).groupBy(name.alias("name")).agg(F.min("event_id").alias("first"), F.max("value").alias("top"))
        return bounded.attached(u, "name", "first", F.col("top") > 200).select("name")

    @query(f"""{common}, a AS (SELECT event_type, event_id, t_ms FROM e WHERE value > 200), s AS (SELECT event_type, t_ms AS t, max(event_id) AS flag FROM e WHERE value < 20 GROUP BY 1, 2),
n AS (SELECT a.event_id, s.flag, row_number() OVER (PARTITION BY a.event_id ORDER BY CASE WHEN abs(s.t - a.t_ms) < 60000 THEN 0 ELSE 1 END, CASE WHEN abs(s.t - a.t_ms) < 60000 THEN s.t ELSE abs(s.t - a.t_ms) END, s.t) AS rn FROM a JOIN s USING (event_type)) SELECT event_id, flag FROM n WHERE rn = 1""")
    def quality_at_event(spark, sf_dir):
        e = events(spark, sf_dir)
        samples = e.filter("value < 20").groupBy("event_type", "t_ms").agg(F.max("event_id").alias("flag"))
        return bounded.flag_at(e.filter("value > 200").select("event_type", "event_id", "t_ms"), samples, entity, "t_ms", "t_ms", "flag").select("event_id", "flag")
