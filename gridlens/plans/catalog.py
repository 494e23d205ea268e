"""Named queries of the telemetry engine on the driver tables, and their SQL.

An entity is an event type, a signal is `value`, arrival order is (t_ms, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import evidence, forensics, islands, rolling, sampling, segments, series, stats
from gridlens.plans import bounds, drawn, ingest, inline, notes, reports, streams, texts

ENTITY, ORDER = ["event_type"], ["t_ms", "event_id"]
WEEK = "t_ms div 604800000"  # a week of an entity is a task of the rolling rules
QUERIES: dict = {}
SQL: dict[str, str] = {}
EVENTS = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t_ms FROM events)"


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


W15 = "OVER (PARTITION BY event_type ORDER BY t_ms, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)"
SCORED = f"""{EVENTS}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY t_ms, event_id) AS delta FROM e),
b AS (SELECT *, count(value) {W15} AS base_n, avg(value) {W15} AS base_mean, coalesce(stddev_pop(value) {W15}, 0) AS base_std, median(value) {W15} AS base_median,
 coalesce(mad(value) {W15}, 0) AS base_mad, coalesce(median(abs(delta)) {W15}, 0) AS ramp_median FROM d),
z AS (SELECT *, abs(value - base_median) / greatest(1.4826 * base_mad, 0.5) AS z_robust, abs(value - base_mean) / greatest(base_std, 0.5) AS z_std, abs(delta) / greatest(1.4826 * ramp_median, 0.5) AS ramp_score FROM b),
a AS (SELECT *, coalesce(base_n >= 8 AND abs(value - base_median) >= 5 AND (z_robust >= 3 OR z_std >= 3), false) AS stat_alarm, coalesce(base_n >= 8 AND abs(delta) >= 5 AND ramp_score >= 6, false) AS ramp_alarm FROM z)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.alarms(rolling.scores(rolling.baseline(events(spark, sf_dir), "value", ENTITY, ORDER, chunk=F.expr(WEEK)), "value"), "value")


@query(f"{SCORED} SELECT event_id, event_type, base_n, round(base_mean, 6) AS base_mean, round(base_std, 6) AS base_std, round(base_median, 6) AS base_median, round(base_mad, 6) AS base_mad, round(z_robust, 6) AS z_robust, round(z_std, 6) AS z_std FROM a")
def rolling_robust_z(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "event_type", "base_n", *r6("base_mean", "base_std", "base_median", "base_mad", "z_robust", "z_std"))


@query(f"{SCORED} SELECT event_id, event_type, round(value, 6) AS value, stat_alarm, ramp_alarm, concat_ws(' + ', CASE WHEN stat_alarm THEN 'STAT' END, CASE WHEN ramp_alarm THEN 'RAMP' END) AS rule FROM a WHERE stat_alarm OR ramp_alarm")
def rolling_alarm_rows(spark, sf_dir):
    return scored(spark, sf_dir).filter("stat_alarm or ramp_alarm").select("event_id", "event_type", *r6("value"), "stat_alarm", "ramp_alarm", "rule")


@query(f"{SCORED} SELECT event_type, count(*) AS n_rows, count_if(stat_alarm) AS stat_alarms, count_if(ramp_alarm) AS ramp_alarms FROM a GROUP BY event_type")
def alarm_counts_by_entity(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_if("stat_alarm").alias("stat_alarms"), F.count_if("ramp_alarm").alias("ramp_alarms"))


@query(f"""{EVENTS}, m AS (SELECT event_type, median(value) AS mid FROM e GROUP BY 1), d AS (SELECT e.*, value - mid AS dev FROM e JOIN m USING (event_type)),
b AS (SELECT *, count(dev) {W15} AS dev_n, coalesce(median(abs(dev)) {W15}, 0) AS dev_median FROM d)
SELECT event_id, dev_n, round(abs(dev) / greatest(1.4826 * dev_median, 0.5), 6) AS onset_score, coalesce(dev_n >= 8 AND abs(dev) >= 5 AND abs(dev) / greatest(1.4826 * dev_median, 0.5) >= 3, false) AS onset_alarm FROM b""")
def onset_residual(spark, sf_dir):
    e = events(spark, sf_dir)
    mid = e.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    d = e.join(mid, "event_type").withColumn("dev", F.col("value") - F.col("mid"))
    return rolling.onset(d, "dev", ENTITY, ORDER, chunk=F.expr(WEEK)).select("event_id", "dev_n", *r6("onset_score"), "onset_alarm")


RUNS = f"""{EVENTS}, d AS (SELECT *, value - 250 AS dev, event_id % 10 = 0 AS bad FROM e WHERE value IS NOT NULL),
h AS (SELECT *, (NOT bad AND abs(dev) >= 60) AS is_hit, sum(CASE WHEN NOT bad AND abs(dev) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t_ms, event_id) AS island FROM d),
r AS (SELECT *, sum(is_hit::INT) OVER (PARTITION BY event_type, island ORDER BY t_ms, event_id) AS run FROM h),
f AS (SELECT *, is_hit AND run >= 5 AS fired FROM r),
w AS (SELECT event_type, island, min(t_ms) AS start, max(t_ms) AS stop, count(*) AS fires, max(abs(dev)) AS max_abs, arg_max(dev, (abs(dev), event_id)) AS max_signed FROM f WHERE fired GROUP BY 1, 2)"""


def counted(spark, sf_dir) -> DataFrame:
    d = events(spark, sf_dir).withColumn("dev", F.col("value") - 250)
    return islands.runs(d, "dev", F.col("event_id") % 10 == 0, ENTITY, ORDER, hit=60.0, fire=5, chunk=F.expr(WEEK))


def sustained(spark, sf_dir) -> DataFrame:
    return islands.windows(counted(spark, sf_dir), "dev", "t_ms", ENTITY, "event_id")


@query(f"{RUNS} SELECT event_id, event_type, CAST(island AS BIGINT) AS island, CAST(run AS BIGINT) AS run, fired FROM f")
def sustained_runs(spark, sf_dir):
    return counted(spark, sf_dir).select("event_id", "event_type", "island", "run", "fired")


@query(f"{RUNS} SELECT event_type, CAST(island AS BIGINT) AS island, start, stop, fires, round(max_abs, 6) AS max_abs, round(max_signed, 6) AS max_signed FROM w")
def sustained_windows(spark, sf_dir):
    return sustained(spark, sf_dir).select("event_type", "island", "start", "stop", "fires", *r6("max_abs", "max_signed"))


@query(f"{RUNS}, c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY start, island) AS rn, greatest(count(*) OVER (PARTITION BY event_type) - 20, 0) AS dropped FROM w) SELECT event_type, start, fires, rn, dropped FROM c WHERE rn <= 20")
def sustained_windows_capped(spark, sf_dir):
    return islands.capped(sustained(spark, sf_dir), ENTITY, 20).select("event_type", "start", "fires", "rn", "dropped")


@query(f"""{EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_ms, event_id) AS rn FROM e)
SELECT a.event_id, b.event_id AS context_id, b.rn - a.rn AS back FROM n a JOIN n b ON a.event_type = b.event_type AND b.rn BETWEEN a.rn - 4 AND a.rn WHERE a.value > 150""")
def context_windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy(*ENTITY).orderBy(*ORDER)))
    rows = rolling.context(e, ["event_id", "rn"], ENTITY, ORDER).filter("value > 150")
    return rows.select("event_id", "rn", F.explode("context").alias("c")).select("event_id", F.col("c.event_id").alias("context_id"), (F.col("c.rn") - F.col("rn")).cast("long").alias("back"))


@query("""SELECT l_returnflag, metric, round(min(v), 6) AS min, round(max(v), 6) AS max, round(sum(v), 2) AS sum, count(v) AS n, round(avg(v), 6) AS mean FROM
(SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1, 2""")
def numeric_stats(spark, sf_dir):
    return stats.numeric_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag"]).select("l_returnflag", "metric", *r6("min", "max"), F.round("sum", 2).alias("sum"), "n", *r6("mean"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count_if(l_discount > 0.05) AS flagged FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def stats_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows"), F.count_if(F.col("l_discount") > 0.05).alias("flagged"))


@query(f"""{EVENTS}, s AS (SELECT event_type, user_id, count(*) AS n, min((t_ms, event_id)) AS first FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS rk FROM s)
SELECT event_type, CASE WHEN rk <= 20 THEN CAST(user_id AS VARCHAR) ELSE 'other' END AS reason, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def reason_counts_capped(spark, sf_dir):
    return stats.counts_capped(events(spark, sf_dir), ENTITY, "user_id", ORDER)


@query(f"""{EVENTS}, p AS (SELECT min(t_ms) AS lo, max(t_ms) AS hi FROM e), k AS (SELECT lo, 86400000 * min(CASE WHEN floor((hi - lo) / (86400000.0 * (1::BIGINT << i))) < 24 THEN (1::BIGINT << i) END) AS width_ms FROM p, range(30) t(i) GROUP BY lo)
SELECT width_ms, CAST(floor((t_ms - lo)::DOUBLE / width_ms) AS INT) AS bin, event_type, count(*) AS n FROM e, k GROUP BY 1, 2, 3""")
def category_over_time(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("all", F.lit(1))
    return stats.category_over_time(e, ["all"], "event_type", "t_ms").select("width_ms", "bin", "event_type", "n")


@query(f"""{EVENTS}, r AS (SELECT event_type, min(t_ms) AS data_lo, max(t_ms) AS data_hi, min(t_ms) FILTER (value > 100) AS kept_lo, max(t_ms) FILTER (value > 100) AS kept_hi FROM e GROUP BY 1)
SELECT *, round(CASE WHEN kept_lo IS NULL THEN NULL WHEN data_hi <= data_lo THEN 1.0 ELSE least(1.0, (kept_hi - kept_lo)::DOUBLE / (data_hi - data_lo)) END, 6) AS coverage FROM r""")
def time_range_coverage(spark, sf_dir):
    return stats.time_coverage(events(spark, sf_dir), ENTITY, "t_ms", F.col("value") > 100).select("event_type", "data_lo", "data_hi", "kept_lo", "kept_hi", *r6("coverage"))


@query(f"""{EVENTS}, p AS (SELECT event_type, min(t_ms) AS lo, max(t_ms) AS hi FROM e GROUP BY 1), c AS (SELECT event_type, CAST(least(7, floor((t_ms - lo) * 8.0 / (hi - lo))) AS INT) AS bucket, count(*) AS n FROM e JOIN p USING (event_type) GROUP BY 1, 2)
SELECT event_type, CAST(i AS INT) AS bucket, coalesce(n, 0) AS n FROM (SELECT event_type, i FROM p, range(8) t(i)) f LEFT JOIN c ON f.event_type = c.event_type AND f.i = c.bucket""".replace("SELECT event_type, CAST(i", "SELECT f.event_type, CAST(i"))
def time_histogram(spark, sf_dir):
    return stats.time_histogram(events(spark, sf_dir), ENTITY, "t_ms").select("event_type", "bucket", "n")


BINS = f"{EVENTS}, b AS (SELECT event_type, t_ms // 86400000 * 86400000 AS bin_ms, count(value) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM e GROUP BY 1, 2)"


def bins(spark, sf_dir) -> DataFrame:
    return series.day_bins(events(spark, sf_dir), ENTITY, "t_ms", "value")


@query(f"{BINS} SELECT event_type, bin_ms, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean FROM b")
def series_day_bins(spark, sf_dir):
    return bins(spark, sf_dir).select("event_type", "bin_ms", "n", *r6("lo", "hi", "mean"))


@query(f"""{BINS}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bin_ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM b),
t AS (SELECT *, CAST(floor(i / pow(2, greatest(0, ceil(log2(c / 12.0))))) AS INT) AS tile FROM i)
SELECT event_type, tile, min(bin_ms) AS bin_ms, CAST(sum(n) AS BIGINT) AS n, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, round(sum(mean * n) / sum(n), 6) AS mean FROM t GROUP BY 1, 2""")
def series_tiled_bins(spark, sf_dir):
    return series.tiled_bins(bins(spark, sf_dir), ENTITY, 12).select("event_type", "tile", "bin_ms", "n", *r6("lo", "hi", "mean"))


@query(f"{BINS} SELECT bin_ms, CAST(sum(n) AS BIGINT) AS n, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, round(sum(mean * n) / sum(n), 6) AS mean FROM b WHERE event_type IN ('click', 'view') GROUP BY 1")
def series_merge(spark, sf_dir):
    parts = [bins(spark, sf_dir).filter(F.col("event_type") == t).withColumn("event_type", F.lit("both")) for t in ("click", "view")]
    return series.merge(parts, ENTITY).select("bin_ms", "n", *r6("lo", "hi", "mean"))


@query(f"{EVENTS}, r AS (SELECT user_id, max(value) - min(value) AS range, count(*) AS n FROM e GROUP BY 1) SELECT user_id, round(range, 6) AS range, n FROM r ORDER BY range DESC, n DESC, user_id LIMIT 8")
def top_entities_by_range(spark, sf_dir):
    b = series.day_bins(events(spark, sf_dir), ["user_id"], "t_ms", "value")
    return series.top_entities(b, "user_id").select("user_id", *r6("range"), "n")


@query("""WITH g AS (SELECT o_custkey, o_orderpriority, count_if(o_totalprice > 200000) AS alarms, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY alarms DESC, n DESC, o_custkey) AS rn FROM g)
SELECT o_orderpriority, CAST(CASE WHEN rn <= 10 THEN rn ELSE 11 END AS INT) AS slot, count(*) AS members, CAST(sum(alarms) AS BIGINT) AS alarms, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def top_groups_with_rest(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 200000).alias("alarms"), F.count("*").alias("n"))
    return stats.top_with_rest(g, ["o_orderpriority"], [F.desc("alarms"), F.desc("n"), F.col("o_custkey")], ["alarms", "n"], 10)


STEP = f"""{BINS}, s AS (SELECT *, lag(mean) OVER (PARTITION BY event_type ORDER BY bin_ms) AS from_y FROM b), g AS (SELECT *, mean - from_y AS step, row_number() OVER (PARTITION BY event_type ORDER BY abs(mean - from_y) DESC, bin_ms) AS rn FROM s WHERE from_y IS NOT NULL)"""


@query(f"{STEP} SELECT event_type, bin_ms AS t, round(step, 6) AS step, round(from_y, 6) AS from_y, round(mean, 6) AS to_y FROM g WHERE rn = 1")
def step_anchor(spark, sf_dir):
    return forensics.step_anchor(bins(spark, sf_dir), ENTITY).select("event_type", "t", *r6("step", "from_y", "to_y"))


@query(f"{EVENTS}, g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(value) DESC, t_ms) AS rn FROM e) SELECT event_type, t_ms AS t, round(value, 6) AS y FROM g WHERE rn = 1")
def level_anchor(spark, sf_dir):
    return forensics.level_anchor(events(spark, sf_dir), ENTITY, "t_ms", "value").select("event_type", "t", *r6("y"))


@query(f"""{STEP}, n AS (SELECT b.event_type, b.bin_ms, b.mean - first_value(b.mean) OVER (PARTITION BY b.event_type ORDER BY b.bin_ms) AS change FROM b JOIN g ON b.event_type = g.event_type AND g.rn = 1 WHERE b.bin_ms BETWEEN g.bin_ms - 1728000000 AND g.bin_ms + 1728000000)
SELECT event_type, bin_ms, round(change / greatest(max(abs(change)) OVER (PARTITION BY event_type), 1e-6), 6) AS y_norm FROM n""")
def normalized_window(spark, sf_dir):
    b = bins(spark, sf_dir)
    near = forensics.around(b, forensics.step_anchor(b, ENTITY), ENTITY, "bin_ms", 20 * 86_400_000)
    return forensics.normalized(near, ENTITY, "bin_ms", "mean").select("event_type", "bin_ms", *r6("y_norm"))


@query(f"""{STEP}, p AS (SELECT g.event_type, g.bin_ms AS t, min(b.bin_ms) AS lo, max(b.bin_ms) AS hi FROM g JOIN b ON b.event_type = g.event_type WHERE g.rn = 1 GROUP BY 1, 2), q AS (SELECT *, greatest(lo, t - 600000) AS s, least(hi, t + 600000) AS f FROM p)
SELECT event_type, 'Normal' AS state, lo AS from_ms, s AS to_ms FROM q UNION ALL SELECT event_type, 'Precursor', s, t FROM q UNION ALL SELECT event_type, 'Main', t, t FROM q UNION ALL SELECT event_type, 'Recovery', t, f FROM q""")
def event_states(spark, sf_dir):
    b = bins(spark, sf_dir)
    spans = b.groupBy("event_type").agg(F.min("bin_ms").alias("lo"), F.max("bin_ms").alias("hi")).join(forensics.step_anchor(b, ENTITY).select("event_type", "t"), "event_type")
    return forensics.event_states(spans)


@query(f"""{EVENTS}, f AS (SELECT user_id, t_ms FROM e WHERE event_type = 'click'), s AS (SELECT user_id, t_ms, min(value) AS value FROM e WHERE event_type = 'view' GROUP BY 1, 2),
j AS (SELECT f.user_id, f.t_ms, s.t_ms AS near_ms, s.value AS near_y, row_number() OVER (PARTITION BY f.user_id, f.t_ms ORDER BY abs(s.t_ms - f.t_ms), s.t_ms) AS rn FROM f LEFT JOIN s USING (user_id))
SELECT user_id, t_ms, near_ms, round(coalesce(near_y, 0), 6) AS near_y FROM j WHERE rn = 1""")
def nearest_sample_join(spark, sf_dir):
    e = events(spark, sf_dir)
    grid = e.filter("event_type = 'click'").select("user_id", "t_ms").distinct()
    return forensics.nearest(grid, e.filter("event_type = 'view'"), ["user_id"], "t_ms", "value", chunk="t div 604800000").select("user_id", "t_ms", "near_ms", *r6("near_y"))


CORR = f"""{BINS}, f AS (SELECT bin_ms, mean AS fy FROM b WHERE event_type = 'click'), j AS (SELECT b.event_type, b.bin_ms, mean AS y, fy FROM b JOIN f USING (bin_ms) WHERE b.event_type <> 'click'),
c AS (SELECT event_type, CASE WHEN count(*) < 4 THEN 0 ELSE coalesce(corr(y, fy), 0) END AS corr, sign(arg_max(y, bin_ms) - arg_min(y, bin_ms)) = sign(arg_max(fy, bin_ms) - arg_min(fy, bin_ms)) AS same_sign FROM j GROUP BY 1)"""


def peers(spark, sf_dir) -> DataFrame:
    b = bins(spark, sf_dir)
    focus = b.filter("event_type = 'click'").select("bin_ms", F.col("mean").alias("fy"))
    j = b.filter("event_type <> 'click'").join(focus, "bin_ms")
    ends = lambda c: F.sign(F.max_by(c, "bin_ms") - F.min_by(c, "bin_ms"))
    return j.groupBy("event_type").agg(stats.correlation("mean", "fy").alias("corr"), (ends("mean") == ends("fy")).alias("same_sign"))


@query(f"{CORR} SELECT event_type, round(corr, 6) AS corr, same_sign FROM c")
def peer_correlation(spark, sf_dir):
    return peers(spark, sf_dir).select("event_type", *r6("corr"), "same_sign")


@query(f"""{CORR}, r AS (SELECT count_if(corr >= 0.45 AND same_sign) AS support, count(*) AS peers, avg(corr) AS mean_corr FROM c)
SELECT support, peers, round(mean_corr, 6) AS mean_corr, CASE WHEN peers = 0 THEN 'unknown' WHEN support >= 1 AND mean_corr >= 0.35 THEN 'common' ELSE 'local' END AS mode FROM r""")
def common_mode(spark, sf_dir):
    return forensics.common_mode(peers(spark, sf_dir)).select("support", "peers", *r6("mean_corr"), "mode")


@query(f"""{EVENTS}, d AS (SELECT event_type, t_ms - lag(t_ms) OVER w AS dt, abs(value - lag(value) OVER w) AS dv FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t_ms, event_id)),
q AS (SELECT event_type, list_sort(list(dv / (dt / 3600000.0))) AS s FROM d WHERE dt > 0 GROUP BY 1) SELECT event_type, round(s[CAST(floor(0.5 * (len(s) - 1)) AS INT) + 1], 4) AS p50, round(s[CAST(floor(0.95 * (len(s) - 1)) AS INT) + 1], 4) AS p95, round(s[len(s)], 4) AS max FROM q""")
def rate_of_change_quantiles(spark, sf_dir):
    steps = segments.previous(events(spark, sf_dir), ENTITY, ORDER, F.expr(WEEK), t0=F.col("t_ms"), v0=F.col("value"))
    d = steps.select("event_type", (F.col("t_ms") - F.col("t0")).alias("dt"), F.abs(F.col("value") - F.col("v0")).alias("dv")).filter("dt > 0")
    q = stats.lower_quantiles(d.withColumn("rate", F.col("dv") / (F.col("dt") / F.lit(3600000.0))), "rate", {"p50": 0.5, "p95": 0.95}, ENTITY)
    return q.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "max")])


TRANS = """WITH d AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER w AS i0, l_quantity - lag(l_quantity) OVER w AS di, l_extendedprice - lag(l_extendedprice) OVER w AS dv FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
t AS (SELECT *, -dv / di AS r FROM d WHERE abs(di) >= 5 AND NOT (abs(i0) < 2 AND abs(l_quantity) < 2))"""


def moved(spark, sf_dir) -> DataFrame:
    return forensics.transitions(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", "l_extendedprice")


@query(f"{TRANS} SELECT l_suppkey, l_orderkey, l_linenumber, round(di, 6) AS di, round(r, 8) AS r FROM t")
def transition_events(spark, sf_dir):
    return moved(spark, sf_dir).select("l_suppkey", "l_orderkey", "l_linenumber", *r6("di"), F.round("r", 8).alias("r"))


@query("""WITH q AS (SELECT l_returnflag, list_sort(list(l_quantity))[CAST(floor(0.5 * (count(l_quantity) - 1)) AS INT) + 1] AS mq, list_sort(list(l_tax))[CAST(floor(0.5 * (count(l_tax) - 1)) AS INT) + 1] AS mt, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, count(*) AS matched, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem l JOIN q USING (l_returnflag) WHERE n < 8 OR (abs(l_quantity - mq) <= 15 AND abs(l_tax - mt) <= 0.02000001) GROUP BY 1""")
def operating_point_match(spark, sf_dir):
    m = forensics.matched_point(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"l_quantity": 15.0, "l_tax": 0.02000001})
    return m.groupBy("l_returnflag").agg(F.count("*").alias("matched"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query(f"""{TRANS}, n AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, r) AS rn FROM t)
SELECT l_suppkey, round(median(r) FILTER (rn > n - greatest(4, floor(n / 5.0))) - median(r) FILTER (rn <= greatest(4, floor(n / 5.0))), 4) AS drift FROM n WHERE n >= 4 GROUP BY 1""")
def drift_by_entity(spark, sf_dir):
    return forensics.drift(moved(spark, sf_dir), ["l_suppkey"], ["l_orderkey", "l_linenumber", "r"], "r").select("l_suppkey", F.round("drift", 4).alias("drift"))


DAILY = f"{EVENTS}, y AS (SELECT event_type, t_ms // 86400000 AS day, median(value) AS y FROM e GROUP BY 1, 2)"


def daily(spark, sf_dir) -> DataFrame:
    day = F.floor(F.col("t_ms") / 86_400_000).cast("long").alias("day")
    return events(spark, sf_dir).groupBy("event_type", day).agg(F.percentile("value", F.lit(0.5)).alias("y"))


@query(f"{DAILY} SELECT event_type, day, round(y, 6) AS y FROM y")
def daily_median(spark, sf_dir):
    return daily(spark, sf_dir).select("event_type", "day", *r6("y"))


PIECE = f"""{DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM y),
s AS (SELECT *, regr_slope(y, i) OVER l AS ls, regr_syy(y, i) OVER l - coalesce(regr_sxy(y, i) OVER l ** 2 / regr_sxx(y, i) OVER l, 0) AS le, regr_slope(y, i) OVER r AS rs, regr_syy(y, i) OVER r - coalesce(regr_sxy(y, i) OVER r ** 2 / regr_sxx(y, i) OVER r, 0) AS re FROM i
 WINDOW l AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(le + re, 6), i) AS rn FROM s WHERE n >= 24 AND i BETWEEN 8 AND n - 9)"""


@query(f"{PIECE} SELECT event_type, day AS knee_x, CAST(i AS INT) AS split, round(le + re, 2) AS sse FROM k WHERE rn = 1")
def piecewise_knee(spark, sf_dir):
    return forensics.piecewise_knee(daily(spark, sf_dir), ENTITY, "day", "y").select("event_type", "knee_x", "split", F.round("sse", 2).alias("sse"))


CHORD_ONLY = """b AS (SELECT *, first_value(day) OVER w AS x0, last_value(day) OVER w AS x1, first_value(y) OVER w AS y0, last_value(y) OVER w AS y1 FROM y WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, round((day - x0)::DOUBLE / (x1 - x0) - (y - y0) / (y1 - y0), 9) AS gap FROM b), c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gap DESC, day) AS rn FROM q WHERE gap IS NOT NULL)"""
CHORD = f"{DAILY}, {CHORD_ONLY}"


@query(f"{CHORD} SELECT event_type, day AS knee_x, round(gap, 6) AS gap FROM c WHERE rn = 1")
def chord_knee(spark, sf_dir):
    return forensics.chord_knee(daily(spark, sf_dir), ENTITY, "day", "y").select("event_type", "knee_x", *r6("gap"))


@query(f"""{PIECE}, {CHORD_ONLY}, sp AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM y GROUP BY 1)
SELECT sp.event_type, k.day AS px, c.day AS cx, CASE WHEN k.day IS NULL THEN 'no piecewise knee' WHEN c.day IS NULL THEN 'no chord knee' WHEN abs(k.day - c.day) > 0.25 * (hi - lo) THEN 'methods disagree' END AS reason FROM sp LEFT JOIN k ON k.event_type = sp.event_type AND k.rn = 1 LEFT JOIN c ON c.event_type = sp.event_type AND c.rn = 1""")
def knee_agreement(spark, sf_dir):
    d = daily(spark, sf_dir)
    spans = d.groupBy("event_type").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    both = forensics.knee_agreement(forensics.piecewise_knee(d, ENTITY, "day", "y"), forensics.chord_knee(d, ENTITY, "day", "y"), spans, ENTITY)
    return both.select("event_type", "px", "cx", "reason")


CELLS = """WITH c AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 9) t(i)), r AS (SELECT a.vec_id, a.i, a.v - median(b.v) AS res FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY a.vec_id, a.i, a.v),
o AS (SELECT vec_id, i, res, row_number() OVER (PARTITION BY vec_id ORDER BY abs(res) DESC, i) AS rn FROM r)"""


def cells(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("c"))
    return c.withColumn("res", rolling.cell_residuals(F.col("c"))).withColumn("cell", rolling.outlier_cell(F.col("res")))


@query(f"{CELLS} SELECT vec_id, CAST(i AS INT) AS cell, round(res, 6) AS residual FROM r")
def peer_residual(spark, sf_dir):
    return cells(spark, sf_dir).select("vec_id", F.posexplode("res").alias("p", "residual")).select("vec_id", (F.col("p") + 1).alias("cell"), *r6("residual"))


@query(f"""{CELLS}, v AS (SELECT i, count(*) AS votes FROM o WHERE rn = 1 GROUP BY 1) SELECT CAST(i AS INT) AS cell, votes, round(votes / sum(votes) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY votes DESC) AS INT) AS place FROM v""")
def outlier_vote(spark, sf_dir):
    return evidence.votes(cells(spark, sf_dir), "cell").select("cell", "votes", *r6("share"), "place")


@query(f"""{CELLS}, v AS (SELECT i, count(*) AS votes FROM o WHERE rn = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), m AS (SELECT i, avg(v) AS s FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT CAST(v.i AS INT) AS first_cell, CAST(m.i AS INT) AS second_cell, CASE WHEN v.i = m.i THEN 'agree' ELSE 'conflict' END AS state FROM v, m""")
def attribution_conflict(spark, sf_dir):
    c = cells(spark, sf_dir)
    means = c.select(F.posexplode("c").alias("p", "v")).groupBy((F.col("p") + 1).alias("cell")).agg(F.avg("v").alias("score"))
    return evidence.conflict(evidence.votes(c, "cell").withColumnRenamed("votes", "score"), means).select("first_cell", "second_cell", "state")


@query(f"{EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_ms, event_id) AS rn FROM e) SELECT event_type, event_id, CAST(rn AS INT) AS rn FROM r WHERE rn <= 15")
def head_sample(spark, sf_dir):
    return sampling.head(events(spark, sf_dir), ENTITY, ORDER).select("event_type", "event_id", "rn")


@query(f"""{EVENTS}, p AS (SELECT event_type, min(t_ms) AS lo, max(t_ms) AS hi FROM e GROUP BY 1), s AS (SELECT a.*, CAST(CASE WHEN hi > lo THEN least(7, floor((t_ms - lo) * 8.0 / (hi - lo))) ELSE 0 END AS INT) AS stratum FROM e a JOIN p USING (event_type) WHERE value > 100),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, stratum ORDER BY t_ms, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM s), k AS (SELECT * FROM r WHERE rn <= 5)
SELECT event_type, stratum, event_id, n - count(*) OVER (PARTITION BY event_type) AS dropped FROM k""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(events(spark, sf_dir), ENTITY, "t_ms", ORDER, F.col("value") > 100).select("event_type", "stratum", "event_id", "dropped")


@query()
def retained_alarms(spark, sf_dir):
    """Events over 100 as alarms, kept as a reader in arrival order (by id) keeps them; tests hold it against a plain fold."""
    kept = sampling.retained_alarms(events(spark, sf_dir), ENTITY, ["event_id"], "t_ms", F.col("value") > 100, chunk=F.expr("event_id div 5000"))
    return kept.select("event_type", "event_id", "t_ms", "dropped")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.09)")
def semi_citation(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return evidence.cited(table(spark, sf_dir, "orders"), cited, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.09)")
def anti_unmatched(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return evidence.uncited(table(spark, sf_dir, "orders"), cited, ["o_orderkey"]).select("o_orderkey")


@query(f"""{RUNS}, k AS (SELECT 1 AS kind, event_type AS entity, start AS at_ms, 'sustained' AS rule, CAST(fires AS BIGINT) AS weight FROM w UNION ALL SELECT 2, event_type, t_ms, 'level', CAST(floor(value) AS BIGINT) FROM e WHERE value > 250),
n AS (SELECT *, row_number() OVER (ORDER BY kind, at_ms, entity, weight) AS i FROM k) SELECT printf('E%03d', i) AS evidence_id, entity, at_ms, rule, weight FROM n WHERE i <= 80""")
def evidence_ledger(spark, sf_dir):
    w = sustained(spark, sf_dir).select(F.lit(1).alias("kind"), F.col("event_type").alias("entity"), F.col("start").alias("at_ms"), F.lit("sustained").alias("rule"), F.col("fires").alias("weight"))
    e = events(spark, sf_dir).filter("value > 250").select(F.lit(2).alias("kind"), F.col("event_type").alias("entity"), F.col("t_ms").alias("at_ms"), F.lit("level").alias("rule"), F.floor("value").cast("long").alias("weight"))
    return evidence.ledger([w, e], ["kind", "at_ms", "entity", "weight"]).select("evidence_id", "entity", "at_ms", "rule", "weight")


@query("SELECT l_shipmode, count(*) AS n FROM (SELECT CASE WHEN abs(l_discount - 0.05) < 0.02 THEN 'near' WHEN l_discount < 0.05 THEN 'below' ELSE 'above' END AS l_shipmode FROM lineitem) GROUP BY 1".replace("l_shipmode", "side"))
def residual_buckets(spark, sf_dir):
    side = F.when(F.abs(F.col("l_discount") - 0.05) < 0.02, "near").when(F.col("l_discount") < 0.05, "below").otherwise("above")
    return table(spark, sf_dir, "lineitem").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query(f"""{EVENTS}, g AS (SELECT event_type, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY event_type ORDER BY t_ms, event_id) AS gap FROM e) SELECT event_type, max(gap) AS gap, round(max(gap)::DOUBLE / (max(t_ms) - min(t_ms)), 6) AS share FROM g GROUP BY 1""")
def largest_gap(spark, sf_dir):
    return stats.largest_gap(events(spark, sf_dir), ENTITY, ORDER, "t_ms", F.expr(WEEK)).select("event_type", "gap", *r6("share"))


@query(f"{CELLS} SELECT vec_id, round(stddev_pop(v), 6) AS spread, round(max(v) - median(v), 6) AS hottest FROM c GROUP BY 1")
def cell_spread(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.select("vec_id", F.round(rolling.cell_spread(F.col("c")), 6).alias("spread"), F.round(rolling.hottest(F.col("c")), 6).alias("hottest"))


@query(f"{RUNS}, c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY start, island) AS rn, greatest(count(*) OVER (PARTITION BY event_type) - 20, 0) AS dropped FROM w), k AS (SELECT event_type, count(*) AS kept, max(dropped) AS dropped, sum(fires) AS fires FROM c WHERE rn <= 20 GROUP BY 1) SELECT count(*) AS entities, coalesce(sum(kept), 0)::BIGINT AS kept, coalesce(sum(dropped), 0)::BIGINT AS dropped, coalesce(sum(fires), 0)::BIGINT AS fires FROM k")
def sustained_rollup(spark, sf_dir):
    return islands.rollup(islands.capped(sustained(spark, sf_dir), ENTITY, 20), ENTITY)


@query(f"{EVENTS}, g AS (SELECT user_id % 7 AS file, event_type, min(t_ms) AS lo, max(t_ms) AS hi, count(*) AS n, count_if(value IS NULL) AS untold FROM e GROUP BY 1, 2) SELECT file, count(*) AS groups, min(lo) AS lo, max(hi) AS hi, sum(n)::BIGINT AS n, sum(untold)::BIGINT AS untold FROM g GROUP BY 1")
def file_rollup(spark, sf_dir):
    """Times and counts of the groups of a file, then of the file."""
    groups = events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("file"), "event_type").agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("untold"))
    return groups.groupBy("file").agg(F.count("*").alias("groups"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("untold").alias("untold"))


bounds.register(query, table, events, EVENTS)
inline.register(query, table)
streams.register(query, events, RUNS)
ingest.register(query, table, events, EVENTS, SCORED)
texts.register(query, table, events, EVENTS)
reports.register(query, table, events, EVENTS)
drawn.register(query, table, events, EVENTS, PIECE[len(DAILY) + 2 :], CHORD_ONLY)
notes.register(query, table, events, EVENTS, QUERIES, SQL)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
