"""Queries of the figures, of the ledger and of the source profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.operators import evidence, figures, forensics, series, stats

HOUR = 3_600_000


def told(found, **stat: str):
    """figure, available, reason and one number of each figure."""
    out = F.lit(None).cast("double")
    for name, key in stat.items():
        out = F.when(F.col("figure") == name.replace("_", "-"), F.get_json_object("stats", f"$.{key}").try_cast("double")).otherwise(out)
    return found.select("figure", "available", "reason", F.round(out, 4).alias("stat"))


def register(query, table, events, common: str, piece: str, chord: str) -> None:
    grid = f"""{common}, h AS (SELECT event_type AS entity, t_ms // {HOUR} * {HOUR} AS b, count(value) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM e GROUP BY 1, 2),
    f AS (SELECT entity, max(hi) - min(lo) AS range FROM h GROUP BY 1 ORDER BY 2 DESC, sum(n) DESC, 1 LIMIT 1), own AS (SELECT h.* FROM h JOIN f USING (entity)),
    st AS (SELECT *, mean - lag(mean) OVER (ORDER BY b) AS step, b - lag(b) OVER (ORDER BY b) AS dt FROM own), an AS (SELECT entity, b AS ta FROM st WHERE step IS NOT NULL ORDER BY abs(step) DESC, b LIMIT 1),
    rt AS (SELECT list_sort(list(abs(step) / (dt / {HOUR}.0))) AS r FROM st WHERE dt > 0),
    w AS (SELECT h.*, (mean - first_value(mean) OVER x) AS ch FROM h, an WHERE b BETWEEN ta - 86400000 AND ta + 86400000 WINDOW x AS (PARTITION BY h.entity ORDER BY b)),
    nm AS (SELECT *, ch / greatest(max(abs(ch)) OVER (PARTITION BY entity), 1e-6) AS y FROM w),
    gr AS (SELECT nm.b, nm.y AS fy FROM nm JOIN f USING (entity)),
    nr AS (SELECT p.entity, gr.b, gr.fy, p.y, row_number() OVER (PARTITION BY p.entity, gr.b ORDER BY abs(p.b - gr.b), p.b) AS rn FROM gr, nm p WHERE p.entity NOT IN (SELECT entity FROM f)),
    co AS (SELECT entity, CASE WHEN count(*) < 4 THEN 0 ELSE coalesce(corr(y, fy), 0) END AS c, count(*) >= 2 AND sign(arg_max(y, b)) = sign(arg_max(fy, b)) AS s FROM nr WHERE rn = 1 GROUP BY 1),
    q AS (SELECT CASE WHEN e.event_id % 7 = 0 THEN 0 ELSE 1 END AS quality FROM e, an WHERE event_type = an.entity ORDER BY CASE WHEN abs(t_ms - ta) < 60000 THEN 0 ELSE 1 END, CASE WHEN abs(t_ms - ta) < 60000 THEN t_ms ELSE abs(t_ms - ta) END, t_ms LIMIT 1)"""

    def hours(spark, sf_dir, value):
        e = events(spark, sf_dir)
        b = series.day_bins(e.withColumn("value", value).withColumn("t_ms", F.expr(f"(t_ms div {HOUR}) * 86400000")), ["event_type"], "t_ms", "value")
        return b.withColumn("bin_ms", F.expr(f"bin_ms div 86400000 * {HOUR}")).withColumnRenamed("event_type", "entity")

    @query(f"""{grid} SELECT * FROM (VALUES ('A-F1', true, NULL, (SELECT round(range, 4) FROM f)), ('A-F2', (SELECT count(*) >= 3 FROM own, an WHERE b BETWEEN ta - 43200000 AND ta + 43200000), CASE WHEN (SELECT count(*) < 3 FROM own, an WHERE b BETWEEN ta - 43200000 AND ta + 43200000) THEN 'too few points around the event' END, (SELECT count(*) FROM own, an WHERE b BETWEEN ta - 43200000 AND ta + 43200000)::DOUBLE),
    ('A-F3', true, NULL, (SELECT round(r[floor(0.95 * (len(r) - 1))::INT + 1], 4) FROM rt)), ('A-F4', true, NULL, (SELECT round(avg(c), 4) FROM co)), ('A-F5', true, NULL, (SELECT quality FROM q)::DOUBLE), ('A-F6', true, NULL, (SELECT round(mean - 250, 4) FROM own ORDER BY abs(mean - 250) DESC, b LIMIT 1))) t(figure, available, reason, stat)""")
    def grid_figures(spark, sf_dir):
        """The six figures of power series on the events: hours as bins, half a day around the event, a day around it for its peers."""
        samples = events(spark, sf_dir).select(F.col("event_type").alias("entity"), F.col("t_ms").alias("t"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(1).alias("quality"))
        found, _ = figures.grid_figures(hours(spark, sf_dir, F.col("value")), samples, hours(spark, sf_dir, F.col("value") - 250), event_ms=43_200_000, peer_ms=86_400_000)
        return told(found, A_F1="range", A_F2="points", A_F3="p95", A_F4="mean_corr", A_F5="quality", A_F6="deviation")

    @query(f"{grid} SELECT 'A-F1' AS figure, count(*) AS n, min(b)::DOUBLE AS x0, round(avg(mean), 4) AS y FROM own UNION ALL SELECT 'A-F3', (SELECT count(*) FROM st WHERE dt > 0), (SELECT min(b)::DOUBLE FROM st WHERE dt > 0), (SELECT round(list_avg(r), 4) FROM rt) UNION ALL SELECT 'A-F4', count(*), min(b)::DOUBLE, round(avg(mean), 4) FROM w")
    def figure_points(spark, sf_dir):
        samples = events(spark, sf_dir).select(F.col("event_type").alias("entity"), F.col("t_ms").alias("t"), F.lit(1).alias("quality"))
        _, drawn = figures.grid_figures(hours(spark, sf_dir, F.col("value")), samples, event_ms=43_200_000, peer_ms=86_400_000)
        return drawn.filter("figure <> 'A-F2'").groupBy("figure").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.round(F.avg("y"), 4).alias("y"))

    @query("""SELECT * FROM (VALUES ('A-F1', false, 'no series of power', NULL::DOUBLE), ('A-F2', false, 'too few points around the event', 0), ('A-F3', false, 'no steps to take a rate of', NULL), ('A-F4', false, 'no other entity to compare with', NULL), ('A-F5', false, 'no series of power', NULL), ('A-F6', false, 'no column of deviations', NULL)) t(figure, available, reason, stat) WHERE (SELECT count(*) FROM events WHERE value > 1e9) = 0""")
    def unavailable_figures(spark, sf_dir):
        """What is said of a log without rows that count: every figure is there, with its reason."""
        samples = events(spark, sf_dir).filter("value > 1e9").select(F.col("event_type").alias("entity"), F.col("t_ms").alias("t"), F.lit(1).alias("quality"))
        found, _ = figures.grid_figures(hours(spark, sf_dir, F.col("value")).filter("lo > 1e9"), samples)
        return told(found, A_F2="points", A_F3="p95")

    steps = """v AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS c, ((vec_id * 37) % 100 - 50)::DOUBLE AS i FROM embeddings WHERE len(embedding) >= 8),
    l AS (SELECT *, lag(i) OVER (ORDER BY vec_id) AS i0, lag(c) OVER (ORDER BY vec_id) AS c0 FROM v),
    ev AS (SELECT vec_id, 1600000000000 + vec_id * 21600000 AS t, i, i - i0 AS di, (vec_id % 100)::DOUBLE AS soc, (20 + vec_id % 8)::DOUBLE AS tm, list_transform(range(1, 9), lambda k: -(c[k] - c0[k]) / (i - i0)) AS r FROM l WHERE abs(i - i0) >= 5 AND NOT (abs(i0) < 2 AND abs(i) < 2)),
    md AS (SELECT list_sort(list(soc))[(count(*) - 1) // 2 + 1] AS ms, list_sort(list(tm))[(count(*) - 1) // 2 + 1] AS mt, list_sort(list(i))[(count(*) - 1) // 2 + 1] AS mi, count(*) AS n FROM ev),
    ma AS (SELECT ev.* FROM ev, md WHERE n < 8 OR (abs(soc - ms) <= 15 AND abs(tm - mt) <= 15 AND abs(i - mi) <= 25)),
    pt AS (SELECT k AS cell, t, r[k] AS r FROM ma, range(1, 9) s(k)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY t, r) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM pt),
    dr AS (SELECT cell, median(r) FILTER (rn > n - greatest(4, n // 5)) - median(r) FILTER (rn <= greatest(4, n // 5)) AS drift FROM rk WHERE n >= 4 GROUP BY 1),
    wo AS (SELECT cell, drift FROM dr ORDER BY drift DESC, cell LIMIT 1),
    y AS (SELECT 1 AS event_type, t // 86400000 AS day, median(r) AS y FROM pt JOIN wo USING (cell) GROUP BY 2),
    bl AS (SELECT t, (t - lag(t) OVER (ORDER BY t)) / 3600000.0 AS h, vec_id FROM ev), ch AS (SELECT k AS cell, sum(abs((vec_id * k) % 5 / 10.0) * h) AS q FROM bl, range(1, 9) s(k) WHERE h IS NOT NULL GROUP BY 1)"""

    def resistances(spark, sf_dir):
        """Changes of current of a battery whose cells are the first components of the embeddings, a row each six hours."""
        e = table(spark, sf_dir, "embeddings").filter("size(embedding) >= 8").select("vec_id", F.lit(1).alias("one"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("c"), ((F.col("vec_id") * 37) % 100 - 50).cast("double").alias("i"))
        return forensics.cell_events(e, ["one"], ["vec_id"], "i", "c", chunk=F.expr("vec_id div 4096")).select(
            (F.lit(1_600_000_000_000) + F.col("vec_id") * 21_600_000).alias("t"), "i", "di", (F.col("vec_id") % 100).cast("double").alias("soc"), (20 + F.col("vec_id") % 8).cast("double").alias("t_mean"), "r", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.col("vec_id") * k) % 5 / 10).alias("bal"), "c")

    @query(f"""WITH {steps}, {piece}, {chord},
    kn AS (SELECT k.day AS px, c.day AS cx, (SELECT max(day) - min(day) FROM y) AS sp FROM (SELECT 1) LEFT JOIN k ON k.rn = 1 LEFT JOIN c ON c.rn = 1),
    re AS (SELECT CASE WHEN px IS NULL THEN 'no piecewise knee' WHEN cx IS NULL THEN 'no chord knee' WHEN abs(px - cx) > 0.25 * sp THEN 'methods disagree' END AS why, (px + cx) / 2.0 AS knee FROM kn)
    SELECT * FROM (VALUES ('B-F1', true, NULL, (SELECT round(drift, 4) FROM wo)), ('B-F2', true, NULL, (SELECT count(*) FROM ma)::DOUBLE), ('B-F3', true, NULL, (SELECT count(*) FROM ev)::DOUBLE), ('B-F4', (SELECT why IS NULL FROM re), (SELECT why FROM re), (SELECT CASE WHEN why IS NULL THEN knee END FROM re)), ('B-F5', false, 'no model of fault probability is part of this library', NULL), ('B-F6', true, NULL, (SELECT round(max(q), 4) FROM ch))) t(figure, available, reason, stat)""")
    def battery_figures(spark, sf_dir):
        r = resistances(spark, sf_dir)
        found, _ = figures.battery_figures(r, r.select("t", (F.array_max("c") - F.array_min("c")).alias("v_range")))
        return told(found, B_F1="drift", B_F2="matched", B_F3="points", B_F4="knee_day", B_F6="charge")

    @query(f"WITH {steps} SELECT cell::INT AS cell, t, round(r, 8) AS r FROM (SELECT k AS cell, t, r[k] AS r FROM ev, range(1, 9) s(k)) WHERE isfinite(r)")
    def resistance_points(spark, sf_dir):
        return figures.resistance_points(resistances(spark, sf_dir)).select("cell", "t", F.round("r", 8).alias("r"))

    @query(f"WITH {steps} SELECT cell::INT AS cell, round(q, 6) AS charge FROM ch")
    def balancing_charge(spark, sf_dir):
        return forensics.balancing_burden(resistances(spark, sf_dir).withColumn("one", F.lit(1)), ["one"], "t", "bal").select("cell", F.round("charge", 6).alias("charge"))

    @query("""WITH d AS (SELECT l_shipmode AS kind, count(*) AS n, min(x) AS least, max(x) AS most, avg(x) AS mean, median(x) AS middle, mad(x) AS mad, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.99) AS p99, regr_slope(x, l_linenumber) AS slope, regr_intercept(x, l_linenumber) AS base FROM (SELECT l_returnflag AS l_shipmode, l_linenumber, l_quantity - 25 AS x FROM lineitem) GROUP BY 1)
    SELECT kind, n, round(least, 4) AS least, round(most, 4) AS most, round(mean, 4) AS mean, round(middle, 4) AS middle, round(mad, 4) AS mad, round(p01, 4) AS p01, round(p99, 4) AS p99, round(slope, 6) AS slope, round(base, 4) AS base FROM d""")
    def deviation_summary(spark, sf_dir):
        d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") - 25).alias("dev"))
        s = stats.deviations(d, "dev", ["kind"]).join(stats.least_squares(d, "x", "dev", ["kind"]), "kind")
        return s.select("kind", "n", *[F.round(c, 4).alias(c) for c in ("least", "most", "mean", "middle", "mad", "p01", "p99")], F.round("slope", 6).alias("slope"), F.round("base", 4).alias("base"))

    @query(f"""{common}, a AS (SELECT event_type, count(*) AS n FROM e WHERE value > 150 GROUP BY 1), w AS (SELECT event_id, event_type, t_ms, value FROM e WHERE value > 200 ORDER BY event_id LIMIT 20),
    p AS (SELECT 0 AS part, event_type AS k, '' AS at_time, event_type AS source, 'value' AS signal, n || ' alarms' AS observation, '' AS derived, 'rule over 150' AS supports, 'High' AS confidence, '' AS figure FROM a
      UNION ALL SELECT 1, lpad(event_id::VARCHAR, 12, '0'), strftime(epoch_ms(t_ms), '%Y-%m-%dT%H:%M:%S'), event_type, 'value', printf('%.2f', value), printf('%.2f', value - 200), '', 'Confirmed', '' FROM w),
    o AS (SELECT *, row_number() OVER (ORDER BY part, k) AS i FROM p)
    SELECT printf('E%03d', i) AS evidence_id, '' AS case_id, at_time, source, signal, observation, derived, supports, '' AS contradicts, confidence, figure, CASE part WHEN 0 THEN 'Derived' ELSE 'Observed' END AS notes FROM o WHERE i <= 80""")
    def evidence_ledger_columns(spark, sf_dir):
        """All twelve columns, from alarms of groups and from the first windows."""
        e = events(spark, sf_dir)
        two = lambda c: F.format_string("%.2f", c)
        groups = e.filter("value > 150").groupBy("event_type").agg(F.count("*").alias("n")).select(F.col("event_type").alias("k"), F.col("event_type").alias("source"), F.lit("value").alias("signal"), F.concat(F.col("n").cast("string"), F.lit(" alarms")).alias("observation"), F.lit("rule over 150").alias("supports"), F.lit("High").alias("confidence"), F.lit("Derived").alias("notes"))
        first = e.filter("value > 200").orderBy("event_id").limit(20)
        windows = first.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("k"), F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss").alias("at_time"), F.col("event_type").alias("source"), F.lit("value").alias("signal"), two(F.col("value")).alias("observation"), two(F.col("value") - 200).alias("derived"), F.lit("Confirmed").alias("confidence"), F.lit("Observed").alias("notes"))
        return figures.ledger([groups, windows], ["k"])

    @query(f"""{common} SELECT 'file ' || user_id % 5 AS source_file, 'generic' AS format_id, 'event_type' AS entity_column, count(*) AS row_count, count_if(value > 150) AS derived_alarm_count, min(t_ms) AS data_lo, max(t_ms) AS data_hi, min(t_ms) FILTER (value > 150) AS evidence_lo, max(t_ms) FILTER (value > 150) AS evidence_hi, round(least(1, (max(t_ms) FILTER (value > 150) - min(t_ms) FILTER (value > 150)) / (max(t_ms) - min(t_ms))), 6) AS coverage, 0::BIGINT AS dropped_events FROM e GROUP BY 1""")
    def source_profiles(spark, sf_dir):
        e = events(spark, sf_dir).withColumn("source_file", F.concat(F.lit("file "), (F.col("user_id") % 5).cast("string")))
        p = evidence.profiles(e, "source_file", "t_ms", F.col("value") > 150, entity_column="event_type")
        return p.withColumn("coverage", F.round("coverage", 6))

    @query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer) SELECT c_custkey AS case_id, c_mktsegment AS state, json_object('name', c_name)::VARCHAR AS body FROM c WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'new', json_object('name', c_name)::VARCHAR FROM c WHERE c_custkey % 2 = 0""")
    def case_snapshots(spark, sf_dir):
        """Snapshots without their heavy fields, those of every second case taken anew, each read back by its case."""
        c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("state"), F.col("c_name").alias("name"), F.array_repeat("c_name", 50).alias("series"))
        old = evidence.snapshots(c, ["case_id", "state"], heavy=["series"])
        new = evidence.snapshots(c.filter("case_id % 2 = 0").withColumn("state", F.lit("new")), ["case_id", "state"], heavy=["series"])
        return evidence.upsert(old, new)
