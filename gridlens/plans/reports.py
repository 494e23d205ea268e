"""Queries of the evidence text and of contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.operators import contracts, pack
from gridlens.operators.contracts import listed, nullable, number, shape, text

CAP = 3000


def register(query, table, events, common: str) -> None:
    @query(f"""{common}, g AS (SELECT user_id % 12 AS source, event_type, count(*) AS n, count_if(value > 100) AS alarms, min(value) AS lo, max(value) AS hi, sum(value) AS total FROM e GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY alarms DESC, n DESC, event_type) AS place FROM g),
    k AS (SELECT *, least(alarms, 8) AS want, sum(least(alarms, 8)) OVER (ORDER BY source, place) AS upto FROM p WHERE place <= 3 AND source < 10),
    u AS (SELECT *, greatest(0, least(want, 60 - (upto - want))) AS used FROM k),
    a AS (SELECT u.source, u.place, u.used, event_id, value, row_number() OVER (PARTITION BY u.source, u.place ORDER BY t_ms, event_id) AS rn FROM e JOIN u ON e.user_id % 12 = u.source AND e.event_type = u.event_type WHERE value > 100),
    l AS (SELECT source, 0 AS place, 0 AS rn, '### source ' || source || ': ' || sum(n) || ' rows, ' || sum(alarms) || ' alarms' AS v FROM g WHERE source < 10 GROUP BY 1
      UNION ALL SELECT source, place, 0, '- ' || event_type || ': ' || n || ' rows, ' || alarms || ' alarms, value ' || printf('%.2f', lo) || '..' || printf('%.2f', hi) || ', mean ' || printf('%.2f', total / n) FROM u
      UNION ALL SELECT source, place, rn, '  [alarm ' || rn || '] ' || event_id || ': ' || printf('%.2f', value) FROM a WHERE rn <= used),
    b AS (SELECT string_agg(v, chr(10) ORDER BY source, place, rn) AS body FROM l),
    o AS (SELECT array_to_string(list_filter([CASE WHEN s > 0 THEN s || ' sources not included' END, CASE WHEN x > 0 THEN x || ' groups not detailed' END, CASE WHEN c > 0 THEN c || ' alarm contexts left out' END], lambda t: t IS NOT NULL), ', ') AS parts
      FROM (SELECT (SELECT count(DISTINCT source) FROM g WHERE source >= 10) AS s, (SELECT count(*) FROM p WHERE place > 3 AND source < 10) AS x, (SELECT sum(want - used) FROM u) AS c)),
    c AS (SELECT body, parts, length(body) AS whole, (SELECT max(i) FROM range(0, length(body) + 1) t(i) WHERE i + length(format('{{:,}}', length(body) - i)) <= {CAP} - (length('[Note: left out for size: . Call what is left out unconfirmed.]') + length(parts) + 2 + length(' characters cut') + 2)) AS lim FROM b, o)
    SELECT '[Note: left out for size: ' || parts || ', ' || format('{{:,}}', whole - lim) || ' characters cut. Call what is left out unconfirmed.]' || chr(10) || chr(10) || body[1:lim] AS text, whole, whole - lim AS cut_chars FROM c""")
    def evidence_text(spark, sf_dir):
        e = events(spark, sf_dir).withColumn("source", F.col("user_id") % 12)
        groups = e.groupBy("source", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("alarms"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"))
        shown = pack.top_groups(groups.filter("source < 10"), "source", "alarms", "n", "event_type", most=3)
        used = pack.spent(shown.withColumn("want", F.least("alarms", F.lit(8))), ["source", "place"], F.col("want"), chunk=F.col("source"))
        two = lambda c: F.format_string("%.2f", c)
        rank = F.expr("row_number() over (partition by source, place order by t_ms, event_id)")
        alarms = e.filter("value > 100").join(used.select("source", "event_type", "place", "used"), ["source", "event_type"]).withColumn("rn", rank).filter("rn <= used")
        parts = [
            groups.filter("source < 10").groupBy("source").agg(F.lit(0).alias("place"), F.lit(0).alias("rn"), F.format_string("### source %d: %d rows, %d alarms", F.first("source"), F.sum("n"), F.sum("alarms")).alias("v")),
            used.select("source", "place", F.lit(0).alias("rn"), F.format_string("- %s: %d rows, %d alarms, value %s..%s, mean %s", "event_type", "n", "alarms", two(F.col("lo")), two(F.col("hi")), pack.average(F.col("total"), F.col("n"))).alias("v")),
            alarms.select("source", "place", "rn", F.format_string("  [alarm %d] %d: %s", "rn", "event_id", two(F.col("value"))).alias("v")),
        ]
        lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
        sums = groups.agg(F.count_distinct(F.when(F.col("source") >= 10, F.col("source"))).alias("s"), F.count_if(F.col("source") < 10).alias("g")).crossJoin(F.broadcast(used.agg(F.count("*").alias("k"), F.sum(F.col("want") - F.col("used")).alias("c"))))
        left = sums.select(pack.told({"{} sources not included": F.col("s"), "{} groups not detailed": F.col("g") - F.col("k"), "{} alarm contexts left out": F.col("c")}).alias("parts"))
        return pack.bounded_text(lines, ["source", "place", "rn"], "v", F.lit(CAP), left, chunk=F.col("source"))

    order = shape({"id": number(0, whole=True), "state": text(1, 10, substantive=True), "price": number(1000), "tags": listed(text(1), 1, 3)}, {"owner": nullable(shape({"key": number(0, whole=True), "name": text(1, 20)}))})

    @query("""SELECT o_orderkey, CASE WHEN k = 6 THEN '$ is no JSON' ELSE array_to_string(list_sort(list_filter([
      CASE WHEN k = 1 THEN '$.owner.extra is unknown' END, CASE WHEN k = 2 THEN '$.id is no number' END, CASE WHEN k = 3 THEN '$.price is missing' WHEN o_totalprice < 1000 THEN '$.price is below 1000' END,
      CASE WHEN k = 4 THEN '$.tags has more than 3' END, CASE WHEN k = 5 THEN '$.state is a placeholder' END, CASE WHEN k = 8 THEN '$.owner.key is not whole' END, CASE WHEN k = 9 THEN '$.tags[1] is no text' END, CASE WHEN k = 10 THEN '$.owner.name is longer than 20' END], lambda x: x IS NOT NULL)), '; ') END AS broken
    FROM (SELECT *, o_orderkey % 11 AS k FROM orders)""")
    def contract_of_orders(spark, sf_dir):
        """Orders as nested JSON, ten in eleven with a fault, or none where null is allowed, and what the contract says of each."""
        k = F.col("o_orderkey") % 11
        quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        key = F.col("o_custkey").cast("string")
        name = F.when(k == 10, F.lit("x" * 21)).otherwise(F.concat(F.lit("c"), key))
        owner = F.when(k == 7, F.lit("null")).otherwise(F.concat(F.lit('{"key":'), key, F.when(k == 8, ".5").otherwise(""), F.lit(',"name":'), quote(name), F.when(k == 1, ',"extra":1').otherwise(""), F.lit("}")))
        tags = F.when(k == 4, '["a","b","c","d"]').when(k == 9, '["a",2]').otherwise('["a","b"]')
        price = F.when(k == 3, "").otherwise(F.concat(F.lit('"price":'), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit(",")))
        id_ = F.when(k == 2, quote(F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
        json = F.concat(F.lit('{"id":'), id_, F.lit(',"state":'), quote(F.when(k == 5, " TBD ").otherwise(F.col("o_orderstatus"))), F.lit(","), price, F.lit('"tags":'), tags, F.lit(',"owner":'), owner, F.when(k == 6, "").otherwise("}"))
        return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(contracts.violations(json, order), "; ").alias("broken"))

    @query("SELECT conv_id, least(count(*), 3)::BIGINT AS kept, greatest(count(*) - 3, 0)::BIGINT AS dropped FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
    def windows_truncated(spark, sf_dir):
        """The turns of a conversation as the windows of a response, of which three stay."""
        c = table(spark, sf_dir, "conversations").filter("conv_id is not null").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("turn", "role")).alias("anomalyWindows"))).alias("json"))
        kept, dropped = contracts.truncated(F.col("json"), "anomalyWindows", 3)
        return c.select("conv_id", F.size(kept).cast("long").alias("kept"), dropped.cast("long").alias("dropped"))

    @query(r"""SELECT o_orderkey, o_orderkey % 5 = 1 OR o_orderkey % 4 <> 2 AS overclaims FROM orders""")
    def overclaimed_causes(spark, sf_dir):
        k = F.col("o_orderkey")
        said = [F.concat(F.lit("Order "), k.cast("string")), F.when(k % 5 == 1, F.lit("the connector at rack 3 이 확정된 원인")).otherwise(F.lit("the connector may be worn")), F.col("o_orderpriority")]
        limits = F.element_at(F.array(*[F.lit(x) for x in ("none", "a physical cause cannot be told", "effective series resistance alone; the cause cannot be told", "effective series resistance rises")]), (k % 4 + 1).cast("int"))
        return table(spark, sf_dir, "orders").select("o_orderkey", contracts.overclaims(said, limits).alias("overclaims"))

    @query("""WITH a AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS f FROM orders WHERE o_totalprice > 250000), t AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS f FROM orders WHERE o_orderstatus = 'F')
    SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT c FROM a) AND c_custkey NOT IN (SELECT a.c FROM a JOIN t ON a.c = t.c AND a.f = t.f)""")
    def uncited_figures(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("figure"), "o_totalprice", "o_orderstatus")
        return contracts.uncited(table(spark, sf_dir, "customer").select("c_custkey"), o.filter("o_totalprice > 250000"), o.filter("o_orderstatus = 'F'"), "c_custkey", "figure")

    @query("""SELECT conv_id, turn FROM conversations c WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id % 3 = 0 AND contains(d.text, trim(c.text)[1:40]))""")
    def uncontained_findings(spark, sf_dir):
        """Turns whose first 40 characters stand in no turn of every third conversation."""
        c = table(spark, sf_dir, "conversations")
        return contracts.uncontained(c.select("conv_id", "turn", "text"), c.filter("conv_id % 3 = 0").select(F.col("text").alias("said")), "text", "said").select("conv_id", "turn")
