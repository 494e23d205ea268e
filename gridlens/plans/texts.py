"""Queries of the scalar functions over texts of the tables; their SQL states each rule once more."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import scalars
from gridlens.sources import logs

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\b0\d{1,2}-?\d{3,4}-?\d{4}\b"
LABEL = r"(?:고객사|고객명|사이트명|담당자)\s*[:：]"
ADDRESS = r"[가-힣]+(?:특별시|광역시|자치시|도)\s?[가-힣]+(?:시|군|구)\s?[가-힣0-9]+(?:읍|면|동|로|길)"
PRIVATE = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, LABEL, ADDRESS))


def pick(options: list[str], key):
    """The option that a whole number names, in turn."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


def listed(options: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in options) + "]"


def register(query, table, events, common: str) -> None:
    states = ["Charging", "Fault", "0", "online", " idle ", "", "discharging", "TRIP", "Running", "ok", "2", "Stand by", "STANDBY"]

    def stated(spark, sf_dir, rule):
        return table(spark, sf_dir, "orders").select("o_orderkey", rule(pick(states, F.col("o_orderkey"))).alias("alarm"))

    state = f"SELECT o_orderkey, trim({listed(states)}[o_orderkey % {len(states)} + 1]) AS s FROM orders"

    @query(f"SELECT o_orderkey, s <> '' AND upper(s) NOT IN ('OK', 'NORMAL', 'CHARGING', 'DISCHARGING', 'IDLE', 'STANDBY', 'RUNNING', 'READY', '0') AS alarm FROM ({state})")
    def status_alarms(spark, sf_dir):
        return stated(spark, sf_dir, logs.status_alarm)

    @query(f"SELECT o_orderkey, s <> '' AND upper(s) NOT IN ('0', 'OK', 'NORMAL') AS alarm FROM ({state})")
    def code_alarms(spark, sf_dir):
        return stated(spark, sf_dir, logs.code_alarm)

    @query("SELECT l_orderkey, l_linenumber, count(*) AS n, count_if(l_linenumber % 4 NOT IN (1, 3)) AS alarms FROM lineitem GROUP BY 1, 2")
    def quality_alarms(spark, sf_dir):
        flag = F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("1.0"), F.lit(" ")), (F.col("l_linenumber") % 4 + 1).cast("int"))
        return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(logs.quality_alarm(flag)).alias("alarms"))

    @query("SELECT o_orderkey, '<' || chr((o_orderkey % 50000 + 40)::INT) || '&lt;' || chr((o_orderkey % 900 + 40)::INT) || ' R&D; 1 & 2' AS text FROM orders")
    def html_references(spark, sf_dir):
        k = F.col("o_orderkey")
        text = F.concat(F.lit("&lt;&#"), (k % 50000 + 40).cast("string"), F.lit(";&amp;lt;&#x"), F.hex(k % 900 + 40), F.lit("; R&D; 1 & 2"))
        return table(spark, sf_dir, "orders").select("o_orderkey", scalars.html_references(text).alias("text"))

    @query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace(text, '&', ' and ') || ' ' || chr(10) || '  ' || chr(10) || ' end', '[ \t\x0b\f]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE text IS NOT NULL AND NOT contains(text, '<')""")
    def html_lines(spark, sf_dir):
        t = table(spark, sf_dir, "conversations").filter("text is not null and not contains(text, '<')")
        html = F.concat(F.lit("<script a>no < no</script>\n<p class='x'>"), F.replace("text", F.lit("&"), F.lit(" and ")), F.lit("</p>\n  \n<style>p{}</style> end"))
        return t.select("conv_id", "turn", scalars.html_text(html).alias("text"))

    @query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(d, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(d, '%Y-%m-%d') || ',' || strftime(d + 40, '%Y-%m-%d') ELSE strftime(d - 3, '%Y-%m-%d') || ',' || strftime(d, '%Y-%m-%d') END AS days FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
    def date_days(spark, sf_dir):
        d = F.col("o_orderdate").cast("date")
        texts = [F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" and "), F.date_format(d, "yyyy/M/d"), F.lit(" not 2025-02-30")), F.concat(F.date_format(d, "yyyy년 M월 d일"), F.lit("부터 "), F.date_format(F.date_add(d, 40), "yyyy/MM/dd")), F.concat(F.date_format(d, "yyyy-M-d"), F.lit(" before "), F.date_format(F.date_sub(d, 3), "yyyy-MM-dd"))]
        text = F.when(F.col("o_orderkey") % 3 == 0, texts[0]).when(F.col("o_orderkey") % 3 == 1, texts[1]).otherwise(texts[2])
        return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(scalars.days_in(text), lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("days"))

    def zoned(ms, k):
        """A time in five spellings."""
        at = lambda shift, form: F.date_format(F.timestamp_millis(ms + shift * 3_600_000), form)
        five = [at(0, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), at(10, "yyyy/MM/dd HH:mm:ss"), F.concat(at(5, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("987+05:00")), at(10, "yyyy-MM-dd"), F.concat(at(0, "yyyy/M/d H:m:s"), F.lit(" UTC"))]
        out = five[4]
        for i in range(4):
            out = F.when(k % 5 == i, five[i]).otherwise(out)
        return out

    @query(f"{common} SELECT event_id, CASE event_id % 5 WHEN 0 THEN t_ms WHEN 2 THEN t_ms WHEN 3 THEN (t_ms + 36000000) // 86400000 * 86400000 ELSE t_ms // 1000 * 1000 END AS ms FROM e")
    def zoned_timestamps(spark, sf_dir):
        """Zone, offset, assumed offset (+10), a day alone (UTC), fraction cut to milliseconds."""
        return events(spark, sf_dir).select("event_id", scalars.timestamp_ms(zoned(F.col("t_ms"), F.col("event_id")), 600).alias("ms"))

    @query("SELECT o_orderkey, epoch_ms(make_date(2023 + (o_orderkey % 3)::INT, 1, 1)::TIMESTAMP + to_months((o_orderkey % 14)::INT) + to_days((o_orderkey % 40)::INT - 1)) + o_orderkey % 61 * 1000 AS ms FROM orders")
    def parse_timestamp(spark, sf_dir):
        """Fields over their range roll on: months to 14, days to 39, seconds to 60."""
        k = F.col("o_orderkey")
        text = F.concat((2023 + k % 3).cast("string"), F.lit("-"), (k % 14 + 1).cast("string"), F.lit("-"), (k % 40).cast("string"), F.lit(" 00:00:"), (k % 61).cast("string"))
        return table(spark, sf_dir, "orders").select("o_orderkey", scalars.timestamp_ms(text).alias("ms"))

    @query(f"{common} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN t_ms // 1000 * 1000 ELSE t_ms END AS ms FROM e")
    def epochs_ms(spark, sf_dir):
        n = F.when(F.col("event_id") % 2 == 0, F.floor(F.col("t_ms") / 1000)).otherwise(F.col("t_ms"))
        return events(spark, sf_dir).select("event_id", scalars.epoch_ms(n.cast("double")).alias("ms"))

    extensions, headers = ["csv", "PDF", "log", "md"], ["timestamp,voltage_V", "name,size", "soc", "", "Date;status"]

    @query(f"""WITH p AS (SELECT p_partkey, lower('Unit ' || p_name || '.' || {listed(extensions)}[p_partkey % 4 + 1]) AS f, lower({listed(headers)}[p_partkey % 5 + 1]) AS h FROM part)
    SELECT p_partkey, (CASE WHEN regexp_matches(f, 'bms|ess|pcs|ems|cell|alarm|fault|log') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(h, 'time|timestamp|date') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(h, 'volt|voltage|current|temp|soc|soh|alarm|fault|status') THEN 2 ELSE 0 END - CASE WHEN string_split(f, '.')[-1] IN ('csv', 'txt', 'log', 'tsv', 'dat') THEN 0 ELSE 5 END)::INT AS score FROM p""")
    def file_scores(spark, sf_dir):
        name = F.concat(F.lit("Unit "), "p_name", F.lit("."), pick(extensions, F.col("p_partkey")))
        return table(spark, sf_dir, "part").select("p_partkey", scalars.source_score(name, pick(headers, F.col("p_partkey"))).alias("score"))

    @query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.2f MB', round(n / 1048576, 2)) END AS size FROM (SELECT doc_id, (length(text) * (doc_id % 700))::BIGINT AS n FROM documents WHERE text IS NOT NULL)")
    def byte_sizes(spark, sf_dir):
        d = table(spark, sf_dir, "documents").filter("text is not null")
        return d.select("doc_id", scalars.byte_size(F.length("text").cast("long") * (F.col("doc_id") % 700)).alias("size"))

    @query("SELECT o_orderkey, (o_orderkey * 7919 * 1000) % 4294967296 AS size FROM orders")
    def signed_sizes(spark, sf_dir):
        whole = (F.col("o_orderkey") * 7919 * 1000) % F.lit(4294967296)
        return table(spark, sf_dir, "orders").select("o_orderkey", scalars.signed32(F.when(whole >= 2147483648, whole - 4294967296).otherwise(whole)).alias("size"))

    @query("""WITH p AS (SELECT p_partkey, [p_size::VARCHAR, 'cell ' || p_size, 'Cell' || p_size, 'pack CELL  ' || p_size, 'cell_' || p_size, 'cell 0', p_name, ' ' || p_size || ' ', p_size || 'V'][p_partkey % 9 + 1] AS s FROM part)
    SELECT p_partkey, CASE WHEN n > 0 THEN 'Cell ' || n END AS label FROM (SELECT p_partkey, coalesce(try_cast(regexp_extract(s, '(?i)cell\\s*(\\d+)', 1) AS BIGINT), try_cast(regexp_extract(trim(s), '^(\\d+)$', 1) AS BIGINT)) AS n FROM p)""".replace("\\\\", "\\"))
    def cell_labels(spark, sf_dir):
        n = F.col("p_size").cast("string")
        nine = [n, F.concat(F.lit("cell "), n), F.concat(F.lit("Cell"), n), F.concat(F.lit("pack CELL  "), n), F.concat(F.lit("cell_"), n), F.lit("cell 0"), F.col("p_name"), F.concat(F.lit(" "), n, F.lit(" ")), F.concat(n, F.lit("V"))]
        return table(spark, sf_dir, "part").select("p_partkey", scalars.cell_label(F.element_at(F.array(*nine), (F.col("p_partkey") % 9 + 1).cast("int"))).alias("label"))

    @query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) AS escaped FROM pages""")
    def escaped_html(spark, sf_dir):
        return table(spark, sf_dir, "pages").select("page_id", F.md5(scalars.html_escape(F.col("html"))).alias("escaped"))

    @query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN NULL WHEN 2 THEN c_nationkey * 1000.0 ELSE c_nationkey / 10.0 END::DOUBLE AS n FROM customer")
    def prefix_numbers(spark, sf_dir):
        k, nation = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
        text = F.when(k == 0, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" V"))).when(k == 1, F.col("c_name")).when(k == 2, F.concat(nation, F.lit("e3x"))).otherwise(F.concat(F.lit("+"), (F.col("c_nationkey") / 10).cast("string"), F.lit("mA")))
        return table(spark, sf_dir, "customer").select("c_custkey", scalars.number(text).alias("n"))

    def private(*patterns):
        def run(spark, sf_dir):
            found = F.concat(*[scalars.pii(F.col("text"), p) for p in patterns])
            return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "|").alias("found"))

        return run

    def first_three(p: str) -> str:
        """Different matches in the order of their first place, three at most."""
        return f"list_filter(m_{p}, lambda x, i: list_position(m_{p}, x) = i)[1:3]"

    matches = "FROM (SELECT doc_id, " + ", ".join(f"regexp_extract_all(text, '{p}') AS m_{k}" for k, p in {"email": EMAIL, "phone": PHONE, "label": LABEL, "address": ADDRESS}.items()) + " FROM documents)"

    for name, keys, patterns in (("personal_data", ["email"], [scalars.EMAIL]), ("phone_numbers", ["phone"], [scalars.PHONE]), ("labels_and_addresses", ["label", "address"], [scalars.LABEL, scalars.ADDRESS])):
        run = private(*patterns)
        run.__name__ = name
        lists = first_three(keys[0]) if len(keys) == 1 else f"list_concat({', '.join(map(first_three, keys))})"
        query(f"SELECT doc_id, array_to_string({lists}, '|') AS found {matches}")(run)

    @query(f"{common} SELECT event_id, (t_ms + 36000000) // 86400000 * 86400000 - 36000000 AS start_ms FROM e")
    def civil_day_starts(spark, sf_dir):
        return events(spark, sf_dir).select("event_id", scalars.day_start_ms(F.col("t_ms"), 600).alias("start_ms"))

    @query(f"{common} SELECT event_id, strftime(epoch_ms(t_ms + 36000000), '%Y-%m-%d') AS day FROM e")
    def civil_day_labels(spark, sf_dir):
        return events(spark, sf_dir).select("event_id", scalars.day_label(F.col("t_ms"), 600).alias("day"))

    said = ["Test", " n/a ", "없음", "testing", "", "lorem ipsum", "a cell rose", "TBD"]

    @query(f"""SELECT conv_id, turn, length(s) BETWEEN 1 AND 90 AND NOT regexp_matches(trim(s), '(?i)^(test|todo|placeholder|n/a|na|xxx|tbd|lorem ipsum|foo|bar|example|sample|없음|미상)$') AS ok
    FROM (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN coalesce(text, '') ELSE {listed(said)}[conv_id % 8 + 1] END AS s FROM conversations WHERE conv_id IS NOT NULL)""")
    def placeholder_texts(spark, sf_dir):
        s = F.when(F.col("conv_id") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise(pick(said, F.col("conv_id")))
        return table(spark, sf_dir, "conversations").filter("conv_id is not null").select("conv_id", "turn", scalars.substantive(s, 90).alias("ok"))

    @query("SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 1 AND o_orderkey % 7 <> 2 AS ok FROM orders")
    def review_gate(spark, sf_dir):
        k = F.col("o_orderkey")
        name, severity, reason = F.when(k % 5 == 0, " \t").otherwise("aged cell"), F.when(k % 3 != 1, F.col("o_orderpriority")), F.when(k % 7 == 2, "").otherwise("drift")
        return table(spark, sf_dir, "orders").select("o_orderkey", scalars.reviewed(F.trim(F.regexp_replace(name, "\t", "")), severity, reason).alias("ok"))

    @query(f"SELECT doc_id, coalesce(doc_id % 5 <> 0 AND doc_id % 11 <> 3 AND length(trim(text)) >= 30 AND NOT regexp_matches(text, '{PRIVATE}'), false) AS ok FROM documents")
    def intake_gate(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", scalars.admitted(F.col("text"), F.col("doc_id") % 5 != 0, F.col("doc_id") % 11 != 3).alias("ok"))

    @query("""SELECT c_custkey, c_custkey % 9 = 4 AS malformed, CASE WHEN c_custkey % 9 <> 4 THEN c_mktsegment || ', "' || c_name || '"' ELSE '' END AS note, CASE WHEN c_custkey % 9 <> 4 AND c_custkey % 5 > 0 THEN c_nationkey::VARCHAR ELSE '' END AS n FROM customer""")
    def parse_delimited(spark, sf_dir):
        """Lines with quoted delimiters and quotes, outer white space, missing cells, and quotes that stay open."""
        k = F.col("c_custkey")
        quoted = F.concat(F.lit('"'), "c_mktsegment", F.lit(', ""'), "c_name", F.lit('""'), F.when(k % 9 == 4, "").otherwise('"'))
        line = F.concat(k.cast("string"), F.lit(","), quoted, F.when(k % 5 > 0, F.concat(F.lit(",  "), F.col("c_nationkey").cast("string"), F.lit(" "))).otherwise(""))
        rows = table(spark, sf_dir, "customer").select("c_custkey", line.alias("value"))
        return logs.generic_rows(rows, ["k", "note", "n"]).select("c_custkey", "malformed", "note", "n")
