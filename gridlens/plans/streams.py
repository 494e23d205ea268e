"""Queries of the streams, fed with the events in slices of time, one micro-batch after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridlens.session import shared_dir
from gridlens.streaming import bins, sustained


def slices(spark, df, t: str, many: int, folder: str):
    """Writes `df` to a folder in `many` slices of its time span, and yields after each."""
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    step = ((hi - lo) // many + 1) if hi is not None else 1
    for i in range(many if hi is not None else 1):
        part = df.filter((F.col(t) >= lo + i * step) & (F.col(t) < lo + (i + 1) * step)) if hi is not None else df
        part.write.mode("append").parquet(folder)
        yield i


def register(query, events, runs_sql: str) -> None:
    @query(f"{runs_sql} SELECT event_type, CAST(island AS BIGINT) AS island, start, stop, fires, round(max_abs, 6) AS max_abs, round(max_signed, 6) AS max_signed FROM w")
    def stream_sustained_windows(spark, sf_dir):
        """The sustained windows of a stream that is stopped twice and goes on from its checkpoint: with those its end closes, the batch's."""
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", sustained.ROCKS)
        rows = events(spark, sf_dir).select(F.col("event_type").alias("entity"), F.col("event_id").alias("seq"), F.col("t_ms").alias("t"), (F.col("value") - 250).alias("dev"), (F.col("event_id") % 10 == 0).alias("bad"))
        at = f"{shared_dir(spark)}/sustained-{uuid.uuid4().hex}"
        for _ in slices(spark, rows, "t", 3, f"{at}/in"):
            found = sustained.run_to_end(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), at, hit=60.0, fire=5, idle_ms=86_400_000)
        return found.select(F.col("entity").alias("event_type"), "island", "start", "stop", "fires", F.round("max_abs", 6).alias("max_abs"), F.round("max_signed", 6).alias("max_signed"))

    @query("""WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS entity, event_type AS kind, epoch_us(ts) // 1000 AS t FROM events), s AS (SELECT entity, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1),
    w AS (SELECT entity, min(86400000 * (1::BIGINT << i)) AS width_ms FROM s, range(30) r(i) WHERE hi // (86400000 * (1::BIGINT << i)) - lo // (86400000 * (1::BIGINT << i)) < 10 GROUP BY 1)
    SELECT entity, t // width_ms * width_ms AS bin_ms, width_ms, kind, count(*) AS n FROM e JOIN w USING (entity) GROUP BY ALL""")
    def stream_bins(spark, sf_dir):
        """Counts by type over at most ten bins, of events that come latest first: the bins of a batch."""
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", sustained.ROCKS)
        rows = events(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("entity"), F.col("t_ms").alias("t"), F.col("event_type").alias("kind"), (-F.col("t_ms")).alias("back"))
        at = f"{shared_dir(spark)}/bins-{uuid.uuid4().hex}"
        for _ in slices(spark, rows, "back", 3, f"{at}/in"):
            found = bins.run_to_end(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), at, most=10)
        return found
