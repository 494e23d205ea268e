"""Downsampled series: day bins, tiled bins, merging of series, choice of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_MS = 86_400_000


def day_bins(df: DataFrame, entity: list[str], t_ms: str, value: str) -> DataFrame:
    """count, min, max and mean for each civil day (UTC)."""
    day = (F.floor(F.col(t_ms) / DAY_MS) * DAY_MS).cast("long")
    return df.filter(F.col(t_ms).isNotNull()).groupBy(*entity, day.alias("bin_ms")).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))


def tiled_bins(bins: DataFrame, entity: list[str], cap: int) -> DataFrame:
    """At most `cap` bins by merging 2^k neighbours, with the least k that suffices; means weigh by count."""
    w = Window.partitionBy(*entity)
    numbered = bins.withColumn("i", F.row_number().over(w.orderBy("bin_ms")) - 1).withColumn("all", F.count("*").over(w))
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.col("all") / F.lit(float(cap)))))
    return combine(numbered.withColumn("tile", F.floor(F.col("i") / F.pow(F.lit(2.0), k)).cast("int")), [*entity, "tile"])


def combine(bins: DataFrame, by: list[str]) -> DataFrame:
    """Bins of one key as one bin."""
    return bins.groupBy(*by).agg(F.min("bin_ms").alias("bin_ms"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))


def merge(parts: list[DataFrame], entity: list[str]) -> DataFrame:
    """Series of several sources as one: equal times combine, gaps stay gaps."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return combine(whole.withColumn("at", F.col("bin_ms")), [*entity, "at"]).drop("at")


def top_entities(bins: DataFrame, entity: str, top: int = 8) -> DataFrame:
    """Entities of the largest range, then of most samples, then by name."""
    r = bins.groupBy(entity).agg((F.max("hi") - F.min("lo")).alias("range"), F.sum("n").alias("n"))
    return r.orderBy(F.desc("range"), F.desc("n"), entity).limit(top)


def points(bins: DataFrame) -> DataFrame:
    """x, y, lo, hi for drawing; a missing bound falls back to the mean, rows without a finite mean go."""
    ok = F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") < F.lit(float("inf")))
    return bins.filter(ok).select("*", F.col("bin_ms").alias("x"), F.col("mean").alias("y")).withColumn("lo", F.coalesce("lo", "y")).withColumn("hi", F.coalesce("hi", "y"))


def halved(bins: DataFrame, entity: list[str], signals: list[str]) -> DataFrame:
    """Every two neighbouring bins as one (columns n, and <signal>_min, _max and _mean for each signal).

    A signal that one of the two lacks is the other's; means weigh by the rows of the
    bin, not of the signal, and a bin without a count weighs one. The last bin of an
    odd number stays.
    """
    pair = F.floor((F.row_number().over(Window.partitionBy(*entity).orderBy("bin_ms")) - 1) / 2)
    n = F.coalesce(F.nullif("n", F.lit(0)), F.lit(1))
    of = [x for s in signals for x in (F.min(f"{s}_min").alias(f"{s}_min"), F.max(f"{s}_max").alias(f"{s}_max"), (F.sum(F.col(f"{s}_mean") * n) / F.sum(F.when(F.col(f"{s}_mean").isNotNull(), n))).alias(f"{s}_mean"))]
    return bins.withColumn("pair", pair).groupBy(*entity, "pair").agg(F.min("bin_ms").alias("bin_ms"), F.sum(n).cast("long").alias("n"), *of).drop("pair")
