"""Sustained deviations: run counting with hold, and the windows of runs that fired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import segments

# Size of a hit, run length that fires, windows kept for an entity.
HIT, FIRE, KEPT = 12.0, 75, 48


def runs(df: DataFrame, dev: str, bad: Column, entity: list[str], order: list[str], hit: float = HIT, fire: int = FIRE, chunk: Column | None = None) -> DataFrame:
    """Adds island, run and fired. Bad rows hold the count, small deviations reset it, rows without deviation are skipped.

    `chunk`, which rises with `order`, cuts an entity into tasks (see `segments`); without it an entity is one task.
    """
    rows = df.filter(F.col(dev).isNotNull()).withColumn("bad", bad).withColumn("is_hit", ~F.col("bad") & (F.abs(dev) >= hit))
    reset = ~F.col("bad") & (F.abs(dev) < hit)
    if chunk is not None:
        counted = segments.runs(rows, entity, order, chunk, F.col("is_hit"), reset)
    else:
        w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inner = Window.partitionBy(*entity, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        counted = rows.withColumn("island", F.sum(reset.cast("int")).over(w)).withColumn("run", F.sum(F.col("is_hit").cast("int")).over(inner))
    return counted.withColumn("fired", F.col("is_hit") & (F.col("run") >= fire))


def windows(counted: DataFrame, dev: str, t: str, entity: list[str], seq: str) -> DataFrame:
    """One row per island that fired: first and last fire, fires, largest deviation (the last one on ties)."""
    return (
        counted.filter("fired")
        .groupBy(*entity, "island")
        .agg(
            F.min(t).alias("start"),
            F.max(t).alias("stop"),
            F.count("*").alias("fires"),
            F.max(F.abs(dev)).alias("max_abs"),
            F.max_by(F.col(dev), F.struct(F.abs(dev), F.col(seq))).alias("max_signed"),
        )
    )


def capped(found: DataFrame, entity: list[str], kept: int = KEPT) -> DataFrame:
    """The first `kept` windows of an entity, with the number of those dropped."""
    w = Window.partitionBy(*entity).orderBy("start", "island")
    whole = Window.partitionBy(*entity)
    return found.withColumn("rn", F.row_number().over(w)).withColumn("dropped", F.greatest(F.count("*").over(whole) - kept, F.lit(0))).filter(F.col("rn") <= kept)


def rollup(kept: DataFrame, entity: list[str]) -> DataFrame:
    """Over all entities: those with windows, windows kept, windows dropped, and fires within kept ones."""
    each = kept.groupBy(*entity).agg(F.count("*").alias("kept"), F.first("dropped").alias("dropped"), F.sum("fires").alias("fires"))
    return each.agg(F.count("*").alias("entities"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.coalesce(F.sum("fires"), F.lit(0)).alias("fires"))
