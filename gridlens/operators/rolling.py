"""Rolling baselines and alarm rules over the last rows of an entity.

Frames follow arrival order. `order` names the columns that give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

# Baseline length and least size, scale of the MAD, floors and thresholds.
BASELINE, LEAST, MAD_SCALE, FLOOR = 15, 8, 1.4826, 0.5
DEVIATION, Z_ALARM, RAMP_ALARM, ONSET_ALARM = 5.0, 3.0, 6.0, 3.0


def trailing(entity: list[str], order: list[str], rows: int = BASELINE) -> WindowSpec:
    """The `rows` rows before the current one."""
    return Window.partitionBy(*entity).orderBy(*order).rowsBetween(-rows, -1)


def in_chunks(df: DataFrame, entity: list[str], order: list[str], chunk: Column, back: int) -> DataFrame:
    """`df` with chunk__ and halo__: each chunk of an entity preceded by the entity's `back` rows before it.

    Frames of up to `back` rows can then be taken within (entity, chunk__), so that the history
    of one entity is many tasks; rows with halo__ only serve the frames and are filtered
    afterwards. `chunk` rises with `order`. Only `df` itself is shuffled, once, by those
    frames; beside it go the sizes of the chunks and their last rows, which are small.
    """
    keys = [*entity, "chunk__"]
    rows = df.withColumn("chunk__", chunk)
    line = Window.partitionBy(*entity).orderBy("chunk__")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size__")).withColumn("before__", F.sum("size__").over(line) - F.col("size__"))
    # A chunk has a row or more, so the last rows of one are wanted by at most the `back` next chunks.
    nexts = sizes.withColumn("next__", F.collect_list(F.struct("chunk__", "before__")).over(line.rowsBetween(1, back))).select(*[F.col(c).alias(f"{c}__of") for c in keys], "size__", "before__", "next__")
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    tails = rows.withColumn("rank__", F.row_number().over(latest)).filter(F.col("rank__") <= back)
    same = [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in keys]
    placed = tails.join(nexts, same).withColumn("place__", F.col("before__") + F.col("size__") - F.col("rank__")).select(*df.columns, "place__", F.explode("next__").alias("to__"))
    halo = placed.filter(F.col("place__") >= F.col("to__.before__") - back).select(*df.columns, F.col("to__.chunk__").alias("chunk__"), F.lit(True).alias("halo__"))
    return rows.withColumn("halo__", F.lit(False)).unionByName(halo)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: filters and projections above a generator take its output, not its expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def median_of(values: Column) -> Column:
    """Midpoint median of an array; null for an empty one."""
    return middle(F.array_sort(values))


def middle(s: Column) -> Column:
    """Midpoint of a sorted array; null for an empty one."""
    n = F.size(s)
    half = F.floor(n / 2).cast("int")
    return F.when(n > 0, F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2))


def baseline(df: DataFrame, value: str, entity: list[str], order: list[str], rows: int = BASELINE, chunk: Column | None = None) -> DataFrame:
    """Adds base_n, base_mean, base_std, base_median, base_mad, delta and ramp_median.

    `chunk`, which rises with `order`, cuts an entity into tasks; without it an entity is one task.
    """
    if chunk is not None:  # the earliest row of a frame has its own delta
        held = in_chunks(df, entity, order, chunk, rows + 1)
        return baseline(held, value, [*entity, "chunk__"], order, rows).filter(~F.col("halo__")).drop("chunk__", "halo__")
    w = trailing(entity, order, rows)
    step = Window.partitionBy(*entity).orderBy(*order)
    framed = df.withColumn("delta", F.col(value) - F.lag(value).over(step)).withColumns(
        {
            "base_n": F.count(value).over(w),
            "base_mean": F.avg(value).over(w),
            "base_std": F.coalesce(F.stddev_pop(value).over(w), F.lit(0.0)),
            "base_values": F.collect_list(value).over(w),
            "ramps": F.collect_list(F.abs("delta")).over(w),
        }
    )
    ordered = once(framed, sorted_values=F.sort_array("base_values"), sorted_ramps=F.sort_array("ramps"))
    centred = ordered.withColumns({"base_median": middle(F.col("sorted_values")), "ramp_median": F.coalesce(middle(F.col("sorted_ramps")), F.lit(0.0))})
    spread = once(centred, spreads=F.sort_array(F.transform("sorted_values", lambda x: F.abs(x - F.col("base_median")))))
    return spread.withColumn("base_mad", F.coalesce(middle(F.col("spreads")), F.lit(0.0))).drop("base_values", "ramps", "sorted_values", "sorted_ramps", "spreads")


def scores(df: DataFrame, value: str) -> DataFrame:
    """Adds z_robust, z_std and ramp_score to a baseline."""
    dev = F.col(value) - F.col("base_median")
    return df.withColumns(
        {
            "z_robust": F.abs(dev) / F.greatest(F.lit(MAD_SCALE) * F.col("base_mad"), F.lit(FLOOR)),
            "z_std": F.abs(F.col(value) - F.col("base_mean")) / F.greatest("base_std", F.lit(FLOOR)),
            "ramp_score": F.abs("delta") / F.greatest(F.lit(MAD_SCALE) * F.col("ramp_median"), F.lit(FLOOR)),
        }
    )


def alarms(df: DataFrame, value: str) -> DataFrame:
    """Adds stat_alarm, ramp_alarm and the joined rule codes to scored rows."""
    enough = F.col("base_n") >= LEAST
    stat = enough & (F.abs(F.col(value) - F.col("base_median")) >= DEVIATION) & ((F.col("z_robust") >= Z_ALARM) | (F.col("z_std") >= Z_ALARM))
    ramp = enough & (F.abs("delta") >= DEVIATION) & (F.col("ramp_score") >= RAMP_ALARM)
    flags = df.withColumns({"stat_alarm": F.coalesce(stat, F.lit(False)), "ramp_alarm": F.coalesce(ramp, F.lit(False))})
    return flags.withColumn("rule", F.concat_ws(" + ", F.when(F.col("stat_alarm"), F.lit("STAT")), F.when(F.col("ramp_alarm"), F.lit("RAMP"))))


def onset(df: DataFrame, dev: str, entity: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """Adds onset_score and onset_alarm: a deviation far above the last deviations of the entity. `chunk` as in `baseline`."""
    if chunk is not None:
        held = in_chunks(df, entity, order, chunk, BASELINE)
        return onset(held, dev, [*entity, "chunk__"], order).filter(~F.col("halo__")).drop("chunk__", "halo__")
    w = trailing(entity, order)
    return (
        once(df.withColumns({"dev_n": F.count(dev).over(w), "devs": F.collect_list(F.abs(dev)).over(w)}), sorted_devs=F.sort_array("devs"))
        .withColumn("dev_median", F.coalesce(middle(F.col("sorted_devs")), F.lit(0.0)))
        .drop("devs", "sorted_devs")
        .withColumn("onset_score", F.abs(dev) / F.greatest(F.lit(MAD_SCALE) * F.col("dev_median"), F.lit(FLOOR)))
        .withColumn("onset_alarm", F.coalesce((F.col("dev_n") >= LEAST) & (F.abs(dev) >= DEVIATION) & (F.col("onset_score") >= ONSET_ALARM), F.lit(False)))
    )


def context(df: DataFrame, columns: list[str], entity: list[str], order: list[str], rows: int = 5) -> DataFrame:
    """Adds `context`: the current and the rows before it, oldest first."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("context", F.collect_list(F.struct(*columns)).over(w))


def cell_residuals(cells: Column) -> Column:
    """Per cell its value less the median of the other cells."""
    return F.transform(cells, lambda v, i: v - median_of(F.filter(cells, lambda _, j: j != i)))


def outlier_cell(residuals: Column) -> Column:
    """1-based cell of the largest absolute residual; the lowest cell on ties."""
    sizes = F.transform(residuals, lambda r: F.abs(r))
    return F.array_position(sizes, F.array_max(sizes)).cast("int")


def cell_alarm(residuals: Column, least: float = 0.03, factor: float = 3.0, floor: float = 0.005) -> Column:
    """A cell stands out: its centred residual reaches the floor and the spread of the others."""
    mid = median_of(residuals)
    centred = F.transform(residuals, lambda r: F.abs(r - mid))
    spread = F.greatest(F.lit(MAD_SCALE) * median_of(centred), F.lit(floor))
    return F.array_max(centred) >= F.greatest(F.lit(least), F.lit(factor) * spread)


def cell_spread(cells: Column) -> Column:
    """Population standard deviation over the cells of a row; null cells are left out, null without any."""
    told = F.filter(cells, lambda v: v.isNotNull())
    n = F.size(told)
    mean = F.aggregate(told, F.lit(0.0), lambda a, v: a + v) / n
    return F.when(n > 0, F.sqrt(F.aggregate(told, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n))


def hottest(temperatures: Column) -> Column:
    """How far the largest temperature of a row lies over their median; null without any."""
    told = F.filter(temperatures, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.array_max(told) - median_of(told)
