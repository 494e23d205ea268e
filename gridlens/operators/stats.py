"""Counts, running statistics, quantiles, capped category counts and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import segments
from gridlens.session import stored

DAY_MS = 86_400_000


def numeric_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """min, max, sum, count and average of every column as tidy rows; NaN is left out, infinities stay.

    The columns are aggregated side by side in one pass and unpivoted afterwards.
    """
    by = by or []
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wide = df.groupBy(*by).agg(*[f(value(c)).alias(f"{c}__{k}") for c in columns for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("n", F.count))])
    entry = lambda c: F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}__{k}").alias(k) for k in ("min", "max", "sum", "n")])
    tidy = wide.select(*by, F.explode(F.array(*map(entry, columns))).alias("s")).select(*by, "s.*")
    return tidy.withColumn("mean", F.when(F.col("n") > 0, F.col("sum") / F.col("n")))


def lower_quantile(values: Column, p: float) -> Column:
    """sorted[floor(p (n - 1))] of an array, without interpolation."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.lit(p) * (F.size(s) - 1)).cast("int"))


def lower_quantiles(df: DataFrame, value: str, ps: dict[str, float], by: list[str], cells: int = 4096, few: int = 100_000, passes: int = 12) -> DataFrame:
    """lower_quantile of groups of any size, and their largest value, without sorting a group.

    Each quantile of a group has a bracket of values, at first all of them, that holds the
    sought rank. A pass counts the rows of a bracket over `cells` equal cells, with the least and largest value of
    each, and the cell of the rank is the next bracket; it ends where these are equal, after
    some log(rows) / log(cells) passes. No row moves: cells are counted within tasks first, and the brackets
    are broadcast while they are at most `few`. NaN is the largest value, as in sorting; null is no value.
    """
    if not ps:
        return df.groupBy(*by).agg(F.max(value).alias("max"))
    names = [f"by__{i}" for i in range(len(by))]
    same = [F.col(n).eqNullSafe(F.col(f"{n}of")) for n in names]
    x = F.col("x__")
    # infinities and NaN lie in cells of their own, at the ends
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(value).alias("v__"), F.col(value).cast("double").alias("x__"))
    all_ = rows.groupBy(*names).agg(F.count("*").alias("n__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k__"), F.lit(p).alias("p__")) for k, p in ps.items()]))
    now = all_.withColumn("e__", each).select(*[F.col(n).alias(f"{n}of") for n in names], F.col("e__.k__").alias("k__"), F.floor(F.col("e__.p__") * (F.col("n__") - 1)).cast("long").alias("rank__"), "lo__", "hi__", F.col("hi__").alias("max__"))
    now, done = stored(now, "brackets"), []
    for turn in range(passes + 1):
        done.append(now.filter("lo__ = hi__"))
        open_ = now.filter("lo__ <> hi__")
        n = open_.count()
        if not n:
            break
        lo, hi = F.greatest(F.col("lo__").cast("double"), F.lit(-1.7e308)), F.when(F.isnan(F.col("hi__").cast("double")), 1.7e308).otherwise(F.least(F.col("hi__").cast("double"), F.lit(1.7e308)))
        share = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)
        cell = F.when(finite, F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor(F.coalesce(share, F.lit(0.0)) * cells)))).when(x == -float("inf"), -1).otherwise(F.when(F.isnan(x), cells + 1).otherwise(cells))
        inside = (F.col("v__") >= F.col("lo__")) & (F.col("v__") <= F.col("hi__"))
        met = rows.join(F.broadcast(open_) if n <= few else open_, [*same, inside])
        # the last turn, for brackets that equal cells no longer divide, takes every value as a cell
        of = [F.col(f"{n}of") for n in names]
        counts = met.groupBy(*of, "k__", "rank__", "max__", (F.col("v__") if turn == passes else cell).alias("cell__")).agg(F.count("*").alias("n__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__"))
        upto = F.sum("n__").over(Window.partitionBy(*of, "k__").orderBy("cell__").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("upto__", upto).filter((F.col("rank__") < F.col("upto__")) & (F.col("rank__") >= F.col("upto__") - F.col("n__")))
        now = stored(found.select(*of, "k__", (F.col("rank__") - F.col("upto__") + F.col("n__")).alias("rank__"), "lo__", "hi__", "max__"), "brackets")
    else:
        done.append(now)
    told = reduce(DataFrame.unionByName, done)
    picks = [F.max(F.when(F.col("k__") == k, F.col("lo__"))).alias(k) for k in ps]
    return told.groupBy(*[F.col(f"{n}of").alias(c) for c, n in zip(by, names, strict=True)]).agg(*picks, F.max("max__").alias("max"))


def largest_gap(df: DataFrame, entity: list[str], order: list[str], t_ms: str, chunk: Column) -> DataFrame:
    """The largest time between neighbouring rows of an entity and its share of the span; `chunk`, which rises with `order`, cuts an entity into tasks."""
    steps = segments.previous(df, entity, order, chunk, before__=F.col(t_ms))
    found = steps.groupBy(*entity).agg(F.max(F.col(t_ms) - F.col("before__")).alias("gap"), (F.max(t_ms) - F.min(t_ms)).alias("span"))
    return found.withColumn("share", F.try_divide("gap", "span"))


def counts_capped(df: DataFrame, by: list[str], key: str, order: list[str], cap: int = 20, other: str = "other") -> DataFrame:
    """Counts by key; keys beyond the first `cap` seen fall under `other`."""
    seen = df.groupBy(*by, key).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first__"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("first__"))
    return seen.withColumn("reason", F.when(rank <= cap, F.col(key).cast("string")).otherwise(F.lit(other))).groupBy(*by, "reason").agg(F.sum("n").alias("n"))


def category_over_time(df: DataFrame, by: list[str], key: str, t_ms: str, bins: int = 24, width: int = DAY_MS) -> DataFrame:
    """Counts by key over equal bins; the width is the least doubling of a day that needs at most `bins`."""
    span = df.groupBy(*by).agg(F.min(t_ms).alias("lo"), F.max(t_ms).alias("hi"))
    k = F.aggregate(F.sequence(F.lit(0), F.lit(40)), F.lit(-1), lambda acc, i: F.when((acc < 0) & (F.floor((F.col("hi") - F.col("lo")) / (F.lit(float(width)) * F.pow(F.lit(2.0), i))) < bins), i).otherwise(acc))
    sized = span.withColumn("width_ms", (F.lit(float(width)) * F.pow(F.lit(2.0), k)).cast("long"))
    placed = df.join(sized, by).withColumn("bin", F.floor((F.col(t_ms) - F.col("lo")) / F.col("width_ms")).cast("int"))
    return placed.groupBy(*by, "width_ms", "bin", key).agg(F.count("*").alias("n"))


def time_coverage(df: DataFrame, by: list[str], t_ms: str, kept: Column) -> DataFrame:
    """Range of all rows and of the kept ones, and the share of the span that these cover."""
    r = df.groupBy(*by).agg(F.min(t_ms).alias("data_lo"), F.max(t_ms).alias("data_hi"), F.min(F.when(kept, F.col(t_ms))).alias("kept_lo"), F.max(F.when(kept, F.col(t_ms))).alias("kept_hi"))
    span, own = F.col("data_hi") - F.col("data_lo"), F.col("kept_hi") - F.col("kept_lo")
    ratio = F.when(F.col("kept_lo").isNull(), F.lit(None)).when(span <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), own / span))
    return r.withColumn("coverage", ratio).withColumn("low_coverage", F.col("coverage") < 0.2)


def time_histogram(df: DataFrame, by: list[str], t_ms: str, buckets: int = 8) -> DataFrame:
    """Counts over equal buckets of the data span, the last one closed, empty ones kept."""
    span = df.groupBy(*by).agg(F.min(t_ms).alias("lo"), F.max(t_ms).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor((F.col(t_ms) - F.col("lo")) * F.lit(float(buckets)) / (F.col("hi") - F.col("lo"))))).otherwise(0)
    counts = df.join(span, by).groupBy(*by, at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    frame = span.select(*by, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return frame.join(counts, [*by, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def deviations(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, least, most, mean, middle, mad (of the finite values about their median), and quantiles p01 to p99, interpolated."""
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    ps = {f"p{int(p * 100):02d}": p for p in (0.01, 0.05, 0.25, 0.75, 0.95, 0.99)}
    found = finite.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("middle"), *[F.percentile(value, F.lit(p)).alias(k) for k, p in ps.items()])
    own = [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in by]
    middles = found.select(*[F.col(c).alias(f"{c}__of") for c in by], F.col("middle").alias("middle__"))
    spread = finite.join(middles, own).groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("middle__")), F.lit(0.5)).alias("mad"))
    of = spread.select(*[F.col(c).alias(f"{c}__of") for c in by], "mad")
    return found.join(of, own).drop(*[f"{c}__of" for c in by])


def least_squares(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """slope, base and squared error of the line through the pairs of a group; 0, 0 and infinity for fewer than three."""
    told = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, sse = F.count("*"), F.regr_syy(y, x) - F.coalesce(F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.lit(0.0))
    few = n < 3
    return told.groupBy(*by).agg(F.when(few, 0.0).otherwise(F.coalesce(F.regr_slope(y, x), F.lit(0.0))).alias("slope"), F.when(few, 0.0).otherwise(F.coalesce(F.regr_intercept(y, x), F.avg(y))).alias("base"), F.when(few, float("inf")).otherwise(sse).alias("sse"))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; 0 for fewer than four pairs or without variance."""
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(F.count("*") < 4, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))


def top_with_rest(df: DataFrame, by: list[str], rank: list[Column], sums: list[str], top: int) -> DataFrame:
    """The first `top` rows of each group as they are and one row that sums up the others."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*rank)) if by else F.row_number().over(Window.orderBy(*rank))
    ranked = df.withColumn("rn", rn)
    slot = F.when(F.col("rn") <= top, F.col("rn")).otherwise(F.lit(top + 1))
    return ranked.withColumn("slot", slot).groupBy(*by, "slot").agg(F.count("*").alias("members"), *[F.sum(c).alias(c) for c in sums])
