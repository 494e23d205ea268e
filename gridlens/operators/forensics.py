"""Event anchors, common mode, nearest samples, resistance of transitions and knees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import segments


def step_anchor(bins: DataFrame, entity: list[str], t: str = "bin_ms", y: str = "mean") -> DataFrame:
    """The largest step between neighbouring bins of an entity; the earliest on ties."""
    w = Window.partitionBy(*entity).orderBy(t)
    steps = bins.withColumn("from_y", F.lag(y).over(w)).filter(F.col("from_y").isNotNull()).withColumn("step", F.col(y) - F.col("from_y"))
    best = F.max_by(F.struct(F.col(t).alias("t"), "step", "from_y", F.col(y).alias("to_y")), F.struct(F.abs("step"), -F.col(t)))
    return steps.groupBy(*entity).agg(best.alias("b")).select(*entity, "b.*")


def anchor_fold(points: Column) -> Column:
    """Anchor of an ordered array of (t, y), at most a series' worth of bins: the largest
    step, then a slow ramp from the first point where it exceeds 1.05 times the best so far."""
    none = F.struct(F.lit(None).cast("long").alias("t"), F.lit(0.0).alias("score"), F.lit(0.0).alias("last"), F.lit(0).alias("i"))
    first = F.get(points, F.lit(0))["y"]

    def take(acc, p, size):
        return F.struct(p["t"].alias("t"), size.alias("score"), p["y"].alias("last"), (acc["i"] + 1).alias("i"))

    def keep(acc, p):
        return F.struct(acc["t"].alias("t"), acc["score"].alias("score"), p["y"].alias("last"), (acc["i"] + 1).alias("i"))

    steps = F.aggregate(points, none, lambda acc, p: F.when((acc["i"] > 0) & (F.abs(p["y"] - acc["last"]) > acc["score"]), take(acc, p, F.abs(p["y"] - acc["last"]))).otherwise(keep(acc, p)))
    return F.aggregate(points, steps, lambda acc, p: F.when(F.abs(p["y"] - first) > 1.05 * acc["score"], take(acc, p, F.abs(p["y"] - first))).otherwise(keep(acc, p)))


def level_anchor(df: DataFrame, entity: list[str], t: str, y: str) -> DataFrame:
    """The row of the largest absolute level; the earliest on ties."""
    return df.groupBy(*entity).agg(F.max_by(F.struct(F.col(t).alias("t"), F.col(y).alias("y")), F.struct(F.abs(y), -F.col(t))).alias("b")).select(*entity, "b.*")


def around(df: DataFrame, anchors: DataFrame, entity: list[str], t: str, radius_ms: int) -> DataFrame:
    """Rows within the closed radius of their entity's anchor `t`."""
    a = anchors.select(*entity, F.col("t").alias("anchor_ms"))
    return df.join(a, entity).filter(F.col(t).between(F.col("anchor_ms") - radius_ms, F.col("anchor_ms") + radius_ms))


def normalized(df: DataFrame, entity: list[str], t: str, y: str) -> DataFrame:
    """Adds y_norm: change from the first row over the largest absolute change (at least 1e-6)."""
    w = Window.partitionBy(*entity).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = df.withColumn("change", F.col(y) - F.first(y).over(w))
    return moved.withColumn("y_norm", F.col("change") / F.greatest(F.max(F.abs("change")).over(Window.partitionBy(*entity)), F.lit(1e-6))).drop("change")


def event_states(spans: DataFrame, before_ms: int = 600_000, after_ms: int = 600_000) -> DataFrame:
    """Normal, Precursor, Main and Recovery around `t`, clamped to [lo, hi]."""
    lo, hi, t = F.col("lo"), F.col("hi"), F.col("t")
    start, stop = F.greatest(lo, t - before_ms), F.least(hi, t + after_ms)
    state = lambda name, a, b: F.struct(F.lit(name).alias("state"), a.alias("from_ms"), b.alias("to_ms"))
    states = F.array(state("Normal", lo, start), state("Precursor", start, t), state("Main", t, t), state("Recovery", t, stop))
    return spans.withColumn("s", F.explode(states)).select(*[c for c in spans.columns if c not in ("lo", "hi", "t")], "s.*")


def nearest(grid: DataFrame, samples: DataFrame, by: list[str], t: str, y: str, chunk: str | None = None) -> DataFrame:
    """For every grid time the sample of the same key nearest in time; the earlier one on ties.

    Both sides are laid on one time line for each key; the last sample at or before
    and the first at or after are carried along it in both directions, so no pairs are made. `chunk`, an
    expression of the time `t` that rises with it, cuts the line of a key into tasks.
    """
    line = grid.select(*by, F.col(t).alias("t"), F.lit(None).cast("long").alias("st"), F.lit(None).cast("double").alias("sy"), F.lit(1).alias("g"))
    line = line.unionByName(samples.groupBy(*by, F.col(t).alias("t")).agg(F.min_by(y, F.col(y)).cast("double").alias("sy")).select(*by, "t", F.col("t").alias("st"), "sy", F.lit(0).alias("g")))
    pair = F.when(F.col("st").isNotNull(), F.struct("st", "sy"))
    at = F.lit(0) if chunk is None else F.expr(chunk)
    both = segments.latest(line, by, ["t", "g"], at, p=pair).withColumn("back__", -F.col("t"))
    both = segments.latest(both, by, ["back__", "g"], -at, q=pair).filter("g = 1")
    first = F.col("q").isNull() | (F.col("p").isNotNull() & (F.col("t") - F.col("p.st") <= F.col("q.st") - F.col("t")))
    near = F.when(first, F.col("p")).otherwise(F.col("q"))
    return both.select(*by, F.col("t").alias(t), near["st"].alias("near_ms"), F.coalesce(near["sy"], F.lit(0.0)).alias("near_y"))


def common_mode(peers: DataFrame) -> DataFrame:
    """(support, peers, mean_corr) of peers (corr, same_sign) and the mode they speak for."""
    support = F.count_if((F.col("corr") >= 0.45) & F.col("same_sign"))
    row = peers.agg(support.alias("support"), F.count("*").alias("peers"), F.avg("corr").alias("mean_corr"))
    mode = F.when(F.col("peers") == 0, "unknown").when((F.col("support") >= 1) & (F.col("mean_corr") >= 0.35), "common").otherwise("local")
    return row.withColumn("mode", mode)


def transitions(df: DataFrame, entity: list[str], order: list[str], i: str, v: str, step: float = 5.0, idle: float = 2.0, chunk: Column | None = None) -> DataFrame:
    """Rows where the current moves by `step` or more and is not idle on both sides, with the resistance -dV/dI.

    `chunk`, which rises with `order`, cuts an entity into tasks.
    """
    if chunk is not None:
        paired = segments.previous(df, entity, order, chunk, i0=F.col(i), v0=F.col(v))
    else:
        w = Window.partitionBy(*entity).orderBy(*order)
        paired = df.withColumns({"i0": F.lag(i).over(w), "v0": F.lag(v).over(w)})
    moved = paired.withColumns({"di": F.col(i) - F.col("i0"), "dv": F.col(v) - F.col("v0")}).drop("v0")
    return moved.filter((F.abs("di") >= step) & ~((F.abs("i0") < idle) & (F.abs(i) < idle))).withColumn("r", -F.col("dv") / F.col("di"))


def cell_resistance(before: Column, after: Column, di: Column) -> Column:
    return F.zip_with(before, after, lambda a, b: -(b - a) / di)


def cell_events(df: DataFrame, entity: list[str], order: list[str], i: str, cells: str, step: float = 5.0, idle: float = 2.0, chunk: Column | None = None) -> DataFrame:
    """Changes of current of a battery, as `transitions`, with di and the resistance r of every cell."""
    paired = segments.previous(df, entity, order, F.lit(0) if chunk is None else chunk, i0=F.col(i), c0=F.col(cells)).withColumn("di", F.col(i) - F.col("i0"))
    moved = paired.filter((F.abs("di") >= step) & ~((F.abs("i0") < idle) & (F.abs(i) < idle)))
    return moved.withColumn("r", cell_resistance(F.col("c0"), F.col(cells), F.col("di"))).drop("i0", "c0")


def matched_point(df: DataFrame, by: list[str], limits: dict[str, float], least: int = 8) -> DataFrame:
    """Rows near the group's lower medians of all columns; groups under `least` rows stay whole, missing values pass."""
    from gridlens.operators.stats import lower_quantiles

    n = df.groupBy(*by).agg(F.count("*").alias("n__"))
    out = df.join(n, by)
    ok = F.lit(True)
    for c, limit in limits.items():
        mid = lower_quantiles(df, c, {f"{c}__mid": 0.5}, by).drop("max")
        out = out.join(mid, by, "left")
        ok = ok & F.coalesce(F.abs(F.col(c) - F.col(f"{c}__mid")) <= limit, F.lit(True))
    return out.filter((F.col("n__") < least) | ok).drop("n__", *[f"{c}__mid" for c in limits])


def drift(df: DataFrame, by: list[str], order: list[str], r: str, least: int = 4) -> DataFrame:
    """Median of the last fifth less median of the first fifth of a group (four rows at least)."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(*order)))
    k = F.greatest(F.lit(least), F.floor(F.col("n") / 5))
    ends = ranked.filter(F.col("n") >= least).groupBy(*by).agg(F.expr(f"percentile(CASE WHEN rn <= greatest({least}, floor(n / 5)) THEN {r} END, 0.5)").alias("head"), F.expr(f"percentile(CASE WHEN rn > n - greatest({least}, floor(n / 5)) THEN {r} END, 0.5)").alias("tail"), F.max(k).alias("k"))
    return ends.withColumn("drift", F.col("tail") - F.col("head"))


def piecewise_knee(df: DataFrame, by: list[str], x: str, y: str, margin: int = 8, least: int = 24) -> DataFrame:
    """Split of an ordered series into two least-squares lines with the least squared error.

    Prefix and suffix sums give the error of every split in closed form.
    """
    w = Window.partitionBy(*by).orderBy(x)
    pre, suf = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("i", (F.row_number().over(w) - 1).cast("double")).withColumn("n", F.count("*").over(Window.partitionBy(*by))).withColumn("yy", F.col(y).cast("double"))

    def fit(frame: object, name: str, d: DataFrame) -> DataFrame:
        n, sx, sy = F.count("*").over(frame), F.sum("i").over(frame), F.sum("yy").over(frame)
        sxx, sxy, syy = F.sum(F.col("i") * F.col("i")).over(frame), F.sum(F.col("i") * F.col("yy")).over(frame), F.sum(F.col("yy") * F.col("yy")).over(frame)
        vx, vxy, vy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
        return d.withColumn(f"{name}_slope", F.coalesce(F.try_divide(vxy, vx), F.lit(0.0))).withColumn(f"{name}_sse", vy - F.coalesce(F.try_divide(vxy * vxy, vx), F.lit(0.0)))

    d = fit(suf, "right", fit(pre, "left", d)).filter((F.col("n") >= least) & (F.col("i") >= margin) & (F.col("i") <= F.col("n") - margin - 1)).withColumn("sse", F.col("left_sse") + F.col("right_sse"))
    best = F.min_by(F.struct(F.col(x).alias("knee_x"), F.col("i").cast("int").alias("split"), "sse", "left_slope", "right_slope"), F.struct(F.round("sse", 9), F.col("i")))
    out = d.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
    return out.withColumn("slope_ratio", F.abs("right_slope") / F.greatest(F.abs("left_slope"), F.lit(1e-9)))


def chord_knee(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Point furthest below the chord on axes scaled to 0..1; the earliest on ties."""
    w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scaled = df.withColumns({"x0": F.first(x).over(w), "x1": F.last(x).over(w), "y0": F.first(y).over(w), "y1": F.last(y).over(w)})
    nx, ny = F.try_divide(F.col(x) - F.col("x0"), F.col("x1") - F.col("x0")), F.try_divide(F.col(y) - F.col("y0"), F.col("y1") - F.col("y0"))
    gaps = scaled.withColumn("gap", F.round(nx - ny, 9)).filter("gap is not null")
    return gaps.groupBy(*by).agg(F.max_by(F.struct(F.col(x).alias("knee_x"), "gap"), F.struct("gap", -F.col(x))).alias("b")).select(*by, "b.*")


def knee_agreement(piecewise: DataFrame, chord: DataFrame, spans: DataFrame, by: list[str], share: float = 0.25) -> DataFrame:
    """Whether two knees lie within a share of the span, and their mean if so."""
    both = spans.join(piecewise.select(*by, F.col("knee_x").alias("px")), by, "left").join(chord.select(*by, F.col("knee_x").alias("cx")), by, "left")
    reason = F.when(F.col("px").isNull(), "no piecewise knee").when(F.col("cx").isNull(), "no chord knee").when(F.abs(F.col("px") - F.col("cx")) > share * (F.col("hi") - F.col("lo")), "methods disagree")
    return both.withColumn("reason", reason).withColumn("knee", F.when(reason.isNull(), (F.col("px") + F.col("cx")) / 2))


def balancing_burden(df: DataFrame, entity: list[str], t_ms: str, currents: str) -> DataFrame:
    """Charge moved by balancing for each cell: |b| times the hours since the event before."""
    w = Window.partitionBy(*entity).orderBy(t_ms)
    gaps = df.withColumn("hours", (F.col(t_ms) - F.lag(t_ms).over(w)) / F.lit(3_600_000.0)).filter("hours is not null")
    return gaps.select(*entity, "hours", F.posexplode(currents).alias("cell", "b")).groupBy(*entity, (F.col("cell") + 1).alias("cell")).agg(F.sum(F.abs("b") * F.col("hours")).alias("charge"))
