"""Relations of bounded size that say what they leave out: retained events, adaptive bins, category counts, attached entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import segments
from gridlens.operators.series import DAY_MS

# Retained events, those of the first part, bins after it and the least quota of a bin.
EVENTS, FIRST, BINS, QUOTA = 4000, 288, 64, 58
# Series bins, category keys and values, metric keys, attached entities and the names always attached.
SERIES, KEYS, VALUES, METRICS, ATTACHED, ALWAYS = 2000, 20, 20, 50, 32, "(?i)bess|battery"


def of_entity(rows: DataFrame, told: DataFrame, entity: list[str]) -> DataFrame:
    """`rows` with the columns of `told`, one row an entity; null entities meet."""
    own = told.select(*[F.col(c).alias(f"{c}__of") for c in entity], *[c for c in told.columns if c not in entity])
    return rows.join(own, [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in entity]).drop(*[f"{c}__of" for c in entity])


def retained(df: DataFrame, entity: list[str], order: list[str], t_ms: str, cap: int = EVENTS, first: int = FIRST, bins: int = BINS, quota: int = QUOTA, chunk: Column | None = None) -> DataFrame:
    """The events that stay of an entity, with the number of those dropped.

    Up to `cap` all stay. Beyond, the first `first` in order stay, and of the rest each of
    at most `bins` equal bins (a day doubled until the span fits) keeps its share of the
    room left, at least `quota`, at even distances in time with both ends. A row
    without time is in bin 0. The batch form of an online rule: the bins are those of the whole span.
    An entity is as many tasks as it has bins; `chunk`, which rises with `order`, cuts the numbering of its rows into tasks too.
    """
    ranked = segments.running(df, entity, order, F.lit(0) if chunk is None else chunk, rank__=F.lit(1))
    whole = of_entity(ranked, df.groupBy(*entity).agg(F.count("*").alias("seen__"), F.min(t_ms).alias("lo__"), F.max(t_ms).alias("hi__")), entity)
    days = F.floor((F.col("hi__") - F.col("lo__")) / DAY_MS) + 1
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(days / F.lit(float(bins)))))) * DAY_MS
    later = F.col("rank__") > first
    binned = whole.withColumn("bin__", F.when(later, F.coalesce(F.floor((F.col(t_ms) - F.col("lo__")) / width), F.lit(0))).otherwise(-1))
    inner = Window.partitionBy(*entity, "bin__")
    placed = binned.withColumns({"i__": F.row_number().over(inner.orderBy(F.col(t_ms).asc_nulls_last(), *order)) - 1, "n__": F.count("*").over(inner)})
    occupied = binned.groupBy(*entity).agg(F.count_distinct(F.when(F.col("bin__") >= 0, F.col("bin__"))).alias("bins__"))
    shared = of_entity(placed, occupied, entity).withColumn("k__", F.greatest(F.lit(quota), F.floor(F.lit(cap - first) / F.greatest("bins__", F.lit(1)))))
    # Row i is place j of k for the least j with j * (n - 1) >= i * (k - 1), if j * (n - 1) div (k - 1) is i.
    at = shared.withColumn("j__", F.expr("(i__ * (k__ - 1) + n__ - 2) div greatest(n__ - 1, 1)"))
    stays = (F.col("seen__") <= cap) | ~later | (F.col("n__") <= F.col("k__")) | F.expr("(j__ * (n__ - 1)) div greatest(k__ - 1, 1) = i__")
    left = at.filter(stays)
    dropped = left.groupBy(*entity).agg((F.first("seen__") - F.count("*")).alias("dropped"))
    return of_entity(left.drop("rank__", "seen__", "lo__", "hi__", "bin__", "i__", "n__", "k__", "j__", "bins__"), dropped, entity)


def retention_summary(kept: DataFrame, entity: list[str], t_ms: str) -> DataFrame:
    """kept, dropped and seen of all entities together, for each UTC year with the kept rows of that year."""
    year = F.year(F.timestamp_millis(t_ms)).alias("year")
    # dropped is the same on every row of an entity
    sums = kept.groupBy(*entity).agg(F.count("*").alias("kept"), F.first("dropped").alias("dropped")).agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))
    return kept.groupBy(year).agg(F.count("*").alias("of_year")).crossJoin(F.broadcast(sums)).withColumn("seen", F.col("kept") + F.col("dropped"))


def adaptive_bins(df: DataFrame, entity: list[str], order: list[str], t_ms: str, value: str, cap: int = SERIES, chunk: Column | None = None) -> DataFrame:
    """At most `cap` (an even number) bins of an entity: n, lo, hi, mean and the time of the first row.

    Rows of one time in a row share a bin. Online, a bin beyond `cap` makes neighbours
    merge in pairs with the last one carried on, so that early bins are wider. A bin that is
    the r-th to begin halves its place with every merge from then on, which gives its final place directly.
    `chunk`, which rises with `order`, cuts an entity into tasks.
    """
    at = F.lit(0) if chunk is None else chunk
    steps = segments.previous(df.filter(F.col(t_ms).isNotNull()), entity, order, at, before__=F.col(t_ms))
    begins = F.coalesce(F.col(t_ms) != F.col("before__"), F.lit(True)).cast("int")
    runs = segments.running(steps, entity, order, at, r__=begins).withColumn("r__", F.col("r__") - 1)
    last = of_entity(runs, runs.groupBy(*entity).agg(F.max("r__").alias("last__")), entity)
    half = cap // 2
    merges = lambda r: f"if({r} < {cap}, 0L, ({r} - {cap}) div {half} + 1)"  # noqa: E731  merges once r + 1 bins have begun
    begun = F.expr(f"if(r__ <= {cap}, r__, {half + 1} + (r__ - {cap + 1}) % {half})")
    since = F.expr(f"{merges('last__')} - {merges('(r__ - 1)')}")
    binned = last.withColumn("bin", F.floor(begun / F.pow(F.lit(2.0), since)))
    first = F.struct(*order)
    return binned.groupBy(*entity, "bin").agg(F.min_by(t_ms, first).alias("bin_ms"), F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))


def category_counts(df: DataFrame, key: str, value: str, order: list[str], keys: int = KEYS, values: int = VALUES) -> DataFrame:
    """Counts of the first `keys` keys to appear, each with its first `values` values; what comes later is left out."""
    cells = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("at__"))
    early = first_seen(cells.groupBy(key).agg(F.min("at__").alias("at__")), key, "at__", keys)
    within = F.row_number().over(Window.partitionBy(key).orderBy("at__"))
    return cells.join(F.broadcast(early), key, "left_semi").withColumn("rank__", within).filter(F.col("rank__") <= values).select(key, value, "n")


def first_seen(df: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """The `most` keys with the earliest `at`; a sorted limit, so that no task ranks all keys."""
    return df.orderBy(at, key).limit(most).select(key)


def first_metrics(df: DataFrame, key: str, value: str, order: list[str], most: int = METRICS) -> DataFrame:
    """n, lo, hi and mean of finite values for the `most` keys that appear first."""
    finite = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    found = finite.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.min(F.struct(*order)).alias("at__"))
    return found.orderBy("at__", key).limit(most).drop("at__")


def attached(entities: DataFrame, name: str, first: str, alarmed: Column, most: int = ATTACHED) -> DataFrame:
    """Entities with a series: the `most` that appear first, names of storage units, and those with an alarm."""
    early = first_seen(entities, name, first, most).withColumn("early__", F.lit(True))
    rows = entities.join(F.broadcast(early), name, "left")
    return rows.filter(F.coalesce(F.col("early__"), F.lit(False)) | F.col(name).rlike(ALWAYS) | F.coalesce(alarmed, F.lit(False))).drop("early__")


def flag_at(events: DataFrame, samples: DataFrame, entity: list[str], at: str, t_ms: str, flag: str, radius: int = 60_000, chunk_ms: int = DAY_MS) -> DataFrame:
    """`events` with the flag of the first sample less than `radius` away, else of the nearest one, the earlier on ties.

    An event asks at the first time that is near enough: the next sample from there is the near one, or, if it is too late for that,
    the nearest after the event, and then the one before is the nearest before it. Both sides lie on one line of time, whose stretches
    of `chunk_ms` are tasks; events are not paired with samples.
    """
    own = samples.groupBy(*entity, F.col(t_ms).alias("t__")).agg(F.min(F.struct(F.col(flag).alias("flag"))).alias("lo__"), F.max(F.struct(F.col(flag).alias("flag"))).alias("hi__"))
    side = lambda c: F.struct(F.col("t__").alias("t"), F.col(c)["flag"].alias("flag"))
    told = own.select(*entity, "t__", F.lit(1).alias("g__"), side("hi__").alias("p__"), F.when(F.col("t__").isNotNull(), side("lo__")).alias("q__"))
    # an event without a time takes the first sample
    asks = events.withColumns({"t__": F.coalesce(F.col(at).cast("long") - (radius - 1), F.lit(-(2**62))), "g__": F.lit(0)})
    line = segments.beside(asks.unionByName(told, allowMissingColumns=True), entity, ["t__", "g__"], F.expr(f"t__ div {chunk_ms}"), F.col("p__"), F.col("q__")).filter("g__ = 0")
    t, p, q = F.col(at), F.col("before__"), F.col("after__")
    sooner = p.isNotNull() & (q.isNull() | (t - p["t"] <= q["t"] - t))
    found = F.when(q["t"] < t + radius, q).when(sooner, p).otherwise(q)
    return line.select(*events.columns, found["flag"].alias(flag))
