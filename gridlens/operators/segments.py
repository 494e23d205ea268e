"""Ordered operations over entities of any length, cut into chunks.

A running state over the rows of one entity would be one task. Here an entity is cut
into chunks (`chunk`, a column that rises with the order: a day, a week, a range of
line numbers); each chunk is scanned by itself and says in one row what it does to
the state; these rows, one a chunk, are scanned by entity; and the state that a chunk begins with
is joined back to its rows. Rows are shuffled once, by entity and chunk. The rows of states
are as many as chunks, so their scan is small where chunks are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridlens.operators.rolling import in_chunks

CHUNK = "chunk__"


def dealt(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(CHUNK, chunk)


def line(entity: list[str], order: list[str]) -> WindowSpec:
    """The rows of a chunk up to the current one."""
    return Window.partitionBy(*entity, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def before(entity: list[str]) -> WindowSpec:
    """The chunks of an entity before the current one."""
    return Window.partitionBy(*entity).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, states: DataFrame, entity: list[str]) -> DataFrame:
    """`rows` with the columns of `states` (entity, chunk, ...), one row a chunk; null keys meet."""
    keys = [*entity, CHUNK]
    own = states.select(*[F.col(c).alias(f"{c}__of") for c in keys], *[c for c in states.columns if c not in keys])
    same = [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in keys]
    return rows.join(own, same).drop(*[f"{c}__of" for c in keys])


def running(df: DataFrame, entity: list[str], order: list[str], chunk: Column, **sums: Column) -> DataFrame:
    """Adds running sums (null counts nothing) up to and with each row. A sum of 1 is the row number."""
    rows = dealt(df, chunk).withColumns({f"{n}__v": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    own = rows.withColumns({f"{n}__in": F.sum(f"{n}__v").over(line(entity, order)) for n in sums})
    whole = rows.groupBy(*entity, CHUNK).agg(*[F.sum(f"{n}__v").alias(f"{n}__all") for n in sums])
    states = whole.select(*entity, CHUNK, *[F.coalesce(F.sum(f"{n}__all").over(before(entity)), F.lit(0)).alias(f"{n}__before") for n in sums])
    return carried(own, states, entity).select(*df.columns, *[(F.col(f"{n}__before") + F.col(f"{n}__in")).alias(n) for n in sums])


def span(df: DataFrame, entity: list[str], order: list[str], chunk: Column, t: str) -> DataFrame:
    """Adds lo and hi: the least and largest `t` up to and with each row."""
    rows, w = dealt(df, chunk), line(entity, order)
    own = rows.withColumns({"lo__in": F.min(t).over(w), "hi__in": F.max(t).over(w)})
    whole = rows.groupBy(*entity, CHUNK).agg(F.min(t).alias("lo__all"), F.max(t).alias("hi__all"))
    states = whole.select(*entity, CHUNK, F.min("lo__all").over(before(entity)).alias("lo__before"), F.max("hi__all").over(before(entity)).alias("hi__before"))
    return carried(own, states, entity).select(*df.columns, F.least("lo__in", "lo__before").alias("lo"), F.greatest("hi__in", "hi__before").alias("hi"))


def previous(df: DataFrame, entity: list[str], order: list[str], chunk: Column, **columns: Column) -> DataFrame:
    """Adds values of the row before, null for the first row of an entity."""
    held = in_chunks(df, entity, order, chunk, 1)
    step = Window.partitionBy(*entity, CHUNK).orderBy(*order)
    return held.withColumns({n: F.lag(c).over(step) for n, c in columns.items()}).filter(~F.col("halo__")).drop(CHUNK, "halo__")


def latest(df: DataFrame, entity: list[str], order: list[str], chunk: Column, **values: Column) -> DataFrame:
    """Adds the last value that is not null up to and with each row, whatever chunk it is in."""
    rows = dealt(df, chunk).withColumns({f"{n}__v": c for n, c in values.items()})
    own = rows.withColumns({f"{n}__in": F.last(f"{n}__v", ignorenulls=True).over(line(entity, order)) for n in values})
    last = lambda n: F.max_by(f"{n}__v", F.when(F.col(f"{n}__v").isNotNull(), F.struct(*order))).alias(f"{n}__end")
    whole = rows.groupBy(*entity, CHUNK).agg(*[last(n) for n in values])
    states = whole.select(*entity, CHUNK, *[F.last(f"{n}__end", ignorenulls=True).over(before(entity)).alias(f"{n}__before") for n in values])
    return carried(own, states, entity).select(*df.columns, *[F.coalesce(f"{n}__in", f"{n}__before").alias(n) for n in values])


def beside(df: DataFrame, entity: list[str], order: list[str], chunk: Column, before_: Column, after_: Column) -> DataFrame:
    """Adds before__ and after__: of values that are not null, the last up to each row and the first from it on, whatever chunks they are in.

    One shuffle of the rows; `order` should leave no ties.
    """
    rows = dealt(df, chunk).withColumns({"p__v": before_, "q__v": after_})
    reverse = Window.partitionBy(*entity, CHUNK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("p__in", F.last("p__v", ignorenulls=True).over(line(entity, order))).withColumn("q__in", F.last("q__v", ignorenulls=True).over(reverse))
    told = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    whole = rows.groupBy(*entity, CHUNK).agg(F.max_by("p__v", told("p__v")).alias("p__end"), F.min_by("q__v", told("q__v")).alias("q__end"))
    later = Window.partitionBy(*entity).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    states = whole.select(*entity, CHUNK, F.last("p__end", ignorenulls=True).over(before(entity)).alias("p__before"), F.last("q__end", ignorenulls=True).over(later).alias("q__after"))
    return carried(own, states, entity).select(*df.columns, F.coalesce("p__in", "p__before").alias("before__"), F.coalesce("q__in", "q__after").alias("after__"))


def runs(df: DataFrame, entity: list[str], order: list[str], chunk: Column, hit: Column, reset: Column) -> DataFrame:
    """Adds island (resets so far) and run (hits since the last reset).

    A chunk says how many resets it has, its hits, and its hits after its last reset. A chunk begins with the
    hits since the last chunk with a reset: that chunk's last hits and those of the chunks after it.
    """
    rows = dealt(df, chunk).withColumns({"hit__": hit.cast("int"), "reset__": reset.cast("int")})
    own = rows.withColumn("in__", F.sum("reset__").over(line(entity, order)))
    inner = Window.partitionBy(*entity, CHUNK, "in__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = own.withColumn("run__", F.sum("hit__").over(inner))
    parts = own.groupBy(*entity, CHUNK, "in__").agg(F.sum("hit__").alias("hits"))
    whole = parts.groupBy(*entity, CHUNK).agg(F.max("in__").alias("resets"), F.max_by("hits", "in__").alias("tail"))
    ended = whole.withColumn("turn", F.sum((F.col("resets") > 0).cast("int")).over(Window.partitionBy(*entity).orderBy(CHUNK)))
    until = ended.withColumn("held", F.sum("tail").over(Window.partitionBy(*entity, "turn").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)))
    to = Window.partitionBy(*entity).orderBy(CHUNK)
    states = until.select(*entity, CHUNK, F.coalesce(F.sum("resets").over(before(entity)), F.lit(0)).alias("island__"), F.coalesce(F.lag("held").over(to), F.lit(0)).alias("carry__"))
    run = F.col("run__") + F.when(F.col("in__") == 0, F.col("carry__")).otherwise(0)
    return carried(counted, states, entity).withColumns({"island": F.col("island__") + F.col("in__"), "run": run}).select(*df.columns, "island", "run")
