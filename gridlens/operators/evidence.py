"""Evidence relations: ledger, citations, votes, conflicts, snapshots, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ledger(parts: list[DataFrame], order: list[str], cap: int = 80) -> DataFrame:
    """The union of evidence in order, numbered E001 and so on; a report's worth of rows."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(*order).limit(cap)
    return rows.withColumn("evidence_id", F.format_string("E%03d", F.row_number().over(Window.orderBy(*order))))


def cited(rows: DataFrame, citations: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(citations, on, "left_semi")


def uncited(rows: DataFrame, citations: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(citations, on, "left_anti")


def votes(df: DataFrame, cell: str) -> DataFrame:
    """Votes, share and place of each cell; equal votes share a place. There are as many rows as cells."""
    n = df.groupBy(cell).agg(F.count("*").alias("votes"))
    total = n.agg(F.sum("votes").alias("all__"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("votes") / F.col("all__")).withColumn("place", F.rank().over(Window.orderBy(F.desc("votes")))).drop("all__")


def conflict(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two sides (cell, score) name the same cell: agree, conflict or one-sided."""
    top = lambda d, name: d.agg(F.max_by("cell", F.struct("score", -F.col("cell"))).alias(name))
    both = top(first, "first_cell").crossJoin(top(second, "second_cell"))
    state = F.when(F.col("first_cell").isNull() | F.col("second_cell").isNull(), "one-sided").when(F.col("first_cell") == F.col("second_cell"), "agree").otherwise("conflict")
    return both.withColumn("state", state)


def upsert(history: DataFrame, snapshot: DataFrame, key: str = "case_id") -> DataFrame:
    """History with the snapshot in place of rows of the same case."""
    return snapshot.unionByName(history.join(snapshot.select(key), key, "left_anti"), allowMissingColumns=True)


def snapshots(cases: DataFrame, keys: list[str], heavy: list[str]) -> DataFrame:
    """The key columns of cases and `body`, the others as JSON without the heavy ones."""
    body = [c for c in cases.columns if c not in keys and c not in heavy]
    return cases.select(*keys, F.to_json(F.struct(*body)).alias("body"))


def reloaded(history: DataFrame, case_id, schema: str, key: str = "case_id") -> DataFrame:
    """A case of the history, its body typed again."""
    return history.filter(F.col(key) == F.lit(case_id)).withColumn("body", F.from_json("body", schema)).select("*", "body.*").drop("body")


def profiles(df: DataFrame, source: str, t_ms: str, alarm: Column, format_id: str = "generic", entity_column: str | None = None, dropped: Column | None = None) -> DataFrame:
    """What is told of each source: format, entity column, rows, alarms, range of data and of evidence, coverage, events dropped."""
    from gridlens.operators.stats import time_coverage

    hit = F.coalesce(alarm, F.lit(False))
    n = df.groupBy(source).agg(F.count("*").alias("row_count"), F.count_if(hit).alias("derived_alarm_count"), (F.lit(0) if dropped is None else F.sum(dropped)).cast("long").alias("dropped_events"))
    c = time_coverage(df, [source], t_ms, hit).select(source, "data_lo", "data_hi", F.col("kept_lo").alias("evidence_lo"), F.col("kept_hi").alias("evidence_hi"), "coverage")
    return n.join(c, source).select(source, F.lit(format_id).alias("format_id"), F.lit(entity_column).alias("entity_column"), "row_count", "derived_alarm_count", "data_lo", "data_hi", "evidence_lo", "evidence_hi", "coverage", "dropped_events")


def budget(df: DataFrame, by: list[str], order: list[str], size: Column, per_row: int, total: int) -> DataFrame:
    """Adds `take`: characters of each row within a budget per row and for the group, spent in order."""
    want = df.withColumn("want", F.least(size, F.lit(per_row)))
    before = F.coalesce(F.sum("want").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return want.withColumn("take", F.greatest(F.lit(0), F.least(F.col("want"), F.lit(total) - before))).withColumn("cut", F.col("take") < size)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def taken(sources: DataFrame, group: str, order: str, least: int = 3) -> DataFrame:
    """The ready sources of each group that go on, with the reason `why`: those selected; if there are none,
    those of score `least` or more; if there are none either, the first by `order`. Columns ready, selected
    and score; nulls count as false. Three sums of a group are joined back, so a large group is many tasks."""
    ready, selected, good = (F.coalesce(c, F.lit(False)) for c in (F.col("ready"), F.col("selected"), F.col("score") >= least))
    sums = sources.filter(ready).groupBy(group).agg(F.max(selected).alias("any_selected"), F.max(good).alias("any_good"), F.min(order).alias("head"))
    why = F.when(F.col("any_selected"), "chosen").when(F.col("any_good"), "score").otherwise("first")
    stays = F.when(F.col("any_selected"), selected).when(F.col("any_good"), good).otherwise(F.col(order) == F.col("head"))
    return sources.filter(ready).join(sums, group).filter(stays).withColumn("why", why).drop("any_selected", "any_good", "head")
