"""The bounded evidence text: lines in order, budgets spent in order, and a cut whose note counts into the cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import segments

# Sources of a pack, groups of a source, alarm contexts of the whole, and characters.
SOURCES, GROUPS, CONTEXTS, CHARS = 10, 10, 60, 300_000
GAP = 2  # the line feeds between note and text
NOTE, CUT = "[Note: left out for size: {}. Call what is left out unconfirmed.]", "{} characters cut"


def top_groups(groups: DataFrame, source: str, alarms: str, rows: str, name: str, most: int = GROUPS) -> DataFrame:
    """The first groups of a source by alarms, then rows, then name, with their place."""
    w = Window.partitionBy(source).orderBy(F.desc(alarms), F.desc(rows), name)
    return groups.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def spent(rows: DataFrame, order: list[str], want: Column, total: int = CONTEXTS, chunk: Column | None = None) -> DataFrame:
    """Adds `used`: of a budget for all rows together, what each gets in order; the last one may get a part."""
    upto = segments.running(rows, [], order, F.lit(0) if chunk is None else chunk, upto__=want.cast("long"))
    return upto.withColumn("used", F.greatest(F.lit(0), F.least(want.cast("long"), F.lit(total) - (F.col("upto__") - want)))).drop("upto__")


def average(total: Column, n: Column) -> Column:
    """An average with two decimals, a dash without values."""
    return F.when(n > 0, F.format_string("%.2f", total / n)).otherwise("—")


def percent(share: Column) -> Column:
    """A share with one decimal, a dash where there is none."""
    return F.when(share.isNotNull(), F.concat(F.format_string("%.1f", F.round(share * 100, 1)), F.lit("%"))).otherwise("—")


def moment(ms: Column) -> Column:
    """A time as ISO in UTC, a dash where there is none."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("—"))


def span(lo: Column, hi: Column) -> Column:
    return F.concat(moment(lo), F.lit(" ~ "), moment(hi))


def told(parts: dict[str, Column]) -> Column:
    """A note of what is left out, of the parts ({} is the number) above 0; null where nothing is."""
    said = F.array_compact(F.array(*[F.when(n > 0, F.concat(F.lit(text.split("{}")[0]), F.format_number(n, 0), F.lit(text.split("{}")[1]))) for text, n in parts.items()]))
    return F.when(F.size(said) > 0, F.array_join(said, ", "))


def room(whole: Column, cap: Column, parts: Column, note: str, cut: str) -> Column:
    """How many of `whole` characters fit `cap` beside their note; with `parts` null and all of them fitting there is no note.

    The note names the characters cut, whose digits count too: if their number takes k characters, cap less
    the note with k leaves room for the text, and so a number; the least k that this number takes is the one. Some k
    always is, since each further character raises the number by one.
    """
    bare = F.coalesce(F.length(parts) + (len(note) - 2) + GAP, F.lit(0))
    fixed = (len(note) - 2) + F.coalesce(F.length(parts) + 2, F.lit(0)) + (len(cut) - 2) + GAP
    limit = lambda k: F.least(whole, F.greatest(F.lit(0), cap - fixed - k)).cast("long")
    right = F.filter(F.sequence(F.lit(1), F.lit(26)), lambda k: F.length(F.format_number(whole - limit(k), 0)) == k)
    return F.when(whole + bare <= cap, whole).otherwise(F.coalesce(limit(F.get(right, F.lit(0))), F.lit(0)))


def bounded_text(lines: DataFrame, order: list[str], value: str, cap: Column, left_out: DataFrame, note: str = NOTE, cut: str = CUT, chunk: Column | None = None) -> DataFrame:
    """text, whole (its length before the cut) and cut_chars, in one row, for the lines joined by line feeds.

    `left_out` has one row with a column `parts`, the note of earlier omissions or null. With a note, the text is the note, two
    line feeds and the lines as far as they fit `cap` (see `room`). No line that begins beyond the cut reaches the row.
    """
    sized = lines.withColumn("n__", F.length(value).cast("long"))
    placed = segments.running(sized, [], order, F.lit(0) if chunk is None else chunk, end__=F.col("n__") + 1)
    whole = sized.agg(F.coalesce(F.greatest(F.sum("n__") + F.count("*") - 1, F.lit(0)), F.lit(0)).alias("whole"))
    one = whole.crossJoin(F.broadcast(left_out.select("parts")))
    cut_at = one.withColumn("limit", room(F.col("whole"), cap, F.col("parts"), note, cut)).withColumn("cut_chars", F.col("whole") - F.col("limit"))
    said = F.array_compact(F.array("parts", F.when(F.col("cut_chars") > 0, F.concat(F.format_number("cut_chars", 0), F.lit(cut[2:])))))
    head, tail = (F.lit(x) for x in note.split("{}"))
    noted = cut_at.withColumn("note", F.when(F.size(said) > 0, F.concat(head, F.array_join(said, ", "), tail, F.lit("\n" * GAP))).otherwise(""))
    begun = placed.crossJoin(F.broadcast(noted.select("limit"))).filter(F.col("end__") - F.col("n__") - 1 <= F.col("limit"))
    kept = begun.agg(F.array_sort(F.collect_list(F.struct(F.col("end__").alias("at"), F.col(value).alias("v")))).alias("all"))
    body = F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<at:bigint,v:string>>")), lambda x: x["v"]), "\n")
    out = noted.crossJoin(F.broadcast(kept.select(body.alias("body"))))
    text = F.concat("note", F.substring("body", F.lit(1), F.col("limit").cast("int")))
    return out.select(F.substring(text, F.lit(1), cap.cast("int")).alias("text"), "whole", "cut_chars")
