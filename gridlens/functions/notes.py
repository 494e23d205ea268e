"""Figures and notes as people read them: percentages, ranges of days, differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def percent(share: Column, none: str = UNKNOWN) -> Column:
    """A share in percent with one decimal, halves up, without a last `.0`; null and infinite shares are `none`."""
    shown = F.regexp_replace(F.format_string("%.1f", F.floor(share * 1000 + 0.5) / 10), r"\.0$", "")
    return F.when(finite(share), F.concat(shown, F.lit("%"))).otherwise(none)


def day_range(low_ms: Column, high_ms: Column) -> Column:
    """First and last day (UTC), one day alone, or unknown where a bound is missing."""
    low, high = (F.date_format(F.timestamp_millis(c), "yyyy-MM-dd") for c in (low_ms, high_ms))
    return F.when(low.isNull() | high.isNull(), UNKNOWN).when(low == high, low).otherwise(F.concat_ws(" ~ ", low, high))


def coverage_note(source: Column, evidence: tuple[Column, Column], data: tuple[Column, Column]) -> Column:
    """What part of a source's data its alarms cover; null where they cover all of it. Without alarms, or in data of one instant, the share is unknown."""
    share = (evidence[1] - evidence[0]) / F.nullif(data[1] - data[0], F.lit(0))
    note = F.concat(source, F.lit(": alarms "), day_range(*evidence), F.lit(" of data "), day_range(*data), F.lit(" ("), percent(share), F.lit("). Call what lies outside unconfirmed."))
    return F.when(F.coalesce(share, F.lit(0.0)) < 1, note)
