"""Scalar functions on columns: tolerant numbers, timestamps, sizes, labels, dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
ENDLESS = r"^\s*([+-]?Infinity)"


def number(c: Column) -> Column:
    """The number a string begins with, or null: `12abc` is 12."""
    return F.when(F.regexp_extract(c, NUMBER, 1) != "", F.regexp_extract(c, NUMBER, 1).try_cast("double"))


def number_or_infinite(c: Column) -> Column:
    return F.coalesce(number(c), F.regexp_extract(c, ENDLESS, 1).try_cast("double"))


CIVIL = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d+))?)?)?\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?\s*$"


def timestamp_ms(c: Column, offset_minutes: int = 0) -> Column:
    """Epoch milliseconds of a civil or zoned time; fields over their range roll on.

    A time without zone is taken at `offset_minutes` east of UTC, a day alone with
    hyphens at UTC. Digits of a
    fraction beyond the third are cut. Anything else is null.
    """
    part = lambda k: F.regexp_extract(c, CIVIL, k)
    whole = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    days = F.datediff(F.add_months(F.make_date(whole(1), F.lit(1), F.lit(1)), whole(2) - 1), F.lit("1970-01-01").cast("date")) + whole(3) - 1
    seconds = days.cast("long") * 86400 + whole(4) * 3600 + whole(5) * 60 + whole(6)
    zone = part(8)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    day_alone = (part(4) == "") & c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$")
    shift = F.when(day_alone, F.lit(0)).when(zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))).when(zone != "", F.lit(0)).otherwise(F.lit(offset_minutes))
    millis = F.coalesce(F.rpad(F.substring(part(7), 1, 3), 3, "0").try_cast("int"), F.lit(0))
    return F.when(c.rlike(CIVIL), (seconds - shift * 60) * 1000 + millis)


def epoch_ms(n: Column) -> Column:
    """Epoch seconds below 1e12, else milliseconds."""
    return F.when(n < 1e12, n * 1000).otherwise(n).cast("long")


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / 1048576))


def signed32(n: Column) -> Column:
    """Sizes over 2 GiB that arrive as negative 32-bit numbers."""
    return F.when(n < 0, n + F.lit(4294967296)).otherwise(n)


#: fixed values: how a cell is named.
CELL, CELL_ALONE = r"(?i)cell\s*(\d+)", r"^\s*(\d+)\s*$"


def cell_label(c: Column) -> Column:
    """`8`, `cell8` and `pack cell 8` are `Cell 8`; null without a number above 0, or with one of more than 18 digits."""
    n = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (CELL, CELL_ALONE)]).try_cast("long")
    return F.when(n > 0, F.concat(F.lit("Cell "), n.cast("string")))


#: fixed values: how days are written.
DATES = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일"


def days_in(text: Column) -> Column:
    """Distinct valid civil days named in a text, as dates in order."""
    found = F.regexp_extract_all(text, F.lit(DATES), 0)
    parts = F.transform(found, lambda s: F.split(s, "[^0-9]+"))
    days = F.transform(parts, lambda p: F.try_make_date(p[0].cast("int"), p[1].cast("int"), p[2].cast("int")) if hasattr(F, "try_make_date") else F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")).try_cast("date"))
    return F.array_sort(F.array_distinct(F.array_compact(days)))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: fixed values: the named references that are decoded.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def html_references(c: Column) -> Column:
    """Named and numeric character references decoded in one pass; unknown ones stay."""
    names = F.create_map(*[F.lit(v) for kv in REFERENCES.items() for v in kv])

    def one(x: Column) -> Column:
        """What follows an ampersand, with the reference it begins with decoded."""
        name = F.regexp_extract(x, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z]{2,4});", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).try_cast("long")
        numeric = F.when((code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        told = F.coalesce(F.when(name != "", names[name]), numeric)
        return F.coalesce(F.concat(told, F.substring(x, F.length(name) + 2, F.length(x))), F.concat(F.lit("&"), x))

    pieces = F.split(c, "&")
    told = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))
    return F.when(F.contains(c, F.lit("&")), told).otherwise(c)


def html_text(c: Column) -> Column:
    """Visible text: scripts and styles go, tags become spaces, references are decoded; white space
    within a line becomes one space, empty lines go, single line breaks stay."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(html_references(t), r"[ \t\f\x0b]+", " "), r"\n\s*\n+", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


#: fixed values: what counts as personal data.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\b0\d{1,2}-?\d{3,4}-?\d{4}\b"
LABEL = r"(?:고객사|고객명|사이트명|담당자)\s*[:：]"
ADDRESS = r"[가-힣]+(?:특별시|광역시|자치시|도)\s?[가-힣]+(?:시|군|구)\s?[가-힣0-9]+(?:읍|면|동|로|길)"
#: fixed values: extensions of logs, and the words that speak for a log.
LOG_EXTENSIONS = ["csv", "txt", "log", "tsv", "dat"]
LOG_NAMES = "bms|ess|pcs|ems|cell|alarm|fault|log"
TIME_HEADERS = "time|timestamp|date"
SIGNAL_HEADERS = "volt|voltage|current|temp|soc|soh|alarm|fault|status"


def pii(text: Column, pattern: str, most: int = 3) -> Column:
    """The first different matches of a pattern; what is shown is bounded, the test is not."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def source_score(name: Column, header: Column) -> Column:
    """How likely a file is a telemetry log, from its name and first line (null or empty: no header)."""
    lower, head = F.lower(name), F.lower(F.coalesce(header, F.lit("")))
    return (
        F.when(lower.rlike(LOG_NAMES), 2).otherwise(0)
        + F.when(head.rlike(TIME_HEADERS), 3).otherwise(0)
        + F.when(head.rlike(SIGNAL_HEADERS), 2).otherwise(0)
        - F.when(F.element_at(F.split(lower, r"\."), -1).isin(LOG_EXTENSIONS), 0).otherwise(5)
    )


def day_start_ms(ms: Column, offset_minutes: int = 0) -> Column:
    """Start of the civil day that holds a time, `offset_minutes` east of UTC; the day ends 86,400,000 ms later."""
    shift, day = offset_minutes * 60_000, 86_400_000
    local = ms.cast("long") + shift
    return local - F.pmod(local, F.lit(day)) - shift


def day_label(ms: Column, offset_minutes: int = 0) -> Column:
    """The civil day that holds a time, as yyyy-MM-dd."""
    local = F.floor((ms.cast("long") + offset_minutes * 60_000) / 86_400_000).cast("int")
    return F.date_format(F.date_from_unix_date(local), "yyyy-MM-dd")


#: fixed values: texts that stand for none, and the least size of a case description.
PLACEHOLDERS = r"(?i)^(test|todo|placeholder|n\/a|na|xxx|tbd|lorem ipsum|foo|bar|example|sample|없음|미상)$"
LEAST_TEXT = 30


def substantive(c: Column, most: int) -> Column:
    """A text of 1 to `most` characters that is no placeholder; null is none."""
    return F.coalesce(F.length(c).between(1, most) & ~F.trim(c).rlike(PLACEHOLDERS), F.lit(False))


def reviewed(name: Column, severity: Column, reason: Column) -> Column:
    """A review is complete: name and reason are not blank, and a severity is set."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return said(name) & F.coalesce(severity != "", F.lit(False)) & said(reason)


def admitted(text: Column, confirmed: Column, has_time: Column) -> Column:
    """A case may go on: confirmed, long enough, with a time column and without personal data."""
    private = text.rlike("|".join(f"(?:{p})" for p in (EMAIL, PHONE, LABEL, ADDRESS)))
    return F.coalesce(confirmed & has_time & (F.length(F.trim(text)) >= LEAST_TEXT) & ~private, F.lit(False))
