"""Risk-controlled quality rules, in DataFrame and SQL functions only.

Each document gets counts (words, symbols, repeated lines and passages). A rule
compares one rate with a cutoff. Cutoffs are not set by hand: for every stratum
and rule the labelled holdout is tried from the most lenient cutoff to the
strictest, and a cutoff is certified while the exact binomial test rejects
"more than `risk` of the good documents would be refused" at the level
alpha / (strata x rules). Trying stops at the first failure (fixed-sequence
testing), so with the Bonferroni division over strata and rules the family-wise
error stays below alpha, and each stratum refuses at most `risk` of its good
documents in all (`risk` is shared out among its rules).

Nulls and edge cases: a null or empty text has no words and fails the base
rules; a null stratum is a stratum of its own; a null label is not in the
holdout; repeated label rows count once (the lowest quality holds); a stratum
without enough labels has no cutoff, so only the base rules apply to it.
Columns of the input other than id, text and stratum are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.session import stored

WINDOW = 8
#: rule -> cutoffs from lenient to strict; a document is refused above the cutoff.
GRID = {
    "symbol_pct": [30.0, 20.0, 15.0, 10.0, 7.0, 5.0, 3.0, 2.0, 1.0, 0.5],
    "upper_pct": [95.0, 90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0],
    "dup_line_pct": [90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 20.0],
}
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _covered(starts: Column, width: int) -> Column:
    """Positions in the union of [s, s + width) over ascending starts."""
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
        F.lit(width)
        + F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(starts) - 1, F.lit(1))),
            F.lit(0),
            lambda acc, i: acc + F.when(i < F.size(starts), F.least(F.lit(width), F.get(starts, i) - F.get(starts, i - 1))).otherwise(0),
        )
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang") -> DataFrame:
    """Per document: id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines.

    One narrow pass, no shuffle. Repeats are found inside the row: windows are
    hashed, and only if some hash is double are they put in order to find which.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")).alias("stratum"),
        text.alias("t"),
        words(F.col(text_col)).alias("w"),
        F.split(text, "\n").alias("lines"),
    )
    lines = first.select(
        "doc_id",
        "stratum",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter("lines", lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    hashed = lines.select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("h"),
    ).drop("lines", "w")
    tied = hashed.withColumn(
        "sorted",
        F.when(
            F.size("h") > F.size(F.array_distinct("h")),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("h")
    starts = tied.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda x, k: (F.get(F.col("sorted"), k - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), k + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    return starts.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("starts"), WINDOW).cast("long").alias("n_repeat_words"), "n_upper", "n_lines"
    )


def _pct(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.lit(100.0) * F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def rates() -> dict[str, Column]:
    """The measured side of each rule, by name."""
    return {
        "symbol_pct": _pct("n_symbols", "word_chars"),
        "upper_pct": _pct("n_upper", "word_chars"),
        "dup_line_pct": _pct("n_dup_lines", "n_lines"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly from the largest term down.

    The log of the k-th term is a sum over 1..k, so it neither over- nor
    underflows; terms below it fall off by the ratio i(1-p) / ((n-i+1)p).
    For k >= n p the tail is over one half and 1 is returned (never certified).
    """
    log_q, log_odds = math.log1p(-p), math.log(p) - math.log1p(-p)
    top = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")),
        n * F.lit(log_q),
        lambda acc, i: acc + F.when(i > 0, F.log((n - i + 1) / F.greatest(i, F.lit(1))) + F.lit(log_odds)).otherwise(0.0),
    )
    terms = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j) / ((n - k + j + 1)) * F.lit(math.exp(-log_odds))).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * terms))


def cutoffs(measured: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", good: str = "quality", risk: float = 0.03, alpha: float = 0.05, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Certified cutoffs: stratum, one column `max_<rule>` per rule (null: no cutoff).

    The grid is fixed beforehand, so all labelled good documents can be holdout.
    """
    grid = GRID if grid is None else grid
    lab = labels.select(F.col(label_id).alias("doc_id"), F.col(good).alias("good")).filter(F.col("doc_id").isNotNull() & F.col("good").isNotNull()).groupBy("doc_id").agg(F.min("good").alias("good"))
    hold = measured.filter(F.col("doc_id").isNotNull() & ~base_failed()).join(lab.filter(F.col("good") == 1), "doc_id")
    value = rates()
    counts = hold.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.count_if(value[r] > F.lit(c)).alias(f"{r}__{j}") for r in grid for j, c in enumerate(grid[r])],
    )
    strata = counts.agg(F.count("*").alias("strata"))
    p = risk / len(grid)
    tested = counts.crossJoin(F.broadcast(strata))  # one row
    level = F.lit(alpha) / (F.col("strata") * F.lit(len(grid)))

    def certified(rule: str) -> Column:
        tries = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"{rule}__{j}").alias("k")) for j, c in enumerate(grid[rule])])
        state = F.aggregate(
            tries,
            F.struct(F.lit(True).alias("open"), F.lit(None).cast("double").alias("cut")),
            lambda acc, x: F.when(acc["open"] & (binomial_tail(x["k"], F.col("n"), p) <= level), F.struct(F.lit(True).alias("open"), x["cut"].alias("cut"))).otherwise(
                F.struct(F.lit(False).alias("open"), acc["cut"].alias("cut"))
            ),
        )
        return state["cut"]

    return tested.select("stratum", *[certified(r).alias(f"max_{r}") for r in grid])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang", risk: float = 0.03, alpha: float = 0.05) -> DataFrame:
    """Counts, `base_failed`, `kept` and the name of the first rule that refused, per document.

    The measures are written once to the shared folder: texts are read and
    split once, and calibration and verdict both read the narrow rows.
    """
    measured = stored(measures(docs, id_col, text_col, stratum), "quality")
    cuts = cutoffs(measured, labels, risk=risk, alpha=alpha)
    value = rates()
    refused = F.coalesce(*[F.when(value[r] > F.col(f"max_{r}"), F.lit(r)) for r in GRID])
    joined = measured.alias("m").join(cuts.withColumnRenamed("stratum", "s"), F.col("m.stratum").eqNullSafe(F.col("s")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & refused.isNull()).alias("kept"),
        F.when(base_failed(), F.lit("base")).otherwise(refused).alias("refused_by"),
    )
