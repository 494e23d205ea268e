"""Contracts of nested JSON, and the rules that ask more than shape.

A contract is a tree of rules; it becomes one expression over a VARIANT, which
names every violation by its path. A rule names its value several times, so values are bound (`bound`)
and taken from the text once a row, however deep the tree is; the keys of an object are read as those of a map. Objects are strict: a key that the contract does not
name is a violation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalars import PLACEHOLDERS

Rule = Callable[[Column, Column], Column]  # (value, path) to the names of violations


def bound(value: Column, body: Callable[[Column], Column], like: Column | None = None) -> Column:
    """`body` of a value that is computed once, though the body names it many times; it is of the type of `like`, names if untold.

    A fold over one value: the item of a transformed list would ask for the types of the whole tree at each row.
    """
    return F.aggregate(F.array(value), none() if like is None else like, lambda _, v: body(v))


def none() -> Column:
    return F.array().cast("array<string>")


#: fixed values: what the schema of a VARIANT begins with; anything else is a number.
KINDS = {"OBJECT": "object", "ARRAY": "list", "STRING": "text", "BOOLEAN": "flag", "VOID": "null"}


def kind(v: Column) -> Column:
    """object, list, text, number, flag or null. The schema of an object or list is that of all below it, so rules for these read the value instead."""
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(v.isNull(), "missing").otherwise(F.coalesce(F.try_element_at(names, F.substring_index(F.schema_of_variant(v), "<", 1)), F.lit("number")))


def broken(path: Column, said: str, if_: Column) -> Column:
    """The violation where a rule does not hold; null counts as broken."""
    return F.when(F.coalesce(if_, F.lit(True)), F.array(F.concat(path, F.lit(f" {said}")))).otherwise(none())


def only(wanted: str, is_: Column, path: Column, more: Column) -> Column:
    """Another kind is one violation; else what the further rules say."""
    return F.when(is_, more).otherwise(F.array(F.concat(path, F.lit(f" is no {wanted}"))))


def text(least: int = 0, most: int = 1_000_000, substantive: bool = False, one_of: list[str] | None = None) -> Rule:
    def more(s: Column, path: Column) -> Column:
        found = [broken(path, f"is shorter than {least}", F.length(s) < least)] if least else []
        found.append(broken(path, f"is longer than {most}", F.length(s) > most))
        if substantive:
            found.append(broken(path, "is a placeholder", F.trim(s).rlike(PLACEHOLDERS)))
        if one_of is not None:
            found.append(broken(path, "is none of its values", ~s.isin(one_of)))
        return F.flatten(F.array(*found))

    return lambda v, path: only("text", kind(v) == "text", path, bound(v.cast("string"), lambda s: more(s, path)))


def number(least: float | None = None, whole: bool = False) -> Rule:
    def more(n: Column, path: Column) -> Column:
        found = [none()] + ([broken(path, f"is below {least}", n < least)] if least is not None else []) + ([broken(path, "is not whole", n != F.floor(n))] if whole else [])
        return F.flatten(F.array(*found))

    return lambda v, path: only("number", kind(v) == "number", path, bound(F.try_variant_get(v, "$", "double"), lambda n: more(n, path)))


def flag() -> Rule:
    return lambda v, path: only("flag", kind(v) == "flag", path, none())


def nullable(inner: Rule) -> Rule:
    return lambda v, path: F.when(F.is_variant_null(v), none()).otherwise(inner(v, path))


def listed(item: Rule, least: int = 0, most: int = 1_000_000) -> Rule:
    def more(items: Column, path: Column) -> Column:
        size = [broken(path, f"has fewer than {least}", F.size(items) < least)] if least else []
        size.append(broken(path, f"has more than {most}", F.size(items) > most))
        each = F.flatten(F.transform(items, lambda x, i: item(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.flatten(F.array(*size, each))

    return lambda v, path: bound(F.try_variant_get(v, "$", "array<variant>"), lambda items: only("list", items.isNotNull(), path, more(items, path)))


def placed(inner: Rule, path: Column) -> Callable[[Column], Column]:
    return lambda v: inner(v, path)


def shape(required: dict[str, Rule], optional: dict[str, Rule] | None = None) -> Rule:
    optional_ = optional or {}

    def more(v: Column, keys: Column, path: Column) -> Column:
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in [*required, *optional_]])), lambda k: F.concat(path, F.lit("."), k, F.lit(" is unknown")))
        found = [unknown]
        for key, inner in [*required.items(), *optional_.items()]:
            own, at = F.try_variant_get(v, f"$['{key}']", "variant"), F.concat(path, F.lit(f".{key}"))
            missing = F.array(F.concat(at, F.lit(" is missing"))) if key in required else none()
            inside = placed(inner, at)
            found.append(bound(own, lambda x, inside=inside, missing=missing: F.when(x.isNull(), missing).otherwise(inside(x))))
        return F.flatten(F.array(*found))

    return lambda v, path: bound(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda keys: only("object", keys.isNotNull(), path, more(v, keys, path)))


def violations(json: Column, contract: Rule) -> Column:
    """Names of all violations, in order; a text that is no JSON has one. Null is no JSON."""
    said = lambda v: F.when(v.isNull(), F.array(F.lit("$ is no JSON"))).otherwise(F.array_sort(contract(v, F.lit("$"))))
    return bound(F.try_parse_json(json), said)


def truncated(json: Column, key: str, most: int) -> tuple[Column, Column]:
    """(the list below `key` cut to `most`, the number dropped) of a JSON object; null and 0 without a list."""
    items = F.try_variant_get(F.try_parse_json(json), f"$['{key}']", "array<variant>")
    return F.slice(items, 1, most), F.greatest(F.lit(0), F.coalesce(F.size(items), F.lit(0)) - most)


# Claims of a physical cause that a cell log cannot bear, and the limits that a claim must name.
CAUSES = [r"(?i)(?:전기화학적\s*열화|electrochemical\s*degradation)\s*(?:가|은|이)?\s*(?:확정(?:된)?\s*(?:원인)?|원인(?:이다|으로\s*판단))", r"(?i)(?:커넥터|connector|부식|corrosion)[^.!?\n]{0,20}(?:가|은|이)?\s*(?:확정(?:된)?\s*(?:원인)?|원인(?:이다|으로\s*판단))"]
LIMITED = [r"(?i)(?:유효\s*직렬\s*저항|effective\s+series\s+resistance)", r"(?i)(?:확정할\s*수\s*없|입증.*불가|판단.*불가|미확정|cannot|not\s+establish)"]


def overclaims(said: list[Column], limit: Column) -> Column:
    """A hypothesis on a cell log names a physical cause as certain, or does not limit its claim."""
    whole = F.concat_ws(" ", *said)
    certain = F.coalesce(whole.rlike(CAUSES[0]) | whole.rlike(CAUSES[1]), F.lit(False))
    return certain | ~F.coalesce(limit.rlike(LIMITED[0]) & limit.rlike(LIMITED[1]), F.lit(False))


def uncited(cases: DataFrame, available: DataFrame, citations: DataFrame, case: str, figure: str) -> DataFrame:
    """Cases with available figures none of which they cite."""
    hit = available.join(citations.select(case, figure), [case, figure], "left_semi").select(case)
    return cases.join(available.select(case), case, "left_semi").join(hit, case, "left_anti")


def uncontained(findings: DataFrame, texts: DataFrame, finding: str, text: str, prefix: int = 40, gram: int = 8) -> DataFrame:
    """Findings whose first `prefix` characters, trimmed, stand in no text. Blank findings are in every one.

    Each finding is anchored at the one of its `gram`-character strings that the fewest texts have; only texts with
    that string are searched, and no pair is made for the others. Findings shorter than that are anchored by strings of their own length.
    Strings stand for many times the size of their table, so no join of them is broadcast; a text goes with its strings as a hash,
    and itself only meets the findings whose anchor it has.
    """
    own = findings.select("*", F.substring(F.trim(finding), 1, prefix).alias("p__")).withColumn("id__", F.xxhash64("p__"))
    asked = own.filter("p__ <> ''").select("id__", "p__").distinct().withColumn("w__", F.least(F.length("p__"), F.lit(gram)))
    grams = lambda c, w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - w + 1, F.lit(1))), lambda i: F.substring(c, i, w)))
    wanted = asked.select("id__", "p__", "w__", F.explode(grams(F.col("p__"), F.col("w__"))).alias("g__"))
    widths = [r[0] for r in asked.select("w__").distinct().collect()]  # at most `gram` of them
    if not widths:
        return own.filter("p__ <> '' and p__ is not null").select(findings.columns)
    numbered = texts.filter(F.col(text).isNotNull()).select(F.col(text).alias("t__")).distinct().withColumn("h__", F.xxhash64("t__"))
    named = wanted.select("g__").distinct()
    met = None
    for w in sorted(widths):
        part = numbered.filter(F.length("t__") >= w).select("h__", F.explode(grams(F.col("t__"), F.lit(w))).alias("g__")).join(named.filter(F.length("g__") == w).hint("merge"), "g__", "left_semi")
        met = part if met is None else met.unionByName(part)
    counts = met.groupBy("g__").agg(F.count("*").alias("n__"))
    rarest = wanted.join(counts.hint("merge"), "g__", "left").groupBy("id__", "p__").agg(F.min_by("g__", F.struct(F.coalesce("n__", F.lit(0)), "g__")).alias("g__"))
    asking = met.join(rarest.hint("merge"), "g__").select("h__", "id__", "p__")
    held = asking.join(numbered.hint("merge"), "h__").filter(F.contains("t__", F.col("p__"))).select("id__", "p__").distinct()
    return own.filter("p__ <> ''").join(held.hint("merge"), ["id__", "p__"], "left_anti").select(findings.columns)
