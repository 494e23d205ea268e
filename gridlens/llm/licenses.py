"""License scans over a positional rare-token index, in DataFrame and SQL functions only.

Every template is a list of phrases with the words' places in the template; some
phrases are mandatory. Document frequencies of the templates' words are counted
over all documents; each phrase is then indexed under its rarest (highest-IDF)
word, with that word's place. A file's words are looked up in the index, the
words around a hit are compared with the phrase, and the hits of a template are
intersected by relative position: file position minus template position, in
overlapping bins that forgive a few inserted words. A template is found where
all its mandatory phrases meet in one bin; its score is the share of its indexed
phrases there, weighted by IDF.

Base phrases are templates of one phrase, so their places come from the same
index.

Nulls and edge cases: a null or empty text has no words, no labels and score 0;
repeated ids are separate rows (each row gets its own result); a file without
hits keeps its row. Columns of the input other than id and text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: fixed values: the phrases each base label stands for.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: fixed values: wording of public licences, as (place in the template, phrase, mandatory).
TEMPLATES = {
    "mit": [(0, "mit license", True), (-2, "released under", False), (10, "permission is hereby granted free of charge", False)],
    "mit-text": [(0, "permission is hereby granted free of charge", True), (15, "this software and associated documentation files", True), (25, "without restriction", False)],
    "apache-2.0": [(0, "apache license version 2 0", True), (-3, "licensed under the", False)],
    "gpl-3.0": [(0, "gnu general public license version 3", True), (-3, "licensed under the", False)],
    "gpl-2.0": [(0, "gnu general public license version 2", True), (-3, "licensed under the", False)],
    "lgpl": [(0, "gnu lesser general public license", True)],
    "agpl": [(0, "gnu affero general public license", True)],
    "cc-by-4.0": [(0, "cc by 4 0", True)],
    "cc-by-sa-4.0": [(0, "cc by sa 4 0", True)],
    "cc-by-nc-4.0": [(0, "cc by nc 4 0", True), (-2, "licensed under", False)],
    "bsd": [(0, "redistribution and use in source and binary forms", True), (8, "with or without modification", False), (13, "are permitted provided", False)],
    "mpl-2.0": [(0, "mozilla public license", True), (3, "v 2 0", False), (3, "version 2 0", False)],
    "isc": [(0, "permission to use copy modify and or distribute this software", True), (11, "for any purpose with or without fee is hereby granted", False)],
    "unlicense": [(0, "this is free and unencumbered software released into the public domain", True)],
}
BIN = 16


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and other characters, with A-Z lower-cased.

    The Kelvin sign is swapped for another letter first: lower() would make it a k.
    """
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def phrases() -> list[tuple[str, int, tuple[str, ...], bool]]:
    """(label, place, words, mandatory) of every base phrase and template phrase; base labels begin with `base:`."""
    found = [(f"base:{label}", 0, tuple(text.split()), True) for label, text in BASE.items()]
    return found + [(label, place, tuple(text.split()), must) for label, parts in TEMPLATES.items() for place, text, must in parts]


def vocabulary() -> list[str]:
    return sorted({w for _, _, ws, _ in phrases() for w in ws})


def frequencies(docs: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """Documents that hold each template word, and documents in all: at most one number per template word."""
    held = docs.select(F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, vocabulary()))).alias("w"))
    row = held.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("w", w)).alias(f"w{k}") for k, w in enumerate(vocabulary())]).first()
    return {w: row[f"w{k}"] for k, w in enumerate(vocabulary())}, row["n"]


def index(df: dict[str, int], n: int) -> list[dict]:
    """The postings: each phrase under its rarest word. Bounded by the templates, not by the documents."""
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary()}
    found = []
    for k, (label, place, ws, must) in enumerate(phrases()):
        key = max(range(len(ws)), key=lambda i: (idf[ws[i]], -i))
        found.append({"id": k, "label": label, "place": place, "words": ws, "must": must, "key": key, "weight": max(idf[ws[key]], 1e-9)})
    return found


def _places(postings: list[dict]) -> Column:
    """All places of all phrases in the words `w`: array of (label, phrase, at)."""
    by_word: dict[str, list[dict]] = {}
    for p in postings:
        by_word.setdefault(p["words"][p["key"]], []).append(p)

    def around(i: Column, p: dict) -> Column:
        start = i - F.lit(p["key"])
        same = reduce(lambda a, b: a & b, [F.get(F.col("w"), start + j) == F.lit(x) for j, x in enumerate(p["words"]) if j != p["key"]], start >= 0)
        return F.when(F.coalesce(same, F.lit(False)), F.struct(F.lit(p["label"]).alias("label"), F.lit(p["id"]).alias("phrase"), start.cast("int").alias("at")))

    def look_up(i: Column) -> Column:
        word = F.get(F.col("w"), i)
        none = F.lit(None).cast("array<struct<label:string,phrase:int,at:int>>")
        return reduce(lambda rest, kv: F.when(word == kv[0], F.array(*[around(i, p) for p in kv[1]])).otherwise(rest), by_word.items(), none)

    keys = F.array(*map(F.lit, by_word))
    at = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(keys, x), i)), lambda i: i.isNotNull())
    return F.filter(F.flatten(F.transform(at, look_up)), lambda x: x.isNotNull())


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Two narrow passes over the texts: one counts document frequencies, one looks
    words up. Nothing is shuffled but the counts (one row per task).
    """
    df, n = frequencies(docs, text_col)
    postings = index(df, n)
    none = F.array().cast("array<struct<label:string,phrase:int,at:int>>")
    keys = F.array(*[F.lit(p["words"][p["key"]]) for p in postings])
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    hits = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", keys), _places(postings)).otherwise(none).alias("hits"))
    base = hits.withColumn("base", F.filter("hits", lambda x: x["label"].startswith("base:"))).withColumn("found", F.array_compact(F.array(*_templates(postings))))
    starts = F.transform("base", lambda x: x["at"].cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    own = F.transform("base", lambda x: F.substring(x["label"], 6, 1000))
    return base.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(own).alias("base_labels"),
        labels(F.concat(own, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.when(F.size("base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
        F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["at"].alias("word"), x["score"].alias("score"))).alias("spans"),
    )


def _templates(postings: list[dict]) -> list[Column]:
    """For every template the best bin in which all its mandatory phrases stand, or null.

    A hit votes for the two half-shifted bins of its relative position. Bins are
    the distinct votes of one mandatory phrase, so the work follows its places.
    """

    def best_of(label: str) -> Column:
        own = [p for p in postings if p["label"] == label]
        total = sum(p["weight"] for p in own)
        first = next(p for p in own if p["must"])

        def origins(p: dict) -> Column:
            return F.transform(F.filter("hits", lambda x: x["phrase"] == p["id"]), lambda x: x["at"] - F.lit(p["place"]))

        def votes(p: dict) -> Column:
            return F.array_distinct(F.flatten(F.transform(origins(p), lambda o: F.array(F.floor(o / BIN) * 2, F.floor((o + BIN // 2) / BIN) * 2 + 1))))

        agreed = reduce(F.array_intersect, [votes(p) for p in own if p["must"]])
        others = [p for p in own if not p["must"]]
        sure = sum(p["weight"] for p in own if p["must"])
        score = lambda b: F.lit(sure / total) + sum((F.when(F.array_contains(votes(p), b), p["weight"] / total).otherwise(0.0) for p in others), F.lit(0.0))
        best = F.array_max(F.transform(agreed, lambda b: F.struct(F.least(F.lit(1.0), score(b)).alias("score"), (-b).alias("bin"))))
        entry = F.struct(F.lit(label).alias("label"), F.array_min(origins(first)).alias("at"), best["score"].alias("score"))
        return F.when(F.exists("hits", lambda x: x["phrase"] == F.lit(first["id"])) & (F.size(agreed) > 0), entry)

    return [best_of(label) for label in TEMPLATES]
