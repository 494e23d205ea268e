"""The corpus pipeline: five stages, each a dealt operator over all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
`documents`; the last returns packed pieces. Rows with a null id pass the stages
that decide by id; null and empty texts are never rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import decontam, jaccard, packing, queries, substrings, toxicity
from gridlens.session import among, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go."""
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.sample(docs.select("doc_id", "text"), labels))
    return toxicity.score(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    others = jaccard.join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return among(docs.select(*COLUMNS), stored(others, "others"), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one are cut out of the text."""
    found = stored(substrings.passages(docs), "passages")
    return substrings.cut(docs.select(*COLUMNS), found).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontam.contaminated(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id").filter("doc_id is not null").distinct()
    return among(docs.select(*COLUMNS), stored(leaks, "leaks"), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 4096 tokens."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

#: the stages are no SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
