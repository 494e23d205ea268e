"""Sessions for local runs, and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: bytes of rows that go to a Python worker at once: 10,000 texts are tens of megabytes, held by both sides.
BATCH = 8 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Where it is unset, a temporary folder serves a local session; a cluster has
    no folder that all executors see, so that is an error there.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridlens-"))
    return named or context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a compressed table in the shared folder, read back without its lineage.

    While it is written, Python workers get at most BATCH bytes of rows at once; the session's own setting is put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(BATCH))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, because what they led to is itself stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def among(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", most: int = 1_000_000) -> DataFrame:
    """Rows of `df` with (left_semi) or without (left_anti) a partner in `ids`, or with its columns (inner, left).

    The wide side stays where it is while `ids` has at most `most` rows: then it is
    broadcast. Beyond that both sides are shuffled, and a hot key is split by AQE.
    """
    few = ids.count() <= most
    return df.join(F.broadcast(ids) if few else ids, on, how)
