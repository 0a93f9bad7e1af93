"""Where intermediate tables go, and how large a corpus is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Only a local session that names none (as in
    tests) gets a folder of its own below the warehouse; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/llm-shared"
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: cuts the lineage, so a lost executor
    costs its own tasks only."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """How many key buckets a corpus of `size` bytes is dealt into, so that one bucket's keys fit a task."""
    return max(partitions(spark), -(-size // each))
