"""How the long maps over documents are laid out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def computed(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed at this point.

    The optimizer writes the expression of a column into each filter, join key and generator above that
    mentions it. For columns made of dozens of patterns, each built on the one before, that repeats the
    work and lets the plan grow without bound. A generator of exactly one row per row ends that: nothing
    is shuffled or stored, and whole-stage code runs through it."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all cores before costly work. Larger
    scans stay as they are, so at scale this adds no shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def left_join_dealt(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of `rows` and `table` (one row per key) on `key`, a column of both that many rows may lack.

    Rows without it get a key from their other values and are dealt out in a shuffle instead of meeting in one task."""
    others = [f"`{c}`" for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    own = F.concat(F.lit("no key "), F.xxhash64(*others).cast("string"))
    # The marker keeps a key of the table apart from one made here.
    made = F.when(F.col(key).isNull(), own).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    keyed = table.filter(F.col(key).isNotNull()).withColumn("_key", F.concat(F.lit("="), F.col(key).cast("string"))).drop(key)
    return rows.withColumn("_key", made).join(keyed, "_key", "left").drop("_key")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the session's `spark.checkpoint.dir`, the folder all executors share. What is kept
    there must outlive the loss of any executor, so a session without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: for results of long maps that
    several joins read. Readers take only the columns they need, and a lost executor costs its own tasks
    only. The table may be deleted when the job is done."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
