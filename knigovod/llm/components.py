"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knigovod.llm.shared import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands the smallest node it knows to its larger (or not larger) neighbours."""
    if large:
        seen = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = seen.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that edges (a, b) lead to. Nodes without edges do not appear.
    Nulls and loops are dropped; repeated edges count once. Each round is written to the shared folder."""
    edges = staged(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges")
    before = None
    while True:
        edges = staged(_stars(_stars(edges, True), False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(roots)
