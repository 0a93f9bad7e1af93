"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, how often it is taken, as near to 1 as the constraints allow (least relative entropy per
token) such that every source's tokens meet its target. The dual is convex with a multiplier per source; its solution
tilts exponentially: rate = exp(multiplier). Newton's steps are taken on all sources at once, gradient and curvature
being sums over the documents, which are pre-aggregated to cells of equal source and size.

Rates are then rounded to copies. Within a source, cells go from the largest size down, and what rounding one cell
leaves over is carried to the next, so a source ends within about one small document of its target.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knigovod.llm.shared import partitions, staged

WEIGHTS = (5, 2, 1)
#: No document is taken more often, and no target is more than so many times its source's size.
MOST = 3
#: Documents of one cell that are ranked together; larger cells are split by ranges of the hash.
RANKED = 10_000
#: Rows of one document that repeats that are written together.
REPEATED = 10_000


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _kind(doc_id: str, text: str, source: str) -> list[Column]:
    """doc_id, source, size (the number of words: runs without space and 0x09-0x0D), and h, which tells texts apart: rows
    that agree in all four are alike."""
    return [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), _size(text).alias("size"),
            F.xxhash64(doc_id, F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h")]


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size, h, m: kinds of documents, and how many rows are of each."""
    return docs.select(*_kind(doc_id, text, source)).groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("m"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> the same with `target`: shares of the whole by weight, in order of the source (null
    last); targets stop at `most` times the source, and the excess goes to the others by weight until none is above."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight).drop("rank"), "sources")
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # `level` is the target per weight of the sources that are not stopped; it only rises.
        stopped = F.col("weight") * F.lit(level) > most * F.col("source_size")
        fixed, free = ranked.agg(
            F.sum(F.when(stopped, most * F.col("source_size")).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))).first()
        following = (whole - (fixed or 0)) / free if free else math.inf
        if following <= level or not free:
            break
        level = following
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def multipliers(cells: DataFrame, sources: DataFrame, tolerance: float = 1e-12, steps: int = 100) -> DataFrame:
    """(source, rate): the solution of the dual. Each step sums the tilted tokens of all cells by source; sources
    without tokens or without a target have rate 0."""
    duals = sources.withColumn("multiplier", F.lit(0.0))
    for _ in range(steps):
        tilted = cells.alias("c").join(duals.alias("d"), F.expr("c.source <=> d.source")).groupBy("d.source").agg(
            F.sum(F.col("c.size") * F.col("c.n") * F.exp("d.multiplier")).alias("tokens"))
        # Gradient: target - tokens; curvature: tokens.
        moved = duals.alias("d").join(tilted.alias("t"), F.expr("d.source <=> t.source")).select(
            "d.source", "d.source_size", "d.target",
            F.when((F.col("tokens") > 0) & (F.col("target") > 0), F.col("multiplier") + F.col("target") / F.col("tokens") - 1).otherwise(
                F.col("multiplier")).alias("multiplier"),
            F.when((F.col("tokens") > 0) & (F.col("target") > 0), F.abs(F.col("target") - F.col("tokens")) / F.col("target")).otherwise(0.0).alias("off"))
        moved = staged(moved, "duals")
        duals = moved.drop("off")
        if (moved.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    rate = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.round(F.exp("multiplier"), 9)).otherwise(0.0)
    return duals.select("source", "source_size", "target", rate.alias("rate"))


def rounded(cells: list[tuple[int, int]], rate: float, most: int) -> list[int]:
    """Copies for cells of (size, documents) in falling order of size."""
    carry, out = 0.0, []
    for size, n in cells:
        wanted = rate * n * size + carry
        copies = min(max(math.floor(wanted / size + 0.5), 0), most * n) if size else 0
        carry = wanted - copies * size
        out.append(copies)
    return out


def planned(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], most: int, ranked: int) -> DataFrame:
    """doc_id, source, size, h, m, source_size, target, rate, base, extra: each of the m rows of a kind is taken `base`
    times, and `extra` of them once more.

    Extra copies go to the rows of a cell in order of their hash. Cells of more than `ranked` rows are cut into ranges of
    the hash; what comes before a range is the sum of the real counts of those before it, so the plan is the same however
    cells are cut."""
    sizes = staged(sized(docs, doc_id, text, source), "sizes")
    cells = staged(sizes.groupBy("source", "size").agg(F.sum("m").alias("n")), "cells")
    sources = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    rates = multipliers(cells, sources)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending")])
        pairs = list(zip(table.column("size").to_pylist(), table.column("n").to_pylist()))
        copies = rounded(pairs, table.column("rate")[0].as_py(), most)
        return table.append_column("whole", pa.array(copies, pa.int64()))

    joined = cells.alias("c").join(rates.alias("r"), F.expr("c.source <=> r.source")).select(
        "c.source", "size", "n", "source_size", "target", "rate")
    plan = joined.groupBy("source").applyInArrow(
        run, "source string, size bigint, n bigint, source_size bigint, target double, rate double, whole bigint")
    plan = staged(plan, "copies")
    met = sizes.alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source AND s.size = p.size")).select(
        "s.*", "p.n", "p.source_size", "p.target", "p.rate", "p.whole")
    # The upper 31 bits of the hash, cut into as many equal ranges as the cell has parts.
    top = F.shiftrightunsigned("h", 33)
    parts = F.ceil(F.col("n") / ranked)
    met = met.withColumns({"top": top, "part": F.floor(top * parts / F.lit(1 << 31)).cast("int")})
    counts = met.groupBy("source", "size", "part").agg(F.sum("m").alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("held")
    before = staged(counts.withColumn("before", earlier).drop("held"), "parts")
    met = met.alias("s").join(before.alias("b"), F.expr("s.source <=> b.source AND s.size = b.size AND s.part = b.part")).select("s.*", "b.before")
    rows = Window.partitionBy("source", "size", "part").orderBy("top", "h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.col("before") + F.sum("m").over(rows) - F.col("m")
    extra = F.least(F.greatest(F.col("whole") % F.col("n") - place, F.lit(0)), F.col("m"))
    worded = F.col("size") > 0
    return met.select(
        "doc_id", "source", "size", "h", "m", "source_size", "target", "rate",
        F.when(worded, F.floor(F.col("whole") / F.col("n"))).otherwise(0).cast("bigint").alias("base"),
        F.when(worded, extra).otherwise(0).cast("bigint").alias("extra"))


def _numbered(rows: DataFrame, count: str, *columns) -> DataFrame:
    """Each row `count` times, with its number k from 1; rows of a large count are dealt out."""
    last = F.greatest(F.lit(0), F.floor((F.col(count) - 1) / REPEATED))
    cut = rows.filter(F.col(count) > 0).select(*columns, count, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_chunk"))
    cut = cut.repartition(partitions(rows.sparkSession))
    first, upto = F.col("_chunk") * REPEATED + 1, F.least((F.col("_chunk") + 1) * REPEATED, F.col(count))
    return cut.select(*columns, F.explode(F.sequence(first, upto)).alias("k"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ranked: int = RANKED) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken (copies * size) for each row of `docs`.

    Null, empty and blank texts have size 0 and no copies; a null source is a source of its own, the last. Sources
    without words have target 0. Documents of equal source and size are told apart by the hash of their id and text; rows
    that repeat an id count each. Very long texts are counted whole. The result depends only on the rows, so reruns
    agree. Other columns are not read."""
    plan = planned(docs, doc_id, text, source, weights, most, ranked)
    rows = _numbered(plan, "m", "doc_id", "size", "source_size", "target", "rate", "base", "extra")
    out = rows.withColumn("copies", F.col("base") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0).cast("bigint"))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resampled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
              weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ranked: int = RANKED) -> DataFrame:
    """The rows of `docs`, all columns, as often as `mixed` takes them. Of rows alike in id, source and text that are not
    all taken equally often, what some are taken more is added as copies of one of them."""
    plan = planned(docs, doc_id, text, source, weights, most, ranked).filter("base > 0 OR extra > 0").select("doc_id", "source", "h", "m", "base", "extra")
    plan = staged(plan, "plan")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_kind(doc_id, text, source))
    met = keyed.alias("d").join(plan.alias("p"), F.expr("d.doc_id <=> p.doc_id AND d.source <=> p.source AND d.h = p.h")).select("d.*", "m", "base", "extra")
    copies = F.col("base") + F.when(F.col("m") == 1, F.col("extra")).otherwise(0)
    own = met.withColumn("copies", copies).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    more = met.filter("m > 1 AND extra > 0").groupBy("doc_id", "source", "h").agg(F.first("row").alias("row"), F.first("extra").alias("extra"))
    return own.select("row.*").unionByName(_numbered(more, "extra", "row").select("row.*"))
