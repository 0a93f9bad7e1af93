"""A stated set of query vectors against all vectors, in tiles of bounded size.

Rows are dealt evenly into `R` row groups and queries into `C` query groups. Each row group is packed once (by the
operator's own `pack`) and staged; each of the R x C tiles is one cogroup, which keeps some best rows for each query.
Rows travel C times and queries R times, packed; what leaves a tile is a few rows for each query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knigovod.llm.shared import partitions, staged

#: Bytes of vectors in a row group, rows in the smallest one, queries in a query group.
GROUP_BYTES, LEAST_ROWS, GROUP_QUERIES = 16 << 20, 4096, 4096


def usable(rows: DataFrame, asks: Column, vec_id: str, vector: str, label: str | None = None) -> DataFrame:
    """id, v, label, asks (false where null) of the rows that take part: id, vector (and label) not null, components not
    null and finite, and as many components as most vectors have (of two such lengths the smaller; vectors without
    components never)."""
    kind = rows.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    out = rows.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"),
        (F.lit(0) if label is None else F.col(label)).cast("bigint").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks")).dropna()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = out.filter((F.size("v") > 0) & finite)
    common = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.filter(F.size("v") == (common.n if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def groups(n: int, width: int, slots: int) -> int:
    """How many row groups `n` vectors of `width` components make: enough for all slots, none above GROUP_BYTES."""
    most = max(1, GROUP_BYTES // (8 * max(1, width)))
    each = min(most, max(LEAST_ROWS, -(-n // max(1, 4 * slots))))
    return max(1, -(-n // each))


def packed(rows: DataFrame, n_groups: int, pack: Callable[[pa.Table], dict[str, bytes]], columns: list[str], name: str) -> DataFrame:
    """One row per group: r, and the binary columns that `pack` makes of the group's id, v, label (and what else `rows`
    have). Staged, so that every tile sees the same groups."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            made = pack(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_pydict(
                {"r": pa.array([TaskContext.get().partitionId()], pa.int64()), **{c: pa.array([made[c]], pa.binary()) for c in columns}})

    schema = "r bigint, " + ", ".join(f"{c} binary" for c in columns)
    return staged(rows.repartition(n_groups).mapInArrow(run, schema), name)


def tiles(index: DataFrame, queries: DataFrame, n_groups: int, n_queries: int, best: Callable[[dict, pa.Table], pa.Table],
          schema: str) -> DataFrame:
    """`best(row group, queries)` for each row group and each group of queries; `best` gives rows of `schema`."""
    n_c = max(1, -(-n_queries // GROUP_QUERIES))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = index.select("*", all_of(n_c).alias("c"))
    right = queries.repartition(n_c).withColumn("c", F.spark_partition_id().cast("bigint"))
    right = right.select("*", all_of(n_groups).alias("r"))
    types = T._parse_datatype_string(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [best({c: row[c] for c in row}, b) for row in a.to_pylist()] if b.num_rows else []
        return pa.concat_tables(out) if out else empty(types)

    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(run, schema)


def empty(types: T.StructType) -> pa.Table:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.table({f.name: pa.array([], kinds[f.dataType.simpleString()]) for f in types})


def slots(rows: DataFrame) -> int:
    return partitions(rows.sparkSession)
