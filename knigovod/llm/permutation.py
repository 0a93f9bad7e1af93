"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of distance. Each row group holds one inverted file per pivot:
the rows that have the pivot among their `PREFIX` nearest, with its place. A query opens the files of its own nearest
pivots and adds up how well the places agree, which orders all rows by the footrule distance of the two prefixes
(places beyond a prefix count as its length). The rows of least footrule are ranked anew by their true distance.

Pivots come from a bounded sample (the `SAMPLE` rows of least hash), chosen farthest first, so that a group of near
copies gets one pivot and not a third of them. Every row is indexed. Row groups are cut from the rows as they are
dealt out, so no inverted file grows with the data, however common a vector is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knigovod.llm import vectors as V

#: Rows that pivots are chosen from, pivots, pivots in a representation.
SAMPLE, PIVOTS, PREFIX = 2048, 256, 96
#: The share of a row group, by least footrule, that is reranked (rows as near as the last one too), and its least size.
RERANKED, LEAST_RERANKED = 0.125, 64

COLUMNS = ["ids", "vectors", "starts", "posted", "places"]
FOUND = "query_id bigint, q bigint, vec_id bigint, score double"


def chosen_pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """At most `n` different vectors of the sample, each the farthest from those before it."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return np.empty((0, 0))
    points = V.matrix(sample.column("v"))
    chosen, nearest = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def places(points: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each point, nearest first; of equally near ones the first chosen."""
    out = np.empty((len(points), prefix), np.int64)
    for low in range(0, len(points), 1024):
        part = points[low:low + 1024]
        out[low:low + 1024] = np.argsort((pivots ** 2).sum(1)[None] - 2 * part @ pivots.T, axis=1, kind="stable")[:, :prefix]
    return out


def index(rows: DataFrame, pivots: np.ndarray, n_groups: int, prefix: int = PREFIX) -> DataFrame:
    """One row per row group: ids, vectors, and the inverted files one after the other (rows and places; where each starts)."""
    prefix = min(prefix, len(pivots))

    def pack(group: pa.Table) -> dict[str, bytes]:
        points = V.matrix(group.column("v"))
        near = places(points, pivots, prefix).ravel()
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(len(pivots) + 1))
        single = group.schema.field("v").type.value_type == pa.float32()
        return {"ids": group.column("id").to_numpy().astype(np.int64).tobytes(), "vectors": points.astype(np.float32 if single else np.float64).tobytes(),
                "starts": starts.astype(np.int64).tobytes(), "posted": (order // prefix).astype(np.int32).tobytes(),
                "places": (order % prefix).astype(np.int16).tobytes()}

    return V.packed(rows, n_groups, pack, COLUMNS, "permutations")


def least(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the `k` least values stand, in order; of equal ones the smaller id first."""
    if len(values) > k:
        kept = np.flatnonzero(values <= np.partition(values, k - 1)[k - 1])
    else:
        kept = np.arange(len(values))
    return kept[np.lexsort((ids[kept], values[kept]))][:k]


def nearest(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
            reranked: float = RERANKED, n_pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` nearest rows found for each row of `rows` that `is_query`, by
    Euclidean distance in double precision, ties to the smaller vec_id; all candidates if there are fewer.

    Rows without an id, and vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part. A query's candidates are all rows of another id. Query rows that repeat (id, vector) are
    asked once; two vectors under one id are two queries with ranks of their own. Candidate rows that repeat are all
    candidates. Distances beyond the range of doubles are infinite. Other columns are not read. No rows give no rows."""
    data = V.usable(rows, is_query, vec_id, vector).filter(F.exists("v", lambda x: x != 0))
    asked = data.filter("asks").dropDuplicates(["id", "v"])
    pivots = chosen_pivots(data, n_pivots)
    n, n_queries = data.count(), asked.count()
    n_groups = V.groups(n, pivots.shape[1], V.slots(rows))
    depth = min(prefix, len(pivots))
    queries = asked.select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q"), F.col("v").cast("array<double>").alias("v"))

    def best(group: dict, asked: pa.Table) -> pa.Table:
        ids, starts = (np.frombuffer(group[c], np.int64) for c in ("ids", "starts"))
        posted, at = np.frombuffer(group["posted"], np.int32), np.frombuffer(group["places"], np.int16)
        width = pivots.shape[1]
        points = np.frombuffer(group["vectors"], np.float64 if len(group["vectors"]) == 8 * width * len(ids) else np.float32).reshape(-1, width)
        wanted = max(LEAST_RERANKED, k, int(np.ceil(reranked * len(ids))))
        # What a pivot at one place in the query and another in the row adds: how far both lie before the prefix's end, less their distance.
        steps = np.arange(depth, dtype=np.int32)
        gain = 2 * (depth - np.maximum.outer(steps, steps))
        questions = V.matrix(asked.column("v"))
        out = {"query_id": [], "q": [], "vec_id": [], "score": []}
        for own, key, point, near in zip(asked.column("query_id").to_pylist(), asked.column("q").to_pylist(), questions, places(questions, pivots, depth)):
            agreed = np.zeros(len(ids), np.int32)
            for place, pivot in enumerate(near):
                low, high = starts[pivot], starts[pivot + 1]
                agreed[posted[low:high]] += gain[place][at[low:high]]
            agreed[ids == own] = -1
            if len(ids) > wanted:
                kept = np.flatnonzero(agreed >= max(0, np.partition(agreed, len(ids) - wanted)[len(ids) - wanted]))
            else:
                kept = np.flatnonzero(agreed >= 0)
            with np.errstate(over="ignore"):
                apart = np.sqrt(((points[kept].astype(np.float64) - point) ** 2).sum(1))
            first = least(apart, ids[kept], k)
            out["query_id"] += [own] * len(first)
            out["q"] += [key] * len(first)
            out["vec_id"] += ids[kept[first]].tolist()
            out["score"] += apart[first].tolist()
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})

    built = index(data, pivots, n_groups, prefix)
    found = V.tiles(built, queries, n_groups, n_queries, best, FOUND)
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
