"""Hard negatives by exact integer scores, worked out the Four-Russians way.

Components are integers in two's complement. A candidate is stored as bit planes: for each bit and each group of eight
components, one byte of their bits. For an anchor, a table per group holds the sum of the anchor's components over each
of the 256 subsets of the group; a candidate's byte picks the sum. Sums of one plane are added, planes are shifted and
added from the sign bit downwards, which gives the whole inner product without a multiplication.

Scores are made twice: first for the best rows of an anchor's own label (the positives), then for the rows of other
labels within the bounds that each positive sets. What leaves a tile is a few rows for each anchor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knigovod.llm import vectors as V
from knigovod.llm.shared import staged

#: Components are held to this many bits and a sign. Scores are modulo 2**64, so exact up to 2**63.
BITS = 31
#: Anchors whose tables are used at a time, and candidates scored at a time: both stay in the processor's cache.
ANCHORS, CANDIDATES = 32, 2048

COLUMNS = ["ids", "labels", "shape", "planes"]
POSITIVES = "anchor_id bigint, q bigint, positive_id bigint, positive_score bigint"
NEGATIVES = "anchor_id bigint, q bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def whole(points: np.ndarray, scale: float) -> np.ndarray:
    """Components scaled and rounded down, held to BITS bits."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(points * scale), -(1 << BITS), (1 << BITS) - 1).astype(np.int64)


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """(planes, groups of eight, rows): the bytes of each bit, lowest bit first, the sign bit last."""
    n, width = numbers.shape
    groups = -(-width // 8)
    padded = np.zeros((n, groups * 8), np.int64)
    padded[:, :width] = numbers
    size = max((int(x).bit_length() for x in (numbers.max(initial=0), -numbers.min(initial=0) - 1)), default=0) + 1
    out = np.empty((size, groups, n), np.uint8)
    for k in range(size):
        out[k] = np.packbits(((padded >> k) & 1).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """(groups of eight, 256, anchors): the sum of the anchors' components over each subset of a group."""
    n, width = anchors.shape
    groups = -(-width // 8)
    padded = np.zeros((n, groups * 8), kind)
    padded[:, :width] = anchors
    parts = padded.reshape(n, groups, 8).transpose(1, 2, 0)
    out = np.zeros((groups, 256, n), kind)
    for j in range(8):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + parts[:, j:j + 1]
    return out


def scores(planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(anchors, rows): all inner products."""
    size, groups, n = planes.shape
    reach = int(np.abs(anchors).max(initial=0)) * groups * 8 << size
    kind = np.int32 if reach < 1 << 31 else np.int64
    out = np.empty((len(anchors), n), np.int64)
    for a in range(0, len(anchors), ANCHORS):
        tables = subset_sums(anchors[a:a + ANCHORS], kind)
        width = tables.shape[2]
        for low in range(0, n, CANDIDATES):
            part = planes[:, :, low:low + CANDIDATES]
            total, picked = np.zeros((part.shape[2], width), kind), np.empty((part.shape[2], width), kind)
            for k in range(size - 1, -1, -1):
                np.left_shift(total, 1, out=total)
                for g in range(groups):
                    np.take(tables[g], part[k, g], axis=0, out=picked, mode="clip")
                    total += picked
                if k == size - 1:
                    np.negative(total, out=total)
            out[a:a + ANCHORS, low:low + CANDIDATES] = total.T
    return out


def best(values: np.ndarray, ids: np.ndarray, kept: np.ndarray, k: int) -> np.ndarray:
    """Of the rows `kept`, the `k` of highest value, in order; of equal ones the smaller id first."""
    if len(kept) > k:
        kept = kept[values[kept] >= np.partition(values[kept], len(kept) - k)[len(kept) - k]]
    return kept[np.lexsort((ids[kept], -values[kept]))][:k]


def index(rows: DataFrame, n_groups: int, scale: float) -> DataFrame:
    """One row per row group: ids, labels, and the bit planes of its vectors."""

    def pack(group: pa.Table) -> dict[str, bytes]:
        planes = bit_planes(whole(V.matrix(group.column("v")), scale))
        return {"ids": group.column("id").to_numpy().astype(np.int64).tobytes(), "labels": group.column("label").to_numpy().astype(np.int64).tobytes(),
                "shape": np.array(planes.shape, np.int64).tobytes(), "planes": planes.tobytes()}

    return V.packed(rows, n_groups, pack, COLUMNS, "planes")


def unpacked(group: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(group["planes"], np.uint8).reshape(np.frombuffer(group["shape"], np.int64))
    return np.frombuffer(group["ids"], np.int64), np.frombuffer(group["labels"], np.int64), planes


def numbers_of(out: list[tuple], names: str) -> pa.Table:
    """Rows of integers under the names of a schema."""
    columns = [x.split()[0] for x in names.split(",")]
    values = list(zip(*out)) if out else [()] * len(columns)
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(columns, values)})


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each row that `is_anchor`
    and each of its `n_positives` best rows of the same label, the `n_negatives` best rows of another label that score
    from `low` to `high` percent of the positive. Scores are inner products of the scaled, rounded-down components;
    higher ones come first, ties by the smaller vec_id; a positive below 0 admits nothing.

    Rows with a null id, label, vector or component, a non-finite component, or a vector of another length than most
    take no part. An anchor's own row is any row of its id. Anchors that repeat (id, label, vector) are asked once; two
    vectors or labels under one id are two anchors with ranks of their own. Other rows that repeat all count.
    Components beyond 31 bits are held at that bound. Other columns are not read. No rows give no rows."""
    data = V.usable(rows, is_anchor, vec_id, vector, label)
    asked = data.filter("asks").dropDuplicates(["id", "label", "v"])
    n, n_anchors = data.count(), asked.count()
    width = len((data.first() or {"v": ()})["v"])
    n_groups = V.groups(n, width, V.slots(rows))
    built = index(data, n_groups, scale)
    anchors = asked.select(F.col("id").alias("anchor_id"), F.xxhash64("label", "v").alias("q"), F.col("label").alias("own"), "v")

    def close(group: dict, asked: pa.Table) -> pa.Table:
        ids, labels, planes = unpacked(group)
        out = []
        for key, own, value in scored(asked, planes):
            same = np.flatnonzero((labels == own) & (ids != key[0]))
            out += [(*key, int(ids[x]), int(value[x])) for x in best(value, ids, same, n_positives)]
        return numbers_of(out, POSITIVES)

    def scored(asked: pa.Table, planes: np.ndarray):
        numbers = whole(V.matrix(asked.column("v")), scale)
        keys = list(zip(*(asked.column(c).to_pylist() for c in ("anchor_id", "q"))))
        owns = asked.column("own").to_pylist()
        for at in range(0, len(keys), ANCHORS):
            for k, value in enumerate(scores(planes, numbers[at:at + ANCHORS]), at):
                yield keys[k], owns[k], value

    place = F.row_number().over(Window.partitionBy("anchor_id", "q").orderBy(F.desc("positive_score"), "positive_id"))
    positives = V.tiles(built, anchors, n_groups, n_anchors, close, POSITIVES)
    positives = staged(positives.withColumn("place", place).filter(F.col("place") <= n_positives), "positives")

    bounds = positives.groupBy("anchor_id", "q").agg(F.collect_set("positive_score").alias("levels"))
    bounded = anchors.join(bounds, ["anchor_id", "q"])

    def apart(group: dict, asked: pa.Table) -> pa.Table:
        ids, labels, planes = unpacked(group)
        levels = asked.column("levels").to_pylist()
        out = []
        for (key, own, value), wanted in zip(scored(asked, planes), levels):
            other = np.flatnonzero(labels != own)
            seen = value[other]
            for level in wanted:
                inside = other[(seen >= -(-low * level // 100)) & (seen <= high * level // 100)]
                out += [(*key, level, int(ids[x]), int(value[x])) for x in best(value, ids, inside, n_negatives)]
        return numbers_of(out, NEGATIVES)

    negatives = V.tiles(built, bounded, n_groups, n_anchors, apart, NEGATIVES)
    place = F.row_number().over(Window.partitionBy("anchor_id", "q", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    negatives = negatives.withColumn("rank", place).filter(F.col("rank") <= n_negatives)
    return positives.drop("place").join(negatives, ["anchor_id", "q", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
