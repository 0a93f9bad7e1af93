"""Packs: documents put together in rows of a few MB, so that whole packs can be worked on with numpy, and
so that a question about the whole corpus costs a few bytes a key.

The pattern that `jaccard`, `katz` and `suffixes` share:

1. `pack` turns documents into packs (compressed rows; one shuffle by pack number, reused by all steps).
2. Each pack asks about its distinct keys: a sorted run of hashes for each bucket (`ask_rows`).
3. One task per bucket merges the runs and answers each pack with values in the order that it asked in.
4. Each pack is brought together with its answers (`cogroup`).

A key that a third of all documents hold is asked about once per pack, however often it occurs there.
Numbers of packs and buckets follow the size of the corpus; no task holds more than a pack or a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a pack. One longer document is a pack of its own.
PACK_BYTES = 8 << 20

#: Rows of a batch that are turned into Python values at once.
_STEP = 512

PACK_SCHEMA = "pack bigint, ids array<bigint>, n_raw bigint, lengths binary, flags binary, data binary"


def squeeze(data) -> bytes:
    return pa.compress(bytes(data), codec="zstd", asbytes=True)


def expand(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def store(array: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes, mostly zero, cost next to nothing."""
    array = np.ascontiguousarray(array)
    width = array.dtype.itemsize
    planes = array.view(np.uint8).reshape(-1, width).T
    return len(array).to_bytes(8, "little") + squeeze(np.ascontiguousarray(planes).tobytes()) if len(array) else b""


def load(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.empty(0, dtype)
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(expand(data[8:], n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def length(data: bytes) -> int:
    """How many integers `store` was given."""
    return int.from_bytes(data[:8], "little")


def store_sorted(keys: np.ndarray) -> bytes:
    """A sorted run of uint64, as differences."""
    return store(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


def load_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(load(data, np.uint64), dtype=np.uint64)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = PACK_BYTES, flag: Column | None = None) -> DataFrame:
    """One row per pack. Texts stand one after the other, each followed by a line feed; null is empty. `flag` is a
    boolean of the caller's, kept for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, flags, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            raw = b"\n".join([*texts, b""])
            lengths = np.array([len(t) for t in texts], np.uint32)
            return pa.RecordBatch.from_pydict({
                "pack": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "n_raw": pa.array([len(raw)], pa.int64()), "lengths": pa.array([store(lengths)], pa.binary()),
                "flags": pa.array([store(np.array(flags, np.uint8))], pa.binary()), "data": pa.array([squeeze(raw)], pa.binary())})

        for batch in (whole.slice(at, _STEP) for whole in batches for at in range(0, whole.num_rows, _STEP)):
            for key, value, mark in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if texts and size + len(value) > limit:
                    yield row()
                    number, ids, texts, flags, size = number + 1, [], [], [], 0
                ids.append(key)
                flags.append(mark)
                texts.append(value)
                size += len(value) + 1
        if texts:
            yield row()

    given = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
        F.lit(False).alias("flag") if flag is None else flag.alias("flag"))
    return given.mapInArrow(run, PACK_SCHEMA)


class Pack:
    """A pack, unpacked: `raw` bytes, `starts` and `ends` of the documents in them, their `ids`."""

    def __init__(self, table: pa.Table):
        self.number = table.column("pack")[0].as_py()
        self.ids = table.column("ids")[0].as_py()
        self.flags = load(table.column("flags")[0].as_py(), np.uint8).astype(bool)
        self.lengths = load(table.column("lengths")[0].as_py(), np.uint32).astype(np.int64)
        self.raw = expand(table.column("data")[0].as_py(), table.column("n_raw")[0].as_py())
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(self.lengths + 1) - 1
        self.starts = self.ends - self.lengths


def bucket_of(keys: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """The bucket of each key: the range of keys cut into `n` equal parts, so sorted keys have sorted buckets."""
    top = (keys >> np.uint64(bits - 32)).astype(np.uint64)
    return ((top * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def cuts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array of buckets."""
    if not len(buckets):
        return []
    edges = np.flatnonzero(np.diff(buckets)) + 1
    lows, highs = [0, *edges.tolist()], [*edges.tolist(), len(buckets)]
    return [(int(buckets[a]), a, b) for a, b in zip(lows, highs)]


def binary_rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})
