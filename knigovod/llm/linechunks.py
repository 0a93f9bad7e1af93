"""Line dedup on content-defined chunks of lines.

A rolling hash over the hashes of the last `SPAN` lines that are not blank says which lines are boundaries; a chunk goes
from one boundary to the next, both included, so it has two such lines at least and neighbouring chunks share the line
at their border. Whether a line is a boundary depends on the line alone, so a passage has the same chunks wherever it
stands. Boundaries are dense (all but one line in `PASSED`): a passage of two lines is a chunk of its own in 15 of 16
cases, and longer ones nearly always hold one.

Chunks that occur more than once in the corpus are removed, but for the first occurrence (least doc_id, then position),
after their bytes are compared with it. A removed chunk is then extended line by line, both ways up to the next
boundary, as far as the lines around the first occurrence are the same; beyond a boundary there is another chunk.

Texts move twice: the chunks that may be removed to where their hash is, and the documents to where their repeats are.
Which chunks may be removed is told by a bit map of the repeated hashes, of a fixed size and sent to every worker; chunks
that share a bit by chance travel in vain, and the joins sort them out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knigovod.llm import words as W
from knigovod.llm.shared import staged

SPAN, PASSED = 1, 32
#: Bits of the map of repeated hashes: 16 MB.
MAP_BITS = 1 << 27


def full_lines(lines: list[bytes]) -> list[int]:
    """Where the lines stand that are not blank."""
    return [k for k, x in enumerate(lines) if x.strip()]


def boundaries(lines: list[bytes], passed: int = PASSED) -> list[int]:
    """Which of the given lines are boundaries; the first and the last always."""
    if not lines:
        return []
    hashes = np.array([zlib.crc32(x) for x in lines], np.uint64)
    rolled = np.zeros(len(lines), np.uint64)
    for j in range(min(SPAN, len(lines))):
        rolled[j:] += hashes[:len(lines) - j] * np.uint64(pow(W.MULTIPLIER, j, 1 << 64))
    chosen = W.mix(rolled) % np.uint64(passed) != 0
    chosen[[0, -1]] = True
    return np.flatnonzero(chosen).tolist()


def chunks(lines: list[bytes], full: list[int], passed: int = PASSED) -> list[tuple[int, int]]:
    """(first, last) of each chunk, as places in `full`."""
    ends = boundaries([lines[k] for k in full], passed)
    return list(zip(ends, ends[1:]))


def body(lines: list[bytes], full: list[int], low: int, high: int) -> bytes:
    """From one full line to another, with the blank lines between."""
    return b"\n".join(lines[full[low]:full[high] + 1])


def _around(lines: list[bytes], full: list[int], low: int, high: int) -> list[bytes]:
    """Single steps from `low` to `high` (either way): each the next full line with the blank lines on the way to it."""
    step = 1 if high > low else -1
    out = []
    for k in range(low, high, step):
        a, b = sorted((full[k], full[k + step]))
        out.append(b"\n".join(lines[a + 1:b + 1] if step > 0 else lines[a:b]))
    return out


FOUND = "doc_id bigint, k bigint, place int, h bigint, body binary, before array<binary>, after array<binary>"


def bit_map(hashes: DataFrame) -> bytes:
    """A bit for each h, at its last 27 bits: MAP_BITS / 64 words reach the driver at most, however many hashes there are."""
    at = F.col("h").bitwiseAND(F.lit(MAP_BITS - 1))
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(
        F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def _found(docs: DataFrame, passed: int, repeated: Broadcast | None = None) -> DataFrame:
    """One row per chunk: doc_id, k (hash of the text), place (of its first line), h. With a bit map, only chunks whose
    bit is set, with their bytes and the lines before and after up to the next boundaries, the nearest first."""
    lines_type = pa.list_(pa.binary())
    with_text = repeated is not None

    def run(batches):
        for batch in batches:
            ids, keys, places, hashes, bodies, befores, afters = [], [], [], [], [], [], []
            bits = repeated.value if with_text else b""
            for i, k, value in zip(*(batch.column(c).to_pylist() for c in range(3))):
                lines = value.split(b"\n")
                full = full_lines(lines)
                cut = chunks(lines, full, passed)
                for n, (low, high) in enumerate(cut):
                    own = body(lines, full, low, high)
                    h = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                    if with_text and not bits[(h & (MAP_BITS - 1)) >> 3] >> (h & 7) & 1:
                        continue
                    ids.append(i)
                    keys.append(k)
                    places.append(low)
                    hashes.append(h)
                    if with_text:
                        bodies.append(own)
                        befores.append(_around(lines, full, low, cut[n - 1][0] + 1) if n and cut[n - 1][0] + 1 < low else [])
                        afters.append(_around(lines, full, high, cut[n + 1][1] - 1) if n + 1 < len(cut) and cut[n + 1][1] - 1 > high else [])
            none = [None] * len(ids)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "k": pa.array(keys, pa.int64()), "place": pa.array(places, pa.int32()),
                "h": pa.array(hashes, pa.int64()), "body": pa.array(bodies if with_text else none, pa.binary()),
                "before": pa.array(befores if with_text else none, lines_type), "after": pa.array(afters if with_text else none, lines_type)})

    return docs.select("doc_id", "k", "t").mapInArrow(run, FOUND)


def _alike(one: str, other: str):
    """How many steps of two lists are the same, from their beginning."""
    same = f"zip_with({one}, {other}, (x, y) -> coalesce(x = y, false))"
    return F.expr(f"cast(array_position(array_append({same}, false), false) - 1 as int)")


OUT = "doc_id bigint, n_lines bigint, n_chunks bigint, n_removed bigint, kept binary"


def without_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passed: int = PASSED) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed (lines), kept (the other lines, joined) for each row of `docs`.

    Null texts are empty, and an empty text is one blank line. A null doc_id comes before all others. Rows that repeat
    (doc_id, text) are one document: what is removed from one is removed from all. A chunk whose hash is that of another
    but whose bytes are not stays. A line goes only if an equal line stands earlier, so each distinct line stays once at
    least; blank lines go only between lines that do. Very long texts are read line by line, never cut. Other columns are
    not read. No rows give no rows."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    given = given.withColumn("k", F.xxhash64("t"))
    where = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), "k", "place")
    firsts = _found(given, passed).withColumn("w", where).groupBy("h").agg(
        F.min("w").alias("first"), F.max("w").alias("last")).filter("first <> last").select("h", "first")
    firsts = staged(firsts, "chunks")
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(firsts))
    # Both joins move texts: sort-merge at every size, so that what is moved grows as the texts do.
    repeated = staged(_found(given, passed, bits).join(firsts.hint("merge"), "h").withColumn("w", where), "repeats")
    originals = repeated.filter("w = first").groupBy("h").agg(F.first(F.struct("body", "before", "after")).alias("o"))
    removed = repeated.filter("w <> first").join(originals, "h").filter("body = o.body").select(
        "doc_id", "k", F.struct("place", _alike("before", "o.before").alias("before"), _alike("after", "o.after").alias("after")).alias("gone"))
    gone = removed.groupBy("doc_id", "k").agg(F.collect_set("gone").alias("gone"))
    joined = given.alias("g").join(gone.alias("r").hint("merge"), F.expr("g.doc_id <=> r.doc_id AND g.k = r.k"), "left").select("g.doc_id", "t", "gone")

    def run(batches):
        for batch in batches:
            n_lines, n_chunks, n_removed, kept = [], [], [], []
            for value, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = value.split(b"\n")
                full = full_lines(lines)
                cut = chunks(lines, full, passed)
                last = dict(cut)
                gone_lines = {n for x in gone or () for n in range(full[x["place"] - x["before"]], full[last[x["place"]] + x["after"]] + 1)}
                out = [x for n, x in enumerate(lines) if n not in gone_lines] if gone_lines else lines
                n_lines.append(len(lines))
                n_chunks.append(len(cut))
                n_removed.append(len(lines) - len(out))
                kept.append(b"\n".join(out))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_lines": pa.array(n_lines, pa.int64()), "n_chunks": pa.array(n_chunks, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return joined.mapInArrow(run, OUT)
