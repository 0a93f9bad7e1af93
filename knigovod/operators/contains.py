"""Which texts contain which short strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knigovod.config import MAX_INLINE_ROWS


def grams(text, size: int):
    """Distinct runs of `size` characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(
        F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(size))))


def small_rows(df: DataFrame, limit: int = MAX_INLINE_ROWS):
    """Rows of a dimension of at most `limit` rows; None when it is larger."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def contains_join(texts: DataFrame, needles: DataFrame, limit: int = MAX_INLINE_ROWS) -> DataFrame:
    """Pairs (text_id, needle_id) where the text contains the needle.

    texts: text_id, text. needles: needle_id, needle (not empty).
    Few needles are looked for in one expression over the texts, more of them by an automaton.
    """
    few = small_rows(needles.select("needle_id", "needle"), limit)
    if few is not None:
        if not few:
            nothing = F.lit(None).cast(needles.schema["needle_id"].dataType)
            return texts.select("text_id", nothing.alias("needle_id")).filter(F.lit(False))
        listed = F.array(*[F.struct(F.lit(r.needle_id).alias("needle_id"), F.lit(r.needle).alias("needle")) for r in few])
        found = F.filter(listed, lambda n: F.contains(F.col("text"), n["needle"]))
        return texts.select("text_id", F.explode(found).alias("hit")).select("text_id", "hit.needle_id")
    return contains_by_automaton(texts, needles)


def first_containing(texts: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, place, text_id): the first `n` texts, by text_id, that contain each query (query_id, query), in any case.

    texts: text_id, text in lower case. Queries that ask for the same are looked for once, and each map task keeps `n` texts
    a spelling before anything is shuffled; the queries' ids meet only what is left."""
    asked = queries.filter(F.coalesce(F.col("query"), F.lit("")) != "").select("query_id", F.lower("query").alias("needle_id"))
    needles = asked.select("needle_id", F.col("needle_id").alias("needle")).distinct()

    def first(rows: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy("text_id"))
        return rows.withColumn("place", place).filter(F.col("place") <= n)

    found = first(contains_join(texts, needles), "needle_id").drop("place")
    return first(found.join(asked, "needle_id"), "query_id").select("query_id", "place", "text_id")


#: Most letters of the needles in an automaton, which takes some hundred bytes a letter.
AUTOMATON_LETTERS = 2_000_000


def contains_by_automaton(texts: DataFrame, needles: DataFrame, letters: int | None = None) -> DataFrame:
    """The pairs of `contains_join` for any number of needles, in one pass over the texts.

    The distinct needles make an Aho-Corasick automaton, which reads each text once and reports every needle in it: texts
    are not shuffled, only what is found is joined with the needles' ids. Needles of more than `letters` letters together
    (AUTOMATON_LETTERS if not given) do not fit a task; then a sieve of bounded size, a few bits for each needle, takes the
    automaton's place, and the join drops what passed it by chance."""
    letters = letters or AUTOMATON_LETTERS
    distinct = needles.filter("needle <> ''").select("needle").distinct()
    size = distinct.agg(F.sum(F.length("needle"))).first()[0] or 0
    if size <= letters:
        search = _searched(texts.sparkSession.sparkContext.broadcast(distinct.toArrow().column("needle").to_pylist()))
    else:
        search = _sifted(*_sieve(distinct))
    schema = T.StructType([texts.schema["text_id"], T.StructField("needle", T.StringType())])
    return texts.select("text_id", "text").mapInArrow(search, schema).join(needles, "needle").select("text_id", "needle_id")


#: Bits of a sieve: so many for each needle, and at most so many (32 MB).
BITS_A_NEEDLE, MOST_BITS = 32, 1 << 28
#: Words of 64 bits of a sieve that travel as one row.
SIEVE_WORDS = 1 << 13
#: Letters that are hashed at a time.
HASHED_LETTERS = 1 << 20
# Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def _hashes(texts: list[str]):
    """(first letter of each text, a function that hashes the windows of a length at given letters) of texts written one
    after the other. Equal windows have equal hashes wherever they are."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(len(letters), base, np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(letters * powers(_BASE)[:-1], dtype=np.uint64)]
    back = powers(pow(_BASE, -1, 1 << 64))

    def windows(at: np.ndarray, length: int, prefix: bool = False) -> np.ndarray:
        h = (sums[at + length] - sums[at]) * back[at] + np.uint64(2 * length + prefix)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(32))

    return np.cumsum([0, *map(len, texts)]), windows


def _places(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    mask = np.uint64(n_bits - 1)
    return hashes & mask, (hashes >> np.uint64(36)) & mask


def _sieve(distinct: DataFrame) -> tuple[Broadcast, int, list[int]]:
    """(bits, their number, lengths of the needles): two bits for each needle and, where lengths differ, two for as many of
    its first letters as the shortest has."""
    # At most as many lengths as the longest needle has letters.
    by_length = distinct.groupBy(F.length("needle").alias("n")).agg(F.count(F.lit(1)).alias("needles")).collect()
    lengths = sorted(r.n for r in by_length)
    count = sum(r.needles for r in by_length)
    n_bits = min(max(1 << (BITS_A_NEEDLE * count - 1).bit_length(), 1 << 16), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.column(0).to_pylist()):
                starts, windows = _hashes(part)
                sizes = np.diff(starts)
                hashed = [windows(starts[:-1][sizes == n], int(n)) for n in np.unique(sizes)]
                if len(lengths) > 1:
                    hashed.append(windows(starts[:-1], lengths[0], True))
                places = np.unique(np.concatenate([p for h in hashed for p in _places(h, n_bits)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))],
                    ["word", "bits"])

    def filled(words: pa.Table) -> pa.Table:
        block, own = words.column("word")[0].as_py() // SIEVE_WORDS, np.zeros(SIEVE_WORDS, np.int64)
        own[words.column("word").to_numpy() % SIEVE_WORDS] = words.column("bits").to_numpy()
        return pa.table({"block": [block], "bits": [own.tobytes()]})

    words = distinct.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # The driver gets the sieve in a few hundred pieces and never the millions of words with their places.
    blocks = words.groupBy(F.floor(F.col("word") / SIEVE_WORDS)).applyInArrow(filled, "block bigint, bits binary")
    bits = np.zeros(max(n_bits // 64, SIEVE_WORDS), np.int64)
    for row in blocks.collect():
        bits[row.block * SIEVE_WORDS:(row.block + 1) * SIEVE_WORDS] = np.frombuffer(row.bits, np.int64)
    return distinct.sparkSession.sparkContext.broadcast(bits.view(np.uint8)), n_bits, lengths


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in parts of HASHED_LETTERS, or a single longer one."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > HASHED_LETTERS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _sifted(sieve: Broadcast, n_bits: int, lengths: list[int]):
    """(text_id, window) of every window of a text that may be a needle, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value

        def held(hashes: np.ndarray) -> np.ndarray:
            one, two = ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in _places(hashes, n_bits))
            return (one & two).astype(bool)

        for batch in batches:
            first = 0
            for part in _parts([t or "" for t in batch.column(1).to_pylist()]):
                starts, windows = _hashes(part)
                ends = np.repeat(starts[1:], np.diff(starts))
                at = np.flatnonzero(np.arange(len(ends)) + lengths[0] <= ends)
                if len(lengths) > 1:
                    at = at[held(windows(at, lengths[0], True))]
                found = set()
                for n in lengths:
                    at = at[at + n <= ends[at]]
                    hits = at[held(windows(at, n))]
                    rows = np.searchsorted(starts, hits, "right") - 1
                    found.update((r, part[r][i:i + n]) for r, i in zip(rows.tolist(), (hits - starts[rows]).tolist()))
                rows = pa.array([first + r for r, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([w for _, w in found], pa.string())], ["text_id", "needle"])
                first += len(part)

    return run


def _searched(needles: Broadcast):
    """(text_id, needle) of every needle in every text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        listed = needles.value
        automaton = ahocorasick.Automaton()
        for k, needle in enumerate(listed):
            automaton.add_word(needle, k)
        if listed:
            automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1).to_pylist() if listed else ()):
                own = {k for _, k in automaton.iter(text)} if text else ()
                rows.extend([row] * len(own))
                hits.extend(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([listed[k] for k in hits], pa.string())], ["text_id", "needle"])

    return run
