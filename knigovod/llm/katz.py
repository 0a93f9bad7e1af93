"""A Katz backoff language model of bigrams, learned from a corpus and applied to it.

P(w | h) = d(c) c(hw) / c(h) if the training texts hold h w, c = c(hw) times, else alpha(h) P(w). d is the Good-Turing
discount for counts up to `CUTOFF`; alpha(h) makes P(. | h) sum to one exactly. P(w) is discounted in the same way, and
what is taken off is the probability of the one unknown word. A text is its words and one end token; before the first
word stands a beginning.

Tables are partitioned by hash. The vocabulary gives each word a number, by falling count: so a word's count follows
from its number through a short list of steps (at most sqrt(2 N) counts differ in N tokens). Counts of pairs are
gathered per context, and each pack of documents is sent the counts of its own pairs and the sums of its contexts. A
context that holds more than a quarter of a bucket's share of all tokens is split over several buckets by its next
word, and packs add up the parts' sums. Nothing is sampled or cut off; all figures cover all training texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knigovod.llm import words as W
from knigovod.llm.packs import Pack, bucket_of, cuts, length, load, load_sorted, pack, store, store_sorted
from knigovod.llm.shared import buckets_for, staged, text_bytes

CUTOFF = 5
#: Bytes of text in a pack; its pairs take about ten times as much.
PACK_BYTES = 5 << 20
END = np.uint64(0x9D5C0FFEE1234567)

RUNS = "kind int, bucket bigint, keys binary, counts binary"
COUNTED = "kind int, bucket bigint, keys binary, counts binary, c array<bigint>, n array<bigint>"
ASKED = "bucket bigint, pack bigint, keys binary"
ANSWERED = "pack bigint, kind int, bucket bigint, one binary, two binary, three binary"
PAIRS = "bucket bigint, pack bigint, contexts binary, sizes binary, nexts binary, counts binary"


def discounts(n: list[int], cutoff: int = CUTOFF) -> np.ndarray:
    """d(0..cutoff + 1) from n[r], the number of kinds seen r times (r up to cutoff + 1); the last stands for all
    higher counts. Where Good-Turing gives no factor between 0 and 1 (small or odd samples), absolute discounting by
    n1 / (n1 + 2 n2), or a half, takes its place at that level."""
    d = np.ones(cutoff + 2)
    if all(n[r] > 0 for r in range(1, cutoff + 2)):
        mu = (cutoff + 1) * n[cutoff + 1] / n[1]
        if mu < 1:
            for r in range(1, cutoff + 1):
                d[r] = ((r + 1) * n[r + 1] / (n[r] * r) - mu) / (1 - mu)
            if all(0 < d[r] < 1 for r in range(1, cutoff + 1)):
                return d
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d[1:cutoff + 1] = [(r - off) / r for r in range(1, cutoff + 1)]
    return d


class Tokens:
    """The tokens of a pack: hash, document and place of each word, with an end after each document."""

    def __init__(self, p: Pack):
        starts, ends = W.words(p.bytes)
        document = W.document_of(p, starts)
        n = len(p.ids)
        counts = np.bincount(document, minlength=n)
        self.sizes = counts + 1
        self.last = np.cumsum(self.sizes) - 1
        self.first = self.last - counts
        self.hashes = np.empty(len(starts) + n, np.uint64)
        self.hashes[np.arange(len(starts)) + document] = W.word_hashes(p.bytes, starts, ends)
        self.hashes[self.last] = END
        self.train = np.repeat(p.flags, self.sizes)


def _runs(packs: DataFrame, buckets: int, bits: int) -> DataFrame:
    """From each pack, sorted runs of the words (kind 1) and pairs (kind 2) of its training texts, with counts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t = Tokens(Pack(pa.Table.from_batches([batch.slice(i, 1)])))
                before = np.concatenate([[np.uint64(0)], t.hashes[:-1]])
                before[t.first] = 0
                pairs = W.mix(before * np.uint64(W.MULTIPLIER) + t.hashes) >> np.uint64(64 - bits)
                for kind, keys, width in ((1, t.hashes[t.train], 64), (2, pairs[t.train], bits)):
                    keys, counts = np.unique(keys, return_counts=True)
                    parts = cuts(bucket_of(keys, buckets, width))
                    yield pa.RecordBatch.from_pydict({
                        "kind": pa.array([kind] * len(parts), pa.int32()), "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
                        "keys": pa.array([store_sorted(keys[lo:hi]) for _, lo, hi in parts], pa.binary()),
                        "counts": pa.array([store(counts[lo:hi].astype(np.uint32)) for _, lo, hi in parts], pa.binary())})

    return packs.mapInArrow(run, RUNS)


def _counted(runs: DataFrame) -> DataFrame:
    """Runs of a bucket, merged: for words, keys and counts; for both kinds, how many keys have each count."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys = np.concatenate([load_sorted(x.as_py()) for x in table.column("keys")])
        counts = np.concatenate([load(x.as_py(), np.uint32) for x in table.column("counts")])
        keys, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, weights=counts).astype(np.int64)
        c, n = np.unique(total if kind == 1 else total[total <= CUTOFF + 1], return_counts=True)
        return pa.table({
            "kind": pa.array([kind], pa.int32()), "bucket": table.column("bucket").slice(0, 1),
            "keys": pa.array([store_sorted(keys) if kind == 1 else None], pa.binary()),
            "counts": pa.array([store(total) if kind == 1 else None], pa.binary()),
            "c": pa.array([c], pa.list_(pa.int64())), "n": pa.array([n], pa.list_(pa.int64()))})

    return runs.groupBy("kind", "bucket").applyInArrow(run, COUNTED)


class Model:
    """What all tasks know: the steps from a word's number to its count, and the discounts of both levels."""

    def __init__(self, words: dict[int, int], pairs: dict[int, int], texts: int):
        self.levels = np.array(sorted(words, reverse=True), np.int64)
        sizes = np.array([words[c] for c in self.levels.tolist()], np.int64)
        self.bases = np.cumsum(sizes) - sizes
        self.known = int(sizes.sum())
        self.total = int((self.levels * sizes).sum())
        self.texts = texts
        self.unknown, self.begin = self.known, self.known + 1
        top = CUTOFF + 1
        self.d2 = discounts([0] + [pairs.get(r, 0) for r in range(1, top + 1)])
        d1 = discounts([0] + [words.get(r, 0) for r in range(1, top + 1)])
        taken = d1[np.minimum(self.levels, top)] * self.levels
        room = self.total if (taken < self.levels).any() else self.total + 1
        self.chances = np.append(taken / room, 0.0) if self.total else np.zeros(1)
        self.chances[-1] = 1.0 - float((self.chances[:-1] * sizes).sum())

    def step(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers >= self.known, len(self.levels), np.searchsorted(self.bases, numbers, "right") - 1)

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """How often the training texts hold each word; for the beginning, how many texts there are."""
        out = np.append(self.levels, 0)[self.step(numbers)]
        out[numbers == self.begin] = self.texts
        return out

    def chance(self, numbers: np.ndarray) -> np.ndarray:
        """P(w)."""
        return self.chances[self.step(numbers)]

    def keys(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Pairs as one number each, in the order of context and word; -1 stands for no word. There is room for 4e9 words."""
        return contexts.astype(np.uint64) * np.uint64(self.known + 3) + (words + 1).astype(np.uint64)

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and words of such numbers."""
        contexts, words = np.divmod(keys, np.uint64(self.known + 3))
        return contexts.astype(np.int64), words.astype(np.int64) - 1

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return self.d2[np.minimum(counts, CUTOFF + 1)] * counts

    def parts(self, contexts: np.ndarray, buckets: int) -> np.ndarray:
        """Over how many buckets each context is split."""
        return np.maximum(1, -(-4 * buckets * self.count(contexts) // max(self.total, 1)))


def _asked_words(packs: DataFrame, buckets: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        p = Pack(table)
        keys = np.unique(Tokens(p).hashes)
        parts = cuts(bucket_of(keys, buckets))
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()), "pack": pa.array([p.number] * len(parts), pa.int64()),
            "keys": pa.array([store_sorted(keys[lo:hi]) for _, lo, hi in parts], pa.binary())})

    return packs.groupBy("pack").applyInArrow(run, ASKED)


def _numbers(asked: DataFrame, vocabulary: DataFrame, model: Model) -> DataFrame:
    """To each pack, the numbers of its words, in the order it asked in."""

    def run(asks: pa.Table, words: pa.Table) -> pa.Table:
        if words.num_rows:
            keys = load_sorted(words.column("keys")[0].as_py())
            counts = load(words.column("counts")[0].as_py(), np.int64)
            # Words of one count are numbered one after the other within a bucket, and bucket after bucket.
            c = np.array([x["c"] for x in words.column("before")[0].as_py()], np.int64)
            before = np.array([x["before"] for x in words.column("before")[0].as_py()], np.int64)
            order = np.argsort(counts, kind="stable")
            ranked = counts[order]
            inner = np.arange(len(order)) - np.searchsorted(ranked, ranked, "left")
            base = model.bases[np.searchsorted(-model.levels, -ranked)]
            number = np.empty(len(keys), np.int64)
            number[order] = base + before[np.searchsorted(c, ranked)] + inner
        else:
            keys, number = np.empty(0, np.uint64), np.empty(0, np.int64)
        out = []
        for blob in asks.column("keys"):
            wanted = load_sorted(blob.as_py())
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            out.append(store(np.where(found, number[at] if len(keys) else 0, model.unknown).astype(np.int64)))
        n = len(out)
        none = pa.array([None] * n, pa.binary())
        return pa.table({"pack": asks.column("pack"), "kind": pa.array([1] * n, pa.int32()), "bucket": asks.column("bucket"),
                         "one": pa.array(out, pa.binary()), "two": none, "three": none})

    return asked.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(run, ANSWERED)


def _blobs(table: pa.Table, kind: int) -> list[dict]:
    """A pack's answers of one kind, in the order of buckets."""
    return sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])


class Pairs:
    """The distinct pairs of a pack in the order of its questions, and where each token's pair is."""

    def __init__(self, p: Pack, t: Tokens, answers: pa.Table, model: Model, buckets: int):
        keys, where = np.unique(t.hashes, return_inverse=True)
        runs = [load(r["one"], np.int64) for r in _blobs(answers, 1)]
        self.words = np.concatenate(runs)[where] if runs else np.full(len(where), model.unknown)
        del keys, where, runs
        keys, pair = np.unique(model.keys(self.contexts(t, model), self.words), return_inverse=True)
        c, w = model.split(keys)
        del keys
        counts = np.bincount(pair[t.train], minlength=len(c))
        # Every part of a split context is asked about, with no pair if the pack has none there.
        parts = model.parts(c, buckets)
        own = np.where(parts > 1, (W.mix(w.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0)
        split = np.unique(c[parts > 1])
        n_parts = model.parts(split, buckets)
        extra_c = np.repeat(split, n_parts)
        extra_part = np.arange(len(extra_c)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        c, w = np.concatenate([c, extra_c]), np.concatenate([w, np.full(len(extra_c), -1)])
        part, counts = np.concatenate([own, extra_part]), np.concatenate([counts, np.zeros(len(extra_c), np.int64)])
        del parts, own, extra_c, extra_part
        bucket = bucket_of(W.mix(c.astype(np.uint64) + part.astype(np.uint64) * np.uint64(W.MULTIPLIER)), buckets)
        del part
        by = np.lexsort((model.keys(c, w), bucket))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.pair = place[pair]
        del pair, place
        self.bucket, self.c, self.w, self.counts = bucket[by], c[by], w[by], counts[by]
        # Groups: all of one context that is in one bucket. Parts that meet there are answered by one sum, so they make one group.
        self.group_starts = np.flatnonzero(np.concatenate([[True], (self.c[1:] != self.c[:-1]) | (self.bucket[1:] != self.bucket[:-1])]))

    def contexts(self, t: Tokens, model: Model) -> np.ndarray:
        """The word before each token."""
        out = np.concatenate([[model.begin], self.words[:-1]])
        out[t.first] = model.begin
        return out


def _asked_pairs(packs: DataFrame, numbers: DataFrame, model: Model, buckets: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Pack(left)
        q = Pairs(p, Tokens(p), right, model, buckets)
        sizes = np.diff(np.append(q.group_starts, len(q.c)))
        rows = []
        for b, lo, hi in cuts(q.bucket[q.group_starts]):
            a, z = int(q.group_starts[lo]), int(q.group_starts[hi]) if hi < len(q.group_starts) else len(q.c)
            rows.append((b, store(q.c[q.group_starts[lo:hi]] * np.int64(1)), store(sizes[lo:hi].astype(np.uint32)),
                         store(q.w[a:z] + 1), store(q.counts[a:z].astype(np.uint32))))
        b, contexts, sizes_, nexts, counts = zip(*rows) if rows else ([], [], [], [], [])
        return pa.table({
            "bucket": pa.array(b, pa.int64()), "pack": pa.array([p.number] * len(b), pa.int64()),
            "contexts": pa.array(contexts, pa.binary()), "sizes": pa.array(sizes_, pa.binary()),
            "nexts": pa.array(nexts, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return packs.groupBy("pack").cogroup(numbers.groupBy("pack")).applyInArrow(run, PAIRS)


def _contexts(asked: DataFrame, model: Model) -> DataFrame:
    """To each pack: the counts of its pairs; for its contexts, the sums of discounted counts and of P(w) over all
    next words that the training texts hold in this bucket."""

    def run(table: pa.Table) -> pa.Table:
        # A bucket is held as one number and one count for each pair of each pack; contexts are read again for the answers.
        edges = np.cumsum([0, *(length(x.as_py()) for x in table.column("nexts"))])
        keys, n = np.empty(edges[-1], np.uint64), np.empty(edges[-1], np.uint32)
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            contexts, sizes, nexts, counts = (table.column(name)[i].as_py() for name in ("contexts", "sizes", "nexts", "counts"))
            keys[a:b] = model.keys(np.repeat(load(contexts, np.int64), load(sizes, np.uint32)), load(nexts, np.int64) - 1)
            n[a:b] = load(counts, np.uint32)
        keys, pair = np.unique(keys, return_inverse=True)
        total = np.bincount(pair, weights=n).astype(np.int64)
        one = [store(total[pair[a:b]].astype(np.uint32)) for a, b in zip(edges[:-1], edges[1:])]
        del pair, n
        pc, pw = model.split(keys)
        del keys
        seen = total > 0
        known, of = np.unique(pc, return_inverse=True)
        kept = np.bincount(of, weights=np.where(seen, model.discounted(total), 0.0))
        lower = np.bincount(of, weights=np.where(seen, model.chance(np.maximum(pw, 0)), 0.0))
        two, three = [], []
        for contexts in table.column("contexts"):
            at = np.searchsorted(known, load(contexts.as_py(), np.int64))
            two.append(store(kept[at]))
            three.append(store(lower[at]))
        return pa.table({
            "pack": table.column("pack"), "kind": pa.array([2] * len(one), pa.int32()), "bucket": table.column("bucket"),
            "one": pa.array(one, pa.binary()), "two": pa.array(two, pa.binary()), "three": pa.array(three, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def katz_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out (not `train`), n_tokens, n_known, train_tokens, base_score, score (log10) for each row.

    The model is learned from the rows where `train` holds (null: it does not). Null, empty and blank texts are one
    end token. Without training texts all words are the unknown word, of probability 1. Rows that repeat count as
    often as they occur. Other columns are not read."""
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    buckets = buckets_for(spark, size)
    # So many bits that about one pair in a million meets another; only counts of counts are taken from these keys.
    bits = min(64, max(48, math.ceil(math.log2(size + 2)) + 18))
    packs = pack(docs, doc_id, text, PACK_BYTES, F.coalesce(train, F.lit(False)))
    counted = staged(_counted(_runs(packs, buckets, bits)), "katz")
    how = counted.select("kind", "bucket", F.explode(F.arrays_zip("c", "n")).alias("x")).select("kind", "bucket", "x.c", "x.n")
    sums: dict[int, dict[int, int]] = {1: {}, 2: {}}
    for kind, c, n in how.groupBy("kind", "c").agg(F.sum("n")).collect():
        sums[kind][c] = n
    texts = docs.filter(F.coalesce(train, F.lit(False))).count()
    model = Model(sums[1], sums[2], texts)
    so_far = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = how.filter("kind = 1").withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    before = before.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("c", "before"))).alias("before"))
    vocabulary = counted.filter("kind = 1").select("bucket", "keys", "counts").join(before, "bucket")
    numbers = _numbers(_asked_words(packs, buckets), vocabulary, model)
    contexts = _contexts(_asked_pairs(packs, numbers, model, buckets), model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Pack(left)
        t = Tokens(p)
        q = Pairs(p, t, right, model, buckets)
        answers = _blobs(right, 2)
        pair_counts = np.concatenate([load(r["one"], np.uint32) for r in answers]).astype(np.int64)
        kept = np.concatenate([load(r["two"], np.float64) for r in answers])
        lower = np.concatenate([load(r["three"], np.float64) for r in answers])
        # Sums of a split context over the buckets its parts are in; every group is one bucket.
        known, of = np.unique(q.c[q.group_starts], return_inverse=True)
        kept, lower = np.bincount(of, weights=kept), np.bincount(of, weights=lower)
        total = model.count(known).astype(np.float64)
        # Where no count is discounted, one more observation leaves room for the others.
        room = np.where((total > 0) & (kept >= total * (1 - 1e-12)), total + 1, total)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(total > 0, (1 - kept / room) / np.maximum(1 - lower, 1e-300), 1.0)
        context = np.searchsorted(known, q.contexts(t, model))
        count = pair_counts[q.pair]
        chance = np.where(count > 0, model.discounted(count) / np.maximum(room[context], 1), alpha[context] * model.chance(q.words))
        del answers, pair_counts, context, count
        seen = model.count(q.words)
        base = np.log10((seen + 0.5) / (model.total + 0.5 * (model.known + 1)))
        add = lambda x: np.add.reduceat(x, t.first)  # noqa: E731  every document has at least its end
        n = len(p.ids)
        return pa.table({
            "doc_id": pa.array(p.ids, pa.int64()), "held_out": pa.array(~p.flags, pa.bool_()),
            "n_tokens": pa.array(t.sizes, pa.int64()), "n_known": pa.array(add((seen > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([model.total] * n, pa.int64()), "base_score": pa.array(add(base), pa.float64()),
            "score": pa.array(add(np.log10(chance)), pa.float64())})

    answers = numbers.unionByName(contexts)
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, OUT)
