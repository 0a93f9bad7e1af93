"""Similarity join on sets of word n-grams: all pairs of texts with a Jaccard similarity of at least a threshold.

Method: the n-grams of a text are ordered rarest first (by how often the corpus holds them, then by hash). Two sets
that are similar enough share an n-gram among the first `size - ceil(threshold * size) + 1` of each (prefix filter).
Pairs that meet on a prefix n-gram pass a length filter, a positional filter (how much can still be shared from the
places on where they meet first) and, in the last round, a suffix filter (ranges of hashes that only one of them has bound
the overlap); those that are left are verified once on the whole sets.

Texts with equal sets are one class and are joined as one. Within a prefix n-gram's texts, pairs are not all made:
each round compares the texts with one pivot per n-gram, and joins what is linked into components; the last round
compares all pairs that lie in different components, which is exact. So a group of near copies costs about as many
pairs as it has members, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knigovod.llm import words as W
from knigovod.llm.components import components
from knigovod.llm.packs import Pack, bucket_of, cuts, load, load_sorted, pack, store, store_sorted
from knigovod.llm.shared import buckets_for, staged, text_bytes

WIDTH, PERCENT = 5, 80
#: Bits of an n-gram's hash that are counted; a collision only changes the order, alike for all texts.
KEY_BITS = 48
#: Ranges of hashes per n-gram of a set in the suffix filter, at least; their number is a power of two.
RANGES = 4
#: Rounds of comparing with one pivot per n-gram before the remaining pairs are compared.
PIVOT_ROUNDS = 3

ASKED = "bucket bigint, pack bigint, n bigint, keys binary, counts binary"
ANSWERED = "pack bigint, bucket bigint, values binary"
RECORDS = "kind string, doc_id bigint, n bigint, class bigint, token bigint, place int, grams binary"


def _sets(p: Pack, width: int):
    """(hash, document) of all n-grams of a pack, sorted by document and hash, each once."""
    starts, ends = W.words(p.bytes)
    hashes = W.word_hashes(p.bytes, starts, ends)
    grams, document = W.shingles(hashes, W.document_of(p, starts), len(p.ids), width)
    order = np.lexsort((grams, document))
    grams, document = grams[order], document[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (document[1:] != document[:-1])
    return grams[keep], document[keep]


def _asks(packs: DataFrame, buckets: int, width: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        p = Pack(table)
        grams, _ = _sets(p, width)
        keys, counts = np.unique(grams >> np.uint64(64 - KEY_BITS), return_counts=True)
        parts = cuts(bucket_of(keys, buckets, KEY_BITS))
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()), "pack": pa.array([p.number] * len(parts), pa.int64()),
            "n": pa.array([hi - lo for _, lo, hi in parts], pa.int64()),
            "keys": pa.array([store_sorted(keys[lo:hi]) for _, lo, hi in parts], pa.binary()),
            "counts": pa.array([store(counts[lo:hi].astype(np.uint32)) for _, lo, hi in parts], pa.binary())})

    return packs.groupBy("pack").applyInArrow(run, ASKED)


def _answers(asks: DataFrame) -> DataFrame:
    """To each pack, in the order of its keys: how often the corpus holds each, as 1 + 8 log2 of the count."""

    def run(table: pa.Table) -> pa.Table:
        runs = [load_sorted(x.as_py()) for x in table.column("keys")]
        counts = np.concatenate([load(x.as_py(), np.uint32) for x in table.column("counts")])
        _, where = np.unique(np.concatenate(runs), return_inverse=True)
        total = np.bincount(where, weights=counts)
        level = (1 + np.round(8 * np.log2(total))).astype(np.uint16)[where]
        at = np.cumsum([0, *map(len, runs)])
        return pa.table({
            "pack": table.column("pack"), "bucket": table.column("bucket"),
            "values": pa.array([store(level[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())})

    return asks.groupBy("bucket").applyInArrow(run, ANSWERED)


def _records(packs: DataFrame, answers: DataFrame, width: int, percent: int) -> DataFrame:
    """One row 'text' per document; one row 'set' per class and pack; rows 'prefix' for those prefix n-grams that
    the corpus holds more than once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Pack(left)
        grams, document = _sets(p, width)
        order = np.argsort(np.asarray(right.column("bucket")))
        blobs = right.column("values").to_pylist()
        runs = [load(blobs[i], np.uint16) for i in order]
        level = np.concatenate(runs) if runs else np.empty(0, np.uint16)
        keys = np.unique(grams >> np.uint64(64 - KEY_BITS))
        level = level[np.searchsorted(keys, grams >> np.uint64(64 - KEY_BITS))] if len(grams) else level
        sizes = np.bincount(document, minlength=len(p.ids))
        first = np.cumsum(sizes) - sizes
        # The class of a text: a hash of its set.
        sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(grams ^ np.uint64(W.STEP)), dtype=np.uint64)])
        classes = W.mix((sums[first + sizes] - sums[first]) + sizes.astype(np.uint64) * np.uint64(W.MULTIPLIER)).view(np.int64)
        need = -(-(percent * sizes) // 100)
        prefix = np.where(sizes > 0, sizes - need + 1, 0)
        ranked = np.lexsort((grams, level, document))
        place = np.arange(len(grams)) - first[document]
        g, lv = grams[ranked], level[ranked]
        shared = (place < prefix[document]) & (lv > 1)
        # A class is given out once per pack.
        _, chosen = np.unique(classes, return_index=True)
        mine = np.zeros(len(p.ids), bool)
        mine[chosen] = True
        shared &= mine[document]
        held = np.flatnonzero(np.bincount(document[shared], minlength=len(p.ids)) > 0)
        d = document[shared]
        n_text, n_set, n_prefix = len(p.ids), len(held), len(d)
        none = [None] * n_text
        kinds = ["text"] * n_text + ["set"] * n_set + ["prefix"] * n_prefix
        which = np.concatenate([np.arange(n_text), held, d]).astype(np.int64)
        return pa.table({
            "kind": pa.array(kinds, pa.string()),
            "doc_id": pa.array(p.ids + [None] * (n_set + n_prefix), pa.int64()),
            "n": pa.array(sizes[which], pa.int64()), "class": pa.array(classes[which], pa.int64()),
            "token": pa.array(np.concatenate([np.zeros(n_text + n_set, np.int64), g[shared].view(np.int64)]), pa.int64()),
            "place": pa.array(np.concatenate([np.zeros(n_text + n_set, np.int64), place[shared]]).astype(np.int32), pa.int32()),
            "grams": pa.array(none + [grams[first[i]:first[i] + sizes[i]].tobytes() for i in held] + [None] * n_prefix, pa.binary())})

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, RECORDS)


def _sketches(sets: DataFrame) -> DataFrame:
    """class, bits, half: which of `RANGES` or more ranges of hashes per n-gram hold one, as words of 64 ranges; and
    the same in half as many ranges, for pairs of sets on either side of a power of two."""

    def words(grams: np.ndarray, exponent: int) -> list[int]:
        bits = np.zeros(1 << exponent, np.uint8)
        bits[(grams >> np.uint64(64 - exponent)).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").view(np.int64).tolist()

    def run(batches):
        for batch in batches:
            bits, half = [], []
            for value in batch.column(1):
                grams = np.frombuffer(value.as_py(), np.uint64)
                exponent = max(7, (RANGES * len(grams) - 1).bit_length())
                bits.append(words(grams, exponent))
                half.append(words(grams, exponent - 1))
            yield pa.RecordBatch.from_pydict({
                "class": batch.column(0), "bits": pa.array(bits, pa.list_(pa.int64())), "half": pa.array(half, pa.list_(pa.int64()))})

    return sets.select("class", "grams").mapInArrow(run, "class bigint, bits array<bigint>, half array<bigint>")


def _may_link(percent: int) -> Column:
    """Length and positional filter for two prefix rows `x` and `y` of one n-gram.

    Overlap o of sets of sizes a and b passes if 100 o >= percent (a + b - o)."""
    a, b = F.col("x.n"), F.col("y.n")
    lengths = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    # A pair that links meets at its first common n-gram, and there all that it shares is still to come. Where it
    # meets again later, it need not pass.
    left = F.least(a - F.col("x.place"), b - F.col("y.place"))
    return lengths & ((100 + percent) * left >= F.lit(percent) * (a + b))


def _suffix_filter(percent: int) -> Column:
    """Each range that one set has and the other has not holds an n-gram that they do not share."""

    def alone(p: str, q: str) -> str:
        return f"aggregate(zip_with({p}, {q}, (i, j) -> bit_count(i & ~j)), 0, (s, k) -> s + k)"

    def overlap(p: str, q: str) -> str:
        return f"least(x.n - {alone(p, q)}, y.n - {alone(q, p)})"

    bound = (f"CASE WHEN size(x.bits) = size(y.bits) THEN {overlap('x.bits', 'y.bits')} "
             f"WHEN size(x.half) = size(y.bits) THEN {overlap('x.half', 'y.bits')} "
             f"WHEN size(x.bits) = size(y.half) THEN {overlap('x.bits', 'y.half')} ELSE least(x.n, y.n) END")
    return F.expr(f"{100 + percent} * ({bound}) >= {percent} * (x.n + y.n)")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("s")), "a")
    with_b = with_a.join(sets.select(F.col("class").alias("b"), F.col("grams").alias("t")), "b")
    return with_b.select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint")


def _pairs(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & condition)
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _relabelled(entries: DataFrame, pivots: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of those n-grams whose texts are still in different components. Rows in the component of a pivot are
    marked; the next pivot is not taken from among them."""
    known = labels.withColumnsRenamed({"node": "class", "label": "new"})
    entries = entries.join(known, "class", "left").withColumn("label", F.coalesce("new", "class")).drop("new")
    pivots = pivots.select("token", "class").join(known, "class", "left").select("token", F.coalesce("new", "class").alias("pivot"))
    open_tokens = entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    # An n-gram whose texts have all been in a pivot's component has no pivot of its own any more.
    entries = entries.join(open_tokens, "token", "left_semi").join(pivots, "token", "left")
    marked = F.col("done") | F.coalesce(F.col("label") == F.col("pivot"), F.lit(False))
    return staged(entries.withColumn("done", marked).drop("pivot").select("token", "class", "n", "place", "label", "done"), "prefixes")


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class, component_id for each row of `docs`.

    Null, empty or blank texts have an empty set, link with nothing and are their own component. Rows that repeat a
    doc_id are linked with each other only through their texts; a null doc_id is nobody's component id unless all of
    the component are null. Ties in the order of n-grams go by hash. Other columns of `docs` are not read."""
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    packs = pack(docs, doc_id, text)
    asks = _asks(packs, buckets_for(spark, size), width)
    records = staged(_records(packs, _answers(asks), width, percent), "jaccard")
    texts = records.filter("kind = 'text'").select("doc_id", F.col("n").alias("n_shingles"), "class")
    sets = records.filter("kind = 'set'").groupBy("class").agg(F.first("grams").alias("grams"))
    entries = records.filter("kind = 'prefix'").groupBy("token", "class").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    crowded = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token")
    entries = staged(entries.join(crowded, "token", "left_semi").select(
        "token", "class", "n", "place", F.col("class").alias("label"), F.lit(False).alias("done")), "prefixes")
    sets = staged(sets.join(entries.select("class").distinct(), "class", "left_semi"), "sets")
    links, labels = None, None
    for last in [False] * PIVOT_ROUNDS + [True]:
        if entries.isEmpty():
            break
        if not last:
            # The pivot has the fewest n-grams of its own before this one: it is near the middle of its group.
            pivots = entries.filter("NOT done").groupBy("token").agg(F.min_by(
                F.struct("class", "label", "n", "place"), F.struct(F.col("place") / F.col("n"), "class")).alias("p")).select("token", "p.*")
            pivots = staged(pivots, "pivots")
            found = _pairs(entries, pivots, (F.col("x.label") != F.col("y.label")) & _may_link(percent))
        else:
            open_sets = sets.join(entries.select("class").distinct(), "class", "left_semi")
            sketched = staged(entries.join(_sketches(open_sets), "class"), "sketched")
            found = _pairs(sketched, sketched, (F.col("x.label") < F.col("y.label")) & _may_link(percent) & _suffix_filter(percent))
        new = staged(_verified(found, sets, percent), "links")
        links = new if links is None else links.unionByName(new)
        labels = staged(components(links), "labels")
        if not last:
            entries = _relabelled(entries, pivots, labels)
    if labels is not None:
        texts = texts.join(labels.withColumnsRenamed({"node": "class"}), "class", "left")
    else:
        texts = texts.withColumn("label", F.lit(None).cast("bigint"))
    texts = texts.withColumn("label", F.coalesce("label", "class"))
    smallest = texts.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = texts.filter("n_shingles > 0").join(smallest, "label", "left").select("doc_id", "n_shingles", "class", "component_id")
    alone = texts.filter("n_shingles = 0").select("doc_id", "n_shingles", "class", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, one of each component: the one with the smallest doc_id. Rows of equal id and
    text are one document. Documents without words are components of their own and stay."""
    classes = similarity_classes(docs, doc_id, text, width, percent)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    met = docs.join(kept, F.col(doc_id).eqNullSafe(F.col("_kept")), "left_semi")
    return met.dropDuplicates([doc_id, text])
