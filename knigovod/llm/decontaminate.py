"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items are put into one suffix automaton. A document's words are streamed through it: the state
says the longest stretch that ends at this word and occurs in some item. Wherever that length reaches the window (ten
words), the last ten words are a window of an item and are hit. An item of fewer words, but not none, is one window.

Repeated items are taken once, longer ones in overlapping pieces, and put into blocks of about `BLOCK_WORDS` words by
running counts, so the automaton in a task has a fixed bound. One block is one pass over the documents, which are not
shuffled for it. Where there are more, a pass for each `SIEVE_BLOCKS` of them first finds the documents that share the hash
of a window with an item; only these meet the automata, block by block.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from knigovod.llm.shared import staged

WINDOW = 10
BLOCK_WORDS = 100_000
#: Blocks whose window hashes, 8 bytes for each word, are sent to the tasks together.
SIEVE_BLOCKS = 40

#: Bytes of words: 0-9, a-z and all of non-ASCII characters; A-Z are lower-cased, the rest separates.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """The suffix automaton of several word sequences; `found` streams a document through it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.moves: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        short: list[tuple[int, int, str]] = []
        for name, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
                ends.append((last, name))
            if 0 < len(words) < window:
                short.append((last, len(words), name))
        n = len(self.link)
        order = sorted(range(1, n), key=self.length.__getitem__)
        # A state belongs to the items that it occurs in; needed only where it stands for strings of window length.
        held: list[set | None] = [None] * n
        for state, name in ends:
            if self.length[state] >= window:
                held[state] = (held[state] or set()) | {name}
        for state in reversed(order):
            up = self.link[state]
            if held[state] and self.length[up] >= window:
                held[up] = (held[up] or set()) | held[state]
        #: For each state of window length or more, the items of the window that ends there.
        self.items: list = [None] * n
        for state in order:
            if self.length[state] >= window:
                up = self.link[state]
                self.items[state] = self.items[up] if self.length[up] >= window else frozenset(held[state] or ())
        #: For each state, (length, items) of the short items that end there.
        self.short: list = [()] * n
        if short:
            own: dict[int, dict[int, set]] = {}
            for state, size, name in short:
                own.setdefault(state, {}).setdefault(size, set()).add(name)
            for state in order:
                self.short[state] = self.short[self.link[state]] + tuple((s, frozenset(x)) for s, x in own.get(state, {}).items())
        self.has_short = bool(short)

    def _clone(self, state: int, length: int) -> int:
        self.moves.append(dict(self.moves[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.link) - 1

    def _redirect(self, start: int, word: bytes, old: int, new: int) -> None:
        while start != -1 and self.moves[start].get(word) == old:
            self.moves[start][word] = new
            start = self.link[start]

    def _extend(self, last: int, word: bytes) -> int:
        known = self.moves[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            copy = self._clone(known, self.length[last] + 1)
            self._redirect(last, word, known, copy)
            self.link[known] = copy
            return copy
        self.moves.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, at = len(self.link) - 1, last
        while at != -1 and word not in self.moves[at]:
            self.moves[at][word] = new
            at = self.link[at]
        if at != -1:
            target = self.moves[at][word]
            if self.length[target] == self.length[at] + 1:
                self.link[new] = target
            else:
                copy = self._clone(target, self.length[at] + 1)
                self._redirect(at, word, target, copy)
                self.link[target] = self.link[new] = copy
        return new

    def found(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """(spans of hit words, end exclusive; items; the longest match)."""
        spans: list[list[int]] = []
        items: set[str] = set()
        moves, link, length, window = self.moves, self.link, self.length, self.window
        state = size = longest = 0
        for at, word in enumerate(words):
            to = moves[state].get(word)
            if to is None:
                while state:
                    state = link[state]
                    to = moves[state].get(word)
                    if to is not None:
                        break
                if to is None:
                    size = 0
                    continue
                size = length[state]
            state = to
            size += 1
            if size >= window:
                self._hit(spans, at + 1 - window, at + 1)
                items |= self.items[state]
                longest = max(longest, size)
            elif self.has_short:
                longest = max(longest, size)
            if self.has_short:
                for own, names in self.short[state]:
                    if own <= size:
                        self._hit(spans, at + 1 - own, at + 1)
                        items |= names
        return spans, items, longest

    @staticmethod
    def _hit(spans: list[list[int]], low: int, high: int) -> None:
        while spans and spans[-1][0] >= low:
            spans.pop()
        if spans and spans[-1][1] >= low:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])


def _pairs(items: list) -> list[tuple[str, list[bytes]]]:
    return [("" if i is None else str(i), words_of((t or "").encode())) for i, t in items]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_words: int, window: int = WINDOW) -> tuple[DataFrame, int]:
    """(i, t, b): the words of the items and the block of each, and how many blocks there are. A block has `block_words`
    words and part of an item more at most. An item of more words than that is cut into pieces that share a window less one."""
    most = max(block_words, 4 * window)

    def run(batches):
        for batch in batches:
            names, texts, sizes = [], [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(value.as_py() or b"")
                for low in range(0, max(len(words) - window + 1, min(len(words), 1)), most - window + 1):
                    piece = words[low:low + most]
                    names.append(name)
                    texts.append(b" ".join(piece).decode())
                    sizes.append(len(piece))
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(names, pa.string()), "t": pa.array(texts, pa.string()), "n": pa.array(sizes, pa.int64())})

    given = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    pieces = staged(given.mapInArrow(run, "i string, t string, n bigint").dropDuplicates(["i", "t"]), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    # Running counts: over the cells, of which a block has four, and inside of each.
    cells = max(1, 4 * total // block_words)
    placed = pieces.withColumn("cell", F.pmod(F.xxhash64("i", "t"), F.lit(cells)))
    bases, before = [], 0
    for row in placed.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect():
        bases.append((row["cell"], before))
        before += row["n"]
    if not bases:
        return pieces.select("i", "t", F.lit(0).cast("bigint").alias("b")), 1
    known = benchmark.sparkSession.createDataFrame(bases, "cell bigint, base bigint")
    inside = F.sum("n").over(Window.partitionBy("cell").orderBy("i", "t").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = placed.withColumn("inside", inside).join(F.broadcast(known), "cell")
    place = F.floor((F.col("base") + F.col("inside")) / block_words)
    return staged(placed.select("i", "t", place.alias("b")), "blocks"), (total - 1) // block_words + 1


def _block(listed: DataFrame, b: int, blocks: int) -> list:
    return listed.filter(F.col("b") == b).select("i", "t").collect()


def _sent(listed: DataFrame, b: int, blocks: int):
    """The items of a block, sent to the tasks: of bounded size by how blocks are made."""
    return listed.sparkSession.sparkContext.broadcast(_pairs(_block(listed, b, blocks)))


def _keys(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each `size` words in a row."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[k:len(words) - size + 1 + k]
    return out


def _sift(docs: DataFrame, sieve, text: str, hit: bool) -> DataFrame:
    """The rows that share, or do not share, the hash of a window with the items of a sieve."""
    at = docs.columns.index(text)

    def run(batches):
        sizes, keys = sieve.value
        for batch in batches:
            keep = []
            for value in batch.column(at):
                words = words_of((value.as_py() or "").encode())
                met = False
                for size in sizes:
                    own = _keys(words, size)
                    place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                    met = met or bool(len(keys) and (keys[place] == own).any())
                keep.append(met == hit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _sifted(docs: DataFrame, listed: DataFrame, blocks: int, window: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows without a word of any item's window, the others, written): a superset of what the automata find."""

    def run(table: pa.Table) -> pa.Table:
        sizes, keys = set(), [np.empty(0, np.uint64)]
        for value in table.column("t"):
            words = value.as_py().encode().split()
            sizes.add(min(len(words), window))
            keys.append(_keys(words, min(len(words), window)))
        return pa.table({"sizes": pa.array([sorted(sizes)], pa.list_(pa.int64())), "keys": [np.unique(np.concatenate(keys)).tobytes()]})

    suspects = None
    for low in range(0, blocks, SIEVE_BLOCKS):
        group = listed.filter(F.col("b").between(low, low + SIEVE_BLOCKS - 1)).groupBy(F.lit(0).alias("g"))
        # One group of a bounded number of words, and one row of it.
        row = group.applyInArrow(run, "sizes array<bigint>, keys binary").first()
        sieve = docs.sparkSession.sparkContext.broadcast((row["sizes"], np.frombuffer(row["keys"], np.uint64)) if row else ([], np.empty(0, np.uint64)))
        found = staged(_sift(docs, sieve, text, True), "suspects")
        suspects = found if suspects is None else suspects.unionByName(found)
        docs = _sift(docs, sieve, text, False)
    return docs, suspects


FOUND = "n_words bigint, spans array<struct<low:int,high:int>>, items array<string>"


SPAN = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _scanned(docs: DataFrame, pairs, window: int, carried: bool = False, last: bool = True) -> DataFrame:
    """The rows of `docs` (doc_id, text) with the columns of FOUND, for one block of items, put to those of the blocks before
    if these are `carried`. The text goes at the last block. The rows stay where they are."""

    def run(batches):
        automaton = Automaton(pairs.value if pairs else [], window)
        for batch in batches:
            sizes, spans, names = [], [], []
            known = zip(*(batch.column(k).to_pylist() for k in (3, 4))) if carried else [((), ())] * batch.num_rows
            for value, (marked, listed) in zip(batch.column(1), known):
                words = words_of((value.as_py() or "").encode())
                s, i, _ = automaton.found(words)
                sizes.append(len(words))
                spans.append([{"low": a, "high": b} for a, b in _merged([*((x["low"], x["high"]) for x in marked), *map(tuple, s)])])
                names.append(sorted({*listed, *i}))
            kept = {"doc_id": batch.column(0)} | ({} if last else {"text": batch.column(1)})
            yield pa.RecordBatch.from_pydict(kept | {
                "n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, SPAN), "items": pa.array(names, pa.list_(pa.string()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ("" if last else "text string, ") + FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings), items_sha256, spans (of words, end exclusive),
    contaminated (n_hit > 0) for each row of `docs`.

    Null and empty texts have no words and are clean; null or wordless items match nothing; an item without an id is
    reported as ''. Repeated items count once by id. With no items, all documents are clean. Repeated rows give
    repeated results. Other columns are not read."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    listed, blocks = _blocks(benchmark, item_id, item_text, block_words, window)
    if blocks == 1:
        found = _scanned(given, _sent(listed, 0, 1), window)
    else:
        clean, found = _sifted(given, listed, blocks, window, "text")
        for b in range(blocks):
            found = staged(_scanned(found, _sent(listed, b, blocks), window, b > 0, b == blocks - 1), "contamination")
        found = found.unionByName(_scanned(clean, None, window))
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.high - s.low)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "spans", (hit > 0).alias("contaminated"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of several blocks in order, overlapping and adjoining ones put together."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and out[-1][1] >= low:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without spans of words, from the first letter of each span to its last; what separates words stays."""
    at = [m.span() for m in WORD.finditer(text.translate(WORD_BYTES))]
    cuts = [0, *(k for low, high in spans for k in (at[low][0], at[high - 1][1])), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _marked(docs: DataFrame, pairs, window: int, text: str, marks: str, last: Callable | None) -> DataFrame:
    """The rows with a column `marks`, the spans that this block of items hits put to those of the blocks before. At the last
    block, `last` (words, spans -> whether the row stays, whether its text is cut) is applied instead and `marks` goes.
    Rows stay where they are."""
    at, columns = docs.columns.index(text), [c for c in docs.columns if c != marks]
    before = len(columns) < len(docs.columns)

    def run(batches):
        automaton = Automaton(pairs.value, window)
        for batch in batches:
            known = batch.column(len(columns)).to_pylist() if before else [()] * batch.num_rows
            spans_of, keep, texts = [], [], []
            for value, earlier in zip(batch.column(at), known):
                raw = (value.as_py() or "").encode()
                words = words_of(raw)
                spans = _merged([*((x["low"], x["high"]) for x in earlier), *map(tuple, automaton.found(words)[0])])
                if last is None:
                    spans_of.append([{"low": a, "high": b} for a, b in spans])
                else:
                    stays, cut = last(len(words), spans)
                    keep.append(stays)
                    texts.append(without_spans(raw, spans).decode() if stays and cut and spans else value.as_py())
            arrays = [batch.column(k) for k in range(len(columns))]
            if last is None:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans_of, SPAN)], names=[*columns, marks])
            else:
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep, pa.bool_()))

    schema = StructType([f for f in docs.schema.fields if f.name != marks])
    return docs.mapInArrow(run, schema if last else schema.add(marks, ArrayType(StructType().add("low", IntegerType()).add("high", IntegerType()))))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, max_words: int = 0, max_coverage: float = 0.0, block_words: int = BLOCK_WORDS,
                   cut: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, without the documents of which the items, all blocks together, hit more than
    `max_words` words and more than a share of `max_coverage`. By default any hit excludes a document. With `cut`, the
    texts of those that stay lose the words that are hit; what then meets is not searched again. Nulls, empty texts
    and repeated rows as in `contamination`; columns of any name are kept."""

    def last(n_words: int, spans: list[tuple[int, int]]) -> tuple[bool, bool]:
        hit = sum(b - a for a, b in spans)
        return hit <= max_words or hit <= max_coverage * n_words, cut

    marks = "_".join(["spans", *docs.columns])  # longer than any name given
    listed, blocks = _blocks(benchmark, item_id, item_text, block_words, window)
    if blocks == 1:
        return _marked(docs, _sent(listed, 0, 1), window, text, marks, last)
    clean, found = _sifted(docs, listed, blocks, window, text)
    for b in range(blocks):
        found = staged(_marked(found, _sent(listed, b, blocks), window, text, marks, last if b == blocks - 1 else None), "contamination")
    return clean.unionByName(found)
