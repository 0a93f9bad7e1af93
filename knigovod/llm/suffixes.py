"""Removal of text that an earlier document already has, byte by byte, by sorting suffixes.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller id is removed.

1. Anchors. In every window of `length` bytes the k-gram with the least hash is marked (all of them on a tie), so
   equal windows are marked at equal places. Hashes of marked k-grams are counted over the corpus (`packs`); only
   anchors whose k-gram occurs elsewhere go on.
2. Suffixes. Around such an anchor a window's worth of bytes on either side is kept. Within a bucket of anchors, the
   suffixes that begin at anchors, and the reversed prefixes that end there, are ordered by deep-shallow sorting:
   multikey quicksort up to `SHALLOW` bytes (vectorised, a word of eight bytes at a time), then a blind trie for each
   group that still ties. Neighbours' common prefix lengths say, byte for byte, which windows around two anchors are
   equal, and the smallest id among equal windows says which are removed.
3. Each pack gets its windows back as bit masks and marks the bytes.

Within a pack, equal surroundings are sent once, with their smallest id, and the others are settled at once or get the
answer of the one that was sent; so a passage that a third of all documents hold is sent once per pack, and a run of one
character, in which every place is an anchor, as often as it has different surroundings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knigovod.llm import words as W
from knigovod.llm.packs import Pack, bucket_of, cuts, load, load_sorted, pack, store, store_sorted
from knigovod.llm.shared import buckets_for, text_bytes

LENGTH, GRAM = 50, 24
#: Bytes up to which suffixes are ordered by multikey quicksort; ties beyond go to blind tries.
SHALLOW = 32
KEY_BITS = 48

ASKED = "bucket bigint, pack bigint, keys binary, twice binary"
ANSWERED = "pack bigint, bucket bigint, shared binary"
SENT = "bucket bigint, pack bigint, n bigint, at binary, ids binary, lefts binary, rights binary, around binary, settled binary"
MARKED = "pack bigint, at binary, masks binary, settled binary"


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes, never 0, of all runs of `width` bytes, by doubling."""
    power = raw.astype(np.uint32) + np.uint32(1)
    size, out, done = 1, None, 0
    base = 0x85EBCA6B
    while width:
        if width & 1:
            if out is None:
                out, done = power, size
            else:
                n = len(raw) - done - size + 1
                out = out[:n] * np.uint32(pow(base, size, 1 << 32)) + power[done:done + n]
                done += size
        width >>= 1
        if width:
            n = len(raw) - 2 * size + 1
            power = power[:n] * np.uint32(pow(base, size, 1 << 32)) + power[size:size + n]
            size *= 2
    out = out ^ (out >> np.uint32(15))
    out = out * np.uint32(0x2C1B3C6D)
    return np.maximum(out ^ (out >> np.uint32(13)), np.uint32(1))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or greatest of every `width` values that follow each other."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = pick(values[:len(values) - step], values[step:])
        size += step
    return values


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int, block: int = 1 << 18) -> np.ndarray:
    """Places of all anchors: starts of k-grams that are least in some window within a document."""
    found, span = [], length - gram + 1
    for low in range(0, len(raw), block):
        # Windows that start in [low, low + block).
        piece = raw[low:low + block + length - 1]
        n = len(piece) - length + 1
        if n <= 0:
            continue
        grams = rolling(piece, gram)
        least = sliding(grams, span, np.minimum)[:n].copy()
        # Windows that reach beyond their document's end do not count.
        first, last = np.searchsorted(ends, [low, low + n - 1], "right")
        for d in range(first, min(last + 1, len(ends))):
            least[max(0, max(starts[d], ends[d] - length + 1) - low):max(0, ends[d] + 1 - low)] = 0
        # An anchor's hash is the least of one of the windows around it; those reach `span - 1` back.
        padded = np.concatenate([np.zeros(span - 1, np.uint32), least, np.zeros(span - 1, np.uint32)])
        greatest = sliding(padded, span, np.maximum)
        hit = np.flatnonzero((grams[:len(greatest)] == greatest[:len(grams)]) & (greatest[:len(grams)] > 0))
        found.append(hit + low)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def gram_keys(raw: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of the k-grams at given places."""
    value = np.zeros(len(at), np.uint64)
    for j in range(gram):
        value = value * np.uint64(W.MULTIPLIER) + raw[at + j].astype(np.uint64) + np.uint64(1)
    return W.mix(value)


def _asks(packs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        p = Pack(table)
        at = anchors(p.bytes, p.starts, p.ends, length, gram)
        keys, counts = np.unique(gram_keys(p.bytes, at, gram) >> np.uint64(64 - KEY_BITS), return_counts=True)
        parts = cuts(bucket_of(keys, buckets, KEY_BITS))
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()), "pack": pa.array([p.number] * len(parts), pa.int64()),
            "keys": pa.array([store_sorted(keys[lo:hi]) for _, lo, hi in parts], pa.binary()),
            "twice": pa.array([store((counts[lo:hi] > 1).astype(np.uint8)) for _, lo, hi in parts], pa.binary())})

    return packs.groupBy("pack").applyInArrow(run, ASKED)


def _answers(asks: DataFrame) -> DataFrame:
    """To each pack, in the order of its keys: does the k-gram occur more than once?"""

    def run(table: pa.Table) -> pa.Table:
        runs = [load_sorted(x.as_py()) for x in table.column("keys")]
        twice = np.concatenate([load(x.as_py(), np.uint8) for x in table.column("twice")])
        _, where = np.unique(np.concatenate(runs), return_inverse=True)
        shared = (np.bincount(where, weights=1 + twice) > 1)[where].astype(np.uint8)
        at = np.cumsum([0, *map(len, runs)])
        return pa.table({
            "pack": table.column("pack"), "bucket": table.column("bucket"),
            "shared": pa.array([store(shared[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())})

    return asks.groupBy("bucket").applyInArrow(run, ANSWERED)


#: Anchors whose surroundings are looked at together.
BLOCK = 1 << 16


def _room(p: Pack, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of the document stand before an anchor and after its k-gram, `length - gram` at most."""
    side, document = length - gram, np.searchsorted(p.ends, at, "right")
    return np.minimum(at - p.starts[document], side).astype(np.uint8), np.minimum(p.ends[document] - at - gram, side).astype(np.uint8)


def _around(p: Pack, at: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The bytes around anchors (`length - gram` before, the k-gram, as many after), zero outside the document."""
    side = length - gram
    offsets = np.arange(-side, gram + side)
    out = np.empty((len(at), len(offsets)), np.uint8)
    for low in range(0, len(at), BLOCK):
        part = slice(low, low + BLOCK)
        rows = p.bytes[np.clip(at[part, None] + offsets, 0, len(p.bytes) - 1)]
        rows[(offsets < -left[part, None].astype(np.int64)) | (offsets >= gram + right[part, None].astype(np.int64))] = 0
        out[part] = rows
    return out


def settled_within(p: Pack, at: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, a leader: the first anchor of the pack by id with the same surroundings, itself if there is none;
    and the order that it was found in. Surroundings are told apart by their bytes, in blocks, so that a run of millions
    of equal ones takes a few numbers each."""
    value = np.zeros(len(at), np.uint64)
    for low in range(0, len(at), BLOCK):
        part = slice(low, low + BLOCK)
        rows = np.concatenate([_around(p, at[part], left[part], right[part], length, gram), left[part, None], right[part, None]], axis=1)
        for j in range(rows.shape[1]):
            value[part] = value[part] * np.uint64(W.MULTIPLIER) + rows[:, j].astype(np.uint64)
    order = np.lexsort((ids, W.mix(value)))
    first = np.ones(len(order), bool)
    again = np.flatnonzero(value[order[1:]] == value[order[:-1]]) + 1
    for low in range(0, len(again), BLOCK):
        one, other = order[again[low:low + BLOCK]], order[again[low:low + BLOCK] - 1]
        same = (left[one] == left[other]) & (right[one] == right[other])
        same &= (_around(p, at[one], left[one], right[one], length, gram) == _around(p, at[other], left[other], right[other], length, gram)).all(axis=1)
        first[again[low:low + BLOCK][same]] = False
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    return leader, order


def joined_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        out.append(data[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _all_windows(left: np.ndarray, right: np.ndarray, side: int) -> np.ndarray:
    """Bit o of a mask: the window that starts o bytes before the anchor. Here, all those within the document."""
    out = np.zeros(len(left), np.uint64)
    for o in range(side + 1):
        out |= ((o <= left) & (side - o <= right)).astype(np.uint64) << np.uint64(o)
    return out


def _known_ids(ids: list, at_document: np.ndarray) -> np.ndarray:
    """Ids as numbers; a null id comes after all others."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)[at_document]


def _sent(packs: DataFrame, answers: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    side = length - gram

    def run(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        p = Pack(left_table)
        at = anchors(p.bytes, p.starts, p.ends, length, gram)
        full = gram_keys(p.bytes, at, gram)
        keys = np.unique(full >> np.uint64(64 - KEY_BITS))
        order = np.argsort(np.asarray(right_table.column("bucket")))
        blobs = right_table.column("shared").to_pylist()
        runs = [load(blobs[i], np.uint8) for i in order]
        shared = np.concatenate(runs) if runs else np.empty(0, np.uint8)
        if len(at):
            kept = shared[np.searchsorted(keys, full >> np.uint64(64 - KEY_BITS))] == 1
            at, full = at[kept], full[kept]
        left, right = _room(p, at, length, gram)
        ids = _known_ids(p.ids, np.searchsorted(p.ends, at, "right"))
        leader, _ = settled_within(p, at, left, right, ids, length, gram)
        done = np.flatnonzero(ids > ids[leader])
        # Equal surroundings in documents of one id do not remove each other: one asks for all of them.
        twins = np.flatnonzero((ids == ids[leader]) & (leader != np.arange(len(at))))
        chosen = np.flatnonzero(leader == np.arange(len(at)))
        bucket = bucket_of(full[chosen], buckets)
        by = np.argsort(bucket, kind="stable")
        chosen, bucket = chosen[by], bucket[by]
        parts = cuts(bucket)
        pick = [chosen[lo:hi] for _, lo, hi in parts]
        own = [joined_parts([store(at[done].astype(np.uint32)), store(_all_windows(left[done], right[done], side)),
                             store(at[twins].astype(np.uint32)), store(at[leader[twins]].astype(np.uint32))])] + [None] * (len(parts) - 1)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()), "pack": pa.array([p.number] * len(parts), pa.int64()),
            "n": pa.array([len(i) for i in pick], pa.int64()),
            "at": pa.array([store(at[i].astype(np.uint32)) for i in pick], pa.binary()),
            "ids": pa.array([store(ids[i]) for i in pick], pa.binary()),
            "lefts": pa.array([store(left[i]) for i in pick], pa.binary()),
            "rights": pa.array([store(right[i]) for i in pick], pa.binary()),
            "around": pa.array([squeezed(_around(p, at[i], left[i], right[i], length, gram)) for i in pick], pa.binary()),
            "settled": pa.array(own[:len(parts)], pa.binary())})

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, SENT)


def squeezed(rows: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(rows).tobytes(), codec="zstd", asbytes=True) if rows.size else b""


# --- Deep-shallow sorting ---------------------------------------------------------------------------------------


class BlindTrie:
    """Orders distinct byte strings of one length that share a long prefix. A node knows only the depth at which its
    strings part and the byte of each branch; an insert goes down blindly, compares once with the string it ends at,
    and adds its branch where the two part."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0
        for i in range(1, len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        own = self.strings[i]
        node = self.root
        while not isinstance(node, int):
            depth, branches = node
            node = branches.get(own[depth])
            if node is None:
                node = next(iter(branches.values()))
        other = self.strings[node]
        part = next(j for j in range(len(own)) if own[j] != other[j])
        parent, key, node = None, 0, self.root
        while not isinstance(node, int) and node[0] < part:
            parent, key = node, own[node[0]]
            node = node[1][key]
        if not isinstance(node, int) and node[0] == part:
            node[1][own[part]] = i
            return
        fresh = [part, {other[part]: node, own[part]: i}]
        if parent is None:
            self.root = fresh
        else:
            parent[1][key] = fresh

    def in_order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow(strings: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the length of the common prefix of each row with the one before it in
    that order (the width if equal, 0 for the first)."""
    n, width = strings.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    levels = padded.view(">u8").astype(np.uint64)
    depth = min(levels.shape[1], max(1, shallow // 8))
    # Multikey quicksort, one word at a time: only groups that still tie are sorted by the next word.
    order = np.argsort(levels[:, 0], kind="stable")
    group = np.cumsum(np.concatenate([[0], (np.diff(levels[order, 0]) != 0).astype(np.int64)]))
    for level in range(1, depth):
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((levels[rows, level], group[tied]))]
        key = levels[order, level]
        group = np.cumsum(np.concatenate([[0], ((group[1:] != group[:-1]) | (key[1:] != key[:-1])).astype(np.int64)]))
    # Deep: what still ties. Equal strings are put together first, and a blind trie orders the distinct ones.
    sizes = np.bincount(group)
    tied = np.flatnonzero(sizes[group] > 1)
    if len(tied) and levels.shape[1] > depth:
        rows = order[tied]
        rest = levels[rows][:, depth:]
        uneven = np.flatnonzero((group[tied][1:] == group[tied][:-1]) & (rest[1:] != rest[:-1]).any(axis=1))
        for g in np.unique(group[tied][uneven]):
            low = int(np.searchsorted(group, g))
            high = low + int(sizes[g])
            held: dict[bytes, list[int]] = {}
            for i in order[low:high].tolist():
                held.setdefault(strings[i].tobytes(), []).append(i)
            distinct = list(held)
            order[low:high] = [i for k in BlindTrie(distinct).in_order() for i in held[distinct[k]]]
    ordered = strings[order]
    same = ordered[1:] == ordered[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if n > 1 else np.empty(0, np.int64)
    return order, np.concatenate([[0], common]).astype(np.int64)


def classes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each string, the number of its group of strings that agree up to `depth`."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def removed_windows(around: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each anchor, a mask of the windows around it that also occur at an anchor with a smaller id."""
    side, n = length - gram, len(ids)
    masks = np.zeros(n, np.uint64)
    if n < 2:
        return masks
    forward, forward_common = deep_shallow(np.ascontiguousarray(around[:, side:]))
    # Only anchors whose k-gram another anchor has can be alike.
    grams = classes_at(forward, forward_common, gram)
    alike = np.flatnonzero(np.bincount(grams)[grams] > 1)
    if not len(alike):
        return masks
    backward, backward_common = deep_shallow(np.ascontiguousarray(around[alike, :side][:, ::-1]))
    for o in range(side + 1):
        ahead = classes_at(forward, forward_common, length - o)[alike]
        behind = classes_at(backward, backward_common, o) if o else np.zeros(len(alike), np.int64)
        inside = np.flatnonzero((left[alike] >= o) & (right[alike] >= side - o))
        if len(inside) < 2:
            continue
        key, own = ahead[inside] * np.int64(len(alike) + 1) + behind[inside], ids[alike[inside]]
        by = np.lexsort((own, key))
        start = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        least = own[by][np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))]
        masks[alike[inside[by[own[by] > least]]]] |= np.uint64(1 << o)
    return masks


def _marked(sent: DataFrame, length: int, gram: int) -> DataFrame:
    width = 2 * length - gram

    def run(table: pa.Table) -> pa.Table:
        def all_of(name: str, dtype) -> np.ndarray:
            return np.concatenate([load(x.as_py(), dtype) for x in table.column(name)])

        sizes = table.column("n").to_pylist()
        ids, left, right = all_of("ids", np.int64), all_of("lefts", np.uint8), all_of("rights", np.uint8)
        around = np.concatenate([
            np.frombuffer(pa.decompress(x.as_py(), n * width, codec="zstd", asbytes=True), np.uint8).reshape(n, width)
            if n else np.empty((0, width), np.uint8) for x, n in zip(table.column("around"), sizes)])
        masks = removed_windows(around, left, right, ids, length, gram)
        at = np.cumsum([0, *sizes])
        kept_at, kept_masks = [], []
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            hit = np.flatnonzero(masks[a:b])
            kept_at.append(store(load(table.column("at")[k].as_py(), np.uint32)[hit]))
            kept_masks.append(store(masks[a:b][hit]))
        return pa.table({
            "pack": table.column("pack"), "at": pa.array(kept_at, pa.binary()), "masks": pa.array(kept_masks, pa.binary()),
            "settled": table.column("settled")})

    return sent.groupBy("bucket").applyInArrow(run, MARKED)


def _cover(p: Pack, table: pa.Table, length: int, gram: int) -> np.ndarray:
    """Which bytes of a pack are removed."""
    starts = np.zeros(len(p.bytes) + 1, bool)
    at, masks, twins = [], [], []
    for a, m, s in zip(table.column("at").to_pylist(), table.column("masks").to_pylist(), table.column("settled").to_pylist()):
        at.append(load(a, np.uint32))
        masks.append(load(m, np.uint64))
        if s:
            done, all_windows, *pair = split_parts(s)
            at.append(load(done, np.uint32))
            masks.append(load(all_windows, np.uint64))
            twins.append([load(x, np.uint32) for x in pair])
    if at:
        places, masks = np.concatenate(at), np.concatenate(masks)
        by = np.argsort(places)
        sorted_places = places[by]
        for place, leader in twins:
            where = np.searchsorted(sorted_places, leader)
            found = np.flatnonzero(np.append(sorted_places, np.uint32(0xFFFFFFFF))[where] == leader)
            places = np.concatenate([places, place[found]])
            masks = np.concatenate([masks, masks[by[where[found]]]])
        places = places.astype(np.int64)
        for o in range(length - gram + 1):
            starts[places[(masks >> np.uint64(o)) & np.uint64(1) == 1] - o] = True
    # A byte is covered if one of the `length` windows that hold it is removed.
    sums = np.cumsum(starts, dtype=np.int32)
    return (sums - np.concatenate([np.zeros(length, np.int32), sums])[:len(sums)])[:-1] > 0


OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs), kept (the bytes that are left) for each row; with `digest`,
    `kept_sha256` (lowercase hex) in place of `kept`.

    Texts are UTF-8 bytes; null is empty. Rows with the same doc_id do not remove each other's bytes. A null doc_id
    comes after all others. Strings are judged on the input, not on what is left, and never cross documents. `length`
    may be up to `gram` + 39. Texts are never cut: one longer than a pack is a pack of its own, of up to 4 GB. Other
    columns are not read."""
    if not 8 <= gram <= length <= gram + 39:
        raise ValueError("gram must be at least 8, and length from gram to gram + 39")
    spark = docs.sparkSession
    buckets = buckets_for(spark, text_bytes(docs, text))
    packs = pack(docs, doc_id, text)
    sent = _sent(packs, _answers(_asks(packs, buckets, length, gram)), buckets, length, gram)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Pack(left)
        gone = _cover(p, right, length, gram)
        sums = np.concatenate([[0], np.cumsum(gone)])
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        runs = np.concatenate([[0], np.cumsum(begins)])
        kept = []
        for a, b in zip(p.starts.tolist(), p.ends.tolist()):
            rest = p.raw[a:b] if sums[a] == sums[b] else p.bytes[a:b][~gone[a:b]].tobytes()
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
        return pa.table({
            "doc_id": pa.array(p.ids, pa.int64()), "n_bytes": pa.array(p.lengths, pa.int64()),
            "n_removed": pa.array(sums[p.ends] - sums[p.starts], pa.int64()),
            "n_spans": pa.array(runs[p.ends] - runs[p.starts], pa.int64()),
            "kept_sha256" if digest else "kept": pa.array(kept, pa.string() if digest else pa.binary())})

    schema = OUT.replace("kept binary", "kept_sha256 string") if digest else OUT
    return packs.groupBy("pack").cogroup(_marked(sent, length, gram).groupBy("pack")).applyInArrow(run, schema)
