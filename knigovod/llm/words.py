"""Words of packed texts as numbers, with numpy: positions, 64-bit hashes, hashes of word sequences.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Hashes are polynomials modulo
2**64, mixed at the end; two words of a corpus of 10**8 distinct words meet with a chance of about 3e-4."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that each end with a line feed."""
    space = SPACE[raw]
    before = np.concatenate([[True], space[:-1]]) if len(raw) else space
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(~before & space)
    return starts, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A hash for each word. Worked out in blocks of words that stay in the processor's cache."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, origin + block, "right")))
        last = int(ends[upto - 1])
        n = last - origin + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum((LOWER[raw[origin:last]].astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, n - 1), out=sums[1:])
        low, high = starts[at:upto] - origin, ends[at:upto] - origin
        value = (sums[high] - sums[low]) * powers(inverse, n)[low]
        out[at:upto] = mix(value + (high - low).astype(np.uint64) * np.uint64(STEP))
        at = upto
    return out


def document_of(pack, starts: np.ndarray) -> np.ndarray:
    """Which document each word belongs to."""
    return np.searchsorted(pack.ends, starts, "right")


def shingles(hashes: np.ndarray, document: np.ndarray, n_documents: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every sequence of `width` words; of the whole text if it has fewer words."""
    counts = np.bincount(document, minlength=n_documents)
    first = np.cumsum(counts) - counts
    out_h, out_d = [], []
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        value = np.zeros(n, np.uint64)
        for j in range(width):
            value += hashes[j:j + n] * np.uint64(pow(STEP, j + 1, 1 << 64))
        inside = document[:n] == document[width - 1:]
        out_h.append(mix(value[inside]))
        out_d.append(document[:n][inside])
    for size in range(1, width):
        chosen = np.flatnonzero(counts == size)
        if len(chosen):
            value = np.full(len(chosen), size, np.uint64)
            for j in range(size):
                value += hashes[first[chosen] + j] * np.uint64(pow(STEP, j + 1, 1 << 64))
            out_h.append(mix(value * np.uint64(MULTIPLIER)))
            out_d.append(chosen)
    if not out_h:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)
