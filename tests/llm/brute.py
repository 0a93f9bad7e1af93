"""Plain versions of the operators, without Spark, for small inputs. `docs` is a list of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- Fingerprints ---------------------------------------------------------------------------------------------------

M64 = (1 << 64) - 1


def turned(x, by):
    return ((x << by) | (x >> (64 - by))) & M64 if by else x


def winnowed(text, gram=5, window=8):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    if len(h) >= gram:
        grams = []
        for i in range(len(h) - gram + 1):
            value = 0
            for j in range(gram):
                value ^= turned(h[i + j], gram - 1 - j)
            grams.append(value)
    elif h:
        a = 0
        for x in h:
            first = xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()
            a = xxhash.xxh64(x.to_bytes(8, "little"), seed=first).intdigest()
        grams = [a]
    else:
        return []
    out = []
    for i in range(max(len(grams) - window, 0) + 1):
        part = [(g >> 28, -(i + k)) for k, g in enumerate(grams[i:i + window])]
        least = min(part)
        if (least[0], -least[1]) not in out:
            out.append((least[0], -least[1]))
    return out


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprints(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        f, e, n = winnowed(t), winnowed(edited), winnowed(following)
        as_text = lambda x: " ".join(f"{h:X}@{p}" for h, p in x)
        out.append((i, len(t), sha(edited), as_text(f), as_text(e), alike(f, e), alike(f, n)))
    return out


# --- Decontamination --------------------------------------------------------------------------------------------------


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for name, text in items:
        words = BENCH_WORD.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i:i + size])].add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words = BENCH_WORD.findall(lower(text))
        hit, names = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                found = windows.get(tuple(words[k:k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= found
        out.append((i, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


# --- Similarity classes -----------------------------------------------------------------------------------------------


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def similarity_classes(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holding = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holding[g].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holding[g] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = root(i)
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)]


# --- Repeated bytes ---------------------------------------------------------------------------------------------------


def remove_repeats(docs, length=50):
    texts = [(math.inf if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            w = t[k:k + length]
            if first.get(w, math.inf) > i:
                first[w] = i
    out = []
    for (i, _), (order, t) in zip(docs, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first.get(t[k:k + length], math.inf) < order:
                gone[k:k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(t), sum(gone), runs, sha(kept)))
    return out


# --- Katz -------------------------------------------------------------------------------------------------------------


def katz(docs, train, discounts, cutoff=5):
    """`train`: a flag per document; `discounts`: the function from counts of counts to factors. Also returns the model."""
    texts = [WORD.findall(lower(t)) + [None] for _, t in docs]
    one, two, follows = Counter(), Counter(), defaultdict(set)
    for words, learn in zip(texts, train):
        if learn:
            for h, w in zip(["<"] + words, words):
                one[w] += 1
                two[h, w] += 1
                follows[h].add(w)
    context = Counter()
    for (h, _), n in two.items():
        context[h] += n
    kinds = lambda c: [0] + [sum(1 for n in c.values() if n == r) for r in range(1, cutoff + 2)]
    d1, d2 = discounts(kinds(one)), discounts(kinds(two))
    total = sum(one.values())
    cut = lambda d, n: d[min(n, cutoff + 1)] * n
    room = total if any(cut(d1, n) < n for n in one.values()) else total + 1
    unknown = 1 - sum(cut(d1, n) for n in one.values()) / room if total else 1.0
    single = lambda w: cut(d1, one[w]) / room if w in one else unknown
    alpha, base = {}, {}
    for h, words in follows.items():
        kept = sum(cut(d2, two[h, w]) for w in words)
        base[h] = context[h] if kept < context[h] * (1 - 1e-12) else context[h] + 1
        alpha[h] = (1 - kept / base[h]) / (1 - sum(single(w) for w in words))

    def chance(h, w):
        if (h, w) in two:
            return cut(d2, two[h, w]) / base[h]
        return alpha.get(h, 1.0) * single(w)

    out = []
    for (i, _), words, learn in zip(docs, texts, train):
        known = sum(1 for w in words if w in one)
        plain = sum(math.log10((one.get(w, 0) + 0.5) / (total + 0.5 * (len(one) + 1))) for w in words)
        score = sum(math.log10(chance(h, w)) for h, w in zip(["<"] + words, words))
        out.append((i, not learn, len(words), known, total, plain, score))
    return out, chance, one


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


# --- Secrets ----------------------------------------------------------------------------------------------------------

SECRETS = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def base_secrets(text):
    found = []
    for k, (_, pattern, group, least) in enumerate(SECRETS):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(SECRETS[k][0], a, b) for a, k, b in sorted(found)]


# --- Mixing -----------------------------------------------------------------------------------------------------------


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, stopped = sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in stopped)
        level = (whole - sum(most * sizes[s] for s in stopped)) / free if free else 0
        more = {s for s in order if s not in stopped and weight[s] * level > most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s]) if s in stopped else weight[s] * level for s in order}
        stopped |= more


# --- Lines ------------------------------------------------------------------------------------------------------------


def line_dedup(docs, chunks):
    """(id, text left). `chunks` cuts a text; what is repeated, and how far around, is found by comparing bytes."""
    cut = []
    for i, t in docs:
        t = (t or "").encode()
        lines = t.split(b"\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        cut.append(((i is not None, i or 0, xxhash.xxh64(t, seed=42).intdigest() ^ (1 << 63)), lines, full, chunks(lines, full)))
    first = {}
    for own, lines, full, found in cut:
        for low, high in found:
            whole = b"\n".join(lines[full[low]:full[high] + 1])
            if whole not in first or (*own, low) < first[whole][0]:
                first[whole] = ((*own, low), (lines, full, found))

    out = []
    for own, lines, full, found in cut:
        gone = set()
        edges = {x for pair in found for x in pair}
        for low, high in found:
            place, (there, others, theirs) = first[b"\n".join(lines[full[low]:full[high] + 1])]
            if place == (*own, low):
                continue
            a, b, x, y = low, high, place[3], dict(theirs)[place[3]]
            other_edges = {e for pair in theirs for e in pair}
            gap = lambda ls, f, k: b"\n".join(ls[f[k] + 1:f[k + 1] + 1])
            lead = lambda ls, f, k: b"\n".join(ls[f[k]:f[k + 1]])
            while b + 1 < len(full) and y + 1 < len(others) and b + 1 not in edges and y + 1 not in other_edges and gap(lines, full, b) == gap(there, others, y):
                b, y = b + 1, y + 1
            while a > 0 and x > 0 and a - 1 not in edges and x - 1 not in other_edges and lead(lines, full, a - 1) == lead(there, others, x - 1):
                a, x = a - 1, x - 1
            gone |= set(range(full[a], full[b] + 1))
        out.append((own[1] if own[0] else None, len(lines), len(found), len(gone), b"\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out
