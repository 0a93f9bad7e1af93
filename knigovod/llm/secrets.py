"""Secret scans: base patterns, and password strength by the cost of guessing.

Base patterns find assignments of long values to credential names, access keys and long hexadecimal runs. Beyond them,
every value in the context of a credential (`password=x`, `pwd: x`, `password is x`, ...), also one that a base pattern
covers, is held against a guesser. A dynamic program
over the value finds the cheapest segmentation into dictionary words (cost: the word's rank, doubled for capitals),
dates, repeats, keyboard walks and brute-force spans; segments multiply, and n of them cost n! orders. A value that
takes `10 ** LEAST_GUESSES` guesses or more is reported as `guess`; a plain word after "password is" is cheap. So an
assignment with a guess inside holds a strong secret, one without a placeholder or a weak password. The whole value is
rated and reported, however long: what can no longer cost less than the least is not followed.

The dictionary is the corpus's own: all its words of letters by rank, but for those that stand as a value in credential
context, so that copies of a secret do not make it a word. Most values are decided without it, by the cost with no words and
with all words for nothing; each distinct value of the rest is brought together with the ranks of the words in it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knigovod.llm.shared import partitions, staged

DICTIONARY = 30_000
#: log10 of the guesses from which a value in credential context is a secret.
LEAST_GUESSES = 9.0

#: The parts of the assignment pattern; letters of the name in either case.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CONTEXT = re.compile(
    rb"""(?i:(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|api[_ -]?key|access[_ -]?key|pin|login))"""
    rb"""["']?(?:[ \t]*[:=]{1,2}[ \t]*|[ \t]+(?:is|was|are)[ \t]+:?[ \t]*)["']?([^\s"'<>,;]{6,})""")
#: Letters of a dictionary word.
LETTERS = (3, 24)
KINDS = ("assign", "access", "hex", "guess")

#: Rows of a keyboard, and its neighbours by column: fixed values.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACES = {c: (r, k) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}
DATE = re.compile(r"(?:(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\1(?:19|20)?\d\d|(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:19|20)\d\d)")
#: log10 of the guesses for a date: days of a year times years, and separators.
DATE_COST, YEAR_COST, SEPARATOR_COST = math.log10(365 * 120), math.log10(120), math.log10(4)


def hex_runs(raw: bytes, least: int = 16) -> list[tuple[int, int]]:
    """Maximal runs of 0-9a-f of at least `least` bytes."""
    data = np.frombuffer(raw, np.uint8)
    inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    lows, highs = edges[::2], edges[1::2]
    long = highs - lows >= least
    return list(zip(lows[long].tolist(), highs[long].tolist()))


def alphabet(part: str) -> int:
    """How many characters a brute-force guesser must try per place."""
    return (26 * any("a" <= c <= "z" for c in part) + 26 * any("A" <= c <= "Z" for c in part)
            + 10 * any("0" <= c <= "9" for c in part) + 33 * any(not (c.isascii() and c.isalnum()) for c in part)) or 1


def _walk(value: str, at: int, most: float) -> int:
    """End of the longest keyboard walk from `at`, of `most` keys at most: neighbours, one key after the other."""
    end = at + 1
    while end < len(value) and end - at < most:
        one, two = PLACES.get(value[end - 1]), PLACES.get(value[end])
        if one is None or two is None or abs(one[0] - two[0]) > 1 or abs(one[1] - two[1]) > 1 or one == two:
            break
        end += 1
    return end


def _segments(value: str, low: str, i: int, per_place: float, room: float, ranks) -> list[tuple[int, float]]:
    """(end, cost) of the segments from `i`; brute force and walks only as long as they cost no more than `room`."""
    n, out = len(value), []
    for j in range(i + LETTERS[0], min(n, i + LETTERS[1]) + 1):
        rank = ranks.get(low[i:j])
        if rank is not None:
            capitals = sum(1 for c in value[i:j] if c.isupper())
            out.append((j, math.log10(rank + 1) + (math.log10(2) if capitals in (1, j - i) else capitals * math.log10(2))))
    for j in range(i + 4, min(n, i + 10) + 1):
        if DATE.fullmatch(value, i, j):
            digits = sum(c.isdigit() for c in value[i:j])
            out.append((j, (YEAR_COST if j - i == 4 and digits == 4 else DATE_COST) + (SEPARATOR_COST if digits < j - i else 0)))
    for j in range(i + 4, _walk(low, i, room / 0.3 + 1) + 1):
        out.append((j, math.log10(len(PLACES)) + math.log10(8) + 0.3 * (j - i)))
    for unit in range(1, min(8, (n - i) // 2) + 1):
        j = i + unit
        while j + unit <= n and value[j:j + unit] == value[i:i + unit]:
            j += unit
        if j - i >= max(3, 2 * unit):
            base = min([unit * math.log10(max(alphabet(value[i:i + unit]), 10))] + [
                math.log10(r + 1) for r in [ranks.get(low[i:i + unit])] if r is not None])
            out.append((j, base + math.log10((j - i) // unit)))
    out.extend((j, per_place * (j - i)) for j in range(i + 1, int(min(n, i + room / per_place + 1)) + 1))
    return out


def guesses(value: str, ranks, limit: float = math.inf) -> float:
    """log10 of the guesses that `value` takes: the least over all segmentations; infinite from `limit` on."""
    n, low = len(value), "".join(x if len(x := c.lower()) == 1 else c for c in value)
    per_place = math.log10(max(alphabet(value), 10))
    # Cheapest way to each place with so many segments. Ten cost 10! orders and ten words, more than `LEAST_GUESSES`.
    most = min(n, 10)
    orders = [math.log10(math.factorial(k)) for k in range(most + 1)]
    best: dict[int, list[float]] = {0: [0.0] + [math.inf] * most}
    upto = 0
    for i in range(n):
        if i > upto:
            break
        row = best.pop(i, None)
        if row is None:
            continue
        segments = _segments(value, low, i, per_place, limit - min(row), ranks)
        for used in range(most):
            cost = row[used]
            if cost < math.inf:
                for j, own in segments:
                    total = cost + own
                    if total + orders[used + 1] < limit:
                        to = best.get(j)
                        if to is None:
                            to = best[j] = [math.inf] * (most + 1)
                            upto = max(upto, j)
                        if total < to[used + 1]:
                            to[used + 1] = total
    return min((c + o for c, o in zip(best[n], orders)), default=math.inf) if n in best else math.inf


class Asked:
    """A dictionary that has every word at the first rank, and notes which it was asked for."""

    def __init__(self):
        self.words: set[str] = set()

    def get(self, word: str) -> int | None:
        if LETTERS[0] <= len(word) <= LETTERS[1] and word.isalpha():
            self.words.add(word)
            return 1
        return None


def values_of(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the values in credential context."""
    found = [(m.start(1), m.start(1) + len(m.group(1).rstrip(b".!?)]}"))) for m in CONTEXT.finditer(raw)]
    return [(a, b) for a, b in found if b - a >= 6]


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find in a text, in bytes."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    return found + [(a, 2, b) for a, b in hex_runs(raw)]


def decided(value: str, least: float) -> bool | None:
    """Whether a value takes `least` guesses or more, None where that is up to the ranks of words."""
    if guesses(value, Asked(), least) >= least:
        return True
    return None if guesses(value, {}, least) >= least else False


def code_points(raw: bytes, places: list[int]) -> list[int]:
    """Byte places as places of code points."""
    if raw.isascii():
        return places
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return before[places].tolist()


def counted_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of the corpus's words of 3 to 24 letters that are not values in credential context, n counted over all
    texts."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            counts: Counter = Counter()
            for value in batch.column(0):
                raw = value.as_py()
                found = values_of(raw)
                if found:
                    ends = [0, *(high for _, high in found)]
                    raw = b" ".join(raw[a:b] for a, b in zip(ends, [*(low for low, _ in found), len(raw)]))
                counts.update(raw.lower().split())
            kept: Counter = Counter()
            for w, n in counts.items():
                word = w.decode("utf-8", "ignore").lower()
                if LETTERS[0] <= len(word) <= LETTERS[1] and word.isalpha():
                    kept[word] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})

    given = docs.select(F.col(text).cast("binary")).dropna().mapInArrow(run, "word string, n bigint")
    return given.groupBy("word").agg(F.sum("n").alias("n"))


def ranked_counts(counted: DataFrame) -> DataFrame:
    """(n, rank): the rank among all words of those that occur n times, the middle of theirs. Running sums over the counts,
    inside each power of two, and over these."""
    sizes = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("power", F.floor(F.log2("n")).cast("int"))
    sizes = staged(sizes, "counts")
    # A row for each power of two, of which there are 63.
    above, bases = 0, []
    for row in sizes.groupBy("power").agg(F.sum("words").alias("words")).orderBy(F.desc("power")).collect():
        bases.append((row["power"], above))
        above += row["words"]
    known = F.broadcast(counted.sparkSession.createDataFrame(bases, "power int, base bigint"))
    before = Window.partitionBy("power").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum("words").over(before) - F.col("words")
    return sizes.withColumn("inside", inside).join(known, "power").select(
        "n", (F.col("base") + F.col("inside") + (F.col("words") + 1) / 2).alias("rank"))


def rated(values: DataFrame, counted: DataFrame, least: float = LEAST_GUESSES) -> DataFrame:
    """(v, strong) for distinct values (v): whether one takes `least` guesses or more, words costing their rank in the corpus."""

    def asked(batches):
        for batch in batches:
            at, words = [], []
            for value in batch.column(0).to_pylist():
                own = Asked()
                guesses(value, own, least)
                at.extend([value] * len(own.words))
                words.extend(sorted(own.words))
            yield pa.RecordBatch.from_pydict({"v": pa.array(at, pa.string()), "word": pa.array(words, pa.string())})

    def rate(batches):
        for batch in batches:
            values, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            strong = [guesses(v, {x["word"]: x["rank"] for x in k or ()}, least) >= least for v, k in zip(values, known)]
            yield pa.RecordBatch.from_pydict({"v": batch.column(0), "strong": pa.array(strong, pa.bool_())})

    # Values are few bytes and much work: dealt out by number, or they would meet in a task or two.
    values = values.repartition(partitions(values.sparkSession), "v")
    needed = values.mapInArrow(asked, "v string, word string")
    # Words that several values ask about are looked up once.
    ranks = counted.join(needed.select("word").distinct(), "word", "left_semi").join(ranked_counts(counted), "n").select("word", "rank")
    held = needed.join(ranks, "word").groupBy("v").agg(F.collect_list(F.struct("word", "rank")).alias("known"))
    known = values.join(held, "v", "left").select("v", "known").repartition(partitions(values.sparkSession), "v")
    return known.mapInArrow(rate, "v string, strong boolean")


def frequent_words(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> dict[str, int]:
    """Ranks of the corpus's most frequent words, as `counted_words` counts them. Ties go by the word."""
    counted = staged(counted_words(docs, text).filter("n > 1"), "words")
    # A top-k sends k rows of each partition to the driver. So the least count among the top comes first, from the number of
    # words of each count, of which there are few; then only the words that reach it are sorted.
    least, above = 1, 0
    for row in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect():
        least, above = row["n"], above + row["words"]
        if above >= most:
            break
    rows = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    return {row["word"]: rank for rank, row in enumerate(rows, 1)}


SPANS = "array<struct<s:bigint,k:int,e:bigint>>"


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: dict[str, int] | None = None,
                 least: float = LEAST_GUESSES) -> DataFrame:
    """doc_id and the spans of its secrets (kinds, starts, ends in code points, end exclusive; sorted by start, then
    kind as in `KINDS`) for each row of `docs`.

    Null and empty texts have none. Repeated rows give repeated results, also in the counts of the dictionary. Very
    long texts and values are rated whole. `ranks` replaces the corpus's dictionary. Other columns are not read."""
    span = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
    asked = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("v", pa.string())]))

    def run(batches):
        for batch in batches:
            sure, rest = [], []
            for value in batch.column(1):
                raw = value.as_py()
                found, doubtful = base_spans(raw), []
                for low, high in values_of(raw):
                    own = raw[low:high].decode("utf-8", "ignore")
                    strong = decided(own, least) if ranks is None else guesses(own, ranks, least) >= least
                    if strong:
                        found.append((low, 3, high))
                    elif strong is None:
                        doubtful.append((low, high, own))
                places = iter(code_points(raw, [x for a, _, b in found for x in (a, b)] + [x for a, b, _ in doubtful for x in (a, b)]) if found or doubtful else [])
                sure.append([{"s": next(places), "k": k, "e": next(places)} for _, k, _ in found])
                rest.append([{"s": next(places), "e": next(places), "v": v} for _, _, v in doubtful])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "h": batch.column(2), "sure": pa.array(sure, span), "rest": pa.array(rest, asked)})

    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw.alias("t"), F.sha2(raw, 256).alias("h"))
    found = given.mapInArrow(run, f"doc_id bigint, h string, sure {SPANS}, rest array<struct<s:bigint,e:bigint,v:string>>")
    if ranks is None:
        found = staged(found, "spans")
        values = staged(found.select(F.explode("rest.v").alias("v")).distinct(), "values")
        strong = rated(values, staged(counted_words(docs, text), "words"), least).filter("strong").select("v")
        # Equal texts have equal spans, so a text is enough to bring the rated ones back to their rows.
        texts = found.filter(F.size("rest") > 0).select("h", "rest").dropDuplicates(["h"]).select("h", F.inline("rest"))
        more = staged(texts.join(strong, "v").groupBy("h").agg(
            F.collect_list(F.struct("s", F.lit(3).alias("k"), "e")).cast(SPANS).alias("more")), "rated")
        open_rows = found.filter(F.size("rest") > 0).join(more, "h", "left").select(
            "doc_id", F.concat("sure", F.coalesce("more", F.array().cast(SPANS))).alias("all"))
        found = found.filter(F.size("rest") == 0).select("doc_id", F.col("sure").alias("all")).unionByName(open_rows)
    else:
        found = found.select("doc_id", F.col("sure").alias("all"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return found.withColumn("all", F.array_sort("all")).select(
        "doc_id", F.transform("all", lambda x: F.get(kinds, x["k"])).alias("kinds"), F.col("all.s").alias("starts"), F.col("all.e").alias("ends"))
