"""Document fingerprints by winnowing, in DataFrame functions only.

The unit is a word (a run without white space, lower-cased). A cyclic polynomial, which rolls from one word to the next
by a rotation and two exclusive ors, hashes every run of `GRAM` words; from each `WINDOW` hashes that follow each other
the least is kept, of equal ones the rightmost. So any `GRAM + WINDOW - 1` words that two texts share leave a common
fingerprint. An entry is 36 bits of hash and 27 bits of position in one number, made so that the least number is the
least hash with the rightmost position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knigovod.llm.shared import partitions

GRAM, WINDOW = 5, 8
POSITION_BITS = 27
LAST = (1 << POSITION_BITS) - 1


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _turned(value: str, by: int) -> str:
    return f"(shiftleft({value}, {by}) | shiftrightunsigned({value}, {64 - by}))" if by else value


def entries(text: str, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint of a text column (never null): an array of numbers, by position. Texts of fewer than `gram`
    words are one run; texts without words have none."""
    words = f"filter(split(lower({text}), '[\\\\s]+'), w -> w <> '')"
    hashes = "transform(words, w -> xxhash64(w))"
    rolled = " ^ ".join([_turned("x", gram - 1)] + [_turned(f"get(hashes, i + {j})", gram - 1 - j) for j in range(1, gram)])
    grams = (f"CASE WHEN size(hashes) >= {gram} THEN transform(slice(hashes, 1, greatest(size(hashes) - {gram - 1}, 0)), (x, i) -> {rolled}) "
             "WHEN size(hashes) > 0 THEN array(aggregate(hashes, 0L, (a, x) -> xxhash64(a, x))) ELSE cast(array() as array<bigint>) END")
    numbered = f"transform(grams, (x, i) -> shiftleft(shiftrightunsigned(x, {POSITION_BITS + 1}), {POSITION_BITS}) | cast({LAST} - i as bigint))"
    least = (f"CASE WHEN size(numbered) = 0 THEN numbered ELSE array_distinct(transform("
             f"sequence(1, greatest(size(numbered) - {window - 1}, 1)), i -> array_min(slice(numbered, i, {window})))) END")
    return F.expr(_let(words, "words", _let(hashes, "hashes", _let(grams, "grams", _let(numbered, "numbered", least)))))


def hashes_of(fingerprint: str) -> str:
    return f"transform({fingerprint}, x -> shiftrightunsigned(x, {POSITION_BITS}))"


def as_text(fingerprint: str) -> Column:
    """`hash@position` for each entry, a space between."""
    return F.expr(f"array_join(transform({fingerprint}, x -> concat(hex(shiftrightunsigned(x, {POSITION_BITS})), '@', {LAST} - (x & {LAST}L))), ' ')")


def likeness(one: str, two: str) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; two empty ones are alike."""
    return F.expr(
        f"CASE WHEN size({one}) = 0 AND size({two}) = 0 THEN 1.0D ELSE "
        + _let(hashes_of(one), "a", _let(hashes_of(two), "b", "cast(size(array_intersect(a, b)) as double) / size(array_union(a, b))")) + " END")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, text, entries for each row of `docs`. Null texts are empty."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return given.withColumn("entries", entries("text", gram, window))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) -> doc_id, text, entries, and those of the next document in ascending order of doc_id (null first,
    equal ids by text) as next_text, next_entries; the last is followed by the first.

    Documents are dealt into ranges of ids. The first document of each range goes to the range before it as well, so
    one shuffle puts each document beside its next one, and nothing has to be ordered in one place."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), "doc_id", "text")
    shares = [i / parts for i in range(1, parts)]
    bounds = keyed.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts))).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    # Two steps of about the root of the number of ranges each, instead of one over all bounds.
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if blocks:
        tops = "array(" + ", ".join(f"{b[0]}L" for b in blocks) + ")"
        rest = "array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in b) + ")" for b in blocks) + ")"
        top = f"size(filter({tops}, x -> x <= key))"
        part = F.expr(f"CASE WHEN {top} = 0 THEN 0 ELSE ({top} - 1) * {step} + size(filter(get({rest}, {top} - 1), x -> x <= key)) END")
    else:
        part = F.lit(0)
    placed = keyed.withColumn("part", part)
    firsts = sorted((r["part"], r["first"]) for r in placed.groupBy("part").agg(F.min("key").alias("first")).collect())
    if not firsts:
        firsts = [(0, 0)]
    table = spark.createDataFrame(
        [(p, f, firsts[i - 1][0]) for i, (p, f) in enumerate(firsts)], "part int, first bigint, previous int")
    # One row per range, `parts` at most.
    placed = placed.join(F.broadcast(table), "part")
    again = F.when(F.col("key") == F.col("first"), F.array(
        F.struct("part", F.lit(False).alias("extra")), F.struct(F.col("previous").alias("part"), F.lit(True).alias("extra")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("extra"))))
    dealt = placed.select("key", "doc_id", "text", F.inline(again)).repartition(partitions(spark), "part")
    dealt = dealt.withColumn("entries", entries("text"))
    order = Window.partitionBy("part").orderBy("extra", "key", "text")
    seen = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_entries", F.lead("entries").over(order))
    return seen.filter("NOT extra").select("doc_id", "text", "entries", "next_text", "next_entries")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs`:
    its fingerprint, that of the text with its last quarter replaced by the beginning of the next document, and how
    alike it is to that one and to the next document's.

    Null texts are empty; empty and blank texts have an empty fingerprint, alike to another empty one (1.0) and unlike
    all others (0.0). Rows that repeat a doc_id follow each other by text. A single row is its own next. Texts may have
    up to 2**27 words. Other columns are not read."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = with_next(given, 2 * partitions(docs.sparkSession))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    seen = seen.select("doc_id", n.cast("bigint").alias("n_chars"), "entries", "next_entries", edited.alias("edited"))
    seen = seen.select(
        "doc_id", "n_chars", "entries", "next_entries", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(entries("edited"))).alias("edited_entries"))
    return seen.select(
        "doc_id", "n_chars", "edited_sha256", as_text("entries").alias("fingerprint"), as_text("edited_entries").alias("edited_fingerprint"),
        likeness("entries", "edited_entries").alias("near_edited"), likeness("entries", "next_entries").alias("near_next"))
