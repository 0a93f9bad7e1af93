"""Counterparty resolution: names and texts against the registry.

Names are matched once per distinct spelling and joined back, so a vendor that sends a third of all
documents costs one lookup. Substring tests between names are equi-joins on the pieces of words, never
a product of the two tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knigovod.config import DEFAULT, MAX_BROADCAST_BYTES, Settings
from knigovod.functions.amounts import let
from knigovod.functions.sql import rx
from knigovod.functions.text import match_form
from knigovod.operators.contains import first_containing, grams
from knigovod.operators.stages import left_join_dealt, staged


def with_match_form(registry: DataFrame) -> DataFrame:
    return registry.withColumn("norm_name", match_form(F.col("name")))


def clean_registry(raw: DataFrame) -> DataFrame:
    """Registry as loaded: numeric ids without decimals, rows lacking id or name dropped."""
    whole = F.regexp_replace(F.trim(F.col("id").cast("string")), r"^(\d+)\.0+$", "$1")
    return (
        raw.withColumns({"id": whole, "name": F.trim("name")})
        .filter((F.col("id") != "") & (F.col("name") != ""))
    )


def words_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), " ")), lambda w: w != "")


def fingerprints(registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Tokens that occur exactly once in all registry names: (token, reg_order)."""
    tokens = registry.select("reg_order", F.explode(F.split(F.lower("norm_name"), " ")).alias("token"))
    return (
        tokens.filter(F.length("token") >= settings.min_token_length)
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("reg_order").alias("reg_order"))
        .filter(F.col("n") == 1).select("token", "reg_order")
    )


def words_holding(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (word, token) where the word contains the token.

    words: word, distinct. tokens: token, distinct. Blank-free tokens can only occur inside words, so
    the words are cut into pieces as long as some token, and the pieces are equi-joined."""
    lengths = tokens.select(F.length("token").alias("n")).distinct()
    # A scalar subquery: the token lengths that occur, at most as many as the longest name has letters.
    listed = lengths.agg(F.array_sort(F.collect_list("n")).alias("lengths")).scalar()
    pieces = words.withColumn("lengths", listed).select("word", F.explode(F.array_distinct(F.flatten(F.transform(
        F.filter("lengths", lambda n: n <= F.length("word")),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substr(F.col("word"), i, n)))))).alias("token"))
    return pieces.join(tokens.select("token"), "token").select("word", "token")


def scan_texts(texts: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Registry entry whose fingerprint tokens occur most often in each text (score 90).

    texts: text_id, text. The vocabulary of all texts is searched once per distinct word."""
    unique = fingerprints(registry, settings)
    text_words = texts.select("text_id", F.explode(words_of(match_form(F.col("text")))).alias("word"))
    vocabulary = text_words.filter(F.length("word") >= settings.min_token_length).select("word").distinct()
    held = words_holding(vocabulary, unique).join(unique, "token")
    hits = text_words.join(held, "word").groupBy("text_id", "reg_order").agg(
        F.count_distinct("token").alias("hits"))
    best = hits.groupBy("text_id").agg(F.max(F.struct("hits", (-F.col("reg_order")).alias("minus"))).alias("best"))
    return (
        best.select("text_id", (-F.col("best.minus")).alias("reg_order"), F.col("best.hits").alias("hits"))
        .join(registry.select("reg_order", "id", "name"), "reg_order")
        .select("text_id", "id", "name", F.lit(90.0).alias("score"), F.lit(False).alias("low_confidence"), "hits")
    )


def lookup_ids(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry name of each row's id."""
    first = registry.groupBy("id").agg(F.min(F.struct("reg_order", "name")).alias("first"))
    names = first.select(F.col("id").alias("_id"), F.col("first.name").alias("komitent_name"))
    return left_join_dealt(rows.withColumn("_id", F.trim("komitent_id")), names, "_id").drop("_id")


def search(queries: DataFrame, registry: DataFrame, n: int = 8) -> DataFrame:
    """First `n` registry entries, in registry order, that contain each query (query_id, query)."""
    # A line break keeps the two spellings of a name apart.
    names = registry.select(
        F.col("reg_order").alias("text_id"), F.lower(F.concat_ws("\n", "name", "norm_name")).alias("text"))
    return (
        first_containing(names, queries, n).join(registry, F.col("text_id") == F.col("reg_order"))
        .select("query_id", "place", "id", "name")
    )


# --- Similar names -----------------------------------------------------------------------------------

def compared_form(norm: Column) -> Column:
    """Letters and digits only, padded so that word ends count."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(norm), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def similarity(a: Column, b: Column) -> Column:
    """Percentage of shared trigrams of two compared forms (Dice), to one decimal."""
    left, right = grams(a, 3), grams(b, 3)
    shared = F.size(F.array_intersect(left, right))
    return F.round(200.0 * shared / F.greatest(F.size(left) + F.size(right), F.lit(1)), 1)


def gram_codes(form: Column) -> Column:
    """Distinct trigrams as integers: three code points of 21 bits each, so no two share a code."""
    # The letters are listed once: to find the i-th one in the text again and again is quadratic in its length.
    letters = F.transform(F.split(form, ""), lambda c: F.ascii(c).cast("bigint"))
    code = lambda at, i, shift: F.shiftleft(F.get(at, i), shift)
    starts = F.when(F.length(form) >= 3, F.sequence(F.lit(0), F.length(form) - 3))
    return F.array_distinct(let(letters, lambda at: F.transform(
        F.coalesce(starts, F.array().cast("array<int>")), lambda i: code(at, i, 42) + code(at, i + 1, 21) + code(at, i + 2, 0))))


def _ranked(named: DataFrame, key: str, frequency: DataFrame) -> DataFrame:
    """Trigrams of each name, those that are rare in the registry first, and how rare each is."""
    # Dealt out by name before it is cut: where the frequencies go to every task, the trigrams need no shuffle.
    cut = named.repartition(key).select(key, F.explode(gram_codes(F.col("form"))).alias("gram"))
    # A name has few trigrams; the list per name is as short as the name.
    listed = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))
    hashed = lambda bit, counts: (f"aggregate(transform(ranked, r -> xxhash64(r.gram)), 0L, "
                                  f"(bits, h) -> if({counts}, bits | shiftleft(1L, cast({bit} as int)), bits))")
    return cut.join(frequency, "gram", "left").groupBy(key).agg(listed.alias("ranked")).select(
        key, F.transform("ranked", lambda r: r["gram"]).alias("grams"), F.transform("ranked", lambda r: r["n"]).alias("counts"),
        # A bit for each trigram: two names differ in at least as many trigrams as in bits. Once in 64 bits, and once in 128.
        F.expr(hashed("pmod(h, 64)", "true")).alias("bits"),
        F.expr(hashed("pmod(shiftright(h, 7), 64)", "pmod(h, 128) < 64")).alias("low_bits"),
        F.expr(hashed("pmod(shiftright(h, 7), 64)", "pmod(h, 128) >= 64")).alias("high_bits"))


def _prefixed(sized: DataFrame, needed: Column) -> DataFrame:
    """One row per rare trigram and its place, of rows with their ranked `grams`: of two names that share at least `needed`
    trigrams, one of these is shared (prefix filter of set-similarity joins)."""
    prefix = F.slice("grams", F.lit(1), F.greatest(F.col("n") - needed + 1, F.lit(0)))
    rows = sized.select("*", F.posexplode(prefix).alias("place", "gram"))
    # Both sides know how many entries hold a trigram, so they agree on how often to split it.
    held = F.get("counts", F.col("place"))
    return rows.filter(held > 0).withColumn("salts", (F.floor(held / SALT_EVERY) + 1).cast("int")).drop("counts")


# A trigram of more entries than this is dealt out to several tasks.
SALT_EVERY = 10_000


def _least(n: Column, t: float) -> Column:
    """Fewest trigrams that a name of `n` shares with any that is like it."""
    return F.ceil(n * F.lit(t / (2 - t)) - F.lit(1e-9)).cast("int")


def similar_names(names: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
    """All (name_id, reg_order, score) with a similarity of at least `floor`; both sides with their
    ranked trigrams, as staged tables.

    Names are asked about for each number of trigrams that an entry may have: the more it has, the more must be shared, and
    the fewer of the name's trigrams, rarest first, have to be looked at. Two names that meet at a trigram share at most what
    follows it on either side, and differ where their bits do; what cannot be alike is dropped before it is compared. No pair
    appears twice. Entries of a checked size go to every task, or else names of a checked size; otherwise both are dealt out
    by trigram (`_met_by_trigram`)."""
    # Scores are rounded to one decimal before they are held against the floor.
    t = (floor - 0.05) / 100.0
    # A scalar subquery: the sizes that occur, at most as many as the longest name has letters.
    sizes = entries.select(F.size("grams").alias("m")).distinct().agg(F.array_sort(F.collect_list("m")).alias("sizes")).scalar()
    fits = lambda m: (m >= _least(F.col("n"), t)) & (m <= F.floor(F.col("n") * F.lit((2 - t) / t) + F.lit(1e-9)))
    # Dealt out by name: the comparison keeps all cores busy, and the best of a name need no shuffle after
    # a broadcast of the entries.
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = names.repartition(parts, "name_id").withColumns({"n": F.size("grams"), "sizes": sizes})
    asked = asked.withColumn("m", F.explode(F.filter("sizes", fits))).drop("sizes")
    left = _prefixed(asked, F.ceil((F.col("n") + F.col("m")) * F.lit(t / 2) - F.lit(1e-9)).cast("int")).drop("salts")
    right = _prefixed(entries.withColumn("n", F.size("grams")), _least(F.col("n"), t)).drop("salts")
    # What a task would hold of a side: each row with its key in the hash table. The tables are staged in few bytes and cut
    # into many rows here, so their files say nothing about what a broadcast would bring through the driver.
    weight = lambda rows: rows.agg(F.sum(8 * F.col("n") + 150)).head()[0] or 0
    if weight(right) <= MAX_BROADCAST_BYTES:
        right = F.broadcast(right)
    elif weight(left) <= MAX_BROADCAST_BYTES:
        left = F.broadcast(left)
    else:
        return _scored(_met_by_trigram(names, entries, t), names, entries, floor)
    left, right = left.alias("l"), right.alias("r")
    most = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place"))
    total = F.col("l.n") + F.col("r.n")
    spare = total - 2 * F.ceil(total * F.lit(t / 2) - F.lit(1e-9))
    met = left.join(right, (F.col("l.gram") == F.col("r.gram")) & (F.col("l.m") == F.col("r.n"))
                    & (200.0 * most / total >= floor - 0.05) & (F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= spare))
    # A pair counts only at its first shared trigram.
    score = let(F.array_intersect("l.grams", "r.grams"), lambda shared: F.when(
        F.get(shared, F.lit(0)) == F.col("l.gram"), F.round(200.0 * F.size(shared) / total, 1)))
    return met.select("name_id", "reg_order", score.alias("score")).filter(F.col("score") >= floor)


def _scored(pairs: DataFrame, names: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
    """(name_id, reg_order, score) of the distinct pairs that reach the floor, by sort-merge joins with the staged tables."""
    left = names.select("name_id", F.col("grams").alias("l_grams")).hint("merge")
    right = entries.select("reg_order", F.col("grams").alias("r_grams")).hint("merge")
    total = F.size("l_grams") + F.size("r_grams")
    score = F.round(200.0 * F.size(F.array_intersect("l_grams", "r_grams")) / total, 1)
    return pairs.distinct().join(left, "name_id").join(right, "reg_order").select(
        "name_id", "reg_order", score.alias("score")).filter(F.col("score") >= floor)


#: Rows that a task of the search by trigram is meant to read, and pairs whose bits it compares at a time.
MET_ROWS, MET_PAIRS = 400_000, 1 << 20


def _met_by_trigram(names: DataFrame, entries: DataFrame, t: float) -> DataFrame:
    """(name_id, reg_order) of names and entries that share a trigram rare enough and whose bits are near enough, some more
    than once; t: share of the trigrams that must be common.

    Both sides are dealt out by trigram. A task holds the entries of its trigrams and reads the names after them, in
    batches. The entries of a common trigram are split, and the names that look at it go to each part."""
    cell = F.xxhash64("gram", "salt").alias("cell")
    told = lambda rows, side, name, order: rows.select(
        cell, F.lit(side).alias("side"), name.alias("name_id"), order.cast("bigint").alias("reg_order"), F.col("n").cast("int").alias("n"),
        F.col("place").cast("int").alias("place"), "bits", "low_bits", "high_bits")
    prefixed = lambda rows: _prefixed(rows.withColumn("n", F.size("grams")).filter("n > 0"), _least(F.col("n"), t))
    name_kind, order_kind = names.schema["name_id"].dataType, entries.schema["reg_order"].dataType
    known = told(prefixed(entries).withColumn("salt", F.pmod(F.xxhash64("reg_order"), F.col("salts")).cast("int")),
                 0, F.lit(None).cast(name_kind), F.col("reg_order"))
    asked = told(prefixed(names).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))),
                 1, F.col("name_id"), F.lit(None))
    rows = known.unionByName(asked)
    # As many tasks as keep the entries of one within bounds.
    parts = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // MET_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = [], None
        for batch in batches:
            first = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if first:
                held.append(batch.slice(0, first))
            if first < batch.num_rows:
                table = table or _Known(held)
                asked = batch.slice(first)
                for row, order in table.met(asked, t):
                    yield pa.RecordBatch.from_arrays([asked.column("name_id").take(pa.array(row)), pa.array(order)], ["name_id", "reg_order"])

    schema = T.StructType([T.StructField("name_id", name_kind), T.StructField("reg_order", T.LongType())])
    met = rows.repartition(parts, "cell").sortWithinPartitions("side").mapInArrow(run, schema)
    return met.withColumn("reg_order", F.col("reg_order").cast(order_kind))


class _Known:
    """The entries of a task, by trigram, number of trigrams and place."""

    def __init__(self, batches: list[pa.RecordBatch]):
        column = lambda c, kind=np.int64: np.concatenate([b.column(c).to_numpy().astype(kind) for b in batches] or [np.zeros(0, kind)])
        cells, n, place = column("cell"), column("n"), column("place")
        self.cells, number = np.unique(cells, return_inverse=True)
        self.sizes = np.unique(n)
        self.step = int(max(n.max(initial=0), place.max(initial=0))) + 1
        keys = self._key(number, n, place)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.orders = column("reg_order")[order]
        # Unsigned: of a negative number the bits of its absolute value would be counted.
        self.bits, self.low, self.high = (column(c)[order].view(np.uint64) for c in ("bits", "low_bits", "high_bits"))

    def _key(self, cell, n, place):
        return (cell * self.step + n) * self.step + place

    def met(self, batch: pa.RecordBatch, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of the batch, entry) in pieces of MET_PAIRS pairs looked at, or those of one name."""
        if not len(self.keys):
            return
        cell, n, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "n", "place"))
        bits, low_bits, high_bits = (batch.column(c).to_numpy().view(np.uint64) for c in ("bits", "low_bits", "high_bits"))
        number = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        there = self.cells[number] == cell
        for m in self.sizes.tolist():
            needed = np.ceil((n + m) * (t / 2) - 1e-9).astype(np.int64)
            # Both trigrams must have enough behind them; so the entries are those of one run of keys.
            rows = np.flatnonzero(there & (place <= n - needed) & (needed <= m))
            low = np.searchsorted(self.keys, self._key(number[rows], m, 0))
            high = np.searchsorted(self.keys, self._key(number[rows], m, np.minimum(m - needed[rows], self.step - 1)), "right")
            rows, low, many = rows[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(many)
            start = 0
            while start < len(rows):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - many[start] + MET_PAIRS, "right")))
                part, size = slice(start, stop), many[start:stop]
                row = np.repeat(rows[part], size)
                at = np.arange(len(row)) + np.repeat(low[part] - np.cumsum(size) + size, size)
                spare = np.repeat((n + m - 2 * needed)[rows[part]], size)
                near = np.flatnonzero(np.bitwise_count(bits[row] ^ self.bits[at]) <= spare)
                row, at = row[near], at[near]
                near = np.bitwise_count(low_bits[row] ^ self.low[at]) + np.bitwise_count(high_bits[row] ^ self.high[at]) <= spare[near]
                if near.any():
                    yield row[near], self.orders[at[near]]
                start = stop


@dataclass(frozen=True)
class Trigrams:
    """The scorer by shared trigrams. A scorer gives the score of two compared forms, and finds all pairs from a floor
    upwards among prepared names (name_id, form) and entries (reg_order, form)."""

    floors: tuple[float, ...] = (95.0, 85.0, 80.0, 70.0, 60.0, 52.0)

    def score(self, a: Column, b: Column) -> Column:
        return similarity(a, b)

    def prepared(self, names: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        frequency = staged(
            entries.select(F.explode(gram_codes(F.col("form"))).alias("gram")).groupBy("gram")
            .agg(F.count(F.lit(1)).alias("n")), "gram-frequency")
        return staged(_ranked(names, "name_id", frequency), "name-grams"), staged(_ranked(entries, "reg_order", frequency), "entry-grams")

    def pairs(self, names: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
        return similar_names(names, entries, floor)


TRIGRAMS = Trigrams()


def fuzzy_winner(names: DataFrame, registry: DataFrame, settings: Settings = DEFAULT, scorer=TRIGRAMS) -> DataFrame:
    """Most similar registry entry of each name (name_id, form), if it leads the runner-up by the margin.

    The search goes down from a high floor, where few trigrams decide, and a name leaves it as soon as
    the result is certain: two entries above the floor, or one that leads the floor by the margin. So
    the wide search at the lowest floor is left to names that are like nothing much."""
    entries = registry.select("reg_order", compared_form(F.col("norm_name")).alias("form"))
    undecided, ranked_entries = scorer.prepared(names, entries)
    best_first = Window.partitionBy("name_id").orderBy(F.desc("score"), "reg_order")
    decided = None
    last = settings.match_floor
    for floor in [f for f in scorer.floors if f > last] + [last]:
        # row_number <= 2 prunes each map task to two rows per name before the shuffle.
        top = scorer.pairs(undecided, ranked_entries, floor).withColumn(
            "place", F.row_number().over(best_first)).filter(F.col("place") <= 2)
        first = F.col("place") == 1
        found = top.groupBy("name_id").agg(
            F.max(F.when(first, F.col("score"))).alias("score"),
            F.max(F.when(first, F.col("reg_order"))).alias("reg_order"),
            F.max(F.when(~first, F.col("score"))).alias("runner_up"))
        certain = F.col("runner_up").isNotNull() | (F.col("score") >= floor + settings.match_margin) | F.lit(floor == last)
        sure = staged(found.filter(certain), "similar")
        decided = sure if decided is None else decided.unionByName(sure)
        undecided = undecided.join(sure.select("name_id"), "name_id", "left_anti")
        if floor == last or undecided.isEmpty():
            break
    return decided.filter(
        F.col("runner_up").isNull() | (F.col("score") >= F.col("runner_up") + settings.match_margin))


# --- Names against the registry ------------------------------------------------------------------------

def _alias_hits(names: DataFrame, registry: DataFrame, settings: Settings) -> DataFrame:
    """First registry entry that holds the canonical text of a vendor alias (score 100)."""
    number = F.coalesce(*[
        F.when(F.col("vendor_name").rlike(rx(pattern)), F.lit(i))
        for i, (pattern, _, _) in enumerate(settings.vendor_aliases)], F.lit(None).cast("int"))
    first = registry.agg(F.array(*[
        F.min(F.when(F.lower("norm_name").contains(text.lower()), F.col("reg_order")))
        for _, _, text in settings.vendor_aliases]).alias("orders"))
    found = first.select(F.posexplode("orders").alias("alias", "reg_order")).filter(F.col("reg_order").isNotNull())
    return names.withColumn("alias", number).join(F.broadcast(found), "alias").select("name_id", "reg_order")


def token_candidates(names: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(name_id, token, n, reg_order): registry entries holding a token of the name, for tokens held by
    at most four entries. Tokens held by more say nothing about the vendor and are left out."""
    most = settings.max_token_candidates
    tokens = names.select("name_id", F.explode(F.array_distinct(F.filter(
        F.split("norm_name", " "), lambda t: F.length(t) >= settings.min_token_length))).alias("written"))
    tokens = tokens.withColumn("token", F.lower("written"))
    distinct_tokens = tokens.select("token").distinct()
    entry_words = registry.select("reg_order", F.explode(words_of(F.col("norm_name"))).alias("word"))
    per_word = entry_words.groupBy("word").agg(F.count(F.lit(1)).alias("entries"))
    held = words_holding(per_word.select("word"), distinct_tokens).join(per_word, "word")
    # A word that is common already rules its tokens out; only rare words are followed to the entries.
    rare = held.groupBy("token").agg(F.max("entries").alias("most")).filter(F.col("most") <= most).select("token")
    entries = (
        held.join(rare, "token", "left_semi").select("token", "word")
        .join(entry_words, "word").select("token", "reg_order").distinct()
    )
    counted = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return tokens.join(counted, "token").join(entries, "token").select("name_id", "token", "n", "reg_order")


def match_names(names: DataFrame, registry: DataFrame, settings: Settings = DEFAULT, scorer=TRIGRAMS) -> DataFrame:
    """Registry entry of each distinct `vendor_name`: alias, then telling token, then similar name by the given scorer.

    Returns vendor_name, komitent_id, komitent_name, komitent_score, komitent_low_confidence, route."""
    asked = (
        names.select("vendor_name").filter(F.coalesce("vendor_name", F.lit("")) != "").distinct()
        .withColumn("name_id", F.col("vendor_name"))
        .withColumn("norm_name", match_form(F.col("vendor_name")))
        .withColumn("form", compared_form(F.col("norm_name")))
    )
    asked = staged(asked, "asked-names")
    entries = registry.select("reg_order", compared_form(F.col("norm_name")).alias("reg_form"))
    open_names = asked
    routes = []
    if settings.vendor_aliases:
        hits = _alias_hits(asked, registry, settings).select(
            "name_id", "reg_order", F.lit(100.0).alias("score"), F.lit("alias").alias("route"))
        routes.append(hits)
        open_names = open_names.join(hits.select("name_id"), "name_id", "left_anti")

    scored = (
        token_candidates(open_names, registry, settings)
        .join(entries, "reg_order").join(open_names.select("name_id", "form"), "name_id")
        .withColumn("score", F.when(F.col("n") == 1, F.lit(90.0)).otherwise(scorer.score(F.col("form"), F.col("reg_form"))))
        .filter((F.col("n") == 1) | (F.col("score") >= settings.match_threshold))
    )
    # The longest telling token decides, then the more similar entry, then the earlier one.
    first = F.min(F.struct(-F.length("token"), "token", (-F.col("score")).alias("minus"), "reg_order", "n"))
    by_token = (
        scored.groupBy("name_id").agg(first.alias("first"))
        .select("name_id", F.col("first.reg_order").alias("reg_order"), (-F.col("first.minus")).alias("score"),
                F.when(F.col("first.n") == 1, "token").otherwise("candidates").alias("route"))
    )
    by_token = staged(by_token, "by-token")
    routes.append(by_token)
    rest = open_names.join(by_token.select("name_id").hint("merge"), "name_id", "left_anti")
    routes.append(fuzzy_winner(rest.select("name_id", "form"), registry, settings, scorer).select(
        "name_id", "reg_order", "score", F.lit("similar").alias("route")))

    found = routes[0]
    for more in routes[1:]:
        found = found.unionByName(more)
    return (
        found.join(registry.select("reg_order", "id", "name"), "reg_order")
        .select(
            F.col("name_id").alias("vendor_name"), F.col("id").alias("komitent_id"),
            F.col("name").alias("komitent_name"), F.col("score").alias("komitent_score"),
            (F.col("score") < settings.match_threshold).alias("komitent_low_confidence"), "route")
    )


def resolve(records: DataFrame, registry: DataFrame, settings: Settings = DEFAULT, scorer=TRIGRAMS) -> DataFrame:
    """Counterparty of each record by vendor name; unsure ones by a scan of the document text.

    records: doc_id, vendor_name, full_text; read several times, so a scan or a staged table. A scan hit also replaces the vendor name, unless it is
    the buyer."""
    # One row per distinct name; both joins below read it.
    by_name = staged(match_names(records, registry, settings, scorer), "names")
    named = left_join_dealt(records, by_name, "vendor_name")
    unsure = named.filter(F.col("komitent_id").isNull() | F.col("komitent_low_confidence"))
    scanned = scan_texts(
        unsure.select(F.col("doc_id").alias("text_id"), F.col("full_text").alias("text")), registry, settings)
    if settings.buyer_pattern:
        scanned = scanned.filter(~F.col("name").rlike(rx(settings.buyer_pattern)))
    scanned = scanned.select(
        F.col("text_id").alias("doc_id"), F.col("id").alias("scan_id"), F.col("name").alias("scan_name"),
        F.col("score").alias("scan_score"))
    hit = F.col("scan_id").isNotNull()
    return (
        named.join(scanned, "doc_id", "left")
        .withColumns({
            "komitent_id": F.coalesce("scan_id", "komitent_id"),
            "komitent_name": F.coalesce("scan_name", "komitent_name"),
            "komitent_score": F.coalesce("scan_score", "komitent_score"),
            "komitent_low_confidence": F.when(hit, False).otherwise(F.coalesce("komitent_low_confidence", F.lit(False))),
            "vendor_name": F.coalesce("scan_name", "vendor_name"),
            "route": F.when(hit, "scan").otherwise(F.col("route")),
        })
        .drop("scan_id", "scan_name", "scan_score")
    )


def fill_siblings(rows: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Fill the missing one of komitent_id and komitent_name from the registry. rows: row_id, both."""
    id_known = F.coalesce(F.trim("komitent_id"), F.lit("")) != ""
    by_id = lookup_ids(rows.withColumnRenamed("komitent_name", "written"), registry)
    asked = rows.filter(~id_known & (F.length(F.trim("komitent_name")) >= 3)).select(
        F.trim("komitent_name").alias("vendor_name"))
    matched = match_names(asked, registry, settings).select(
        F.col("vendor_name").alias("_name"), F.col("komitent_id").alias("_found"))
    return (
        left_join_dealt(by_id.withColumn("_name", F.trim("written")), matched, "_name")
        .withColumns({
            "komitent_id": F.when(id_known, F.col("komitent_id")).otherwise(F.col("_found")),
            "komitent_name": F.when(id_known, F.coalesce("komitent_name", "written")).otherwise(F.col("written")),
        })
        .drop("written", "_name", "_found")
    )
