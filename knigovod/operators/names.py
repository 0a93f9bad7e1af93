"""How alike two names are by edits and by words, and the exact join that finds all pairs from a floor upwards.

The score is the highest of three: the share of letters that need no edit, the share of common words, and a fixed score
where all words of one name are in the other. Each has a join of its own that looks at few pairs:

* Edits: an edit changes at most three trigrams, so of two names at most `d` edits apart one holds, among its rarest
  trigrams, one of the other's rarest, no more than d places off. Names meet on it and on the length of one. Where so many
  edits are allowed that no trigram need be left, one name is cut into d + 1 pieces, of which one occurs unchanged in the
  other, at a place that the edits before and after it allow; names meet on piece, its number and both lengths.
* Common words: names meet on their rarest words, as many as must hold one common word.
* Words in the other: the rarest word of the shorter name must be one of the other's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knigovod.operators.stages import staged

#: Score of a name whose words are all in the other, and the letters that those words must have together.
CONTAINED, CONTAINED_LETTERS = 90.0, 4


def words(form: Column) -> Column:
    return F.filter(F.array_distinct(F.split(form, " ")), lambda w: w != "")


def edit_score(a: Column, b: Column) -> Column:
    """Percentage of letters that stay, to one decimal."""
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.round(100.0 * (longer - F.levenshtein(a, b)) / longer, 1)


def word_score(a: Column, b: Column) -> Column:
    """Percentage of common words, or CONTAINED where all words of one are in the other."""
    common = F.array_intersect(a, b)
    fewer = F.least(F.size(a), F.size(b))
    letters = F.aggregate(common, F.lit(0), lambda n, w: n + F.length(w))
    contained = F.when((F.size(common) == fewer) & (letters >= CONTAINED_LETTERS), CONTAINED).otherwise(0.0)
    return F.greatest(F.round(100.0 * F.size(common) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 1), contained)


def _edits(floor: float, longer: str) -> str:
    """Most edits between two names, the longer of which has so many letters, that round to a score of `floor`."""
    return f"cast(floor({longer} * {(100.05 - floor) / 100.0} + 1e-9) as int)"


#: Whether names of the lengths l_length and r_length that are at most d edits apart must share a trigram.
_SHARES = "greatest(l_length, r_length) - 2 - 3 * d > 0"


def _pieces(entries: DataFrame, floor: float) -> DataFrame:
    """One row per entry, number of edits that some length allows, and piece; for edits that may leave no trigram."""
    share = (floor - 0.05) / 100.0
    least, most = _edits(floor, "length(form)"), _edits(floor, f"floor(length(form) / {share} + 1e-9)")
    cut = entries.filter("form <> ''").select("reg_order", "form", F.expr("length(form)").alias("r_length"), F.expr(f"explode(sequence({least}, {most}))").alias("d"))
    at = lambda i: f"cast(floor(({i}) * r_length / (d + 1)) as int)"
    piece = f"struct(i as i, substr(form, {at('i')} + 1, {at('i + 1')} - {at('i')}) as piece)"
    return cut.filter("r_length - 2 - 3 * d <= 0").select(
        "reg_order", F.col("form").alias("r_form"), "r_length", "d", F.expr(f"inline(transform(sequence(0, d), i -> {piece}))"))


def _sized(names: DataFrame, floor: float) -> DataFrame:
    """One row per name and length of a possible entry, with the edits that these allow."""
    share = (floor - 0.05) / 100.0
    sized = names.filter("form <> ''").withColumn("l_length", F.expr("length(form)")).withColumn("r_length", F.expr(
        f"explode(sequence(cast(ceil(l_length * {share} - 1e-9) as int), cast(floor(l_length / {share} + 1e-9) as int)))"))
    return sized.filter("r_length > 0").withColumn("d", F.expr(_edits(floor, "greatest(l_length, r_length)")))


def _places(names: DataFrame, floor: float) -> DataFrame:
    """One row per name, length of a possible entry, number of a piece, and what may stand there in the name."""
    sized = _sized(names, floor).filter(f"not ({_SHARES})").select(
        "name_id", "form", "l_length", "r_length", "d", F.expr("explode(sequence(0, d))").alias("i"))
    at = lambda i: f"cast(floor(({i}) * r_length / (d + 1)) as int)"
    sized = sized.withColumns({"start": F.expr(at("i")), "n": F.expr(f"{at('i + 1')} - {at('i')}")})
    # A piece moves by no more than the edits before it, and by what is left of the difference of lengths after it.
    placed = sized.withColumns({
        "low": F.expr("greatest(0, start - i, start + l_length - r_length - (d - i))"),
        "high": F.expr("least(l_length - n, start + i, start + l_length - r_length + (d - i))")}).filter("low <= high")
    return placed.select("name_id", F.col("form").alias("l_form"), "r_length", "d", "i", F.expr(
        "explode(array_distinct(transform(sequence(low, high), p -> substr(form, p + 1, n))))").alias("piece"))


def with_rare_grams(rows: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """Rows with `grams`: their trigrams with their places, as often as they occur, those that entries (form) hold least first."""
    cut = lambda form: F.expr(f"transform(if(length({form}) > 2, sequence(1, length({form}) - 2), cast(array() as array<int>)), "
                              f"i -> struct(substr({form}, i, 3) as gram, i as at))")
    held = entries.select(F.inline(cut("form"))).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    each = rows.select(key, F.inline(cut("form"))).join(held, "gram", "left")
    listed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram", "at"))).alias("grams"))
    return rows.join(listed, key, "left")


#: Entries up to which the planner may choose the joins of what is cut from them.
FEW_ENTRIES = 20_000


def _merged(left: DataFrame, right: DataFrame, keys: list[str], entries: DataFrame) -> DataFrame:
    """Inner join of rows that were cut out of staged tables. By the size of their files these look small, and the planner would
    bring all that was cut from them through the driver; beyond a checked number of entries a sort-merge join never does."""
    if entries.limit(FEW_ENTRIES + 1).count() > FEW_ENTRIES:
        left, right = left.hint("merge"), right.hint("merge")
    return left.join(right, keys)


def _gram_pairs(names: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
    """(name_id, reg_order, l_form, r_form, d) of names and entries that share a rare trigram, where they must."""
    share = (floor - 0.05) / 100.0
    # Of n trigrams, 3 d may be changed, and the other name may have fewer: of the rest the rarest is among these.
    few = lambda own: f"slice(grams, 1, greatest(0, least(size(grams), {own} + 3 * d + 1 - greatest(l_length, r_length))))"
    left = _sized(names, floor).filter(_SHARES).filter("size(grams) > 0").select(
        "name_id", F.col("form").alias("l_form"), "r_length", "d", F.expr(f"inline({few('l_length')})")).filter("held > 0")
    # For an entry, as many as the least favourable length of a name asks for.
    most = f"array_max(transform(sequence(length(form), cast(floor(length(form) / {share} + 1e-9) as int)), l -> length(form) + 3 * {_edits(floor, 'l')} + 1 - l))"
    right = entries.filter("size(grams) > 0").select(
        "reg_order", F.col("form").alias("r_form"), F.expr("length(form)").alias("r_length"),
        F.expr(f"inline(slice(grams, 1, least(size(grams), {most})))")).drop("held").withColumnRenamed("at", "r_at")
    return _merged(left, right, ["r_length", "gram"], entries).filter("abs(at - r_at) <= d")


def edit_pairs(names: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
    """All (name_id, reg_order, score) whose edit score is at least `floor`. names: name_id, form, grams; entries: reg_order,
    form, grams. Empty forms are like nothing."""
    told = ["name_id", "reg_order", "l_form", "r_form", "d"]
    by_piece = _merged(_places(names, floor), _pieces(entries, floor), ["r_length", "d", "i", "piece"], entries)
    met = _gram_pairs(names, entries, floor).select(*told).unionByName(by_piece.select(*told))
    close = met.filter(F.expr("levenshtein(l_form, r_form, d) >= 0")).select(
        "name_id", "reg_order", edit_score(F.col("l_form"), F.col("r_form")).alias("score"))
    return close.filter(F.col("score") >= floor).distinct()


def word_pairs(names: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
    """All (name_id, reg_order, score) whose word score is at least `floor`. Both sides with their words, rarest first."""
    needed = lambda ranked: F.ceil(F.size(ranked) * F.lit((floor - 0.05) / 100.0) - F.lit(1e-9)).cast("int")

    def told(rows: DataFrame, key: str, side: str) -> DataFrame:
        """What a row is found by: kind 0 its rarest words; kinds 1 and 2 its rarest word against all of the other's."""
        rarest = F.slice("ranked", F.lit(1), F.size("ranked") - needed(F.col("ranked")) + 1)
        kinds = [rarest, F.col("ranked"), F.slice("ranked", 1, 1)] if side == "l" else [rarest, F.slice("ranked", 1, 1), F.col("ranked")]
        kept = kinds if floor <= CONTAINED else kinds[:1]
        listed = F.flatten(F.array(*[F.arrays_zip(F.array_repeat(F.lit(n), F.size(k)).alias("kind"), k.alias("word")) for n, k in enumerate(kept)]))
        return rows.filter(F.size("ranked") > 0).select(key, F.col("ranked").alias(f"{side}_words"), F.inline(listed))

    met = _merged(told(names, "name_id", "l"), told(entries, "reg_order", "r"), ["kind", "word"], entries)
    scored = met.select("name_id", "reg_order", word_score(F.col("l_words"), F.col("r_words")).alias("score"))
    return scored.filter(F.col("score") >= floor).distinct()


@dataclass(frozen=True)
class EditsAndWords:
    """The scorer by edits and words. High floors first: there few edits are allowed, and most names are decided."""

    floors: tuple[float, ...] = (96.0, 90.0, 88.0, 80.0, 70.0, 60.0)

    def score(self, a: Column, b: Column) -> Column:
        one, two = F.trim(a), F.trim(b)
        return F.greatest(edit_score(one, two), word_score(words(one), words(two)))

    def prepared(self, names: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides (name_id or reg_order, form) with their words and trigrams, those that few entries hold first."""
        count = entries.select(F.explode(words(F.col("form"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

        def ranked(rows: DataFrame, key: str) -> DataFrame:
            rows = rows.select(key, F.trim("form").alias("form"))
            cut = rows.select(key, F.explode(words(F.col("form"))).alias("word")).join(count, "word", "left")
            listed = cut.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)), "word"))).alias("ranked"))
            worded = rows.join(listed, key, "left").select(key, "form", F.coalesce(F.col("ranked.word"), F.array().cast("array<string>")).alias("ranked"))
            return with_rare_grams(worded, key, entries.select(F.trim("form").alias("form")))

        return staged(ranked(names, "name_id"), "names-by-words"), staged(ranked(entries, "reg_order"), "entries-by-words")

    def pairs(self, names: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
        """All (name_id, reg_order, score) with a score of at least `floor`."""
        both = edit_pairs(names, entries, floor).unionByName(word_pairs(names, entries, floor))
        return both.groupBy("name_id", "reg_order").agg(F.max("score").alias("score"))
