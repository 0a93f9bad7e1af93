"""Account suggestion: past corrections, account descriptions, keyword rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knigovod.config import DEFAULT, MAX_BROADCAST_BYTES, Settings
from knigovod.fixed_values import DEFAULT_KONTO, DOCUMENT_RULES, LINE_RULES, OTHER_KONTO_LABELS
from knigovod.functions.amounts import let
from knigovod.functions.vectors import best_match, first_match, stack
from knigovod.operators.contains import contains_join, first_containing, small_rows
from knigovod.operators.stages import staged

# --- Keyword rules -----------------------------------------------------------------------------------


def konto_rules(spark: SparkSession, scope: str = "document") -> DataFrame:
    """The default rule table, for whole documents or for single lines."""
    labels = {konto: label for konto, label, _ in LINE_RULES}
    listed = DOCUMENT_RULES if scope == "document" else [(konto, words) for konto, _, words in LINE_RULES]
    rows = [(order, konto, labels[konto], word) for order, (konto, words) in enumerate(listed) for word in words]
    return spark.createDataFrame(rows, "rule_order int, konto string, label string, keyword string")


def rule_konto(text: Column, rules) -> Column:
    """Account of the first rule one of whose keywords is in the text, null if none is.

    rules: (konto, keyword) in rule order; the list becomes one constant array."""
    listed = F.array(*[F.struct(F.lit(k).alias("konto"), F.lit(w.lower()).alias("keyword")) for k, w in rules])
    # The text is folded once, and the search ends with the first keyword that is found.
    return let(F.lower(text), lambda t: F.aggregate(listed, F.lit(None).cast("string"), lambda hit, r: F.coalesce(
        hit, F.when(F.contains(t, r["keyword"]), r["konto"]))))


def listed_rules(rules: DataFrame):
    """(konto, keyword) in rule order, or None when the table is too large to be folded in."""
    rows = small_rows(rules.select("rule_order", "konto", "keyword").filter("keyword IS NOT NULL"))
    return None if rows is None else [
        (r.konto, r.keyword) for r in sorted(rows, key=lambda r: (r.rule_order, r.konto is not None, r.konto or "", r.keyword))]


def suggest_by_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule_konto (null if no rule fits) to texts (text_id, text)."""
    listed = listed_rules(rules)
    if listed is not None:
        return texts.withColumn("rule_konto", rule_konto(F.col("text"), listed))
    numbered = rules.filter("keyword IS NOT NULL").withColumn("needle_id", F.struct("rule_order", "konto"))
    pairs = contains_join(
        texts.select("text_id", F.lower("text").alias("text")),
        numbered.select("needle_id", F.lower("keyword").alias("needle")))
    first = pairs.groupBy("text_id").agg(F.min("needle_id").alias("rule"))
    return texts.join(first.select("text_id", F.col("rule.konto").alias("rule_konto")), "text_id", "left")


def konto_labels(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the label of each row's konto, empty when unknown."""
    labels = rules.groupBy("konto").agg(F.min(F.struct("rule_order", "label")).alias("first")).select(
        "konto", F.col("first.label").alias("rule_label"))
    fixed = F.create_map(*[F.lit(x) for pair in OTHER_KONTO_LABELS.items() for x in pair])
    return rows.join(labels, "konto", "left").withColumn(
        "label", F.coalesce(fixed[F.col("konto")], "rule_label", F.lit(""))).drop("rule_label")


def describe(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds the description of each row's konto from the chart of accounts."""
    return rows.join(clean_accounts(accounts).select(
        F.col("code").alias("konto"), F.col("description").alias("konto_description")), "konto", "left")


def clean_accounts(accounts: DataFrame) -> DataFrame:
    """Chart of accounts without blanks; of codes listed twice the later description counts."""
    trimmed = accounts.select("acct_order", F.trim("code").alias("code"), F.trim("description").alias("description"))
    kept = trimmed.filter((F.col("code") != "") & (F.col("description") != ""))
    last = kept.groupBy("code").agg(
        F.min("acct_order").alias("acct_order"), F.max(F.struct("acct_order", "description")).alias("last"))
    return last.select("acct_order", "code", F.col("last.description").alias("description"))


def search_accounts(queries: DataFrame, accounts: DataFrame, n: int = 8) -> DataFrame:
    """First `n` accounts whose code or description contains each query (query_id, query)."""
    chart = clean_accounts(accounts)
    texts = chart.select(
        F.struct("acct_order", "code").alias("text_id"), F.lower(F.concat_ws("\n", "code", "description")).alias("text"))
    found = first_containing(texts, queries, n).select("query_id", "place", F.col("text_id.code").alias("code"))
    return found.join(chart.select("code", "description"), "code").select("query_id", "place", "code", "description")


def expense_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts of class 4; all accounts where the chart has none."""
    has_expense = accounts.agg(F.max(F.col("code").startswith("4")).alias("has_expense")).scalar()
    return accounts.filter(F.col("code").startswith("4") | ~has_expense)


# --- Nearest vectors ---------------------------------------------------------------------------------

#: Vectors in a block of the partitioned search.
BLOCK_ROWS = 4096


def _nearest_schema(queries: DataFrame) -> str:
    """Hits carry the queries' own type of id."""
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id bigint, similarity double"


def nearest(queries: DataFrame, items: DataFrame, at_least: float, earlier: bool = False,
            max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Most similar item of each query: (query_id, item_id, similarity >= at_least).

    queries: query_id, embedding; items: item_id, embedding; unit vectors. `earlier` admits only items
    with an id smaller than the query's; items may then have a column `until`, the last query id that still
    meets them (null: all). Ties go to the smaller item id.

    Items that fit `max_bytes` (their count is checked) go to every task as one matrix. More items are
    partitioned around pivots, and by the triangle inequality of angles a query visits only the
    partitions that can hold a hit. Both ways are exact.
    """
    return _searched(queries, items, at_least, earlier, False, max_bytes)


def first_later(queries: DataFrame, items: DataFrame, at_least: float, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The item of the smallest id above the query's that is at least so similar: (query_id, item_id, similarity),
    in the ways of `nearest`."""
    return _searched(queries, items, at_least, False, True, max_bytes)


def _with_until(items: DataFrame) -> DataFrame:
    until = F.col("until") if "until" in items.columns else F.lit(None)
    return items.select("item_id", "embedding", F.coalesce(until.cast("bigint"), F.lit(2**63 - 1)).alias("until"))


def _searched(queries: DataFrame, items: DataFrame, at_least: float, earlier: bool, later: bool, max_bytes: int) -> DataFrame:
    first = items.select(F.size("embedding")).head()
    if first is None:
        return queries.sparkSession.createDataFrame([], _nearest_schema(queries))
    count = items.count()
    if count * first[0] * 8 <= max_bytes:
        return _nearest_in_matrix(queries, items, at_least, earlier, later)
    if not earlier and not later:
        return _nearest_of_distinct(queries, items, at_least, first[0], max_bytes)
    # No more pivots than blocks: where angles rule nothing out, a query is then sent no more often than to each block once.
    return _nearest_by_pivots(queries, items, at_least, earlier, first[0], max_bytes, later=later,
                              max_pivots=min(1024, -(-count // BLOCK_ROWS)))


def _nearest_of_distinct(queries: DataFrame, items: DataFrame, at_least: float, dim: int, max_bytes: int) -> DataFrame:
    """The search of partitioned items once for each distinct vector: of equal items the smaller id is the hit, and equal
    queries have the same one."""
    held = staged(items.groupBy("embedding").agg(F.min("item_id").alias("item_id")), "nearest-items")
    asked = staged(queries.groupBy("embedding").agg(F.min("query_id").alias("first_id")), "nearest-queries")
    count = held.count()
    found = _nearest_by_pivots(asked.withColumnRenamed("first_id", "query_id"), held, at_least, False, dim, max_bytes,
                               max_pivots=min(1024, -(-count // BLOCK_ROWS)))
    named = queries.select("query_id", "embedding").join(asked, "embedding").select("query_id", "first_id")
    hits = named.join(found.withColumnRenamed("query_id", "found_id"), F.col("first_id").eqNullSafe(F.col("found_id")))
    # An id that stands for several vectors has the nearest of all.
    best = F.max(F.struct("similarity", (-F.col("item_id")).alias("minus")))
    return hits.groupBy("query_id").agg(best.alias("best")).select(
        "query_id", (-F.col("best.minus")).alias("item_id"), F.col("best.similarity").alias("similarity"))


def _nearest_in_matrix(queries: DataFrame, items: DataFrame, at_least: float, earlier: bool, later: bool) -> DataFrame:
    rows = _with_until(items).orderBy("item_id").collect()
    shared = queries.sparkSession.sparkContext.broadcast((
        np.array([r.item_id for r in rows], dtype=np.int64), np.array([r.until for r in rows], dtype=np.int64),
        stack([r.embedding for r in rows])))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, until, matrix = shared.value
        for batch in batches:
            if len(batch):
                yield _hits(batch["query_id"].to_numpy(), stack(batch["embedding"]), ids, until, matrix, at_least, earlier, later)

    return queries.select("query_id", "embedding").mapInPandas(match, _nearest_schema(queries))


def _hits(query_ids, queries, item_ids, until, items, at_least: float, earlier: bool, later: bool) -> pd.DataFrame:
    if later:
        index, score = first_match(queries, items, at_least, query_ids, item_ids)
    else:
        index, score = best_match(queries, items, *((query_ids, item_ids, until) if earlier else ()))
    found = (index >= 0) & (score >= at_least)
    return pd.DataFrame({
        "query_id": query_ids[found], "item_id": item_ids[index[found]], "similarity": score[found]})


def _nearest_by_pivots(queries: DataFrame, items: DataFrame, at_least: float, earlier: bool, dim: int,
                       max_bytes: int, block_rows: int = BLOCK_ROWS, max_pivots: int = 1024, later: bool = False) -> DataFrame:
    spark = queries.sparkSession
    pivots_wanted = max(1, min(max_pivots, max_bytes // (8 * dim)))
    chosen = items.orderBy(F.xxhash64("item_id")).limit(pivots_wanted).select("embedding").collect()
    pivots = spark.sparkContext.broadcast(stack([r.embedding for r in chosen]))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                index, score = best_match(stack(batch["embedding"]), pivots.value)
                yield batch.assign(pivot=index, angle=np.arccos(np.clip(score, -1.0, 1.0)))

    placed = _with_until(items).mapInPandas(
        assign, "item_id bigint, embedding array<float>, until bigint, pivot bigint, angle double")
    # At most one row per pivot.
    sizes = placed.groupBy("pivot").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius = np.full(len(chosen), -np.inf)
    blocks = np.ones(len(chosen), dtype=np.int64)
    for row in sizes:
        radius[row.pivot] = row.radius
        blocks[row.pivot] = -(-row.n // block_rows)
    reach = np.arccos(np.clip(at_least, -1.0, 1.0)) + 1e-9
    plan = spark.sparkContext.broadcast((radius, blocks))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        radius, _ = plan.value
        for batch in batches:
            if len(batch):
                yield from _visits(batch, pivots.value, radius, reach, block_rows)

    n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), (F.col("pivot") + 1).cast("int"))
    visits = queries.select("query_id", "embedding").mapInPandas(
        visit, f"query_id {queries.schema['query_id'].dataType.simpleString()}, embedding array<float>, pivot bigint")
    # Blocks of both sides are of bounded size: items by their block of the pivot, queries by a chunk
    # each; every query chunk meets every item block.
    chunks = visits.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("chunks"))
    item_blocks = (
        placed.withColumn("block", F.pmod(F.xxhash64("item_id"), n_blocks).cast("int"))
        .join(F.broadcast(chunks), "pivot")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("pivot", "block", "chunk", "item_id", "until", "embedding")
    )
    query_blocks = (
        visits.join(F.broadcast(chunks), "pivot")
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
        .select("pivot", "block", "chunk", "query_id", "embedding")
    )

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"].iloc[:0], "item_id": [], "similarity": []}).astype(
                {"item_id": "int64", "similarity": "float64"})
        right = right.sort_values("item_id")
        return _hits(left["query_id"].to_numpy(), stack(left["embedding"]), right["item_id"].to_numpy(),
                     right["until"].to_numpy(), stack(right["embedding"]), at_least, earlier, later)

    key = ["pivot", "block", "chunk"]
    partial = query_blocks.groupBy(*key).cogroup(item_blocks.groupBy(*key)).applyInPandas(multiply, _nearest_schema(queries))
    if later:
        return partial.groupBy("query_id").agg(F.min(F.struct("item_id", "similarity")).alias("best")).select(
            "query_id", "best.item_id", "best.similarity")
    best = F.max(F.struct("similarity", (-F.col("item_id")).alias("minus")))
    return partial.groupBy("query_id").agg(best.alias("best")).select(
        "query_id", (-F.col("best.minus")).alias("item_id"), F.col("best.similarity").alias("similarity"))


def _visits(batch: pd.DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: float, rows: int) -> Iterator[pd.DataFrame]:
    """The queries of a batch, once for each pivot that may hold a hit, in pieces of at most `rows` (or one row's pivots): a
    query may visit every pivot, so a whole batch of visits would have no bound."""
    step = max(1, rows // len(radius))
    for start in range(0, len(batch), step):
        part = batch.iloc[start:start + step]
        angles = np.arccos(np.clip(stack(part["embedding"]) @ pivots.T, -1.0, 1.0))
        row, pivot = np.nonzero(angles - radius[None, :] <= reach)
        yield part.iloc[row].assign(pivot=pivot)


def nearest_correction(queries: DataFrame, corrections: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, konto, similarity) of the most similar past correction."""
    hits = nearest(queries, corrections.withColumnRenamed("corr_id", "item_id"), settings.correction_similarity)
    kontos = corrections.select(F.col("corr_id").alias("item_id"), "konto")
    return hits.join(kontos, "item_id").select("query_id", "item_id", "konto", "similarity")


def nearest_account(queries: DataFrame, accounts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, konto, similarity) of the expense account whose description is most similar.

    accounts: acct_order, code, embedding."""
    expense = expense_accounts(accounts).withColumnRenamed("acct_order", "item_id")
    hits = nearest(queries, expense, settings.description_similarity)
    return hits.join(expense.select("item_id", F.col("code").alias("konto")), "item_id").select(
        "query_id", "item_id", "konto", "similarity")


def suggest(queries: DataFrame, corrections: DataFrame, accounts: DataFrame, rules: DataFrame,
            settings: Settings = DEFAULT) -> DataFrame:
    """Account of each document: correction, else account description, else keyword rule.

    queries: query_id, embedding, text. Adds konto, method, confidence (3 decimals), rule_konto."""
    learned = nearest_correction(queries, corrections, settings).select(
        "query_id", F.struct("konto", F.lit("learned_correction").alias("method"),
                             F.round("similarity", 3).alias("confidence")).alias("learned"))
    # Only what no correction decides is compared with the chart of accounts.
    rest = queries.join(learned.select("query_id"), "query_id", "left_anti")
    described = nearest_account(rest, accounts, settings).select(
        "query_id", F.struct("konto", F.lit("embedding_match").alias("method"),
                             F.round("similarity", 3).alias("confidence")).alias("described"))
    ruled = suggest_by_rules(queries.withColumnRenamed("query_id", "text_id"), rules).withColumnRenamed(
        "text_id", "query_id")
    fallback = F.struct(
        F.coalesce("rule_konto", F.lit(DEFAULT_KONTO)).alias("konto"), F.lit("keyword").alias("method"),
        F.lit(0.0).alias("confidence"))
    return (
        ruled.join(learned, "query_id", "left").join(described, "query_id", "left")
        .withColumn("chosen", F.coalesce("learned", "described", fallback))
        .select(*[c for c in queries.columns if c != "embedding"], "chosen.konto", "chosen.method",
                "chosen.confidence", "rule_konto")
    )


def taken_over(known: DataFrame, approvals: DataFrame, at_least: float) -> DataFrame:
    """(corr_id, follows): the correction whose place each approval takes when all are learned one by one in the order of
    corr_id. Approvals that take a new place have no row. Both tables: corr_id, embedding.

    An approval follows the most similar of the corrections that hold a place when it comes, those before it that nothing
    has followed yet. So who follows whom depends on earlier approvals only, and rounds that search with the lifetimes of
    the last one settle at least one more approval each, in order, until nothing changes; then all are as one-by-one learning
    has them. The first round takes every correction to end at the first later approval that is like it, which is already
    right for groups in which all are alike, however large."""
    asked = approvals.select(F.col("corr_id").alias("query_id"), "embedding")
    nodes = known.select("corr_id", "embedding").unionByName(approvals.select("corr_id", "embedding"))
    ends = staged(first_later(nodes.withColumnRenamed("corr_id", "query_id"), asked.withColumnRenamed("query_id", "item_id"), at_least)
                  .select(F.col("query_id").alias("item_id"), F.col("item_id").alias("until")), "learn-ends")
    # Only these can be followed, and only approvals that are like one of them can follow.
    held = staged(nodes.withColumnRenamed("corr_id", "item_id").join(ends.select("item_id"), "item_id", "left_semi"), "learn-held")
    liked = nearest(asked, held, at_least, earlier=True).select("query_id")
    asked = staged(asked.join(liked, "query_id", "left_semi"), "learn-asked")
    while True:
        found = staged(nearest(asked, held.join(ends, "item_id", "left"), at_least, earlier=True).select("query_id", "item_id"), "learn-found")
        now = staged(found.groupBy("item_id").agg(F.min("query_id").alias("until")), "learn-ends")
        changed = now.withColumnRenamed("until", "now").join(ends, "item_id", "full").filter(~F.col("now").eqNullSafe(F.col("until")))
        if changed.isEmpty():
            return found.select(F.col("query_id").alias("corr_id"), F.col("item_id").alias("follows"))
        ends = now


def places(follows: DataFrame) -> DataFrame:
    """(corr_id, place): the first correction of the chain that each follower stands in, by doubled steps."""
    steps = follows.select("corr_id", F.col("follows").alias("place"))
    while True:
        on = steps.select(F.col("corr_id").alias("place"), F.col("place").alias("further"))
        further = staged(steps.join(on, "place", "left").select("corr_id", F.coalesce("further", "place").alias("place"),
                                                                F.col("further").isNotNull().alias("moved")), "learn-places")
        steps = further.select("corr_id", "place")
        if further.filter("moved").isEmpty():
            return steps


def learn(corrections: DataFrame, approvals: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Corrections table after a batch of approvals (corr_id = arrival order, each its own, larger than any known).

    The table is the one that learning them one by one gives: an approval at least `duplicate_similarity` like a correction
    takes the place of the nearest one as the table stands then (equally near ones: the smaller corr_id), and others are added.
    Approvals without an account or a vector teach nothing. Needs `spark.checkpoint.dir`."""
    usable = staged(approvals.filter((F.coalesce("konto", F.lit("")) != "") & F.col("embedding").isNotNull()), "learn-approvals")
    follows = taken_over(corrections.filter(F.col("embedding").isNotNull()), usable, settings.duplicate_similarity)
    placed = usable.join(places(follows), "corr_id", "left").withColumn("place", F.coalesce("place", "corr_id"))
    newest = placed.groupBy("place").agg(F.max("corr_id").alias("corr_id"))
    updates = placed.join(newest, ["place", "corr_id"]).select(
        F.col("place").alias("corr_id"), "embedding", "konto", "komitent_id", "preview")
    kept = corrections.join(updates.select("corr_id"), "corr_id", "left_anti")
    return kept.select("corr_id", "embedding", "konto", "komitent_id", "preview").unionByName(updates)
