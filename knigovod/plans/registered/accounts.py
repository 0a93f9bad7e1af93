"""Account suggestion and learning."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from knigovod import fixed_values
from knigovod.fixed_values import OTHER_KONTO_LABELS
from knigovod.operators import accounts as ac
from knigovod.operators import featurize
from knigovod.operators.stages import shared_path
from knigovod.plans.bindings import (
    texts, ACCOUNTS, PART_RULES, SETTINGS, accounts, corrections, part_rules, rule_case, table, vector_accounts, vector_queries)
from knigovod.plans.registered import plain, with_sql
from knigovod.plans.registered.journals import JOURNAL, entries

# The given vectors point everywhere; at the usual thresholds none would be near another.
NEAR = replace(SETTINGS, correction_similarity=0.35, description_similarity=0.3)

DOCUMENT_RULES = [(i, konto, "", k) for i, (konto, words) in enumerate(fixed_values.DOCUMENT_RULES) for k in words]


def konto_rules(spark, sf):
    asked = texts(spark, sf).select(F.col("doc_id").alias("text_id"), "text")
    ruled = ac.suggest_by_rules(asked, ac.konto_rules(spark))
    return ruled.select(F.col("text_id").alias("doc_id"), F.coalesce("rule_konto", F.lit("4499")).alias("konto"))


konto_rules_sql = f"SELECT doc_id, {rule_case('text', DOCUMENT_RULES)} AS konto FROM documents"


def konto_labels(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", ac.rule_konto(F.col("p_name"), ac.listed_rules(part_rules(spark))).alias("konto"))
    filled = parts.withColumn("konto", F.coalesce("konto", F.when(F.col("p_partkey") % 2 == 0, "4499").otherwise("9999")))
    return ac.konto_labels(filled, part_rules(spark)).select("p_partkey", "konto", "label")


def konto_rules_many(spark, sf):
    """All documents by a rule for each word of the benchmark items: thousands of keywords, the first item's count first."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("rule_order"), F.explode(
        F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), 1)).alias("keyword"))
    rules = items.select("rule_order", F.concat(F.lit("4"), F.length("keyword")).alias("konto"), F.lit("").alias("label"), "keyword").distinct()
    asked = texts(spark, sf).select(F.col("doc_id").alias("text_id"), "text")
    return ac.suggest_by_rules(asked, rules).select(F.col("text_id").alias("doc_id"), F.col("rule_konto").alias("konto"))


rules_many_sql = """WITH words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS keyword FROM benchmark),
firsts AS (SELECT keyword, min(item_id) AS rule_order FROM words GROUP BY 1)
SELECT doc_id, (SELECT '4' || len(keyword) FROM firsts WHERE contains(lower(text), keyword) ORDER BY rule_order, '4' || len(keyword) LIMIT 1) AS konto FROM documents"""

_LABELS = " ".join(f"WHEN '{k}' THEN '{l}'" for k, l in {**{k: l for _, k, l, _ in PART_RULES}, **OTHER_KONTO_LABELS}.items())
labels_sql = f"""SELECT p_partkey, konto, CASE konto {_LABELS} ELSE '' END AS label
FROM (SELECT p_partkey, {rule_case('p_name').replace("ELSE '4499'", "ELSE CASE WHEN p_partkey % 2 = 0 THEN '4499' ELSE '9999' END")} AS konto FROM part)"""


def konto_describe(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(
        F.lit("4"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("konto"))
    return plain(ac.describe(rows, accounts(spark, sf)))


describe_sql = with_sql(ACCOUNTS, """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, '4' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS konto,
  acc.description AS konto_description
FROM lineitem LEFT JOIN acc ON acc.code = '4' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')""")


def account_search(spark, sf):
    queries = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.concat(F.lpad((F.col("s_suppkey") % 90 + 10).cast("string"), 2, "0"),
                                                       F.when(F.col("s_suppkey") % 2 == 0, "7").otherwise("")).alias("query"))
    return plain(ac.search_accounts(queries, accounts(spark, sf)))


account_search_sql = with_sql(ACCOUNTS, """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY acct_order) AS place, code, description
FROM (SELECT s_suppkey AS query_id, (s_suppkey % 90 + 10) || CASE WHEN s_suppkey % 2 = 0 THEN '7' ELSE '' END AS query FROM supplier) q
JOIN acc ON contains(lower(code), query) OR contains(lower(description), query) QUALIFY place <= 8""")

def account_search_many(spark, sf):
    """What every order's number finds in the chart of accounts."""
    queries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("query"))
    return plain(ac.search_accounts(queries, accounts(spark, sf)))


search_many_sql = with_sql(ACCOUNTS, """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY acct_order) AS place, code, description
FROM (SELECT o_orderkey AS query_id, CAST(o_orderkey AS VARCHAR) AS query FROM orders) q
JOIN acc ON contains(lower(code), query) OR contains(lower(description), query) QUALIFY place <= 8""")

VECTORS = """vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
corr AS (SELECT vec_id AS id, e, '4' || label AS konto FROM vec),
chart AS (SELECT vec_id AS id, e, '41' || label AS konto FROM vec WHERE vec_id % 4 <> 1),
ask AS (SELECT vec_id AS query_id, list_reverse(e) AS e, coalesce(text, '') AS text FROM vec LEFT JOIN documents ON doc_id = vec_id),
learned AS (SELECT query_id, konto, list_inner_product(ask.e, corr.e) AS s FROM ask, corr
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) = 1 AND s >= 0.35),
described AS (SELECT query_id, konto, list_inner_product(ask.e, chart.e) AS s FROM ask, chart
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) = 1 AND s >= 0.3)"""


def konto_nearest_correction(spark, sf):
    near = ac.nearest_correction(vector_queries(spark, sf), corrections(spark, sf), NEAR)
    return near.select("query_id", "konto", F.round("similarity", 3).alias("similarity"))


correction_sql = with_sql(VECTORS, "SELECT query_id, konto, round(s, 3) AS similarity FROM learned")


def konto_nearest_partitioned(spark, sf):
    """The same with the corrections partitioned around pivots, as those beyond memory are."""
    items, fewest = corrections(spark, sf).withColumnRenamed("corr_id", "item_id"), 8 * 64 * 32
    near = ac.nearest(vector_queries(spark, sf), items, NEAR.correction_similarity, max_bytes=fewest)
    return near.join(items.select("item_id", "konto"), "item_id").select("query_id", "konto", F.round("similarity", 3).alias("similarity"))


def konto_nearest_account(spark, sf):
    near = ac.nearest_account(vector_queries(spark, sf), vector_accounts(spark, sf), NEAR)
    return near.select("query_id", "konto", F.round("similarity", 3).alias("similarity"))


account_sql = with_sql(VECTORS, "SELECT query_id, konto, round(s, 3) AS similarity FROM described")


def konto_suggest(spark, sf):
    made = ac.suggest(vector_queries(spark, sf), corrections(spark, sf), vector_accounts(spark, sf), ac.konto_rules(spark), NEAR)
    return made.select("query_id", "konto", "method", "confidence")


suggest_sql = with_sql(VECTORS, f"""
SELECT a.query_id, coalesce(l.konto, d.konto, {rule_case('a.text', DOCUMENT_RULES)}) AS konto,
  CASE WHEN l.konto IS NOT NULL THEN 'learned_correction' WHEN d.konto IS NOT NULL THEN 'embedding_match' ELSE 'keyword' END AS method,
  coalesce(round(l.s, 3), round(d.s, 3), 0) AS confidence
FROM ask a LEFT JOIN learned l USING (query_id) LEFT JOIN described d USING (query_id)""")


def _edited(text):
    """A text with its first thirty characters gone and a line of its own added: what a later document of a vendor looks like."""
    return F.concat(F.substring(text, 31, 1000000000), F.lit("\n"), F.lit("услуга за месец"))


def _n_words(text):
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def konto_from_texts(spark, sf):
    """All documents, edited, against all documents as past corrections, both by the stored weights of the words."""
    known = texts(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = shared_path(spark, f"weights-{uuid.uuid4().hex}")
    featurize.save(featurize.fit(known), path)
    weights = featurize.load(spark, path)
    corrections = featurize.featurized(known.select(
        F.col("doc_id").alias("corr_id"), F.concat(F.lit("4"), _n_words(F.col("text")) % 10).alias("konto"), "text"), weights)
    asked = featurize.featurized(known.select(F.col("doc_id").alias("query_id"), _edited(F.col("text")).alias("text")), weights)
    near = ac.nearest_correction(asked, corrections, SETTINGS)
    return near.select("query_id", "konto", F.round("similarity", 3).alias("similarity"))


def konto_from_descriptions(spark, sf):
    """All parts, as printed on an invoice line, against the descriptions of the chart of accounts."""
    chart = accounts(spark, sf).select("acct_order", F.lower("description").alias("text"))
    weights = featurize.fit(chart)
    described = featurize.featurized(chart.withColumn("code", F.concat(F.lit("4"), F.md5(F.col("text").cast("binary")))), weights)
    asked = featurize.featurized(table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat(F.lit("Услуга "), "p_name", F.lit(" / "), "p_type").alias("text")), weights)
    near = ac.nearest_account(asked, described, SETTINGS)
    return near.select("query_id", "konto", F.round("similarity", 3).alias("similarity"))


def _nearest_sql(items: str, asked: str, least: float) -> str:
    """Nearest of `items` (id, konto, text) to each of `asked` (id, text), by hashed and weighted words."""
    hits = " OR ".join(f"contains(lower(x), '{k}')" for k in fixed_values.DESCRIPTION_KEYWORDS)
    return with_sql(f"""given AS (SELECT 'item' AS side, id, text FROM ({items}) UNION ALL SELECT 'query', id, text FROM ({asked}))""", f"""
focused AS (SELECT side, id, left(trim(left(text, 350) || ' ' || array_to_string([trim(x, ' ') FOR x IN string_split_regex(text, '\r\n|\r|\n') IF {hits}][1:4], ' '), ' '), 500) AS f FROM given)""", """
hashed AS (SELECT side, id, md5(unnest(regexp_extract_all(lower(f), '[\\p{L}\\p{N}]+'))) AS h FROM focused)""", """
placed AS (SELECT side, id, CAST('0x' || substr(h, 1, 7) AS BIGINT) % 384 AS place, sum(CASE WHEN CAST('0x' || substr(h, 8, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS n
  FROM hashed GROUP BY ALL)""", """
weights AS (SELECT place, ln(((SELECT count(*) FROM given WHERE side = 'item') + 1.0) / (count(DISTINCT id) + 1.0)) AS w FROM placed WHERE side = 'item' GROUP BY place)""", """
weighted AS (SELECT side, id, place, n * w AS x FROM placed JOIN weights USING (place))""", """
vectors AS (SELECT side, id, place, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS x FROM weighted WHERE x <> 0)""", f"""
products AS (SELECT q.id AS query_id, i.id, round(sum(q.x * i.x), 9) AS s FROM vectors q JOIN vectors i ON q.side = 'query' AND i.side = 'item' AND q.place = i.place
  GROUP BY q.id, i.id HAVING sum(q.x * i.x) >= {least} QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(sum(q.x * i.x), 9) DESC, i.id) = 1)""", f"""
SELECT query_id, konto, round(s, 3) AS similarity FROM products JOIN ({items}) USING (id)""")


from_texts_sql = _nearest_sql(
    "SELECT doc_id AS id, '4' || len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) % 10 AS konto, coalesce(text, '') AS text FROM documents",
    "SELECT doc_id AS id, substr(coalesce(text, ''), 31) || chr(10) || 'услуга за месец' AS text FROM documents", SETTINGS.correction_similarity)
from_descriptions_sql = _nearest_sql(
    "SELECT p_partkey AS id, '4' || md5(lower(p_name || ' ' || p_type)) AS konto, lower(p_name || ' ' || p_type) AS text FROM part",
    "SELECT p_partkey AS id, 'Услуга ' || p_name || ' / ' || p_type AS text FROM part", SETTINGS.description_similarity)


def approvals(spark, sf):
    """Every vector backwards as a new approval, some of these again later with another account, and every known correction
    again. Approvals without an account teach nothing."""
    e = table(spark, sf, "embeddings")
    row = lambda shift, vector, konto: (
        (F.col("vec_id") + shift).alias("corr_id"), vector.alias("embedding"), konto.alias("konto"),
        F.lit(None).cast("string").alias("komitent_id"), F.lit("").alias("preview"))
    backwards = F.reverse("embedding")
    new = e.select(*row(10**12, backwards, F.concat(F.lit("5"), "label")))
    again = e.select(*row(2 * 10**12, backwards, F.when(F.col("vec_id") % 20 == 2, F.concat(F.lit("6"), "label"))))
    known = e.select(*row(3 * 10**12, F.col("embedding"), F.when(F.col("vec_id") % 50 == 0, F.concat(F.lit("7"), "label")).otherwise("")))
    return new.unionByName(again).unionByName(known)


def learn_upsert(spark, sf):
    return ac.learn(corrections(spark, sf), approvals(spark, sf), SETTINGS).select("corr_id", "konto")


learn_sql = """SELECT vec_id AS corr_id, CASE WHEN vec_id % 50 = 0 THEN '7' ELSE '4' END || label AS konto FROM embeddings
UNION ALL SELECT vec_id + 1000000000000, CASE WHEN vec_id % 20 = 2 THEN '6' ELSE '5' END || label FROM embeddings"""


def drifting(spark, sf):
    """Four approvals of each vector, each turned on a little from the one before: like that one, unlike the one before it.
    In every third chain the second approval has no account, so that the third is like nothing that was learned."""
    turned = F.expr("""transform(embedding, (x, i) -> cast(
        cos(0.2D * step) * x + sin(0.2D * step) * if(i % 2 = 0, -embedding[i + 1], embedding[i - 1]) AS float))""")
    steps = table(spark, sf, "embeddings").withColumn("step", F.explode(F.expr("sequence(1, 4)")))
    taught = (F.col("step") != 2) | (F.col("vec_id") % 3 != 0)
    return steps.select(
        (F.col("vec_id") + F.col("step") * F.lit(10**12)).alias("corr_id"), turned.alias("embedding"),
        F.when(taught, F.concat(F.col("step").cast("string"), F.col("label").cast("string"))).alias("konto"),
        F.lit(None).cast("string").alias("komitent_id"), F.lit("").alias("preview"))


def learn_chains(spark, sf):
    """Chains of approvals inside one batch end as one-by-one learning has them: the last one in the first one's place."""
    return ac.learn(corrections(spark, sf), drifting(spark, sf), SETTINGS).select("corr_id", "konto")


chains_sql = """SELECT vec_id AS corr_id, CASE WHEN vec_id % 3 = 0 THEN '1' ELSE '4' END || label AS konto FROM embeddings
UNION ALL SELECT vec_id + 3000000000000, '4' || label FROM embeddings WHERE vec_id % 3 = 0"""


def approve_to_correction(spark, sf):
    """What approving the orders that have a document of the same number would teach."""
    from knigovod.operators.journal import first_expense_line

    previews = texts(spark, sf).select(F.col("doc_id").alias("invoice_id"), F.substring("text", 1, 120).alias("preview"))
    return first_expense_line(entries(spark, sf)).join(previews, "invoice_id")


approve_sql = with_sql(JOURNAL, """
SELECT invoice_id, konto, left(text, 120) AS preview FROM (SELECT invoice_id, konto FROM journal WHERE debit_c > 0 AND konto <> '2200'
  QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY line_no NULLS LAST, l_partkey, l_suppkey) = 1) JOIN documents ON doc_id = invoice_id""")

QUERIES = {
    "konto_rules": (konto_rules, konto_rules_sql),
    "konto_rules_many": (konto_rules_many, rules_many_sql),
    "account_search_many": (account_search_many, search_many_sql),
    "konto_labels": (konto_labels, labels_sql),
    "konto_describe": (konto_describe, describe_sql),
    "account_search": (account_search, account_search_sql),
    "konto_nearest_correction": (konto_nearest_correction, correction_sql),
    "konto_nearest_partitioned": (konto_nearest_partitioned, correction_sql),
    "konto_nearest_account": (konto_nearest_account, account_sql),
    "konto_suggest": (konto_suggest, suggest_sql),
    "konto_from_texts": (konto_from_texts, from_texts_sql),
    "konto_from_descriptions": (konto_from_descriptions, from_descriptions_sql),
    "learn_upsert": (learn_upsert, learn_sql),
    "learn_chains": (learn_chains, chains_sql),
    "approve_to_correction": (approve_to_correction, approve_sql),
}
