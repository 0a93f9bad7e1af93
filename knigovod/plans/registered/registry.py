"""Counterparty resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from knigovod.operators import registry as rg
from knigovod.operators.names import EditsAndWords
from knigovod.plans.bindings import texts, ASKED, REGISTRY, SETTINGS, asked_names, registry, table
from knigovod.plans.registered import plain, with_sql


def registry_by_id(spark, sf):
    asked = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_custkey", F.lit(" ")).alias("komitent_id"))
    return rg.lookup_ids(asked, registry(spark, sf)).select("o_orderkey", "komitent_name")


by_id_sql = with_sql(REGISTRY, "SELECT o_orderkey, reg.name AS komitent_name FROM orders LEFT JOIN reg ON reg.reg_order = o_custkey")


def fingerprint_tokens(spark, sf):
    return rg.fingerprints(registry(spark, sf), SETTINGS)


FINGERPRINTS = """unique_tokens AS (SELECT token, min(reg_order) AS reg_order
  FROM (SELECT reg_order, unnest(string_split(lower(norm_name), ' ')) AS token FROM reg) WHERE len(token) >= 4 GROUP BY 1 HAVING count(*) = 1)"""
fingerprint_sql = with_sql(REGISTRY, FINGERPRINTS, "SELECT token, reg_order FROM unique_tokens")

_FORM = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"
_GRAMS = "list_distinct([f[i:i+2] for i in range(1, len(f) - 1)])"
_DICE = "round(200.0 * len(list_intersect(n.g, r.g)) / (len(n.g) + len(r.g)), 1)"


def _matched(given: str, score: str) -> str:
    """Names against the registry: `given` is what a score takes, of the compared form f; `score` compares n with r."""
    form = lambda norm: f"{_FORM.format(norm)} AS f"
    return f"""names AS (SELECT vendor_name, norm, {given} FROM (SELECT DISTINCT vendor_name, norm, {form('norm')} FROM asked)),
entries AS (SELECT reg_order, id, name, norm_name, {given} FROM (SELECT *, {form('norm_name')} FROM reg)),
tokens AS (SELECT vendor_name, unnest(list_distinct(list_filter(string_split(norm, ' '), lambda t: len(t) >= 4))) AS token FROM names),
words AS (SELECT reg_order, unnest(list_distinct(string_split(lower(norm_name), ' '))) AS word FROM reg),
vocabulary AS (SELECT DISTINCT word FROM words),
holding AS (SELECT DISTINCT t.token, w.reg_order FROM (SELECT DISTINCT token FROM tokens) t JOIN vocabulary v ON contains(v.word, lower(t.token))
  JOIN words w ON w.word = v.word),
counted AS (SELECT token, reg_order, count(*) OVER (PARTITION BY token) AS n FROM holding),
scored AS (SELECT t.vendor_name, lower(t.token) AS token, c.n, c.reg_order, CASE WHEN c.n = 1 THEN 90.0 ELSE {score} END AS score
  FROM tokens t JOIN counted c ON c.token = t.token AND c.n <= 4 JOIN names n ON n.vendor_name = t.vendor_name JOIN entries r ON r.reg_order = c.reg_order),
by_token AS (SELECT vendor_name, reg_order, score, CASE WHEN n = 1 THEN 'token' ELSE 'candidates' END AS route FROM scored WHERE n = 1 OR score >= 60
  QUALIFY row_number() OVER (PARTITION BY vendor_name ORDER BY len(token) DESC, token, score DESC, reg_order) = 1),
near AS (SELECT n.vendor_name, r.reg_order, {score} AS score FROM names n JOIN entries r ON {score} >= 45
  WHERE n.vendor_name NOT IN (SELECT vendor_name FROM by_token)),
top AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS runner_up FROM near
  WINDOW w AS (PARTITION BY vendor_name ORDER BY score DESC, reg_order)),
winners AS (SELECT vendor_name, reg_order, score, 'similar' AS route FROM top WHERE place = 1 AND (runner_up IS NULL OR score >= runner_up + 5)
  UNION ALL SELECT * FROM by_token),
matched AS (SELECT w.vendor_name, r.id AS komitent_id, r.name AS komitent_name, CAST(w.score AS DOUBLE) AS komitent_score,
  w.score < 60 AS komitent_low_confidence, w.route FROM winners w JOIN reg r USING (reg_order))"""


MATCHED = _matched(f"{_GRAMS} AS g", _DICE)


def registry_match(spark, sf):
    return rg.match_names(asked_names(spark, sf), registry(spark, sf), SETTINGS)


match_sql = with_sql(REGISTRY, ASKED, MATCHED, "SELECT * FROM matched")


def registry_unique_token(spark, sf):
    return registry_match(spark, sf).filter("route = 'token'").select("vendor_name", "komitent_id")


unique_sql = with_sql(REGISTRY, ASKED, MATCHED, "SELECT vendor_name, komitent_id FROM matched WHERE route = 'token'")


def registry_candidates(spark, sf):
    return registry_match(spark, sf).filter("route = 'candidates'").select("vendor_name", "komitent_id", "komitent_score")


candidates_sql = with_sql(REGISTRY, ASKED, MATCHED, "SELECT vendor_name, komitent_id, komitent_score FROM matched WHERE route = 'candidates'")


def registry_fuzzy(spark, sf):
    return registry_match(spark, sf).filter("route = 'similar'").select("vendor_name", "komitent_id", "komitent_score", "komitent_low_confidence")


fuzzy_sql = with_sql(REGISTRY, ASKED, MATCHED, "SELECT vendor_name, komitent_id, komitent_score, komitent_low_confidence FROM matched WHERE route = 'similar'")


def registry_alias(spark, sf):
    from dataclasses import replace

    aliases = replace(SETTINGS, vendor_aliases=((r"\bvndor\d*9\b", "Nine", "n03 vendor"),))
    return rg.match_names(asked_names(spark, sf), registry(spark, sf), aliases).filter("route = 'alias'")


alias_sql = with_sql(REGISTRY, ASKED, """
SELECT DISTINCT a.vendor_name, r.id AS komitent_id, r.name AS komitent_name, CAST(100 AS DOUBLE) AS komitent_score,
  false AS komitent_low_confidence, 'alias' AS route
FROM asked a, (SELECT * FROM reg WHERE contains(lower(norm_name), 'n03 vendor') ORDER BY reg_order LIMIT 1) r
WHERE regexp_matches(lower(a.vendor_name), 'vndor[0-9]*9( |$)')""")


def registry_edits(spark, sf):
    """Names against the registry by the scorer of edits and words."""
    return rg.match_names(asked_names(spark, sf), registry(spark, sf), SETTINGS, EditsAndWords())


_WORDS = "trim(f) AS f, list_distinct(string_split(trim(f), ' ')) AS w"
_COMMON = "list_intersect(n.w, r.w)"
_LONGER = "greatest(len(n.f), len(r.f))"
_EDITS = f"""greatest(round(100.0 * ({_LONGER} - levenshtein(n.f, r.f)) / {_LONGER}, 1),
  round(100.0 * len({_COMMON}) / (len(n.w) + len(r.w) - len({_COMMON})), 1),
  CASE WHEN len({_COMMON}) = least(len(n.w), len(r.w)) AND len(array_to_string({_COMMON}, '')) >= 4 THEN 90.0 ELSE 0.0 END)"""
edits_sql = with_sql(REGISTRY, ASKED, _matched(_WORDS, _EDITS), "SELECT * FROM matched")


def _texts(spark, sf):
    """Given documents with a registered name at the end."""
    d, r = texts(spark, sf), registry(spark, sf)
    named = d.join(r.select(F.col("reg_order").alias("doc_id"), "name"), "doc_id", "left")
    return named.select(F.col("doc_id").alias("text_id"), F.concat_ws("\n", "text", F.upper("name")).alias("text"))


def registry_scan_text(spark, sf):
    found = rg.scan_texts(_texts(spark, sf), registry(spark, sf), SETTINGS)
    return found.select("text_id", "id", "name", "score", "hits")


SCANNED = """texts AS (SELECT doc_id, lower(text || coalesce(chr(10) || reg.name, '')) AS text FROM documents LEFT JOIN reg ON reg.reg_order = doc_id),
scans AS (SELECT doc_id, u.reg_order, count(*) AS hits FROM texts JOIN unique_tokens u ON contains(text, u.token) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, u.reg_order) = 1)"""
scan_sql = with_sql(REGISTRY, FINGERPRINTS, SCANNED, """
SELECT doc_id AS text_id, id, name, CAST(90 AS DOUBLE) AS score, hits FROM scans JOIN reg USING (reg_order)""")


def registry_cascade(spark, sf):
    """Orders as records; those with a document of the same number can be scanned."""
    found = _texts(spark, sf).select(F.col("text_id").alias("doc_id"), F.col("text").alias("full_text"))
    records = asked_names(spark, sf).select("doc_id", "vendor_name").join(found, "doc_id", "left").withColumn(
        "full_text", F.coalesce("full_text", F.lit("")))
    return rg.resolve(records, registry(spark, sf), SETTINGS).select(
        "doc_id", "vendor_name", "komitent_id", "komitent_score", "komitent_low_confidence")


cascade_sql = with_sql(REGISTRY, ASKED, MATCHED, FINGERPRINTS, SCANNED, """
SELECT a.doc_id, CASE WHEN use_scan THEN s.name ELSE a.vendor_name END AS vendor_name,
  CASE WHEN use_scan THEN s.id ELSE m.komitent_id END AS komitent_id,
  CASE WHEN use_scan THEN 90 ELSE m.komitent_score END AS komitent_score,
  CASE WHEN use_scan THEN false ELSE coalesce(m.komitent_low_confidence, false) END AS komitent_low_confidence
FROM asked a LEFT JOIN matched m ON m.vendor_name = a.vendor_name
LEFT JOIN (SELECT doc_id, id, name FROM scans JOIN reg USING (reg_order)) s ON s.doc_id = a.doc_id,
LATERAL (SELECT s.id IS NOT NULL AND (m.komitent_id IS NULL OR m.komitent_low_confidence) AS use_scan) u""")


def registry_search(spark, sf):
    queries = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.concat(F.lit("OR0"), F.lpad(F.floor(F.col("s_suppkey") / 5).cast("string"), 4, "0")).alias("query"))
    return plain(rg.search(queries, registry(spark, sf)))


registry_search_sql = with_sql(REGISTRY, """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY reg_order) AS place, id, name
FROM (SELECT s_suppkey AS query_id, 'or0' || lpad(CAST(s_suppkey // 5 AS VARCHAR), 4, '0') AS query FROM supplier) q
JOIN reg ON contains(lower(name), query) OR contains(lower(norm_name), query) QUALIFY place <= 8""")


def sibling_fill(spark, sf):
    """Orders that know either the id or the name of their counterparty."""
    rows = asked_names(spark, sf).select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("doc_id") % 2 == 0, F.col("c_custkey").cast("string")).alias("komitent_id"),
        F.when(F.col("doc_id") % 2 == 1, F.col("vendor_name")).alias("komitent_name"))
    return rg.fill_siblings(rows, registry(spark, sf), SETTINGS).select("row_id", "komitent_id", "komitent_name")


sibling_sql = with_sql(REGISTRY, ASKED, MATCHED, """
SELECT a.doc_id AS row_id, CASE WHEN a.doc_id % 2 = 0 THEN CAST(cust AS VARCHAR) ELSE m.komitent_id END AS komitent_id,
  CASE WHEN a.doc_id % 2 = 0 THEN reg.name ELSE a.vendor_name END AS komitent_name
FROM asked a LEFT JOIN matched m ON m.vendor_name = a.vendor_name JOIN reg ON reg.reg_order = a.cust""")

QUERIES = {
    "registry_by_id": (registry_by_id, by_id_sql),
    "fingerprint_tokens": (fingerprint_tokens, fingerprint_sql),
    "registry_match": (registry_match, match_sql),
    "registry_unique_token": (registry_unique_token, unique_sql),
    "registry_candidates": (registry_candidates, candidates_sql),
    "registry_fuzzy": (registry_fuzzy, fuzzy_sql),
    "registry_alias": (registry_alias, alias_sql),
    "registry_edits": (registry_edits, edits_sql),
    "registry_scan_text": (registry_scan_text, scan_sql),
    "registry_cascade": (registry_cascade, cascade_sql),
    "registry_search": (registry_search, registry_search_sql),
    "sibling_fill": (sibling_fill, sibling_sql),
}
