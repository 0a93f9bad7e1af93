"""Journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from knigovod.fixed_values import DEFAULT_KONTO, PAYABLE_TEXT
from knigovod.operators import journal as jn
from knigovod.operators.accounts import listed_rules, rule_konto
from knigovod.plans.bindings import INVOICES, LINES, invoices, lines, part_rules, rule_case
from knigovod.plans.registered import plain, with_sql


def _konto(spark):
    return F.coalesce(rule_konto(F.col("konto_text"), listed_rules(part_rules(spark))), F.lit(DEFAULT_KONTO))


def entries(spark, sf):
    return jn.journal(invoices(spark, sf), lines(spark, sf), _konto(spark))


_UNITS = "CASE WHEN {0} >= 0 THEN ({0} + 50) // 100 ELSE -((-({0}) + 50) // 100) END"

# Gross of a line in cents, halves upwards also below zero.
JOURNAL = f"""{INVOICES}, {LINES},
gross AS (SELECT *, description = 'Rounding adjustment' AS rounding,
  CASE WHEN rate > 0 THEN CAST(floor((net_c * (100 + rate) + 50) / 100.0) AS BIGINT) ELSE net_c END AS gross_c FROM lines),
per AS (SELECT invoice_id, coalesce(sum(net_c) FILTER (rounding), 0) AS rounding_c, count(*) FILTER (NOT rounding AND rate > 0) AS taxed
  FROM gross GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY rate > 0 DESC, gross_c DESC, line_no, l_partkey, l_suppkey) AS place
  FROM gross WHERE NOT rounding),
adjusted AS (SELECT r.*, inv.vendor, inv.konto_suggestion, r.gross_c
    + CASE WHEN place > 1 THEN 0 WHEN taxed > 0 THEN CASE WHEN abs(rounding_c) >= 50 THEN rounding_c ELSE 0 END ELSE tax_c END AS amount_c
  FROM ranked r JOIN per USING (invoice_id) JOIN inv USING (invoice_id)),
posted AS (SELECT *, {_UNITS.format('amount_c')} AS units FROM adjusted WHERE amount_c <> 0),
sums AS (SELECT invoice_id, sum(units) AS units FROM posted GROUP BY 1),
journal AS (
  SELECT invoice_id, line_no, l_partkey, l_suppkey, coalesce(konto_suggestion, {rule_case("description || ' ' || vendor")}) AS konto,
    description AS opis, CASE WHEN amount_c >= 0 THEN units ELSE 0 END * 100 AS debit_c,
    CASE WHEN amount_c < 0 THEN -units ELSE 0 END * 100 AS credit_c
  FROM posted
  UNION ALL
  SELECT invoice_id, NULL, NULL, NULL, coalesce(konto_suggestion, {rule_case('vendor')}), vendor, (total_c + 50) // 100 * 100, 0
  FROM inv WHERE invoice_id NOT IN (SELECT invoice_id FROM per)
  UNION ALL
  SELECT invoice_id, NULL, NULL, NULL, '2200', '{PAYABLE_TEXT}', 0,
    CASE WHEN per.invoice_id IS NULL THEN (total_c + 50) // 100 * 100 WHEN coalesce(units, 0) <> 0 THEN units * 100 ELSE total_c END
  FROM inv LEFT JOIN per USING (invoice_id) LEFT JOIN sums USING (invoice_id))"""


def journal_entries(spark, sf):
    return plain(entries(spark, sf), "invoice_id", "konto", "opis", "debit", "credit")


journal_sql = with_sql(JOURNAL, "SELECT invoice_id, konto, opis, debit_c / 100.0 AS debit, credit_c / 100.0 AS credit FROM journal")


def journal_balance(spark, sf):
    return plain(jn.journal_totals(entries(spark, sf)))


balance_sql = with_sql(JOURNAL, """
SELECT invoice_id, sum(debit_c) / 100.0 AS debit, sum(credit_c) / 100.0 AS credit, sum(debit_c) = sum(credit_c) AS balanced
FROM journal GROUP BY 1""")


def journal_by_account(spark, sf):
    return plain(jn.group_by_konto(entries(spark, sf)), "invoice_id", "konto", "opis", "debit", "credit", "n")


by_account_sql = with_sql(JOURNAL, """
SELECT invoice_id, konto, CASE WHEN count(*) > 1 THEN count(*) || ' entries' ELSE min(opis) END AS opis,
  sum(debit_c) / 100.0 AS debit, sum(credit_c) / 100.0 AS credit, count(*) AS n
FROM journal GROUP BY 1, 2""")


def journal_rounding(spark, sf):
    """What rounding lines add up to, and whether the journal takes it up."""
    rounding = lines(spark, sf).filter(jn.is_rounding(F.col("description")))
    sums = rounding.groupBy("invoice_id").agg(F.sum("line_total").alias("rounding_sum"))
    return plain(sums.withColumn("absorbed", F.abs("rounding_sum") >= F.lit(jn.ABSORB_FROM).cast("decimal(18,2)")))


rounding_sql = with_sql(LINES, """
SELECT invoice_id, sum(net_c) / 100.0 AS rounding_sum, abs(sum(net_c)) >= 50 AS absorbed
FROM lines WHERE description = 'Rounding adjustment' GROUP BY 1""")


def first_expense_account(spark, sf):
    return jn.first_expense_line(entries(spark, sf))


first_sql = with_sql(JOURNAL, """
SELECT invoice_id, konto FROM journal WHERE debit_c > 0 AND konto <> '2200'
QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY line_no NULLS LAST, l_partkey, l_suppkey) = 1""")

def journals_completed(spark, sf):
    """Exported invoices bring a journal row of their own; the others get theirs generated."""
    inv, rows = invoices(spark, sf), lines(spark, sf)
    brought = inv.filter("status = 'Exported'").select(
        "invoice_id", F.lit(None).cast(rows.schema["line_key"].dataType).alias("line_key"), F.lit("9990").alias("konto"),
        F.lit("as posted").alias("opis"), F.col("total").alias("debit"), F.col("total").alias("credit"))
    return plain(jn.completed(brought, inv, rows, _konto(spark)), "invoice_id", "konto", "opis", "debit", "credit")


completed_sql = with_sql(JOURNAL, """
SELECT invoice_id, konto, opis, debit_c / 100.0 AS debit, credit_c / 100.0 AS credit FROM journal
WHERE invoice_id NOT IN (SELECT invoice_id FROM inv WHERE status = 'Exported')
UNION ALL SELECT invoice_id, '9990', 'as posted', total_c / 100.0, total_c / 100.0 FROM inv WHERE status = 'Exported'""")

QUERIES = {
    "journal_entries": (journal_entries, journal_sql),
    "journal_balance": (journal_balance, balance_sql),
    "journal_by_account": (journal_by_account, by_account_sql),
    "journal_rounding": (journal_rounding, rounding_sql),
    "journals_completed": (journals_completed, completed_sql),
    "first_expense_account": (first_expense_account, first_sql),
}
