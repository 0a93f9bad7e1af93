"""Arithmetic checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from knigovod.functions.amounts import money
from knigovod.operators import verify
from knigovod.plans.bindings import INVOICES, STATED_LINES, from_cents, invoices, stated_lines
from knigovod.plans.registered import money_text, plain, with_sql


def line_math_check(spark, sf):
    return plain(verify.check_lines(stated_lines(spark, sf)), "invoice_id", "line_no", "stated", "expected", "line_total", "flag")


LINE_FLAG = f"""CASE WHEN stated_c <> expected_c THEN 'LINE_MATH_ERROR: Line ' || line_no || ' (''' || description[:40] || ''') — stated '
  || {money_text('stated_c')} || ', Python recalculates ' || {money_text('expected_c')} || ' (delta '
  || {money_text('abs(stated_c - expected_c)')} || '). Corrected to Python value.' END"""

line_math_sql = with_sql(STATED_LINES, f"""
SELECT invoice_id, CAST(line_no AS BIGINT) AS line_no, stated_c / 100.0 AS stated, expected_c / 100.0 AS expected,
  expected_c / 100.0 AS line_total, {LINE_FLAG} AS flag FROM stated""")


def stated_invoices(spark, sf):
    """Invoices whose stated total is off by nothing, one cent, two cents, or a tenth."""
    sums = verify.line_sums(stated_lines(spark, sf)).select("invoice_id", F.col("line_sum").alias("_sum"))
    key = F.col("invoice_id")
    off = F.when(key % 7 == 0, money(F.lit("0.01"))).when(key % 7 == 1, money(F.lit("-0.02"))).when(
        key % 7 == 2, from_cents(F.floor(F.col("_sum") * 10).cast("bigint"))).otherwise(money(F.lit(0)))
    return invoices(spark, sf).join(sums, "invoice_id", "left").withColumn(
        "total", money(F.coalesce(F.col("_sum") + off, "total"))).drop("_sum")


STATED_INVOICES = """sums AS (SELECT invoice_id, sum(stated_c) AS sum_c, count(*) AS n FROM stated GROUP BY 1),
claims AS (SELECT inv.*, sums.sum_c, sums.n,
  coalesce(sum_c + CASE invoice_id % 7 WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN sum_c // 10 ELSE 0 END, total_c) AS claim_c
  FROM inv LEFT JOIN sums USING (invoice_id))"""


def total_check(spark, sf):
    checked = verify.check_totals(stated_invoices(spark, sf), stated_lines(spark, sf))
    return plain(checked, "invoice_id", "stated_total", "line_sum", "total", "flag")


total_sql = with_sql(INVOICES, STATED_LINES, STATED_INVOICES, f"""
SELECT invoice_id, claim_c / 100.0 AS stated_total, sum_c / 100.0 AS line_sum,
  CASE WHEN abs(claim_c - sum_c) > 1 THEN sum_c ELSE claim_c END / 100.0 AS total,
  CASE WHEN abs(claim_c - sum_c) > 1 THEN 'TOTAL_MISMATCH [HIGH SEVERITY]: stated ' || {money_text('claim_c')}
    || ', sum of line items = ' || {money_text('sum_c')} || ' (delta ' || {money_text('abs(claim_c - sum_c)')}
    || '). This is the payment amount — REVIEW REQUIRED. Using sum-of-lines value.' END AS flag
FROM claims""")


def tax_invoices(spark, sf):
    """All invoices, stating net, tax rate, tax and total, each wrong or missing for some keys."""
    key = F.col("invoice_id")
    sums = verify.line_sums(stated_lines(spark, sf)).select("invoice_id", "line_sum")
    sums = invoices(spark, sf).select("invoice_id", "total").join(sums, "invoice_id", "left").select(
        "invoice_id", F.coalesce("line_sum", "total").alias("net"))
    rate = F.when(key % 3 == 0, 5).otherwise(18)
    tax = F.floor((F.col("net") * 100 * rate + 50) / 100).cast("bigint")
    c = lambda col: money(col.cast("decimal(20,2)") / 100)
    return sums.select(
        "invoice_id",
        money(F.col("net") + F.when(key % 5 == 0, money(F.lit(1))).otherwise(money(F.lit(0)))).alias("subtotal"),
        F.when(key % 11 != 0, rate.cast("decimal(5,2)")).alias("tax_rate"),
        F.when(key % 13 != 0, c(tax + F.when(key % 7 == 0, 200).otherwise(0))).alias("tax_amount"),
        money(F.col("net") + c(tax) + F.when(key % 4 == 0, money(F.lit(9))).otherwise(money(F.lit(0)))).alias("total"))


TAX_INVOICES = """net AS (SELECT invoice_id, sum_c, coalesce(sum_c, total_c) AS net_c FROM inv
  LEFT JOIN (SELECT invoice_id, sum(stated_c) AS sum_c FROM stated GROUP BY 1) USING (invoice_id)),
tax AS (SELECT *, CASE WHEN invoice_id % 3 = 0 THEN 5 ELSE 18 END AS r, (net_c * CASE WHEN invoice_id % 3 = 0 THEN 5 ELSE 18 END + 50) // 100 AS own_c FROM net),
said AS (SELECT invoice_id, sum_c, net_c + CASE WHEN invoice_id % 5 = 0 THEN 100 ELSE 0 END AS sub_c, CASE WHEN invoice_id % 11 <> 0 THEN r END AS rate,
  CASE WHEN invoice_id % 13 <> 0 THEN own_c + CASE WHEN invoice_id % 7 = 0 THEN 200 ELSE 0 END END AS tax_c,
  net_c + own_c + CASE WHEN invoice_id % 4 = 0 THEN 900 ELSE 0 END AS total_c FROM tax),
-- The lines decide the net amount; an invoice without any keeps what it states, and its tax follows from that.
netted AS (SELECT *, coalesce(sum_c, sub_c) AS good_sub_c, (coalesce(sum_c, sub_c) * rate + 50) // 100 AS right_c FROM said),
judged AS (SELECT *,
  CASE WHEN rate IS NULL THEN tax_c WHEN tax_c IS NULL OR abs(tax_c - right_c) > 1 THEN right_c ELSE tax_c END AS good_c FROM netted)"""


def _code(flag: str):
    return F.regexp_extract(flag, "^[A-Z_]+", 0)


def subtotal_check(spark, sf):
    checked = verify.check_tax_totals(tax_invoices(spark, sf), stated_lines(spark, sf))
    return plain(checked.withColumn("code", F.coalesce(_code("subtotal_flag"), F.lit(""))), "invoice_id", "subtotal", "code")


subtotal_sql = with_sql(INVOICES, STATED_LINES, TAX_INVOICES, """
SELECT invoice_id, good_sub_c / 100.0 AS subtotal, CASE WHEN sub_c <> sum_c THEN 'SUBTOTAL_MISMATCH' ELSE '' END AS code FROM judged""")


def tax_check(spark, sf):
    checked = verify.check_tax_totals(tax_invoices(spark, sf), stated_lines(spark, sf))
    return plain(
        checked.withColumns({"tax_code": F.coalesce(_code("tax_flag"), F.lit("")),
                             "total_code": F.coalesce(_code("total_flag"), F.lit(""))}),
        "invoice_id", "tax_amount", "total", "tax_code", "total_code")


tax_sql = with_sql(INVOICES, STATED_LINES, TAX_INVOICES, """
SELECT invoice_id, good_c / 100.0 AS tax_amount,
  CASE WHEN abs(good_sub_c + coalesce(good_c, 0) - total_c) > 1 THEN good_sub_c + coalesce(good_c, 0) ELSE total_c END / 100.0 AS total,
  CASE WHEN rate IS NULL AND tax_c IS NULL THEN '' WHEN rate IS NULL THEN 'TAX_RATE_MISSING'
       WHEN tax_c IS NULL THEN 'TAX_AMOUNT_MISSING' WHEN abs(tax_c - right_c) > 1 THEN 'TAX_MISMATCH' ELSE '' END AS tax_code,
  CASE WHEN abs(good_sub_c + coalesce(good_c, 0) - total_c) > 1 THEN 'TOTAL_MISMATCH' ELSE '' END AS total_code
FROM judged""")


def review_recheck(spark, sf):
    return plain(verify.recheck(stated_invoices(spark, sf), stated_lines(spark, sf)), "invoice_id", "line_sum", "bad_lines", "total_ok")


recheck_sql = with_sql(INVOICES, STATED_LINES, STATED_INVOICES, """
SELECT invoice_id, coalesce(c.sum_c, 0) / 100.0 AS line_sum, coalesce(b.bad, 0) AS bad_lines,
  coalesce(c.sum_c, 0) = claim_c AS total_ok
FROM claims c LEFT JOIN (SELECT invoice_id, count(*) FILTER (abs(stated_c - expected_c) > 1) AS bad FROM stated GROUP BY 1) b
  USING (invoice_id)""")

QUERIES = {
    "line_math_check": (line_math_check, line_math_sql),
    "total_check": (total_check, total_sql),
    "subtotal_check": (subtotal_check, subtotal_sql),
    "tax_check": (tax_check, tax_sql),
    "review_recheck": (review_recheck, recheck_sql),
}
