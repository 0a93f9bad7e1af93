"""Dashboard reports and list filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from knigovod.operators import filters, journal as jn, reports
from knigovod.plans.bindings import (
    AS_OF, INVOICES, LINES, SESSION_ITEMS, as_of, invoices, lines, session_items, table, templates)
from knigovod.plans.registered import plain, with_sql
from knigovod.plans.registered.journals import JOURNAL, entries


def kpis(spark, sf):
    return plain(reports.kpis(invoices(spark, sf)))


kpis_sql = with_sql(INVOICES, """
SELECT count(*) AS total_invoices, count(*) FILTER (status = 'Pending') AS pending,
  count(*) FILTER (status = 'Exported') AS exported, sum(total_c) / 100.0 AS total_value FROM inv""")


def status_counts(spark, sf):
    return reports.status_counts(invoices(spark, sf))


status_sql = with_sql(INVOICES, """
SELECT s.status, CASE s.status WHEN 'All' THEN (SELECT count(*) FROM inv) ELSE coalesce(c.n, 0) END AS n
FROM (SELECT unnest(['All', 'Pending', 'Processing', 'Approved', 'Exported', 'Rejected']) AS status) s
LEFT JOIN (SELECT status, count(*) AS n FROM inv GROUP BY 1) c ON c.status = s.status""")


def top_vendors(spark, sf):
    return reports.top_vendors(invoices(spark, sf))


_UNITS = "CAST(floor((sum(total_c) + 50) / 100.0) AS BIGINT)"
top_sql = with_sql(INVOICES, f"""
SELECT vendor, {_UNITS} AS value FROM inv WHERE status <> 'Rejected' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")


def currency_split(spark, sf):
    return reports.spend_by_currency(invoices(spark, sf))


currency_sql = with_sql(INVOICES, f"""
SELECT coalesce(currency, 'MKD') AS currency, {_UNITS} AS value FROM inv WHERE status <> 'Rejected' GROUP BY 1""")


def monthly_trend(spark, sf):
    return reports.monthly_trend(invoices(spark, sf))


monthly_sql = with_sql(INVOICES, f"""
SELECT strftime(invoice_date, '%Y-%m') AS month, {_UNITS} AS value FROM inv
WHERE status <> 'Rejected' AND invoice_date IS NOT NULL GROUP BY 1 ORDER BY 1""")


def net_vat_split(spark, sf):
    # Lines of even parts state no rate.
    gross = lines(spark, sf).withColumn("vat_rate", F.when(F.col("line_key.l_partkey") % 2 == 1, F.col("vat_rate")))
    split = reports.net_vat_split(invoices(spark, sf), gross)
    return split.select(F.round("net", 2).alias("net"), F.round("vat", 2).alias("vat"))


net_vat_sql = with_sql(INVOICES, LINES, """parts AS (SELECT total_c, invoice_id, NULL AS net_c, 18 AS rate FROM inv WHERE status <> 'Rejected' AND invoice_id NOT IN (SELECT invoice_id FROM lines)
  UNION ALL SELECT NULL, invoice_id, net_c, CASE WHEN l_partkey % 2 = 1 THEN rate ELSE 18 END FROM lines JOIN inv USING (invoice_id) WHERE status <> 'Rejected'),
rates AS (SELECT rate, sum(coalesce(net_c, total_c)) / 100.0 AS gross FROM parts GROUP BY 1)""", """
SELECT round(sum(gross / (1 + rate / 100.0)), 2) AS net, round(sum(gross - gross / (1 + rate / 100.0)), 2) AS vat FROM rates""")


def vendor_count(spark, sf):
    return reports.vendor_count(invoices(spark, sf))


vendors_sql = with_sql(INVOICES, "SELECT count(DISTINCT vendor) AS vendors FROM inv WHERE status <> 'Rejected'")


def journal_health(spark, sf):
    return reports.journal_health(jn.journal_totals(entries(spark, sf)))


health_sql = with_sql(JOURNAL, "t AS (SELECT invoice_id, sum(debit_c) = sum(credit_c) AS balanced FROM journal GROUP BY 1)", """
SELECT CAST(floor(100 * count(*) FILTER (balanced) / count(*) + 0.5) AS BIGINT) AS health FROM t""")


def volume_14d(spark, sf):
    return reports.daily_volume(invoices(spark, sf), as_of())


volume_sql = with_sql(INVOICES, f"""
SELECT CAST(d AS DATE) AS day, (SELECT count(*) FROM inv WHERE received = CAST(d AS DATE)) AS n
FROM generate_series(DATE '{AS_OF}' - 13, DATE '{AS_OF}', INTERVAL 1 DAY) AS t(d)""")


def payment_run(spark, sf):
    return plain(reports.payment_totals(invoices(spark, sf), as_of()).withColumn("currency", F.coalesce("currency", F.lit("all"))))


payment_sql = with_sql(INVOICES, f"""
SELECT coalesce(c, 'all') AS currency, sum(total_c) / 100.0 AS amount, count(*) AS n
FROM (SELECT coalesce(currency, 'MKD') AS c, total_c FROM inv WHERE status IN ('Approved', 'Exported')
  AND due_date <= DATE '{AS_OF}' + CAST((12 - isodow(DATE '{AS_OF}')) % 7 AS INTEGER))
GROUP BY ROLLUP (c)""")


def flagged(spark, sf):
    i = invoices(spark, sf)
    return i.withColumn("flags", F.when(F.col("blocked"), F.array(F.lit("TOTAL_MISMATCH [HIGH SEVERITY]: x")))
                        .when(F.col("invoice_id") % 9 == 0, F.array(F.lit("DATE_SUSPECT: y")))
                        .otherwise(F.array().cast("array<string>")))


def attention_list(spark, sf):
    return reports.needs_attention(flagged(spark, sf), 5).select("invoice_id", "received")


attention_sql = with_sql(INVOICES, """
SELECT invoice_id, received FROM inv WHERE blocked OR invoice_id % 9 = 0 ORDER BY received DESC, invoice_id DESC LIMIT 5""")


def recent_invoices(spark, sf):
    return reports.newest(invoices(spark, sf)).select("invoice_id", "received")


recent_sql = with_sql(INVOICES, "SELECT invoice_id, received FROM inv ORDER BY received DESC, invoice_id DESC LIMIT 6")


def batch_progress(spark, sf):
    return reports.batch_progress(session_items(spark, sf))


progress_sql = with_sql(SESSION_ITEMS, """
SELECT session_id, count(*) FILTER (status = 'analyzing') AS analyzing, count(*) FILTER (status = 'done') AS done,
  count(*) FILTER (status = 'error') AS failed, count(*) AS total, count(*) FILTER (status IN ('done', 'error')) AS processed,
  bool_and(status IN ('done', 'error')) AS all_done FROM items GROUP BY 1""")


def pattern_counts(spark, sf):
    return reports.pattern_counts(templates(spark, sf))


patterns_sql = """SELECT 't' || c_custkey AS id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_patterns
FROM customer"""


def learned_counts(spark, sf):
    return reports.health(templates(spark, sf), table(spark, sf, "embeddings"))


learned_sql = """SELECT 'templates' AS what, count(*) AS n FROM customer
UNION ALL SELECT 'corrections', count(*) FROM embeddings"""


def invoice_filter(spark, sf):
    return filters.by_status(invoices(spark, sf), "Pending").select("invoice_id", "status")


filter_sql = with_sql(INVOICES, "SELECT invoice_id, status FROM inv WHERE status = 'Pending'")


def invoice_search(spark, sf):
    return filters.by_text(invoices(spark, sf), " CUSTOMER#00000012 ").select("invoice_id", "vendor", "number").unionByName(
        filters.by_text(invoices(spark, sf), "inv-77").select("invoice_id", "vendor", "number"))


search_sql = with_sql(INVOICES, """
SELECT invoice_id, vendor, number FROM inv WHERE contains(lower(vendor), 'customer#00000012') OR contains(lower(number), 'customer#00000012')
UNION ALL SELECT invoice_id, vendor, number FROM inv WHERE contains(lower(vendor), 'inv-77') OR contains(lower(number), 'inv-77')""")


def date_presets(spark, sf):
    i, day = invoices(spark, sf), as_of()
    parts = [("week", filters.last_week(i, day)), ("month", filters.this_month(i, day)), ("overdue", filters.overdue(i, day))]
    chosen = [df.select(F.lit(name).alias("preset"), "invoice_id") for name, df in parts]
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2])


presets_sql = with_sql(INVOICES, f"""
SELECT 'week' AS preset, invoice_id FROM inv WHERE invoice_date >= DATE '{AS_OF}' - 7
UNION ALL SELECT 'month', invoice_id FROM inv WHERE strftime(invoice_date, '%Y-%m') = '{AS_OF[:7]}'
UNION ALL SELECT 'overdue', invoice_id FROM inv WHERE due_date < DATE '{AS_OF}' AND status <> 'Exported'""")


def session_filter(spark, sf):
    return filters.by_session(invoices(spark, sf), session_items(spark, sf), "1997-03").select("invoice_id", "status")


session_filter_sql = with_sql(INVOICES, SESSION_ITEMS, """
SELECT invoice_id, status FROM inv WHERE invoice_id IN (SELECT invoice_id FROM items WHERE session_id = '1997-03')""")


def export_selection(spark, sf):
    chosen = session_items(spark, sf).filter("status = 'done'")
    return filters.export_selection(invoices(spark, sf), chosen).select("invoice_id", "invoice_date")


selection_sql = with_sql(INVOICES, SESSION_ITEMS, """
SELECT invoice_id, invoice_date FROM inv WHERE status IN ('Approved', 'Exported')
  AND invoice_id IN (SELECT invoice_id FROM items WHERE items.status = 'done')""")


def export_marks(spark, sf):
    chosen = session_items(spark, sf).filter("status = 'done'")
    return filters.mark_exported(invoices(spark, sf), chosen).select("invoice_id", "status")


marks_sql = with_sql(INVOICES, SESSION_ITEMS, """
SELECT inv.invoice_id, CASE WHEN inv.status = 'Approved' AND items.status = 'done' THEN 'Exported' ELSE inv.status END AS status
FROM inv JOIN items USING (invoice_id)""")


def session_counts(spark, sf):
    return reports.session_counts(session_items(spark, sf), invoices(spark, sf))


session_counts_sql = with_sql(INVOICES, SESSION_ITEMS, """
SELECT session_id, count(*) FILTER (inv.status IN ('Approved', 'Exported')) AS posted, count(*) AS total
FROM items JOIN inv USING (invoice_id) GROUP BY 1""")

QUERIES = {
    "kpis": (kpis, kpis_sql),
    "status_counts": (status_counts, status_sql),
    "top_vendors": (top_vendors, top_sql),
    "currency_split": (currency_split, currency_sql),
    "monthly_trend": (monthly_trend, monthly_sql),
    "net_vat_split": (net_vat_split, net_vat_sql),
    "vendor_count": (vendor_count, vendors_sql),
    "journal_health": (journal_health, health_sql),
    "volume_14d": (volume_14d, volume_sql),
    "payment_run": (payment_run, payment_sql),
    "attention_list": (attention_list, attention_sql),
    "recent_invoices": (recent_invoices, recent_sql),
    "batch_progress": (batch_progress, progress_sql),
    "pattern_counts": (pattern_counts, patterns_sql),
    "learned_counts": (learned_counts, learned_sql),
    "invoice_filter": (invoice_filter, filter_sql),
    "invoice_search": (invoice_search, search_sql),
    "date_presets": (date_presets, presets_sql),
    "session_filter": (session_filter, session_filter_sql),
    "export_selection": (export_selection, selection_sql),
    "export_marks": (export_marks, marks_sql),
    "session_counts": (session_counts, session_counts_sql),
}
