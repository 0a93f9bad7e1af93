"""Filters of the invoice list. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knigovod.operators.reports import POSTED


def by_status(invoices: DataFrame, status: str = "All") -> DataFrame:
    return invoices if status == "All" else invoices.filter(F.col("status") == status)


def by_text(invoices: DataFrame, query: str) -> DataFrame:
    """Vendor or number holds the query, whatever the letter case."""
    q = query.strip().lower()
    if not q:
        return invoices
    return invoices.filter(F.lower("vendor").contains(q) | F.lower("number").contains(q))


def last_week(invoices: DataFrame, as_of: Column) -> DataFrame:
    return invoices.filter(F.col("invoice_date") >= F.date_sub(as_of, 7))


def this_month(invoices: DataFrame, as_of: Column) -> DataFrame:
    first = F.trunc(as_of, "MM")
    return invoices.filter((F.col("invoice_date") >= first) & (F.col("invoice_date") <= F.last_day(as_of)))


def overdue(invoices: DataFrame, as_of: Column) -> DataFrame:
    return invoices.filter((F.col("due_date") < as_of) & (F.col("status") != "Exported"))


def by_session(invoices: DataFrame, session_items: DataFrame, session_id) -> DataFrame:
    chosen = session_items.filter(F.col("session_id") == session_id).select("invoice_id")
    return invoices.join(chosen, "invoice_id", "left_semi")


def export_selection(invoices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Posted invoices among the chosen ids, in export order."""
    return (
        invoices.filter(F.col("status").isin(*POSTED)).join(chosen.select("invoice_id"), "invoice_id", "left_semi")
        .orderBy(F.col("invoice_date").asc_nulls_first(), "invoice_id")
    )


def mark_exported(invoices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Invoices after an export: the chosen posted ones are Exported."""
    ids = chosen.select("invoice_id").distinct().withColumn("_chosen", F.lit(True))
    return (
        invoices.join(ids, "invoice_id", "left")
        .withColumn("status", F.when(F.col("_chosen") & F.col("status").isin(*POSTED), "Exported")
                    .otherwise(F.col("status")))
        .drop("_chosen")
    )
