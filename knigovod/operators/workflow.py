"""Review workflow: approvals, rejections, exports, and upload sessions.

The state an invoice ends in depends only on the places of its last rejection, approval and export,
which are plain maxima. So no event list is collected or walked: an invoice with a third of all events
costs one combined row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knigovod.operators.reports import POSTED

ACTIONS = ("approve", "reject", "export")


def action_marks(events: DataFrame) -> DataFrame:
    """Last place, and number, of each action per invoice. events: invoice_id, action, seq."""

    def last(action: str) -> Column:
        return F.max(F.when(F.col("action") == action, F.col("seq")))

    return events.groupBy("invoice_id").agg(
        *[last(a).alias(f"last_{a}") for a in ACTIONS],
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS])


def final_status(status: Column, blocked: Column, approve: Column, reject: Column, export: Column) -> Column:
    """Status after all actions.

    approve works unless high-severity warnings block it (posted invoices may be approved again);
    reject always works; export works on posted invoices only."""
    posted = status.isin(*POSTED)
    approved = ~blocked & approve.isNotNull() & (reject.isNull() | (approve > reject))
    # An invoice posted from the start also accepts approvals while blocked, until it is rejected.
    still_posted = reject.isNull() & posted
    exported_last = export.isNotNull() & (approve.isNull() | (export > approve))
    return (
        F.when(approved, F.when(exported_last, "Exported").otherwise("Approved"))
        .when(still_posted & exported_last, "Exported")
        .when(still_posted & approve.isNotNull(), "Approved")
        .when(reject.isNotNull(), "Rejected")
        .otherwise(status)
    )


def fold_status(invoices: DataFrame, events: DataFrame) -> DataFrame:
    """Invoices in the state their actions leave them in. invoices: invoice_id, status, blocked."""
    marks = action_marks(events)
    return invoices.join(marks, "invoice_id", "left").withColumn("status", final_status(
        F.col("status"), F.coalesce("blocked", F.lit(False)), F.col("last_approve"), F.col("last_reject"),
        F.col("last_export")))


def approve_gate(invoices: DataFrame) -> DataFrame:
    """Outcome of approving every invoice now."""
    refused = F.coalesce("blocked", F.lit(False)) & ~F.col("status").isin(*POSTED)
    return invoices.withColumn("approval", F.when(refused, "blocked").otherwise("Approved"))


def sessions(uploads: DataFrame, gap_seconds: int) -> DataFrame:
    """Upload sessions of each user: uploads closer than the gap belong together.

    Two uploads within one gap-long time slot are always in the same session, so uploads are first
    combined per (user, slot). What is left per user is bounded by the length of the calendar, not by
    the number of uploads; only that goes through the window."""
    second = F.unix_micros("received_ts")
    gap = gap_seconds * 1_000_000
    slots = (
        uploads.groupBy("user_id", F.floor(second / F.lit(gap)).alias("slot"))
        .agg(F.min("received_ts").alias("first_ts"), F.max("received_ts").alias("last_ts"),
             F.count(F.lit(1)).alias("n"))
    )
    by_time = Window.partitionBy("user_id").orderBy("slot")
    before = F.lag("last_ts").over(by_time)
    opens = before.isNull() | (F.unix_micros("first_ts") - F.unix_micros(before) > gap)
    number = F.sum(F.col("opens").cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    return (
        slots.withColumn("opens", opens).withColumn("session_no", number)
        .groupBy("user_id", "session_no")
        .agg(F.min("first_ts").alias("started"), F.max("last_ts").alias("ended"), F.sum("n").alias("n"))
    )
