"""Dashboard figures. Every report is one aggregation with map-side combining, or a bounded top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knigovod.functions.amounts import money
from knigovod.functions.dates import month_bucket, next_friday

POSTED = ("Approved", "Exported")
STATUSES = ("Pending", "Processing", "Approved", "Exported", "Rejected")


def not_rejected(invoices: DataFrame) -> DataFrame:
    return invoices.filter(F.col("status") != "Rejected")


def value() -> Column:
    return F.coalesce("total", F.lit(0).cast("decimal(18,2)"))


def rounded_sum() -> Column:
    return F.floor(F.sum(value()) + F.lit(0.5).cast("decimal(2,1)")).cast("bigint")


def kpis(invoices: DataFrame) -> DataFrame:
    return invoices.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("status") == "Pending").alias("pending"),
        F.count_if(F.col("status") == "Exported").alias("exported"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_value"))


def status_counts(invoices: DataFrame) -> DataFrame:
    """Count per status and over all, statuses without invoices included."""
    # rollup() counts each row once per grouping set, but combines before the shuffle.
    counted = invoices.filter(F.col("status").isNotNull()).rollup("status").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select(F.coalesce("status", F.lit("All")).alias("status"), "n")
    listed = invoices.sparkSession.createDataFrame([(s,) for s in ("All", *STATUSES)], "status string")
    return listed.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def top_vendors(invoices: DataFrame, n: int = 6) -> DataFrame:
    return (
        not_rejected(invoices).groupBy("vendor").agg(rounded_sum().alias("value"))
        .orderBy(F.desc("value"), "vendor").limit(n)
    )


def spend_by_currency(invoices: DataFrame) -> DataFrame:
    return not_rejected(invoices).groupBy(F.coalesce("currency", F.lit("MKD")).alias("currency")).agg(
        rounded_sum().alias("value"))


def monthly_trend(invoices: DataFrame) -> DataFrame:
    return (
        not_rejected(invoices).filter(F.col("invoice_date").isNotNull())
        .groupBy(month_bucket(F.col("invoice_date")).alias("month")).agg(rounded_sum().alias("value"))
        .orderBy("month")
    )


def net_vat_split(invoices: DataFrame, lines: DataFrame, default_rate: int = 18) -> DataFrame:
    """Net and tax of all spending: lines hold gross amounts, invoices without lines their total.

    Lines are summed per rate first; only the few sums per rate are divided."""
    relevant = not_rejected(invoices).select("invoice_id", "total")
    counted = lines.groupBy("invoice_id", F.coalesce("vat_rate", F.lit(default_rate)).alias("rate")).agg(
        F.sum("line_total").alias("gross"))
    joined = relevant.join(counted, "invoice_id", "left")
    per_rate = joined.groupBy(F.coalesce("rate", F.lit(default_rate)).alias("rate")).agg(
        F.sum(F.coalesce("gross", "total", F.lit(0))).alias("gross"))
    net = F.col("gross").cast("double") / (1 + F.col("rate").cast("double") / 100)
    return per_rate.agg(F.sum(net).alias("net"), F.sum(F.col("gross").cast("double") - net).alias("vat"))


def vendor_count(invoices: DataFrame) -> DataFrame:
    return not_rejected(invoices).agg(F.count_distinct("vendor").alias("vendors"))


def journal_health(totals: DataFrame) -> DataFrame:
    """Share of balanced invoices in percent, 100 when there are none."""
    share = F.floor(F.lit(100) * F.count_if("balanced") / F.count(F.lit(1)) + 0.5)
    return totals.agg(F.when(F.count(F.lit(1)) == 0, 100).otherwise(share).cast("bigint").alias("health"))


def daily_volume(invoices: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Invoices per day over the last days, days without any included."""
    spark = invoices.sparkSession
    day = F.coalesce("received", "invoice_date")
    counted = (
        invoices.select(day.alias("day")).filter(F.col("day").between(F.date_sub(as_of, days - 1), as_of))
        .groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    )
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.date_sub(as_of, days - 1), as_of)).alias("day"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def payment_run(invoices: DataFrame, as_of: Column) -> DataFrame:
    """Posted invoices due by the coming Friday."""
    return invoices.filter(F.col("status").isin(*POSTED) & (F.col("due_date") <= next_friday(as_of)))


def payment_totals(invoices: DataFrame, as_of: Column) -> DataFrame:
    """Sum and count of the payment run per currency and over all (currency null)."""
    return (
        payment_run(invoices, as_of)
        .withColumn("currency", F.coalesce("currency", F.lit("MKD")))
        .rollup("currency").agg(money(F.sum(value())).alias("amount"), F.count(F.lit(1)).alias("n"))
    )


def needs_attention(invoices: DataFrame, n: int | None = None) -> DataFrame:
    flagged = invoices.filter(F.size("flags") > 0)
    return flagged if n is None else newest(flagged, n)


def newest(invoices: DataFrame, n: int = 6) -> DataFrame:
    return invoices.orderBy(F.desc("received"), F.desc("invoice_id")).limit(n)


def batch_progress(items: DataFrame) -> DataFrame:
    """Progress of upload sessions: items hold session_id and status."""
    status = F.col("status")
    return (
        items.groupBy("session_id").agg(
            F.count_if(status == "analyzing").alias("analyzing"), F.count_if(status == "done").alias("done"),
            F.count_if(status == "error").alias("failed"), F.count(F.lit(1)).alias("total"))
        .withColumn("processed", F.col("done") + F.col("failed"))
        .withColumn("all_done", F.col("processed") == F.col("total"))
    )


def pattern_counts(templates: DataFrame) -> DataFrame:
    """Patterns that each template holds."""
    n = F.size(F.map_filter("patterns", lambda _, v: v.isNotNull()))
    return templates.select("id", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint").alias("n_patterns"))


def health(templates: DataFrame, corrections: DataFrame) -> DataFrame:
    """Size of what the engine has learned."""
    return templates.agg(F.count(F.lit(1)).alias("n")).select(F.lit("templates").alias("what"), "n").unionByName(
        corrections.agg(F.count(F.lit(1)).alias("n")).select(F.lit("corrections").alias("what"), "n"))


def session_counts(session_items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Posted invoices of each session."""
    return (
        session_items.select("session_id", "invoice_id").join(invoices.select("invoice_id", "status"), "invoice_id", "left")
        .groupBy("session_id").agg(
            F.count_if(F.col("status").isin(*POSTED)).alias("posted"), F.count(F.lit(1)).alias("total"))
    )
