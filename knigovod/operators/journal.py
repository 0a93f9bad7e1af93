"""Double-entry journals and the rows of the ledger import.

One partial-combined aggregate per invoice finds the rounding sum, the lines that absorb rounding or
tax, and the payable amount. The lines then need a single join with that summary. Nothing collects or
sorts the lines of an invoice, so an invoice of any size stays spread over the tasks; the join's line
side is the one adaptive execution may split when an invoice is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knigovod.fixed_values import LEDGER_COLUMNS, PAYABLE_KONTO, PAYABLE_TEXT, ROUNDING_KEYWORDS
from knigovod.functions.amounts import money, round_cents, round_units
from knigovod.functions.dates import booking_date, dot_date, last_of_month
from knigovod.functions.text import any_keyword

ABSORB_FROM = "0.50"


def is_rounding(description: Column) -> Column:
    return any_keyword(F.lower(F.coalesce(description, F.lit(""))), ROUNDING_KEYWORDS)


def gross_amount(net: Column, vat_rate: Column) -> Column:
    return F.when(vat_rate > 0, round_cents(net * (vat_rate + 100) / 100)).otherwise(round_cents(net))


def signed_units(amount: Column) -> Column:
    """Whole units posted for an amount: debits positive, credits negative."""
    return F.when(amount >= 0, round_units(amount)).otherwise(-round_units(-amount))


def _largest(amount: Column, condition: Column) -> Column:
    # Smallest of (-amount, line_key): the largest amount, the first line among equals.
    return F.min(F.when(condition, F.struct((-amount).alias("minus"), F.col("line_key").alias("line_key"))))


def journal(invoices: DataFrame, lines: DataFrame, konto: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Journal rows (invoice_id, line_key, konto, opis, debit, credit) of invoices.

    invoices: invoice_id, vendor, total, tax_amount, konto_suggestion
    lines:    invoice_id, line_key (any orderable type, unique per invoice), description, line_total,
              vat_rate
    konto:    account for the column `konto_text` (description and vendor), or what adds the column `konto` to such rows

    The payable row has a null line_key and sorts last.
    """
    gross = F.col("gross")
    priced = lines.select(
        "invoice_id", "line_key", "description",
        is_rounding(F.col("description")).alias("rounding"),
        round_cents(F.col("line_total")).alias("net"),
        F.coalesce("vat_rate", F.lit(0)).alias("vat_rate"),
    ).withColumn("gross", gross_amount(F.col("net"), F.col("vat_rate")))

    regular = ~F.col("rounding")
    summary = priced.groupBy("invoice_id").agg(
        money(F.sum(F.when(F.col("rounding"), F.col("net")))).alias("rounding_sum"),
        F.sum(F.when(regular, signed_units(gross))).alias("posted"),
        _largest(gross, regular & (F.col("vat_rate") > 0)).alias("taxable"),
        _largest(gross, regular).alias("largest"),
    )

    rounding = F.coalesce("rounding_sum", F.lit(0).cast("decimal(18,2)"))
    tax = round_cents(F.col("tax_amount"))
    # What the chosen line absorbs: rounding goes to the main taxable line; where no line is taxed,
    # the tax of the invoice goes to the largest line.
    absorbs = F.when(
        F.col("taxable").isNotNull(),
        F.when(F.abs(rounding) >= F.lit(ABSORB_FROM).cast("decimal(18,2)"),
               F.struct(F.col("taxable.line_key").alias("line_key"), (-F.col("taxable.minus")).alias("gross"),
                        rounding.alias("extra")))
    ).when(
        F.col("largest").isNotNull() & (tax > 0),
        F.struct(F.col("largest.line_key").alias("line_key"), (-F.col("largest.minus")).alias("gross"),
                 tax.alias("extra")))
    headers = (
        invoices.select("invoice_id", "vendor", "total", "tax_amount", "konto_suggestion")
        .join(summary, "invoice_id", "left")
        .withColumn("total", round_cents(F.col("total")))
        .withColumn("absorbs", absorbs)
        .withColumn("has_lines", F.col("rounding_sum").isNotNull() | F.col("largest").isNotNull())
        .withColumn("posted", F.coalesce("posted", F.lit(0)) + F.coalesce(
            signed_units(round_cents(F.col("absorbs.gross") + F.col("absorbs.extra")))
            - signed_units(F.col("absorbs.gross")), F.lit(0)))
        .withColumn("vendor", F.coalesce("vendor", F.lit("")))
    )

    # Two more rows per invoice join the same way as its lines: the payable, and for invoices without
    # any line the total itself as the expense. So the summary is needed once.
    no_key = F.lit(None).cast(lines.schema["line_key"].dataType).alias("line_key")
    none = lambda c: F.lit(None).cast(c)
    extra = invoices.select(
        "invoice_id", no_key, none("string").alias("description"), none("decimal(18,2)").alias("gross"),
        F.explode(F.array(F.lit("payable"), F.lit("whole"))).alias("kind"))
    rows = (
        priced.filter(regular).select("invoice_id", "line_key", "description", "gross", F.lit("line").alias("kind"))
        .unionByName(extra).join(headers, "invoice_id")
    )
    is_line, is_payable = F.col("kind") == "line", F.col("kind") == "payable"
    chosen = F.coalesce(F.col("line_key") == F.col("absorbs.line_key"), F.lit(False))
    # The total counts in whole units on both sides where it stands for the lines.
    whole_total = money(round_units(F.col("total")))
    payable = F.when(~F.col("has_lines"), whole_total).when(F.col("posted") != 0, money(F.col("posted"))).otherwise(F.col("total"))
    amount = (
        F.when(is_line, F.when(chosen, round_cents(gross + F.col("absorbs.extra"))).otherwise(gross))
        .when(is_payable, -payable).otherwise(F.col("total"))
    )
    opis = (
        F.when(is_payable, F.lit(PAYABLE_TEXT))
        .when(is_line, F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.col("vendor")))
        .otherwise(F.when(F.col("vendor") == "", "Expense").otherwise(F.col("vendor")))
    )
    posted = (
        rows.filter((F.col("kind") != "whole") | ~F.col("has_lines"))
        .select("invoice_id", "line_key", "kind", "vendor", "konto_suggestion", amount.alias("amount"), opis.alias("opis"))
        .filter((F.col("kind") != "line") | (F.abs("amount") >= F.lit("0.01").cast("decimal(18,2)")))
        .withColumn("konto_text", F.when(F.col("kind") == "line", F.concat_ws(" ", "opis", "vendor")).otherwise(F.col("vendor")))
    )
    if callable(konto):
        posted = konto(posted)
        konto = F.col("konto")
    zero = money(F.lit(0))
    units = lambda a: F.when(F.col("kind") == "payable", a).otherwise(money(round_units(a)))
    is_credit = (F.col("kind") == "payable") | (F.col("amount") < 0)
    return posted.select(
        "invoice_id", "line_key",
        F.when(F.col("kind") == "payable", PAYABLE_KONTO).otherwise(F.coalesce(F.nullif(F.trim("konto_suggestion"), F.lit("")), konto)).alias("konto"), "opis",
        F.when(is_credit, zero).otherwise(units(F.col("amount"))).alias("debit"),
        F.when(is_credit, units(-F.col("amount"))).otherwise(zero).alias("credit"))


def completed(entries: DataFrame, invoices: DataFrame, lines: DataFrame, konto: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Given journal rows, and generated ones for the invoices that have none. `lines` may hold those of all invoices: the
    journal joins them with the invoices that are left."""
    missing = invoices.join(entries.select("invoice_id").distinct(), "invoice_id", "left_anti")
    return entries.unionByName(journal(missing, lines, konto))


def journal_totals(entries: DataFrame) -> DataFrame:
    """Sums per invoice and whether they balance to the cent."""
    return (
        entries.groupBy("invoice_id")
        .agg(money(F.sum("debit")).alias("debit"), money(F.sum("credit")).alias("credit"))
        .withColumn("balanced", F.abs(F.col("debit") - F.col("credit")) < F.lit("0.01").cast("decimal(18,2)"))
    )


def group_by_konto(entries: DataFrame) -> DataFrame:
    """Journal of each invoice, one row per account."""
    konto = F.coalesce(F.nullif("konto", F.lit("")), F.lit("—"))
    return (
        entries.groupBy("invoice_id", konto.alias("konto"))
        .agg(money(F.sum("debit")).alias("debit"), money(F.sum("credit")).alias("credit"),
             F.count(F.lit(1)).alias("n"), F.min("opis").alias("only"), F.min("line_key").alias("line_key"))
        .withColumn("opis", F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" entries")))
                    .otherwise(F.col("only")))
        .drop("only")
    )


def ledger_rows(entries: DataFrame, invoices: DataFrame, as_of: Column) -> DataFrame:
    """Journal rows in the 16 columns of the ledger import, with their sort keys in front."""
    header = invoices.select(
        "invoice_id", "number", "komitent_id", "invoice_date",
        dot_date(booking_date(F.col("invoice_date"), as_of)).alias("booked"))
    empty = F.lit("")
    zero = money(F.lit(0))
    return (
        entries.join(header, "invoice_id")
        .withColumns({
            "KONTO": F.coalesce("konto", empty),
            "SODRZINA": F.coalesce("number", empty),
            "SIFRA KOMITENT": F.coalesce("komitent_id", empty),
            "IZVOD BR": empty,
            "DEN DOLZI": money(F.col("debit")),
            "DEN POBARUVA": money(F.col("credit")),
            "DEV DOLZI": zero,
            "DEV POBARUVA": zero,
            "KURS": zero,
            "DATUM VALUTA": empty,
            "DATUM DOKUMENT": dot_date(last_of_month(as_of)),
            "ZABELESKA": empty,
            "BROJ DOKUMENT": empty,
            "DATUM KNIZENJE": F.col("booked"),
            "STATUS POC": empty,
            "OE": empty,
        })
        .select("invoice_id", "invoice_date", "line_key", *LEDGER_COLUMNS)
    )


def ledger_batch(rows: DataFrame) -> DataFrame:
    """Rows of all invoices of an export: by invoice date, undated first, then journal order.

    The range sort splits on the whole key, so one busy day or one huge invoice does not stay in one
    partition."""
    return rows.orderBy(
        F.col("invoice_date").asc_nulls_first(), "invoice_id", F.col("line_key").asc_nulls_last())


def first_expense_line(entries: DataFrame) -> DataFrame:
    """Account of the first posted expense line of each invoice: what an approval teaches."""
    usable = (F.col("debit") > 0) & (F.coalesce("konto", F.lit("")) != "") & (F.col("konto") != PAYABLE_KONTO)
    first = F.min(F.struct(F.col("line_key").isNull(), F.col("line_key"), F.col("konto")))
    return (
        entries.filter(usable).groupBy("invoice_id").agg(first.alias("first"))
        .select("invoice_id", F.col("first.konto").alias("konto"))
    )


