"""Numbers, dates and names as FIXTURES.md lists them."""

from decimal import Decimal

from pyspark.sql import functions as F

from knigovod.functions import sql, text
from knigovod.functions.dates import booking_date, date_flags, next_friday


def test_amount_spellings(spark):
    cases = {
        "93,548": "93548", "1.234,56": "1234.56", "6,381,65": "6381.65", "1.148.70": "1148.70", "12Ѕ,00": "125.00",
        "6381,65": "6381.65", "1,234.56": "1234.56", "1234.56": "1234.56", "1.234": "1234", "1 234,50 ": "1234.5",
        "1 234,50": "1234.5", "750.": "750", "abc": None, "": None, "...": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.expr(sql.parse_amount("t")).alias("a")).collect()
    for row in rows:
        wanted = cases[row.t]
        assert row.a == (None if wanted is None else Decimal(wanted)), row.t


def test_coerced_numbers(spark):
    cases = {"1.234,56": "1234.56", "93,548": "93548", "": "0", ".": "0", "-": "0", "x": "0", "6,381,65": "638165"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.expr(sql.coerce_decimal("t")).alias("a")).collect()
    assert {r.t: r.a for r in rows} == {k: Decimal(v) for k, v in cases.items()}


def dates(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string").withColumn("t", F.expr(sql.clean_date("raw"))).withColumn(
        "p", F.expr(sql.parse_date("t"))).withColumn("flags", date_flags(F.col("t"), F.col("p"), "invoice_date"))
    return {r.raw: (None if r.p is None else str(r.p.day), r.flags) for r in df.collect()}


def test_dates_without_warning(spark):
    wanted = {
        "26/05/2025": "2025-05-26", "26.05.2025": "2025-05-26", "2025-05-26": "2025-05-26", "26 May 2025": "2025-05-26",
        "May 26, 2025": "2025-05-26", "31.10,22": "2022-10-31", "14.Nov.2025": "2025-11-14", "20250526": "2025-05-26",
        "14.Nov.25": "2025-11-14", "5.6.2025": "2025-06-05",
    }
    got = dates(spark, list(wanted))
    assert got == {k: (v, []) for k, v in wanted.items()}


def test_dates_with_warning(spark):
    got = dates(spark, ["05/26/2025", "not-a-date", "26/05/0025", "31.10.99", None, ""])
    assert got["05/26/2025"][0] == "2025-05-26" and "AMBIGUOUS" in got["05/26/2025"][1][0]
    assert got["not-a-date"][0] is None and "UNPARSEABLE" in got["not-a-date"][1][0]
    assert "SUSPECT" in got["26/05/0025"][1][0]
    assert got["31.10.99"][0] == "1999-10-31" and "SUSPECT" in got["31.10.99"][1][0]
    assert got[None] == (None, []) and got[""] == (None, [])


def test_booking_date_and_friday(spark):
    df = spark.sql("SELECT d, date'2024-02-10' AS today FROM VALUES (date'2024-02-03'), (date'2024-01-31'), (date'2024-03-01'), (CAST(NULL AS date)) AS t(d)")
    got = {str(r.d): str(r.b) for r in df.select("d", booking_date(F.col("d"), F.col("today")).alias("b")).collect()}
    assert got == {"2024-02-03": "2024-02-03", "2024-01-31": "2024-02-01", "2024-03-01": "2024-02-29", "None": "2024-02-29"}
    days = spark.sql("SELECT explode(sequence(date'2024-02-05', date'2024-02-11')) AS d").select("d", next_friday(F.col("d")).alias("f")).collect()
    assert [str(r.f) for r in days] == ["2024-02-09"] * 5 + ["2024-02-16"] * 2


def test_names(spark):
    row = spark.createDataFrame([("Џамбаз Љубчо ДООЕЛ Скопје",)], "t string").select(
        text.transliterate(F.col("t")).alias("latin"), text.match_form(F.col("t")).alias("form")).head()
    assert row.latin == "Dzhambaz Ljubcho DOOEL Skopje" and row.form == "Dzhambaz Ljubcho"


def test_every_character_that_composing_changes_is_sent_to_it(spark):
    import unicodedata

    changed = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    second = {unicodedata.normalize("NFD", chr(c))[1:] for c in range(0x110000) if not 0xD800 <= c < 0xE000} - {""}
    seen = spark.createDataFrame([(c,) for c in changed + sorted(second)], "c string")
    assert seen.filter(~F.col("c").rlike(text.COMPOSABLE)).count() == 0


def test_composed_letters(spark):
    df = text.compose_unicode(spark.createDataFrame([("Ѓорѓи", 1), (None, 2), ("abc", 3)], "t string, k int"), "t")
    assert [r.t for r in df.orderBy("k").collect()] == ["Ѓорѓи", None, "abc"]


def test_keyword_patterns_agree(spark):
    words = ["Фактура :", "Рок за плаќање", "a.b (c)", "ДДВ"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.expr(text.lookalike_pattern("w")).alias("p"))
    assert {r.w: r.p for r in df.collect()} == {w: text.lookalike_regex(w) for w in words}


def test_flags(spark):
    raw = ["TOTAL_MISMATCH [HIGH SEVERITY]: stated 1", "DATE_SUSPECT: x: y", "plain"]
    row = spark.createDataFrame([(raw,)], "flags array<string>").select(
        text.parse_flags(F.col("flags")).alias("f"), text.flag_summary(F.col("flags")).alias("s")).head()
    assert [tuple(f) for f in row.f] == [
        ("high", "Total mismatch", "stated 1"), ("warn", "Date suspect", "x: y"), ("warn", "Plain", "plain")]
    assert row.s == "3 · critical"
