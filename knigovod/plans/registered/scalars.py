"""Scalar forms: amounts, dates, tax numbers, names, warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from knigovod.fixed_values import DESCRIPTION_KEYWORDS, LATIN_OF_CYRILLIC
from knigovod.functions import dates, sql, text
from knigovod.operators import lines as ln
from knigovod.operators.verify import validate_records, with_outcome
from knigovod.plans.bindings import texts, INVOICES, cents, from_cents, invoices, table
from knigovod.plans.registered import money_text, plain, with_sql


def amount_roundtrip(spark, sf):
    """Prices written in six spellings by key and read back."""
    c = cents("l_extendedprice")
    value = from_cents(c)
    anglo = F.format_number(value, 2)
    spellings = F.array(
        F.translate(anglo, ",.", ".,"), anglo, value.cast("string"), F.replace(anglo, F.lit("."), F.lit(",")),
        F.concat(F.lit(" "), F.translate(anglo, ",.", ".,"), F.lit(".")), F.replace(anglo, F.lit(","), F.lit(".")))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c"), spellings.alias("s"))
    read = li.withColumn("spelled", F.element_at("s", (F.col("l_orderkey") % 6 + 1).cast("int")))
    return plain(
        read.withColumns({"amount": F.expr(sql.parse_amount("spelled")), "coerced": F.expr(sql.coerce_decimal("spelled"))}),
        "l_orderkey", "l_linenumber", "amount", "coerced")


# The last spellings are ambiguous from a million on; prices stay below that.
amount_sql = """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_orderkey % 6 AS form FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  -- A full stop behind the fifth spelling spoils it: the comma goes, and the first dot is taken for the decimal point.
  CASE WHEN form <> 4 THEN c / 100.0 WHEN c < 100000 THEN CAST(c AS DOUBLE)
       ELSE CAST((c // 100000) || '.' || lpad(CAST(c // 100 % 1000 AS VARCHAR), 3, '0') || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS amount,
  CASE WHEN form IN (0, 1, 2) THEN c / 100.0
       WHEN form = 3 THEN CASE WHEN c >= 100000 THEN CAST(c AS DOUBLE) ELSE c / 100.0 END
       WHEN form = 4 THEN CASE WHEN c >= 100000 THEN CAST(0 AS DOUBLE) ELSE CAST(c AS DOUBLE) END
       ELSE CASE WHEN c >= 100000 THEN CAST(0 AS DOUBLE) ELSE c / 100.0 END END AS coerced
FROM p"""


def date_roundtrip(spark, sf):
    """Order dates written in eight spellings by key and read back, with their warnings."""
    day = F.to_date("o_orderdate")
    spelled = F.element_at(F.array(*[
        F.date_format(day, f) for f in ("dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "d MMMM yyyy", "dd.MM,yy", "yyyyMMdd", "dd.MMM.yyyy", "MM-yyyy")]),
        (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", spelled.alias("spelled"))
    o = o.withColumn("clean", F.expr(sql.clean_date("spelled"))).withColumn("parsed", F.expr(sql.parse_date("clean")))
    return o.select("o_orderkey", F.col("parsed.day").alias("day"), F.array_join(
        F.transform(dates.date_flags(F.col("clean"), F.col("parsed"), "invoice_date"), lambda f: F.regexp_extract(f, "^[A-Z_]+", 0)), ",").alias("codes"))


date_sql = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 7 THEN CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 8 = 7 THEN 'DATE_UNPARSEABLE' WHEN year(o_orderdate) < 2000 THEN 'DATE_SUSPECT' ELSE '' END AS codes FROM orders"""


def vat_normalize(spark, sf):
    latin = sql.normalize_vat("concat('mk 40', lpad(s_suppkey, 9, '0'), ' 7')")
    cyrillic = sql.normalize_vat("concat('МК', s_suppkey)")
    return table(spark, sf, "supplier").select("s_suppkey", F.expr(latin).alias("latin"), F.expr(cyrillic).alias("cyrillic"))


vat_sql = """SELECT s_suppkey, '40' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '7' AS latin,
  CAST(s_suppkey AS VARCHAR) AS cyrillic FROM supplier"""

_CYRILLIC = "Ѓорѓи Џамбаз и Љубчо Њушка ДООЕЛ Скопје "


def transliterate(spark, sf):
    name = F.concat(F.lit(_CYRILLIC), F.col("c_mktsegment"), F.lit(" AD "), F.col("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey", text.transliterate(name).alias("latin"), text.match_form(name).alias("form"))


def _replaced(sql: str) -> str:
    for cyrillic, latin in LATIN_OF_CYRILLIC:
        sql = f"replace({sql}, '{cyrillic}', '{latin}')"
    return sql


translit_sql = f"""SELECT c_custkey, {_replaced(f"('{_CYRILLIC}' || c_mktsegment || ' AD ' || c_name)")} AS latin,
  'Gjorgji Dzhambaz i Ljubcho Njushka ' || c_mktsegment || ' ' || c_name AS form FROM customer"""


def focus_text(spark, sf):
    return texts(spark, sf).select("doc_id", text.focus_text(F.col("text")).alias("focus"))


focus_sql = f"""WITH l AS (SELECT doc_id, text, [trim(x, ' ') FOR x IN string_split_regex(text, '\\r\\n|\\r|\\n')
    IF {' OR '.join(f"contains(lower(x), '{k}')" for k in DESCRIPTION_KEYWORDS)}] AS hits FROM documents)
SELECT doc_id, left(trim(left(text, 350) || ' ' || array_to_string(hits[1:4], ' '), ' '), 500) AS focus FROM l"""


def flag_parse(spark, sf):
    key = F.col("invoice_id")
    flag = F.when(key % 3 == 0, F.concat(F.lit("TOTAL_MISMATCH [HIGH SEVERITY]: stated "), "total")).when(
        key % 3 == 1, F.concat(F.lit("date_suspect: year "), F.year("received"))).otherwise(F.lit("no colon here"))
    f = invoices(spark, sf).select("invoice_id", text.parse_flag(flag).alias("f"), F.array_repeat(flag, (key % 4).cast("int")).alias("flags"))
    return f.select("invoice_id", "f.severity", "f.label", "f.text", text.flag_summary(F.col("flags")).alias("summary"))


flag_sql = with_sql(INVOICES, f"""
SELECT invoice_id, CASE WHEN invoice_id % 3 = 0 THEN 'high' ELSE 'warn' END AS severity,
  CASE invoice_id % 3 WHEN 0 THEN 'Total mismatch' WHEN 1 THEN 'Date suspect' ELSE 'No colon here' END AS label,
  CASE invoice_id % 3 WHEN 0 THEN 'stated ' || {money_text('total_c')} WHEN 1 THEN 'year ' || year(received) ELSE 'no colon here' END AS text,
  CASE WHEN invoice_id % 4 = 0 THEN NULL WHEN invoice_id % 3 = 0 THEN invoice_id % 4 || ' · critical'
    WHEN invoice_id % 4 = 1 THEN '1 warning' ELSE invoice_id % 4 || ' warnings' END AS summary
FROM inv""")


def record_validation(spark, sf):
    i = invoices(spark, sf)
    item = F.struct(F.lit("x").alias("description"), F.lit(1).alias("quantity"))
    records = i.select(
        "invoice_id", F.when(F.col("invoice_id") % 19 != 0, F.concat(F.lit(" "), "vendor")).alias("vendor_name"),
        F.col("number").alias("invoice_number"), dates.iso(F.col("invoice_date")).alias("invoice_date_raw"), "invoice_date", "total",
        F.array_repeat(item, (F.col("invoice_id") % 3).cast("int")).alias("line_items"),
        (F.col("invoice_id") % 4 == 0).alias("komitent_low_confidence"))
    judged = with_outcome(validate_records(records))
    return judged.select("invoice_id", "vendor_name", "error", "success", "has_warnings", "has_errors", "date_marked", "komitent_marked")


validation_sql = with_sql(INVOICES, """judged AS (SELECT *, array_to_string(list_filter([CASE WHEN invoice_id % 19 = 0 THEN 'vendor_name' END,
    CASE WHEN invoice_date IS NULL THEN 'invoice_date' END, CASE WHEN invoice_id % 3 = 0 THEN 'line_items' END], lambda x: x IS NOT NULL), ', ') AS missing FROM inv)""", """
SELECT invoice_id, CASE WHEN invoice_id % 19 <> 0 THEN vendor END AS vendor_name,
  CASE WHEN missing <> '' THEN 'Schema validation failed: ' || missing END AS error, missing = '' AS success,
  missing <> '' AS has_warnings, false AS has_errors, invoice_date IS NULL AS date_marked, invoice_id % 4 = 0 AS komitent_marked FROM judged""")


def suffix_route(spark, sf):
    """Web addresses as file paths, with an extension by key."""
    ending = F.element_at(F.array(F.lit(".PDF"), F.lit(".png"), F.lit(".docx"), F.lit(""), F.lit(".jpeg")), (F.col("page_id") % 5 + 1).cast("int"))
    files = table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#.]", "_"), ending).alias("path"))
    return ln.route_files(files).select("page_id", "route", F.substring_index("error", ".", 1).alias("error"), "suffix")


suffix_sql = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text_layer' WHEN 1 THEN 'image' WHEN 4 THEN 'image' END AS route,
  CASE page_id % 5 WHEN 2 THEN 'Unsupported file type: ' WHEN 3 THEN 'Unsupported file type: ' END AS error,
  CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' WHEN 3 THEN '' ELSE '.jpeg' END AS suffix FROM pages"""

QUERIES = {
    "amount_roundtrip": (amount_roundtrip, amount_sql),
    "date_roundtrip": (date_roundtrip, date_sql),
    "vat_normalize": (vat_normalize, vat_sql),
    "transliterate": (transliterate, translit_sql),
    "focus_text": (focus_text, focus_sql),
    "flag_parse": (flag_parse, flag_sql),
    "record_validation": (record_validation, validation_sql),
    "suffix_route": (suffix_route, suffix_sql),
}
