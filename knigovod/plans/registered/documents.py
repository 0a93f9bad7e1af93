"""Documents to lines and records. Orders printed as invoices must give their facts back."""

from __future__ import annotations

from pyspark.sql import functions as F

from knigovod.fixed_values import SYNTHETIC_ITEM
from knigovod.operators import extract as ex
from knigovod.operators import lines as ln
from knigovod.operators.verify import verify_records
from knigovod.plans.bindings import texts, RENDERED, SETTINGS, rendered, table
from knigovod.plans.process import process_documents, verified_records
from knigovod.plans.registered import plain, with_sql

_PAGE_LINES = 5


def _paged(spark, sf):
    """Given documents cut into pages of five lines, inside each row."""
    d = texts(spark, sf).select("doc_id", F.split("text", "\n").alias("all_lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("all_lines") - 1) / _PAGE_LINES).cast("int"))
    pages = F.transform(starts, lambda i: F.struct(
        (i + 1).alias("page"),
        F.array_join(F.slice("all_lines", i * _PAGE_LINES + 1, F.lit(_PAGE_LINES)), "\n").alias("text"),
        F.slice("all_lines", i * _PAGE_LINES + 1, F.lit(_PAGE_LINES)).alias("lines")))
    return d.select("doc_id", pages.alias("pages"))


PAGED = f"""paged AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pages AS (SELECT doc_id, l, [l[i * {_PAGE_LINES} + 1 : i * {_PAGE_LINES} + {_PAGE_LINES}] for i in range(0, (len(l) - 1) // {_PAGE_LINES} + 1)] AS p FROM paged)"""


def pages_merge(spark, sf):
    merged = ln.merge_pages(_paged(spark, sf))
    return plain(merged.withColumn("n_lines", F.size("lines")), "doc_id", "full_text", "n_lines", "page_count")


pages_sql = with_sql(PAGED, """
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN len(p) > 1 THEN '--- Page ' || i || ' ---' || chr(10) ELSE '' END
    || array_to_string(x, chr(10))), chr(10) || chr(10)) AS full_text, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(p) AS BIGINT) AS page_count
FROM pages""")


def text_layer_gate(spark, sf):
    gated = ln.text_layer(_paged(spark, sf))
    return plain(gated.withColumn("n_lines", F.size(F.flatten(F.transform("pages", lambda p: p["lines"])))),
                 "doc_id", "n_chars", "extraction_method", "n_lines")


gate_sql = with_sql(PAGED, """c AS (SELECT doc_id, CAST(list_sum([len(trim(array_to_string(x, chr(10)), ' ')) for x in p]) AS BIGINT) AS n_chars,
    CAST(len(list_filter(l, lambda x: trim(x, ' ') <> '')) AS BIGINT) AS n_lines FROM pages)""", """
SELECT doc_id, n_chars, CASE WHEN n_chars >= 100 THEN 'pdf_text_layer' END AS extraction_method, n_lines FROM c""")


def document_lines(spark, sf):
    docs = ln.from_text(texts(spark, sf).select("doc_id", F.col("text").alias("full_text")))
    return plain(ln.explode_lines(docs))


document_lines_sql = r"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line
FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)"""


def _segments(spark, sf):
    """Words of the given documents as scanned segments: ten to a visual row, at uneven heights."""
    words = texts(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "text"))
    return words.select(
        "doc_id", F.lit(1).alias("page"), ((F.col("pos") * 7) % 10 * 50.0 + F.col("pos") % 10).alias("x_left"),
        (F.floor(F.col("pos") / 10) * 30 + F.col("pos") * 7 % 9 - 5).cast("double").alias("y_top"),
        (F.floor(F.col("pos") / 10) * 30 + F.col("pos") * 7 % 9 + 5).cast("double").alias("y_bottom"),
        "text", F.when(F.col("pos") % 17 == 3, 0.25).otherwise(0.9).alias("conf"))


def segments_to_rows(spark, sf):
    return plain(ln.segment_lines(_segments(spark, sf)), "doc_id", "row_y", "line")


SEGMENTS = r"""words AS (SELECT doc_id, w[i] AS word, i - 1 AS pos FROM (SELECT doc_id, string_split_regex(text, '\s+') AS w FROM documents),
  unnest(range(1, len(w) + 1)) AS t(i)),
seg AS (SELECT doc_id, word, pos // 10 AS r, pos * 7 % 10 * 50.0 + pos % 10 AS x, pos // 10 * 30 + pos * 7 % 9 AS y FROM words WHERE pos % 17 <> 3)"""
segments_sql = with_sql(SEGMENTS, """
SELECT * FROM (SELECT doc_id, CAST(min(y) AS DOUBLE) AS row_y, trim(string_agg(word, ' ' ORDER BY x, y, word), ' ') AS line
  FROM seg GROUP BY doc_id, r) WHERE line <> ''""")


def segment_audit(spark, sf):
    audited = ln.audit_segments(_segments(spark, sf)).groupBy("doc_id", "conf").agg(F.count(F.lit(1)).alias("n"))
    return audited


audit_sql = with_sql(SEGMENTS, "SELECT doc_id, CAST(0.9 AS DOUBLE) AS conf, count(*) AS n FROM seg GROUP BY 1")


def sections(spark, sf):
    counted = ln.sectioned_lines(rendered(spark, sf)).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))
    return counted


sections_sql = with_sql(RENDERED, """
SELECT doc_id, section, n FROM doc, (VALUES (0, 'header', 8), (0, 'items', 3), (0, 'totals', 3), (0, 'footer', 2), (1, 'header', 12),
  (2, 'header', 7), (3, 'header', 7), (4, 'header', 5), (4, 'items', 3), (4, 'totals', 3), (4, 'footer', 2),
  (5, 'header', 4), (5, 'items', 3), (5, 'totals', 2), (5, 'footer', 2)) AS s(layout_no, section, n) WHERE layout = layout_no""").replace(
    "SELECT doc_id, section, n", "SELECT doc_id, section, CAST(n AS BIGINT) AS n")


def item_lines(spark, sf):
    marked = ln.mark_sections(rendered(spark, sf)).select("doc_id", F.posexplode(F.expr(ln.item_rows("lines"))).alias("item_no", "i"))
    return plain(marked, "doc_id", "item_no", "i.description", "i.amount")


# Amounts of the item rows as they are printed, in cents.
ITEMS = """base AS (SELECT *, CASE layout WHEN 5 THEN total_c ELSE net_c END AS c FROM doc),
printed AS (SELECT doc_id, layout, net_c, total_c, tax_c, c, [c // 2, CASE layout WHEN 4 THEN c // 3 * 100 ELSE c // 3 END, c - c // 2 - c // 3] AS a
  FROM base WHERE layout IN (0, 4, 5))"""
item_lines_sql = with_sql(RENDERED, ITEMS, """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS item_no, ['1. Интернет услуга', '2. Одржување опрема', '3. Хартија А4'][i] AS description, a[i] / 100.0 AS amount
FROM printed, unnest([1, 2, 3]) AS t(i)""")


def _marked(spark, sf):
    return ln.mark_sections(rendered(spark, sf))


def extract_vendor(spark, sf):
    return _marked(spark, sf).select("doc_id", F.expr(ex.vendor_name(SETTINGS)).alias("vendor"))


VENDOR = """CASE WHEN layout IN (0, 5) THEN 'Трговија ' || cust || ' ДООЕЛ' WHEN layout = 2 THEN 'Customer ' || cust || ' Ltd'
  WHEN layout = 3 THEN 'Занаетчија ' || cust || ' Битола' ELSE 'Customer ' || cust || ' DOOEL Skopje' END"""
vendor_sql = with_sql(RENDERED, f"SELECT doc_id, {VENDOR} AS vendor FROM doc")


def extract_vat(spark, sf):
    return rendered(spark, sf).select(
        "doc_id", F.expr(ex.vat_id()).alias("vat_id"), F.expr(ex.vat_number(SETTINGS)).alias("vat_number"))


# The first layout names the buyer's number first: the identity takes it, the vendor's number skips it.
vat_sql = with_sql(RENDERED, """
SELECT doc_id, CASE WHEN layout IN (0, 1, 4) THEN 'МК' || lpad(CAST(cust AS VARCHAR), 13, '0') END AS vat_id,
  CASE WHEN layout IN (0, 1, 4) THEN lpad(CAST(cust AS VARCHAR), 13, '0') END AS vat_number FROM doc""")


def extract_number(spark, sf):
    return _marked(spark, sf).select("doc_id", F.expr(ex.invoice_number(SETTINGS)).alias("number"))


NUMBER = """CASE layout WHEN 0 THEN 'INV-' || doc_id WHEN 2 THEN 'EXP/' || doc_id WHEN 4 THEN 'ИС-' || doc_id
  WHEN 5 THEN doc_id || '/' || year(day) ELSE '25-' || doc_id END"""
number_sql = with_sql(RENDERED, f"SELECT doc_id, {NUMBER} AS number FROM doc")


def extract_dates(spark, sf):
    dated = _marked(spark, sf).withColumn("due", F.expr(ex.due_date())).withColumn("day", F.expr(ex.invoice_date("due")))
    return dated.select("doc_id", "day", F.when(~F.col("due").eqNullSafe(F.col("day")), F.col("due")).alias("due"))


DAY = "CASE layout WHEN 2 THEN strftime(day, '%d/%m/%Y') WHEN 5 THEN strftime(day, '%d.%m,%y') ELSE strftime(day, '%d.%m.%Y') END"
dates_sql = with_sql(RENDERED, f"""
SELECT doc_id, {DAY} AS day, CASE layout WHEN 0 THEN strftime(day + 30, '%d.%m.%Y') WHEN 2 THEN strftime(day + 30, '%d/%m/%Y') END AS due FROM doc""")


def extract_totals(spark, sf):
    return plain(ex.add_totals(_marked(spark, sf), SETTINGS), "doc_id", "total", "subtotal", "tax_rate", "tax_amount")


totals_sql = with_sql(RENDERED, """
SELECT doc_id, total_c / 100.0 AS total, CASE WHEN layout IN (0, 2, 4, 5) THEN net_c / 100.0 END AS subtotal,
  CASE WHEN layout IN (0, 2, 4) THEN CAST(18 AS DOUBLE) END AS tax_rate, CASE WHEN layout IN (0, 2, 4, 5) THEN tax_c / 100.0 END AS tax_amount FROM doc""")


def extract_items(spark, sf):
    found = ex.add_line_items(ex.add_totals(_marked(spark, sf), SETTINGS))
    items = found.select("doc_id", "amount_basis", F.posexplode("line_items").alias("item_no", "i"))
    return plain(items, "doc_id", "amount_basis", "item_no", "i.description", "i.line_total", "i.vat_rate")


items_sql = with_sql(RENDERED, ITEMS, f"""
SELECT doc_id, CASE layout WHEN 5 THEN 'gross' ELSE 'net' END AS amount_basis, CAST(i - 1 AS BIGINT) AS item_no,
  ['1. Интернет услуга', '2. Одржување опрема', '3. Хартија А4'][i] AS description,
  CASE WHEN layout = 4 AND i = 2 THEN c // 3 ELSE a[i] END / 100.0 AS line_total, CASE WHEN layout <> 5 THEN CAST(18 AS DOUBLE) END AS vat_rate
FROM printed, unnest([1, 2, 3]) AS t(i)
UNION ALL SELECT doc_id, 'gross', 0, '{SYNTHETIC_ITEM}', total_c / 100.0, NULL FROM doc WHERE layout IN (1, 2, 3)""")


def extract_record(spark, sf):
    records = verified_records(rendered(spark, sf), SETTINGS)
    return plain(
        records.withColumns({"n_items": F.size("line_items"), "codes": F.array_join(F.transform(
            "flags", lambda f: F.regexp_extract(f, "^[A-Z_]+", 0)), ",")}),
        "doc_id", "vendor_name", "invoice_number", "invoice_date", "due_date", "total", "tax_amount", "amount_basis", "n_items", "codes")


record_sql = with_sql(RENDERED, f"""
SELECT doc_id, {VENDOR} AS vendor_name, {NUMBER} AS invoice_number, day AS invoice_date, CASE WHEN layout IN (0, 2) THEN day + 30 END AS due_date,
  total_c / 100.0 AS total, CASE WHEN layout IN (0, 2, 4, 5) THEN tax_c / 100.0 END AS tax_amount,
  CASE WHEN layout IN (0, 4) THEN 'net' ELSE 'gross' END AS amount_basis, CAST(CASE WHEN layout IN (1, 2, 3) THEN 1 ELSE 3 END AS BIGINT) AS n_items,
  CASE WHEN year(day) < 2000 THEN 'DATE_SUSPECT' ELSE '' END AS codes FROM doc""")


def post_process_flags(spark, sf):
    """Warnings of records whose stated total and lines are partly off."""
    from knigovod.functions.amounts import money

    records = verified_records(rendered(spark, sf), SETTINGS).select(
        "doc_id", "invoice_date_raw", "due_date_raw", "line_items", "amount_basis", "total", "subtotal", "tax_rate", "tax_amount")
    off = F.col("doc_id") % 7
    broken = records.withColumns({
        "total": F.col("total") + F.when(off == 0, money(F.lit(10))).otherwise(money(F.lit(0))),
        "invoice_date_raw": F.when(off == 1, "not-a-date").otherwise(F.col("invoice_date_raw")),
        "line_items": F.transform("line_items", lambda x, i: F.when(
            (off == 2) & (i == 0), x.withField("line_total", money(x["line_total"] + 5))).otherwise(x))})
    checked = verify_records(broken, SETTINGS)
    return plain(checked.withColumn("codes", F.array_join(F.transform("flags", lambda f: F.regexp_extract(f, "^[A-Z_]+", 0)), ",")),
                 "doc_id", "total", "codes", "invoice_date_text")


flags_sql = with_sql(RENDERED, f"""
SELECT doc_id, (total_c + CASE WHEN doc_id % 7 = 0 AND layout IN (0, 4) THEN 1000 ELSE 0 END) / 100.0 AS total, array_to_string(list_filter([
    CASE WHEN doc_id % 7 = 1 THEN 'DATE_UNPARSEABLE' WHEN year(day) < 2000 THEN 'DATE_SUSPECT' END,
    CASE WHEN doc_id % 7 = 2 THEN 'LINE_MATH_ERROR' END, CASE WHEN doc_id % 7 = 0 AND layout NOT IN (0, 4) THEN 'TOTAL_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS codes,
  CASE WHEN doc_id % 7 = 1 THEN 'not-a-date' ELSE strftime(day, '%Y-%m-%d') END AS invoice_date_text
FROM doc""")


def process_given_documents(spark, sf):
    """The whole job over the given documents, which are noise to it: what it makes of each."""
    from knigovod.plans.bindings import registry, templates

    docs = ln.from_text(texts(spark, sf).select("doc_id", F.col("text").alias("full_text")))
    records = process_documents(docs, templates(spark, sf), registry(spark, sf), settings=SETTINGS)
    return plain(records, "doc_id", "vendor_name", "invoice_number", "invoice_date_text", "total", "konto", "komitent_id", "error")


def process_orders(spark, sf):
    """The whole job from documents to ledger rows: printed orders are read by templates and rules, checked, given a
    counterparty and an account, posted, and written as ledger rows."""
    from knigovod.operators import journal as jn
    from knigovod.operators.registry import with_match_form
    from knigovod.plans.bindings import as_of, templates
    from knigovod.plans.process import post

    docs = ln.from_text(rendered(spark, sf).select("doc_id", "full_text"))
    # Counterparties come from the templates; the registry's queries have their own.
    nobody = with_match_form(spark.createDataFrame([], "reg_order long, id string, name string"))
    records = process_documents(docs, templates(spark, sf), nobody, settings=SETTINGS)
    invoices, entries = post(records, as_of())
    return plain(jn.ledger_rows(entries, invoices, as_of()), "invoice_id", "KONTO", "SODRZINA", F.col("`SIFRA KOMITENT`").alias("sifra"),
                 F.col("`DEN DOLZI`").alias("debit"), F.col("`DEN POBARUVA`").alias("credit"), F.col("`DATUM KNIZENJE`").alias("booked"))


def _process_orders_sql() -> str:
    from knigovod.plans.bindings import AS_OF, rule_case
    from knigovod.plans.registered.accounts import DOCUMENT_RULES

    # The account goes by words that all documents of a layout share; vendor names hold none of the rules' words.
    words = """CASE WHEN layout IN (0, 4, 5) THEN 'Интернет услуга Одржување опрема Хартија А4 Трансакциска сметка Директор'
      WHEN layout = 1 THEN 'ФАКТУРА Опис на работата Вкупно за плаќање Трансакциска сметка Директор' WHEN layout = 2 THEN 'Invoice Date Due date Subtotal VAT Total'
      ELSE 'Занаетчија Битола Фактура За извршена работа Рок до 30 дена Со зборови Скопје' END"""
    return with_sql(RENDERED, f"""known AS (SELECT doc.*, c_custkey IS NOT NULL AND layout IN (0, 1, 4) AND cust % 3 <> 2 AS used
  FROM doc LEFT JOIN customer ON c_custkey = cust),
rec AS (SELECT *, CASE WHEN used AND cust % 2 = 0 AND layout <> 1 THEN CAST(doc_id AS VARCHAR) ELSE {NUMBER} END AS number,
  CASE WHEN used AND cust % 4 = 0 THEN CAST(cust AS VARCHAR) ELSE '' END AS sifra, {rule_case(words, DOCUMENT_RULES)} AS konto,
  CASE WHEN layout IN (0, 4) THEN net_c ELSE total_c END AS c FROM known),
items AS (SELECT doc_id, layout, tax_c, unnest(CASE WHEN layout IN (0, 4, 5) THEN [c // 2, c // 3, c - c // 2 - c // 3] ELSE [c] END) AS net,
  unnest(CASE WHEN layout IN (0, 4, 5) THEN [1, 2, 3] ELSE [1] END) AS i FROM rec),
-- Net lines are grossed up; where lines are not taxed but the invoice states a tax, the largest line takes it.
amounts AS (SELECT doc_id, i, CASE WHEN layout IN (0, 4) THEN (net * 118 + 50) // 100
  WHEN layout IN (2, 5) AND row_number() OVER (PARTITION BY doc_id ORDER BY net DESC, i) = 1 THEN net + tax_c ELSE net END AS amount FROM items),
units AS (SELECT doc_id, (amount + 50) // 100 AS u FROM amounts WHERE amount <> 0),
rows_ AS (SELECT doc_id, konto, u AS debit, 0 AS credit FROM units JOIN rec USING (doc_id)
  UNION ALL SELECT doc_id, '2200', 0, sum(u) FROM units GROUP BY 1)""", f"""
SELECT doc_id AS invoice_id, rows_.konto AS "KONTO", number AS "SODRZINA", sifra, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
  strftime(CASE WHEN date_trunc('month', day) = date_trunc('month', DATE '{AS_OF}') THEN day
    WHEN day < DATE '{AS_OF}' THEN CAST(date_trunc('month', DATE '{AS_OF}') AS DATE) ELSE last_day(DATE '{AS_OF}') END, '%d.%m.%Y') AS booked
FROM rows_ JOIN rec USING (doc_id)""")


QUERIES = {
    "pages_merge": (pages_merge, pages_sql),
    "text_layer_gate": (text_layer_gate, gate_sql),
    "document_lines": (document_lines, document_lines_sql),
    "segments_to_rows": (segments_to_rows, segments_sql),
    "segment_audit": (segment_audit, audit_sql),
    "sections": (sections, sections_sql),
    "item_lines": (item_lines, item_lines_sql),
    "extract_vendor": (extract_vendor, vendor_sql),
    "extract_vat": (extract_vat, vat_sql),
    "extract_number": (extract_number, number_sql),
    "extract_dates": (extract_dates, dates_sql),
    "extract_totals": (extract_totals, totals_sql),
    "extract_items": (extract_items, items_sql),
    "extract_record": (extract_record, record_sql),
    "post_process_flags": (post_process_flags, flags_sql),
    "process_given_documents": (process_given_documents, None),
    "process_orders": (process_orders, _process_orders_sql()),
}
