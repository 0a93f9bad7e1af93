"""The given tables in the roles of invoices, line items, documents and dimensions.

Each binding has a twin: a common table expression for the SQL that checks the queries. Amounts are
whole cents on the SQL side and decimals on the Spark side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knigovod.config import Settings
from knigovod.functions.amounts import money
from knigovod.operators.registry import with_match_form
from knigovod.operators.stages import computed, spread

OWN_VAT = "4000000000001"
SETTINGS = Settings(own_vat_numbers=(OWN_VAT,), buyer_pattern=r"Купувач Пример")
AS_OF = "1998-06-15"


def as_of(day: str = AS_OF) -> Column:
    return F.lit(day).cast("date")


def ensure_shared_folder(spark: SparkSession) -> None:
    """A local session that names no checkpoint folder gets one below its warehouse; a cluster must name its own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_shared_folder(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def from_cents(col: Column) -> Column:
    return money(col.cast("decimal(20,2)") / 100)


# --- Invoices and line items ------------------------------------------------------------------------------


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.when(key % 97 != 0, F.to_date("o_orderdate"))
    return o.select(
        key.alias("invoice_id"),
        F.concat(F.lit("INV-"), key).alias("number"),
        F.concat(F.lit("Customer#"), F.lpad(cust.cast("string"), 9, "0")).alias("vendor"),
        F.when(key % 6 != 0, cust.cast("string")).alias("komitent_id"),
        day.alias("invoice_date"),
        F.date_add(day, 30).alias("due_date"),
        F.date_add(F.to_date("o_orderdate"), (key % 4).cast("int")).alias("received"),
        F.when(key % 10 != 0, F.element_at(F.array(F.lit("MKD"), F.lit("EUR"), F.lit("USD")), (cust % 3 + 1).cast("int"))).alias("currency"),
        from_cents(cents("o_totalprice")).alias("total"),
        money((key % 5) * 10).alias("tax_amount"),
        F.when(key % 11 == 0, "Rejected").when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "P", "Approved").otherwise("Exported").alias("status"),
        (key % 13 == 0).alias("blocked"),
        F.when(key % 17 == 0, "4112").alias("konto_suggestion"),
    )


INVOICES = """inv AS (
  SELECT o_orderkey AS invoice_id, 'INV-' || o_orderkey AS number,
    'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS vendor,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS komitent_id,
    CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS invoice_date,
    CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS due_date,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS received,
    CASE WHEN o_orderkey % 10 <> 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'MKD' WHEN 1 THEN 'EUR' ELSE 'USD' END END AS currency,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total_c,
    (o_orderkey % 5) * 1000 AS tax_c,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Rejected' WHEN o_orderstatus = 'O' THEN 'Pending'
         WHEN o_orderstatus = 'P' THEN 'Approved' ELSE 'Exported' END AS status,
    o_orderkey % 13 = 0 AS blocked,
    CASE WHEN o_orderkey % 17 = 0 THEN '4112' END AS konto_suggestion
  FROM orders)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given documents (doc_id, text)."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def stated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose stated totals are partly off: by one cent, two cents, or ten."""
    li = table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity").cast("bigint")
    unit = F.floor(cents("l_extendedprice") / qty).cast("bigint")
    off = F.when(F.col("l_partkey") % 7 == 0, 1).when(F.col("l_partkey") % 7 == 1, -2).when(
        F.col("l_partkey") % 7 == 2, 1000).otherwise(0)
    return li.select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_no"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line_key"),
        F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" as it is listed in the catalogue")).alias("description"),
        qty.cast("decimal(18,4)").alias("quantity"),
        (unit.cast("decimal(18,2)") / 100).cast("decimal(18,4)").alias("unit_price"),
        from_cents(qty * unit + off).alias("line_total"),
        (F.col("l_tax").cast("decimal(5,2)") * 100).cast("decimal(5,2)").alias("vat_rate"))


STATED_LINES = """stated AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, l_partkey, l_suppkey,
    'Part ' || l_partkey || ' as it is listed in the catalogue' AS description,
    CAST(l_quantity AS BIGINT) AS qty,
    CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_c,
    CAST(l_quantity AS BIGINT) * (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) AS expected_c,
    CAST(l_quantity AS BIGINT) * (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT))
      + CASE l_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 1000 ELSE 0 END AS stated_c,
    CAST(round(l_tax * 100) AS BIGINT) AS rate
  FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the journal takes them: some round off, some are returns."""
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax", "l_returnflag"), "l_orderkey")
    part = table(spark, sf_dir, "part")
    rounds = (F.col("l_linenumber") == 1) & (F.col("l_partkey") % 10 == 0)
    back = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") >= 6)
    net = F.when(rounds, F.col("l_suppkey") % 200 - 100).when(back, -cents("l_extendedprice")).otherwise(cents("l_extendedprice"))
    return (
        li.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
        .select(
            F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_no"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line_key"),
            F.when(rounds, "Rounding adjustment").otherwise(F.col("p_name")).alias("description"),
            from_cents(net).alias("line_total"),
            (F.col("l_tax").cast("decimal(5,2)") * 100).cast("decimal(5,2)").alias("vat_rate"))
    )


LINES = """lines AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, l_partkey, l_suppkey,
    CASE WHEN l_linenumber = 1 AND l_partkey % 10 = 0 THEN 'Rounding adjustment' ELSE p_name END AS description,
    CASE WHEN l_linenumber = 1 AND l_partkey % 10 = 0 THEN l_suppkey % 200 - 100
         WHEN l_returnflag = 'R' AND l_linenumber >= 6 THEN -CAST(round(l_extendedprice * 100) AS BIGINT)
         ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS net_c,
    CAST(round(l_tax * 100) AS BIGINT) AS rate
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""

# Account rules over the words of part names.
PART_RULES = [
    (0, "4030", "Energy", "ring"), (1, "4010", "Office", "bolt"), (1, "4010", "Office", "plate"),
    (2, "4130", "Upkeep", "gear"), (3, "44907", "Software", "small widget"), (4, "4109", "Transport", "rod"),
]


def part_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PART_RULES, "rule_order int, konto string, label string, keyword string")


def rule_case(text: str, rules=None) -> str:
    """The rules as an SQL expression."""
    rules = PART_RULES if rules is None else rules
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN contains(lower({text}), {quote(k.lower())}) THEN {quote(konto)}" for _, konto, _, k in rules)
    return f"CASE {whens} ELSE '4499' END"


# --- Registry and accounts ------------------------------------------------------------------------------


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as counterparties. One in four has a name of its own; the others share its telling part
    with one or two more."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return with_match_form(c.select(
        F.col("c_custkey").alias("reg_order"), F.col("c_custkey").cast("string").alias("id"),
        registry_name().alias("name")))


def registry_name(key: str = "c_custkey", segment: str = "c_mktsegment") -> Column:
    key = F.col(key)
    return F.concat(
        F.initcap(F.col(segment)),
        F.when(key % 4 == 0, F.concat(F.lit(" Solo"), F.lpad(key.cast("string"), 6, "0"))).otherwise(F.concat(
            F.lit(" N"), F.lpad((key % 7).cast("string"), 2, "0"), F.lit(" Vendor"),
            F.lpad(F.floor(key / 3).cast("string"), 6, "0"))),
        F.lit(" DOOEL"))


REGISTRY = """reg AS (
  SELECT c_custkey AS reg_order, CAST(c_custkey AS VARCHAR) AS id, norm_name || ' DOOEL' AS name, norm_name
  FROM (SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || CASE WHEN c_custkey % 4 = 0
      THEN ' Solo' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')
      ELSE ' N' || lpad(CAST(c_custkey % 7 AS VARCHAR), 2, '0') || ' Vendor' || lpad(CAST(c_custkey // 3 AS VARCHAR), 6, '0')
      END AS norm_name FROM customer))"""


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor names on orders: as registered, shortened (own names in Cyrillic), or misspelt."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    short = F.when(key % 4 == 0, F.concat(F.lit("Соло"), F.lpad(key.cast("string"), 6, "0"), F.lit(" ДООЕЛ"))).otherwise(
        F.concat(F.lit("Vendor"), F.lpad(F.floor(key / 3).cast("string"), 6, "0"), F.lit(" Skopje")))
    name = registry_name()
    written = F.when(key % 3 == 0, F.lower(name)).when(key % 3 == 1, short).otherwise(
        F.regexp_replace(F.regexp_replace(name, "Vendor", "Vndor"), "Solo", "Slo"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c_custkey")).join(
        c.select("c_custkey", "c_mktsegment"), "c_custkey").select("doc_id", "c_custkey", written.alias("vendor_name"))


ASKED = """asked AS (
  SELECT o_orderkey AS doc_id, o_custkey AS cust,
    CASE o_custkey % 3 WHEN 0 THEN lower(reg.name)
      WHEN 1 THEN CASE WHEN o_custkey % 4 = 0 THEN 'Соло' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || ' ДООЕЛ'
                       ELSE 'Vendor' || lpad(CAST(o_custkey // 3 AS VARCHAR), 6, '0') || ' Skopje' END
      ELSE replace(replace(reg.name, 'Vendor', 'Vndor'), 'Solo', 'Slo') END AS vendor_name,
    CASE o_custkey % 3 WHEN 0 THEN lower(reg.norm_name)
      WHEN 1 THEN CASE WHEN o_custkey % 4 = 0 THEN 'Solo' || lpad(CAST(o_custkey AS VARCHAR), 6, '0')
                       ELSE 'Vendor' || lpad(CAST(o_custkey // 3 AS VARCHAR), 6, '0') END
      ELSE replace(replace(reg.norm_name, 'Vendor', 'Vndor'), 'Solo', 'Slo') END AS norm
  FROM orders JOIN reg ON reg.reg_order = o_custkey)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a chart of accounts; a part in five is an expense account."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("acct_order"),
        F.concat((F.col("p_partkey") % 5 + 1).cast("string"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("code"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"))


ACCOUNTS = """acc AS (
  SELECT p_partkey AS acct_order, (p_partkey % 5 + 1) || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code,
    p_name || ' ' || p_type AS description FROM part)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("corr_id"), "embedding", F.concat(F.lit("4"), F.col("label")).alias("konto"),
        F.lit(None).cast("string").alias("komitent_id"), F.lit("").alias("preview"))


def vector_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("acct_order"),
        F.concat(F.when(F.col("vec_id") % 4 == 1, "2").otherwise("4"), F.lit("1"), F.col("label")).alias("code"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector read backwards (so that it is not its own neighbour), with the text of the document of the same number."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    return e.join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding"), F.coalesce("text", F.lit("")).alias("text"))


# --- Rendered documents ------------------------------------------------------------------------------------

LAYOUTS = 6


def _european(c: Column) -> Column:
    return F.translate(F.format_number(from_cents(c), 2), ",.", ".,")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as invoices, in one of six layouts by key. A map over the orders."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    facts = o.select(
        key.alias("doc_id"), (key % LAYOUTS).alias("layout"), cust.alias("cust"), F.to_date("o_orderdate").alias("day"),
        cents("o_totalprice").alias("net_c")
    ).withColumn("tax_c", F.floor((F.col("net_c") * 18 + 50) / 100).cast("bigint")).withColumn(
        "total_c", F.col("net_c") + F.col("tax_c"))
    net, tax, total, day = (F.col(c) for c in ("net_c", "tax_c", "total_c", "day"))
    number, cust_text = F.col("doc_id").cast("string"), F.col("cust").cast("string")
    due = F.date_add(day, 30)
    dots = lambda d: F.date_format(d, "dd.MM.yyyy")
    slashes = lambda d: F.date_format(d, "dd/MM/yyyy")
    half = lambda c: F.floor(c / 2).cast("bigint")
    third = lambda c: F.floor(c / 3).cast("bigint")
    vat = F.concat(F.lit("ЕДБ: МК"), F.lpad(cust_text, 13, "0"))

    def rows(c: Column, second: Column) -> list:
        return [
            "Опис Износ",
            F.concat(F.lit("1. Интернет услуга "), _european(half(c))),
            F.concat(F.lit("2. Одржување опрема "), second),
            F.concat(F.lit("3. Хартија А4 "), _european(c - half(c) - third(c))),
        ]

    def page(*parts) -> Column:
        return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    footer = ["Трансакциска сметка 300000000012345", "Директор"]
    net_rows = lambda second: [
        *rows(net, second), F.concat(F.lit("Основица: "), _european(net)),
        F.concat(F.lit("ДДВ 18% "), _european(tax)),
        F.concat(F.lit("За наплата: "), _european(total), F.lit(" ден"))]
    layouts = [
        page(
            F.concat(F.lit("Добавувач: Трговија "), cust_text, F.lit(" ДООЕЛ")), "ул. Партизанска 12",
            f"Купувач Пример АД ЕДБ {OWN_VAT}", vat, F.concat(F.lit("Фактура број: INV-"), number),
            F.concat(F.lit("Датум на издавање: "), dots(day)), F.concat(F.lit("Рок за плаќање: "), dots(due)),
            *net_rows(_european(third(net))), *footer),
        page(
            F.concat(F.lit("Customer "), cust_text, F.lit(" DOOEL Skopje")), "ФАКТУРА", "ул. Илинденска 7", vat,
            F.concat(F.lit("број: 25-"), number), "Датум:", dots(day), "Опис на работата", "Вкупно за плаќање",
            _european(total), *footer),
        page(
            F.concat(F.lit("Customer "), cust_text, F.lit(" Ltd")), F.concat(F.lit("Invoice: EXP/"), number),
            F.concat(F.lit("Date: "), slashes(day)), F.concat(F.lit("Due date: "), slashes(due)),
            F.concat(F.lit("Subtotal: "), F.format_number(from_cents(net), 2)),
            F.concat(F.lit("VAT 18% "), F.format_number(from_cents(tax), 2)),
            F.concat(F.lit("Total: "), F.format_number(from_cents(total), 2))),
        page(
            F.concat(F.lit("Занаетчија "), cust_text, F.lit(" Битола")), F.concat(F.lit("Фактура 25-"), number),
            "За извршена работа", _european(total), "Рок до 30 дена", "Со зборови: според износот",
            F.concat(F.lit("Скопје, "), dots(day), F.lit("г."))),
        page(
            F.concat(F.lit("Customer "), cust_text, F.lit(" DOOEL Skopje")), vat,
            F.concat(F.lit("Испратница: ИС-"), number), F.concat(F.lit("Валута: "), dots(day)),
            *net_rows(third(net).cast("string")), *footer),
        page(
            F.concat(F.lit("Добавувач: Трговија "), cust_text, F.lit(" ДООЕЛ")),
            F.concat(F.lit("Број на фактура: "), number, F.lit("/"), F.date_format(day, "yyyy")),
            F.concat(F.lit("Датум на фактура: "), F.date_format(day, "dd.MM,yy")),
            *rows(total, _european(third(total))), F.concat(F.lit("Вкупно со ДДВ "), _european(total)),
            F.concat(F.lit("ДДВ+ "), _european(tax)), *footer),
    ]
    printed = F.coalesce(*[F.when(F.col("layout") == i, page) for i, page in enumerate(layouts)])
    return computed(facts.withColumn("lines", printed).select(
        "doc_id", "lines", F.array_join("lines", "\n").alias("full_text"), "layout"))


# What the rendered documents say, as facts.
RENDERED = """doc AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 6 AS layout, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day,
    CAST(round(o_totalprice * 100) AS BIGINT) AS net_c,
    (CAST(round(o_totalprice * 100) AS BIGINT) * 18 + 50) // 100 AS tax_c,
    CAST(round(o_totalprice * 100) AS BIGINT) + (CAST(round(o_totalprice * 100) AS BIGINT) * 18 + 50) // 100 AS total_c
  FROM orders)"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each customer; two in three are found by tax number, the others state none."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    no_map = F.create_map().cast("map<string,string>")
    return c.select(
        key.cast("int").alias("template_order"), F.concat(F.lit("t"), key).alias("id"),
        F.concat(F.lit("Template "), key).alias("display_name"),
        F.when(key % 3 != 2, F.concat(F.lit("MK "), F.lpad(key.cast("string"), 13, "0"))).otherwise("").alias("vat_number"),
        F.lit("MKD").alias("currency"), F.lit("user_saved").alias("source"),
        F.array().cast("array<string>").alias("keywords"),
        F.when(key % 2 == 0, F.create_map(
            F.lit("invoice_number"), F.lit(r"(?:број: |INV-|ИС-)((?:25-)?\d+)"), F.lit("total"), F.lit(r"плаќање\s+([\d.,]+)")
        )).otherwise(no_map).alias("patterns"),
        F.when(key % 5 == 0, F.create_map(F.lit("total"), F.lit("За наплата:"))).otherwise(no_map).alias("keyword_hints"),
        F.when(key % 4 == 0, F.create_map(F.lit("vendor_name"), F.concat(F.lit("Vendor "), key), F.lit("komitent_sifra"), key.cast("string")))
        .otherwise(no_map).alias("defaults"))


def keyword_templates(spark: SparkSession) -> DataFrame:
    from knigovod.schemas import TEMPLATES

    rows = [
        (0, "k0", "Both words", "", "MKD", None, ["Занаетчија", "Со зборови :"], {}, {}, {}),
        (1, "k1", "Look-alikes", "", "MKD", None, ["Exp/", "DUE DATE"], {}, {}, {}),
        (2, "k2", "Latin letters", "", "MKD", None, ["Xaртија A4"], {}, {}, {}),
        (3, "k3", "No keywords", "", "MKD", None, [], {}, {}, {}),
        (4, "k4", "Fallback", "", "MKD", None, ["плаќање"], {}, {}, {}),
    ]
    return spark.createDataFrame(rows, TEMPLATES)


# --- Events -----------------------------------------------------------------------------------------------


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review actions on invoices (the users)."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").when(
        F.col("event_type") == "signup", "export")
    return e.select(F.col("user_id").alias("invoice_id"), action.alias("action"), F.col("event_id").alias("seq")).filter(
        F.col("action").isNotNull())


def acted_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    return ids.select(
        F.col("user_id").alias("invoice_id"),
        F.element_at(F.array(F.lit("Pending"), F.lit("Approved"), F.lit("Exported")), (F.col("user_id") % 3 + 1).cast("int")).alias("status"),
        (F.col("user_id") % 4 == 0).alias("blocked"))


def session_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in upload sessions of their month, with a progress status."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("session_id"), F.col("o_orderkey").alias("invoice_id"),
        F.when(F.col("o_orderkey") % 29 == 0, "error").when(
            (F.col("o_orderkey") % 31 == 0) & (F.month("o_orderdate") < 7), "analyzing").otherwise("done").alias("status"))


SESSION_ITEMS = """items AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS session_id, o_orderkey AS invoice_id,
    CASE WHEN o_orderkey % 29 = 0 THEN 'error' WHEN o_orderkey % 31 = 0 AND month(o_orderdate) < 7 THEN 'analyzing'
         ELSE 'done' END AS status
  FROM orders)"""
