"""Whole jobs, in batch and as streams, and the registered queries."""

import datetime as dt
import os
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check import TABLES, rows
from knigovod.operators import journal as jn
from knigovod.operators import workflow as wf
from knigovod.operators.lines import from_text
from knigovod.operators.registry import with_match_form
from knigovod.plans.process import decorated, post, process_documents
from knigovod.schemas import TEMPLATES
from knigovod.sources import readers, sinks
from knigovod.streaming import jobs

SMOKE = "/root/testdata/sf0.001"
TEXT = ("Пример Сервис ДООЕЛ\nФактура број: INV-2024-{0}\nДатум: 15.03.2024\n1. Интернет услуга 1.000,00\n2. Телефон 500,00\n"
        "За наплата: 1.500,00 ден")


def registry(spark):
    return with_match_form(spark.createDataFrame([(0, "7", "Primer Servis")], "reg_order long, id string, name string"))


def documents(spark, n=3):
    return spark.createDataFrame([(f"d{i}", TEXT.format(i)) for i in range(n)], "doc_id string, full_text string")


def test_document_to_ledger(spark, tmp_path):
    records = process_documents(from_text(documents(spark)), spark.createDataFrame([], TEMPLATES), registry(spark))
    day = F.lit("2024-03-20").cast("date")
    invoices, entries = post(records, day)
    entries = entries.persist()
    got = entries.filter("invoice_id = 'd1'").orderBy(F.col("line_key").asc_nulls_last()).collect()
    assert [(e.konto, e.opis, float(e.debit), float(e.credit)) for e in got] == [
        ("4111", "1. Интернет услуга", 1000.0, 0.0), ("4111", "2. Телефон", 500.0, 0.0),
        ("2200", "Обврска спрема добавувач", 0.0, 1500.0)]
    assert all(r.balanced for r in jn.journal_totals(entries).collect())
    ledger = jn.ledger_rows(entries, invoices, day)
    sinks.write_ledger(ledger, str(tmp_path / "ledger"), "b1")
    back = spark.read.csv(str(tmp_path / "ledger"), header=True)
    assert back.count() == 9 and back.select("SIFRA KOMITENT").distinct().head()[0] == "7"
    assert back.select("DATUM KNIZENJE").distinct().head()[0] == "15.03.2024"


def test_invoices_from_elsewhere_get_a_journal(spark):
    records = process_documents(from_text(documents(spark)), spark.createDataFrame([], TEMPLATES), registry(spark))
    day = F.lit("2024-03-20").cast("date")
    invoices, entries = post(records, day)
    brought = entries.filter("invoice_id = 'd0' AND konto = '2200'")
    shown, whole = decorated(invoices, brought, day)
    assert shown.count() == 3 and {(r.invoice_id, r.n) for r in whole.groupBy("invoice_id").agg(F.count("*").alias("n")).collect()} == {
        ("d0", 1), ("d1", 3), ("d2", 3)}


def test_readers(spark, tmp_path):
    (tmp_path / "reg.csv").write_text("reg_order,id,name\n0,12.0, Пример АД \n1,,x\n2,A7,Друг\n")
    assert [(r.id, r.name) for r in readers.read_registry(spark, str(tmp_path / "reg.csv")).orderBy("reg_order").collect()] == [
        ("12", "Пример АД"), ("A7", "Друг")]
    (tmp_path / "t.json").write_text('[{"id": "a", "display_name": "A", "patterns": {"total": null}}, {"display_name": "no id"}]')
    assert [r.id for r in readers.read_templates(spark, str(tmp_path / "t.json")).collect()] == ["a"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.txt").write_text("a\nb")
    assert readers.read_documents(spark, str(tmp_path / "docs"), "text").head().full_text == "a\nb"
    assert os.path.basename(readers.list_files(spark, str(tmp_path / "docs")).head().path) == "x.txt"


def test_sessions_match_a_walk(spark):
    base = dt.datetime(2024, 1, 1)
    seconds = [0, 100, 1900, 1901, 3700, 3701, 3702, 5501, 7302, 7303, 9999999]
    df = spark.createDataFrame([(1, base + dt.timedelta(seconds=s)) for s in seconds], "user_id int, received_ts timestamp")
    wanted, last = [], None
    for s in seconds:
        if last is None or s - last > 1800:
            wanted.append(0)
        wanted[-1] += 1
        last = s
    got = [r.n for r in wf.sessions(df, 1800).orderBy("started").collect()]
    assert got == wanted


def test_process_stream(spark, tmp_path):
    documents(spark, 4).write.parquet(str(tmp_path / "in"))
    stream = from_text(spark.readStream.schema("doc_id string, full_text string").parquet(str(tmp_path / "in")))
    query = jobs.process_stream(
        stream, spark.createDataFrame([], TEMPLATES), registry(spark), str(tmp_path / "out"), job=f"p-{uuid.uuid4().hex}")
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "records"))
    assert got.count() == 4 and {r.komitent_id for r in got.collect()} == {"7"}
    assert spark.read.parquet(str(tmp_path / "out" / "failed")).count() == 0


def test_learn_stream(spark, tmp_path):
    schema = "corr_id long, embedding array<float>, konto string, komitent_id string, preview string"
    spark.createDataFrame([(1, [1.0, 0.0], "4111", None, "")], schema).write.parquet(str(tmp_path / "versions" / "version=0"))
    spark.createDataFrame([(5, [1.0, 0.0], "4112", None, ""), (6, [0.0, 1.0], "4030", None, "")], schema).write.parquet(str(tmp_path / "in"))
    query = jobs.learn_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "versions"),
                              job=f"l-{uuid.uuid4().hex}")
    query.awaitTermination()
    assert {(r.corr_id, r.konto) for r in spark.read.parquet(str(tmp_path / "versions" / "version=1")).collect()} == {(1, "4112"), (6, "4030")}


def test_suggest_stream_reads_the_newest_version(spark, tmp_path):
    from knigovod.operators.accounts import konto_rules

    schema = "corr_id long, embedding array<float>, konto string, komitent_id string, preview string"
    for version, konto in ((0, "4111"), (1, "4150"), (10, "4170")):
        spark.createDataFrame([(1, [1.0, 0.0], konto, None, "")], schema).write.parquet(str(tmp_path / "versions" / f"version={version}"))
    asked = "query_id string, embedding array<float>, text string"
    spark.createDataFrame([("a", [1.0, 0.0], ""), ("b", [0.0, 1.0], "интернет"), ("c", [-1.0, 0.0], "")], asked).write.parquet(str(tmp_path / "in"))
    accounts = spark.createDataFrame([(1, "4030", [0.6, 0.8])], "acct_order long, code string, embedding array<float>")
    jobs.suggest_stream(spark.readStream.schema(asked).parquet(str(tmp_path / "in")), str(tmp_path / "versions"), accounts,
                        konto_rules(spark), str(tmp_path / "out"), job=f"s-{uuid.uuid4().hex}").awaitTermination()
    got = {r.query_id: (r.konto, r.method, r.confidence) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("4170", "learned_correction", 1.0), "b": ("4030", "embedding_match", 0.8), "c": ("4499", "keyword", 0.0)}


def test_whole_job_takes_corrections_screened_templates_and_decomposed_letters(spark):
    import unicodedata

    given = documents(spark, 3).withColumn("embedding", F.when(F.col("doc_id") == "d0", F.array(F.lit(1.0), F.lit(0.0))).when(
        F.col("doc_id") == "d1", F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    text = given.withColumn("full_text", F.concat("full_text", F.lit(unicodedata.normalize("NFD", "\nЃорѓи"))))
    corrections = spark.createDataFrame([(1, [1.0, 0.0], "4450")], "corr_id long, embedding array<float>, konto string")
    accounts = spark.createDataFrame([(1, "4030", [0.6, 0.8]), (2, "1000", [0.0, 1.0])], "acct_order long, code string, embedding array<float>")
    broken = spark.createDataFrame([{"id": "t", "display_name": "T", "template_order": 0, "vat_number": "", "keywords": ["Пример"],
                                     "patterns": {"invoice_number": "(INV-[\\d-]+", "vendor_name": "(?P<v>Пример)"}}], TEMPLATES)
    records = process_documents(from_text(text), broken, registry(spark), corrections=corrections, accounts=accounts)
    got = {r.doc_id: r for r in records.collect()}
    assert {k: (r.konto, r.konto_method, r.konto_confidence) for k, r in got.items()} == {
        "d0": ("4450", "learned_correction", 1.0), "d1": ("4030", "embedding_match", 0.8), "d2": ("4111", "keyword", 0.0)}
    assert {r.invoice_number for r in got.values()} == {"INV-2024-0", "INV-2024-1", "INV-2024-2"}
    assert all(r.full_text.endswith("Ѓорѓи") and r.template_id == "t" for r in got.values())


def test_entry(spark):
    assert entry_points.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", ["total_check", "journal_entries", "ledger_rows", "payment_run", "extract_record", "status_fold", "sections"])
def test_registered(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE}/{table}.parquet'")
    result = entry_points.queries()[name](spark, SMOKE)
    cursor = db.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert rows([tuple(r) for r in result.collect()], result.columns) == rows(cursor.fetchall(), names)


def test_many_line_rules_post_the_same_journal(spark):
    """Beyond the rules that fold into an expression, accounts come from a join; both ways agree, also on ties and nulls."""
    from knigovod.config import MAX_INLINE_ROWS
    from knigovod.operators.accounts import suggest_by_rules

    texts = spark.createDataFrame([(1, "red box"), (2, "blue box"), (3, "none"), (4, "")], "text_id int, text string")
    schema = "rule_order int, konto string, label string, keyword string"
    few = [(1, "9", "x", "box"), (1, "1", "y", "red"), (1, "2", "z", None), (0, "5", "w", "blue")]
    many = few + [(10 + k, "7", "f", f"filler{k}") for k in range(MAX_INLINE_ROWS)]
    short, long = (suggest_by_rules(texts, spark.createDataFrame(r, schema)).select("text_id", "rule_konto").collect() for r in (few, many))
    assert dict(short) == dict(long) == {1: "1", 2: "5", 3: None, 4: None}


def test_template_table_round_trip(spark, tmp_path):
    from knigovod.sources import readers, sinks

    rows = spark.createDataFrame([(str(k), f"v{k}") for k in range(5)], "id string, display_name string").repartition(3)
    sinks.write_templates(rows, str(tmp_path / "t"))
    back = readers.read_templates(spark, str(tmp_path / "t"))
    assert back.count() == 5 and sorted(r.template_order for r in back.collect()) == list(range(5))
    assert readers.read_templates(spark, str(tmp_path / "missing")).count() == 0


def test_a_template_field_sent_twice(spark):
    from knigovod import schemas
    from knigovod.operators.templates import screen_templates, set_defaults, upsert_templates

    one = {"id": "a", "display_name": "A", "template_order": 0, "patterns": {"total": "(?P<v>\\d+)", "vendor_name": "(x)?(?(1)a|b)"}}
    table = spark.createDataFrame([one], schemas.TEMPLATES)
    changes = spark.createDataFrame([("a", "vendor_name", "first"), ("a", "vendor_name", "second")], "id string, field string, value string").coalesce(1)
    changed, _ = set_defaults(table, changes)
    assert changed.first().defaults == {"vendor_name": "second"}
    sent = spark.createDataFrame([{"id": "b", "display_name": "one"}, {"id": "b", "display_name": "two"}], schemas.TEMPLATES).coalesce(1)
    assert [r.display_name for r in upsert_templates(table, sent).collect() if r.id == "b"] == ["two"]
    good, bad = screen_templates(table)
    assert good.first().patterns == {"total": "(?<v>\\d+)"} and [r.field for r in bad.collect()] == ["vendor_name"]
