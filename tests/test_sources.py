"""Tables on their way in and out: commits, versions, malformed input, keyed state."""

import os
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knigovod.fixed_values import LEDGER_COLUMNS
from knigovod.operators.stages import left_join_dealt
from knigovod.sources import ledger_files as files
from knigovod.sources import readers, versions
from knigovod.streaming import jobs, keyed


def ledger(spark, n, parts=3):
    """Rows of n invoices, two each."""
    rows = spark.range(n).select(
        F.col("id").alias("invoice_id"), F.lit(None).cast("date").alias("invoice_date"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line_key"),
        *[F.concat(F.lit(f'{c}, "'), "id").alias(c) for c in LEDGER_COLUMNS])
    return rows.repartition(parts)


def everything(path):
    return sorted(name for _, folders, names in os.walk(path) for name in [*folders, *names]) if os.path.exists(path) else []


def test_files_of_invoices(spark, tmp_path):
    names = spark.range(6).select(F.col("id").alias("invoice_id"), F.concat(F.lit("f"), F.least("id", F.lit(3))).alias("file"))
    files.write_ledger_files(files.per_invoice(ledger(spark, 6), names), str(tmp_path), "one")
    assert sorted(os.listdir(tmp_path)) == ["one"]
    assert sorted(os.listdir(tmp_path / "one")) == ["f0.csv", "f1.csv", "f2.csv", "f3_3.csv", "f3_4.csv", "f3_5.csv"]
    back = spark.read.csv(str(tmp_path / "one"), header=True, escape='"')
    assert back.columns == list(LEDGER_COLUMNS) and back.count() == 12
    assert {r.KONTO for r in back.collect()} == {f'KONTO, "{k}' for k in range(6)}


def test_a_file_of_several_tasks_is_cut_in_order(spark, tmp_path):
    files.write_ledger_files(ledger(spark, 3000, 4).withColumn("file", F.lit("batch")), str(tmp_path), "all")
    parts = sorted(os.listdir(tmp_path / "all"), key=lambda n: int("".join(c for c in n if c.isdigit()) or 0))
    seen = []
    for part in parts:
        seen += [int(r.KONTO.split('"')[-1]) for r in spark.read.csv(str(tmp_path / "all" / part), header=True, escape='"').collect()]
    assert seen == [k for k in range(3000) for _ in range(2)]


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    broken = ledger(spark, 50).withColumn("file", F.concat(F.lit("f"), "invoice_id")).withColumn(
        "KONTO", F.when(F.col("invoice_id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("KONTO")))
    with pytest.raises(Exception, match="lost"):
        files.write_ledger_files(broken, str(tmp_path), "x")
    assert everything(tmp_path) == []
    with pytest.raises(Exception, match="no rows"):
        files.write_ledger_files(ledger(spark, 5).withColumn("file", F.lit("f")).filter("invoice_id < 0"), str(tmp_path), "x")
    assert everything(tmp_path) == []


def test_an_export_is_not_written_twice_unless_asked(spark, tmp_path):
    rows = ledger(spark, 2).withColumn("file", F.lit("f"))
    files.write_ledger_files(rows, str(tmp_path), "x")
    with pytest.raises(Exception, match="there already"):
        files.write_ledger_files(rows.filter("invoice_id = 0"), str(tmp_path), "x")
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 4
    files.write_ledger_files(rows.filter("invoice_id = 0"), str(tmp_path), "x", overwrite=True)
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 2 and sorted(os.listdir(tmp_path)) == ["x"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.newest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.update(spark, path, lambda t: t)
    assert versions.publish(spark.range(1), path, None) == 0
    assert versions.publish(spark.range(2), path, 0) == 1
    before = everything(path)
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(9), path, 0)
    assert everything(path) == before and versions.read(spark, path, 1).count() == 2
    calls = []

    def add(rows):
        def change(known):
            calls.append(rows)
            if len(calls) == 1:
                versions.update(spark, path, add(200), tag="other")
            return known.union(spark.range(rows, rows + 1))
        return change

    assert versions.update(spark, path, add(100), tag="mine") == 3 and calls == [100, 200, 100]
    assert sorted(r.id for r in versions.read(spark, path, 3).collect()) == [0, 1, 100, 200]
    assert versions.update(spark, path, add(300), tag="mine") == 3 and len(calls) == 3
    assert versions.drop_old(spark, path, 2) == [0, 1] and versions.versions(spark, path) == [2, 3]
    assert versions.read(spark, path, 2).count() == 3 and len(os.listdir(tmp_path / "t" / "data")) >= 2


def test_malformed_lines_keep_their_reason(spark, tmp_path):
    given = ['{"doc_id": "a", "n": 1}', '{"doc_id": "b", "n": "x"}', '{"doc_id": "c", "n"', "", "   ", '{"n": 2}', '{"doc_id": " "}', "null", "[]",
             '{"doc_id": "a", "n": 1}', "plain"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(given))
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n", T.IntegerType())])
    good, refused = readers.usable_and_refused(readers.parsed_json(readers.landing_lines(spark, str(tmp_path / "in")), schema, "doc_id"))
    assert [tuple(r) for r in good.collect()] == [("a", 1), ("a", 1)] and good.columns == ["doc_id", "n"]
    told = {r.record: r.reason for r in refused.collect()}
    assert set(told) == {g for g in given if g.strip()} - {'{"doc_id": "a", "n": 1}'}
    assert told['{"n": 2}'] == told['{"doc_id": " "}'] == "no doc_id" and told["plain"] == told['{"doc_id": "c", "n"'] == "malformed"
    assert all(r.file.endswith("x.json") for r in refused.collect())


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.createDataFrame([(1, "a", {"x": 1}), (2, None, {}), (3, None, None), (4, "=a", {}), (5, "b", {})], "id int, k string, m map<string,int>")
    found = left_join_dealt(rows, spark.createDataFrame([("a", 10), (None, 20), ("no key 1", 30)], "k string, v int"), "k")
    assert found.columns == ["id", "k", "m", "v"]
    assert sorted((r.id, r.k, r.v) for r in found.collect()) == [(1, "a", 10), (2, None, None), (3, None, None), (4, "=a", None), (5, "b", None)]


@pytest.mark.parametrize("status", ["Pending", "Approved", "Exported", "Rejected"])
def test_status_rule_agrees_with_the_columns(spark, status):
    from itertools import product

    from knigovod.operators.workflow import final_status

    marks = [m for m in product([None, 1, 2, 3], repeat=3) if len({x for x in m if x}) == sum(x is not None for x in m)]
    cases = [(status, blocked, *m) for blocked in (False, True) for m in marks]
    table = spark.createDataFrame(cases, "status string, blocked boolean, a long, r long, e long")
    got = table.select("*", final_status(F.col("status"), F.col("blocked"), F.col("a"), F.col("r"), F.col("e")).alias("s")).collect()
    assert all(r.s == keyed.status_after(*tuple(r)[:5]) for r in got)


def test_keyed_status_late_early_and_dropped(spark, tmp_path):
    schema = "invoice_id long, action string, seq long, event_ts timestamp"
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    waves = [
        [(1, "approve", 5, day(0)), (2, "reject", 6, day(0)), (3, "approve", 7, day(0)), (9, "approve", 1, day(0))],
        [(1, "reject", 2, day(0)), (2, "approve", 9, day(1)), (3, "export", 8, day(1))],   # 1: an earlier action arrives late
        [(4, "reject", 20, day(100))],                                                      # the watermark passes all timers
        [(4, "approve", 21, day(101))],
        [(2, "reject", 22, day(3)), (4, "export", 23, day(101))],                           # 2: later than the delay, left out
    ]
    for k, wave in enumerate(waves):
        spark.createDataFrame(wave, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"w{k}"))
        for name in os.listdir(tmp_path / "in" / f"w{k}"):
            if name.endswith(".parquet"):
                (tmp_path / "flat").mkdir(exist_ok=True)
                target = tmp_path / "flat" / f"{k}.parquet"
                target.write_bytes((tmp_path / "in" / f"w{k}" / name).read_bytes())
                os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    invoices = spark.createDataFrame([(1, "Pending", False), (2, "Pending", False), (3, "Pending", True), (4, "Pending", None)],
                                     "invoice_id long, status string, blocked boolean")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STATE_STORE)
    try:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
        query = (
            keyed.status_keyed(events, invoices, "1 day", timedelta(days=30)).writeStream.outputMode("update")
            .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={e}")))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out"))
    last = {r.invoice_id: r.s for r in out.groupBy("invoice_id").agg(F.max_by("status", "epoch").alias("s")).collect()}
    assert last == {1: "Approved", 2: "Approved", 3: "Pending", 4: "Exported"}
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) >= 3 and held[-1] < max(held)
