"""Scanned segments, sections and item rows."""

import random

from pyspark.sql import functions as F

from knigovod.operators import lines as ln
from knigovod.schemas import SEGMENTS


def walk(centres, tolerance=18.0):
    """Row of each centre, in the plain way."""
    rows, mean, row = [], None, -1
    for y in sorted(centres):
        if mean is not None and abs(y - mean) <= tolerance:
            mean = (mean + y) / 2
        else:
            row, mean = row + 1, y
        rows.append((y, row))
    return rows


def segments(spark, centres, page=1):
    rows = [("d", page, float(i), y - 5, y + 5, f"w{i}", 0.9) for i, y in enumerate(centres)]
    return spark.createDataFrame(rows, SEGMENTS)


def test_rows_of_the_running_mean(spark):
    got = ln.segment_rows(segments(spark, [10.0, 20.0, 30.0, 60.0])).select("y", "row_y").orderBy("y").collect()
    assert [r.row_y for r in got] == [10.0, 10.0, 10.0, 60.0]


def test_rows_match_the_plain_walk(spark):
    rng = random.Random(7)
    for _ in range(4):
        centres = [float(rng.choice(range(0, 400, 3))) for _ in range(150)]
        plain = {}
        for y, row in walk(centres):
            plain.setdefault(y, set()).add(row)
        got = ln.segment_rows(segments(spark, centres)).select("y", "row_y").distinct().collect()
        starts = sorted({r.row_y for r in got})
        # A height that the walk itself puts in two rows cannot occur: equal heights follow each other.
        assert {r.y: starts.index(r.row_y) for r in got} == {y: min(rows) for y, rows in plain.items()}


def test_hot_height_settles(spark):
    centres = [0.0] + [15.0] * 500 + [32.0, 34.0]
    got = {r.y: r.row_y for r in ln.segment_rows(segments(spark, centres)).select("y", "row_y").distinct().collect()}
    wanted = dict(walk(centres))
    assert (got[32.0] == 0.0) == (wanted[32.0] == 0) and (got[34.0] == got[32.0]) == (wanted[34.0] == wanted[32.0])


def test_lines_across_batches(spark):
    """Rows are put together in one walk: whatever the batches, equal heights, ties, and nulls."""
    rng = random.Random(11)
    rows = [(f"d{k % 3}", k % 2 + 1, rng.choice([None, *map(float, range(40))]), y, y, rng.choice(["a", "b", "", " c", None]), 0.9)
            for k in range(900) for y in [float(rng.choice(range(0, 2000, 7)))]]
    rows += [("d0", 1, 1.0, None, 2.0, "no height", 0.9), ("d0", None, 1.0, 2.0, 2.0, "no page", 0.9), (None, 1, 1.0, 2.0, 2.0, "no id", 0.9)]
    wanted = {}
    for page in {r[:2] for r in rows if None not in r[:2]}:
        on_page = [r for r in rows if r[:2] == page and r[3] is not None]
        placed = {}
        for y, row in walk([r[3] for r in on_page]):
            placed.setdefault(y, row)
        for row in set(placed.values()):
            parts = sorted((r for r in on_page if placed[r[3]] == row), key=lambda r: (r[2] is not None, r[2] or 0.0, r[3], r[5] or ""))
            line = " ".join(r[5] for r in parts if r[5] is not None).strip(" ")
            if line:
                wanted[(*page, min(r[3] for r in parts))] = line
    given = spark.createDataFrame(rows, "doc_id string, page int, x_left double, y_top double, y_bottom double, text string, conf double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = ln.segment_lines(given).collect()
            assert {(r.doc_id, r.page, r.row_y): r.line for r in got} == wanted and len(got) == len(wanted)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_one_shuffle_makes_lines(spark):
    """No aggregate, window or join over segments: they held more than an executor has."""
    plan = ln.segment_lines(segments(spark, [1.0, 2.0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(word in plan for word in ("Aggregate", "Window", "Join"))


def test_segment_text(spark):
    rows = [("d", 1, 50.0, 5.0, 15.0, "b", 0.9), ("d", 1, 10.0, 8.0, 18.0, "a", 0.9), ("d", 1, 90.0, 5.0, 15.0, "x", 0.25),
            ("d", 2, 1.0, 5.0, 15.0, "c", 0.9)]
    pages = ln.segment_pages(spark.createDataFrame(rows, SEGMENTS))
    merged = ln.merge_pages(pages).head()
    assert merged.lines == ["a b", "c"]
    assert merged.full_text == "--- Page 1 ---\na b\n\n--- Page 2 ---\nc"


def sections(spark, *lines):
    df = spark.createDataFrame([("d", list(lines))], "doc_id string, lines array<string>")
    return [r.section for r in ln.sectioned_lines(df).orderBy("line_no").collect()]


def test_sections(spark):
    assert sections(spark, "head", "1. Датум: 25.06.2024", "x", "1) Услуга 450,00", "2) Друго 50,00", "Вкупно 500,00", "Потпис") == [
        "header", "items", "items", "items", "items", "totals", "footer"]
    assert sections(spark, "1. Датум", "x", "2. Рок") == ["header"] * 3
    assert sections(spark, "1 Услуга 1,00") == ["header"]


def test_marks_are_idempotent(spark):
    df = spark.createDataFrame([("d", ["1. A 5,00", "2. B 6,00", "Основица 11,00"])], "doc_id string, lines array<string>")
    once = ln.mark_sections(df)
    assert once.head().lines == ["", "--- СТАВКИ ---", "", "1. A 5,00", "2. B 6,00", "", "--- ВКУПНО ---", "", "Основица 11,00"]
    assert ln.mark_sections(once).head().lines == once.head().lines


def test_item_rows(spark):
    cases = {"1. Услуга А 1.234,56": ("1. Услуга А", 1234.56), "$ Ставка 1 234,50": ("$ Ставка 1", 234.5), "само текст": None,
             "Ставка 12 ,50": ("Ставка 12", 50.0), "Ставка 12 .": ("Ставка", 12.0), "--- КРАЈ ---": None, "": None, "1,00": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", F.expr(ln.parse_item("l")).alias("i"))
    for row in df.collect():
        wanted = cases[row.l]
        assert (None if row.i is None else (row.i.description, float(row.i.amount))) == wanted, row.l


def test_empty_document(spark):
    df = spark.createDataFrame([("d", []), ("e", None)], "doc_id string, lines array<string>")
    assert all(r.table_at is None for r in ln.add_sections(df).collect())
