"""What keeps the work in proportion to the input: repeated questions asked once, candidates few, blocks of bounded size."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from knigovod.operators import accounts as ac
from knigovod.operators import contains
from knigovod.operators import names as nm
from knigovod.operators import registry as rg


def test_equal_queries_are_searched_once(spark, monkeypatch):
    chart = spark.createDataFrame([(k, f"4{k:03d}", f"part {k % 7}") for k in range(60)], "acct_order long, code string, description string")
    queries = spark.createDataFrame([(i, ("Part 3", "01")[i % 2]) for i in range(100)] + [(5, "part 3")], "query_id long, query string")
    asked = []

    def counted(texts, needles, *more):
        asked.append(needles.count())
        return join(texts, needles, *more)

    join = contains.contains_join
    monkeypatch.setattr(contains, "contains_join", counted)
    monkeypatch.setattr(ac, "contains_join", counted)
    rows = ac.search_accounts(queries, chart, 4).collect()
    assert asked == [2]
    of = lambda i: [r.code for r in sorted(rows, key=lambda r: r.place) if r.query_id == i]
    assert of(0) == ["4003", "4010", "4017", "4024"] and of(1) == ["4001", "4010", "4011", "4012"]
    # A query id that stands for two queries has the first of both, as rows.
    assert of(5) == ["4001", "4003", "4010", "4010"]


def test_needles_beyond_an_automaton_take_one_pass(spark, monkeypatch):
    """However many the needles, the texts are read once, and nothing is found or lost by chance."""
    needles = ["мк%05d" % k for k in range(0, 3000, 3)] + ["a", "aa", "ж😀", "no such", "", "мк0000", "aa", None]
    texts = [f"x мк{k:05d} aaa мк0000" for k in range(200)] + ["", None, "ж😀ж😀a", "ж", "😀", "мк00003" * 3000]
    known = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle string")
    asked = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "text_id string, text string")
    wanted = sorted((f"t{i}", j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t and n and n in t)
    monkeypatch.setattr(contains, "MOST_BITS", 1 << 16)
    found = contains.contains_by_automaton(asked, known, letters=100)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.text_id, r.needle_id) for r in found.collect()) == wanted
    assert sorted((r.text_id, r.needle_id) for r in contains.contains_by_automaton(asked, known).collect()) == wanted


def test_a_sieve_reaches_the_driver_in_few_rows(spark, monkeypatch):
    """The words of a sieve are put together in the tasks, whatever their number."""
    monkeypatch.setattr(contains, "SIEVE_WORDS", 256)
    brought, collected = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: brought.append((df.columns, rows := collected(df))) or rows)
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: pytest.fail("words are brought to the driver"))
    needles = spark.createDataFrame([(f"мк{k:05d}",) for k in range(3000)], "needle string")
    sieve, n_bits, lengths = contains._sieve(needles)
    assert n_bits == 1 << 17 and lengths == [7] and [len(rows) for columns, rows in brought if "bits" in columns] == [n_bits // 64 // 256]
    held = contains._sifted(sieve, n_bits, lengths)
    texts = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(["xмк01234мк02999", "мк03"])], ["text_id", "text"])
    found = [r for b in held([texts]) for r in b.to_pylist()]
    assert {(r["text_id"], r["needle"]) for r in found} >= {(0, "мк01234"), (0, "мк02999")}


def _forms(n):
    """Names that share their first word and differ in a number."""
    return [f"household n{k % 7} vendor{k * 7919 % 100000:05d}" for k in range(n)]


def _dice(a, b):
    grams = lambda t: {t[i:i + 3] for i in range(len(t) - 2)}
    return round(200.0 * len(grams(a) & grams(b)) / max(len(grams(a)) + len(grams(b)), 1) + 1e-9, 1)


@pytest.mark.parametrize("floor", [95.0, 85.0, 60.0, 45.0])
@pytest.mark.parametrize("most_bytes", [0, 1 << 26])
def test_similar_names_of_all_sizes(spark, monkeypatch, floor, most_bytes):
    monkeypatch.setattr(rg, "MAX_BROADCAST_BYTES", most_bytes)
    known = [f" {f} " for f in _forms(40)] + [" vendor12345 ", " ab ", " solo00012 ", "  "]
    asked = [f.replace("vendor", "vndor") for f in known[:25]] + [" vendor07919 ", " solo00013 ", " abc ", "  "]
    names = spark.createDataFrame([(f"n{k}", f) for k, f in enumerate(asked)], "name_id string, form string")
    entries = spark.createDataFrame(list(enumerate(known)), "reg_order long, form string")
    left, right = rg.TRIGRAMS.prepared(names, entries)
    assert "bits" in left.columns
    got = {(r.name_id, r.reg_order): r.score for r in rg.similar_names(left, right, floor).collect()}
    assert got == {(f"n{i}", j): x for i, a in enumerate(asked) for j, b in enumerate(known) if (x := _dice(a, b)) >= floor}


def test_entries_beyond_the_checked_size_stay_off_the_driver(spark, monkeypatch):
    """Staged in a few kilobytes, the entries look small to the planner, which would broadcast what is cut from them."""
    monkeypatch.setattr(rg, "MAX_BROADCAST_BYTES", 0)
    known = _forms(40)
    names = spark.createDataFrame([(f"n{k}", f) for k, f in enumerate(known)], "name_id string, form string")
    left, right = rg.TRIGRAMS.prepared(names, spark.createDataFrame(list(enumerate(known)), "reg_order long, form string"))
    plan = rg.similar_names(left, right, 60.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_many_names_and_entries_meet_as_numbers(spark, monkeypatch):
    """Beyond the checked size pairs are ruled out by their bits in blocks, not row by row in a join; common trigrams are split,
    and no number of pairs is held at once."""
    known = [f" {f} " for f in _forms(60)]
    asked = [f.replace("vendor", "vndor") for f in known]
    names = spark.createDataFrame([(f"n{k}", f) for k, f in enumerate(asked)], "name_id string, form string")
    entries = spark.createDataFrame(list(enumerate(known)), "reg_order int, form string")
    left, right = rg.TRIGRAMS.prepared(names, entries)
    monkeypatch.setattr(rg, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(rg, "SALT_EVERY", 7)
    monkeypatch.setattr(rg, "MET_PAIRS", 5)
    found = rg.similar_names(left, right, 70.0)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and found.schema["reg_order"].dataType.simpleString() == "int"
    got = [((r.name_id, r.reg_order), r.score) for r in found.collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == {(f"n{i}", j): x for i, a in enumerate(asked) for j, b in enumerate(known) if (x := _dice(a, b)) >= 70}


def test_few_names_go_to_every_task(spark, monkeypatch):
    """Few names left over do not have a large registry cut up and shuffled."""
    known = [f" {f} " for f in _forms(60)]
    names = spark.createDataFrame([("n0", known[0].replace("vendor", "vndor"))], "name_id string, form string")
    entries = spark.createDataFrame(list(enumerate(known)), "reg_order long, form string")
    left, right = rg.TRIGRAMS.prepared(names, entries)
    monkeypatch.setattr(rg, "MAX_BROADCAST_BYTES", 30_000)
    found = rg.similar_names(left, right, 70.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" in plan and "SortMergeJoin" not in plan and "MapInArrow" not in plan
    assert {r.reg_order: r.score for r in found.collect()} == {
        j: x for j, b in enumerate(known) if (x := _dice(known[0].replace("vendor", "vndor"), b)) >= 70}


def test_edits_meet_at_rare_trigrams(spark):
    """Names that share their first word with all entries are compared with few of them."""
    known = _forms(200)
    names = spark.createDataFrame([(f"n{k}", f.replace("vendor", "vndor")) for k, f in enumerate(known)], "name_id string, form string")
    entries = spark.createDataFrame(list(enumerate(known)), "reg_order int, form string")
    left, right = nm.EditsAndWords().prepared(names, entries)
    met = nm._gram_pairs(left, right, 95.0).select("name_id", "reg_order").distinct()
    assert nm._places(left, 95.0).count() == 0
    assert 200 <= met.count() < 200 * 200 / 10


def test_rows_cut_for_edits_and_words_stay_off_the_driver(spark, monkeypatch):
    """Staged in a few kilobytes, both sides look small to the planner, which would broadcast what is cut from them."""
    monkeypatch.setattr(nm, "FEW_ENTRIES", 39, raising=False)
    known = _forms(40)
    names = spark.createDataFrame([(f"n{k}", f) for k, f in enumerate(known)], "name_id string, form string")
    left, right = nm.EditsAndWords().prepared(names, spark.createDataFrame(list(enumerate(known)), "reg_order long, form string"))
    for pairs in (nm.edit_pairs, nm.word_pairs):
        assert "BroadcastHashJoin" not in pairs(left, right, 80.0)._jdf.queryExecution().executedPlan().toString()


def test_trigrams_of_a_long_name(spark):
    """A name as long as a text takes time in proportion to its length."""
    form = "".join(chr(97 + k * k % 23) + "ж😀"[k % 2] for k in range(100_000))
    known = spark.createDataFrame([(form,), ("ab",), ("",), ("a😀ж",)], "form string").repartition(1)
    started = time.time()
    got = [set(r[0]) for r in known.select(rg.gram_codes(F.col("form"))).collect()]
    assert time.time() - started < 20
    code = lambda t: (ord(t[0]) << 42) + (ord(t[1]) << 21) + ord(t[2])
    assert sorted(got, key=len) == [set(), set(), {code("a😀ж")}, {code(form[i:i + 3]) for i in range(len(form) - 2)}]


def test_distinct_vectors_are_compared_once(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(size=(30, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    listed = [v.astype(np.float32).tolist() for v in vectors]
    items = spark.createDataFrame([(k, listed[k % 30]) for k in range(300)][::-1], "item_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(f"q{k}", listed[k % 30]) for k in range(90)], "query_id string, embedding array<float>")
    got = {x.query_id: x.item_id for x in ac.nearest(queries, items, 0.99, max_bytes=8 * 8 * 7).collect()}
    assert got == {f"q{k}": k % 30 for k in range(90)}


def test_visits_leave_in_bounded_pieces():
    """A query that may visit every pivot is not copied for a whole batch at once."""
    vectors = np.random.default_rng(4).normal(size=(1000, 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    batch = pd.DataFrame({"query_id": np.arange(1000), "embedding": list(vectors)})
    parts = list(ac._visits(batch, vectors[:50], np.full(50, 0.1), np.pi, 400))
    assert max(len(p) for p in parts) <= 400
    whole = pd.concat(parts)
    assert len(whole) == 1000 * 50 and whole.groupby("pivot").size().tolist() == [1000] * 50
