"""Fill-in-the-middle against a plain version, and back."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from knigovod.llm import fim

TEXTS = [None, "", "a", "plain words here", "été 日本 👩‍👩‍👧 zero\0width", "line\nbreaks\r\n\n", "has <P> a mark", "<S>", "x<M>", "<P", "a <", "P> b",
         "z" * 5000, "long " * 40000, "<<P<S<M", "\\d+ (a)* [x]", "é" * 77]
DOCS = "doc_id bigint, text string, n int, form string, output string, h1 string, t int"


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:low], text[low:high], text[high:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = [(k * 37 + j, t) for j in range(9) for k, t in enumerate(TEXTS)] + [(None, "no id"), (5, "twice"), (5, "twice"), (5, "other")]
    docs = spark.createDataFrame([(i, t, 1, "f", "o", "h", 2) for i, t in rows], DOCS).repartition(3)
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, bytes(r.output).decode()) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((plain(*x) for x in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    same = out.join(docs.select("doc_id", "text").distinct(), "doc_id").groupBy("doc_id", "back").agg(
        F.max((F.col("back") == F.coalesce("text", F.lit("")).cast("binary")).cast("int")).alias("found"))
    assert same.filter("found = 0").count() == 0
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_bytes_that_are_not_text(spark):
    raw = bytearray(b"ab\xff\xfe\xc3 cd" * 5)
    docs = spark.createDataFrame([(k, raw) for k in range(30)], "doc_id int, text binary")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {bytes(r.back) for r in out} == {bytes(raw)} and {r.n for r in out} == {40} and len({r.form for r in out}) > 1


def test_long_texts_take_several_matches(monkeypatch):
    text = "éx\r\n日" * 100
    for unit in (fim.CODE_POINT, r"\X", r"(?:\w|\s)\W?"):
        whole = regex.compile(f"({unit})*")
        once = list(fim.ends_of(text, whole, whole))
        for window in (1, 3, 7):
            monkeypatch.setattr(fim, "WINDOW", window)
            assert list(fim.ends_of(text, whole, regex.compile(f"({unit}){{0,{window}}}+"))) == once
        monkeypatch.undo()
    with pytest.raises(ValueError):
        fim.ends_of("ab1", regex.compile("([a-z])*"), regex.compile("([a-z]){0,9}+"))
