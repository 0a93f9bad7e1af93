"""Documents to text lines, and lines to sections and item rows.

A document is one row and its lines an array in that row, so everything here but the assembly of
scanned segments is a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knigovod.config import DEFAULT, Settings
from knigovod.fixed_values import (
    COMMA_AMOUNT, FIRST_ROW, FOOTER_MARK, FOOTER_START, IMAGE_SUFFIXES, ITEMS_MARK, SECOND_ROW,
    TEXT_LAYER_SUFFIXES, TOTALS_MARK, TOTALS_START)
from knigovod.functions import amounts, sql
from knigovod.functions.text import compose_unicode
from knigovod.functions.sql import all_of, coalesce, let, matches, strip, when
from knigovod.operators.stages import computed

# --- Files and pages -----------------------------------------------------------------------------------


def route_files(files: DataFrame) -> DataFrame:
    """How each file (path) is read: text layer first, image, or an error for other types."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("suffix", suffix).withColumns({
        "route": F.when(F.col("suffix").isin(TEXT_LAYER_SUFFIXES), "text_layer")
        .when(F.col("suffix").isin(IMAGE_SUFFIXES), "image"),
        "error": F.when(~F.col("suffix").isin(TEXT_LAYER_SUFFIXES + IMAGE_SUFFIXES), F.concat(
            F.lit("Unsupported file type: "), F.col("suffix"),
            F.lit(". Supported: PDF, PNG, JPG, JPEG, TIFF, BMP"))),
    })


def text_layer(documents: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Pages without blank lines, and whether their text suffices to go without a scan."""
    kept = F.transform("pages", lambda p: amounts.let(
        F.filter(F.split(p["text"], r"\r\n|\r|\n"), lambda l: F.trim(l) != ""),
        lambda lines: F.struct(
            p["page"].alias("page"), F.array_join(lines, "\n").alias("text"), lines.alias("lines"))))
    chars = F.aggregate("pages", F.lit(0), lambda n, p: n + F.length(F.trim(p["text"])))
    return documents.withColumn("pages", kept).withColumn("n_chars", chars).withColumn(
        "extraction_method", F.when(F.col("n_chars") >= settings.min_text_layer_chars, "pdf_text_layer"))


def merge_pages(documents: DataFrame) -> DataFrame:
    """Adds full_text, lines and page_count: pages joined by a blank line, with a header each where
    there are several."""
    several = F.size("pages") > 1
    texts = F.transform("pages", lambda p: F.when(
        several, F.concat(F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])).otherwise(p["text"]))
    return documents.withColumns({
        "full_text": F.array_join(texts, "\n\n"),
        "lines": F.flatten(F.transform("pages", lambda p: p["lines"])),
        "page_count": F.size("pages"),
    })


def from_text(documents: DataFrame) -> DataFrame:
    """Documents given as plain full_text; its letters are composed."""
    return compose_unicode(documents, "full_text").withColumn("lines", F.split("full_text", r"\r\n|\r|\n"))


def explode_lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode("lines").alias("line_no", "line"))


# --- Scanned segments ----------------------------------------------------------------------------------

# Halving a distance this often leaves nothing of it in a double.
_SETTLED = 64


def _ordered(segments: DataFrame, settings: Settings) -> DataFrame:
    """Confident segments with their centre y, page by page and downwards: one shuffle and one sort. Segments without a
    page or a height are on no row."""
    kept = segments.filter(F.col("conf") > settings.min_segment_confidence).withColumn("y", (F.col("y_top") + F.col("y_bottom")) / 2)
    return (
        kept.select("doc_id", "page", "y", *[c for c in kept.columns if c not in ("doc_id", "page", "y")])
        .dropna(subset=["doc_id", "page", "y"]).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y")
    )


def _walked(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """(batch, row_y, indexes that begin a row) of ordered segments. What is held is the running mean, not a page."""
    page = last = mean = row = None
    times = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n, keys = batch.num_rows, [batch.column(0), batch.column(1)]
        turns = [page != [k[0].as_py() for k in keys]] + pc.or_(*[pc.not_equal(k.slice(1), k.slice(0, n - 1)) for k in keys]).to_pylist()
        page = [k[n - 1].as_py() for k in keys]
        rows, begins = [], []
        for i, y in enumerate(batch.column(2).to_pylist()):
            if turns[i] or (y != last and (y == y or last == last)):
                last = y
                if turns[i] or not abs(y - mean) <= tolerance:
                    # A mean that is its first height stays there at every repetition.
                    mean, row, times = y, y + 0.0, _SETTLED
                    begins.append(i)
                else:
                    mean, times = (mean + y) / 2, 1
            elif times < _SETTLED:
                mean, times = (mean + y) / 2, times + 1
            rows.append(row)
        yield batch, rows, begins


def segment_rows(segments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds row_y, the height a visual row begins at, to the confident segments of each page. A segment
    joins the current row when its vertical centre is within the tolerance of the row's running mean.

    The mean depends on the order of centres only, so each page is sorted by them and walked once, batch by batch. Equal
    heights are one step of the walk: whether they open a row is asked once, and a repeated height is applied until the
    mean has settled."""
    tolerance = settings.row_tolerance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _ in _walked(batches, tolerance):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.float64())], [*batch.schema.names, "row_y"])

    ordered = _ordered(segments, settings)
    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField("row_y", T.DoubleType())]))


def _joined(segments: pa.Table) -> pa.Table:
    """(doc_id, page, row_y, line) of whole rows, numbered in the column row; their texts from left to right. A row without
    any text is left out."""
    segments = segments.filter(pc.is_valid(segments["text"]))
    segments = segments.append_column("known", pc.is_valid(segments["x_left"]).cast(pa.int8()))
    order = pc.sort_indices(segments, sort_keys=[(k, "ascending") for k in ("row", "known", "x_left", "y", "text")])
    segments = segments.take(order).combine_chunks()
    row = segments["row"].to_numpy()
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    texts = pa.concat_arrays(segments["text"].cast(pa.string()).chunks or [pa.array([], pa.string())])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), texts)
    firsts = segments.select(["doc_id", "page", "row_y"]).take(pa.array(starts))
    return firsts.append_column("line", pc.binary_join(lists, " ")).combine_chunks()


def segment_lines(segments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Text lines (doc_id, page, row_y, line) of scanned pages; empty lines dropped.

    Rows follow each other in the walk of `segment_rows`, so their texts are joined on the way; of a page only the row that
    a batch leaves open is held."""
    tolerance = settings.row_tolerance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, n = [], 0
        for batch, rows, begins in _walked(batches, tolerance):
            numbers = np.zeros(batch.num_rows, np.int64)
            numbers[begins] = 1
            numbers = n + np.cumsum(numbers)
            n = int(numbers[-1])
            part = pa.table({name: batch.column(name) for name in ("doc_id", "page", "y", "x_left", "text")} | {
                "row_y": pa.array(rows, pa.float64()), "row": pa.array(numbers)})
            if begins:
                yield from _joined(pa.concat_tables([*left, part.slice(0, begins[-1])])).to_batches()
                left = []
            left.append(part.slice(begins[-1] if begins else 0))
        if left:
            yield from _joined(pa.concat_tables(left)).to_batches()

    ordered = _ordered(segments.select("doc_id", "page", "x_left", "y_top", "y_bottom", "text", "conf"), settings)
    schema = T.StructType([ordered.schema["doc_id"], ordered.schema["page"], T.StructField("row_y", T.DoubleType()), T.StructField("line", T.StringType())])
    ordered = ordered.select("doc_id", "page", "y", "x_left", "text")
    return ordered.mapInArrow(run, schema).withColumn("line", F.trim("line")).filter(F.col("line") != "")


def segment_pages(segments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Documents (doc_id, pages) of scanned segments."""
    lines = segment_lines(segments, settings).groupBy("doc_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_y", "line"))), lambda l: l["line"]).alias("lines"))
    page = F.struct("page", F.array_join("lines", "\n").alias("text"), "lines")
    return (
        lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
        .withColumn("extraction_method", F.lit("easyocr"))
    )


def audit_segments(segments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Segments that were read, with their confidence to 3 decimals."""
    return segments.filter(F.col("conf") > settings.min_segment_confidence).select(
        "doc_id", "page", "text", F.round("conf", 3).alias("conf"))


# --- Sections ------------------------------------------------------------------------------------------


def _starts_table(line: str, i: str) -> str:
    """Line opens the item table: a first row, with a second row within 19 lines and a decimal amount
    on the way there."""
    second = sql.index_of(f"slice(lines, {i} + 2, 19)", lambda l, _: matches(l, SECOND_ROW))
    return all_of(matches(line, FIRST_ROW), let(second, lambda j: (
        f"({j} IS NOT NULL AND {sql.fits(f'array_join(slice(lines, {i} + 1, {j} + 2), {sql.quoted(chr(32))})', COMMA_AMOUNT)})")))


def add_sections(documents: DataFrame) -> DataFrame:
    """Adds table_at, totals_at, footer_at: line indexes where the sections begin (null if none)."""
    marked = sql.first_kept("lines", lambda l: f"contains({l}, {sql.quoted(ITEMS_MARK)})")
    starts = lambda pattern, after: when(f"{after} IS NOT NULL", sql.index_of(
        "lines", lambda l, _: matches(strip(l), pattern), after))
    return computed(
        documents
        .withColumn("table_at", F.expr(when(f"{marked} IS NULL", sql.index_of("lines", _starts_table))))
        .withColumn("totals_at", F.expr(starts(TOTALS_START, "table_at")))
        .withColumn("footer_at", F.expr(starts(FOOTER_START, "totals_at")))
    )


def mark_sections(documents: DataFrame) -> DataFrame:
    """Puts a mark line, between blank lines, in front of each section; marked documents stay as
    they are."""
    mark = lambda at, text: f"WHEN i <=> {at} THEN array('', {sql.quoted(text)}, '', l)"
    marked = (
        f"flatten(transform(lines, (l, i) -> CASE {mark('table_at', ITEMS_MARK)} {mark('totals_at', TOTALS_MARK)}"
        f" {mark('footer_at', FOOTER_MARK)} ELSE array(l) END))")
    return computed(add_sections(documents).withColumn(
        "lines", F.expr(f"CASE WHEN table_at IS NULL THEN lines ELSE {marked} END")).drop(
        "table_at", "totals_at", "footer_at"))


def sectioned_lines(documents: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line, section) of documents."""
    i = F.col("line_no")
    section = (
        F.when(F.col("table_at").isNull() | (i < F.col("table_at")), "header")
        .when(F.col("totals_at").isNull() | (i < F.col("totals_at")), "items")
        .when(F.col("footer_at").isNull() | (i < F.col("footer_at")), "totals")
        .otherwise("footer")
    )
    return (
        add_sections(documents)
        .select("doc_id", "table_at", "totals_at", "footer_at", F.posexplode("lines").alias("line_no", "line"))
        .select("doc_id", "line_no", "line", section.alias("section"))
    )


# --- Item rows -----------------------------------------------------------------------------------------

ITEM_ROW = f"struct<description string, amount {sql.PARSED}>"


def parse_item(line: str) -> str:
    """struct(description, amount): the amount is the last word, or else the last two together."""

    def read(words: str) -> str:
        def item(count: int, amount: str) -> str:
            return let(sql.parse_amount(amount), lambda a: when(
                f"size({words}) > {count} AND {a} > 0",
                f"named_struct('description', array_join(slice({words}, 1, size({words}) - {count}), ' '), 'amount', {a})"))

        last = f"get({words}, size({words}) - 1)"
        return coalesce(item(1, last), when(
            f"size({words}) > 2", item(2, f"concat(get({words}, size({words}) - 2), {last})")))

    return let(strip(line), lambda l: when(
        f"{l} <> '' AND NOT startswith({l}, '---')", let(f"split({l}, '(?U)\\\\s+')", read)))


def item_rows(lines: str) -> str:
    """Item rows between the marks of the item table and of the next section, empty if unmarked."""

    def place(marks: list[str], after: str) -> str:
        listed = ", ".join(sql.quoted(m) for m in marks)
        return sql.index_of(lines, lambda l, _: f"{strip(l)} IN ({listed})", after)

    def section(start: str) -> str:
        return let(place([TOTALS_MARK, FOOTER_MARK], start), lambda end: (
            f"slice({lines}, {start} + 2, coalesce({end} - {start} - 1, size({lines})))"))

    rows = let(place([ITEMS_MARK], "-1"), lambda start: when(f"{start} IS NOT NULL", sql.keep(
        sql.transform(section(start), parse_item), lambda x: f"{x} IS NOT NULL")))
    return coalesce(rows, f"CAST(array() AS array<{ITEM_ROW}>)")
