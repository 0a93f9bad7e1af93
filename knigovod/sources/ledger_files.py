"""Ledger files with commit: every named file of an export appears, or none does.

Tasks write below a hidden folder of the export. The driver gathers the files of the attempts that count, by name only, and one
rename makes the export's folder visible; a failed export leaves nothing. On object stores, where a folder cannot be renamed in
one step, the files appear one after the other.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from knigovod.fixed_values import LEDGER_COLUMNS


class EmptyExport(ValueError):
    """An export without rows is an error, not an empty file."""


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if ":" in path.split("/", 1)[0]:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its place in the order of the rows, its folder, its files in order, the number of rows."""

    place: int
    folder: str
    files: list[str]
    rows: int


class LedgerFilesWriter(DataSourceArrowWriter):
    """Rows of (file, columns ...), sorted by file, as one CSV file per name."""

    def __init__(self, path: str, export: str, overwrite: bool) -> None:
        self.path, self.export, self.overwrite = path.rstrip("/"), export, overwrite
        self.hidden = f"_{export}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _folder(self.path)
        task = TaskContext.get()
        folder = f"{self.hidden}/{task.partitionId():06d}-{task.taskAttemptId()}"
        files.create_dir(f"{root}/{folder}", recursive=True)
        names, rows, out, stream = [], 0, None, None
        try:
            for batch in iterator:
                for name, part in _runs(batch):
                    if not names or names[-1] != name:
                        if out is not None:
                            out.close()
                            stream.close()
                        stream = files.open_output_stream(f"{root}/{folder}/{name}.csv")
                        out = csv.CSVWriter(stream, part.schema, write_options=csv.WriteOptions(quoting_style="needed"))
                        names.append(name)
                    out.write_batch(part)
                    rows += part.num_rows
        finally:
            if out is not None:
                out.close()
                stream.close()
        return Written(task.partitionId(), folder, names, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _folder(self.path)
        told = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        if not sum(m.rows for m in told):
            self.abort(messages)
            raise EmptyExport(f"export {self.export} has no rows")
        pieces: dict[str, list[str]] = {}
        for message in told:
            for name in message.files:
                pieces.setdefault(name, []).append(f"{root}/{message.folder}/{name}.csv")
        whole, final = f"{root}/{self.hidden}/whole", f"{root}/{self.export}"
        files.create_dir(whole)
        for name, parts in pieces.items():
            for number, part in enumerate(parts, 1):
                files.move(part, f"{whole}/{name}.csv" if len(parts) == 1 else f"{whole}/{name}.part{number}.csv")
        if files.get_file_info(final).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(f"export {self.export} is there already")
            files.delete_dir(final)
        files.move(whole, final)
        files.delete_dir(f"{root}/{self.hidden}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _folder(self.path)
        if files.get_file_info(f"{root}/{self.hidden}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.hidden}")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(file, rows without the name) for each run of rows with one file name."""
    names = batch.column(0).to_pylist()
    rows = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
    start = 0
    for end in range(1, len(names) + 1):
        if end == len(names) or names[end] != names[start]:
            yield names[start], rows.slice(start, end - start)
            start = end


class LedgerFiles(DataSource):
    """Format "ledger_files", options path and export (a name for the folder of the export)."""

    @classmethod
    def name(cls) -> str:
        return "ledger_files"

    def writer(self, schema: StructType, overwrite: bool) -> LedgerFilesWriter:
        return LedgerFilesWriter(self.options["path"], self.options["export"], overwrite)


def write_ledger_files(rows: DataFrame, path: str, export: str, overwrite: bool = False) -> None:
    """Ledger rows (file, invoice_id, invoice_date, line_key, ledger columns) as files `path/export/<file>.csv`.

    Rows stand in a file by invoice date, undated first, then in journal order. The range sort goes by all these keys, so a
    file of very many rows is written by several tasks, as <file>.part1.csv and so on. No rows: EmptyExport. An export of that
    name: FileExistsError, or it is replaced with `overwrite`."""
    spark = rows.sparkSession
    spark.dataSource.register(LedgerFiles)
    keys = [F.col("file"), F.col("invoice_date").asc_nulls_first(), F.col("invoice_id"), F.col("line_key").asc_nulls_last()]
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in LEDGER_COLUMNS]
    rows.orderBy(*keys).select("file", *text).write.format("ledger_files").option("export", export).mode(
        "overwrite" if overwrite else "append").save(path)


def per_invoice(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Ledger rows with the file of their invoice. names: invoice_id, file. Invoices whose files would have one name, say those
    without a number, get their id behind it."""
    shared = names.groupBy("file").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    own = names.join(shared, "file", "left").select(
        "invoice_id", F.when(F.col("_n").isNull(), F.col("file")).otherwise(
            F.concat_ws("_", "file", F.col("invoice_id").cast("string"))).alias("file"))
    return rows.join(own, "invoice_id")
