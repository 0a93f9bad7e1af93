"""Review status as keyed state: one small value per invoice, dropped a set time after its last action."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from knigovod.operators.reports import POSTED
from knigovod.operators.workflow import ACTIONS

#: State of timers and values needs this store; name it in spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_MARKS = [f"last_{a}" for a in ACTIONS]
_STATE = ", ".join(["status string", "blocked boolean", *[f"{m} long" for m in _MARKS], "until long"])
_COMBINED = ", ".join(["invoice_id {id}", "status string", "blocked boolean", *[f"{m} long" for m in _MARKS], "event_ts timestamp"])


def status_after(status: str, blocked: bool, approve: int | None, reject: int | None, export: int | None) -> str:
    """The rule of `workflow.final_status` on plain values."""
    exported_last = export is not None and (approve is None or export > approve)
    if not blocked and approve is not None and (reject is None or approve > reject):
        return "Exported" if exported_last else "Approved"
    if reject is None and status in POSTED and (exported_last or approve is not None):
        return "Exported" if exported_last else "Approved"
    return "Rejected" if reject is not None else status


class StatusOfInvoice(StatefulProcessor):
    """Keeps the places of the last approval, rejection and export; their order of arrival does not matter.

    Each action moves the invoice's timer to `keep` after its newest event time. When the watermark passes it, the state goes; an
    action that comes later starts from the status that the invoices table holds by then."""

    def __init__(self, keep: timedelta) -> None:
        self.keep_ms = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("marks", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.value.get() if self.value.exists() else None
        status, blocked, *marks, until = tuple(held) if held is not None else (None, None, *[None] * len(_MARKS), None)
        newest = -1
        for row in rows:
            if status is None:
                status, blocked = row["status"], bool(row["blocked"])
            marks = [b if a is None or (b is not None and b > a) else a for a, b in zip(marks, (row[m] for m in _MARKS))]
            newest = max(newest, int(row["event_ts"].timestamp() * 1000))
        moved = max(until or 0, newest + self.keep_ms)
        if moved != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(moved)
        self.value.update((status, blocked, *marks, moved))
        yield Row(invoice_id=key[0], status=status_after(status, blocked, *marks))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per invoice of each batch, so that an invoice with a third of all actions brings few rows to its task."""
    for batch in batches:
        for action, mark in zip(ACTIONS, _MARKS):
            batch[mark] = batch["seq"].where(batch["action"] == action)
        how = {"status": "first", "blocked": "first", **{m: "max" for m in _MARKS}, "event_ts": "max"}
        yield batch.groupby("invoice_id", as_index=False, dropna=False).agg(how).astype({m: "Int64" for m in _MARKS})


def status_keyed(events: DataFrame, invoices: DataFrame, delay: str = "1 day", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """Status of each invoice with actions, for output mode "update".

    events: stream of invoice_id, action, seq, event_ts. invoices: table of invoice_id, status, blocked; what it says of an invoice
    counts when the invoice is first seen. Events of invoices that are not in it are left out, as are those later than `delay`
    (judged, as Spark does, by the watermark that held in the batch before)."""
    rows = events.join(
        invoices.select("invoice_id", "status", F.coalesce("blocked", F.lit(False)).alias("blocked")), "invoice_id")
    kind = events.schema["invoice_id"].dataType.simpleString()
    combined = rows.select("invoice_id", "status", "blocked", "action", "seq", "event_ts").mapInPandas(
        _combined, _COMBINED.format(id=kind))
    return combined.withWatermark("event_ts", delay).groupBy("invoice_id").transformWithState(
        StatusOfInvoice(keep), f"invoice_id {kind}, status string", "Update", "EventTime")
