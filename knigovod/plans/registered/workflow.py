"""Review workflow, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from knigovod.operators import workflow as wf
from knigovod.operators import reports
from knigovod.plans.bindings import INVOICES, acted_invoices, actions, as_of, invoices, table
from knigovod.operators.stages import shared_path
from knigovod.plans.registered import plain, with_sql
from knigovod.streaming import jobs

GAP = 1800


def status_fold(spark, sf):
    return wf.fold_status(acted_invoices(spark, sf), actions(spark, sf)).select("invoice_id", "status", "n_approve", "n_reject", "n_export")


ACTIONS = """act AS (SELECT user_id AS invoice_id, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'export' END AS action FROM events),
acted AS (SELECT DISTINCT user_id AS invoice_id, ['Pending', 'Approved', 'Exported'][user_id % 3 + 1] AS status, user_id % 4 = 0 AS blocked FROM events),
walked AS (SELECT a.invoice_id, list_reduce(list_prepend(any_value(a.status) || ':' || any_value(a.blocked), list(action ORDER BY seq) FILTER (action IS NOT NULL)),
    lambda s, x: CASE WHEN x = 'reject' THEN 'Rejected' || s[strpos(s, ':'):]
      WHEN x = 'approve' AND (s LIKE '%:false' OR s LIKE 'Approved%' OR s LIKE 'Exported%') THEN 'Approved' || s[strpos(s, ':'):]
      WHEN x = 'export' AND (s LIKE 'Approved%' OR s LIKE 'Exported%') THEN 'Exported' || s[strpos(s, ':'):] ELSE s END) AS s,
    count(*) FILTER (action = 'approve') AS n_approve, count(*) FILTER (action = 'reject') AS n_reject, count(*) FILTER (action = 'export') AS n_export
  FROM acted a JOIN act USING (invoice_id) GROUP BY 1)"""
fold_sql = with_sql(ACTIONS, "SELECT invoice_id, string_split(s, ':')[1] AS status, n_approve, n_reject, n_export FROM walked")


def approve_gate(spark, sf):
    return wf.approve_gate(invoices(spark, sf)).select("invoice_id", "approval")


gate_sql = with_sql(INVOICES, """
SELECT invoice_id, CASE WHEN blocked AND status NOT IN ('Approved', 'Exported') THEN 'blocked' ELSE 'Approved' END AS approval FROM inv""")


def _uploads(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("received_ts"))


def sessions(spark, sf):
    return wf.sessions(_uploads(spark, sf), GAP).select("user_id", F.col("session_no").cast("bigint").alias("session_no"), "started", "ended", "n")


sessions_sql = f"""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM marked)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM numbered GROUP BY 1, 2"""


def daily_volume(spark, sf):
    received = _uploads(spark, sf).select(F.to_date("received_ts").alias("received"), F.lit(None).cast("date").alias("invoice_date"))
    return reports.daily_volume(received, as_of("2024-01-30"))


volume_sql = """SELECT CAST(d AS DATE) AS day, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = CAST(d AS DATE)) AS n
FROM generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY) AS t(d)"""


def _completed(spark, stream, mode: str = "complete"):
    """Result of a stream that has read all there is. A repeated batch overwrites its own folder."""
    folder = shared_path(spark, f"run-{uuid.uuid4().hex}")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    last = out.agg(F.max("epoch")).scalar()
    return out.filter(F.col("epoch") == last).drop("epoch")


def _event_stream(spark, sf):
    static = table(spark, sf, "events")
    return spark.readStream.schema(static.schema).parquet(f"{sf}/events*.parquet")


def stream_daily_volume(spark, sf):
    arrived = _event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("received_ts"))
    return _completed(spark, jobs.daily_volume(arrived))


stream_volume_sql = "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1"


def stream_sessions(spark, sf):
    arrived = _event_stream(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("received_ts"))
    return _completed(spark, jobs.upload_sessions(arrived))


stream_sessions_sql = f"""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM marked)
SELECT user_id, min(ts) AS started, count(*) AS n FROM numbered GROUP BY user_id, session_no"""


def stream_status(spark, sf):
    events = _event_stream(spark, sf)
    action = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").when(
        F.col("event_type") == "signup", "export")
    acts = events.select(F.col("user_id").alias("invoice_id"), action.alias("action"), F.col("event_id").alias("seq")).filter(
        F.col("action").isNotNull())
    return _completed(spark, jobs.status_stream(acts, acted_invoices(spark, sf)))


stream_status_sql = with_sql(ACTIONS, "SELECT invoice_id, string_split(s, ':')[1] AS status FROM walked WHERE n_approve + n_reject + n_export > 0")

QUERIES = {
    "status_fold": (status_fold, fold_sql),
    "approve_gate": (approve_gate, gate_sql),
    "sessions": (sessions, sessions_sql),
    "daily_volume": (daily_volume, volume_sql),
    "stream_daily_volume": (stream_daily_volume, stream_volume_sql),
    "stream_sessions": (stream_sessions, stream_sessions_sql),
    "stream_status": (stream_status, stream_status_sql),
}
