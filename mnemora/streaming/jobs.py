"""The ingest job state machine over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..functions.scores import RETRYABLE
from ..operators.ingest import STOPPED, finished, verbatim

JOB_STATE = "job_id long, status string, attempts long, run_after timestamp, error string"


def job_stream(events: DataFrame, attempts: int = S.JOB_ATTEMPTS, stale_minutes: int = S.STALE_MINUTES) -> DataFrame:
    """Job records in update mode from a stream of (job_id, seq, at, event, error): pending, running, succeeded, dead_letter.

    Events of a micro-batch are taken in the order of ``seq``; one that is not newer than what the job has seen is ignored.
    A retryable failure is due again after a doubling wait. A claim without an outcome falls back to pending by timer, due at once.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, tried, seen, due, error = state.get if state.exists else ("pending", 0, -1, None, None)
        if state.hasTimedOut and status == "running":
            status, due, error = "pending", state.getCurrentProcessingTimeMs() * 1000, error or STOPPED
        rows = [r for part in parts for r in zip(part["seq"], part["at"], part["event"], part["error"], strict=True)]
        for seq, at, event, kind in sorted(rows, key=lambda r: r[0]):
            if seq <= seen:
                continue
            seen, micros = int(seq), pd.Timestamp(at).value // 1000
            if event == "enqueue":
                due = micros
            elif event == "claim":
                status, tried = "running", tried + 1
            elif event == "succeed":
                status = "succeeded"
            elif event == "fail":
                again = kind in RETRYABLE and tried < attempts
                status, error = "pending" if again else "dead_letter", kind
                due = micros + 1_000_000 * S.BACKOFF_SECONDS * 2 ** min(max(tried - 1, 0), 6) if again else due
        state.update((status, tried, seen, due, error))
        if status == "running":
            state.setTimeoutDuration(stale_minutes * 60_000)
        stamp = pd.to_datetime([due], unit="us")
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [tried], "run_after": stamp, "error": [error]})

    kept = "status string, attempts long, seq long, run_after long, error string"
    return events.groupBy("job_id").applyInPandasWithState(run, JOB_STATE, kept, "update", GroupStateTimeout.ProcessingTimeTimeout)


def ingest_stream(payloads: DataFrame, memories_path: str, rejects_path: str, checkpoint: str, every: str | None = None, jobs_path: str | None = None):
    """Start saving a stream of payloads verbatim: good rows are appended to one path, rejected ones with their reason to another.

    A batch is written under its number, so a repeated batch overwrites itself. ``every`` is a
    processing-time trigger; without it all that is there is taken once. ``jobs_path`` receives the log of the jobs that this was.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = verbatim(batch).persist()
        rows.filter("reject_reason IS NULL").drop("reject_reason").write.mode("overwrite").parquet(f"{memories_path}/batch={number}")
        rows.filter("reject_reason IS NOT NULL").write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        if jobs_path:
            finished(rows, F.current_timestamp().cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{jobs_path}/batch={number}")
        rows.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return payloads.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()
