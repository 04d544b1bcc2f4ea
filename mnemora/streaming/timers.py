"""Jobs whose retries and lost workers are acted upon by timers: Structured Streaming with keyed state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..functions.scores import RETRYABLE
from ..operators.ingest import STOPPED

RECORD = "job_id long, status string, attempts long, run_after timestamp_ntz, error string, due boolean"
EPOCH = dt.datetime(1970, 1, 1)
#: How long a finished job is remembered, so that late repeats of its events change nothing.
KEPT_MINUTES = 60


def with_timers(spark: SparkSession) -> SparkSession:
    """Timers and states that expire need the RocksDB state store; it holds for streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Jobs(StatefulProcessor):
    """One job: its record while it is open, and after its end no more than the number of its last event, which expires."""

    def __init__(self, attempts: int, stale_minutes: float, kept_minutes: float) -> None:
        self.most, self.stale_ms, self.kept_ms = attempts, int(stale_minutes * 60_000), int(kept_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "status string, attempts long, seq long, run_after long, error string")
        self.ended = handle.getValueState("ended", "seq long", self.kept_ms)

    def _wait(self, until: int | None) -> None:
        """One timer a job, at ``until`` (milliseconds)."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if until is not None:
            self.handle.registerTimer(until)

    def _record(self, key: tuple, status: str, tried: int, due: int | None, error: str | None, now: bool) -> Row:
        at = None if due is None else EPOCH + dt.timedelta(microseconds=due)
        return Row(job_id=key[0], status=status, attempts=tried, run_after=at, error=error, due=now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        status, tried, seen, due, error = self.open.get() if self.open.exists() else ("pending", 0, self.ended.get()[0] if self.ended.exists() else -1, None, None)
        changed = False
        for row in sorted(rows, key=lambda r: r.seq):
            if row.seq <= seen or (self.ended.exists() and not self.open.exists()):
                continue
            seen, changed = row.seq, True
            micros = (row.at - EPOCH) // dt.timedelta(microseconds=1)
            if row.event == "enqueue":
                due = micros
            elif row.event == "claim":
                status, tried = "running", tried + 1
            elif row.event == "succeed":
                status = "succeeded"
            elif row.event == "fail":
                again = row.error in RETRYABLE and tried < self.most
                status, error = "pending" if again else "dead_letter", row.error
                due = micros + 1_000_000 * S.BACKOFF_SECONDS * 2 ** min(max(tried - 1, 0), 6) if again else due
        if not changed:
            return
        if status in ("succeeded", "dead_letter"):
            self.open.clear()
            self.ended.update((seen,))
            self._wait(None)
        else:
            self.open.update((status, tried, seen, due, error))
            ready = None if due is None else due // 1000
            self._wait(now + self.stale_ms if status == "running" else ready if ready is not None and ready > now else None)
        yield self._record(key, status, tried, due, error, status == "pending" and due is not None and due // 1000 <= now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A waiting job is due; a running one has lost its worker, and is due from now on."""
        if not self.open.exists():
            return
        status, tried, seen, due, error = self.open.get()
        if status == "running":
            status, due, error = "pending", timerValues.getCurrentProcessingTimeInMs() * 1000, error or STOPPED
            self.open.update((status, tried, seen, due, error))
        yield self._record(key, status, tried, due, error, True)

    def close(self) -> None:
        pass


def job_timers(events: DataFrame, attempts: int = S.JOB_ATTEMPTS, stale_minutes: float = S.STALE_MINUTES, kept_minutes: float = KEPT_MINUTES) -> DataFrame:
    """Job records from a stream of (job_id, seq, at, event, error), in update mode; ``due`` says that a worker may claim the job now.

    A job is due when it is enqueued for now or earlier, when the wait after a failure that is worth repeating is over, and
    when its worker has been silent for ``stale_minutes``: for these a timer fires without any new event. Events count in
    the order of ``seq``, each once. A finished job leaves the state after ``kept_minutes``; see ``with_timers``.
    """
    return events.groupBy("job_id").transformWithState(statefulProcessor=Jobs(attempts, stale_minutes, kept_minutes), outputStructType=RECORD, outputMode="Update", timeMode="ProcessingTime")
