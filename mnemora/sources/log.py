"""The event log as files, with a folded state that is brought up to date from the events after it.

A batch of events is written under its number, so a batch that is repeated adds nothing. The state is the fold of all
batches up to one of them; current rows are that state with the later batches folded in, which are all of the log that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from . import store

KEYS = ["user_id", "memory_id"]


class EventLog:
    """A log in the folder ``path``; ``path``/current names the state and the last batch in it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch under its number; the same batch again replaces itself. Batches that the state holds are closed."""
        if batch <= self.upto():
            raise ValueError(f"batch {batch} is part of the state already")
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def state(self) -> tuple[str | None, int]:
        """The folder of the state and the last batch in it."""
        if not self._exists(f"{self.path}/current"):
            return None, -1
        name, upto = store.current_path(self.spark, f"{self.path}/current").split(" ")
        return f"{self.path}/{name}", int(upto)

    def upto(self) -> int:
        return self.state()[1]

    def events(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """Events of the batches after one and up to another; the rest are pruned by folder."""
        if not self._exists(f"{self.path}/log"):
            raise ValueError(f"{self.path} has no events")
        rows = self.spark.read.parquet(f"{self.path}/log").filter(F.col("batch") > after)
        return rows if upto is None else rows.filter(F.col("batch") <= upto)

    def current(self, batch: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Current rows: the state with the later batches folded in, up to ``batch``; only those of ``keys``, if given."""
        path, upto = self.state()
        some = lambda rows: rows if keys is None else rows.join(keys, KEYS, "left_semi")
        if path is None or (batch is not None and batch < upto):
            return events.fold(some(self.events(-1, batch).drop("batch")))
        base, tail = some(self.spark.read.parquet(path)), some(self.events(upto, batch).drop("batch"))
        return events.advance(base, tail, lambda late: self.events(-1, batch).drop("batch").join(late, KEYS, "left_semi"))

    def compact(self, batch: int) -> None:
        """Make the state hold all batches up to ``batch``: written beside the old one, then pointed to."""
        path, upto = self.state()
        if batch <= upto:
            return
        due = lambda after: self.events(after).filter(F.col("batch") <= batch).drop("batch")
        if path is None:
            made = events.folded(due(-1))
        else:
            made = events.advanced(self.spark.read.parquet(path), due(upto), lambda keys: due(-1).join(keys, KEYS, "left_semi"))
        name = f"state-{batch}"
        made.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(f"{self.path}/{name}")
        store.point_to(self.spark, f"{self.path}/current", f"{name} {batch}")
