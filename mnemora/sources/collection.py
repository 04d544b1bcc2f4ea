"""Log, state, index and high-water marks of a collection under one pointer.

A commit writes its events, the index segment of the rows that they change and the new marks each under the commit's
number, and then moves one pointer. So a reader sees all of a commit or nothing of it, a merge with the retirements of its
members; a commit that was broken off is written again over itself, and one that is repeated does nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from . import store
from .log import KEYS, EventLog
from .segments import Segments

MARKS = "user_id long, category string, sub string, recorded_at timestamp_ntz"


@dataclass(frozen=True)
class Version:
    """What a reader sees: the last commit, the index segments that count and the commit that last wrote marks."""

    batch: int = -1
    segments: tuple[int, ...] = ()
    marks: int = -1


class Collection:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = EventLog(spark, f"{self.path}/events")

    def version(self) -> Version:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return Version()
        held = json.loads(store.current_path(self.spark, f"{self.path}/version"))
        return Version(held["batch"], tuple(held["segments"]), held["marks"])

    def memories(self, keys: DataFrame | None = None) -> DataFrame:
        """Current rows, deleted ones too, as in the schema."""
        return self._rows(self.version().batch, keys)

    def _rows(self, batch: int, keys: DataFrame | None) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], S.MEMORIES)
        rows = self.log.current(batch, keys)
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(1.0 if f.name == "importance" else None)).cast(f.dataType).alias(f.name) for f in S.MEMORIES))

    def index(self) -> Segments:
        return Segments(self.spark, f"{self.path}/index", list(self.version().segments))

    def marks(self) -> DataFrame:
        """High-water marks of consolidation."""
        at = self.version().marks
        return self.spark.read.schema(MARKS).parquet(f"{self.path}/marks/{at}") if at >= 0 else self.spark.createDataFrame([], MARKS)

    def engine(self, now: Column):
        from ..engine import Engine

        version = self.version()
        empty = self.spark.createDataFrame([], "user_id long, memory_id long, embedding array<double>")
        return Engine(self.memories(), self.index().vectors if version.segments else empty, now)

    def commit(self, batch: int, events: DataFrame, marks: DataFrame | None = None) -> bool:
        """Make ``events`` and, if given, ``marks`` part of the collection as commit number ``batch``; false if it is already."""
        version = self.version()
        if batch <= version.batch:
            return False
        self.log.append(events, batch)
        changed = self.log.events(batch - 1, batch).filter("operation <> 'access'").select(*KEYS).distinct()
        index = Segments(self.spark, f"{self.path}/index", list(version.segments))
        index.update(self._rows(batch, changed), n=batch)
        at = version.marks
        if marks is not None:
            marks.write.mode("overwrite").parquet(f"{self.path}/marks/{batch}")
            at = batch
        held = {"batch": batch, "segments": index.names(), "marks": at}
        store.point_to(self.spark, f"{self.path}/version", json.dumps(held))
        return True

    def tidy(self, most: int = 4, dead_share: float = 0.3) -> None:
        """Fold the log into its state and merge segments; readers see the same rows before and after."""
        version = self.version()
        self.log.compact(version.batch)
        index = Segments(self.spark, f"{self.path}/index", list(version.segments))
        if index.compact(most, dead_share):
            held = {"batch": version.batch, "segments": index.names(), "marks": version.marks}
            store.point_to(self.spark, f"{self.path}/version", json.dumps(held))
