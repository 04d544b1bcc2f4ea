"""Session helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever their working directory is.

    A cluster without a shared file system ships it with ``--py-files`` instead; then this changes nothing.
    """
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{known}" if known else home


#: For what one task takes: no exchange for a join or a group, and no query stages, of whose plans the driver keeps one after another.
ONE_TASK = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.maxSinglePartitionBytes": str(1 << 62), "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` in the session's configuration for what runs within; then it is as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; one is made here only where none is set, as on a laptop."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
