"""Command line over a snapshot of memories: ``python -m mnemora COMMAND SNAPSHOT ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import consolidate
from .sources import store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mnemora")
    out.add_argument("command", choices=("list", "recall", "profile", "export", "consolidate"))
    out.add_argument("snapshot", help="a folder of Parquet files, or with --pointer the file that names it")
    out.add_argument("--pointer", action="store_true")
    out.add_argument("--user", type=int, default=1)
    out.add_argument("--text", default="")
    out.add_argument("--limit", type=int, default=8)
    out.add_argument("--format", default="markdown", choices=("markdown", "json"))
    out.add_argument("--all", action="store_true", help="inactive memories too")
    return out


def main(args: list[str] | None = None) -> None:
    """Print what a command finds; ``consolidate`` shows what a run would merge and writes nothing."""
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("mnemora").getOrCreate()
    engine = Engine.of(store.read_memories(spark, store.current_path(spark, a.snapshot) if a.pointer else a.snapshot), F.current_timestamp().cast("timestamp_ntz"))
    users = spark.createDataFrame([(a.user, str(a.user))], "user_id long, handle string")
    if a.command == "list":
        engine.list(a.all).filter(F.col("user_id") == a.user).orderBy("position").show(a.limit, truncate=100)
    elif a.command == "recall":
        asked = spark.createDataFrame([(0, a.user, a.text, a.limit)], "query_id long, user_id long, text string, k long")
        for r in engine.checked(asked).filter("reject_reason IS NOT NULL").collect():
            raise SystemExit(r.reject_reason)
        engine.recall(asked).orderBy("position").select("position", "memory_id", "category", "content", "score").show(a.limit, truncate=100)
    elif a.command == "profile":
        print(engine.profile(users).first().text)
    elif a.command == "export":
        print(engine.export(users, a.format, a.all).first()[1])
    else:
        state = spark.createDataFrame([], "user_id long, category string, sub string, recorded_at timestamp_ntz")
        consolidate.previews(engine.plan(state)[1], engine.memories).filter(F.col("user_id") == a.user).show(a.limit, truncate=100)


if __name__ == "__main__":
    main()
