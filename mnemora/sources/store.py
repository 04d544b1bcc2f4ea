"""Snapshots, scans, lookups, export files and evaluation cases."""

from __future__ import annotations

import json
import tomllib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import reports


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot; columns that it lacks are null (importance 1, access_count 0, no tags)."""
    rows = spark.read.parquet(path)
    defaults = {"importance": F.lit(1.0), "access_count": F.lit(0), "tags": F.array().cast("array<string>")}
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.MEMORIES))


def write_memories(memories: DataFrame, path: str, partitions: int | None = None) -> None:
    """A snapshot laid out by user, so that a user's scans prune; write to a new path, then move the pointer."""
    laid = memories.repartitionByRange(partitions, "user_id", "memory_id") if partitions else memories.repartitionByRange("user_id", "memory_id")
    laid.sortWithinPartitions("user_id", "memory_id").write.option("parquet.block.size", str(64 << 20)).parquet(path)


def point_to(spark: SparkSession, pointer: str, path: str) -> None:
    """Record which snapshot is current: the name is written beside the pointer and renamed over it, so that a pointer is always whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (pointer, f"{pointer}.{uuid.uuid4().hex}"))
    files = final.getFileSystem(conf)
    out = files.create(fresh)
    out.write(path.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(fresh), files.makeQualified(final), options)


def current_path(spark: SparkSession, pointer: str) -> str:
    return spark.read.text(pointer, wholetext=True).first()[0]


def listing(memories: DataFrame, include_inactive: bool = False, most: int | None = None) -> DataFrame:
    """Not deleted and, unless inactive ones are wanted, not superseded; expired rows stay. Each user's newest first, with ``position``.

    With ``most`` only each user's first ones, found before the shuffle. Without it no task sorts all of a user's memories:
    they are numbered a day at a time, after the sums of the later days. A memory without a time comes last.
    """
    rows = memories.filter("deleted_at IS NULL")
    rows = rows if include_inactive else rows.filter("superseded_by IS NULL")
    order = [F.col("created_at").desc(), F.col("memory_id")]
    if most is not None:
        own = Window.partitionBy("user_id").orderBy(*order)
        return rows.withColumn("position", F.row_number().over(own).cast("long")).filter(F.col("position") <= most)
    day = F.coalesce(F.to_date("created_at"), F.lit("0001-01-01").cast("date"))
    days = rows.groupBy("user_id", day.alias("_day")).agg(F.count("*").alias("_n"))
    later = Window.partitionBy("user_id").orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("user_id", "_day", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    own = Window.partitionBy("user_id", "_day").orderBy(*order)
    numbered = rows.withColumn("_day", day).withColumn("_own", F.row_number().over(own))
    days = days.withColumnsRenamed({"user_id": "_user", "_day": "_of"})
    met = numbered.join(days, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_day") == F.col("_of")))
    return met.withColumn("position", (F.col("_later") + F.col("_own")).cast("long")).select(*rows.columns, "position")


def find(memories: DataFrame, user_id: int, memory_id: int) -> DataFrame:
    """One memory of a user, or nothing: a missing and a foreign id look alike."""
    return memories.filter((F.col("user_id") == user_id) & (F.col("memory_id") == memory_id) & F.col("deleted_at").isNull())


def find_many(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories of (user_id, memory_id) pairs; unknown, foreign and deleted ones are absent."""
    return memories.filter("deleted_at IS NULL").join(ids.select("user_id", "memory_id").distinct(), ["user_id", "memory_id"], "left_semi")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` put in by key, nulls of a key equal; used for digest caches and high-water marks."""
    new = rows.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    match: Column = F.lit(True)
    for k in keys:
        match &= table[k].eqNullSafe(new[f"_{k}"])
    return table.join(new, match, "left_anti").unionByName(rows.select(*table.columns))


def export(memories: DataFrame, path: str, form: str, include_inactive: bool = False, users: DataFrame | None = None) -> None:
    """Export files of (user_id, value), a line a memory, JSON or Markdown, users in order and each user's lines by category and age.

    Rows are dealt by ranges of all these, so a user with very many memories fills several files. With ``users`` (user_id,
    handle) the lines are those of whole documents, with titles and headings, of these users alone.
    """
    if form not in ("json", "markdown", "md"):
        raise ValueError(f"unknown export format {form!r}")
    if users is not None:
        order = ["user_id", *reports.PLACE]
        rows = reports.document_lines(memories, users, "json" if form == "json" else "markdown", include_inactive).repartitionByRange(*order)
        rows.sortWithinPartitions(*order).select("user_id", "value").write.parquet(path)
    elif form == "json":
        rows = reports.json_rows(memories, include_inactive)
        rows.repartitionByRange("user_id", "memory_id").sortWithinPartitions("user_id", "memory_id").select("user_id", F.col("json").alias("value")).write.parquet(path)
    else:
        order = ["user_id", "category", F.col("created_at").desc(), "memory_id"]
        rows = reports.markdown_rows(memories, include_inactive).repartitionByRange(*order)
        rows.sortWithinPartitions(*order).select("user_id", F.col("line").alias("value")).write.parquet(path)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seed memories, cases) of an evaluation file in TOML."""
    with open(path, "rb") as f:
        spec = tomllib.load(f)
    seeds = [(i, m["content"], m["category"], m.get("subcategory"), m.get("tags", [])) for i, m in enumerate(spec.get("memory", []))]
    cases = [(c["name"], c["kind"], c["query"], c["expect"], c.get("categories", []), c.get("tags", []), c.get("subcategories", [])) for c in spec.get("case", [])]
    return (
        spark.createDataFrame(seeds, "memory_id long, content string, category string, subcategory string, tags array<string>"),
        spark.createDataFrame(cases, "name string, kind string, query string, expect array<string>, categories array<string>, tags array<string>, subcategories array<string>"),
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(kind, recall_at_k) of a baseline file, ``all`` among the kinds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spark.createDataFrame([("all", float(spec["recall_at_k"])), *((k, float(v)) for k, v in spec["by_kind"].items())], "kind string, recall_at_k double")


def write_baseline(report: DataFrame, path: str) -> None:
    """A baseline file from a report (kind, cases, recall_at_k, precision_at_1) with a row ``all``; a few rows, written by the driver."""
    rows = {r.kind: r for r in report.collect()}
    whole = rows.pop("all")
    spec = {"recall_at_k": whole.recall_at_k, "precision_at_1": whole.precision_at_1, "cases": whole.cases, "by_kind": {k: rows[k].recall_at_k for k in sorted(rows)}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f, indent=2)


def reindex(memories: DataFrame, path: str, embed, model: str, dimensions: int, pointer: str | None = None) -> DataFrame:
    """Embed all rows that are not deleted (superseded ones too) anew by a model's callable and write vectors and their pin to a new path; gives the vectors.

    ``pointer`` is moved to the path when all of it is written.
    """
    from ..operators.embedding import model_embed

    rows = model_embed(memories.filter("deleted_at IS NULL").select("user_id", "memory_id", "content"), "content", embed, dimensions)
    rows.select("user_id", "memory_id", "embedding").repartitionByRange("user_id", "memory_id").write.parquet(f"{path}/vectors")
    spark = memories.sparkSession
    spark.createDataFrame([(model, dimensions)], "model string, dimensions int").coalesce(1).write.json(f"{path}/pin")
    if pointer:
        point_to(spark, pointer, path)
    return spark.read.parquet(f"{path}/vectors")
