"""A recall index: vectors and term weights of a snapshot as files, laid out by user, for many batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from .. import schema as S
from ..operators import embedding, recall


def build(memories: DataFrame, path: str, files: int | None = None) -> None:
    """Write the index of a snapshot (deleted rows are left out; superseded and expired ones stay) to a new path."""
    stored = memories.filter("deleted_at IS NULL")
    vectors = embedding.hash_embed(stored.select("user_id", "memory_id", "content"), ["user_id", "memory_id"], "content")
    weights = recall.term_weights(stored)
    write(path, vectors, weights, stored, files)


def write(path: str, vectors: DataFrame, weights: DataFrame, stored: DataFrame, files: int | None) -> None:
    for name, rows, order in (("vectors", vectors, ["user_id", "memory_id"]), ("weights", weights, ["user_id", "term"]), ("memories", stored, ["user_id", "memory_id"])):
        dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.parquet(f"{path}/{name}")


def update(spark: SparkSession, old: str, path: str, memories: DataFrame, changed: DataFrame, files: int | None = None) -> None:
    """Write the index of a changed snapshot to a new path. ``changed`` has the (user_id, memory_id) that were added, edited or removed.

    Vectors of the others are taken from the old index; only changed texts are embedded anew. Term weights follow the whole
    collection's statistics, so they are made again.
    """
    keys = ["user_id", "memory_id"]
    ids = changed.select(*keys).distinct()
    stored = memories.filter("deleted_at IS NULL")
    fresh = stored.join(ids, keys, "left_semi")
    before = Index.read(spark, old)
    vectors = before.vectors.join(ids, keys, "left_anti").unionByName(embedding.hash_embed(fresh.select(*keys, "content"), keys, "content"))
    write(path, vectors, recall.term_weights(stored), stored, files)


@dataclass(frozen=True)
class Index:
    """An index's tables."""

    vectors: DataFrame
    weights: DataFrame
    memories: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("vectors", "weights", "memories")))

    def recall(self, queries: DataFrame, now: Column, filters: recall.Filters | None = None, half_life: float = S.HALF_LIFE_DAYS) -> DataFrame:
        """Answers to (query_id, user_id, text, k), as ``operators.recall.recall`` gives them from the snapshot."""
        made = embedding.hash_embed(queries, ["query_id", "user_id", "text", "k"], "text")
        return recall.recall(made, self.memories, self.vectors, now, filters, half_life, weights=self.weights)
