"""A recall index that is kept up to date by segments: what changed is written beside what there is.

A segment holds the vectors, postings, lengths and memories of the rows that it adds, the keys of older rows that it
replaces or removes, and what both add to a user's number of memories and length of text. A row counts while no later
segment names its key. Weights follow the whole collection, so they are made when a query asks for its terms: from the
postings of those terms and the sums, never from texts. Segments are merged by size, or all once many rows are dead.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import tokens
from ..operators import embedding, recall
from . import store

KEYS = ["user_id", "memory_id"]
#: Each table, and how it is laid out.
LAYOUT = {"vectors": KEYS, "postings": ["user_id", "term", "memory_id"], "lengths": KEYS, "memories": KEYS, "dead": KEYS, "sums": ["user_id", "field"]}


class VectorIndex(Protocol):
    """What the vector leg reads: (user_id, memory_id, embedding)."""

    @property
    def vectors(self) -> DataFrame: ...


class TextIndex(Protocol):
    """What the keyword leg reads: (user_id, memory_id, term, weight) of (user_id, term) pairs."""

    def weights_of(self, terms: DataFrame) -> DataFrame: ...


class Segments:
    """The index in the folder ``path``; ``path``/current lists the segments that count. It is a VectorIndex and a TextIndex."""

    def __init__(self, spark: SparkSession, path: str, pinned: list[int] | None = None) -> None:
        """``pinned`` are the segments that count where something else than ``path``/current keeps them."""
        self.spark, self.path, self.pinned = spark, path.rstrip("/"), pinned

    def names(self) -> list[int]:
        """The segments that count, oldest first."""
        if self.pinned is not None:
            return self.pinned
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return [int(x) for x in store.current_path(self.spark, f"{self.path}/current").split()]

    def rows(self, table: str, names: Iterable[int] | None = None) -> DataFrame:
        """A table's rows of the segments that count, or some of them, dead ones too."""
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("segment").isin(*(self.names() if names is None else names)))

    def live(self, table: str, names: Iterable[int] | None = None) -> DataFrame:
        """A table's rows that no later segment replaces or removes."""
        below = self.rows("dead").groupBy(*KEYS).agg(F.max("segment").alias("_below"))
        met = self.rows(table, names).join(below, KEYS, "left")
        return met.filter(F.col("_below").isNull() | (F.col("segment") >= F.col("_below"))).drop("_below", "segment")

    @property
    def vectors(self) -> DataFrame:
        return self.live("vectors")

    @property
    def memories(self) -> DataFrame:
        return self.live("memories").select(*(f.name for f in S.MEMORIES))

    def weights_of(self, terms: DataFrame) -> DataFrame:
        """BM25 weights of the live postings of ``terms`` (user_id, term)."""
        found = self._postings(terms)
        whole = self.rows("sums").groupBy("user_id", "field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")
        return recall.weigh(found, whole.select("user_id", "field", "n", (F.col("total") / F.col("n")).alias("avgdl")))

    def _postings(self, terms: DataFrame) -> DataFrame:
        wanted = terms.select("user_id", "term").distinct()
        below = self.rows("dead").groupBy(*KEYS).agg(F.max("segment").alias("_below"))
        met = self.rows("postings").join(wanted, ["user_id", "term"], "left_semi").join(below, KEYS, "left")
        return met.filter(F.col("_below").isNull() | (F.col("segment") >= F.col("_below"))).select(*KEYS, "field", "term", "tf", "dl")

    def update(self, rows: DataFrame, gone: DataFrame | None = None, files: int | None = None, n: int | None = None) -> int:
        """Write the segment of changed memories and point to it. ``rows`` are whole memories, new or edited; those that are
        deleted, and the keys in ``gone``, are removed. What is written is in proportion to them. ``n`` numbers the segment, by
        default after the last; one that is written again replaces itself. Without ``files`` a table has as many as its size takes.
        Memories are written first, and the other tables are made from what was written. Returns the segment.
        """
        own = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.MEMORIES]
        fresh = rows.filter("deleted_at IS NULL").select(*own)
        dead = rows.select(*KEYS)
        dead = (dead if gone is None else dead.unionByName(gone.select(*KEYS))).distinct()
        names = self.names()
        n = max(self._written(), default=-1) + 1 if n is None else n
        self._write("memories", n, fresh, files)
        fresh = self._segment("memories", n)
        vectors = embedding.hash_embed(fresh.select(*KEYS, "content"), KEYS, "content")
        self._write("vectors", n, vectors, files)
        self._write("postings", n, recall.postings(fresh), files)
        self._write("lengths", n, recall.field_lengths(fresh), files)
        self._write("dead", n, dead if names else dead.limit(0), files)
        sums = self._summed(self._segment("lengths", n), 1)
        if names:
            sums = sums.unionByName(self._summed(self.live("lengths").join(self._segment("dead", n), KEYS, "left_semi"), -1))
        self._write("sums", n, sums.groupBy("user_id", "field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), files)
        self._point([*names, n])
        return n

    def _summed(self, lengths: DataFrame, sign: int) -> DataFrame:
        return lengths.groupBy("user_id", "field").agg((sign * F.count("*")).alias("n"), (sign * F.sum("dl")).alias("total"))

    def _written(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/memories/segment=*")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return [int(x.getPath().getName().split("=")[1]) for x in found or []]

    def _write(self, table: str, n: int, rows: DataFrame, files: int | None) -> None:
        """Rows are dealt by key to so many files, or as many as their size takes, and each file is sorted; they are made once, as no ranges are sampled."""
        order = LAYOUT[table]
        dealt = rows.repartition(files, *order) if files else rows.repartition(*order)
        dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/{table}/segment={n}")

    def _segment(self, table: str, n: int) -> DataFrame:
        """A table's rows as a segment holds them."""
        return self.spark.read.parquet(f"{self.path}/{table}/segment={n}")

    def _point(self, names: list[int]) -> None:
        if self.pinned is not None:
            self.pinned = names
            return
        store.point_to(self.spark, f"{self.path}/current", " ".join(map(str, names)))

    def sizes(self) -> dict[int, tuple[int, int]]:
        """(rows, of which live) of each segment, from their memories."""
        every = {r[0]: r[1] for r in self.rows("memories").groupBy("segment").count().collect()}
        below = self.rows("dead").groupBy(*KEYS).agg(F.max("segment").alias("_below"))
        lost = self.rows("memories").join(below, KEYS).filter(F.col("segment") < F.col("_below")).groupBy("segment").count()
        dead = {r[0]: r[1] for r in lost.collect()}
        return {n: (every.get(n, 0), every.get(n, 0) - dead.get(n, 0)) for n in self.names()}

    def compact(self, most: int = 4, dead_share: float = 0.3, files: int | None = None) -> list[int]:
        """Merge all segments if more than ``dead_share`` of their rows are dead; else, if there are more than ``most`` of a size,
        the newest of them that together are no smaller than half the next. Returns the segments that were merged.
        """
        sizes, names = self.sizes(), self.names()
        rows, alive = (sum(x[i] for x in sizes.values()) for i in (0, 1))
        some, held = [], 0
        for n in reversed(names):
            if some and sizes[n][0] > 2 * held:
                break
            some.insert(0, n)
            held += sizes[n][0]
        if rows and (rows - alive) / rows > dead_share:
            some = names
        elif len(some) <= most:
            return []
        n = max(self._written()) + 1
        for table in ("memories", "vectors", "postings", "lengths"):
            self._write(table, n, self.live(table, some), files)
        dead = self.rows("dead", some).select(*KEYS).distinct()
        self._write("dead", n, dead.limit(0) if some == names else dead, files)
        self._write("sums", n, self.rows("sums", some).groupBy("user_id", "field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), files)
        self._point([*(x for x in names if x not in some), n])
        return some

    def recall(self, queries: DataFrame, now: Column, filters: recall.Filters | None = None, half_life: float = S.HALF_LIFE_DAYS) -> DataFrame:
        """Answers to (query_id, user_id, text, k), as from an index that is built anew."""
        made = embedding.hash_embed(queries, ["query_id", "user_id", "text", "k"], "text")
        terms = queries.select("user_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        return recall.recall(made, self.memories, self.vectors, now, filters, half_life, weights=self.weights_of(terms))
