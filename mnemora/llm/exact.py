"""Exact duplicates by heavy-hitter split, in DataFrame functions alone.

Texts are equal when they are identical without white space (space and U+0009 to U+000D). Of equal texts the row with the
most code points stays, then the smallest id, then the first row read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A digest with more than one row in so many is frequent; so there are fewer frequent digests than this, whatever the input.
PARTS = 1000


def normalised(text: Column) -> Column:
    """A text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_sha256, size, row) of every row, written once: what follows reads no text. ``row`` tells equal rows apart."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("size"))
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def winners(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """(text_sha256, keep_id, keep_row, group_size) of the frequent digests, fewer than ``parts`` rows.

    Misra-Gries counters (Spark's ``freqItems``) leave no digest out that more than one row in ``parts`` has, but may name
    others; those are told by an exact count, which partial aggregation makes without shuffling their rows.
    """
    least = rows.count() / parts
    likely = rows.freqItems(["text_sha256"], 1 / parts).select(F.explode(F.col("text_sha256_freqItems")).alias("text_sha256"))
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("last"), "id", "row"))
    counted = rows.join(F.broadcast(likely), "text_sha256", "left_semi").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    kept = counted.filter(F.col("group_size") > least)
    return materialise(kept.select("text_sha256", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "winners")


def exact_dedup(docs: DataFrame, id_col: str, text_col: str, parts: int = PARTS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``docs``: which row of its group of equal texts stays.

    Rows of frequent digests meet their verified winner in a broadcast of fewer than ``parts`` rows and are never shuffled;
    the others go by digest, so that a group has at most one row in ``parts``. Only digests are compared and shuffled. A
    null text equals the empty one; a null id comes after all others; of rows with one id and text exactly one stays;
    further columns take no part.
    """
    rows = digests(docs, id_col, text_col)
    hot = F.broadcast(winners(rows, parts))
    group = Window.partitionBy("text_sha256").orderBy(F.col("size").desc(), F.col("id").asc_nulls_last(), "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = rows.join(hot.select("text_sha256"), "text_sha256", "left_anti")
    rest = rest.select("*", F.first("id").over(group).alias("keep_id"), F.first("row").over(group).alias("keep_row"), F.count("*").over(group).alias("group_size"))
    both = rows.join(hot, "text_sha256").unionByName(rest)
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
