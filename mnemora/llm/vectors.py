"""Vector columns: which rows count, classes of equal vectors, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matrix

#: Vectors that a model is fitted on at most, about (rows are taken by hash of their id).
SAMPLE_ROWS = 16_384


#: Rows of a lookup table up to which it is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 17


def checked(small: DataFrame, rows: int) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows allow it."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fingerprint(vector: Column) -> tuple[Column, Column]:
    """128 bits that stand for a vector's value, as two longs."""
    return F.xxhash64(F.lit(101), vector), F.xxhash64(F.lit(211), vector)


def bounded_sample(df: DataFrame, id_col: str, vector_col: str, rows: int | None = None) -> dict[int, np.ndarray]:
    """About ``rows`` (SAMPLE_ROWS) vectors of each number of dimensions by hash of id, one matrix each; all of them if there are no more.

    Each number of dimensions is sampled by its own count, a row each that reaches the driver, so a rare one is not lost
    among the others; where none is sampled, its vector of the smallest id is the sample.
    """
    rows = SAMPLE_ROWS if rows is None else rows
    buckets = 1 << 30
    chosen = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("d"))
    share = chosen.groupBy("d").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    limit = F.least(F.lit(rows) / F.col("n"), F.lit(1.0)) * buckets
    hashed = chosen.join(F.broadcast(share), "d").filter((F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(buckets)) < limit) | (F.col("id") == F.col("first")))
    got = hashed.select("id", F.col("v").cast("array<double>").alias("v"), "d").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    got = got.take(order)
    dims = got.column("d").to_numpy()
    return {int(d): matrix(got.filter(dims == d).column("v")) for d in np.unique(dims)}
