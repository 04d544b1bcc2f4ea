"""Clusters without pairs, and lists of a user's memories in parts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.operators import consolidate
from mnemora.sources import store

from .test_recall import NOW, memory

VECTORS = "user_id long, memory_id long, embedding array<double>"


def groups(spark, rows):
    return consolidate.grouped(spark.createDataFrame(rows, S.MEMORIES), F.lit(NOW).cast("timestamp_ntz"))


def by_hand(vectors, threshold):
    """{memory: smallest memory it is linked to, over any number of links} of those with a link."""
    ids = [i for i, v in vectors.items() if any(v)]
    near = lambda a, b: np.dot(vectors[a], vectors[b]) >= threshold * np.linalg.norm(vectors[a]) * np.linalg.norm(vectors[b])
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if near(a, b):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: x for i, x in label.items() if list(label.values()).count(x) > 1}


@pytest.mark.parametrize("seed", range(3))
def test_linked_is_clusters_of_similar(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = {i: [float(x) for x in rng.normal(size=3)] for i in range(1, 41)} | {41: [0.0, 0.0, 0.0]}
    found = groups(spark, [memory(i, "x") for i in vectors])
    stored = spark.createDataFrame([(1, i, v) for i, v in vectors.items()], VECTORS)
    got = {r.memory_id: r.cluster_id for r in consolidate.linked(found, stored, 0.97).collect()}
    assert got == by_hand(vectors, 0.97)
    assert got == {r.memory_id: r.cluster_id for r in consolidate.clusters(consolidate.similar(found, stored, 0.97)).collect()}


def test_a_chain_over_many_blocks_is_one_cluster(spark):
    n = 1500
    angles = np.arange(n) * (2 * np.pi / n)
    order = np.random.default_rng(0).permutation(n)
    stored = spark.createDataFrame([(1, int(i), [float(np.cos(a)), float(np.sin(a))]) for i, a in zip(order, angles, strict=True)], VECTORS)
    found = consolidate.linked(groups(spark, [memory(i, "x") for i in range(n)]), stored, float(np.cos(1.5 * 2 * np.pi / n)))
    assert [tuple(r) for r in found.groupBy("cluster_id").count().collect()] == [(0, n)]


def test_unusable_vectors_and_widths(spark):
    vectors = {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [1.0, 0.0, 0.0], 4: [1.0, 0.0, 0.0], 5: [1.0, None], 6: None, 7: [], 8: [float("nan"), 1.0], 9: [1.0]}
    found = groups(spark, [memory(i, "x") for i in [*vectors, 10]])
    stored = spark.createDataFrame([(1, i, v) for i, v in vectors.items()], VECTORS)
    assert sorted((r.cluster_id, r.memory_id) for r in consolidate.linked(found, stored, 0.9).collect()) == [(1, 1), (1, 2), (3, 3), (3, 4)]
    assert sorted((r.a, r.b) for r in consolidate.similar(found, stored, 0.9).collect()) == [(1, 2), (3, 4)]
    assert consolidate.linked(found.limit(0), stored, 0.9).count() == 0


def test_listing_in_days(spark):
    rng = np.random.default_rng(1)
    rows = [memory(i, "x", user=int(rng.integers(1, 4)), created_at=NOW - dt.timedelta(hours=int(rng.integers(0, 60)))) for i in range(300)]
    rows += [memory(900, "gone", deleted_at=NOW), memory(901, "old", superseded_by=1)]
    table = spark.createDataFrame(rows, S.MEMORIES)
    want = {}
    for user in (1, 2, 3):
        own = sorted((r for r in table.collect() if r.user_id == user and r.memory_id not in (900, 901)), key=lambda r: (-r.created_at.timestamp(), r.memory_id))
        want |= {r.memory_id: i + 1 for i, r in enumerate(own)}
    listed = store.listing(table)
    assert listed.columns == [*table.columns, "position"]
    assert {r.memory_id: r.position for r in listed.collect()} == want
    assert {r.memory_id: r.position for r in store.listing(table, most=5).collect()} == {i: p for i, p in want.items() if p <= 5}
    assert store.listing(table, include_inactive=True).filter("memory_id = 901").count() == 1
    assert store.listing(table.limit(0)).count() == 0
    assert "_day" in store.listing(table)._jdf.queryExecution().toString()


def test_listing_without_a_time(spark):
    table = spark.createDataFrame([memory(1, "x"), memory(2, "y")], S.MEMORIES)
    table = table.withColumn("created_at", F.when(F.col("memory_id") == 1, F.lit(None)).otherwise(F.col("created_at")))
    assert {r.memory_id: r.position for r in store.listing(table).collect()} == {1: 2, 2: 1}
