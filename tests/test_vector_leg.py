"""The vector leg against brute force: odd vectors, hot users, large batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import recall

QUERY = "query_id long, user_id long, depth long, embedding array<double>"
VECTOR = "user_id long, memory_id long, embedding array<double>"


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(queries, vectors):
    out = set()
    for q, user, depth, y in queries:
        near = sorted((round(math.dist(x, y), 12), i) for u, i, x in vectors if u == user and fine(x) and fine(y) and len(x) == len(y))
        out |= {(q, user, i, rank) for rank, (_, i) in enumerate(near[:depth], 1)}
    return out


def answer(spark, queries, vectors):
    got = recall.vector_leg(spark.createDataFrame(queries, QUERY), spark.createDataFrame(vectors, VECTOR).repartition(4))
    return {(r.query_id, r.user_id, r.memory_id, r.vector_rank) for r in got.collect()}


def rows(rng, n, user, first=0, width=5):
    return [(user, first + i, rng.integers(-3, 4, width).astype(float).tolist()) for i in range(n)]


ODD = [(1, 900, None), (1, 901, []), (1, 902, [1.0, None, 0.0, 0.0, 0.0]), (1, 903, [math.nan] * 5), (1, 904, [math.inf, 0.0, 0.0, 0.0, 0.0]), (1, 905, [0.0] * 4), (1, 906, [0.0] * 5), (9, 907, [0.0] * 5)]


@pytest.mark.parametrize("memories,asking", [(16_384, 1024), (16, 3), (1, 1)])
def test_same_rows_whatever_the_tiles(spark, monkeypatch, memories, asking):
    for name, value in (("TILE_ROWS", memories), ("TILE_QUERIES", asking), ("PARTS", 10**6)):
        monkeypatch.setattr(recall, name, value)
    rng = np.random.default_rng(1)
    vectors = rows(rng, 60, 1) + rows(rng, 7, 2, 100) + rows(rng, 5, 1, 200, 4) + ODD
    queries = [(i, 1 + i % 2, 1 + i % 9, rng.normal(size=5).tolist()) for i in range(12)]
    queries += [(50, 1, 4, None), (51, 1, 4, [math.nan] * 5), (52, 1, 4, [0.0, 1.0, 0.0, 2.0]), (53, 8, 4, [0.0] * 5), (54, 1, 4, [])]
    assert answer(spark, queries, vectors) == brute(queries, vectors)


def test_large_batches_shuffle_their_users(spark, monkeypatch):
    monkeypatch.setattr(recall, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(2)
    vectors, queries = [v for u in range(20) for v in rows(rng, 4, u, 10 * u)], [(u, u, 3, [0.0] * 5) for u in range(20)]
    assert answer(spark, queries, vectors) == brute(queries, vectors)


def test_a_hot_user_fills_many_tiles(spark, monkeypatch):
    """One user has 90 per cent of the memories; no tile holds much more than its share."""
    monkeypatch.setattr(recall, "TILE_ROWS", 50)
    users = spark.range(2000).select(F.when(F.col("id") < 1800, 1).otherwise(F.col("id")).cast("long").alias("user_id"))
    asked = spark.createDataFrame([(1, 1), (2, 1900)], "query_id long, user_id long")
    deal, n = recall.tiles(asked, users)
    assert n == 2 and {r.user_id: (r.memory_parts, r.query_parts) for r in deal.collect()} == {1: (36, 1), 1900: (1, 1)}


def test_nothing(spark):
    assert answer(spark, [], []) == set()
    assert answer(spark, [(1, 1, 3, [0.0])], []) == set()


def test_knn_with_copies(spark, tmp_path):
    """A query's own row is never among its five, whether more copies than that come before it or not."""
    from mnemora.plans.queries import knn_l2

    rows = [(i, i % 2, [1.0, 2.0] if i in (2, 4, 6, 8, 10, 12, 20, 22) else [float(i), float(i % 7)]) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    expected = set()
    for q, label, y in rows:
        if q % 20 == 0:
            near = sorted((round(math.dist(x, y), 12), i) for i, other, x in rows if other == label and i != q)
            expected |= {(q, i, rank, round(distance, 9)) for rank, (distance, i) in enumerate(near[:5], 1)}
    assert {tuple(r) for r in knn_l2(spark, str(tmp_path)).select("query_id", "vec_id", "rank", "distance").collect()} == expected


def test_words_are_hashed_in_slices():
    """A batch of long texts is hashed a bounded number of words at a time, with the same vectors."""
    import pyarrow as pa

    from mnemora.operators import embedding

    words = pa.array([["a", "b"], None, [], ["c"] * 9, ["a"], ["b", "c", "d"], []])
    parts = list(embedding.sliced(words, 4))
    assert pa.chunked_array(parts).to_pylist() == words.to_pylist()
    assert all(len(p) == 1 or sum(len(w or []) for w in p.to_pylist()) <= 4 for p in parts) and len(parts) > 2
    assert (np.concatenate([embedding.hashed(p, 64) for p in parts]) == embedding.hashed(words, 64)).all()


def test_json_export_gathers_no_document(spark):
    """No task holds a user's whole export to count its memories."""
    from mnemora.plans.queries import export_json
    from mnemora.plans.service import export_json_lines

    for made in (export_json(spark, "/root/testdata/sf0.001"), export_json_lines(spark, "/root/testdata/sf0.001")):
        assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()


def test_json_lines_deal_no_texts_by_user(spark):
    """No exchange by user alone carries the objects of an export, of which one user may have most."""
    from mnemora.operators import reports
    from mnemora.plans import fixtures as X
    from mnemora.plans.queries import users

    sf = "/root/testdata/sf0.001"
    lines = reports.document_lines(X.memories(spark, sf), users(spark, sf), "json")
    assert lines.filter("part = 1").count() == X.memories(spark, sf).filter("deleted_at IS NULL AND superseded_by IS NULL").count()

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    plan = lines._jdf.queryExecution().sparkPlan()
    joins = [n for n in nodes(plan) if "Join" in n.nodeName()]
    assert joins
    for n in joins:
        if n.leftKeys().size() == 1:
            assert "json" not in n.children().apply(0).output().toString(), n.toString()
