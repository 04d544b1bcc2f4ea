"""Commits under one pointer; consolidation runs that spare other users."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.operators import run, embedding
from mnemora.sources import segments
from mnemora.sources.collection import Collection

from .test_recall import NOW, memory

STATE = "user_id long, category string, sub string, recorded_at timestamp_ntz"


def at():
    return F.lit(NOW).cast("timestamp_ntz")


def added(spark, rows):
    """Add events of memories."""
    df = spark.createDataFrame(rows, S.MEMORIES)
    null = lambda t: F.lit(None).cast(t)
    return df.select("user_id", "memory_id", F.lit(0).cast("long").alias("seq"), F.col("created_at").alias("at"), F.lit("add").alias("operation"), F.array().cast("array<string>").alias("sets"), null("long").alias("superseded_by"), "content", "category", "subcategory", "confidence", "tags", "expires_at")


def vectors_of(df):
    return embedding.hash_embed(df.select("user_id", "memory_id", "content"), ["user_id", "memory_id"], "content")


def twins():
    rows = [memory(1, "same words here", tags=["a"]), memory(2, "same words here", tags=["b"]), memory(3, "quite other things"), memory(4, "gone by now", expires_at=NOW - dt.timedelta(hours=1))]
    return rows + [memory(i, "the second user's words", user=2) for i in (11, 12)] + [memory(i, "a third one's words", user=3) for i in (21, 22)]


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    held = Collection(spark, path)
    assert held.memories().count() == 0 and held.marks().count() == 0
    assert held.commit(0, added(spark, twins()[:4]))
    done = run.consolidation(held.memories(), held.index().vectors, at(), held.marks(), None, str(tmp_path / "run"), 0.99, name=F.lit(100).cast("long"))

    def broken(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(segments.Segments, "update", broken)
        with pytest.raises(RuntimeError, match="lost"):
            held.commit(1, done.events, done.marks)
    see = lambda: {r.memory_id: (r.superseded_by, r.deleted_at is not None, tuple(r.tags or ())) for r in Collection(spark, path).memories().collect()}
    before = {1: (None, False, ("a",)), 2: (None, False, ("b",)), 3: (None, False, ()), 4: (None, True, ())}
    assert {k: v[0] for k, v in see().items()} == dict.fromkeys((1, 2, 3, 4)) and Collection(spark, path).index().memories.count() == 4
    assert held.commit(1, done.events, done.marks) and not held.commit(1, done.events, done.marks)
    after = before | {1: (100, False, ("a",)), 2: (100, False, ("b",)), 100: (None, False, ("a", "b"))}
    assert see() == after
    index = Collection(spark, path).index()
    assert sorted((r.memory_id, r.superseded_by) for r in index.memories.collect()) == [(1, 100), (2, 100), (3, None), (100, None)]
    assert index.vectors.count() == 4 and held.marks().count() == 1
    held.tidy(most=1, dead_share=0.1)
    assert see() == after and len(held.version().segments) == 1
    q = spark.createDataFrame([(1, 1, "same words", 8)], "query_id long, user_id long, text string, k long")
    assert [r.memory_id for r in held.engine(at()).recall(q).collect()][0] == 100
    again = run.consolidation(held.memories(), held.index().vectors, at(), held.marks(), None, str(tmp_path / "run2"), 0.99)
    assert again.events.filter("operation <> 'delete'").isEmpty()  # nothing has changed since


def test_one_users_rows_spoil_nobody_elses_run(spark, tmp_path):
    df = spark.createDataFrame(twins(), S.MEMORIES)
    good = vectors_of(df)
    state = spark.createDataFrame([], STATE)
    odd = good.withColumn("embedding", F.when(F.col("memory_id") == 11, F.array(F.lit(float("nan")))).when(F.col("memory_id") == 21, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    clean = run.consolidation(df, good, at(), state, None, str(tmp_path / "a"), 0.99, name=F.col("cluster_id") + 1000)
    spoilt = run.consolidation(df, odd, at(), state, None, str(tmp_path / "b"), 0.99, name=F.col("cluster_id") + 1000)
    of = lambda r, u: sorted(map(str, r.events.filter(F.col("user_id") == u).collect())) + sorted(map(str, r.marks.filter(F.col("user_id") == u).collect()))
    assert of(clean, 1) == of(spoilt, 1) and of(clean, 2) and not of(spoilt, 2) and not of(spoilt, 3)
    got = {r.user_id: (r.status, r.reason) for r in spoilt.outcomes.collect()}
    assert got == {1: ("processed", None), 2: ("failed", "1 memories without a usable vector"), 3: ("failed", "vectors of several widths")}


def test_failed_answers_and_budgets_are_not_recorded(spark, tmp_path):
    df = spark.createDataFrame(twins(), S.MEMORIES)
    state = spark.createDataFrame([], STATE)

    def ask(prompt):
        if "second" in prompt:
            raise RuntimeError("no answer")
        return json.dumps({"merge": "third" not in prompt, "content": "merged words", "tags": ["m"], "reason": "r"})

    done = run.consolidation(df, vectors_of(df), at(), state, ask, str(tmp_path / "a"), 0.99, name=F.col("cluster_id") + 1000)
    assert {r.user_id: (r.status, r.reason, r.clusters, r.merged, r.retired) for r in done.outcomes.collect()} == {1: ("processed", None, 1, 1, 2), 2: ("failed", "the model did not answer", 1, 0, 0), 3: ("processed", None, 1, 0, 0)}
    assert {r.user_id for r in done.marks.collect()} == {1, 3}
    assert sorted((r.memory_id, r.operation, r.superseded_by) for r in done.events.collect()) == [(1, "merge", 1001), (2, "merge", 1001), (4, "delete", None), (1001, "add", None)]
    done = run.consolidation(df, vectors_of(df), at(), state, ask, str(tmp_path / "b"), 0.99, max_retired=1, max_calls=1)
    assert {r.status for r in done.outcomes.collect()} <= {"processed", "failed"}


def test_large_segments_are_several_files(spark, tmp_path):
    """No table of a segment is made by one task, whatever its size: with small partitions left apart each table has several files."""
    from mnemora.plans import fixtures as X
    from mnemora.sources.segments import LAYOUT, Segments

    index, rows = Segments(spark, str(tmp_path)), X.memories(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in range(2):
            index.update(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table in LAYOUT:
        assert len(list((tmp_path / table / "segment=1").glob("*.parquet"))) > 1, table
    assert index.memories.count() == rows.filter("deleted_at IS NULL").count()
