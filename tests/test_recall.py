"""Recall against plain Python on small data, and its invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.engine import Engine
from mnemora.operators import recall

NOW = dt.datetime(2024, 6, 1)


def memory(i, content, user=1, **over):
    row = {f.name: None for f in S.MEMORIES} | {"memory_id": i, "user_id": user, "content": content, "category": "preference.coding", "tags": [], "confidence": 1.0, "importance": 1.0, "access_count": 0, "created_at": NOW - dt.timedelta(days=1), "updated_at": NOW} | over
    return tuple(row[f.name] for f in S.MEMORIES)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        memory(1, "use useQuery for server state"),
        memory(2, "use useState for local state", tags=["react", "state"]),
        memory(3, "use useEffect sparingly", subcategory="hooks", category="decision"),
        memory(4, "useQuery of another user", user=2),
        memory(5, "useQuery deleted", deleted_at=NOW),
        memory(6, "useQuery superseded", superseded_by=1),
        memory(7, "useQuery expired", expires_at=NOW),
        memory(8, "twin text", created_at=NOW - dt.timedelta(days=5)),
        memory(9, "twin text", created_at=NOW - dt.timedelta(days=2)),
        memory(10, "twin text", created_at=NOW - dt.timedelta(days=2)),
        memory(11, "old but exact needle", created_at=NOW - dt.timedelta(days=4000)),
    ]
    return Engine.of(spark.createDataFrame(rows, S.MEMORIES), F.lit(NOW).cast("timestamp_ntz"))


def ask(spark, engine, text, user=1, k=8, **kinds):
    q = spark.createDataFrame([(1, user, text, k)], "query_id long, user_id long, text string, k long")
    return engine.recall(q, recall.Filters(**kinds) if kinds else None).orderBy("position").collect()


def test_exact_token_comes_first(spark, engine):
    got = ask(spark, engine, "useQuery")
    assert got[0].memory_id == 1 and got[0].keyword_rank is not None and got[0].vector_rank is not None
    assert {4, 5, 6, 7}.isdisjoint({r.memory_id for r in got})


def test_no_query_crosses_users(spark, engine):
    assert {r.memory_id for r in ask(spark, engine, "useQuery", user=2)} == {4}
    assert ask(spark, engine, "useQuery", user=3) == []


def test_superseded_and_expired_on_demand(spark, engine):
    got = {r.memory_id for r in ask(spark, engine, "useQuery", include_superseded=True)}
    assert {6, 7} <= got and 5 not in got


def test_filters(spark, engine):
    assert {r.memory_id for r in ask(spark, engine, "use", tags=("State ", "react"))} == {2}
    assert {r.memory_id for r in ask(spark, engine, "use", subcategories=("HOOKS",))} == {3}
    assert {r.memory_id for r in ask(spark, engine, "use", categories=("decision",))} == {3}
    assert {r.memory_id for r in ask(spark, engine, "twin", since="2024-05-29")} >= {9, 10} and 8 not in {r.memory_id for r in ask(spark, engine, "twin", since="2024-05-29")}


def test_filtering_keeps_ranks(spark, engine):
    every = {r.memory_id: (r.vector_rank, r.keyword_rank) for r in ask(spark, engine, "use state", k=50)}
    for r in ask(spark, engine, "use state", k=50, categories=("decision",)):
        assert every[r.memory_id] == (r.vector_rank, r.keyword_rank)


def test_ties_newest_then_id_and_limit(spark, engine):
    got = ask(spark, engine, "twin text")
    assert [(r.score, r.created_at, r.memory_id) for r in got] == sorted(((r.score, r.created_at, r.memory_id) for r in got), key=lambda x: (-x[0], -x[1].timestamp(), x[2]))
    place = {r.memory_id: r.position for r in got}
    assert place[9] < place[10] and len(ask(spark, engine, "twin text", k=2)) == 2


def test_old_exact_match_survives(spark, engine):
    assert ask(spark, engine, "needle")[0].memory_id == 11


def test_bad_queries_are_refused(spark, engine):
    q = spark.createDataFrame([(1, 1, " ", 8), (2, 1, "x" * 1001, 8), (3, 1, "use", 0)], "query_id long, user_id long, text string, k long")
    assert engine.recall(q).count() == 0
    assert {r.query_id: r.reject_reason for r in engine.checked(q).collect()} == {1: "query is empty", 2: "query is too long", 3: "limit must be at least 1"}


def test_large_batches_are_joined(spark, engine, monkeypatch):
    """Beyond the broadcast's size, with the same answers."""
    from mnemora.operators import recall

    columns = ["memory_id", "position", "vector_rank", "score"]
    here = [tuple(r[c] for c in columns) for r in ask(spark, engine, "use state twin")]
    monkeypatch.setattr(recall, "BROADCAST_BYTES", 0)
    assert [tuple(r[c] for c in columns) for r in ask(spark, engine, "use state twin")] == here


def test_updated_index(spark, engine, tmp_path):
    """After an edit, an addition and a removal the updated index answers as one that is built anew."""
    from mnemora.sources.index import Index, build, update

    build(engine.memories, str(tmp_path / "v1"), 2)
    changed = engine.memories.withColumn("content", F.when(F.col("memory_id") == 2, "something else entirely").otherwise(F.col("content"))).filter("memory_id <> 3")
    ids = spark.createDataFrame([(1, 2), (1, 3)], "user_id long, memory_id long")
    update(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), changed, ids, 2)
    build(changed, str(tmp_path / "v3"), 2)
    for name in ("vectors", "weights", "memories"):
        a, b = (sorted(map(str, getattr(Index.read(spark, str(tmp_path / v)), name).collect())) for v in ("v2", "v3"))
        assert a == b


def test_dead_keyword_leg_and_empty_store(spark, engine):
    q = spark.createDataFrame([(1, 1, "useQuery", 8)], "query_id long, user_id long, text string, k long")
    got = engine.recall(q, hybrid=False).collect()
    assert got and all(r.keyword_rank is None for r in got)
    empty = Engine.of(engine.memories.filter("false"), engine.now)
    assert empty.recall(q).count() == 0


def test_plan_keeps_filters_above_the_ranking(spark, engine):
    q = spark.createDataFrame([(1, 1, "use", 8)], "query_id long, user_id long, text string, k long")
    plan = engine.recall(q)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "WindowGroupLimit" in plan


def test_index_gives_the_same_answers(spark, engine, tmp_path):
    from mnemora.sources.index import Index, build

    build(engine.memories, str(tmp_path / "index"), 2)
    q = spark.createDataFrame([(1, 1, "useQuery state", 8), (2, 2, "useQuery", 8), (3, 1, "twin needle", 3)], "query_id long, user_id long, text string, k long")
    columns = ["query_id", "position", "memory_id", "score", "vector_rank", "keyword_rank"]
    want = sorted(engine.recall(q).select(*columns).collect())
    assert want == sorted(Index.read(spark, str(tmp_path / "index")).recall(q, engine.now).select(*columns).collect())
