"""Consolidation, events, reports, ingest, streaming and stores."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.engine import Engine
from mnemora.operators import consolidate, embedding, events, ingest, reports
from mnemora.sources import store
from mnemora.streaming import jobs

from .test_recall import NOW, memory

def at():
    return F.lit(NOW).cast("timestamp_ntz")


def frame(spark, rows):
    return spark.createDataFrame(rows, S.MEMORIES)


def links(spark, pairs):
    return spark.createDataFrame([(1, "c", "", a, b) for a, b in pairs], "user_id long, category string, sub string, a long, b long")


@pytest.mark.parametrize(("pairs", "want"), [([(1, 2)], {1: [1, 2]}), ([(1, 2), (2, 3), (3, 4)], {1: [1, 2, 3, 4]}), ([(5, 1), (5, 2), (5, 3)], {1: [1, 2, 3, 5]}), ([(1, 2), (8, 9)], {1: [1, 2], 8: [8, 9]}), ([(4, 4)], {})])
def test_cluster_shapes(spark, pairs, want):
    got = {}
    for r in consolidate.clusters(links(spark, pairs)).collect():
        got.setdefault(r.cluster_id, []).append(r.memory_id)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_plan_groups_and_watermarks(spark):
    same = "the user prefers pnpm over npm"
    rows = [memory(i, same, updated_at=NOW - dt.timedelta(days=i)) for i in range(1, 6)] + [memory(6, same, user=2), memory(7, same, category="decision"), memory(8, same, subcategory="x"), memory(9, same, deleted_at=NOW), memory(10, same, superseded_by=1)]
    engine = Engine.of(frame(spark, rows), at())
    none = spark.createDataFrame([], "user_id long, category string, sub string, recorded_at timestamp_ntz")
    marks, found = engine.plan(none)
    assert [tuple(r) for r in marks.select("user_id", "category", "sub", "size").collect()] == [(1, "preference.coding", "", 5)]
    assert sorted(r.memory_id for r in found.collect()) == [1, 2, 3, 4, 5]
    recorded = marks.select(*consolidate.GROUP, F.col("max_updated_at").alias("recorded_at"))
    assert engine.plan(recorded)[0].count() == 0
    touched = consolidate.record(marks, marks.select(*consolidate.GROUP), none)
    assert touched.count() == 0  # a failed group is tried again
    merged = consolidate.replacements(found, engine.memories, at()).first()
    assert (merged.retired, merged.confidence, merged.content) == (5, 1.0, same)
    kept = consolidate.replacements(found, engine.memories, at(), spark.createDataFrame([(1, True, None, None, None)], "cluster_id long, merge boolean, content string, category string, tags array<string>"))
    assert kept.count() == 0
    retired = events.merge_events(found.withColumn("replacement_id", F.lit(99)), engine.memories, at())
    assert retired.count() == 5


def test_maintain_and_run_summary(spark):
    rows = [memory(1, "a", expires_at=NOW), memory(2, "b", expires_at=NOW + dt.timedelta(1)), memory(3, "c", deleted_at=NOW, expires_at=NOW)]
    gone, live = consolidate.maintain(frame(spark, rows), at())
    assert [(r.memory_id, r.detail) for r in gone.collect()] == [(1, "expired on 2024-06-01")] and [r.memory_id for r in live.collect()] == [2]
    runs = spark.createDataFrame([(1, 10, 1, 3, False, None), (2, 5, 2, 2, True, "calls")], "run_id int, examined long, merged long, retired long, budget_hit boolean, reason string")
    got = consolidate.run_summary(runs).first()
    assert (got.summary, got.budget_hit, got.reason) == ("3 merged / 5 retired / 10 kept", True, "calls")


def test_fold_rules(spark):
    def e(i, seq, op, sets=(), by=None, **cols):
        own = {"content": None, "category": None, "subcategory": None, "confidence": None, "expires_at": None} | cols
        return (1, i, seq, NOW + dt.timedelta(hours=seq), op, list(sets), by, *own.values())

    log = [e(1, 0, "add", content="a", category="c"), e(1, 1, "update", ("content",), content="b", category="ignored"), e(1, 2, "delete"), e(1, 3, "delete"), e(1, 4, "update", ("content",), content="late"), e(1, 5, "access"), e(2, 0, "add", content="x"), e(2, 1, "supersede", by=7), e(2, 2, "merge", by=8), e(2, 3, "supersede", by=9), e(3, 1, "update", ("content",), content="never added")]
    schema = "user_id long, memory_id long, seq int, at timestamp_ntz, operation string, sets array<string>, superseded_by long, content string, category string, subcategory string, confidence double, expires_at timestamp_ntz"
    df = spark.createDataFrame(log, schema)
    got = {r.memory_id: r for r in events.fold(df).collect()}
    assert got.keys() == {1, 2}
    assert (got[1].content, got[1].category, got[1].deleted_at, got[1].updated_at, got[1].access_count) == ("b", "c", NOW + dt.timedelta(hours=2), NOW + dt.timedelta(hours=1), 1)
    assert got[2].superseded_by == 9
    trail = events.audit(df, 3).orderBy("position").collect()
    assert [r.operation for r in trail] == ["update", "delete", "supersede"] and len(trail) == 3
    changes = spark.createDataFrame([(1, 1, 9, ["content"], " a "), (1, 2, 9, ["content"], "new"), (2, 1, 9, ["content"], "foreign"), (1, 77, 9, ["content"], "unknown")], "user_id long, memory_id long, seq int, sets array<string>, content string")
    made = {r.memory_id: r.reembed for r in events.edits(frame(spark, [memory(1, "a"), memory(2, "b")]), changes, at()).collect()}
    assert made == {1: False, 2: True}


def test_profile_budget_and_isolation(spark):
    rows = [memory(i, f"preference {i} " + "x" * 700, confidence=1 - i / 100) for i in range(12)] + [memory(50, "short decision", category="decision", tags=["a", "b"]), memory(51, "own kind", category="custom.kind"), memory(60, "foreign", user=2)]
    users = spark.createDataFrame([(1, "alex"), (2, "sam"), (3, "new")], "user_id long, handle string")
    got = {r.user_id: r for r in reports.profile(frame(spark, rows), users, at()).collect()}
    assert len(got[1].text.encode()) <= S.PROFILE_BYTES + 120
    assert got[1].text.startswith("# Memory profile: alex (updated 2024-06-01)\n") and "short decision _(a, b)_" in got[1].text and "## other" in got[1].text
    assert got[1].included + got[1].omitted == 14 and "foreign" not in got[1].text and "foreign" in got[2].text
    assert "No memories stored yet" in got[3].text


def test_quality_metrics(spark):
    cases = spark.createDataFrame([("a", "x", ["1"]), ("b", "x", ["2", "3"]), ("c", "y", ["4"])], "name string, kind string, expect array<string>")
    results = spark.createDataFrame([("a", 1, "1"), ("b", 1, "9"), ("b", 2, "2")], "name string, position int, content string")
    per, by = reports.quality_metrics(results, cases)
    assert {r.name: (r.recall, r.top_hit, r.missed) for r in per.collect()} == {"a": (1.0, True, []), "b": (0.5, False, ["3"]), "c": (0.0, False, ["4"])}
    got = {r.kind: (r.cases, r.recall_at_k, r.precision_at_1) for r in by.collect()}
    assert got["x"] == (2, 75.0, 50.0) and got["all"] == (3, 50.0, pytest.approx(100 / 3))
    base = spark.createDataFrame([("x", 81.0), ("y", 4.0), ("z", 100.0)], "kind string, recall_at_k double")
    assert [r.kind for r in reports.regressions(by, base).collect()] == ["x"]


def test_salvage_and_decide(spark):
    assert ingest.salvage('text {"a": "}\\"{"} tail') == '{"a": "}\\"{"}'
    assert ingest.salvage('```json\n[1, {"b": 2}]\n```') == '[1, {"b": 2}]'
    assert [ingest.salvage(x) for x in (None, "", "none", "{ open")] == [None] * 4

    def ask(prompt):
        if prompt.startswith("down"):
            raise ConnectionError
        return '{"ok": 1}' if "not JSON" in prompt or prompt == "good" else "sorry"

    df = spark.createDataFrame([("good",), ("bad",), ("down",)], "p string")
    assert [r.answer for r in ingest.decide(df, ask, "p").collect()] == ['{"ok": 1}', '{"ok": 1}', None]


def test_candidates_and_decisions(spark):
    answers = spark.createDataFrame([(1, json.dumps({"candidates": [{"content": " a ", "category": "Fact.Person", "tags": ["X", "x "], "entities": [{"name": " Bo ", "type": "Person"}, {"name": " "}, {"name": "q"}], "confidence": 7}, 5, {"content": "x" * 4001}]})), (2, "not json"), (3, None), (4, '{"candidates": {}}')], "id int, answer string")
    got = ingest.candidates(answers, F.array(F.lit("Mine"))).orderBy("ordinal").collect()
    assert [(r.id, r.content[:2], r.category, r.exact, r.tags, r.confidence, r.reject_reason) for r in got] == [(1, "a", "fact.person", True, ["x", "mine"], 1.0, None), (1, "xx", "fact.project", False, ["mine"], 0.8, "content is too long")]
    assert [(e.name, e.kind) for e in got[0].entities] == [("Bo", "person"), ("q", "thing")]
    said = spark.createDataFrame([(1, '{"decisions":[{"action":"delete","memory_id":"m1"},{"action":"UPDATE","memory_id":"m2"},{"action":"update"}]}', ["m1", "m2"]), (2, "{}", []), (3, "[]", []), (4, '[{"action":"DELETE","memory_id":"zz"}]', ["m1"])], "id int, answer string, shown array<string>")
    done = {r.id: (r.stored, r.supersedes, r.deletes) for r in ingest.outcomes(ingest.decisions(said)).collect()}
    assert done == {1: (True, ["m2"], ["m1"]), 2: (True, [], []), 3: (False, [], []), 4: (False, [], [])}


def job(i, seq, event, error=None, minutes=0):
    return (i, seq, NOW + dt.timedelta(minutes=minutes or seq), event, error)


JOB_ROWS = [
    [job(1, 0, "enqueue"), job(1, 1, "claim"), job(1, 2, "succeed")],
    [job(2, 0, "enqueue"), job(2, 1, "claim"), job(2, 2, "fail", "internal")],
    [job(3, 0, "enqueue"), job(3, 1, "claim"), job(3, 2, "fail", "validation")],
    [job(4, 0, "enqueue"), *(x for n in range(3) for x in (job(4, 2 * n + 1, "claim"), job(4, 2 * n + 2, "fail", "conflict")))],
    [job(5, 0, "enqueue"), job(5, 1, "claim")],
]
WANT = {1: "succeeded", 2: "pending", 3: "dead_letter", 4: "dead_letter"}


def test_job_states(spark):
    log = spark.createDataFrame([x for r in JOB_ROWS for x in r], "job_id long, seq long, at timestamp_ntz, event string, error string")
    later = ingest.job_states(log, F.lit(NOW + dt.timedelta(minutes=60)).cast("timestamp_ntz"))
    got = {r.job_id: r for r in later.collect()}
    assert {k: got[k].status for k in WANT} == WANT and got[5].status == "pending"
    assert got[2].run_after == NOW + dt.timedelta(minutes=2, seconds=5) and got[4].attempts == 3
    soon = ingest.job_states(log, F.lit(NOW + dt.timedelta(minutes=3)).cast("timestamp_ntz"))
    assert {r.job_id: r.status for r in soon.collect()}[5] == "running"
    assert [r.job_id for r in ingest.claimable(later, F.lit(NOW + dt.timedelta(hours=9)).cast("timestamp_ntz"), 5).collect()] == [2, 5]  # a reclaimed job is due from the reclaim on


def test_job_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "job_id long, seq long, at timestamp_ntz, event string, error string"
    for n, rows in enumerate(JOB_ROWS):
        spark.createDataFrame(rows, schema).coalesce(1).orderBy("seq").write.parquet(f"{source}/p{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{source}/*")
    q = jobs.job_stream(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.job_id: r.status for r in spark.table("job_states").collect()}
    assert got == WANT | {5: "running"}


def test_events_of_a_batch_by_number(spark, tmp_path):
    """A claim that is read after its success does not reopen the job; a failure is due again after its wait; old events change nothing."""
    at = lambda m: NOW + dt.timedelta(minutes=m)
    rows = [(1, 2, at(2), "succeed", None), (1, 1, at(1), "claim", None), (1, 0, at(0), "enqueue", None), (2, 2, at(5), "fail", "internal"), (2, 1, at(1), "claim", None), (2, 0, at(0), "enqueue", None)]
    schema = "job_id long, seq long, at timestamp_ntz, event string, error string"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/p0")
    spark.createDataFrame([(1, 1, at(9), "claim", None)], schema).coalesce(1).write.parquet(f"{source}/p1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    q = jobs.job_stream(stream).writeStream.outputMode("update").format("memory").queryName("job_order").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("job_order").collect()
    assert {(r.job_id, r.status, r.attempts) for r in got} == {(1, "succeeded", 1), (2, "pending", 1)}
    assert [r.run_after for r in got if r.job_id == 2] == [at(5) + dt.timedelta(seconds=5)]


def test_ingest_stream(spark, tmp_path):
    rows = [(1, " We decided x ", "", ["A"]), (2, " ", "", []), (3, "y", "skill", None)]
    spark.createDataFrame(rows, "id long, content string, category string, tags array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, content string, category string, tags array<string>").parquet(str(tmp_path / "in"))
    q = jobs.ingest_stream(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck"), jobs_path=str(tmp_path / "jobs"))
    q.awaitTermination(120)
    assert {r.id: r.category for r in spark.read.parquet(str(tmp_path / "good")).collect()} == {1: "decision", 3: "skill"}
    assert [r.reject_reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["content is empty"]
    done = ingest.job_states(spark.read.parquet(str(tmp_path / "jobs")).drop("batch"), F.current_timestamp().cast("timestamp_ntz"))
    assert {r.job_id: r.status for r in done.collect()} == {1: "succeeded", 2: "dead_letter", 3: "succeeded"}


def test_store_round_trip(spark, tmp_path):
    rows = frame(spark, [memory(i, f"m{i}", user=i % 3) for i in range(20)])
    path, pointer = str(tmp_path / "v1"), str(tmp_path / "now")
    store.write_memories(rows, path, 3)
    store.point_to(spark, pointer, path)
    back = store.read_memories(spark, store.current_path(spark, pointer))
    assert sorted(back.collect()) == sorted(rows.collect())
    assert store.find(back, 1, 4).count() == 1 and store.find(back, 2, 4).count() == 0
    ids = spark.createDataFrame([(1, 4), (1, 4), (2, 4), (0, 999)], "user_id long, memory_id long")
    assert store.find_many(back, ids).count() == 1
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "u int, s string, v string")
    new = spark.createDataFrame([(1, None, "c"), (3, "y", "d")], "u int, s string, v string")
    assert sorted((r.u, r.v) for r in store.upsert(old, new, ["u", "s"]).collect()) == [(1, "c"), (2, "b"), (3, "d")]
    store.export(rows, str(tmp_path / "json"), "json")
    store.export(rows, str(tmp_path / "md"), "markdown")
    assert len([json.loads(r.value)["id"] for r in spark.read.parquet(str(tmp_path / "json")).collect()]) == 20
    assert spark.read.parquet(str(tmp_path / "md")).filter("value like '- m%'").count() == 20
    with pytest.raises(ValueError, match="unknown export"):
        store.export(rows, str(tmp_path / "x"), "xml")


def test_cases_file(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[[memory]]\ncontent = "a"\ncategory = "decision"\ntags = ["t"]\n[[case]]\nname = "n"\nkind = "k"\nquery = "a"\nexpect = ["a"]\n')
    (tmp_path / "b.json").write_text('{"recall_at_k": 90.0, "by_kind": {"k": 80.0}}')
    seeds, cases = store.read_cases(spark, str(tmp_path / "c.toml"))
    assert seeds.first().content == "a" and cases.first().expect == ["a"]
    assert {r.kind: r.recall_at_k for r in store.read_baseline(spark, str(tmp_path / "b.json")).collect()} == {"all": 90.0, "k": 80.0}


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "Pnpm, pnpm!"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in embedding.hash_embed(df, ["id"], "text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and got[2] == [0.0] * 64 == got[3]
    made = embedding.model_embed(df, "text", lambda t: np.ones((len(t), 3)), 3).collect()
    assert made[2].embedding == [1.0] * 3
    with pytest.raises(Exception, match="the model returned"):
        embedding.model_embed(df, "text", lambda t: np.ones((1, 2)), 3).collect()
    pins = spark.createDataFrame([("m", 3)], "model string, dimensions int")
    embedding.check_pins(pins, "m", 3)
    with pytest.raises(ValueError, match="pinned"):
        embedding.check_pins(pins, "m", 4)


def test_transcripts(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "z" * 200_001)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in consolidate.transcripts(turns).collect()}
    assert got[1].transcript == "user: a\nassistant: b" and got[1].reject_reason is None and got[2].reject_reason == "transcript is too long"
