"""Ingest with a stand-in for a model: order within a batch, failures, resuming."""

import json

import numpy as np
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.engine import Engine
from mnemora.operators import recall, reconcile

from .test_recall import NOW, memory

PAYLOAD = "id long, user_id long, content string, tags array<string>"


def stand_in(folder=None):
    """Draws a candidate from each line; a fact that begins with a stored one's first word replaces it, with ``not`` before it refutes it."""

    def ask(prompt):
        if folder:
            with open(f"{folder}/asked", "a") as f:
                f.write("x")
        if "broken" in prompt.split("\n\nAnswer")[0].split("Stored memories")[0]:
            raise RuntimeError("no answer")
        if not prompt.startswith("New fact: "):
            lines = prompt.split("\n\n", 1)[1].rsplit("\n\n", 1)[0].split("\n")
            return json.dumps({"candidates": [{"content": x, "category": "decision"} for x in lines]})
        fact, *stored = [x for x in prompt.split("\n\nIs it")[0].split("\n") if not x.startswith("Stored")]
        words = fact.removeprefix("New fact: ").split()
        refutes = words[0] == "not"
        said = []
        for line in stored:
            number, _, text = line.removeprefix("- ").partition(": ")
            if text.split()[0] == words[refutes]:
                said.append({"action": "DELETE" if refutes else "UPDATE", "memory_id": number})
        return json.dumps({"decisions": said or [{"action": "NOOP" if refutes else "ADD"}]})

    return ask


def engine_of(spark, rows):
    return Engine.of(spark.createDataFrame(rows, S.MEMORIES), F.lit(NOW).cast("timestamp_ntz"))


def run(spark, tmp_path, rows, payloads, **kinds):
    engine = engine_of(spark, rows)
    settled, failed = engine.ingest(spark.createDataFrame(payloads, PAYLOAD), kinds.pop("ask", stand_in()), str(tmp_path / "run"), F.col("payload") * 10 + F.col("ordinal"), **kinds)
    state = {r.memory_id: (r.content, r.superseded_by, r.deleted_at is not None) for r in engine.after(settled).memories.collect()}
    return settled, failed, state


def test_later_candidates_see_earlier_ones(spark, tmp_path):
    """The second candidate replaces what the first has just stored; one of another user does not."""
    settled, _, state = run(spark, tmp_path, [memory(1, "editor is vim")], [(1, 1, "editor is emacs\neditor is nano", ["Mine"]), (2, 1, "editor is ed\nnot editor is ed", None), (3, 2, "editor is pico", None)])
    assert state == {1: ("editor is vim", 10, False), 10: ("editor is emacs", 11, False), 11: ("editor is nano", 20, False), 20: ("editor is ed", None, True), 30: ("editor is pico", None, False)}
    assert {r.memory_id: r.tags for r in settled.added.collect()}[10] == ["mine"]
    log = sorted((r.memory_id, r.seq, r.operation, r.superseded_by) for r in settled.events.collect())
    assert [x[2:] for x in log] == [("supersede", 10), ("add", None), ("supersede", 11), ("add", None), ("supersede", 20), ("add", None), ("delete", None), ("add", None)]
    assert settled.pending.isEmpty() and settled.rejected.isEmpty() and settled.failed.isEmpty()


def test_the_fold_of_the_events_is_the_state(spark, tmp_path):
    from mnemora.operators import events

    settled, _, state = run(spark, tmp_path, [], [(1, 1, "a one\na two\nb three\nnot a two", None)], alike=0.3)
    folded = {r.memory_id: (r.content, r.superseded_by, r.deleted_at is not None) for r in events.fold(settled.events).collect()}
    assert folded == state == {10: ("a one", 11, False), 11: ("a two", None, True), 12: ("b three", None, False)}


def test_one_target_two_claims(spark, tmp_path):
    """Unlike candidates of one round that touch one memory: the first has it, the other is asked again."""
    settled, _, state = run(spark, tmp_path, [memory(1, "car red")], [(1, 1, "car blue suede shoes galore everywhere\ncar zebra quick jumps lazy dogs", None)], alike=0.95)
    assert state[1][1] == 10 and state[10][1] == 11 and {r.memory_id: r.round for r in settled.done.collect()} == {10: 1, 11: 2}


def test_failures_are_their_own(spark, tmp_path):
    """A payload or a candidate that a model cannot answer leaves the others as they are."""
    settled, failed, state = run(spark, tmp_path, [memory(1, "x y")], [(1, 1, "x broken", None), (2, 1, "fine words", None), (3, 2, "other words", None), (4, 2, " ", None)])
    assert [r.payload for r in failed.collect()] == [1] and set(state) == {1, 20, 30}
    engine = engine_of(spark, [memory(1, "x y")])

    def half(prompt):
        if prompt.startswith("New fact: x"):
            raise RuntimeError("no answer")
        return stand_in()(prompt)

    settled, _ = engine.ingest(spark.createDataFrame([(1, 1, "x y z\nq r s", None)], PAYLOAD), half, str(tmp_path / "other"), F.col("payload") * 10 + F.col("ordinal"))
    assert [r.content for r in settled.failed.collect()] == ["x y z"] and [r.content for r in settled.added.collect()] == ["q r s"]


def test_rejected_and_pending(spark, tmp_path):
    settled, _, state = run(spark, tmp_path, [], [(1, 1, "\n".join(f"word{i} is here" for i in range(5)) + "\n" + "x" * 4001, None)], batch=3, alike=2.0)
    assert [r.reject_reason for r in settled.rejected.collect()] == ["content is too long"]
    assert sorted(r.memory_id for r in settled.pending.collect()) == [13, 14] and set(state) == {10, 11, 12}
    settled, _, state = run(spark, tmp_path / "b", [], [(1, 1, "a b\na b\na b", None)], rounds=2)
    assert len(state) == 2 and settled.pending.count() == 1


def test_a_run_goes_on(spark, tmp_path):
    """On the same path nothing is asked twice."""
    payloads = [(1, 1, "a b\na c", None)]
    first = run(spark, tmp_path, [], payloads, ask=stand_in(tmp_path))[2]
    asked = (tmp_path / "asked").read_text()
    assert run(spark, tmp_path, [], payloads, ask=stand_in(tmp_path))[2] == first and (tmp_path / "asked").read_text() == asked


def test_a_round_holds_only_those_who_wait(spark, tmp_path):
    """A user who is settled is in no later round."""
    run(spark, tmp_path, [memory(1, "x y"), memory(2, "q r", user=2)], [(1, 1, "a b\na c\na d", None), (2, 2, "z w", None)], alike=0.3)
    kept = lambda n: {r.user_id for r in spark.read.parquet(str(tmp_path / "run" / f"round={n}" / "memories")).collect()}
    assert (kept(1), kept(2), kept(3)) == ({1}, {1}, set())


def test_marks_are_not_broadcast(spark, tmp_path):
    settled, _, _ = run(spark, tmp_path, [memory(1, "a b")], [(1, 1, "a c", None)])
    made = engine_of(spark, [memory(1, "a b")]).after(settled).memories
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_ids_belong_to_users(spark, tmp_path):
    """Payloads and candidates of two users under the same ids do not meet."""
    settled, _, _ = run(spark, tmp_path, [memory(1, "car pink"), memory(2, "boat old", user=2)], [(1, 1, "car red", ["Mine"]), (1, 2, "boat new\nsun", None)])
    assert sorted((r.user_id, r.memory_id, r.content, r.tags) for r in settled.added.collect()) == [(1, 10, "car red", ["mine"]), (2, 10, "boat new", []), (2, 11, "sun", [])]
    assert sorted((r.user_id, r.memory_id, r.status, r.supersedes) for r in settled.done.collect()) == [(1, 10, "stored", [1]), (2, 10, "stored", [2]), (2, 11, "stored", [])]


def plans_of(monkeypatch):
    """Plans of all that an ingest writes from now on, by their path's end."""
    was, seen = reconcile.written, {}

    def written(rows, path):
        seen[path.split("run/")[1]] = rows._jdf.queryExecution().executedPlan().toString()
        return was(rows, path)

    monkeypatch.setattr(reconcile, "written", written)
    return seen


CHAINS = [(1, 1, "car red\ncar blue\nnot car blue\ncar green", None), (2, 2, "car old\nboat new", None), (3, 3, "sun", None)]


def test_a_large_round_broadcasts_nothing(spark, tmp_path, monkeypatch):
    """Beyond what is small no join of a round goes through the driver, however small its files are."""
    rows = [memory(1, "car pink"), memory(2, "boat", user=2)]
    expected = run(spark, tmp_path / "small", rows, CHAINS, alike=0.3)[2]
    monkeypatch.setattr(reconcile, "ROUND_BYTES", -1, raising=False)
    monkeypatch.setattr(recall, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(recall, "BROADCAST_ROWS", -1)
    seen = plans_of(monkeypatch)
    assert run(spark, tmp_path / "large", rows, CHAINS, alike=0.3)[2] == expected
    assert "round=4/answers" in seen and not [at for at, plan in seen.items() if "BroadcastExchange" in plan]


def test_a_small_round_is_one_task(spark, tmp_path, monkeypatch):
    """The driver keeps no query stages of it, and the session's settings are as before."""
    names = ["spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.maxSinglePartitionBytes", "spark.sql.autoBroadcastJoinThreshold"]
    before, seen = [spark.conf.get(k, None) for k in names], plans_of(monkeypatch)
    run(spark, tmp_path, [memory(1, "car pink")], CHAINS, alike=0.3)
    own = [plan for at, plan in seen.items() if at.startswith("round=")]
    assert len(own) == 12 and not [p for p in own if "AdaptiveSparkPlan" in p] and max(p.count("Exchange hashpartitioning") for p in own) <= 3
    assert [spark.conf.get(k, None) for k in names] == before


def test_nothing(spark, tmp_path):
    settled, failed, state = run(spark, tmp_path, [], [])
    assert settled.done.isEmpty() and settled.events.isEmpty() and failed.isEmpty() and not state


def test_levels():
    x = np.array([[1, 0], [0, 1], [1, 0.01], [0, 0], [1, 0], [0, 2.0]])
    assert reconcile.levels(x, 0.9).tolist() == [1, 1, 2, 1, 3, 2]
