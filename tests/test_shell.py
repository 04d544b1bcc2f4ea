"""Configuration, identity, rendered texts, reindexing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.functions import render
from mnemora.operators import identity
from mnemora.sources import config, store
from mnemora.streaming import schedule

from .test_recall import NOW, memory

TOKEN = "k_" + "0a" * 20


def test_config_layers_and_problems(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('recall_limit = 12\nschedule = "weekly"\nextra_categories = ["a.b"]\n')
    got = config.load(str(path), {"MNEMORA_RECALL_LIMIT": "20", "MNEMORA_HYBRID": "false", "OTHER": "x"})
    assert (got.recall_limit, got.schedule, got.hybrid, got.extra_categories, got.half_life_days) == (20, "weekly", False, ("a.b",), 90.0)
    with pytest.raises(ValueError, match="unknown setting zzz; group_cap cannot be 'x'; recall_limit must be 1 to 50; schedule must be"):
        config.load(None, {"MNEMORA_ZZZ": "1", "MNEMORA_GROUP_CAP": "x", "MNEMORA_RECALL_LIMIT": "99", "MNEMORA_SCHEDULE": "never"})


def test_identity(spark):
    at = F.lit(NOW).cast("timestamp_ntz")
    users = spark.createDataFrame([(1, "alex", None), (2, "sam", None)], "user_id long, handle string, email string")
    assert [r.handle for r in identity.directory(users).collect()] == ["alex", "sam"] and identity.by_handle(users, " ALEX ").count() == 1
    wanted = spark.createDataFrame([(" Alex", None), ("new.one", "a@b"), ("bad name", None), ("x", "@b")], "handle string, email string")
    assert sorted((r.handle, r.reject_reason) for r in identity.new_users(wanted, users).collect()) == [("alex", "handle is taken"), ("bad name", "bad handle"), ("new.one", None), ("x", "bad e-mail address")]
    keys = identity.issue(spark.createDataFrame([(1, TOKEN, "read,write"), (2, "nonsense", "read")], "user_id long, token string, scopes string"), "k_", at)
    assert keys.count() == 1 and "secret_hash" not in identity.keys_of(keys, 1).columns
    asked = spark.createDataFrame([(1, TOKEN), (2, "k_" + "0a" * 4 + "ff" * 16), (3, None), (4, "x")], "request_id long, token string")
    status = lambda k, s: {r.request_id: r.status for r in identity.authenticate(asked, k, users, "k_", s).collect()}
    assert status(keys, "read") == {1: 200, 2: 401, 3: 401, 4: 401} and status(keys, "admin")[1] == 403
    gone = identity.revoke(keys, ["0a0a0a0a"], at)
    assert status(gone, "read")[1] == 401 and identity.revoke(gone, ["0a0a0a0a"], at + F.expr("INTERVAL '1' DAY")).first().revoked_at == NOW
    used = identity.touched(keys, spark.createDataFrame([("0a0a0a0a", NOW)], "prefix string, at timestamp_ntz"))
    assert used.first().last_used_at == NOW


def test_texts(spark):
    rows = spark.createDataFrame([(1, 2, "decision", "b\nc", ["t"], 8, 0.5, NOW), (1, 1, "skill", "a", [], 9, 1.0, NOW)], "query_id long, position long, category string, content string, tags array<string>, memory_id long, score double, created_at timestamp_ntz")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    day = NOW.strftime("%Y-%m-%d")
    assert {r.query_id: r.text for r in render.recalled(rows, asked).collect()} == {1: f"1. [skill] a (saved {day}, score 1.00)\n2. [decision] b c (saved {day}, score 0.50, t)", 2: "Nothing is stored that matches."}
    left = spark.createDataFrame([(1, 3, "skill", "x\ny"), (1, 4, "skill", "z"), (2, None, None, None)], "id long, memory_id long, category string, content string")
    got = {r.id: r.text for r in render.saved(left, ["id"], True).collect()}
    assert got[1] == "Saved 2 memories\n- [skill] x y (id 3)\n- [skill] z (id 4)" and got[2].startswith("Nothing new")
    assert {r.id: r.text.split()[0] for r in render.distilled(left, ["id"]).collect()} == {1: "Kept", 2: "Nothing"}
    assert "Not deleted yet" in {r.id: r.text for r in render.forget_candidates(left, ["id"]).collect()}[1]
    assert [r[0] for r in spark.range(3).select(render.forgotten(F.col("id"))).collect()] == ["No memory was deleted.", "Deleted 1 memory.", "Deleted 2 memories."]


def test_schedule_and_time_budget(caplog):
    assert schedule.interval(" Daily ") == 86_400
    with pytest.raises(ValueError, match="hourly, daily, weekly"):
        schedule.interval("yearly")
    waits, runs = [], []

    def run():
        runs.append(len(waits))
        if len(runs) == 1:
            raise RuntimeError("a bad night")

    assert schedule.run_every("hourly", run, lambda s: (waits.append(s), len(waits) <= 3)[1]) == 3
    assert runs == [1, 2, 3] and set(waits) == {3600.0} and "failed" in caplog.text
    assert schedule.run_every("hourly", run, lambda s: True, enabled=False) == 0
    ticks = iter(range(0, 100, 10))
    assert schedule.in_batches(list("abcdef"), lambda b: None, 25, lambda: next(ticks)) == (3, "seconds")
    assert schedule.in_batches(list("ab"), lambda b: None, 0) == (2, None)


def test_command_line(spark, tmp_path, capsys):
    from mnemora.__main__ import main

    path = str(tmp_path / "v1")
    store.write_memories(spark.createDataFrame([memory(1, "uses pnpm"), memory(2, "lives in Rome")], S.MEMORIES), path, 1)
    store.point_to(spark, str(tmp_path / "now"), path)
    store.point_to(spark, str(tmp_path / "now"), path)
    for args in (["list", path], ["recall", str(tmp_path / "now"), "--pointer", "--text", "pnpm"], ["profile", path], ["export", path], ["export", path, "--format", "json"], ["consolidate", path]):
        main(args)
    out = capsys.readouterr().out
    assert "uses pnpm" in out and "# Memories of 1" in out and '{"memories":[' in out
    with pytest.raises(SystemExit, match="query is empty"):
        main(["recall", path])


def test_reindex(spark, tmp_path):
    rows = spark.createDataFrame([memory(1, "a"), memory(2, "b", superseded_by=1), memory(3, "c", deleted_at=NOW)], S.MEMORIES)
    made = store.reindex(rows, str(tmp_path / "v2"), lambda texts: np.ones((len(texts), 2)), "model", 2)
    assert sorted(r.memory_id for r in made.collect()) == [1, 2] and spark.read.json(str(tmp_path / "v2/pin")).first().model == "model"


def test_reindex_swaps_when_done(spark, tmp_path):
    rows = spark.createDataFrame([memory(1, "a")], S.MEMORIES)
    pointer = str(tmp_path / "now")
    store.point_to(spark, pointer, "old")
    with pytest.raises(Exception, match="broken"):
        store.reindex(rows, str(tmp_path / "v3"), lambda texts: exec("raise RuntimeError('broken')"), "model", 2, pointer)
    assert store.current_path(spark, pointer) == "old"
    store.reindex(rows, str(tmp_path / "v4"), lambda texts: np.ones((len(texts), 2)), "model", 2, pointer)
    assert store.current_path(spark, pointer) == str(tmp_path / "v4")


def test_baseline_round_trip(spark, tmp_path):
    report = spark.createDataFrame([("all", 3, 90.0, 50.0), ("k", 3, 90.0, 50.0)], "kind string, cases long, recall_at_k double, precision_at_1 double")
    store.write_baseline(report, str(tmp_path / "b.json"))
    assert {tuple(r) for r in store.read_baseline(spark, str(tmp_path / "b.json")).collect()} == {("all", 90.0), ("k", 90.0)}
