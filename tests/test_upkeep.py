"""What is kept up to date: the folded log, the segmented index, jobs on timers, JSON in replies."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.engine import Engine
from mnemora.operators import events, ingest
from mnemora.sources.log import EventLog
from mnemora.sources.segments import Segments
from mnemora.streaming import timers

from .test_recall import NOW, memory

EVENT = "user_id long, memory_id long, seq int, at timestamp_ntz, operation string, sets array<string>, superseded_by long, content string, category string, subcategory string, confidence double, expires_at timestamp_ntz"


def history(r, n=400):
    """Random events of 30 memories, in order of time."""
    rows, added = [], set()
    for i in range(n):
        key = (r.randint(1, 2), r.randint(1, 15))
        kind = r.choice(["add", "update", "update", "delete", "supersede", "merge", "access"]) if key in added or r.random() < 0.1 else "add"
        added.add(key)
        sets = r.sample(["content", "category", "expires_at"], r.randint(0, 3)) if kind == "update" else []
        rows.append((*key, r.randint(0, 3), NOW + dt.timedelta(minutes=i // 3), kind, sets, r.randint(50, 60), f"c{i}", r.choice("abc"), None, i / n, NOW if i % 2 else None))
    return rows


def shown(df):
    return sorted(str({c: r[c] for c in sorted(df.columns)}) for r in df.collect())


@pytest.mark.parametrize("late", [False, True])
def test_state_and_tail_equal_the_whole_fold(spark, tmp_path, late):
    r = random.Random(7)
    rows = history(r)
    cuts = [rows[:150], rows[150:220], rows[220:]]
    if late:
        r.shuffle(rows)
        cuts = [rows[:150], rows[150:220], rows[220:]]
    want = shown(events.fold(spark.createDataFrame(rows, EVENT)))
    log = EventLog(spark, str(tmp_path / "log"))
    for n, part in enumerate(cuts):
        log.append(spark.createDataFrame(part, EVENT), n)
        log.append(spark.createDataFrame(part, EVENT), n)  # again: nothing is stored twice
        if n == 0:
            log.compact(0)
    assert shown(log.current()) == want
    log.compact(1)
    assert shown(log.current()) == want and log.upto() == 1
    with pytest.raises(ValueError, match="part of the state"):
        log.append(spark.createDataFrame(cuts[0], EVENT), 1)
    log.compact(2)
    assert shown(log.current()) == want


def test_only_the_tail_is_read(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    rows = history(random.Random(1), 90)
    for n in range(3):
        log.append(spark.createDataFrame(rows[30 * n : 30 * n + 30], EVENT), n)
    log.compact(1)
    plan = log.current()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "/log/log]" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^]]*batch#\d+ > 1", line) for line in scans)


def test_segments_answer_as_a_new_index(spark, tmp_path):
    r = random.Random(2)
    words = "pnpm state query hook deploy twin needle cache index token".split()
    rows = {i: memory(i, " ".join(r.choices(words, k=r.randint(1, 6))), user=1 + i % 2, tags=[r.choice(words)]) for i in range(1, 25)}
    frame = lambda ids: spark.createDataFrame([rows[i] for i in ids], S.MEMORIES)
    asked = spark.createDataFrame([(1, 1, "pnpm state hook", 8), (2, 2, "deploy twin", 5), (3, 1, "cache", 50), (4, 9, "cache", 5)], "query_id long, user_id long, text string, k long")
    now = F.lit(NOW).cast("timestamp_ntz")
    columns = ["query_id", "position", "memory_id", "score", "vector_rank", "keyword_rank"]

    def same(index):
        want = Engine.of(frame(sorted(rows)), now).recall(asked)
        assert sorted(index.recall(asked, now).select(*columns).collect()) == sorted(want.select(*columns).collect())

    index = Segments(spark, str(tmp_path / "index"))
    index.update(frame(sorted(rows)))
    for i in (3, 4, 5):
        rows[i] = memory(i, "needle " * i, user=1 + i % 2)
    rows[30] = memory(30, "a new pnpm state", user=1)
    n = index.update(frame([3, 4, 5, 30]))
    assert index.rows("vectors", [n]).count() == 4 == index.rows("memories", [n]).count()  # writes follow the change
    gone = spark.createDataFrame([(1, 2), (1, 30)], "user_id long, memory_id long")
    del rows[2], rows[30]
    index.update(frame([1]).filter("false"), gone)
    same(index)
    rows[3] = memory(3, "cache cache", user=2)
    index.update(frame([3]))
    assert index.sizes()[0] == (24, 20) and index.compact(most=1) == [2, 3] and len(index.names()) == 3
    same(index)
    assert index.compact(dead_share=0.1) and len(index.names()) == 1 and index.rows("dead").isEmpty()
    same(index)


JOB = "job_id long, seq long, at timestamp_ntz, event string, error string"


def test_timers_fire(spark, tmp_path):
    """Without any new event a failed job comes due and a silent worker loses its job; a finished job leaves the state."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.with_timers(spark)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    at = lambda s: now + dt.timedelta(seconds=s)
    rows = [(1, 0, at(-9), "enqueue", None), (1, 1, at(-8), "claim", None), (1, 2, at(3), "fail", "internal"), (2, 0, at(-9), "enqueue", None), (2, 1, at(-9), "claim", None), (3, 0, at(-9), "enqueue", None), (3, 1, at(-8), "claim", None), (3, 2, at(-7), "succeed", None), (4, 0, at(-5), "enqueue", None)]
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    spark.createDataFrame(rows, JOB).coalesce(1).write.parquet(f"{source}/p0")
    stream = timers.job_timers(spark.readStream.schema(JOB).parquet(f"{source}/*"), stale_minutes=0.1, kept_minutes=0.1)
    q = stream.writeStream.outputMode("update").format("memory").queryName("timed_jobs").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        want = {(1, "pending", 1, False), (1, "pending", 1, True), (2, "running", 1, False), (2, "pending", 1, True), (3, "succeeded", 1, False), (4, "pending", 0, True)}
        got = set()
        while time.time() < until and not got >= want:
            time.sleep(1)
            got = {(r.job_id, r.status, r.attempts, r.due) for r in spark.table("timed_jobs").collect()}
        assert got == want
        assert {r.error for r in spark.table("timed_jobs").filter("job_id = 2 and due").collect()} == {ingest.STOPPED}
        left = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()
        while time.time() < until and left("ended"):
            time.sleep(1)
        assert left("ended") == 0 and left("open") == 3
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def ends(body, start):
    """Where the bracket at ``start`` is closed, read from there on; 0 if it is not."""
    stack, quoted, skip = [], False, False
    for i, c in enumerate(body[start:], start):
        if skip or quoted:
            skip, quoted = not skip and c == "\\", skip or c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            if stack.pop() + c not in ("{}", "[]"):
                return 0
            if not stack:
                return i + 1
    return 0


def test_brackets_are_matched_in_one_pass():
    r = random.Random(1)
    for _ in range(5000):
        body = "".join(r.choice('{}[]"\\a') for _ in range(r.randint(0, 14)))
        assert ingest.balanced(body) == [i for i, c in enumerate(body) if c in "{[" and ends(body, i)]


@pytest.mark.parametrize("body", ["[" * 200_000, '{"' * 100_000, "[" * 100_000 + "]" * 100_000, '{"a":' * 60_000, "{a " * 60_000 + "}" * 60_000])
def test_salvage_is_linear(body):
    began = time.process_time()
    found = ingest.salvage(body)
    assert found is None or found == "[" * ingest.DEEPEST + "]" * ingest.DEEPEST
    assert time.process_time() - began < 3


def test_salvage():
    assert ingest.salvage('It is 5" long {"a": [1, "}"]} and [2]') == '{"a": [1, "}"]}'
    assert ingest.salvage('```json\n[1]\n``` {"b":1}') == "[1]"
    assert ingest.salvage('see {below} {"a":1}') == '{"a":1}' and ingest.salvage("no [json") is None and ingest.salvage(" ") is None
