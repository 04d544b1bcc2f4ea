"""A consolidation run as a whole: what it does to the log, what it records, and what became of every user.

A user whose rows are unusable, or whose model answers fail, is reported with a reason and is taken up again by the next
run; nobody else's result depends on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import prompts
from . import consolidate, ingest, recall
from .consolidate import GROUP
from .reconcile import written


@dataclass(frozen=True)
class Run:
    """``events`` for the log, ``marks`` to record, ``outcomes`` (user_id, status, reason, groups, clusters, merged, retired) and the clusters that were found."""

    events: DataFrame
    marks: DataFrame
    outcomes: DataFrame
    clusters: DataFrame


def quarantine(memories: DataFrame, vectors: DataFrame, now: Column) -> DataFrame:
    """(user_id, reason) of users with live memories whose vector is missing or unusable, or of another width than the user's others."""
    live = memories.filter(recall.active(now) & F.col("deleted_at").isNull()).select("user_id", "memory_id")
    seen = live.join(vectors.select("user_id", "memory_id", F.when(recall.usable(F.col("embedding")), F.size("embedding")).alias("d")), ["user_id", "memory_id"], "left")
    per = seen.groupBy("user_id").agg(F.count(F.when(F.col("d").isNull(), 1)).alias("bad"), F.min("d").alias("low"), F.max("d").alias("high"))
    reason = F.when(F.col("bad") > 0, F.format_string("%d memories without a usable vector", "bad")).when(F.col("low") < F.col("high"), "vectors of several widths")
    return per.withColumn("reason", reason).filter("reason IS NOT NULL").select("user_id", "reason")


def consolidation(memories: DataFrame, vectors: DataFrame, now: Column, state: DataFrame, ask: Callable[[str], str] | None, path: str, threshold: float = S.SIMILARITY, max_calls: int = 100, max_retired: int = 5000, name: Column | None = None) -> Run:
    """Expire, cluster the groups that changed, merge as a model says, and say what to record.

    Without a model each cluster becomes its newest member's text. Members are what they were when clusters were written, so a
    run that is begun again on the same ``path`` asks nothing twice. A group is recorded only if all its clusters were dealt with.
    """
    bad = written(quarantine(memories, vectors, now), f"{path}/quarantine")
    fine = memories.join(bad.select("user_id"), "user_id", "left_anti")
    groups = consolidate.grouped(fine, now)
    marks = written(consolidate.changed(consolidate.watermarks(groups), state), f"{path}/marks")
    found = written(consolidate.linked(groups.join(marks.select(*GROUP), GROUP, "left_semi"), vectors, threshold), f"{path}/clusters")
    taken = written(consolidate.budgeted(found, marks, max_calls, max_retired).select(*GROUP, "cluster_id", "retired", "stopped_by"), f"{path}/taken")
    todo = found.join(taken.filter("stopped_by IS NULL").select("user_id", "cluster_id"), ["user_id", "cluster_id"], "left_semi")
    members = todo.select("user_id", "cluster_id", "memory_id").join(memories, ["user_id", "memory_id"])
    if ask is None:
        decisions, lost = None, todo.select(*GROUP).limit(0)
    else:
        answers = written(ingest.decide(prompts.merge(members), ask, "prompt").select("user_id", "cluster_id", "answer"), f"{path}/answers")
        own = members.groupBy("cluster_id").agg(F.min_by("category", "memory_id").alias("category"))
        decisions = ingest.merge_decisions(answers.filter("answer IS NOT NULL"), own)
        lost = todo.join(answers.filter("answer IS NULL").select("user_id", "cluster_id"), ["user_id", "cluster_id"], "left_semi").select(*GROUP).distinct()
    hashed = F.xxhash64("user_id", "cluster_id", now.cast("string")).bitwiseAND(F.lit(2**63 - 1))
    made = written(consolidate.replacements(todo, memories, now, decisions).withColumn("memory_id", hashed if name is None else name), f"{path}/replacements")
    left = taken.filter("stopped_by IS NOT NULL").select(*GROUP, F.concat(F.lit("budget of "), "stopped_by").alias("reason")).unionByName(lost.withColumn("reason", F.lit("the model did not answer")))
    failed = written(left.groupBy(*GROUP).agg(F.min("reason").alias("reason")), f"{path}/failed")
    return Run(run_events(memories, made, todo, now), consolidate.record(marks, failed.select(*GROUP), state), outcomes(marks, bad, failed, taken, made), found)


def run_events(memories: DataFrame, made: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Log events of a run: expired rows are deleted, replacements added, their members merged into them."""
    null = lambda t: F.lit(None).cast(t)
    own = ["content", "category", "subcategory", "confidence", "tags"]
    blank = {c: null(S.MEMORIES[c].dataType) for c in own}

    def event(rows: DataFrame, seq: int, operation: str, by: Column, columns: dict[str, Column]) -> DataFrame:
        return rows.select("user_id", "memory_id", F.lit(seq).cast("long").alias("seq"), now.alias("at"), F.lit(operation).alias("operation"), F.array().cast("array<string>").alias("sets"), by.alias("superseded_by"), *(c.alias(n) for n, c in columns.items()), null("timestamp_ntz").alias("expires_at"))

    gone = memories.filter("deleted_at IS NULL").filter(consolidate.expired(now))
    merged = found.select("user_id", "cluster_id", "memory_id").join(made.select("user_id", "cluster_id", F.col("memory_id").alias("by")), ["user_id", "cluster_id"])
    out = event(gone, 0, "delete", null("long"), blank)
    out = out.unionByName(event(made, 1, "add", null("long"), {c: F.col(c) for c in own}))
    return out.unionByName(event(merged, 2, "merge", F.col("by"), blank))


def outcomes(marks: DataFrame, bad: DataFrame, failed: DataFrame, taken: DataFrame, made: DataFrame) -> DataFrame:
    """(user_id, status, reason, groups, clusters, merged, retired) of every user whom the run concerned."""
    per = marks.groupBy("user_id").agg(F.count("*").alias("groups"))
    asked = taken.filter("stopped_by IS NULL").groupBy("user_id").agg(F.count("*").alias("clusters"))
    done = made.groupBy("user_id").agg(F.count("*").alias("merged"), F.sum("retired").alias("retired"))
    why = bad.unionByName(failed.select("user_id", "reason")).groupBy("user_id").agg(F.min("reason").alias("reason"))
    rows = per.join(why, "user_id", "full_outer").join(asked, "user_id", "left").join(done, "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("user_id", F.when(F.col("reason").isNull(), "processed").otherwise("failed").alias("status"), "reason", zero("groups"), zero("clusters"), zero("merged"), zero("retired"))
