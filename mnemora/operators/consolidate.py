"""Consolidation: expiry, decay, groups with watermarks, similar pairs, clusters, merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scores
from .recall import active, matrix, usable

GROUP = ["user_id", "category", "sub"]


def expired(now: Column) -> Column:
    return F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)


def maintain(memories: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(delete events of expired rows, importance of every live, unsuperseded row)."""
    stored = memories.filter("deleted_at IS NULL")
    gone = stored.filter(expired(now)).select("user_id", "memory_id", F.lit("delete").alias("operation"), F.concat(F.lit("expired on "), F.date_format("expires_at", "yyyy-MM-dd")).alias("detail"))
    value = scores.importance(F.col("created_at"), F.col("last_accessed_at"), F.col("access_count"), now)
    live = stored.filter(active(now)).select("user_id", "memory_id", value.alias("importance"))
    return gone, live


def grouped(memories: DataFrame, now: Column) -> DataFrame:
    """Active memories with their group's key; a missing subcategory is a group of its own."""
    return memories.filter("deleted_at IS NULL").filter(active(now)).withColumn("sub", F.coalesce("subcategory", F.lit("")))


def watermarks(groups: DataFrame) -> DataFrame:
    """(user_id, category, sub, size, max_updated_at) of every group."""
    return groups.groupBy(*GROUP).agg(F.count("*").alias("size"), F.max("updated_at").alias("max_updated_at"))


def changed(marks: DataFrame, state: DataFrame) -> DataFrame:
    """Groups of two or more whose newest update is not the recorded one. ``state`` has the group key and recorded_at."""
    joined = marks.filter("size >= 2").join(state, GROUP, "left")
    return joined.filter(~F.coalesce(F.col("max_updated_at") == F.col("recorded_at"), F.lit(False))).select(*GROUP, "size", "max_updated_at")


def capped(groups: DataFrame, cap: int = S.GROUP_CAP) -> DataFrame:
    """The newest ``cap`` memories of each group: the feature that bounds the pairwise comparison."""
    window = Window.partitionBy(*GROUP).orderBy(F.col("created_at").desc(), F.col("memory_id"))
    return groups.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= cap).drop("_n")


def rows_of(groups: DataFrame, vectors: DataFrame, cap: int) -> DataFrame:
    """(group key, d, memory_id, embedding) of the capped groups' memories; unusable vectors take no part, and vectors meet only those of their width ``d``."""
    held = vectors.filter(usable(F.col("embedding"))).select("user_id", "memory_id", F.size("embedding").alias("d"), "embedding")
    return capped(groups, cap).select(*GROUP, "memory_id").join(held, ["user_id", "memory_id"]).select(*GROUP, "d", "memory_id", "embedding")


def near_blocks(x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the rows i < j of ``x`` with cosine >= threshold, from the products of 512 rows with all; zero rows are near nothing."""
    size = np.linalg.norm(x, axis=1)
    unit = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
    for at in range(0, len(x), 512):
        near = np.clip(unit[at : at + 512] @ unit[at:].T, -1, 1)
        i, j = np.nonzero((near >= threshold) & (size[at : at + 512, None] > 0) & (size[at:] > 0))
        keep = i < j
        yield i[keep] + at, j[keep] + at, near[i[keep], j[keep]]


def in_order(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a group's rows by id."""
    ids = group.column("memory_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(group.column("embedding").combine_chunks())[order]


def keyed(key: tuple[pa.Scalar, ...], n: int) -> dict[str, pa.Array]:
    """The columns of a group's key, ``n`` rows of them."""
    return {c: pa.array([v.as_py()] * n, v.type) for c, v in zip(GROUP, key, strict=False)}


def similar(groups: DataFrame, vectors: DataFrame, threshold: float = S.SIMILARITY, cap: int = S.GROUP_CAP) -> DataFrame:
    """(user_id, category, sub, a, b, similarity) for a < b in one group with cosine >= threshold.

    A capped group is one bounded task: its vectors make one matrix, and blocks of products leave only the similar pairs.
    """

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids, x = in_order(group)
        left, right, value = (np.concatenate(c) for c in zip(*near_blocks(x, threshold), strict=True))
        return pa.table({**keyed(key, len(left)), "a": ids[left], "b": ids[right], "similarity": value})

    return rows_of(groups, vectors, cap).groupBy(*GROUP, "d").applyInArrow(run, "user_id long, category string, sub string, a long, b long, similarity double")


def linked(groups: DataFrame, vectors: DataFrame, threshold: float = S.SIMILARITY, cap: int = S.GROUP_CAP) -> DataFrame:
    """``clusters`` of the ``similar`` memories of every group, without its pairs: (user_id, category, sub, cluster_id, memory_id).

    A group of the cap's size has up to two million pairs and as many rows as the cap, so links are taken up a block
    of products at a time and only labels leave the task. A memory without a link is in no cluster.
    """

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids, x = in_order(group)
        rows = label = np.arange(len(ids))
        for i, j, _ in near_blocks(x, threshold):
            new = label[i] != label[j]
            if new.any():
                label = labels(len(ids), np.concatenate([rows, i[new]]), np.concatenate([label, j[new]]))
        many = np.bincount(label, minlength=len(ids))[label] > 1
        return pa.table({**keyed(key, int(many.sum())), "cluster_id": ids[label[many]], "memory_id": ids[many]})

    return rows_of(groups, vectors, cap).groupBy(*GROUP, "d").applyInArrow(run, "user_id long, category string, sub string, cluster_id long, memory_id long")


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is linked to, over any number of links: labels spread along links and are looked up until they stay."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def clusters(pairs: DataFrame) -> DataFrame:
    """(user_id, category, sub, cluster_id, memory_id): connected components of links; the smallest id names the cluster.

    Links never leave a group and a group is capped, so each group is one bounded task.
    """

    def run(group: pa.Table) -> pa.Table:
        a, b = group.column("a").to_numpy(), group.column("b").to_numpy()
        ids = np.unique(np.concatenate([a, b]))
        label = labels(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b))
        many = np.bincount(label, minlength=len(ids))[label] > 1
        first = group.slice(0, 1).to_pylist()[0]
        n = int(many.sum())
        return pa.table({"user_id": pa.array([first["user_id"]] * n, pa.int64()), "category": pa.array([first["category"]] * n, pa.string()), "sub": pa.array([first["sub"]] * n, pa.string()), "cluster_id": ids[label[many]], "memory_id": ids[many]})

    return pairs.select(*GROUP, "a", "b").groupBy(*GROUP).applyInArrow(run, "user_id long, category string, sub string, cluster_id long, memory_id long")


def previews(found: DataFrame, memories: DataFrame) -> DataFrame:
    """What a run would merge, a row a cluster: members and their contents in id order. Nothing is written."""
    rows = found.join(memories.select("user_id", "memory_id", "content"), ["user_id", "memory_id"])
    parts = F.array_sort(F.collect_list(F.struct("memory_id", "content")))
    return rows.groupBy("user_id", "category", "cluster_id").agg(F.count("*").alias("size"), parts.alias("members"))


def replacements(found: DataFrame, memories: DataFrame, now: Column, decisions: DataFrame | None = None) -> DataFrame:
    """The memory that replaces each cluster: highest confidence, first subcategory in id order, no entities, no expiry.

    ``decisions`` (cluster_id, merge, content, category, tags) override the newest member's content; a
    cluster without a decision to merge, or whose decision has no content, is kept as it is.
    """
    rows = found.select("user_id", "cluster_id", "memory_id").join(memories, ["user_id", "memory_id"]).filter("deleted_at IS NULL AND superseded_by IS NULL")
    merged = rows.groupBy("user_id", "cluster_id").agg(
        F.max("confidence").alias("confidence"),
        F.min_by("subcategory", F.when(F.col("subcategory").isNotNull(), F.col("memory_id"))).alias("subcategory"),
        F.min_by("category", "memory_id").alias("category"),
        F.max_by("content", F.struct("created_at", "memory_id")).alias("content"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        F.count("*").alias("retired"),
    )
    if decisions is not None:
        chosen = decisions.filter("merge AND content IS NOT NULL").select("cluster_id", F.col("content").alias("_c"), F.col("category").alias("_k"), F.col("tags").alias("_t"))
        merged = merged.join(chosen, "cluster_id").withColumns({"content": F.col("_c"), "category": F.coalesce("_k", "category"), "tags": F.coalesce("_t", "tags")}).drop("_c", "_k", "_t")
    return merged.withColumns({"created_at": now, "updated_at": now})


def budgeted(found: DataFrame, sizes: DataFrame, max_calls: int = 100, max_retired: int = 5000) -> DataFrame:
    """Clusters in the order in which a run takes them (largest group first), until a budget is spent; 0 means no limit.

    A budget is checked after each cluster, so the one that exceeds it is still done; ``stopped_by`` names the limit.
    """
    per = found.groupBy("user_id", *GROUP[1:], "cluster_id").agg(F.count("*").alias("retired")).join(sizes.select(*GROUP, "size"), GROUP)
    order = Window.partitionBy("user_id").orderBy(F.col("size").desc(), "category", "sub", "cluster_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent = per.withColumns({"calls_before": F.coalesce(F.count("*").over(before), F.lit(0)), "retired_before": F.coalesce(F.sum("retired").over(before), F.lit(0))})
    stop = F.when((F.col("calls_before") >= max_calls) & F.lit(max_calls > 0), "calls").when((F.col("retired_before") >= max_retired) & F.lit(max_retired > 0), "retired")
    return spent.withColumn("stopped_by", stop)


def record(marks: DataFrame, failed: DataFrame, state: DataFrame) -> DataFrame:
    """The new high-water state: groups processed without failure take their pre-merge newest update; others stay."""
    done = marks.join(failed, GROUP, "left_anti").select(*GROUP, F.col("max_updated_at").alias("recorded_at"))
    return done.union(state.join(done, GROUP, "left_anti").select(*GROUP, "recorded_at"))


def run_summary(reports: DataFrame) -> DataFrame:
    """Totals of many run reports: counters added, flags or-ed, the first stop reason, previews in order of the runs, and a line of text."""
    if "previews" not in reports.columns:
        reports = reports.withColumn("previews", F.array().cast("array<string>"))
    shown = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "previews"))), lambda x: x["previews"])).alias("previews")
    total = reports.agg(shown, F.sum("examined").alias("examined"), F.sum("merged").alias("merged"), F.sum("retired").alias("retired"), F.bool_or("budget_hit").alias("budget_hit"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("run_id"))).alias("reason"))
    return total.withColumn("summary", F.format_string("%d merged / %d retired / %d kept", "merged", "retired", F.col("examined") - F.col("retired")))


def transcripts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns, transcript, n_chars, reject_reason): a session's turns in order, one ``role: text`` line each.

    Lengths are summed first; the texts of a session that is too long are not gathered, and its transcript is null.
    """
    size = F.coalesce(F.char_length("role"), F.lit(0)) + F.coalesce(F.char_length("text"), F.lit(0)) + F.when(F.col("role").isNotNull() & F.col("text").isNotNull(), 2).otherwise(0)
    sums = turns.groupBy(key).agg((F.sum(size) + F.count("*") - 1).cast("long").alias("n_chars"), F.count("*").alias("turns"))
    short = turns.join(sums.filter(F.col("n_chars") <= S.MAX_TRANSCRIPT).select(key), key, "left_semi")
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n")
    made = short.groupBy(key).agg(lines.alias("lines")).select(key, text.alias("transcript"))
    out = sums.join(made, key, "left").select(key, "turns", "transcript", "n_chars")
    reason = F.when(F.col("n_chars") > S.MAX_TRANSCRIPT, "transcript is too long").when(F.char_length(F.trim("transcript")) == 0, "transcript is empty")
    return out.withColumn("reject_reason", reason)
