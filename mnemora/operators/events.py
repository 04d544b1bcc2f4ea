"""State as an append-only event log: current rows are a fold, the audit trail is the log itself.

An event is (memory_id, user_id, seq, at, operation, and the columns it sets); ``seq`` orders events
of one instant. Operations: add, update, supersede, merge, delete, access.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that events set; a log may lack some.
SET = ["content", "category", "subcategory", "confidence", "expires_at", "tags", "entities", "client", "session_id"]


KEYS = ["user_id", "memory_id"]
HELD = ["created_at", "updated_at", "deleted_at", "superseded_by"]


def fold(events: DataFrame) -> DataFrame:
    """Current rows. Update sets only the columns named in ``sets`` (null clears); delete keeps the first time and does not
    touch updated_at; update, supersede and merge do nothing to a deleted row, merge nothing to a superseded one.

    Accesses, of which a memory may have any number, are counted by partial aggregation. Only its edits are gathered, and
    folded in order within the row.
    """
    return rows_of(folded(events))


def folded(events: DataFrame) -> DataFrame:
    """The state of every memory: the columns of ``fold``, and the place (at, seq) of its last edit, from which it can be folded further.

    Rows with accesses only, or edits before they are added, are part of it.
    """
    return _with_accesses(_stepped(_edits(events), None), _accesses(events))


def rows_of(state: DataFrame) -> DataFrame:
    """Current rows of a state: those that were added."""
    return state.filter("created_at IS NOT NULL").drop("last")


def advance(base: DataFrame, tail: DataFrame, all_of) -> DataFrame:
    """Current rows of the state ``base`` with the events ``tail``; see ``advanced``."""
    return rows_of(advanced(base, tail, all_of))


def advanced(base: DataFrame, tail: DataFrame, all_of) -> DataFrame:
    """``base`` with later events folded in: equal to the fold of all events, whatever the cut.

    Rows of ``base`` without new events pass as they are. Events that come late, before the last of their memory in
    ``base``, cannot be folded onto it: those memories alone are folded from all their events, ``all_of`` (keys).
    """
    edits, seen = _edits(tail), _accesses(tail)
    early = edits.select(*KEYS, F.element_at("_e", 1).alias("_first")).select(*KEYS, F.struct("_first.at", "_first.seq").alias("_first"))
    late = base.select(*KEYS, "last").join(early, KEYS).filter(F.col("last").isNotNull() & (F.col("_first") < F.col("last"))).select(*KEYS)
    anew = None if late.isEmpty() else late
    fine = edits if anew is None else edits.join(anew, KEYS, "left_anti")
    kept = base if anew is None else base.join(anew, KEYS, "left_anti")
    touched = kept.join(fine, KEYS, "left")
    added = fine.join(base.select(*KEYS), KEYS, "left_anti")
    moved = touched.filter("_e IS NOT NULL")
    out = touched.filter("_e IS NULL").drop("_e").unionByName(_stepped(moved, base)).unionByName(_stepped(added, None).withColumns({"last_accessed_at": F.lit(None).cast(base.schema["last_accessed_at"].dataType), "access_count": F.lit(0).cast("long")}))
    out = _plus_accesses(out, seen)
    if anew is None:
        return out
    return out.join(anew, KEYS, "left_anti").unionByName(folded(all_of(anew)))


def _accesses(events: DataFrame) -> DataFrame:
    return events.filter("operation = 'access'").groupBy(*KEYS).agg(F.max("at").alias("last_accessed_at"), F.count("*").alias("access_count"))


def _edits(events: DataFrame) -> DataFrame:
    """Each memory's events but accesses, in order, as ``_e``."""
    fields = ["operation", "sets", "superseded_by", *(c for c in SET if c in events.columns)]
    rows = events.filter("operation <> 'access'").groupBy(*KEYS)
    return rows.agg(F.array_sort(F.collect_list(F.struct("at", F.col("seq").cast("long").alias("seq"), *fields))).alias("_e"))


def _stepped(rows: DataFrame, base: DataFrame | None) -> DataFrame:
    """The state after ``_e``: from the columns of a state in ``rows`` if there is one, else from nothing."""
    kinds = {f.name: f.dataType for f in rows.schema["_e"].dataType.elementType.fields}
    own = [c for c in SET if c in kinds]
    held = {**{c: kinds[c] for c in own}, **{c: kinds["at"] for c in HELD[:3]}, "superseded_by": "long"}
    start = F.struct(*((F.col(c) if base is not None else F.lit(None)).cast(t).alias(c) for c, t in held.items()))

    def step(s: Column, e: Column) -> Column:
        op, live = e["operation"], s["deleted_at"].isNull()
        add, update = op == "add", (op == "update") & live
        retire = ((op == "supersede") & live) | ((op == "merge") & live & s["superseded_by"].isNull())
        touched = add | update | retire
        out = [F.when(add | (update & F.array_contains(e["sets"], c)), e[c]).otherwise(s[c]).alias(c) for c in own]
        out += [
            F.when(add, e["at"]).otherwise(s["created_at"]).alias("created_at"),
            F.when(touched, e["at"]).otherwise(s["updated_at"]).alias("updated_at"),
            F.when(op == "delete", F.coalesce(s["deleted_at"], e["at"])).otherwise(s["deleted_at"]).alias("deleted_at"),
            F.when(retire, e["superseded_by"]).otherwise(s["superseded_by"]).alias("superseded_by"),
        ]
        return F.struct(*out)

    end = F.element_at("_e", -1)
    carried = [] if base is None else ["last_accessed_at", "access_count"]
    made = rows.select(*KEYS, *carried, F.aggregate("_e", start, step).alias("_s"), F.struct(end["at"].alias("at"), end["seq"].cast("long").alias("seq")).alias("last"))
    return made.select(*KEYS, "_s.*", *carried, "last")


def _with_accesses(state: DataFrame, seen: DataFrame) -> DataFrame:
    return state.join(seen, KEYS, "full_outer").withColumn("access_count", F.coalesce("access_count", F.lit(0)))


def _plus_accesses(state: DataFrame, seen: DataFrame) -> DataFrame:
    """``state`` with further accesses counted in."""
    more = seen.select(*KEYS, F.col("last_accessed_at").alias("_at"), F.col("access_count").alias("_n"))
    met = state.join(more, KEYS, "full_outer")
    return met.withColumns({"last_accessed_at": F.greatest("last_accessed_at", "_at"), "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))}).drop("_at", "_n")


def audit(events: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` (1 to 500) audited events of each user; accesses and rescoring are not audited."""
    order = Window.partitionBy("user_id").orderBy(F.col("at").desc(), F.col("seq").desc(), "memory_id")
    n = max(1, min(500, limit))
    kept = events.filter(F.col("operation").isin("add", "update", "delete", "supersede", "merge"))
    return kept.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= n)


def edits(memories: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Update events from partial edits: (user_id, memory_id, seq, sets, columns). Unknown, foreign and deleted ids are dropped;
    ``reembed`` says whether the trimmed content changed, the only case in which a vector must be made anew.
    """
    known = memories.filter("deleted_at IS NULL").select("user_id", "memory_id", F.col("content").alias("_old"))
    new = F.array_contains("sets", "content") & (F.trim("content") != F.trim("_old"))
    return changes.join(known, ["user_id", "memory_id"]).withColumns({"at": now, "operation": F.lit("update"), "reembed": new}).drop("_old")


def forget(memories: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """(user_id, memory_id, found, at, operation) for each wanted id: a delete event where it is found, which a missing, foreign or deleted one is not."""
    live = memories.filter("deleted_at IS NULL").select("user_id", "memory_id", F.lit(True).alias("found"))
    rows = wanted.select("user_id", "memory_id").distinct().join(live, ["user_id", "memory_id"], "left")
    return rows.select("user_id", "memory_id", F.coalesce("found", F.lit(False)).alias("found"), now.alias("at"), F.when(F.col("found"), "delete").alias("operation"))


def merge_events(found: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """A merge event for each live, unsuperseded member of a cluster, owned by the cluster's user; others are skipped."""
    live = memories.filter("deleted_at IS NULL AND superseded_by IS NULL").select("user_id", "memory_id")
    return found.join(live, ["user_id", "memory_id"]).select("user_id", "memory_id", now.alias("at"), F.lit("merge").alias("operation"), F.col("replacement_id").alias("superseded_by"))
