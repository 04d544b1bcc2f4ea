"""The engine: a snapshot of memories, its vectors and a clock, with every operation of the service as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema as S
from .functions import prompts
from .operators import consolidate, embedding, events, ingest, recall, reconcile, reports
from .operators import run as runs
from .sources import store
from .sources.session import share_code


@dataclass(frozen=True)
class Engine:
    """``memories`` as in ``schema.MEMORIES``; ``vectors`` (user_id, memory_id, embedding); ``now`` an explicit instant."""

    memories: DataFrame
    vectors: DataFrame
    now: Column

    def __post_init__(self) -> None:
        share_code(self.memories.sparkSession)

    @classmethod
    def of(cls, memories: DataFrame, now: Column) -> Engine:
        """With hashed embeddings."""
        vectors = embedding.hash_embed(memories.select("user_id", "memory_id", "content"), ["user_id", "memory_id"], "content")
        return cls(memories, vectors, now)

    def checked(self, queries: DataFrame) -> DataFrame:
        """Queries with ``reject_reason``: blank or long texts (trimmed) and limits below one; null for those that ``recall`` answers."""
        text = F.trim(F.coalesce("text", F.lit("")))
        reason = F.when(F.char_length(text) == 0, "query is empty").when(F.char_length(text) > S.MAX_QUERY, "query is too long").when(F.coalesce(F.col("k") <= 0, F.lit(True)), "limit must be at least 1")
        return queries.withColumn("text", text).withColumn("reject_reason", reason)

    def recall(self, queries: DataFrame, filters: recall.Filters | None = None, half_life: float = S.HALF_LIFE_DAYS, hybrid: bool = True) -> DataFrame:
        """Answers to (query_id, user_id, text, k). Queries that ``checked`` gives a reason have none; ask it which and why."""
        good = self.checked(queries).filter("reject_reason IS NULL")
        embedded = embedding.hash_embed(good, ["query_id", "user_id", "text", "k"], "text")
        return recall.recall(embedded, self.memories, self.vectors, self.now, filters, half_life, hybrid)

    def neighbours(self, candidates: DataFrame) -> DataFrame:
        """What a reconciler is shown: five unfiltered answers a candidate (query_id, user_id, text)."""
        return self.recall(candidates.select("query_id", "user_id", F.substring("text", 1, S.MAX_QUERY).alias("text"), F.lit(S.NEIGHBOURS).alias("k")))

    def save(self, payloads: DataFrame, extras: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(good rows with their embedding, rejected rows) of verbatim payloads; ``added`` makes the former events."""
        rows = ingest.verbatim(payloads, extras, self.now)
        good = rows.filter("reject_reason IS NULL").drop("reject_reason")
        return embedding.hash_embed(good, good.columns, "content"), rows.filter("reject_reason IS NOT NULL")

    def added(self, good: DataFrame, user_id: Column) -> DataFrame:
        """Add events of saved rows, to be appended to the log; ``id`` names the memory."""
        null = lambda t: F.lit(None).cast(t)
        expires = F.col("expires_at") if "expires_at" in good.columns else null("timestamp_ntz")
        return good.select(user_id.alias("user_id"), F.col("id").alias("memory_id"), F.lit(0).alias("seq"), self.now.alias("at"), F.lit("add").alias("operation"), F.array().cast("array<string>").alias("sets"), null("long").alias("superseded_by"), "content", "category", null("string").alias("subcategory"), F.lit(1.0).alias("confidence"), expires.cast("timestamp_ntz").alias("expires_at"))

    def edit(self, changes: DataFrame) -> DataFrame:
        """Update events of partial edits, with ``reembed``; unknown, foreign and deleted ids have none."""
        return events.edits(self.memories, changes, self.now)

    def forget(self, wanted: DataFrame) -> DataFrame:
        """What becomes of each wanted id: a delete event, or not found."""
        return events.forget(self.memories, wanted, self.now)

    def audit(self, log: DataFrame, limit: int = 100) -> DataFrame:
        return events.audit(log, limit)

    def export(self, users: DataFrame, form: str, include_inactive: bool = False) -> DataFrame:
        """A document a user, Markdown or JSON."""
        if form not in ("json", "markdown", "md"):
            raise ValueError(f"unknown export format {form!r}")
        made = reports.json_documents if form == "json" else reports.markdown_documents
        return made(self.memories, users, include_inactive)

    def jobs(self, log: DataFrame) -> DataFrame:
        """Every job's record as a caller is told."""
        states = ingest.job_states(log, self.now)
        return states.withColumn("status", ingest.status_name(F.col("status")))

    def job(self, log: DataFrame, owners: DataFrame, wanted: DataFrame) -> DataFrame:
        """The record of each wanted (user_id, job_id); a foreign job is as if it did not exist."""
        return ingest.job_of(self.jobs(log), owners, wanted)

    def shown(self, rows: DataFrame) -> DataFrame:
        """What a caller sees of memories."""
        return reports.responses(rows)

    def list(self, include_inactive: bool = False, most: int | None = None) -> DataFrame:
        return store.listing(self.memories, include_inactive, most)

    def find(self, user_id: int, memory_id: int) -> DataFrame:
        return store.find(self.memories, user_id, memory_id)

    def profile(self, users: DataFrame) -> DataFrame:
        return reports.profile(self.memories, users, self.now)

    def maintain(self) -> tuple[DataFrame, DataFrame]:
        return consolidate.maintain(self.memories, self.now)

    def plan(self, state: DataFrame, threshold: float = S.SIMILARITY) -> tuple[DataFrame, DataFrame]:
        """(changed groups, clusters in them): what a consolidation run would merge."""
        groups = consolidate.grouped(self.memories, self.now)
        marks = consolidate.changed(consolidate.watermarks(groups), state)
        todo = groups.join(marks.select(*consolidate.GROUP), consolidate.GROUP, "left_semi")
        return marks, consolidate.linked(todo, self.vectors, threshold)

    def digest(self, users: DataFrame, cache: DataFrame, ask: Callable[[str], str] | None) -> tuple[DataFrame, DataFrame]:
        """(profiles written by a model, new cache rows): only digests that are not fresh are asked for; without a model the assembled profile."""
        plain = self.profile(users)
        if ask is None:
            return plain.select("user_id", "text"), cache.limit(0)
        plan = reports.digest_plan(self.memories, cache, self.now)
        todo = reports.digest_rows(self.memories, self.now).join(plan.filter("not fresh").select("user_id", "domain"), ["user_id", "domain"], "left_semi")
        answers = ingest.decide(prompts.digest(todo), ask, "prompt")
        sections, fresh = reports.digests(plan, answers)
        return reports.digest_profile(sections, users, plain, self.now), fresh

    def consolidate(self, state: DataFrame, ask: Callable[[str], str] | None, path: str, threshold: float = S.SIMILARITY, max_calls: int = 100, max_retired: int = 5000, name: Column | None = None) -> runs.Run:
        """A whole run: the events for the log, the marks to record and what became of every user; see ``operators.run``."""
        return runs.consolidation(self.memories, self.vectors, self.now, state, ask, path, threshold, max_calls, max_retired, name)

    def merge(self, found: DataFrame, ask: Callable[[str], str]) -> DataFrame:
        """Replacements of the clusters that a model says are one thing; a cluster whose answer fails is kept, the others go on."""
        members = found.select("user_id", "cluster_id", "memory_id").join(self.memories, ["user_id", "memory_id"])
        answers = ingest.decide(prompts.merge(members), ask, "prompt")
        own = members.groupBy("cluster_id").agg(F.min_by("category", "memory_id").alias("category"))
        return consolidate.replacements(found, self.memories, self.now, ingest.merge_decisions(answers, own))

    def ingest(self, payloads: DataFrame, ask: Callable[[str], str], path: str, name: Column | None = None, lens: str = "message", extras: tuple[str, ...] = (), alike: float = reconcile.ALIKE, batch: int = reconcile.BATCH, rounds: int = 64) -> tuple[reconcile.Reconciled, DataFrame]:
        """(what became of the candidates that a model draws from payloads, payloads that could not be read).

        Payloads are (id, user_id, content and, if given, tags, client, session_id); they count in the order of their ids.
        A candidate is shown its neighbours among what is stored, with what earlier candidates like it have just stored, and
        the model says whether it is added, replaces or refutes one of them, or is known. ``path`` is a new folder that driver and
        executors share; the same one again goes on with a run that was broken off. ``events`` of the result are for the log.
        """
        drawn, failed = reconcile.extracted(payloads, ask, path, lens, extras, name)
        return reconcile.reconcile(drawn, self.memories, self.vectors, self.now, self.shown_neighbours, ask, path, alike, batch, rounds), failed

    def shown_neighbours(self, memories: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
        return Engine(memories, vectors, self.now).recall(queries)

    def after(self, settled: reconcile.Reconciled) -> Engine:
        """The engine with what an ingest stored, replaced and deleted."""
        made = reconcile.retire(reconcile.rows_of(self.memories, self.now).unionByName(settled.added), settled.done, self.now)
        new = settled.candidates.join(settled.added.select("user_id", "memory_id"), ["user_id", "memory_id"], "left_semi")
        return Engine(made, self.vectors.select("user_id", "memory_id", "embedding").unionByName(new.select("user_id", "memory_id", "embedding")), self.now)

    def distill(self, turns: DataFrame, ask: Callable[[str], str] | None, path: str, name: Column | None = None, client: str = "session-distill") -> tuple[reconcile.Reconciled, DataFrame, DataFrame]:
        """Whole sessions (user_id, conv_id, turn, role, text) drawn from and stored: (what became of the candidates, sessions that could not be read, rejected sessions).

        Without a model there is nothing to draw them with. A session belongs to its user; where turns have no ``user_id``, to a user of its own number.
        """
        if ask is None:
            raise ValueError("distilling a session needs a language model")
        good, rejected = ingest.distilled(consolidate.transcripts(turns), client)
        owner = F.col("user_id") if "user_id" in turns.columns else F.col("conv_id")
        owners = turns.groupBy(F.col("conv_id").alias("id")).agg(F.min(owner).alias("user_id"))
        return *self.ingest(good.join(owners, "id"), ask, path, name, "session"), rejected
