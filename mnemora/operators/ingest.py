"""Ingest: model answers to candidates and decisions, verbatim saves, validation. Answers are inputs: no model is called here."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..functions.scores import TRANSIENT

CANDIDATE = "content string, category string, subcategory string, tags array<string>, entities array<struct<name:string,kind:string,type:string>>, confidence double"
DECISION = "action string, memory_id string, reason string"


def elements(answer: Column, name: str) -> Column:
    """The JSON texts of an answer's array: under ``name``, or the answer itself; null where there is none."""
    bare = F.ltrim(answer).startswith("[")
    body = F.when(bare, answer).otherwise(F.get_json_object(answer, f"$.{name}"))
    return F.from_json(F.when(F.ltrim(body).startswith("["), body), "array<string>")


def candidates(answers: DataFrame, caller_tags: Column | None = None, default_confidence: float = 0.8) -> DataFrame:
    """One row a candidate of (id, answer): its cleaned columns, ``exact`` category match, and ``reject_reason``.

    Unreadable elements are dropped; a candidate that is empty or too long is kept with its reason, not cut.
    """
    rows = answers.select("id", F.posexplode(elements(F.col("answer"), "candidates")).alias("ordinal", "raw")).filter(F.ltrim("raw").startswith("{"))
    rows = rows.withColumn("c", F.from_json("raw", CANDIDATE))
    content = T.tidy(F.coalesce("c.content", F.lit("")))
    tags = T.normalise_tags(F.coalesce("c.tags", F.array().cast("array<string>")))
    if caller_tags is not None:
        tags = F.array_distinct(F.concat(tags, T.normalise_tags(caller_tags)))
    named = F.filter(F.coalesce("c.entities", F.array().cast("array<struct<name:string,kind:string,type:string>>")), lambda e: T.tidy(F.coalesce(e["name"], F.lit(""))) != "")
    kind = lambda e: F.coalesce(F.nullif(T.ascii_lower(T.tidy(F.coalesce(e["kind"], e["type"], F.lit("")))), F.lit("")), F.lit("thing"))
    entities = F.transform(named, lambda e: F.struct(T.tidy(e["name"]).alias("name"), kind(e).alias("kind")))
    resolved = T.resolve_category(F.col("c.category"))
    return rows.select(
        "id",
        F.col("ordinal").cast("long").alias("ordinal"),
        content.alias("content"),
        resolved["category"].alias("category"),
        resolved["exact"].alias("exact"),
        T.normalise_subcategory(F.col("c.subcategory")).alias("subcategory"),
        tags.alias("tags"),
        entities.alias("entities"),
        T.unit_interval(F.coalesce("c.confidence", F.lit(default_confidence)), 0.0).alias("confidence"),
        T.reject_reason(content).alias("reject_reason"),
    )


def decisions(answers: DataFrame) -> DataFrame:
    """One row a decision of (id, answer, shown array<string>): action, memory_id, reason and ``error``.

    UPDATE and DELETE must name an id that was shown. No ``decisions`` array at all means ADD; an array
    of which nothing is usable means NOOP.
    """
    rows = answers.select("id", "shown", F.posexplode_outer(elements(F.col("answer"), "decisions")).alias("ordinal", "raw"), elements(F.col("answer"), "decisions").isNull().alias("absent"))
    rows = rows.withColumn("d", F.from_json("raw", DECISION))
    action = F.upper(T.tidy(F.coalesce("d.action", F.lit(""))))
    target = F.nullif(T.tidy(F.coalesce("d.memory_id", F.lit(""))), F.lit(""))
    needs = action.isin("UPDATE", "DELETE")
    error = F.when(~action.isin("ADD", "NOOP", "UPDATE", "DELETE"), "unknown action").when(needs & target.isNull(), "missing memory_id").when(needs & ~F.coalesce(F.array_contains("shown", target), F.lit(False)), "not a neighbour")
    out = rows.select("id", F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"), "absent", action.alias("action"), F.when(needs, target).alias("memory_id"), T.tidy(F.coalesce("d.reason", F.lit(""))).alias("reason"), error.alias("error"), F.col("raw").isNull().alias("empty"))
    return out.select("id", "ordinal", F.when(F.col("absent"), "ADD").when(F.col("empty"), "NOOP").otherwise(F.col("action")).alias("action"), "memory_id", "reason", F.when(~F.col("absent") & ~F.col("empty"), F.col("error")).alias("error"))


def outcomes(decided: DataFrame) -> DataFrame:
    """What happens to each candidate: stored or not, ids to supersede and to delete (deletes first, links only if stored)."""
    good = F.col("error").isNull()
    pick = lambda a: F.array_sort(F.collect_set(F.when(good & (F.col("action") == a), F.col("memory_id"))))
    stored = F.coalesce(F.bool_or(good & F.col("action").isin("ADD", "UPDATE")), F.lit(False))
    return decided.groupBy("id").agg(stored.alias("stored"), pick("UPDATE").alias("supersedes"), pick("DELETE").alias("deletes"))


def verbatim(payloads: DataFrame, extras: tuple[str, ...] = (), now: Column | None = None) -> DataFrame:
    """Payloads (id, content, category, tags and, if given, expires_at) as memories without a model: wording infers a missing category.

    A time of expiry that is not after ``now`` is a reason to reject; ``expires_at`` stays in the result.
    """
    content = T.tidy(F.coalesce("content", F.lit("")))
    category = F.when(T.tidy(F.coalesce("category", F.lit(""))) == "", T.infer_category(content)).otherwise(T.resolve_category(F.col("category"), extras)["category"])
    tags = T.normalise_tags(F.coalesce("tags", F.array().cast("array<string>")))
    reason, kept = T.reject_reason(content, tags), []
    if "expires_at" in payloads.columns:
        kept = ["expires_at"]
        if now is not None:
            reason = F.coalesce(reason, F.when(F.col("expires_at") <= now, "expires_at is not in the future"))
    return payloads.select("id", content.alias("content"), category.alias("category"), tags.alias("tags"), *kept, reason.alias("reject_reason"))


#: JSON nested deeper than this is not taken for JSON.
DEEPEST = 500
_DECODER = json.JSONDecoder()


def balanced(body: str) -> list[int]:
    """Where the objects and arrays begin that are balanced, in order. Strings may hold brackets; what lies before a bracket does not count as a string.

    From a bracket on, the next one outside strings is the same whichever bracket reading began at. So one pass from the
    end finds, for each bracket, the next, and with it what closes: each step looks at what is already known.
    """
    at = [m.start() for m in re.finditer(r'["\\\[\]{}]', body)]
    n = len(at)
    following, closing, height = [n] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    match = [-1] * n
    outside, quoted, after = n, n, n  # the next bracket from here, read outside and inside a string, and inside one mark later
    for k in range(n - 1, -1, -1):
        c = body[at[k]]
        if c == '"':
            outside, quoted, after = quoted, outside, quoted
            continue
        if c == "\\":
            escaped = k + 1 < n and at[k + 1] == at[k] + 1
            quoted, after = (after if escaped else quoted), quoted
            continue
        following[k], outside, after = outside, k, quoted
        if c in "}]":
            closing[k] = k
            continue
        end = closing[following[k]]
        if end >= 0 and body[at[end]] == ("}" if c == "{" else "]"):
            match[k] = end
            closing[k] = closing[following[end]]
            height[k] = max(height[following[k]] + 1, height[following[end]])
    depth = lambda k: height[following[k]] + 1
    return [at[k] for k in range(n) if match[k] >= 0 and depth(k) <= DEEPEST]


def salvage(text: str | None) -> str | None:
    """The JSON in a model's reply: the whole of it, the inside of a code fence, else the first balanced object or array that parses."""
    if not text:
        return None
    body = text.strip()
    if "```" in body:
        inside = body.split("```", 2)[1]
        whole = (body, inside.removeprefix("json").strip())
    else:
        whole = (body,)
    for part in whole:
        if part[:1] in ("{", "[") and parsed(part, 0) == len(part):
            return part
    for part in reversed(whole):
        for i in balanced(part):
            if (end := parsed(part, i)) > 0:
                return part[i:end]
    return None


def parsed(text: str, start: int) -> int:
    """Where the JSON that begins at ``start`` ends; 0 if there is none."""
    try:
        return _DECODER.raw_decode(text, start)[1]
    except (ValueError, RecursionError):
        return 0


def json_salvage(reply: Column) -> Column:
    """``salvage`` over a column; balanced brackets are beyond regular expressions, so this one is an Arrow-batched function."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(salvage, na_action="ignore")

    return run(reply)


class ModelError(Exception):
    """What a model's server answered instead of a reply: an HTTP status."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(status, message)
        self.status = status


def patiently(call: Callable[[], object], attempts: int, wait: float) -> object:
    """The result of ``call``, which is repeated after a lost connection or a status that may pass, with a wait that doubles. The last error is raised."""
    for tried in range(attempts):
        try:
            return call()
        except (ConnectionError, ModelError) as e:
            passes = isinstance(e, ConnectionError) or e.status >= 500 or e.status in TRANSIENT
            if not passes or tried + 1 == attempts:
                raise
            time.sleep(wait * 2**tried)
    raise ValueError("attempts must be at least 1")


def decide(rows: DataFrame, ask: Callable[[str], str], prompt_col: str, attempts: int = 3, wait: float = 0.5, error_col: str | None = None) -> DataFrame:
    """``rows`` with ``answer``: what a caller's model says to each prompt, salvaged; one repair question after an unreadable answer.

    ``ask`` raises ConnectionError or a ModelError; those that may pass are repeated after ``wait`` seconds, doubled each
    time; after ``attempts`` the answer is null. Any other error concerns its own row alone, whose answer is null at once. ``error_col``
    receives the kind of error: ``internal`` (worth another attempt of the job), ``validation``, or ``unreadable``.
    """

    @F.pandas_udf("answer string, error string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def once(prompt: str | None) -> tuple[str | None, str | None]:
            if prompt is None:
                return None, "validation"
            try:
                reply = patiently(lambda: ask(prompt), attempts, wait)
                if (got := salvage(reply)) is None:
                    got = salvage(patiently(lambda: ask(f"{prompt}\n\nThe answer was not JSON: {reply}"), attempts, wait))
                return got, None if got is not None else "unreadable"
            except ConnectionError:
                return None, "internal"
            except ModelError as e:
                return None, "internal" if e.status >= 500 or e.status in TRANSIENT else "validation"
            except Exception:  # noqa: BLE001 a row that breaks the model must not stop the others
                return None, "validation"

        for part in prompts:
            yield pd.DataFrame([once(p) for p in part], columns=["answer", "error"])

    said = rows.withColumn("_said", run(F.col(prompt_col)))
    said = said.withColumn("answer", F.col("_said.answer"))
    return (said if error_col is None else said.withColumn(error_col, F.col("_said.error"))).drop("_said")


STOPPED = "the worker holding this job stopped"


def job_states(events: DataFrame, now: Column, attempts: int = S.JOB_ATTEMPTS) -> DataFrame:
    """Each job's record from its log (job_id, seq, at, event, error kind): enqueue, claim, succeed, fail.

    A retryable failure waits with doubling backoff until ``attempts`` are spent; others go to the dead
    letters at once; a claim older than 15 minutes without an outcome is pending again, from now on. A job's log is a
    few events an attempt.
    """
    from ..functions.scores import backoff_seconds, retryable

    ordered = F.array_sort(F.collect_list(F.struct("seq", "at", "event", "error")))
    none = F.lit(None)
    stamp = none.cast("timestamp_ntz")
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), stamp.alias("created_at"), stamp.alias("updated_at"), stamp.alias("run_after"), stamp.alias("claimed_at"), none.cast("string").alias("error"))

    def step(s: Column, e: Column) -> Column:
        enqueue, claim, fail = (e["event"] == x for x in ("enqueue", "claim", "fail"))
        again = fail & retryable(e["error"]) & (s["attempts"] < attempts)
        wait = e["at"] + F.make_dt_interval(secs=backoff_seconds(s["attempts"]))
        return F.struct(
            F.when(claim, "running").when(e["event"] == "succeed", "succeeded").when(again, "pending").when(fail, "dead_letter").otherwise(s["status"]).alias("status"),
            (s["attempts"] + F.when(claim, 1).otherwise(0)).alias("attempts"),
            F.coalesce(s["created_at"], F.when(enqueue, e["at"])).alias("created_at"),
            e["at"].alias("updated_at"),
            F.when(enqueue, e["at"]).when(again, wait).otherwise(s["run_after"]).alias("run_after"),
            F.when(claim, e["at"]).when(enqueue, s["claimed_at"]).alias("claimed_at"),
            F.when(fail, e["error"]).otherwise(s["error"]).alias("error"),
        )

    folded = events.groupBy("job_id").agg(F.aggregate(ordered, start, step).alias("s")).select("job_id", "s.*")
    stale = (F.col("status") == "running") & (F.col("claimed_at") <= now - F.make_dt_interval(mins=F.lit(S.STALE_MINUTES)))
    again = {"status": F.lit("pending"), "run_after": now, "updated_at": now, "claimed_at": stamp, "error": F.coalesce("error", F.lit(STOPPED))}
    marked = folded.withColumn("_stale", stale)
    return marked.withColumns({k: F.when(F.col("_stale"), v).otherwise(F.col(k)) for k, v in again.items()}).drop("_stale")


def claimable(states: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The first ``n`` pending jobs whose time has come, by run_after, then age, then id."""
    return states.filter((F.col("status") == "pending") & (F.col("run_after") <= now)).orderBy("run_after", "created_at", "job_id").limit(n)


def job_of(states: DataFrame, owners: DataFrame, wanted: DataFrame) -> DataFrame:
    """The record of each wanted (user_id, job_id), ``owners`` saying whose a job is; a missing and a foreign job both have ``found`` false."""
    own = states.join(owners.select("job_id", "user_id"), "job_id").withColumn("found", F.lit(True))
    return wanted.select("user_id", "job_id").distinct().join(own, ["user_id", "job_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def status_name(status: Column) -> Column:
    """A job's status as a caller is told: a dead letter has failed."""
    return F.when(status == "dead_letter", "failed").otherwise(status)


def finished(saved: DataFrame, now: Column) -> DataFrame:
    """The log of jobs that were done at once: (job_id, seq, at, event, error) from rows (id, reject_reason), one enqueue, claim and outcome each."""
    steps = F.array(F.lit("enqueue"), F.lit("claim"), F.when(F.col("reject_reason").isNull(), "succeed").otherwise("fail"))
    rows = saved.select(F.col("id").alias("job_id"), F.posexplode(steps).alias("seq", "event"))
    return rows.select("job_id", F.col("seq").cast("long").alias("seq"), now.alias("at"), "event", F.when(F.col("event") == "fail", "validation").alias("error"))


def distilled(transcripts: DataFrame, client: str = "session-distill") -> tuple[DataFrame, DataFrame]:
    """(payloads of whole sessions for a model to draw memories from, rejected sessions). No category is hinted at: a session holds several kinds."""
    good = transcripts.filter("reject_reason IS NULL").select(F.col("conv_id").alias("id"), F.col("transcript").alias("content"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("tags"), F.lit(client).alias("client"), F.col("conv_id").cast("string").alias("session_id"))
    return good, transcripts.filter("reject_reason IS NOT NULL").select("conv_id", "reject_reason")


def merge_decisions(answers: DataFrame, clusters: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """(cluster_id, merge, content, category, tags, reason) from (cluster_id, answer); whatever is unusable keeps the cluster as it is.

    ``clusters`` (cluster_id, category) gives the category of an answer that names none; a name that is not known resolves as usual.
    """
    said = F.from_json("answer", "merge boolean, content string, category string, tags array<string>, reason string")
    rows = answers.join(clusters.select("cluster_id", F.col("category").alias("_own")), "cluster_id", "left").select("cluster_id", "_own", said.alias("d"))
    content = F.nullif(T.tidy(F.coalesce("d.content", F.lit(""))), F.lit(""))
    asked = F.coalesce(F.col("d.merge"), F.lit(False))
    reason = F.when(asked & content.isNull(), "the decision to merge has no content").otherwise(F.coalesce("d.reason", F.lit("no reason given")))
    category = F.when(F.col("d.category").isNull(), F.coalesce("_own", F.lit("reference"))).otherwise(T.resolve_category(F.col("d.category"), extras)["category"])
    merge = asked & content.isNotNull()
    only = lambda c: F.when(merge, c)
    tags = F.filter(F.coalesce("d.tags", F.array().cast("array<string>")), lambda t: t.isNotNull())
    return rows.select("cluster_id", merge.alias("merge"), only(content).alias("content"), only(category).alias("category"), only(tags).alias("tags"), reason.alias("reason"))
