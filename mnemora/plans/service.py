"""Further registered queries of the memory engine: runs, commits, model adapters, texts shown, lookups."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import prompts, render, scores
from ..operators import embedding, events, ingest, reports, run
from ..operators.embedding import hash_embed
from ..sources import store
from ..sources.collection import Collection
from ..sources.session import scratch
from . import fixtures as X
from .fixtures import sql
from .queries import FOLD, JOBS, SQL, THRESHOLD, job_log, job_records, log, query, recursive, users


def md5(c) -> F.Column:
    return F.md5(F.col(c).cast("binary")) if isinstance(c, str) else F.md5(c.cast("binary"))


# Runs and commits


def consolidated(spark, d):
    """A run over all users without a model; one vector of the third user is broken."""
    rows = X.memories(spark, d)
    vectors = hash_embed(rows.select("user_id", "memory_id", "content"), ["user_id", "memory_id"], "content")
    first = rows.filter("user_id = 3 AND deleted_at IS NULL AND superseded_by IS NULL AND expires_at IS NULL").agg(F.min("memory_id")).first()[0]
    broken = vectors.withColumn("embedding", F.when(F.col("memory_id") == F.lit(first), F.array(F.lit(float("nan")))).otherwise(F.col("embedding")))
    state = spark.createDataFrame([], "user_id long, category string, sub string, recorded_at timestamp_ntz")
    return Engine(rows, broken, X.clock(spark, d)).consolidate(state, None, scratch(spark, "run"), THRESHOLD, 0, 0, -1 - F.col("cluster_id"))


@query(recursive("""SELECT '@' SELECT user_id, CASE WHEN user_id = 3 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN user_id = 3 THEN '1 memories without a usable vector' END AS reason, CASE WHEN user_id = 3 THEN 0 ELSE groups END AS groups,
  CASE WHEN user_id = 3 THEN 0 ELSE coalesce(clusters, 0) END AS clusters, CASE WHEN user_id = 3 THEN 0 ELSE coalesce(clusters, 0) END AS merged, CASE WHEN user_id = 3 THEN 0 ELSE coalesce(retired, 0) END AS retired
FROM (SELECT user_id, count(*) AS groups FROM (SELECT user_id, category, coalesce(subcategory, '') AS sub FROM live GROUP BY ALL HAVING count(*) >= 2) GROUP BY user_id) g
LEFT JOIN (SELECT e.user_id, count(DISTINCT cluster_id) AS clusters, count(*) AS retired FROM parts p JOIN e ON e.memory_id = p.memory_id GROUP BY e.user_id) c USING (user_id)"""))
def run_outcomes(spark, d):
    """What a run does for each user; the one with a broken vector is reported, and the others are as if it were not there."""
    return consolidated(spark, d).outcomes


@query(recursive("""SELECT '@' SELECT 'delete' AS operation, memory_id, NULL AS by FROM mem CROSS JOIN now WHERE deleted_at IS NULL AND expires_at <= now.now
UNION ALL SELECT 'add', -1 - cluster_id, NULL FROM parts p JOIN e ON e.memory_id = p.memory_id WHERE e.user_id <> 3 GROUP BY cluster_id UNION ALL SELECT 'merge', p.memory_id, -1 - cluster_id FROM parts p JOIN e ON e.memory_id = p.memory_id WHERE e.user_id <> 3"""))
def run_log(spark, d):
    """The events of a run: expired memories go, clusters are replaced."""
    return consolidated(spark, d).events.select("operation", "memory_id", F.col("superseded_by").alias("by"))


@query(sql(FOLD, "mem", "roll"))
def collection_state(spark, d):
    """A history in two commits, the first folded and merged: what a reader sees of log and state."""
    held, rows = Collection(spark, scratch(spark, "collection")), log(spark, d)
    for batch in range(2):
        held.commit(batch, rows.filter((F.col("seq") >= 3) == (batch == 1)))
        if not batch:
            held.tidy()
    return held.memories().select("memory_id", "user_id", "category", "expires_at", "superseded_by", "deleted_at", "updated_at", "access_count")


@query(sql(f"SELECT memory_id, superseded_by, md5(content) AS content FROM ({FOLD}) f JOIN (SELECT memory_id, content FROM mem) m USING (memory_id) WHERE deleted_at IS NULL", "mem", "roll"))
def collection_index(spark, d):
    """The rows of the index that the same commits leave."""
    held, rows = Collection(spark, scratch(spark, "collection")), log(spark, d)
    for batch in range(2):
        held.commit(batch, rows.filter((F.col("seq") >= 3) == (batch == 1)))
    return held.index().memories.select("memory_id", "superseded_by", md5("content").alias("content"))


# Models


def unsure(prompt: str) -> str:
    """A stand-in that answers by the number in its prompt: JSON, JSON when asked again, never, not at all, or not allowed."""
    n = int(prompt.split()[0])
    if n % 5 == 1 and "not JSON" not in prompt or n % 5 == 2:
        return "I would rather talk"
    if n % 5 == 3:
        raise ingest.ModelError(503)
    if n % 5 == 4:
        raise ingest.ModelError(401)
    return json.dumps({"n": n})


@query("SELECT item_id, CASE WHEN item_id % 5 < 2 THEN item_id END AS n, CASE item_id % 5 WHEN 2 THEN 'unreadable' WHEN 3 THEN 'internal' WHEN 4 THEN 'validation' END AS error FROM benchmark")
def model_answers(spark, d):
    """Answers that are repaired, retried, and given up."""
    rows = X.table(spark, d, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(" "), F.col("text")).alias("prompt"))
    got = ingest.decide(rows, unsure, "prompt", 2, 0.0, "error")
    return got.select("item_id", F.get_json_object("answer", "$.n").cast("long").alias("n"), "error")


@query("SELECT event_id, 200 + event_id % 400 AS status, CASE WHEN status < 300 THEN NULL WHEN status >= 500 OR status IN (408, 409, 429) THEN 'internal' ELSE 'validation' END AS kind, coalesce(kind = 'internal', false) AS again FROM events")
def status_kinds(spark, d):
    """What HTTP answers mean to a job."""
    status = 200 + F.col("event_id") % 400
    return X.table(spark, d, "events").select("event_id", status.alias("status"), scores.error_kind(status).alias("kind"), scores.transient_status(status).alias("again"))


def provider(texts: list[str]) -> list[dict]:
    """A stand-in that answers in another order than it is asked."""
    return [{"index": i, "embedding": [len(t), len(t) % 7, i * 0]} for i, t in reversed(list(enumerate(texts)))]


@query("SELECT doc_id, length(text)::DOUBLE AS x, (length(text) % 7)::DOUBLE AS y, 3 AS d FROM documents")
def remote_embedding(spark, d):
    """Vectors of a provider, in the order of what was asked."""
    made = embedding.remote_embed(X.table(spark, d, "documents").select("doc_id", "text"), "text", provider, 3)
    return made.select("doc_id", F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y"), F.size("embedding").alias("d"))


@query("SELECT model, dimensions, count(*) AS collections FROM (SELECT DISTINCT source, CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'old' ELSE 'new' END AS model, CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 64 ELSE 32 END AS dimensions FROM documents) WHERE NOT (model = 'new' AND dimensions = 64) GROUP BY model, dimensions")
def other_pins(spark, d):
    """Collections that another model or width embedded."""
    n = F.substring("source", 4, 9).cast("int")
    pins = X.table(spark, d, "documents").select("source").distinct().select(F.when(n % 3 == 0, "old").otherwise("new").alias("model"), F.when(n % 2 == 0, 64).otherwise(32).alias("dimensions"))
    return embedding.other_pins(pins, "new", 64)


def lengths(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), 1.0] for t in texts])


@query(sql("SELECT user_id, memory_id, length(content)::DOUBLE AS x FROM mem WHERE deleted_at IS NULL", "mem"))
def reindexed(spark, d):
    """All memories that are not deleted embedded anew."""
    return store.reindex(X.memories(spark, d), scratch(spark, "reindex"), lengths, "lengths", 2).select("user_id", "memory_id", F.element_at("embedding", 1).alias("x"))


# Jobs


@query(f"""{JOBS}, wanted AS (SELECT DISTINCT user_id AS job_id, user_id % 3 AS user_id FROM events) SELECT w.user_id, w.job_id, j.status IS NOT NULL AS found, j.status, j.attempts FROM wanted w LEFT JOIN jobs j ON j.job_id = w.job_id AND w.job_id % 2 = w.user_id""")
def job_lookup(spark, d):
    """Each job asked for by one user; half belong to another, or to none."""
    asked = X.table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("user_id") % 3).alias("user_id")).distinct()
    owners = job_log(spark, d).select("job_id", (F.col("job_id") % 2).alias("user_id")).distinct()
    return ingest.job_of(job_records(spark, d), owners, asked).select("user_id", "job_id", "found", "status", "attempts")


@query(r"""SELECT conv_id * 100 + turn AS job_id, i AS seq, ['enqueue', 'claim', CASE WHEN c = '' OR length(c) > 4000 THEN 'fail' ELSE 'succeed' END][i + 1] AS event, CASE WHEN i = 2 AND (c = '' OR length(c) > 4000) THEN 'validation' END AS error
FROM (SELECT *, regexp_replace(regexp_replace(CASE WHEN turn = 3 THEN ' ' ELSE text END, '^\s+', ''), '\s+$', '') AS c FROM conversations), (SELECT unnest([0, 1, 2])::BIGINT AS i)""")
def finished_jobs(spark, d):
    """The jobs that saves at once leave behind; fourth turns are empty."""
    rows = X.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") == 3, " ").otherwise(F.col("text")).alias("content"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("tags"))
    return ingest.finished(ingest.verbatim(rows), X.clock(spark, d)).select("job_id", "seq", "event", "error")


# Texts


def shape(kind: str) -> str:
    return f"chr(10) || chr(10) || 'Answer with JSON of this shape only: {prompts.SHAPES[kind]}'"


LINE = "replace(replace({}, chr(13), ' '), chr(10), ' ')"


@query(f"SELECT doc_id, md5('{prompts.LENSES['message']}' || chr(10) || 'Categories: {prompts.names(('own.kind',))}' || chr(10) || chr(10) || text || {shape('extract')}) AS digest FROM documents")
def extraction_prompts(spark, d):
    """What a model is asked of each document."""
    return X.table(spark, d, "documents").select("doc_id", md5(prompts.extraction(F.col("text"), "message", ("own.kind",))).alias("digest"))


@query(f"""SELECT conv_id, turn, md5('New fact: ' || {LINE.format('text')} || chr(10) || 'Stored memories near it:' || chr(10) || coalesce((SELECT string_agg('- ' || turn || ': ' || {LINE.format('text')}, chr(10) ORDER BY turn) FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn < c.turn), '(none)')
|| chr(10) || chr(10) || 'Is it new, does it replace or refute one of them, or is it known?' || {shape('reconcile')}) AS digest FROM conversations c""")
def reconciliation_prompts(spark, d):
    """What a model is asked of each turn, the earlier ones standing for what is stored."""
    turns = X.table(spark, d, "conversations")
    own = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("memory_id"), F.col("text").alias("content"))))
    whole = turns.groupBy("conv_id").agg(own.alias("all"))
    rows = turns.join(whole, "conv_id")
    return rows.select("conv_id", "turn", md5(prompts.reconciliation(F.col("text"), F.filter("all", lambda m: m["memory_id"] < F.col("turn")))).alias("digest"))


@query(sql(f"""SELECT user_id, domain, md5('Describe this person in at most 300 words, from their ' || domain || ' memories alone; give an empty text if they say nothing.' || chr(10) || string_agg('- [' || category || '] ' || {LINE.format('content')}, chr(10) ORDER BY position) || {shape('digest')}) AS digest
FROM (SELECT *, CASE WHEN category IN ('preference.personal', 'fact.person') THEN 'personal' ELSE 'coding' END AS domain, row_number() OVER (PARTITION BY user_id, domain ORDER BY round(importance, 12) DESC, confidence DESC, created_at DESC, memory_id) AS position FROM live) WHERE position <= 200 GROUP BY user_id, domain""", "live"))
def digest_prompts(spark, d):
    """What a model is asked of each user's memories."""
    rows = reports.digest_rows(X.scored(spark, d).withColumn("importance", F.round("importance", 12)), X.clock(spark, d))
    return prompts.digest(rows).select("user_id", "domain", md5("prompt").alias("digest"))


def left_by(spark, d):
    """Every third document as a memory that its source left; sources also stand with nothing."""
    docs = X.table(spark, d, "documents")
    return docs.select(F.col("source").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("memory_id"), F.lit("skill").alias("category"), F.col("text").alias("content"))


def listed(head: str, none: str) -> str:
    return f"SELECT source AS id, md5(CASE WHEN count(*) FILTER (doc_id % 3 = 0) = 0 THEN '{none}' ELSE '{head} ' || count(*) FILTER (doc_id % 3 = 0) || CASE WHEN count(*) FILTER (doc_id % 3 = 0) = 1 THEN ' memory' ELSE ' memories' END || chr(10) || string_agg('- [skill] ' || {LINE.format('text')} || ' (id ' || doc_id || ')', chr(10) ORDER BY doc_id) FILTER (doc_id % 3 = 0) END) AS digest FROM documents GROUP BY source"


@query(listed("Saved", "Nothing new was stored: it is known already, or holds nothing lasting."))
def saved_texts(spark, d):
    return render.saved(left_by(spark, d), ["id"], True).select("id", md5("text").alias("digest"))


@query(listed("Kept from this session:", "Nothing in this session needed keeping, as is usual."))
def distilled_texts(spark, d):
    return render.distilled(left_by(spark, d), ["id"]).select("id", md5("text").alias("digest"))


@query(listed("Not deleted yet, to be confirmed by id:", "Nothing matches, so nothing can be forgotten."))
def forget_texts(spark, d):
    return render.forget_candidates(left_by(spark, d), ["id"]).select("id", md5("text").alias("digest"))


@query(sql("SELECT user_id, CASE n WHEN 0 THEN 'No memory was deleted.' WHEN 1 THEN 'Deleted 1 memory.' ELSE 'Deleted ' || n || ' memories.' END AS text FROM (SELECT user_id, category, subcategory, count(*) FILTER (deleted_at IS NULL AND memory_id % 9 = 0) AS n FROM mem GROUP BY ALL)", "mem"))
def forgotten_texts(spark, d):
    """How many of the wanted ids were deleted, for each group of memories."""
    rows = X.memories(spark, d)
    wanted = rows.filter("memory_id % 9 = 0").select("user_id", "memory_id")
    gone = events.forget(rows, wanted, X.clock(spark, d)).filter("found").select("user_id", "memory_id", F.lit(1).alias("gone"))
    n = rows.join(gone, ["user_id", "memory_id"], "left").groupBy("user_id", "category", "subcategory").agg(F.count("gone").alias("n"))
    return n.select("user_id", render.forgotten(F.col("n")).alias("text"))


@query(SQL["export_markdown"])
def export_lines(spark, d):
    """The lines of the same exports."""
    lines = reports.document_lines(X.memories(spark, d), users(spark, d), "markdown", include_inactive=True)
    return reports.document_digests(lines, scratch(spark, "lines"))


@query(SQL["export_json"])
def export_json_lines(spark, d):
    """The lines of the same exports as JSON: how many objects, and the first."""
    rows = reports.document_lines(X.memories(spark, d), users(spark, d), "json")
    last = F.max("part").alias("last")
    ends = rows.filter("part <> 1").groupBy("user_id").agg(F.count("*").alias("ends"), last)
    return reports.json_listed(rows).join(ends.filter("ends = 2 AND last = 2"), "user_id").select("user_id", "n", F.col("first").alias("newest"))


@query(sql("""SELECT user_id, md5('# Memory profile: user' || user_id || ' (updated ' || strftime(now.now, '%Y-%m-%d') || ')' || chr(10) || CASE WHEN coding IS NOT NULL AND strlen(coding) <= 350 THEN chr(10) || '## How they work' || chr(10) || chr(10) || coding || chr(10) ELSE '' END || CASE WHEN personal IS NOT NULL THEN chr(10) || '## Who they are' || chr(10) || chr(10) || personal || chr(10) ELSE '' END) AS digest
FROM (SELECT user_id, max(CASE WHEN n > 0 THEN 'knows ' || n || ' things' || CASE WHEN user_id = 1 THEN repeat('.', 400) ELSE '' END END) AS coding, max('has ' || p || ' others') AS personal FROM (SELECT user_id, count(*) FILTER (category NOT IN ('preference.personal', 'fact.person')) AS n, count(*) AS p FROM live GROUP BY user_id) GROUP BY user_id) CROSS JOIN now""", "live"))
def digest_sizes(spark, d):
    """Digests of every user's memories put into profiles: the first user's longer one is over the budget and left out."""
    rows, now = X.memories(spark, d), X.clock(spark, d)
    live = reports.current(rows, now).groupBy("user_id").agg(F.count("*").alias("n"))
    coding = live.select("user_id", F.lit("coding").alias("domain"), F.concat(F.lit("knows "), "n", F.lit(" things"), F.when(F.col("user_id") == 1, F.repeat(F.lit("."), 400)).otherwise("")).alias("content"))
    personal = live.select("user_id", F.lit("personal").alias("domain"), F.concat(F.lit("has "), "n", F.lit(" others")).alias("content"))
    who = live.select("user_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("handle"))
    made = reports.digest_profile(coding.unionByName(personal), who, who.select("user_id", F.lit("plain").alias("text")), now, 400)
    return made.select("user_id", md5("text").alias("digest"))


@query(sql("SELECT count(*) FILTER (user_id = 3) AS failed_users, count(*) AS users FROM (SELECT DISTINCT user_id FROM live)", "live"))
def quarantined(spark, d):
    """Users whose vectors a run cannot use."""
    rows = X.memories(spark, d)
    short = rows.select("user_id", "memory_id", F.when((F.col("user_id") == 3) & (F.col("memory_id") % 2 == 0), F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("embedding"))
    bad = run.quarantine(rows, short, X.clock(spark, d)).agg(F.count("*").alias("failed_users"))
    return bad.crossJoin(reports.current(rows, X.clock(spark, d)).agg(F.countDistinct("user_id").alias("users")))
