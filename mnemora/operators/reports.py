"""Reports: profile, digest selection, exports, fingerprints, retrieval quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import digest
from ..functions.text import domain, one_line, tag_suffix
from .recall import active
from .reconcile import written


def current(memories: DataFrame, now: Column) -> DataFrame:
    return memories.filter("deleted_at IS NULL").filter(active(now))


def profile_rows(memories: DataFrame, now: Column, per_category: int = S.PROFILE_ROWS) -> DataFrame:
    """The first ``per_category`` memories of each user's sections with their section's size; custom categories share ``other``."""
    section = F.when(F.col("category").isin(*S.CATEGORIES), F.col("category")).otherwise("other")
    rows = current(memories, now).withColumn("section", section)
    order = Window.partitionBy("user_id", "section").orderBy(F.col("confidence").desc(), F.col("created_at").desc(), F.col("memory_id"))
    sizes = rows.groupBy("user_id", "section").agg(F.count("*").alias("total"))
    kept = rows.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= per_category)
    return kept.join(sizes, ["user_id", "section"])


def sections(rows: DataFrame) -> DataFrame:
    """(user_id, section, ordinal, total, shown, body): each section's text."""
    names = list(S.PROFILE_ORDER)
    heading = F.create_map(*(F.lit(x) for k, v in [*S.PROFILE_ORDER.items(), ("other", "other")] for x in (k, v)))
    ordinal = F.create_map(*(F.lit(x) for i, k in enumerate([*names, "other"]) for x in (k, i)))
    line = F.concat(F.lit("- "), one_line(F.col("content")), tag_suffix(F.col("tags")), F.lit("\n"))
    lines = rows.withColumn("line", line).groupBy("user_id", "section", "total").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    body = F.concat(F.lit("\n## "), heading[F.col("section")], F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), ""))
    return lines.select("user_id", "section", ordinal[F.col("section")].alias("ordinal"), "total", F.size("l").cast("long").alias("shown"), body.alias("body"))


def profile(memories: DataFrame, users: DataFrame, now: Column, budget: int = S.PROFILE_BYTES) -> DataFrame:
    """(user_id, text, included, omitted) for every user, by a fold over at most nine sections.

    A section that would exceed the budget in bytes is skipped, and a later, smaller one may still fit.
    """
    made = sections(profile_rows(memories, now))
    head = F.concat(F.lit("# Memory profile: "), F.col("handle"), F.lit(" (updated "), F.date_format(now, "yyyy-MM-dd"), F.lit(")\n"))
    parts = made.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "section", "total", "shown", "body"))).alias("parts"))

    def step(s: Column, p: Column) -> Column:
        fits = F.octet_length(s["text"]) + F.octet_length(p["body"]) <= budget
        beyond = F.when(p["section"] == "other", F.lit(0)).otherwise(p["total"] - p["shown"])
        return F.struct(
            F.when(fits, F.concat(s["text"], p["body"])).otherwise(s["text"]).alias("text"),
            (s["included"] + F.when(fits, p["shown"]).otherwise(0)).alias("included"),
            (s["omitted"] + beyond + F.when(fits, F.lit(0)).otherwise(p["shown"])).alias("omitted"),
        )

    start = F.struct(head.alias("text"), F.lit(0).cast("long").alias("included"), F.lit(0).cast("long").alias("omitted"))
    joined = users.select("user_id", "handle").join(parts, "user_id", "left")
    folded = joined.select("user_id", "parts", head.alias("head"), F.aggregate(F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)), start, step).alias("s"))
    note = F.concat(F.lit("\n_"), F.col("s.included").cast("string"), F.lit(" of "), (F.col("s.included") + F.col("s.omitted")).cast("string"), F.lit(" memories shown. Recall the rest by searching._\n"))
    text = F.when(F.col("parts").isNull(), F.concat("head", F.lit("\nNo memories stored yet.\n"))).otherwise(F.concat(F.col("s.text"), F.when(F.col("s.omitted") > 0, note).otherwise("")))
    return folded.select("user_id", text.alias("text"), F.col("s.included").alias("included"), F.col("s.omitted").alias("omitted"))


def fingerprints(memories: DataFrame, now: Column) -> DataFrame:
    """(user_id, domain, fingerprint): count and newest update of the active memories of each domain."""
    rows = current(memories, now).withColumn("domain", domain(F.col("category"))).groupBy("user_id", "domain")
    stamp = F.coalesce(F.date_format(F.max("updated_at"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-"))
    return rows.agg(F.concat_ws(":", F.count("*").cast("string"), stamp).alias("fingerprint"))


def stale_digests(prints: DataFrame, cache: DataFrame) -> DataFrame:
    """Domains whose cached digest is missing or was made from another fingerprint."""
    old = cache.select("user_id", "domain", F.col("fingerprint").alias("_old"))
    return prints.join(old, ["user_id", "domain"], "left").filter(~F.coalesce(F.col("_old") == F.col("fingerprint"), F.lit(False))).drop("_old")


def digest_rows(memories: DataFrame, now: Column, rows: int = S.DIGEST_ROWS) -> DataFrame:
    """The memories that a digest is written from: the first ``rows`` of each domain by importance, confidence, age, id."""
    order = Window.partitionBy("user_id", "domain").orderBy(F.col("importance").desc(), F.col("confidence").desc(), F.col("created_at").desc(), F.col("memory_id"))
    found = current(memories, now).withColumn("domain", domain(F.col("category")))
    return found.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= rows)


def markdown_rows(memories: DataFrame, include_inactive: bool = False) -> DataFrame:
    """(user_id, category, memory_id, line): an export's lines. Without ``include_inactive`` superseded rows go, expired ones stay."""
    rows = memories.filter("deleted_at IS NULL")
    if not include_inactive:
        rows = rows.filter("superseded_by IS NULL")
    notes = F.concat_ws(" · ", F.date_format("created_at", "yyyy-MM-dd"), F.when(F.size("tags") > 0, F.array_join("tags", ", ")), F.when(F.col("superseded_by").isNotNull(), "superseded"))
    line = F.concat(F.lit("- "), F.regexp_replace("content", "\n", " "), F.lit("  _("), notes, F.lit(")_"))
    return rows.select("user_id", "category", "memory_id", "created_at", line.alias("line"))


def json_rows(memories: DataFrame, include_inactive: bool = False) -> DataFrame:
    """(user_id, memory_id, json): one object of eight fields a memory."""
    rows = memories.filter("deleted_at IS NULL")
    if not include_inactive:
        rows = rows.filter("superseded_by IS NULL")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    body = F.struct(F.col("memory_id").cast("string").alias("id"), "content", "category", "tags", "confidence", stamp("created_at"), stamp("updated_at"), F.col("superseded_by").cast("string").alias("superseded_by"))
    return rows.select("user_id", "memory_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def quality_metrics(results: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per case: name, kind, recall, top_hit, missed; per kind and over all: cases, recall_at_k, precision_at_1 in percent).

    ``results``: (name, position, content); ``cases``: (name, kind, expect).
    """
    got = results.groupBy("name").agg(F.collect_set("content").alias("got"), F.min_by("content", "position").alias("first"))
    rows = cases.join(got, "name", "left")
    missed = F.array_except("expect", F.coalesce("got", F.array().cast("array<string>")))
    scored = rows.select("name", "kind", "expect", missed.alias("missed"), F.coalesce(F.array_contains("expect", F.col("first")), F.lit(False)).alias("top_hit"))
    scored = scored.select("name", "kind", (1 - F.size("missed") / F.size("expect")).alias("recall"), "top_hit", "missed")
    mean = [F.count("*").alias("cases"), (F.avg("recall") * 100).alias("recall_at_k"), (F.avg(F.col("top_hit").cast("int")) * 100).alias("precision_at_1")]
    return scored, scored.groupBy("kind").agg(*mean).union(scored.agg(F.lit("all"), *mean))


def regressions(report: DataFrame, baseline: DataFrame, most: float = 5.0) -> DataFrame:
    """Kinds in both tables whose recall fell by more than ``most`` points."""
    old = baseline.select("kind", F.col("recall_at_k").alias("before"))
    return report.join(old, "kind").filter(F.col("before") - F.col("recall_at_k") > most).select("kind", "before", "recall_at_k")


def latency(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean, p50, p95, p99 and maximum of a value; percentiles are values that occur, at the rank p / 100 x n rounded half to even.

    Counted by distinct value first, so a group's task orders its values and not its samples. Nulls do not count.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    whole, order = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(value)
    ranked = counted.withColumns({"_n": F.sum("_c").over(whole), "_to": F.sum("_c").over(order)})
    rank = lambda p: F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.lit(p) / 100 * F.col("_n")).cast("long")))
    at = lambda p: F.min(F.when(F.col("_to") >= rank(p), F.col(value)))
    mean = F.sum(F.col(value) * F.col("_c")) / F.sum("_c")
    return ranked.groupBy(*group).agg(F.sum("_c").alias("n"), mean.alias("mean"), at(50.0).alias("p50"), at(95.0).alias("p95"), at(99.0).alias("p99"), F.max(value).alias("max"))


def markdown_documents(memories: DataFrame, users: DataFrame, include_inactive: bool = False) -> DataFrame:
    """(user_id, text): each user's export as one document: title, count, and a heading a category, newest first within it.

    A document is as long as its user's memories; ``store.export`` writes the lines instead, for any number of them.
    """
    rows = markdown_rows(memories, include_inactive)
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"), "memory_id", "line")))
    lines = rows.groupBy("user_id", "category").agg(F.count("*").alias("n"), newest.alias("lines"))
    body = F.concat(F.lit("\n## "), F.col("category"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    parts = lines.groupBy("user_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("category", body.alias("body")))).alias("parts"))
    made = users.select("user_id", "handle").join(parts, "user_id", "left")
    head = F.concat(F.lit("# Memories of "), F.col("handle"), F.lit("\n\n"), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" memories\n"))
    return made.select("user_id", F.concat(head, F.coalesce(F.array_join(F.transform("parts", lambda p: p["body"]), ""), F.lit(""))).alias("text"))


def json_documents(memories: DataFrame, users: DataFrame, include_inactive: bool = False) -> DataFrame:
    """(user_id, json): each user's export as one object with a list ``memories``, newest first.

    A row holds all of its user's memories; for users of any size there are ``document_lines``.
    """
    rows = json_rows(memories, include_inactive).join(memories.select("user_id", "memory_id", "created_at"), ["user_id", "memory_id"])
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"), "memory_id", "json")))
    parts = rows.groupBy("user_id").agg(newest.alias("rows"))
    made = users.select("user_id").join(parts, "user_id", "left")
    inner = F.coalesce(F.array_join(F.transform("rows", lambda x: x["json"]), ","), F.lit(""))
    return made.select("user_id", F.concat(F.lit('{"memories":['), inner, F.lit("]}")).alias("json"))


PLACE = ["part", "category", "newest", "memory_id"]
#: Bytes of a document that a task reads.
PIECE_BYTES = 128 << 20


def document_lines(memories: DataFrame, users: DataFrame, form: str, include_inactive: bool = False) -> DataFrame:
    """(user_id, part, category, newest, memory_id, value): the lines of every user's export, a row each.

    In the order of these columns, with a line end after each, they are the documents of ``markdown_documents`` and
    ``json_documents``; a user of any size is spread over many rows, and nothing is gathered by user.
    """
    stamp = (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("newest")
    none = lambda t: F.lit(None).cast(t)
    row = lambda part, category, newest, memory, value: ["user_id", F.lit(part).alias("part"), category.alias("category"), newest.alias("newest"), memory.alias("memory_id"), value.alias("value")]
    known = users.select("user_id", "handle")
    # texts are dealt by memory; only keys are ever dealt by user, of whom one may have most of the rows
    keys = ["user_id", "memory_id"]
    kept = memories.filter("deleted_at IS NULL").select(*keys, stamp).join(known.select("user_id"), "user_id", "left_semi")
    if form == "json":
        rows = json_rows(memories, include_inactive).join(kept, keys)
        first = rows.groupBy("user_id").agg(F.min(F.struct("newest", "memory_id")).alias("first")).select("user_id", "first.memory_id", F.lit(True).alias("first"))
        body = rows.join(first, keys, "left").select(*row(1, none("string"), F.col("newest"), F.col("memory_id"), F.concat(F.when(F.col("first"), "").otherwise(","), "json")))
        ends = [known.select(*row(part, none("string"), none("long"), none("long"), F.lit(text))) for part, text in ((0, '{"memories":['), (2, "]}"))]
        return ends[0].unionByName(body).unionByName(ends[1])
    rows = markdown_rows(memories, include_inactive).join(kept.select(*keys), keys, "left_semi")
    counts = rows.groupBy("user_id", "category").agg(F.count("*").alias("n"))
    whole = known.join(counts.groupBy("user_id").agg(F.sum("n").alias("n")), "user_id", "left")
    title = F.concat(F.lit("# Memories of "), F.col("handle"), F.lit("\n\n"), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" memories"))
    head = whole.select(*row(0, none("string"), none("long"), none("long"), title))
    headings = counts.select(*row(1, F.col("category"), none("long"), none("long"), F.concat(F.lit("\n## "), "category", F.lit("\n"))))
    return head.unionByName(headings).unionByName(rows.select(*row(1, F.col("category"), stamp, F.col("memory_id"), F.col("line"))))


def document_digests(lines: DataFrame, path: str, most: int = PIECE_BYTES) -> DataFrame:
    """(user_id, digest): the MD5 of every document that ``lines`` (of ``document_lines``) are, whole documents being nowhere.

    A document is cut after days into pieces of some ``most`` bytes. A piece is one task, which takes up the state that the
    task before it left; so what a task reads is bounded, and there are as many passes as the longest document has pieces.
    """
    day = ["user_id", "part", "category", "day"]
    rows = lines.select("user_id", "part", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("newest", F.lit(-(2**62))).alias("newest"), F.coalesce("memory_id", F.lit(-1)).alias("memory_id"), "value")
    rows = rows.withColumn("day", F.floor(F.col("newest") / 86_400_000_000))
    before = Window.partitionBy("user_id").orderBy(*day[1:]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*day).agg(F.sum(F.octet_length("value") + 1).alias("size"))
    dealt = written(sizes.select(*day, F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / most).cast("int").alias("piece")), f"{path}/days")
    pieces = rows.join(dealt, day).repartition("user_id", "piece")
    pieces.write.mode("overwrite").partitionBy("piece").parquet(f"{path}/pieces")
    spark, last = lines.sparkSession, dealt.agg(F.max("piece")).first()[0]
    state = spark.createDataFrame([], "user_id long, state binary")
    for n in range(-1 if last is None else last + 1):
        held = state.select("user_id", F.lit(-1).alias("part"), F.lit("").alias("category"), F.lit(0).cast("long").alias("newest"), F.lit(0).cast("long").alias("memory_id"), F.lit(None).cast("string").alias("value"), "state")
        own = spark.read.schema(pieces.drop("piece").schema).parquet(f"{path}/pieces/piece={n}").select("user_id", *PLACE, "value", F.lit(None).cast("binary").alias("state"))
        state = written(held.unionByName(own).repartition("user_id").sortWithinPartitions("user_id", *PLACE).mapInArrow(digested, "user_id long, state binary"), f"{path}/state={n}")
    return state.select("user_id", F.udf(digest.closed, "string")(F.col("state")).alias("digest"))


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user_id, state) of rows that are sorted by user: a state to go on from, if there is one, then lines."""
    user, state = None, digest.START
    one = lambda: pa.RecordBatch.from_pydict({"user_id": pa.array([user], pa.int64()), "state": pa.array([state], pa.binary())})
    for batch in batches:
        ids = batch.column("user_id").to_numpy()
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for a, b in zip(edges, edges[1:], strict=False):
            if ids[a] != user:
                if user is not None:
                    yield one()
                user, state = int(ids[a]), batch.column("state")[a].as_py() or digest.START
            text = "".join(f"{x}\n" for x in batch.column("value").slice(a, b - a).to_pylist() if x is not None)
            state = digest.more(state, text.encode())
    if user is not None:
        yield one()


def json_listed(lines: DataFrame) -> DataFrame:
    """(user_id, n, first) from the lines of JSON exports: how many memories each user's list has, and the id of its first; no document is put together."""
    own = F.col("part") == 1
    found = F.get_json_object(F.ltrim("value", F.lit(",")), "$.id")
    return lines.groupBy("user_id").agg(F.count(F.when(own & found.isNotNull(), 1)).alias("n"), F.min_by(found, F.when(own, F.struct("newest", "memory_id"))).alias("first"))


def responses(memories: DataFrame) -> DataFrame:
    """(user_id, memory_id, json): what a caller is shown of a memory. Entities, client, importance and accesses stay inside; empty optional fields are left out."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    body = F.struct(F.col("memory_id").cast("string").alias("id"), "content", "category", "subcategory", "tags", "confidence", stamp("created_at"), stamp("updated_at"), stamp("expires_at"), F.col("superseded_by").cast("string").alias("superseded_by"))
    return memories.select("user_id", "memory_id", F.to_json(body).alias("json"))


def digest_plan(memories: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(user_id, domain, fingerprint, cached, fresh): the digests that a profile needs, with what the cache (user_id, domain, content, fingerprint) holds.

    ``fresh`` digests are used as they are; the others are to be written from ``digest_rows``.
    """
    held = cache.select("user_id", "domain", F.col("content").alias("cached"), F.col("fingerprint").alias("_old"))
    rows = fingerprints(memories, now).join(held, ["user_id", "domain"], "left")
    return rows.withColumn("fresh", F.coalesce(F.col("_old") == F.col("fingerprint"), F.lit(False))).drop("_old")


def digests(plan: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections: user_id, domain, content; new cache rows) from a plan and the model's answers (user_id, domain, answer).

    A fresh digest is kept. An answer without text is a result too, cached and shown as no section. Where the model failed
    (no row, or a null answer) a stale digest serves, if there is one.
    """
    rows = plan.join(answers.select("user_id", "domain", "answer"), ["user_id", "domain"], "left")
    said = F.trim(F.coalesce(F.get_json_object("answer", "$.digest"), F.lit("")))
    answered = F.col("answer").isNotNull() & ~F.col("fresh")
    content = F.when(answered, said).otherwise(F.coalesce("cached", F.lit("")))
    made = rows.withColumns({"content": content, "_new": answered})
    return made.filter("content <> ''").select("user_id", "domain", "content"), made.filter("_new").select("user_id", "domain", "content", "fingerprint")


def digest_profile(sections: DataFrame, users: DataFrame, assembled: DataFrame, now: Column, budget: int = S.PROFILE_BYTES) -> DataFrame:
    """(user_id, text): coding before personal; a section that would exceed the budget in bytes is left out whole. Users without any section get ``assembled``."""
    heading = F.when(F.col("domain") == "coding", "How they work").otherwise("Who they are")
    body = F.concat(F.lit("\n## "), heading, F.lit("\n\n"), F.trim("content"), F.lit("\n"))
    parts = sections.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("domain", body.alias("body")))).alias("parts"))
    head = F.concat(F.lit("# Memory profile: "), F.col("handle"), F.lit(" (updated "), F.date_format(now, "yyyy-MM-dd"), F.lit(")\n"))
    fold = F.aggregate("parts", head, lambda t, p: F.when(F.octet_length(t) + F.octet_length(p["body"]) <= budget, F.concat(t, p["body"])).otherwise(t))
    made = users.select("user_id", "handle").join(parts, "user_id", "left").join(assembled.select("user_id", F.col("text").alias("_plain")), "user_id", "left")
    return made.select("user_id", F.when(F.col("parts").isNull(), F.col("_plain")).otherwise(fold).alias("text"))
