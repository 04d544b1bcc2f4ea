"""Hybrid recall for batches of queries: exact vector top-k and BM25 top-k, fused, weighted, filtered, limited.

Queries are (query_id, user_id, text, k); memories never meet queries of another user.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scores
from ..functions.text import normalise_tags, tokens

#: A stated query batch up to this many bytes is broadcast; a larger one is shuffled by user.
BROADCAST_BYTES = 32 << 20
#: Users of a batch up to this many are broadcast with their tiles.
BROADCAST_ROWS = 200_000
#: Memories and queries of a tile, unless one row in PARTS is more; so few users have more than one tile.
TILE_ROWS, TILE_QUERIES, PARTS = 16_384, 1024, 1000
FIELDS = ("content", "tags", "category")


@dataclass(frozen=True)
class Filters:
    """Post-filters of recall; empty means no filter."""

    categories: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    since: str | None = None
    include_superseded: bool = False
    extra: tuple[Column, ...] = field(default=())


def active(now: Column) -> Column:
    return F.col("superseded_by").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def matches(f: Filters, now: Column) -> Column:
    """P1 to P5 as one predicate. ``include_superseded`` re-admits expired rows too."""
    out = F.lit(True) if f.include_superseded else active(now)
    if f.categories:
        out &= F.col("category").isin(*f.categories)
    if f.subcategories:
        out &= F.coalesce(F.col("subcategory").isin(*(s.strip().lower() for s in f.subcategories)), F.lit(False))
    if f.tags:
        wanted = normalise_tags(F.array(*map(F.lit, f.tags)))
        out &= F.size(F.array_except(wanted, F.col("tags"))) == 0
    if f.since:
        out &= F.col("created_at") >= F.lit(f.since).cast("timestamp_ntz")
    for c in f.extra:
        out &= c
    return out


def small(queries: DataFrame, text_bytes: int) -> DataFrame:
    """The batch with a broadcast hint, if its measured size allows; else its joins are shuffled, whatever Spark takes its size to be."""
    return F.broadcast(queries) if text_bytes <= BROADCAST_BYTES else apart(queries)


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that is shuffled, whatever their size: Spark goes by the size of files, and rows that are alike take many times as much on the driver."""
    return rows.hint("merge")


def measure(queries: DataFrame) -> int:
    """Bytes of a query batch's texts, with an allowance for the other columns."""
    row = queries.agg(F.sum(F.octet_length("text") + 1024)).first()
    return int(row[0] or 0)


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Each query's best ``depth`` rows, numbered; partial top-k runs before the shuffle."""
    window = Window.partitionBy("query_id", "user_id").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).filter(F.col(rank) <= F.col("depth")).filter(F.col(rank) <= S.MAX_DEPTH)


def tiles(asked: DataFrame, owners: DataFrame) -> tuple[DataFrame, int]:
    """(user_id, memory_parts, query_parts) of the users who ask and have memories, and how many users those are.

    Both sides are counted by user; a side with more than its share (TILE_ROWS or TILE_QUERIES, or one row in PARTS) is
    dealt into as many parts as keep within it.
    """
    asks = asked.groupBy("user_id").agg(F.count("*").alias("q"))
    has = owners.groupBy("user_id").agg(F.count("*").alias("m"))
    sizes = asks.join(apart(has), "user_id")
    n, q, m = sizes.agg(F.count("*"), F.sum("q"), F.sum("m")).first()
    parts = lambda c, whole, least: F.ceil(F.col(c) / max(least, (whole or 0) // PARTS)).cast("int")
    return sizes.select("user_id", parts("m", m, TILE_ROWS).alias("memory_parts"), parts("q", q, TILE_QUERIES).alias("query_parts")), n


def vector_leg(queries: DataFrame, vectors: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(query_id, user_id, memory_id, vector_rank): the ``nearest`` of each query."""
    return nearest(queries, vectors, owners).select("query_id", "user_id", "memory_id", "vector_rank")


def nearest(queries: DataFrame, vectors: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(query_id, user_id, memory_id, distance, vector_rank): exact nearest by L2 among the user's memories, ties to the smaller id.

    ``queries`` has (query_id, user_id, depth, embedding); ``vectors`` (user_id, memory_id, embedding); ``owners`` rows whose
    ``user_id`` stand for those of ``vectors`` when a user's memories are counted, where vectors are dear to make. An
    embedding that is null or empty, or holds a null or non-finite component, takes no part, and vectors meet only those
    with as many dimensions.

    Queries and memories are dealt by their counts into tiles of a user, and a tile passes on each query's nearest of
    every batch of its memories, from one product; so a user with most of the memories fills many tiles, and a task holds
    TILE_QUERIES queries and one batch at a time, whatever the size of either side.
    """
    asked = queries.filter(usable(F.col("embedding"))).select("query_id", "user_id", "depth", "embedding")
    deal, n = tiles(asked, owners if owners is not None else vectors)
    deal = F.broadcast(deal) if n <= BROADCAST_ROWS else apart(deal)
    side = lambda which, own, other, key: [F.lit(which).alias("side"), F.size("embedding").alias("d"), own, other, key]
    spread = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    asking = asked.join(deal, "user_id").select("user_id", *side(0, every("memory_parts").alias("i"), spread("query_id", "query_parts").alias("j"), F.col("query_id").alias("id")), "depth", "embedding")
    stored = vectors.filter(usable(F.col("embedding"))).join(deal, "user_id").select("user_id", *side(1, spread("memory_id", "memory_parts").alias("i"), every("query_parts").alias("j"), F.col("memory_id").alias("id")), F.lit(0).cast("long").alias("depth"), "embedding")
    tile = ["user_id", "d", "i", "j"]
    dealt = asking.withColumn("depth", F.col("depth").cast("long")).unionByName(stored).select(*tile, "side", "id", "depth", "embedding")
    near = dealt.repartition(*tile).sortWithinPartitions(*tile, "side").mapInArrow(nearest_of_tiles, "query_id long, user_id long, memory_id long, depth long, distance double, exact double")
    return ranked(near, [F.col("distance"), F.col("memory_id")], "vector_rank").select("query_id", "user_id", "memory_id", F.col("exact").alias("distance"), "vector_rank")


def usable(vector: Column) -> Column:
    """Whether an embedding has components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def nearest_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's nearest of every batch of its tile's memories. Rows are sorted by tile, queries first."""
    tile, parts = None, []
    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)], 1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip(edges, edges[1:], strict=False):
            mark, rows = tuple(marks[a].tolist()), batch.slice(a, b - a)
            if mark[:4] != tile:
                tile, parts = mark[:4], []
            if mark[4] == 0:
                parts.append((rows.column("id").to_numpy(), rows.column("depth").to_numpy(), matrix(rows.column("embedding"))))
            elif parts:
                queries, depth, y = (np.concatenate(c) for c in zip(*parts, strict=True))
                parts = [(queries, depth, y)]
                query, memory, deep, distance, exact = nearest_of(queries, depth, y, rows.column("id").to_numpy(), matrix(rows.column("embedding")))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.full(len(query), tile[0])), pa.array(memory), pa.array(deep), pa.array(distance), pa.array(exact)], ["query_id", "user_id", "memory_id", "depth", "distance", "exact"])


def matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long lists as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest_of(queries: np.ndarray, depth: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, memory, depth, distance, exact) of each query's ``depth`` nearest rows of ``x``: a product narrows them, exact distances, rounded to twelve digits, decide."""
    square, out = (x**2).sum(1), []
    for q in range(0, len(y), 256):
        part = y[q : q + 256]
        rough = square[None, :] - 2 * part @ x.T + (part**2).sum(1)[:, None]
        for i, d in enumerate(depth[q : q + 256].tolist()):
            near = np.arange(len(x))
            if len(x) > d:
                edge = np.partition(rough[i], d - 1)[d - 1]
                near = np.flatnonzero(rough[i] <= edge + 1e-9 * (1 + abs(edge)))
            exact = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
            distance = np.round(exact, 12)
            best = np.lexsort((ids[near], distance))[:d]
            out.append((np.full(len(best), queries[q + i]), ids[near[best]], np.full(len(best), d), distance[best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def worded(memories: DataFrame) -> DataFrame:
    """(user_id, memory_id, field, words) of the content, tags and category of every memory."""
    texts = {"content": F.col("content"), "tags": F.array_join("tags", " "), "category": F.col("category")}
    fields = F.array(*(F.struct(F.lit(n).alias("field"), tokens(F.coalesce(t, F.lit(""))).alias("words")) for n, t in texts.items()))
    return memories.select("user_id", "memory_id", F.explode(fields).alias("f")).select("user_id", "memory_id", "f.field", "f.words")


def tallied(words: Column) -> Column:
    """The (term, tf) of a list of words, within its row: sorted, equal words stand together."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return F.transform(F.array(first), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]


def postings(memories: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(user_id, memory_id, field, term, tf, dl) of the content, tags and category of every memory; only ``terms``, if given.

    Lengths are taken before the terms are filtered, so statistics cover all text. A memory is one row, so its words are
    counted within it: nothing is gathered or shuffled.
    """
    rows = worded(memories).withColumn("dl", F.size("words").cast("long"))
    words = rows.select("user_id", "memory_id", "field", "dl", F.explode(tallied(F.col("words"))).alias("t")).select("user_id", "memory_id", "field", "t.term", "dl", "t.tf")
    return words if terms is None else words.join(terms, ["user_id", "term"], "left_semi").select(*words.columns)


def field_lengths(memories: DataFrame) -> DataFrame:
    """(user_id, memory_id, field, dl) of every memory."""
    return worded(memories).select("user_id", "memory_id", "field", F.size("words").cast("long").alias("dl"))


def field_stats(memories: DataFrame) -> DataFrame:
    """(user_id, field, n, avgdl): how many memories a user has, and the mean length of each field."""
    texts = {"content": F.col("content"), "tags": F.array_join("tags", " "), "category": F.col("category")}
    sizes = [F.avg(F.size(tokens(F.coalesce(t, F.lit("")))).cast("long")).alias(n) for n, t in texts.items()]
    wide = memories.groupBy("user_id").agg(F.count("*").alias("n"), *sizes)
    return wide.select("user_id", "n", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("avgdl")) for n in texts))).alias("s")).select("user_id", "n", "s.field", "s.avgdl")


def bm25(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (S.BM25_K1 + 1) / (tf + S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * dl / avgdl))


def term_weights(memories: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(user_id, memory_id, term, weight): what each term of a memory adds to a BM25 score, summed over its fields; only ``terms``, if given."""
    return weigh(postings(memories, terms), field_stats(memories))


def weigh(found: DataFrame, stats: DataFrame) -> DataFrame:
    """``term_weights`` from postings, all of their terms, and the statistics of their users' fields."""
    return field_weights(found, found.groupBy("user_id", "field", "term").agg(F.count("*").alias("df")), stats).groupBy("user_id", "memory_id", "term").agg(F.sum("weight").alias("weight"))


def field_weights(found: DataFrame, seen: DataFrame, stats: DataFrame) -> DataFrame:
    """(user_id, memory_id, term, weight), a row a field, from postings, their terms' document frequencies and the statistics of fields."""
    scored = found.join(seen, ["user_id", "field", "term"]).join(stats, ["user_id", "field"])
    weight = bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n"), F.col("df"))
    return scored.select("user_id", "memory_id", "term", F.round(weight, 9).alias("weight"))


def weights_for(asked: DataFrame, memories: DataFrame, size: int) -> DataFrame:
    """``field_weights`` of the terms that are asked for. Terms, their frequencies and the askers' statistics are broadcast if the
    batch is small, so postings stay where their memories are read; frequencies have up to a row a field and term, hence the factor.
    """
    found = postings(memories, small(asked.select("user_id", "term").distinct(), size))
    seen = found.groupBy("user_id", "field", "term").agg(F.count("*").alias("df"))
    stats = field_stats(memories).join(small(asked.select("user_id").distinct(), size), "user_id", "left_semi")
    return field_weights(found, small(seen, 8 * size), small(stats, 8 * size))


def keyword_leg(queries: DataFrame, memories: DataFrame, size: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, user_id, memory_id, keyword_rank): best BM25 over content, tags and category, ties to the smaller id.

    All text of a query is plain terms. Weights come from an index, or are made here for those terms that some query asks for.
    They have nine digits and are added as whole numbers of 1e-9, so no order of rows moves a score over a rounding edge.
    """
    asked = queries.select("query_id", "user_id", "depth", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    pairs = (weights_for(asked, memories, size) if weights is None else weights).join(small(asked, size), ["user_id", "term"])
    hits = pairs.groupBy("query_id", "user_id", "memory_id", "depth").agg(F.round(F.sum(F.round(F.col("weight") * 1e9).cast("long")) / 1e9, 6).alias("bm25"))
    return ranked(hits.filter("bm25 > 0"), [F.col("bm25").desc(), F.col("memory_id")], "keyword_rank").select("query_id", "user_id", "memory_id", "keyword_rank", "bm25")


def fuse(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """All candidates of either leg with their ranks in each and the fused score."""
    both = vector.join(keyword.drop("bm25"), ["query_id", "user_id", "memory_id"], "full_outer")
    return both.withColumn("rrf", scores.fused(F.col("vector_rank"), F.col("keyword_rank")))


def score(candidates: DataFrame, memories: DataFrame, now: Column, half_life: float = S.HALF_LIFE_DAYS) -> DataFrame:
    """Candidates with their memories' columns and final score; hits without a memory are dropped."""
    joined = memories.join(candidates, ["user_id", "memory_id"])
    value = F.col("rrf") * scores.recency(F.col("created_at"), now, half_life) * scores.quality(F.col("confidence"), F.col("importance"))
    return joined.withColumn("score", F.round(value, 12))


def top(df: DataFrame) -> DataFrame:
    """Each query's first ``k`` by score, newest first, then smaller id; k is at most 50."""
    window = Window.partitionBy("query_id", "user_id").orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("memory_id"))
    return df.withColumn("position", F.row_number().over(window).cast("long")).filter(F.col("position") <= S.MAX_LIMIT).filter("position <= k")


def recall(queries: DataFrame, memories: DataFrame, vectors: DataFrame, now: Column, filters: Filters | None = None, half_life: float = S.HALF_LIFE_DAYS, hybrid: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """The ranked answer to every query, with memory columns, score and the rank in each leg.

    ``queries``: (query_id, user_id, text, k, embedding). Superseded and expired memories take part in
    both legs and are filtered afterwards without renumbering, so a selective filter can return fewer
    than k; ``recall_filtered_first`` filters before ranking instead. Without ``hybrid`` only vectors count.
    ``weights`` are an index's term weights; without them they are made from the memories.
    """
    size = measure(queries)
    wide = apart if size > BROADCAST_BYTES else (lambda rows: rows)
    asked = queries.withColumn("depth", scores.candidate_depth(F.col("k")))
    stored = memories.filter("deleted_at IS NULL")
    near = vector_leg(asked, vectors.join(wide(stored.select("user_id", "memory_id")), ["user_id", "memory_id"], "left_semi"), stored)
    words = keyword_leg(asked, stored, size, weights)
    candidates = wide(fuse(near, words if hybrid else words.limit(0)))
    kept = score(candidates, stored.filter(matches(filters or Filters(), now)), now, half_life)
    return top(kept.join(small(queries.select("query_id", "user_id", "k"), size), ["query_id", "user_id"]))


def recall_filtered_first(queries: DataFrame, memories: DataFrame, vectors: DataFrame, now: Column, filters: Filters, half_life: float = S.HALF_LIFE_DAYS) -> DataFrame:
    """``recall`` over only those memories that pass the filters: they reach the scan, and ranks are among the filtered."""
    return recall(queries, memories.filter(matches(filters, now)), vectors, now, filters, half_life)


def access_log(results: DataFrame, now: Column) -> DataFrame:
    """The access events that an answer causes; appended separately, never part of the same answer."""
    return results.select("user_id", "memory_id", now.alias("at"))


def access_rollup(log: DataFrame) -> DataFrame:
    """(memory_id, access_count, last_accessed_at)."""
    return log.groupBy("memory_id").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed_at"))
