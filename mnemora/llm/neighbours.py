"""Operator 2: approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and grow with the table: below a sampled leaf, vectors part further
along random directions through the leaf's centre, until a leaf holds some hundred rows of the table, however
many there are. Every vector is indexed in one leaf of each tree. A query walks all trees through one shared
priority queue, nearest margins first, until its share of leaves is reached; that share is calibrated on the
sample to a target recall. Candidates meet the queries by leaf and are ranked there by their exact distance,
each in the first tree only in which a query meets it.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, list_array, materialise, matrix
from .vectors import SAMPLE_ROWS, bounded_sample, checked, fingerprint, usable

TREES = 3
#: Rows of the table in a leaf, about; sampled vectors in a sampled leaf at least.
LEAF, LEAST = 64, 16
#: Recall that the calibration aims at, over the sample.
TARGET = 0.965
#: Where more than one leaf in so many is visited, their bounds are made together instead of one by one.
BULK = 16
#: Rows of either side of a bundle of leaves that one task takes at a time.
CHUNK = 16_384


@dataclass(frozen=True)
class Forest:
    """Split planes of all sampled trees (children >= 0 are nodes, others leaves -1-n), their roots, the tree of each leaf;
    ``directions`` and the leaves' ``centres`` on them, which split every leaf further; the leaves a query visits.
    """

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    tree: np.ndarray
    directions: np.ndarray
    centres: np.ndarray
    visits: int

    @property
    def bits(self) -> int:
        return len(self.directions)

    def sampled(self, x: np.ndarray) -> np.ndarray:
        """The sampled leaf of every vector in every tree; margins are made for some hundred vectors at a time."""
        if len(x) > 512:
            return np.concatenate([self.sampled(x[i : i + 512]) for i in range(0, len(x), 512)])
        at = np.repeat(self.roots[None, :], len(x), 0)
        if not len(self.normals):
            return -1 - at
        side = (x @ self.normals.T >= self.offsets).astype(np.int64)
        rows = np.arange(len(x))[:, None]
        while (inner := at >= 0).any():
            node = np.maximum(at, 0)
            at = np.where(inner, self.children[node, side[rows, node]], at)
        return -1 - at

    def index(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree, as sampled leaf << bits | sides of the further splits."""
        leaf = self.sampled(x)
        out, along = leaf << self.bits, x @ self.directions.T
        for j in range(self.bits):
            out |= (along[:, j, None] >= self.centres[leaf, j]).astype(np.int64) << (self.bits - 1 - j)
        return out

    @functools.cached_property
    def levels(self) -> list[np.ndarray]:
        """The nodes of all trees by depth."""
        out, at = [], self.roots[self.roots >= 0]
        while len(at):
            out.append(at)
            at = self.children[at].ravel()
            at = at[at >= 0]
        return out

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The bound with which one query's queue would hold each leaf: the largest margin on its path by which the query lies on the other side."""
        node, leaf = np.zeros(len(self.normals)), np.zeros(len(self.tree))
        margins = self.normals @ x - self.offsets if len(self.normals) else np.zeros(0)
        for at in self.levels:
            near = self.children[at, (margins[at] >= 0).astype(np.int64)]
            far = self.children[at, (margins[at] < 0).astype(np.int64)]
            for child, bound in ((near, node[at]), (far, np.maximum(node[at], np.abs(margins[at])))):
                node[child[child >= 0]] = bound[child >= 0]
                leaf[-1 - child[child < 0]] = bound[child < 0]
        gaps = self.directions @ x - self.centres
        for j in range(self.bits):
            gap = np.repeat(gaps[:, j], 1 << j)
            other = np.maximum(leaf, np.abs(gap))
            leaf = np.stack([np.where(gap >= 0, other, leaf), np.where(gap >= 0, leaf, other)], 1).ravel()
        return leaf

    def search(self, x: np.ndarray, visits: int | None = None) -> list[list[int]]:
        """The leaves that each query visits, in order, over all trees together; of the first ones that a full queue would give, where a good part is visited."""
        visits = visits or self.visits
        if visits * BULK > len(self.tree) << self.bits:
            return [np.argsort(self.bounds(q), kind="stable")[:visits].tolist() for q in x]
        margins = x @ self.normals.T - self.offsets if len(self.normals) else np.zeros((len(x), 0))
        further = (x @ self.directions.T).tolist()
        children, bits, centres = self.children.tolist(), self.bits, self.centres.tolist()
        push, pop = heapq.heappush, heapq.heappop
        out = []
        for m, along in zip(margins.tolist(), further, strict=True):
            # an entry is (margin, node, depth below the sampled leaf); a leaf's further splits number its children in binary
            heap: list[tuple[float, int, int]] = [(0.0, int(r), 0) for r in self.roots]
            heapq.heapify(heap)
            found: list[int] = []
            while heap and len(found) < visits:
                bound, at, depth = pop(heap)
                if not depth:
                    while at >= 0:
                        low, high = children[at]
                        near, far = (high, low) if m[at] >= 0 else (low, high)
                        push(heap, (max(bound, abs(m[at])), far, 0))
                        at = near
                    at = -1 - at
                for j in range(depth, bits):
                    gap = along[j] - centres[at >> j][j]
                    near = at << 1 | (gap >= 0)
                    push(heap, (max(bound, abs(gap)), near ^ 1, j + 1))
                    at = near
                found.append(at)
            out.append(found)
        return out


def grow(sample: np.ndarray, trees: int, leaf: int, bits: int, seed: int) -> Forest:
    """Split at the median along the direction between two random sampled vectors; equal projections stay together."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, tree, members = [], [], [], [], []

    def build(rows: np.ndarray, t: int) -> int:
        for _ in range(4 * (len(rows) > leaf)):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            if (size := np.linalg.norm(a - b)) > 0:
                along = sample[rows] @ ((a - b) / size)
                middle = float(np.median(along))
                low, high = rows[along < middle], rows[along >= middle]
                if len(low) and len(high):
                    at = len(normals)
                    normals.append((a - b) / size)
                    offsets.append(middle)
                    children.append((0, 0))
                    children[at] = (build(low, t), build(high, t))
                    return at
        tree.append(t)
        members.append(rows)
        return -len(tree)

    roots = [build(np.arange(len(sample)), t) for t in range(trees)]
    directions = rng.normal(size=(bits, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    centres = np.array([(sample[rows] @ directions.T).mean(0) for rows in members]).reshape(len(tree), bits)
    return Forest(np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(roots, np.int64), np.array(tree, np.int64), directions, centres, 0)


def fit(sample: np.ndarray, n: int, k: int, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, seed: int = 7) -> Forest:
    """A forest for ``n`` vectors, and the fewest visits with which sampled queries find ``target`` of their k nearest sampled vectors.

    A sample of one vector in s has a k-th part in s of the k nearest, and at least one of those that are looked for.
    """
    share = n / max(1, len(sample))
    size = max(LEAST, int(leaf / share))
    forest = grow(sample, trees, size, max(0, math.ceil(math.log2(max(1.0, size * share / leaf / 1.5)))), seed)
    asked = sample[:: max(1, len(sample) // 384)][:384]
    where = forest.index(sample)
    square = (sample**2).sum(1)
    near = square[None, :] - 2 * asked @ sample.T
    own = np.argsort(near, 1, kind="stable")[:, 1 : max(1, round(k / max(1.0, share))) + 1]
    total = len(forest.tree) << forest.bits
    if not own.size:
        return replace(forest, visits=total)
    rank = np.empty(own.shape, np.int64)
    for q, x in enumerate(asked):
        bounds = forest.bounds(x)
        # a vector is found once the first of its leaves is visited: after all leaves with a smaller bound
        rank[q] = np.searchsorted(np.sort(bounds), bounds[where[own[q]]].min(1), "right") - 1
    visits = int(np.quantile(rank, target, method="higher")) + 1
    return replace(forest, visits=min(total, max(visits, 2 * trees)))


def ranked(forest_trees: int, cells: np.ndarray, names: np.ndarray, x: np.ndarray, visited: list[np.ndarray], y: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) rows of a bundle: the ``keep`` nearest candidates of each query, ties to the smaller name.

    ``cells`` holds each candidate's leaves in the trees up to the bundle's own, which is the last; ``visited`` the leaves
    of those trees that each query visits. A candidate that the query meets in an earlier tree is left to that tree.
    """
    order = np.argsort(cells[:, -1], kind="stable")
    cells, names, x = cells[order], names[order], x[order]
    square = (x**2).sum(1)
    columns = [np.unique(cells[:, t], return_inverse=True) for t in range(forest_trees)]
    edges = np.searchsorted(cells[:, -1], np.append(columns[-1][0], np.iinfo(np.int64).max))
    out = ([], [], [])
    for at in range(0, len(y), 256):
        part, own = y[at : at + 256], visited[at : at + 256]
        flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(v) for v in own])
        seen = []
        for values, _ in columns:
            place = np.minimum(np.searchsorted(values, flat), len(values) - 1)
            hit = values[place] == flat
            met = np.zeros((len(own), len(values)), bool)
            met[owner[hit], place[hit]] = True
            seen.append(met)
        own_square, bound = (part**2).sum(1), np.full(len(part), np.inf)
        rows, found = [], []
        for u in np.flatnonzero(seen[-1].any(0)):
            low, high = edges[u], edges[u + 1]
            asking = np.flatnonzero(seen[-1][:, u])
            near = square[None, low:high] - 2 * part[asking] @ x[low:high].T + own_square[asking, None]
            for t in range(forest_trees - 1):
                near[seen[t][np.ix_(asking, columns[t][1][low:high])]] = np.inf
            if high - low > keep:
                bound[asking] = np.minimum(bound[asking], np.partition(near, keep - 1, axis=1)[:, keep - 1])
            edge = bound[asking]
            row, column = np.nonzero((near <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None]) & np.isfinite(near))
            rows.append(asking[row])
            found.append(low + column)
        row, column = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, found))
        exact = np.concatenate([np.sqrt(((part[row[i : i + 65536]] - x[column[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(row), 65536)] or [np.zeros(0)])
        best = np.lexsort((names[column], exact, row))
        row, column, exact = row[best], column[best], exact[best]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < keep
        out[0].append(at + row[kept])
        out[1].append(order[column[kept]])
        out[2].append(exact[kept])
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True))


def scatter(cells: np.ndarray, bundles: int) -> np.ndarray:
    """The bundle of its tree that each leaf belongs to."""
    mixed = cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(bundles)).astype(np.int64)


def nearest(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, sample_rows: int = SAMPLE_ROWS, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other ids found, by Euclidean distance, ties to the smaller id.

    Rows whose id or vector is null, zero, or holds a null or non-finite component take no part;
    vectors meet only those with as many dimensions; rows with the query's own id are no candidates.
    Equal vectors are one class, known by a 128-bit fingerprint, so a vector that fills a third of the
    table is indexed once, and only the k + 1 smallest ids of a class can matter. An id that repeats with
    unequal vectors asks once a vector and counts at its nearest. Every vector is sent once a tree, to
    the bundle that its leaf is hashed to, and a query once to each bundle that it visits; bundles
    that turn out full are dealt in chunks by their counts, so no task holds more than 2 x CHUNK vectors.
    """
    first, second = fingerprint(F.col("v"))
    rows = df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.withColumns({"h1": first, "h2": second})
    keys = materialise(rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("q").alias("asks"), F.count("*").alias("w")), "keys")
    twins = keys.filter("w > 1")
    n_twins = twins.count()
    classes = rows.join(checked(twins.select("h1", "h2", "rep", "asks"), n_twins), ["h1", "h2"], "left").filter("rep IS NULL OR id = rep")
    classes = classes.select("h1", "h2", F.col("id").alias("rep"), "v", F.size("v").alias("d"), F.coalesce("asks", "q").alias("q"))
    sizes = {r[0]: r[1] for r in classes.groupBy("d").count().collect()}
    forests = {d: (fit(x, sizes[d], k, target=target), max(1, -(-sizes[d] // CHUNK))) for d, x in bounded_sample(classes, "rep", "v", sample_rows).items()}
    shared = df.sparkSession.sparkContext.broadcast(forests)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int, np.ndarray, pa.ListArray]]:
        """(rows, side, which row, d, bundle, cells) of every batch and number of dimensions: where candidates and queries go."""
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for d in np.unique(dims).tolist():
                own, (forest, bundles) = batch.filter(pa.array(dims == d)), shared.value[d]
                for at in range(0, len(own), 1024):
                    part = own.slice(at, 1024)
                    x = matrix(part.column(3))
                    cells = forest.index(x)
                    spread = scatter(cells, bundles)
                    for t in range(cells.shape[1]):
                        yield part, 0, np.arange(len(part)), d, t * bundles + spread[:, t], list_array(list(cells[:, : t + 1]), pa.int64())
                    asking = np.flatnonzero(part.column(5).to_numpy(zero_copy_only=False))
                    if not len(asking):
                        continue
                    which, to, lists = [], [], []
                    for i, found in zip(asking.tolist(), forest.search(x[asking]), strict=True):
                        found = np.array(found, np.int64)
                        tree = forest.tree[found >> forest.bits]
                        found = found[np.argsort(tree, kind="stable")]
                        tree = np.sort(tree)
                        bundle = tree * bundles + scatter(found, bundles)
                        for b in np.unique(bundle).tolist():
                            which.append(i)
                            to.append(b)
                            lists.append(found[(tree < b // bundles) | (bundle == b)])
                    yield part, 1, np.array(which), d, np.array(to), list_array(lists, pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, _, d, bundle, _ in places(batches):
            value, n = np.unique(bundle, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), d, np.int32)), pa.array(value), pa.array(n if side == 0 else n * 0), pa.array(n if side else n * 0)], ["d", "bundle", "n0", "n1"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, side, which, d, bundle, cells in places(batches):
            own = part.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), own.column(3), pa.array(np.full(len(own), d, np.int32)), pa.array(bundle), pa.array(np.full(len(own), side, np.int32)), cells], ["h1", "h2", "rep", "v", "d", "bundle", "side", "cells"])

    kind = classes.schema["v"].dataType.simpleString()
    counts = classes.mapInArrow(count, "d int, bundle long, n0 long, n1 long").groupBy("d", "bundle").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 > 0 and n1 > 0")
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    deal = materialise(counts.select("d", "bundle", chunks("n0").alias("c0"), chunks("n1").alias("c1")), "deal")
    sent = classes.mapInArrow(send, f"h1 long, h2 long, rep long, v {kind}, d int, bundle long, side int, cells array<bigint>")
    sent = sent.join(checked(deal, deal.count()), ["d", "bundle"])
    own = F.pmod("h1", F.when(F.col("side") == 0, F.col("c0")).otherwise(F.col("c1"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("c1")).otherwise(F.col("c0")) - 1))
    dealt = sent.withColumn("own", own).withColumn("other", across)
    dealt = dealt.select("d", "bundle", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"), "side", "h1", "h2", "rep", "v", "cells")
    dealt = dealt.repartition("d", "bundle", "i", "j").sortWithinPartitions("d", "bundle", "i", "j")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 4):
            side = group.column("side").to_numpy()
            kept, asking = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
            if not len(kept) or not len(asking):
                continue
            cells = kept.column("cells").combine_chunks()
            cells = cells.flatten().to_numpy().reshape(len(kept), -1)
            lists = asking.column("cells").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum()
            q, c, score = ranked(cells.shape[1], cells, kept.column("rep").to_numpy(), matrix(kept.column("v")), np.split(flat, ends[:-1]), matrix(asking.column("v")), k + 1)
            q, c = pa.array(q), pa.array(c)
            names = [asking.column(n).combine_chunks().take(q) for n in ("h1", "h2")] + [kept.column(n).combine_chunks().take(c) for n in ("h1", "h2", "rep")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(score)], ["q1", "q2", "h1", "h2", "rep", "score"])

    found = dealt.mapInArrow(rerank, "q1 long, q2 long, h1 long, h2 long, rep long, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "rep", "h1", "h2"))).filter(F.col("n") <= k + 1)
    copies = rows.select("id", "h1", "h2").join(checked(twins.select("h1", "h2"), n_twins), ["h1", "h2"]).distinct()
    copies = copies.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("n") <= k + 1).groupBy("h1", "h2").agg(F.collect_list("id").alias("ids"))
    members = best.join(checked(copies, n_twins), ["h1", "h2"], "left").select("q1", "q2", "score", F.explode(F.coalesce("ids", F.array("rep"))).alias("vec_id"))
    members = members.groupBy("q1", "q2", "vec_id").agg(F.min("score").alias("score"))
    lists = members.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    asking = rows.filter("q").select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asking.join(lists, ["q1", "q2"]).select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
