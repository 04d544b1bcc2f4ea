"""Operator 4: near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine at least c lie within squared distance 2 - 2c. Rotated onto principal axes
and split into blocks, such a pair must lie within its proportional share of that budget in at least
one block. Each block is range-joined under its share: a k-d partition puts every vector in its cell
and in the cells within reach, cells meet in bounded tiles, and the union of candidates is verified
exactly. A pair counts in the first block that admits it, and each vector counts at its own cell, so
nothing is counted twice and no pairs leave a task.

Blocks hold equal shares of the variance, so they are low-dimensional where it is concentrated. How many
there are is chosen by what the sample's cells would cost. Where no block can be separated, because its
reach is wider than its spread, the cheapest join is that of a single block: one blocked product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, matrix, meet
from .components import connected_components, merge_labels
from .vectors import bounded_sample, checked, fingerprint, usable

#: Rows of either side of a tile; a fuller cell is dealt over several tiles.
TILE = 32_768
#: A cell is split only where at most this share of it lies within reach of both halves.
OVERLAP = 0.5
#: What a pair costs besides a multiplication a dimension, and what a copy of a vector costs, in multiplications.
PAIR_COST, COPY_COST = 24, 20_000


@dataclass(frozen=True)
class Blocks:
    """Rotation, columns and squared-distance budget of each block, and its k-d splits (axis, value, low, high)."""

    rotation: np.ndarray
    columns: list[np.ndarray]
    budgets: list[float]
    splits: list[list[tuple[int, float, int, int]]]


def split_block(part: np.ndarray, reach: float, n: int) -> tuple[list[tuple[int, float, int, int]], float]:
    """K-d splits by medians while splitting pays, and what the cells cost for ``n`` vectors."""
    nodes: list[tuple[int, float, int, int]] = []
    cost, share = 0.0, n / max(1, len(part))

    def build(rows: np.ndarray) -> int:
        nonlocal cost
        if len(rows) * share > TILE and len(rows) > 64:
            axis = int(part[rows].var(0).argmax())
            value = float(np.median(part[rows, axis]))
            if (np.abs(part[rows, axis] - value) <= reach).mean() <= OVERLAP:
                at = len(nodes)
                nodes.append((axis, value, 0, 0))
                low = build(rows[part[rows, axis] <= value + reach])
                high = build(rows[part[rows, axis] > value - reach])
                nodes[at] = (axis, value, low, high)
                return at
        nodes.append((-1, 0.0, 0, 0))
        size = len(rows) * share
        cost += size * size / 2 * (part.shape[1] + PAIR_COST) + size * math.ceil(size / TILE) * COPY_COST
        return len(nodes) - 1

    build(np.arange(len(part)))
    return nodes, cost


def fit(sample: np.ndarray, n: int, threshold: float) -> Blocks:
    """Principal axes of a bounded sample; blocks of equal variance, as many as make the cells cheapest; budgets by share of variance."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    d = unit.shape[1]
    centred = unit - unit.mean(0)
    values, rotation = np.linalg.eigh(centred.T @ centred / len(unit))
    values, rotation = np.maximum(values[::-1], 0) + 1e-6, rotation[:, ::-1]
    turned, mass = unit @ rotation, np.cumsum(values) / values.sum()
    total = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    best, least = None, math.inf
    for wanted in (1 << i for i in range(max(1, d // 2).bit_length())):
        edges = np.unique([0, *(int(np.searchsorted(mass, i / wanted - 1e-9)) + 1 for i in range(1, wanted)), d])
        columns = [np.arange(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        budgets = [float(total * values[c].sum() / values.sum()) for c in columns]
        made = [split_block(turned[:, c], math.sqrt(b), n) for c, b in zip(columns, budgets, strict=True)]
        if (cost := sum(m[1] for m in made)) < least:
            best, least = Blocks(rotation, columns, budgets, [m[0] for m in made]), cost
    return best


def cells(blocks: Blocks, turned: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, cell, rows, is home): where each vector goes, home or within reach."""
    for b, (c, budget, nodes) in enumerate(zip(blocks.columns, blocks.budgets, blocks.splits, strict=True)):
        reach = np.sqrt(budget) * (1 + 1e-9)
        stack = [(0, np.arange(len(turned)), np.ones(len(turned), bool))]
        while stack:
            at, rows, home = stack.pop()
            axis, value, low, high = nodes[at]
            if axis < 0:
                if len(rows):
                    yield b, at, rows, home
                continue
            x = turned[rows, c[axis]] - value
            for child, inside, near in ((low, x < 0, x <= reach), (high, x >= 0, x >= -reach)):
                stack.append((child, rows[near], home[near] & inside[near]))


def join_tile(blocks: Blocks, b: int, x: np.ndarray, weight: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile: per row, the weight of the rows it links with, counted at home and in the first block only; and
    the first row of its component within the tile. ``left`` and ``right`` are row numbers (the same array for a tile with itself).
    """
    size = np.sqrt((x * x).sum(1))
    unit = x / size[:, None]
    part = unit @ blocks.rotation[:, blocks.columns[b]]
    half, one = (part**2).sum(1) / 2, np.ones(len(x))
    # a row of ``ahead`` times a row of ``behind`` is half of what the budget leaves: one product and one comparison a pair
    ahead = np.column_stack([part, blocks.budgets[b] / 2 - half, one]).astype(np.float32)
    behind = np.column_stack([part, one, -half]).astype(np.float32)
    del part
    count, root = np.zeros(len(x), np.int64), np.arange(len(x))
    same = left is right
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        for to in range(at if same else 0, len(right), 4096):
            columns = right[to : to + 4096]
            near = ahead[rows] @ behind[columns].T >= -1e-5
            if same and to < at + len(rows):
                near &= (to + np.arange(len(columns)))[None, :] > (at + np.arange(len(rows)))[:, None]  # each pair once
            hit = np.flatnonzero(near)
            if not len(hit):
                continue
            i, j = np.unique(hit // len(columns)), np.unique(hit % len(columns))
            r, s = rows[i], columns[j]
            ok = near[np.ix_(i, j)] & ((x[r] @ x[s].T) / (size[r][:, None] * size[s][None, :]) >= threshold)
            if not ok.any():
                continue
            first = ok if len(blocks.columns) == 1 else ok & first_block(blocks, b, unit, r, s, ok)
            count[r] += np.where(home[r], first @ weight[s], 0)
            count[s] += np.where(home[s], weight[r] @ first, 0)
            root = merge_labels(root, r, s, ok)
    return count, root


def first_block(blocks: Blocks, b: int, unit: np.ndarray, r: np.ndarray, s: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Which of the ``ok`` pairs are admitted by block ``b`` and by none before it.

    Sums go over one vector or pair at a time in a fixed order, so that every tile that meets a pair finds the same.
    """
    turn = lambda v: np.concatenate([(unit[v[i : i + 64], :, None] * blocks.rotation[None]).sum(1) for i in range(0, len(v), 64)])
    p, q = turn(r), turn(s)
    out = np.zeros_like(ok)
    starts, budgets = [int(c[0]) for c in blocks.columns], np.array(blocks.budgets)
    pairs = np.argwhere(ok)
    for at in range(0, len(pairs), 32_768):
        i, j = pairs[at : at + 32_768].T
        inside = np.add.reduceat((p[i] - q[j]) ** 2, starts, axis=1) <= budgets
        out[i, j] = inside[:, b] & ~inside[:, :b].any(1)
    return out


def vector_dedup(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept): how many other vectors have cosine >= threshold with each, and the smallest id reachable.

    Rows with a null, zero or partly null or non-finite vector, or a null id, link with nothing and
    are kept; vectors meet only those with as many dimensions. Equal vectors are one class with a
    weight, known by a 128-bit fingerprint and found by partial aggregation. Rows that repeat an id stay, a row
    each; with unequal vectors they are one node with the links of all. Cells, tiles
    and budgets follow from a bounded sample and one count a cell; nothing is capped.
    """
    spark = df.sparkSession
    first, second = fingerprint(F.col("v"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    linkable = F.col("id").isNotNull() & usable(F.col("v"))
    alone = rows.filter(~linkable).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.filter(linkable).withColumns({"h1": first, "h2": second})
    keys = materialise(rows.groupBy("h1", "h2").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("w")), "keys")
    n, twins = keys.count(), keys.filter("w > 1")
    n_twins = twins.count()
    single = rows.join(checked(twins.select("h1", "h2"), n_twins), ["h1", "h2"], "left_anti").select(F.col("id").cast("long").alias("rep"), F.lit(1).cast("long").alias("w"), "v")
    twin = rows.join(checked(twins, n_twins), ["h1", "h2"]).filter("id = rep").dropDuplicates(["h1", "h2"]).select("rep", "w", "v")
    classes = materialise(single.union(twin).withColumn("d", F.size("v")), "classes")
    shared = spark.sparkContext.broadcast({d: fit(x, n, threshold) for d, x in bounded_sample(classes, "rep", "v").items()})
    if not shared.value:
        return alone

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims).tolist():
                blocks, own = shared.value[d], batch.filter(pa.array(dims == d))
                x = matrix(own.column(2))
                for b, cell, at, home in cells(blocks, x / np.linalg.norm(x, axis=1, keepdims=True) @ blocks.rotation):
                    part = own.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), b, np.int32)), pa.array(np.full(len(at), cell, np.int32)), pa.array(home)], ["rep", "w", "v", "d", "block", "cell", "home"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.mapInArrow(deal, f"rep long, w long, v {kind}, d int, block int, cell int, home boolean")
    # a row a cell: their number is bounded by the sample, not by the table
    counts = dealt.groupBy("d", "block", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tiles = dealt.join(F.broadcast(counts), ["d", "block", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("d", "block", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "rep", "w", "v", "home")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        d, b, _, i, j = (k.as_py() for k in key)
        group = group.take(pa.array(np.argsort(group.column("rep").to_numpy(), kind="stable")))
        second, rep = group.column("second").to_numpy(), group.column("rep").to_numpy()
        left = np.flatnonzero(~second)
        right = left if i == j else np.flatnonzero(second)
        got, root = join_tile(shared.value[d], b, matrix(group.column("v")), group.column("w").to_numpy(), group.column("home").to_numpy(), left, right, threshold)
        own = (got > 0) | (root != np.arange(len(root)))
        return pa.table({"rep": rep[own], "n": got[own], "to": rep[root[own]]})

    links = materialise(tiles.groupBy("d", "block", "cell", "i", "j").applyInArrow(run, "rep long, n long, to long"), "links")
    totals = links.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(links.select(F.col("rep").alias("src"), F.col("to").alias("dst")))
    labelled = keys.join(totals, "rep", "left").join(parts, keys["rep"] == parts["node"], "left")
    labelled = materialise(labelled.select("h1", "h2", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "labelled")
    out = meet(rows.select("id", "h1", "h2"), labelled, ["h1", "h2"], "w", F.xxhash64("id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("component_id") == F.col("id")).alias("kept")).union(alone)
