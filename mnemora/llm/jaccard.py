"""Operator 6: n-gram Jaccard join by chosen paths.

A text is its set of word shingles. Every distinct set gets a minwise signature, whose values are
the tokens it can share. In each of several runs a tree splits the sets: a node picks some positions
at random, and sets with equal values there go down together, so similar sets stay together and
others part. Small nodes are compared outright. A large node's sets that are near its centre are
tied to it and leave; the rest split again. Runs repeat until the wanted recall at the threshold.

What the trees tie together is only a superset of the links. Large groups are first taken apart by the
signatures alone: only sets that agree at enough positions with another stay together, so what is merely
near a common centre is no candidate. Each group that is left is verified exactly, on the whole texts, in
bounded tiles that count links and never emit pairs. The texts are fetched by the ids of the candidates.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, grouped, materialise, meet, slices, unused
from .components import connected_components, merge_labels

SHINGLE = 5
SIGNATURE = 64
#: Positions that a node picks, on average (1 to 2).
BRANCHING = 1.6
FIRST_DEPTH, LAST_DEPTH = 2, 5
#: Sets of a node that are compared outright.
SMALL = 32
RECALL = 0.99999
#: Part of the pairs that may be missed which is left to signatures that agree too little; the rest is left to the runs.
UNLIKE = 0.1
#: Sets on either side of a tile of signatures.
SIGNED_TILE = 2048
#: Texts on either side of a verification tile, at least and at most, and shingles: a group of n has sides of about 2.4 times
#: the root of n, so that neither the number of its tiles nor a tile grows as the group does.
TILE, LARGE_TILE, TILE_SHINGLES = 128, 2048, 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 below n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words (one run of all, if fewer); empty without a word.

    Words are runs of letters and digits, in lower case.
    """
    code = np.frombuffer(f"{text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_characters()[code]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(1 << max(12, int(len(code)).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)])])
    word = mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))
    n = max(1, len(word) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(word))):
        out += word[i : i + n] * PLACES[i]
    return np.unique(mix(out + np.uint64(min(size, len(word)))))


MULTIPLIERS = mix(np.arange(1001, 1001 + SIGNATURE, dtype=np.uint64)) | np.uint64(1)


def signature(own: np.ndarray) -> np.ndarray:
    """The smallest of each of SIGNATURE hashes over a set, shortened to 16 bits: two unequal sets share a node of depth two by chance once in four thousand million."""
    least = np.full(SIGNATURE, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096, None] * MULTIPLIERS[None, :]
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(0))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def reached(threshold: float, depth: int, branching: float = BRANCHING) -> float:
    """Chance that a pair at the threshold still shares a node at a depth of one run: a node picks one position, or two with the chance branching - 1."""
    chance = 1.0
    for _ in range(depth):
        part = threshold * chance
        chance = (2 - branching) * part + (branching - 1) * (1 - (1 - part) ** 2)
    return chance


def agreements(threshold: float) -> list[float]:
    """Chance of each number of positions, 0 to SIGNATURE, at which the signatures of a pair at the threshold agree."""
    return [math.comb(SIGNATURE, k) * threshold**k * (1 - threshold) ** (SIGNATURE - k) for k in range(SIGNATURE + 1)]


def bounds(threshold: float, recall: float = RECALL) -> tuple[int, int, int]:
    """Positions that must agree: to be tied in a small node (tie); to be tied to a centre (near); to leave with it (core).

    A pair at the threshold agrees at fewer than ``tie`` positions with the chance UNLIKE * (1 - recall) at most. Where two
    sets agree with each other and one with a centre, the other agrees with it too, so from ``tie`` + ``core`` positions
    at least ``near`` = tie + core - SIGNATURE are left: a set that leaves has no partner that was not tied.
    """
    tie, below, chance = 0, 0.0, agreements(threshold)
    while tie < SIGNATURE and below + chance[tie] <= UNLIKE * (1 - recall):
        below += chance[tie]
        tie += 1
    near = tie // 2
    return tie, near, near + SIGNATURE - tie


def missed(threshold: float, runs: int, tie: int, depth: int = LAST_DEPTH) -> float:
    """Chance that a pair at the threshold is not tied. All runs draw from one signature, so they are independent only for a given agreement."""
    return sum(p * (1.0 if k < tie else (1 - reached(k / SIGNATURE, depth)) ** runs) for k, p in enumerate(agreements(threshold)))


def runs_needed(threshold: float, recall: float = RECALL, depth: int = LAST_DEPTH) -> int:
    """The fewest runs after which a pair at the threshold is tied with the chance ``recall``."""
    tie = bounds(threshold, recall)[0]
    low, high = 0, 1
    while missed(threshold, high, tie, depth) > 1 - recall:
        low, high = high, 2 * high
        if high > 1 << 16:
            raise ValueError(f"{SIGNATURE} positions cannot give a recall of {recall} at a threshold of {threshold}")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(threshold, middle, tie, depth) > 1 - recall else (low, middle)
    return high


def split(node: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): where each row's node sends it; equal nodes pick equal positions, one or two."""
    drawn = mix(node ^ BASE)
    first = (drawn % np.uint64(SIGNATURE)).astype(np.int64)
    step = 1 + (drawn >> np.uint64(20)) % np.uint64(SIGNATURE - 1)
    twice = np.flatnonzero((drawn >> np.uint64(40)).astype(np.float64) < (BRANCHING - 1) * 2**24)
    row = np.concatenate([np.arange(len(node)), twice])
    position = np.concatenate([first, (first[twice] + step[twice].astype(np.int64)) % SIGNATURE])
    return row, mix(mix(node[row] + position.astype(np.uint64) + np.uint64(1)) ^ sign[row, position].astype(np.uint64))


def signatures(column: pa.Array) -> np.ndarray:
    """A binary column of signatures, none null, as a matrix over the column's own bytes."""
    if not len(column):
        return np.zeros((0, SIGNATURE), np.uint16)
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16).reshape(-1, SIGNATURE)


def features(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, text_hash, key, check, n, sig): a 128-bit fingerprint of each text's set, its size and its signature; n = 0 for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                sets = [shingles(t, size) for t in texts]
                key = np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s)) for s in sets], np.uint64).view(np.int64)
                check = np.array([mix(s ^ BASE).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                sign = [signature(s).tobytes() if len(s) else None for s in sets]
                kept = [batch.column(i).slice(first, len(texts)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(key), pa.array(check), pa.array([len(s) for s in sets], pa.int64()), pa.array(sign, pa.binary())], ["id", "text_hash", "key", "check", "n", "sig"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "id long, text_hash long, key long, check long, n long, sig binary")


def first_nodes(sets: DataFrame, runs: int) -> DataFrame:
    """(key, node) of every set at FIRST_DEPTH of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sign, keys = signatures(part.column(1)), part.column(0).to_numpy()
                rows = np.tile(np.arange(len(keys)), runs)
                nodes = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64) * BASE), len(keys))
                for _ in range(FIRST_DEPTH):
                    own, nodes = split(nodes, sign[rows])
                    rows = rows[own]
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(nodes.view(np.int64))], ["key", "node"])

    return sets.select("key", "sig").mapInArrow(run, "key long, node long")


def small_ties(tie: int):
    """From rows (node, key, sig) sorted by node: (src, dst) ties of sets that agree at ``tie`` positions within each node; a row's tie is to the first of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in _with_end(batches):
            if batch is not None:
                node, key, sign = batch.column(0).to_numpy(), batch.column(1).to_numpy(), signatures(batch.column(2))
                if carried is not None:
                    node, key, sign = np.concatenate([carried[0], node]), np.concatenate([carried[1], key]), np.concatenate([carried[2], sign])
                if not len(node):
                    continue
                stop = np.searchsorted(node == node[-1], True)
                carried = (node[stop:], key[stop:], sign[stop:])
                node, key, sign = node[:stop], key[:stop], sign[:stop]
            elif carried is None:
                return
            else:
                node, key, sign = carried
            label = np.arange(len(node))
            left, right = [], []
            for shift in range(1, SMALL):
                pair = np.flatnonzero(node[:-shift] == node[shift:]) if shift < len(node) else np.zeros(0, np.int64)
                if not len(pair):
                    break
                near = pair[(sign[pair] == sign[pair + shift]).sum(1) >= tie]
                left.append(near)
                right.append(near + shift)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            while len(a):
                low = np.minimum(label[a], label[b])
                if (low == label[a]).all() and (low == label[b]).all():
                    break
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
            tied = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(key[tied]), pa.array(key[label[tied]])], ["src", "dst"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def compare(near: int, core: int):
    """From rows (node, key, sig, centre, centre_sig): whether each is tied to its node's centre, and whether it is no core, so it may still split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = (signatures(batch.column(2)) == signatures(batch.column(4))).sum(1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(alike >= near), pa.array(alike < core)], ["node", "key", "centre", "tied", "stays"])

    return run


def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (node, key, sig, free): (key, node, free) one level further down."""
    for batch in batches:
        for at in range(0, len(batch), 8192):
            part = batch.slice(at, 8192)
            row, child = split(part.column(0).to_numpy().view(np.uint64), signatures(part.column(2)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(1).take(take), pa.array(child.view(np.int64)), part.column(3).take(take)], ["key", "node", "free"])


def ties(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(src, dst): pairs of keys that connect every group of sets with links, as the trees find them.

    Sets tied to one centre are connected already, so a node goes on only if some of its sets are
    free, that is, not tied: a large group of near copies leaves the trees at its first centre. What
    meets a node's row is dealt by the node's size, so a node that most sets share is no task of its own.
    """
    found, sign = [], sets.select("key", "sig")
    tie, near, core = bounds(threshold, recall)
    level = first_nodes(sets, runs_needed(threshold, recall)).withColumn("free", F.lit(True))
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1):
        level = materialise(level, "nodes")
        shared = level.groupBy("node").agg(F.count("*").alias("size"), F.min("key").alias("centre"), F.max("free").alias("open"))
        shared = materialise(shared.filter("size > 1 and open").drop("open"), "shared")
        large = shared.filter(F.col("size") > SMALL)
        any_large = bool(large.take(1))
        if any_large:
            first = sign.select(F.col("key").alias("centre"), F.col("sig").alias("centre_sig"))
            shared = materialise(large.join(first, "centre").unionByName(shared.filter(F.col("size") <= SMALL), allowMissingColumns=True), "centred")
        rows = materialise(meet(level.select("key", "node"), shared, ["node"], "size", F.xxhash64("key")), "rows")
        small = rows.filter(F.col("size") <= SMALL).select("key", "node").join(sign, "key").select("node", "key", "sig")
        small = small.repartition("node").sortWithinPartitions("node", "key")
        found.append(materialise(small.mapInArrow(small_ties(tie), "src long, dst long").distinct(), "ties"))
        if not any_large:
            break
        big = rows.filter(F.col("size") > SMALL)
        if depth == LAST_DEPTH:
            found.append(big.filter("key <> centre").select(F.col("key").alias("src"), F.col("centre").alias("dst")).distinct())
            break
        paired = big.join(sign, "key").select("node", "key", "sig", "centre", "centre_sig")
        scored = materialise(paired.mapInArrow(compare(near, core), "node long, key long, centre long, tied boolean, stays boolean"), "scored")
        found.append(scored.filter("tied and key <> centre").select(F.col("key").alias("src"), F.col("centre").alias("dst")).distinct())
        going = materialise(scored.groupBy("node").agg(F.max(~F.col("tied")).alias("open"), F.sum(F.col("stays").cast("long")).alias("size")).filter("open"), "going")
        staying = meet(scored.filter("stays").select("node", "key", (~F.col("tied")).alias("free")), going, ["node"], "size", F.xxhash64("key")).join(sign, "key")
        level = staying.select("node", "key", "sig", "free").mapInArrow(descend, "key long, node long, free boolean")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def dealt_in_tiles(members: DataFrame, parts: Column) -> DataFrame:
    """``members`` (component, key and more) of every tile (i, j) of their component, which has ``parts`` parts (of its ``n`` sets); ``second`` says on which side."""
    count = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).withColumn("parts", parts)
    # components are named by their smallest key, so one that holds many sets is a hot key
    dealt = meet(members, materialise(count, "components"), ["component"], "n", F.xxhash64("key"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.col("key"), F.lit(5)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "second": F.col("own") > F.col("other")}).drop("own", "other", "n", "shingles", "parts")


def signed_links(tie: int):
    """From rows (component, i, j, second, key, sig) sorted by the first three: (src, dst), which connect the sets that agree at ``tie`` positions within each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            group = group.take(pa.array(np.argsort(group.column("key").to_numpy(), kind="stable"))).combine_chunks()
            key, second = group.column("key").to_numpy(), group.column("second").to_numpy()
            sign = signatures(group.column("sig").chunk(0))
            left = np.flatnonzero(~second)
            right = np.flatnonzero(second) if second.any() else left
            root = np.arange(len(key))
            for at in range(0, len(left), 32):
                rows = left[at : at + 32]
                agree = np.zeros((len(rows), len(right)), np.uint8)
                for k in range(SIGNATURE):
                    agree += sign[rows, k, None] == sign[None, right, k]
                ok = agree >= tie
                if left is right:
                    ok[np.arange(len(rows)), at + np.arange(len(rows))] = False
                root = merge_labels(root, rows, right, ok)
            tied = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(key[tied]), pa.array(key[root[tied]])], ["src", "dst"])

    return run


def candidates(groups: DataFrame, sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(component, key, w, rep, size) of the sets to verify: the tied groups, the larger ones taken apart by signatures."""
    members = materialise(groups.join(sets, groups["node"] == sets["key"]).select("component", "key", "w", "rep", "size", "sig"), "members")
    sizes = materialise(members.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    large = sizes.filter(F.col("n") > TILE)
    if not large.take(1):
        return members.drop("sig")
    known = meet(members, sizes, ["component"], "n", F.xxhash64("key"))
    tiles = dealt_in_tiles(known.filter(F.col("n") > TILE).drop("n"), F.ceil(F.col("n") / SIGNED_TILE).cast("int"))
    tiles = tiles.select("component", "i", "j", "second", "key", "sig").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    edges = materialise(tiles.mapInArrow(signed_links(bounds(threshold, recall)[0]), "src long, dst long").distinct(), "edges")
    apart = connected_components(edges)
    columns = ["component", "key", "w", "rep", "size"]
    parted = known.filter(F.col("n") > TILE).drop("component").join(apart, known["key"] == apart["node"]).select(*columns)
    return materialise(known.filter(F.col("n") <= TILE).select(*columns).union(parted), "candidates")


def tile_links(sets: list[np.ndarray], weight: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set of a tile: the weight of the sets it links with on the other side, and the first set of its component.

    Intersections are counted by products of presence matrices, a few thousand shingles at a time;
    shingles of one set alone cannot count, and those of all count at once.
    """
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = float((times == len(sets)).sum())
    some = (times > 1) & (times < len(sets))
    column = np.cumsum(some) - 1
    use = some[shingle]
    owner, column = owner[use], column[shingle[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.full((len(left), len(right)), common)
    for at in range(0, int(some.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        present = np.zeros((len(sets), min(4096, int(some.sum()) - at)), np.float32)
        present[owner[a:b], column[a:b] - at] = 1
        inter += present[left] @ present[right].T
    ok = inter / (size[left][:, None] + size[right][None, :] - inter) >= threshold
    count = np.zeros(len(sets), np.int64)
    if left is right:
        ok[np.arange(len(left)), np.arange(len(left))] = False
        count[left] = ok.astype(np.float64) @ weight[right]
    else:
        count[left] = ok.astype(np.float64) @ weight[right]
        count[right] = weight[left].astype(np.float64) @ ok
    return count, merge_labels(np.arange(len(sets)), left, right, ok)


def verify(size: int, threshold: float):
    """From rows (component, i, j, second, key, w, text) sorted by the first three: (key, n, to)."""

    def tile(group: pa.Table, same: bool) -> pa.RecordBatch:
        group = group.take(pa.array(np.argsort(group.column("key").to_numpy(), kind="stable")))
        sets = [shingles(t or "", size) for t in group.column("text").to_pylist()]
        key, weight, second = group.column("key").to_numpy(), group.column("w").to_numpy(), group.column("second").to_numpy()
        made = np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s)) for s in sets], np.uint64).view(np.int64)
        true = np.flatnonzero(made == key)  # another text under a repeated id is no member
        true = true[np.unique(np.stack([key[true], second[true]]), axis=1, return_index=True)[1]]
        sets, key, weight, second = [sets[i] for i in true], key[true], weight[true], second[true]
        left = np.flatnonzero(~second)
        right = left if same else np.flatnonzero(second)
        if len(key) < 2 or not len(left) or not len(right):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["key", "n", "to"])
        count, root = tile_links(sets, weight, left, right, threshold)
        own = (count > 0) | (root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(count[own]), pa.array(key[root[own]])], ["key", "n", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            yield tile(group, group.column("i")[0] == group.column("j")[0])

    return run


def jaccard_join(df: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links, kept, text_hash): each document's class (the smallest id reachable by links), how many other
    documents it links with (Jaccard similarity of shingle sets >= threshold), whether it is its class's first, and
    the ``xxhash64`` of its text, with which decisions can be joined back where ids repeat.

    Null, empty and wordless texts link with nothing and are their own class; rows with a null id
    link with nothing, have a null class and are kept. Rows that repeat an id stay, a row each.
    Equal sets are one class member with a weight (partial aggregation), so exact copies cost no more
    than one text. Links are exact; which sets are compared is random with the stated recall at the
    threshold and more above it. Other columns are not carried.
    """
    rows = materialise(features(df, id_col, text_col, size), "features")
    sets = rows.filter("n > 0 and id is not null").groupBy("key", "check").agg(F.count("*").alias("w"), F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("size"))
    sets = materialise(sets, "sets")
    members = candidates(connected_components(ties(sets, threshold, recall)), sets, threshold, recall)
    side = F.least(F.greatest(2.4 * F.sqrt("n"), F.lit(float(TILE))), F.lit(float(LARGE_TILE)))
    dealt = dealt_in_tiles(members, F.greatest(F.ceil(F.col("n") / side), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int"))
    texts = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    wanted = Sieve(members.select("rep"), "rep", members.count()).split(texts, F.col("rep"), within=True)
    # one plan for every size: the texts are dealt by id, also where the members would be few enough to broadcast
    tiles = dealt.join(wanted.hint("merge"), "rep").select("component", "i", "j", "second", "key", "w", "text")
    tiles = tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = materialise(tiles.mapInArrow(verify(size, threshold), "key long, n long, to long"), "links")
    totals = links.groupBy("key").agg(F.sum("n").alias("n"))
    linked = connected_components(links.select(F.col("key").alias("src"), F.col("to").alias("dst")))
    named = sets.join(linked, sets["key"] == linked["node"], "left").select("key", "check", "w", "rep", F.coalesce("component", "key").alias("component"))
    first = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = named.join(first, "component").join(totals, "key", "left")
    named = materialise(named.select("key", "check", "class_id", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "named")
    usable = (F.col("n") > 0) & F.col("id").isNotNull()
    met = meet(rows.filter(usable).select("id", "text_hash", "key", "check"), named, ["key", "check"], "w", F.xxhash64("id"))
    met = met.select(F.col("id").alias(id_col), "class_id", "n_links", (F.col("class_id") == F.col("id")).alias("kept"), "text_hash")
    alone = rows.filter(~usable).select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "text_hash")
    return met.union(alone)


def drop_duplicates(df: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """``df`` without the documents that ``jaccard_join`` does not keep; all columns stay, whatever their names.

    One row of each group stays: of rows that repeat both id and text, or a null id and a text with words, only one does.
    Rows that nothing is decided about are told apart by a sieve of ids, so their texts are not shuffled.
    """
    named = jaccard_join(df, id_col, text_col, size, threshold, recall)
    decided = named.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max(~F.col("kept")).alias("_gone"), F.count("*").alias("_n"))
    decided = materialise(decided.filter("_gone or (_n > 1 and _hash is not null)").select("_id", "_hash", "_gone"), "decided")
    sieve = Sieve(decided, "_id", decided.count())
    key = F.col(id_col).cast("long")
    names = {c: unused(df, f"{i}") for i, c in enumerate(("_id", "_hash", "_gone"))}
    decided = decided.select(*(F.col(c).alias(n) for c, n in names.items()))
    id_, hash_, gone = (F.col(n) for n in names.values())
    doubtful = sieve.split(df, key, within=True).hint("merge")  # as at every size: no broadcast of decisions
    met = doubtful.join(decided, key.eqNullSafe(id_) & (F.xxhash64(F.col(text_col).cast("string")) == hash_), "left")
    single = met.filter(gone.isNotNull() & ~gone).dropDuplicates(list(names.values())[:2])
    stay = met.filter(gone.isNull()).union(single).select(*df.columns)
    return sieve.split(df, key, within=False).union(stay)
