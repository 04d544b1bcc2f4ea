"""Operators 2 and 4 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from mnemora.llm import components, neighbours, queries, vector_dedup, vectors

SF = "/root/testdata/sf0.1"


def table(spark, x, ids=None, extra=True):
    rows = [(int(i), [float(c) for c in v] if v is not None else None, "x", 1) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, n int")


def brute_neighbours(ids, x, k, step):
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        own = [(a, b) for a, b in zip(d, ids, strict=True) if b != ids[q]]
        out[int(ids[q])] = sorted(own)[:k]
    return out


def test_op2_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    want = brute_neighbours(ids, x, 10, 100)
    got = {}
    for r in queries.op2_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (f[1], f[2]))
        hits += len({f[2] for f in found} & {b for _, b in want[q]})
        for _, score, v in found:
            assert abs(score - np.linalg.norm(x[ids == v][0] - x[ids == q][0])) < 1e-12
    print("recall", hits / (10 * len(want)))
    assert hits >= 0.9 * 10 * len(want)


def test_nearest_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 20)
    rng = np.random.default_rng(1)
    good = rng.normal(size=(150, 6)).astype(np.float32).astype(float)
    good[20:110] = good[20]  # a hot vector
    bad = [None, [0.0] * 6, [float("nan")] + [1.0] * 5, [float("inf")] * 6, []]
    df = table(spark, [*good, *bad], range(155))
    df = df.union(df.filter("vec_id = 7")).union(spark.createDataFrame([(None, [1.0] * 6, "x", 1), (300, [1.0, None] * 3, "x", 1), (400, [1.0, 2.0], None, None)], df.schema))
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, 5, target=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute_neighbours(np.arange(150), good, 5, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for _, v in sorted(got[q])] == [b for _, b in want[q]], q
    assert neighbours.nearest(df.filter("false"), "vec_id", "embedding", F.col("vec_id") % 10 == 0).count() == 0
    few = table(spark, good[:3])
    assert neighbours.nearest(few, "vec_id", "embedding", F.lit(True), 10).count() == 6


def test_few_candidates_where_vectors_cluster():
    """On clustered vectors a query meets a small part of the table and most of its nearest, also where the sample is much smaller than the table."""
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 48)) for c in rng.normal(size=(300, 48))])
    for rows in (len(x), 1500):
        forest = neighbours.fit(x[rng.permutation(len(x))[:rows]], len(x), 10)
        assert (forest.bits > 0) == (rows == 1500)
        where, asked = forest.index(x), x[::90]
        sizes = np.unique(where, return_counts=True)[1]
        assert np.median(sizes) < 3 * neighbours.LEAF
        near, met, hits = (x**2).sum(1)[None, :] - 2 * asked @ x.T, 0, 0
        for q, found in enumerate(forest.search(asked)):
            assert len(set(found)) == len(found) and found[0] in where[90 * q]
            inside = np.isin(where, found).any(1)
            met += inside.sum()
            hits += inside[np.argsort(near[q], kind="stable")[1:11]].sum()
        assert met <= 0.2 * len(x) * len(asked) and hits >= 0.9 * 10 * len(asked), (rows, met / len(x) / len(asked), hits)


def test_a_pair_is_ranked_in_one_tree():
    """Each candidate counts in the first tree in which the query meets it, so all trees together give every pair once."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    forest = neighbours.fit(x, len(x), 5, leaf=16)
    cells, asked = forest.index(x), x[:30]
    found = [np.array(f) for f in forest.search(asked)]
    pairs = []
    for t in range(cells.shape[1]):
        visited = [f[forest.tree[f >> forest.bits] <= t] for f in found]
        q, c, score = neighbours.ranked(t + 1, cells[:, : t + 1], np.arange(400), x, visited, asked, 400)
        assert np.allclose(score, np.linalg.norm(asked[q] - x[c], axis=1))
        pairs += zip(q.tolist(), c.tolist(), strict=True)
    assert len(set(pairs)) == len(pairs)
    assert set(pairs) == {(i, j) for i, f in enumerate(found) for j in np.flatnonzero(np.isin(cells, f).any(1)).tolist()}


def brute_links(x, threshold):
    size = np.linalg.norm(x, axis=1)
    link = x @ x.T / size[:, None] / size >= threshold
    np.fill_diagonal(link, False)
    part = np.arange(len(x))
    while True:
        new = np.minimum(part, np.where(link, part[None, :], len(x)).min(1))
        if (new == part).all():
            return link.sum(1), part
        part = new


def clustered(rng, n, d):
    centres = rng.normal(size=(12, d))
    x = np.concatenate([c + rng.normal(size=(int(k), d)) * s for c, k, s in zip(centres, rng.integers(1, n // 6, 12), rng.uniform(0.02, 0.5, 12), strict=True)] + [rng.normal(size=(n // 2, d))])
    x[5:40] = x[5]
    return rng.permutation(x.astype(np.float32).astype(float))


def test_dedup_equals_brute_force(spark, monkeypatch):
    for seed, d, tile, threshold in ((0, 64, 8192, 0.9), (1, 40, 25, 0.9), (2, 3, 30, 0.97), (3, 17, 40, 0.8)):
        monkeypatch.setattr(vector_dedup, "TILE", tile)
        x = clustered(np.random.default_rng(seed), 300, d)
        n, part = brute_links(x, threshold)
        got = sorted(vector_dedup.vector_dedup(table(spark, x), "vec_id", "embedding", threshold).collect())
        assert [tuple(r) for r in got] == [(i, int(a), int(b), i == b) for i, (a, b) in enumerate(zip(n, part, strict=True))]


def test_blocks_follow_the_variance():
    """Nothing to separate: one block of all dimensions. A few strong axes with gaps: low-dimensional blocks whose cells part."""
    rng = np.random.default_rng(0)
    flat = vector_dedup.fit(rng.normal(size=(4000, 64)), 10**9, 0.9)
    assert len(flat.columns) == 1 and len(flat.splits[0]) == 1
    spots = rng.normal(size=(200, 3))[rng.integers(0, 200, 6000)]
    strong = vector_dedup.fit(np.concatenate([spots + 0.01 * rng.normal(size=spots.shape), 0.01 * rng.normal(size=(6000, 61))], 1), 10**9, 0.99)
    assert max(map(len, strong.splits)) > 50 and len(strong.columns[0]) <= 3 or len(strong.columns) == 1
    assert max(map(len, strong.splits)) > 50
    for blocks in (flat, strong):
        assert np.concatenate(blocks.columns).tolist() == list(range(64)) and abs(sum(blocks.budgets) - (2 - 2 * (0.9 if blocks is flat else 0.99))) < 1e-6


def test_many_blocks_count_each_pair_once(monkeypatch):
    """Whatever the layout, the blocks together give every link once."""
    rng = np.random.default_rng(3)
    x = clustered(rng, 400, 12)
    x = np.unique(x, axis=0)
    n, _ = brute_links(x, 0.9)
    whole = vector_dedup.fit(x, len(x), 0.9)
    for k in (2, 3, 6):
        columns = np.array_split(np.arange(12), k)
        made = vector_dedup.Blocks(whole.rotation, columns, [whole.budgets[0] / k] * k, [[(-1, 0.0, 0, 0)]] * k)
        rows, one = np.arange(len(x)), np.ones(len(x), np.int64)
        got = sum(vector_dedup.join_tile(made, b, x, one, one > 0, rows, rows, 0.9)[0] for b in range(k))
        assert got.tolist() == n.tolist()


def test_dedup_hot_and_bad_thirds(spark):
    """A third of the rows share one vector and a third have none that counts."""
    x = [[1.0, 2.0]] * 300 + [None, [0.0, 0.0], [float("nan"), 1.0]] * 100 + [[np.cos(i), np.sin(i)] for i in np.linspace(0, 6, 300)]
    got = {r.vec_id: r for r in vector_dedup.vector_dedup(table(spark, x), "vec_id", "embedding", 0.9999).collect()}
    good = np.array([v for i, v in enumerate(x) if not 300 <= i < 600], np.float32).astype(float)
    ids = [i for i in range(900) if not 300 <= i < 600]
    n, part = brute_links(good, 0.9999)
    assert [(got[i].n_links, got[i].component_id) for i in ids] == [(int(a), ids[b]) for a, b in zip(n, part, strict=True)]
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 600))


def test_dedup_odd_rows(spark):
    x = [[1.0, 0.0], [2.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, 0.0, 0.0], [1.0, 0.0]]
    df = table(spark, x).union(spark.createDataFrame([(None, [1.0, 0.0], "x", 1), (6, [1.0, 0.0], "y", 1), (8, [None, 1.0], None, None)], table(spark, x[:1]).schema))
    got = sorted((tuple(r) for r in vector_dedup.vector_dedup(df, "vec_id", "embedding").collect()), key=str)
    assert got == sorted([(0, 3, 0, True), (1, 3, 0, False), (6, 3, 0, False), (6, 3, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 0, None, True), (8, 0, 8, True)], key=str)
    assert vector_dedup.vector_dedup(df.filter("false"), "vec_id", "embedding").count() == 0


def test_op4_whole_table(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    n, part = brute_links(np.array([r.embedding for r in rows], float), 0.9)
    got = sorted(queries.op4_vector_dedup(spark, SF).collect())
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == [(r.vec_id, int(a), rows[b].vec_id) for r, a, b in zip(rows, n, part, strict=True)]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))]
    part = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    got = dict(components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {v: c for v, c in part.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sample_is_whole_when_small(spark):
    x = np.random.default_rng(0).normal(size=(50, 4))
    assert len(vectors.bounded_sample(table(spark, x), "vec_id", "embedding")[4]) == 50


def test_rare_dimensions_are_sampled(spark, monkeypatch):
    """However small the sample, each number of dimensions has a model, and its vectors meet each other."""
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 2)
    rng = np.random.default_rng(5)
    x = [*rng.normal(size=(200, 6)).tolist(), *([i + 1.0, 1.0, 0.0] for i in range(3)), [1.0] * 9]
    df = table(spark, x)
    assert set(vectors.bounded_sample(df, "vec_id", "embedding")) == {6, 3, 9}
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_dedup(df, "vec_id", "embedding", 0.9).collect()}
    for first, part in ((0, x[:200]), (200, x[200:203])):
        n, component = brute_links(np.array(part, np.float32).astype(float), 0.9)
        assert [got[first + i] for i in range(len(part))] == [(int(a), first + int(b)) for a, b in zip(n, component, strict=True)]
    assert got[203] == (0, 203)
    near = neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") >= 200, 5, sample_rows=2).collect()
    assert sorted((r.query_id, r.vec_id) for r in near) == [(a, b) for a in range(200, 203) for b in range(200, 203) if a != b]


def test_bulk_search_is_the_queue(monkeypatch):
    """Leaves found by their bounds together have the bounds of those that the queue gives one by one."""
    rng = np.random.default_rng(8)
    sample = rng.normal(size=(600, 6))
    for bits in (0, 3):
        forest = neighbours.grow(sample, 3, 16, bits, 1)
        asked, total = rng.normal(size=(20, 6)), len(forest.tree) << bits
        for visits in (1, 7, total // 2, total):
            monkeypatch.setattr(neighbours, "BULK", 0)
            queue = forest.search(asked, visits)
            monkeypatch.setattr(neighbours, "BULK", 10**9)
            for x, bulk, one in zip(asked, forest.search(asked, visits), queue, strict=True):
                bounds = forest.bounds(x)  # leaves with one bound may come in any order
                assert len(set(bulk)) == len(set(one)) == visits and np.allclose(np.sort(bounds[bulk]), np.sort(bounds[one]))


def test_calibration_has_no_cut():
    """Vectors without structure in a forest of many leaves: the visits follow from the bounds, and are not all leaves for want of a longer search."""
    rng = np.random.default_rng(9)
    forest = neighbours.fit(rng.normal(size=(4096, 64)), 2_000_000, 10)
    total = len(forest.tree) << forest.bits
    assert total > 1 << 14 and forest.visits < total
