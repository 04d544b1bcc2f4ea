"""Operator 6 against all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from mnemora.llm import jaccard, queries
from mnemora.llm.common import Sieve

SF = "/root/testdata/sf0.01"


def plain_set(text, size=5):
    words = ["".join(c for c in w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, threshold=0.8):
    sets = {d: plain_set(t) for d, t in docs}
    ids = sorted(sets)
    links = {d: set() for d in ids}
    where = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    for d in ids:
        count = {}
        for s in sets[d]:
            for e in where[s]:
                count[e] = count.get(e, 0) + 1
        for e, n in count.items():
            if e != d and n / (len(sets[d]) + len(sets[e]) - n) >= threshold:
                links[d].add(e)
    part = {d: d for d in ids}
    for _ in ids:
        new = {d: min([part[d], *(part[e] for e in links[d])]) for d in ids}
        if new == part:
            break
        part = new
    return {d: (part[d], len(links[d]), part[d] == d) for d in ids}


def test_op6_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in queries.op6_jaccard(spark, SF).collect()}
    want = brute(docs)
    assert sum(v[1] for v in want.values()) > 100
    assert got == want


def varied(seed=0):
    """Copies, a large group of near copies, a chain, a shared passage, odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randrange(30))
    base = [word() for _ in range(200)]
    texts = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(200)] = f"new{i}"
        texts.append(" ".join(own))
    texts += [texts[0].upper() + "!!"] * 5
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    texts += [None, "", "  ... ", "one", "one", "One two", "one two three four five", "é è ñ ß ü", "É È Ñ ß Ü", "x " * 20000, "x_y", "x y"]
    return texts


def test_large_groups_split_and_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "TILE", 25)
    monkeypatch.setattr(jaccard, "SIGNED_TILE", 40)
    docs = list(enumerate(varied()))
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, n int, key string")
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in jaccard.jaccard_join(df, "doc_id", "text").collect()}
    assert got == brute(docs)


def test_odd_tables(spark):
    schema = "doc_id long, text string, sig string"
    df = spark.createDataFrame([(1, "a b c d e f", None), (1, "a b c d e f", None), (1, "other words than those here", None), (2, "a b c d e f", "x"), (None, "a b c d e f", None), (3, None, None), (4, "", None)], schema)
    got = sorted((tuple(r)[:4] for r in jaccard.jaccard_join(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, 1, 2, True), (1, 1, 2, True), (1, 1, 0, True), (2, 1, 2, False), (None, None, 0, True), (3, 3, 0, True), (4, 4, 0, True)], key=str)
    assert jaccard.jaccard_join(df.filter("false"), "doc_id", "text").count() == 0


def test_shingles_are_word_runs():
    for t in [*varied(3)[-40:], "a b c d e a b c d e a b"]:
        assert len(jaccard.shingles(t or "")) == len(plain_set(t))
    assert (jaccard.shingles("A-b, C d e f") == jaccard.shingles("zz a b c d e f zz a b c d e f"[3:14])).all()
    assert jaccard.runs_needed(0.8) >= 5


def test_recall_of_one_run():
    """The share of pairs at similarity 0.8 that meet at depth 2 of a run is what ``reached`` says."""
    rng = np.random.default_rng(0)
    met = total = 0
    for _ in range(100):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (jaccard.signature(np.concatenate([both, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2))
        for run in range(20):
            nodes = []
            for s in (a, b):
                node = jaccard.mix(np.array([run + 1], np.uint64) * jaccard.BASE)
                sign = s[None, :]
                for _ in range(2):
                    row, node = jaccard.split(node, sign)
                    sign = sign[row]
                nodes.append(set(node.tolist()))
            met += bool(nodes[0] & nodes[1])
            total += 1
    assert abs(met / total - jaccard.reached(0.8, 2)) < 0.1


def test_recall_with_one_signature():
    """Runs share a signature: the stated recall holds with its agreement averaged in, and what leaves with a centre leaves no partner behind."""
    for threshold in (0.5, 0.6, 0.7, 0.8, 0.9):
        tie, near, core = jaccard.bounds(threshold)
        assert jaccard.missed(threshold, jaccard.runs_needed(threshold), tie) <= 1.001 * (1 - jaccard.RECALL)
        assert 0 < near <= tie + core - jaccard.SIGNATURE and near < core < jaccard.SIGNATURE


def test_borderline_pairs(spark):
    """Pairs of sets exactly at the threshold are linked, all of them, whatever the threshold."""
    for threshold, both, own in ((0.5, 20, 10), (0.6, 30, 10), (0.7, 28, 6), (0.8, 32, 4)):
        texts = []
        for p in range(1000):
            common = [f"c{p}x{i}" for i in range(both)]
            texts += [" ".join([*common, *(f"o{p}x{side}x{i}" for i in range(own))]) for side in range(2)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = jaccard.jaccard_join(df, "doc_id", "text", 1, threshold).collect()
        assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i - i % 2, 1) for i in range(2000)}, threshold


def test_recall_by_similarity(spark):
    """Pairs of sets in bands of similarity from the threshold up: every band's links are found, none below the threshold."""
    texts, want = [], []
    for band, (both, own) in enumerate(((40, 10), (41, 9), (43, 7), (46, 4), (49, 1), (39, 11))):  # 0.67 is the last, others 0.67 to 0.96
        for p in range(400):
            common = [f"c{band}x{p}x{i}" for i in range(both)]
            texts += [" ".join([*common, *(f"o{band}x{p}x{side}x{i}" for i in range(own))]) for side in range(2)]
            want += [both / (both + 2 * own) >= 0.66] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.jaccard_join(df, "doc_id", "text", 1, 0.66).collect()}
    for band in range(6):
        ids = range(800 * band, 800 * (band + 1))
        assert sum(got[i].n_links for i in ids) == sum(want[800 * band : 800 * (band + 1)]), band


def test_shared_boilerplate_is_taken_apart(spark, monkeypatch):
    """Texts that share much, but too little to be linked, are no candidates together."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "TILE", 20)
    rng = random.Random(5)
    common = " ".join(f"licence{i}" for i in range(40))
    docs = [(i, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.features(df, "doc_id", "text", 5)
    sets = jaccard.materialise(rows.selectExpr("key", "check", "1L as w", "id as rep", "sig", "n as size"), "sets")
    groups = jaccard.connected_components(jaccard.ties(sets, 0.8, jaccard.RECALL))
    made = jaccard.candidates(groups, sets, 0.8, jaccard.RECALL)
    sizes = [r["count"] for r in made.groupBy("component").count().collect()]
    assert max(sizes) <= 4 and sum(sizes) >= 60
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in jaccard.jaccard_join(df, "doc_id", "text").collect()}
    assert got == brute(docs)


def test_dropping_keeps_one_row_and_all_columns(spark):
    """Names that helpers would use, repeated ids, and null ids."""
    text = "one two three four five six seven"
    schema = "doc_id long, text string, _gone int, __0 string, class_id long, place int"
    rows = [(1, text, 0, "a", 5, 1), (1, text, 0, "a", 5, 1), (2, text, 1, None, 5, 2), (3, "some other words that stay here", 2, "c", None, 3), (None, text, 3, "d", 1, 4), (None, text, 4, "e", 1, 5), (4, None, 5, "f", 1, 6), (4, None, 5, "f", 1, 6)]
    df = spark.createDataFrame(rows, schema)
    got = jaccard.drop_duplicates(df, "doc_id", "text")
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r["text"] or "") for r in got.collect()) == sorted([(1, text), (3, rows[3][1]), (0, text), (4, "")])
    assert jaccard.drop_duplicates(df.filter("false"), "doc_id", "text").count() == 0


def test_sieve(spark):
    keys, all_ = spark.range(0, 5000, 7), spark.range(5000).union(spark.createDataFrame([(None,)], "id long"))
    sieve = Sieve(keys, "id", keys.count())
    inside, outside = (sieve.split(all_, F.col("id"), w) for w in (True, False))
    assert inside.columns == ["id"] and inside.count() + outside.count() == 5001
    assert keys.join(inside, "id").count() == keys.count() and inside.count() < 1500
    assert Sieve(keys.filter("false"), "id", 0).split(all_, F.col("id"), False).count() == 5001


def test_large_nodes_at_other_thresholds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    docs = list(enumerate(varied(1)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (0.5, 0.65):
        got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in jaccard.jaccard_join(df, "doc_id", "text", 5, threshold).collect()}
        assert got == brute(docs, threshold), threshold
