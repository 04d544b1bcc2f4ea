"""Exact duplicates, spelling variants and collocations against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemora.llm import collocations as C
from mnemora.llm import letters as L
from mnemora.llm import variants as V
from mnemora.llm.exact import exact_dedup, winners

DOCS = "doc_id long, text string, lang string"


# ---------------------------------------------------------------- exact duplicates
def equal_texts(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[ \t-\r]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for members in groups.values():
        best = min(members)
        out += [(m[4], best[4], len(members), m[3] == best[3]) for m in members]
    return sorted(out, key=str)


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab"), (4, None), (5, ""), (6, " \n"), (None, "a b"), (7, "a b"), (8, "x" * 9000), (9, "x " * 9000), (10, "é"), (10, "é"), (11, "A B")]
    rows += [(100 + i, "hot") for i in range(500)] + [(700 + i, f"own {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(7)).withColumn("size", F.lit("clash")).repartition(5)
    for parts in (1000, 10):
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, "doc_id", "text", parts).collect()]
        assert sorted(got, key=str) == equal_texts(rows)


def test_frequent_digests_are_verified(spark):
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text_sha256"), F.lit(1).cast("long").alias("size"), F.col("id").alias("row"))
    got = winners(rows, 100).collect()
    assert [(r.text_sha256, r.keep_id, r.group_size) for r in got] == [("hot", 0, 6667)]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- runs of bytes
@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_pieces(monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    texts = ["", "one two", None, "x" * 50, "  three", "é à", "end"]
    found = []
    for row, data, begins in L.joined(pa.array(texts, pa.string())):
        for starts, ends, flat in L.pieces(data, ~((data == 32) | (data == 10))):
            assert flat.tobytes() == b"".join(data[a:b].tobytes() for a, b in zip(starts, ends, strict=True))
            found += [(row + int((begins <= a).sum()) - 1, data[a:b].tobytes().decode()) for a, b in zip(starts, ends, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]


# ---------------------------------------------------------------- spelling variants
def spelled(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def formed(n):
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 5 * n[w] else None, len(others)]
    rows = []
    for w, (form, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(rows)


def random_docs(random, size=60):
    letters = "abcé"
    words = ["".join(random.choice(letters) for _ in range(random.randint(4, 9))) for _ in range(60)]
    words += [w[:3] + random.choice("abz") + w[4:] for w in words] + [w + "a" for w in words] + [w[1:] for w in words]
    return [(i if i else None, " ".join(random.choice(words) if random.random() > 0.3 else words[int(random.random() ** 3 * 40)].title() for _ in range(120)) + "×÷ÀÉÿÿÿÿ3abcabcab") for i in range(size)]


def answer(rows):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect())


@pytest.mark.parametrize("group", [20_000, 3])
def test_variants(spark, monkeypatch, group):
    import random

    monkeypatch.setattr(V, "GROUP", group)
    monkeypatch.setattr(V, "PARTS", 10**9 if group == 3 else 1000)
    docs = random_docs(random.Random(3))
    docs += [(900, None), (901, ""), (902, "Z" * 90_000 + " " + "z" * 90_000)] + [(903, "repeated repeated repeatde")] * 6
    want = formed(spelled(docs))
    assert any(r[2] != r[1] for r in want if r[1]) or len(want) > 100
    got = answer(V.variants(spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).repartition(3), "doc_id", "text"))
    assert got == want


def test_long_chain_of_forms(spark):
    word, docs = "abcdefghijkl", []
    for step in range(4):
        docs += [(len(docs) + i, " ".join([word[:step] + "z" * step + word[2 * step :]] * 5)) for i in range(6**step)]
    assert answer(V.variants(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")) == formed(spelled(docs))


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"bats", "cats", "bat", "cat", "bits", "bit", "é"})
    arcs, ends, first = V.automaton(words)
    assert len(arcs) == 6  # the end, before s, before t, after b, after c, the first
    for i, w in enumerate(words):
        state, rank = first, 0
        for c in w:
            state, more = arcs[state][c]
            rank += more
        assert ends[state] and rank == i
    assert sorted(words[i] for i in V.one_error((arcs, ends, first), "bat", 1)) == ["bats", "bit"]


def test_crc_of_runs():
    import numpy as np

    words = [b"a", b"", b"hello", b"x" * 64, b"y" * 65, b"z" * 1000, "éà".encode()]
    flat = np.frombuffer(b"".join(words), np.uint8)
    size = np.array(list(map(len, words)))
    seeds = np.array([zlib.crc32(b"%d:" % i) for i in range(len(words))], np.uint32)
    assert V.crc_runs(flat, np.cumsum(size) - size, size, seeds).tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]


def test_variants_of_nothing(spark):
    assert V.variants(spark.createDataFrame([], DOCS), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- collocations
def phrases(docs, least, most, longest=3):
    count, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                count.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    rows = defaultdict(list)
    for p, a in count.items():
        if len(p) < 3 or a < least:
            continue
        longer = [c for q, c in count.items() if len(q) > len(p) and c >= least and q[0] == p[0] and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q)))]
        if longer and 100 * max(longer) >= 50 * a:
            continue
        cuts = []
        for k in range(2, len(p)):
            left, right = count[p[:k]], count[(p[0], *p[k:])]
            cuts.append((math.floor(Fraction(1_000_000 * a * a, left * right)), k, left, right))
        score, _, left, right = min(cuts)
        rows[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    out = []
    for lang, found in rows.items():
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard,roots", [(1 << 20, 1 << 18), (97, 13)])
def test_collocations(spark, monkeypatch, shard, roots):
    import random

    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "ROOTS", roots)
    r = random.Random(5)
    words = ["the", "of", "Then", "é", "now", "rare", "\x00", "ÉA", "a", "b"]
    docs = [(i, "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", " ", ". ", "\n", " ,"]) for _ in range(80)), r.choice(["en", "fr", None, "und"])) for i in range(40)]
    docs += [(50, None, "en"), (51, "", "fr"), (52, "w" * 5000 + " " + "the of " * 700, "en"), (53, "..,,", None)] + [(60, "same thing same thing", "de")] * 9
    frame = spark.createDataFrame(docs, DOCS).withColumn("a", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    for least, most in ((10, 2000), (3, 7)):
        got = C.collocations(frame, "text", "lang", least, 3, 50, most, dealt=4)
        assert sorted(tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases(docs, least, most)


def test_longer_phrases(spark):
    docs = [(i, "one two three four. two three four five, one two three four", "en") for i in range(6)]
    got = C.collocations(spark.createDataFrame(docs, DOCS), "text", "lang", 3, 4)
    assert sorted(tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases(docs, 3, 2000, 4)


def test_collocations_of_nothing(spark):
    assert C.collocations(spark.createDataFrame([], DOCS), "text", "lang").count() == 0
