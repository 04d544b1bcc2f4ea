"""The pipeline's stages, one by one, against brute force on their own inputs."""

import random
import re
import string

import corpus_pipeline
from tokenizers import Tokenizer

from mnemora.llm import queries
from mnemora.llm.common import materialise

from .test_filters import plain_spans
from .test_jaccard import brute
from .test_tokens import check_packed

SF = "/root/testdata/sf0.001"


def hidden(text):
    out, at = "", 0
    for start, order, end, kind in plain_spans(text):
        if kind in ("assign", "access", "hex", "secret"):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
    return out + text[at:]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(9001, "123 456 !!", "en", "s", 10), (9002, None, None, None, None), (None, "the and of that this is", None, "s", 5)], docs.schema)
    docs = materialise(docs.union(extra), "docs")
    start = {r.doc_id: r for r in docs.collect()}
    kept = materialise(corpus_pipeline.language(spark, docs, SF), "kept")
    rows = kept.collect()
    assert kept.columns == columns and {9001, 9002} == start.keys() - {r.doc_id for r in rows}
    assert all(re.search(r"[^\W\d_]", r.text) and r == start[r.doc_id] for r in rows)
    single = materialise(corpus_pipeline.near_duplicates(spark, kept, SF), "single")
    want = brute([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {d for d, v in want.items() if v[2]} | {None}
    clean = materialise(corpus_pipeline.secrets(spark, single, SF), "clean")
    assert clean.columns == columns
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        assert r.text == hidden(before[r.doc_id].text) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
    packed = corpus_pipeline.packing(spark, clean, SF).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in clean.collect()], Tokenizer.from_file(queries.BYTE_VOCABULARY))


def test_language_stage_decides(spark):
    """Gibberish, hexadecimal, symbols and other scripts go; clean texts, however short, and code stay."""
    r = random.Random(4)
    letters = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    bad = [" ".join(letters(string.ascii_lowercase, r.randint(2, 9)) for _ in range(300)), letters("0123456789abcdef", 3000), letters(string.ascii_letters + string.digits + "+/", 3000), "#$%a &*( b)_+ {}c " * 50, "это текст на другом языке " * 20]
    good = ["A.", "Avec.", "the", "und die der in den", "le la des et que pour", "the and of that this is", "def f(x):\n    return [i for i in range(x) if i % 2]\n" * 20]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000 + i, t, None, "s", len(t)) for i, t in enumerate(bad + good)], docs.schema)
    kept = {x.doc_id for x in corpus_pipeline.language(spark, docs.union(extra), SF).collect()}
    assert {x.doc_id for x in docs.collect()} <= kept
    assert {i for i in kept if i >= 9000} == {9000 + i for i in range(len(bad), len(bad + good))}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len({r.doc_id for r in got}) <= len(docs)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
