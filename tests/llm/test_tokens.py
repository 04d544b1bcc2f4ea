"""Operators 1, 3 and 8 against the tokenizers library."""

import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemora.llm import bpe, packing, queries, token_files

BYTE, WORD = queries.BYTE_VOCABULARY, queries.WORD_VOCABULARY
SF = "/root/testdata/sf0.001"
HARD = ["", None, " ", "a", "aaaaaaaa" * 50, "it's we'LL 12345 ½", "x<|endoftext|>y <|endoftext|>", "<|startoftext|>İstanbul ΣΑΣ ς", "é café naïve ß", "日本語 テキスト 👩‍👩‍👧", "tab\tnl\n\n  end  ", "\x1c\x85\xa0　x", "word " * 3000]
SCHEMA = "doc_id long, text string, id string, ids_le string, start string"


def rows(extra=()):
    return [(i, t, "x", None, "y") for i, t in enumerate([*HARD, *extra])] + [(None, "null id", None, None, None), (3, "a", "x", None, "y")]


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_libraries_agree(texts):
    whole = Tokenizer.from_file(BYTE) if not hasattr(test_libraries_agree, "b") else test_libraries_agree.b
    test_libraries_agree.b = whole
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.model(BYTE).encode_batch(pa.array(texts, pa.string())).to_pylist()] == want
    assert [x.tolist() for x in packing.encoder(BYTE)(texts)] == want
    texts_again = [whole.decode(ids, skip_special_tokens=False) for ids in want]
    assert [bpe.model(BYTE).decode(np.array(ids)) for ids in want] == texts_again
    cut = [ids[1:-1] for ids in want]  # may begin or end within a character
    for lists in (want, cut, [[60000, *ids] for ids in cut]):
        packed = pa.array([None, *(np.array(ids, "<u4").tobytes() for ids in lists)], pa.binary())
        assert bpe.model(BYTE).decode_batch(packed).to_pylist() == [None, *(whole.decode(ids, skip_special_tokens=False) for ids in lists)]
    word = token_files.tokenizer(WORD)
    ids, n = word.encode_batch(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [word.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_spaces_between_runs():
    """Runs between single spaces are encoded by themselves; texts with other spaces as a whole."""
    parts = ["a", "it's", "x\n", "\n", "\ty", "9.5", "", "naïve,", "\r\n\n", "it", "s't"]
    texts = [" ".join(c) for n in (1, 2, 3) for c in itertools.product(parts, repeat=n)]
    want = Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)
    got = bpe.model(BYTE).encode_batch(pa.array(texts).slice(0)).to_pylist()
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in want]
    part = bpe.model(BYTE).encode_batch(pa.array(["skip", *texts[:50]]).slice(1)).to_pylist()
    assert part == got[:50] and len(bpe.model(BYTE).encode_batch(pa.array([], pa.string()))) == 0


def test_other_rules_are_refused(tmp_path):
    """A vocabulary with rules that the modules do not know raises, or is left to the library, instead of giving other ids."""
    for name, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})):
        spec = json.load(open(BYTE)) | {name: value}
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec))
        with pytest.raises(ValueError, match=name):
            bpe.model(str(path))
        texts = ["Ame\u0301lie  went", "a b", " x"]
        assert [x.tolist() for x in packing.encoder(str(path))(texts)] == [x.ids for x in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
    spec = json.load(open(WORD))
    spec["normalizer"]["normalizers"].pop()
    path = tmp_path / "word.json"
    path.write_text(json.dumps(spec))
    ids, n = token_files.tokenizer(str(path)).encode_batch(pa.array(["Hello World"]))
    assert ids.tolist() == Tokenizer.from_file(str(path)).encode("Hello World", add_special_tokens=False).ids


def test_encode_decode_rows(spark, byte):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = bpe.bpe_encode(df, "doc_id", "text", BYTE).collect()
    assert len(got) == df.count()
    want = sorted((r.doc_id is None, r.doc_id, np.array(byte.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in df.collect())
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.ids_le)) for r in got) == want
    back = bpe.bpe_decode(bpe.bpe_encode(df, "doc_id", "text", BYTE), "doc_id", "ids_le", BYTE).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    assert bpe.model(BYTE).decode(np.array([227])) == byte.decode([227], skip_special_tokens=False)


def test_op1_whole_table(spark, byte):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op1_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = byte.encode(d.text or "", add_special_tokens=False).ids
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (
            len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        )


def check_packed(got, docs, byte, capacity=1024):
    """Every id in one piece, pieces gapless in their sequences; gives the share of padding."""
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in docs:
        ids = np.array([*byte.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        pad += packing.padding(at, capacity)
    return pad / max(1, sum(r.length for r in got))


def test_op3_whole_table(spark, byte):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_packed(queries.op3_packing(spark, SF).collect(), docs, byte) < 0.02


def test_pack_odd_rows(spark, byte, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 3)
    docs = [(i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, length int, sequence_id int")
    placed = packing.pack(df, "doc_id", "text", BYTE, 64, 0)
    assert check_packed(placed.collect(), docs, byte, 64) < 0.05
    made = packing.sequences(df, "doc_id", "text", placed, BYTE, 64, 0, 50256).collect()
    assert sum(len([i for i in r.ids if i != 50256]) for r in made) + 3 >= sum(r.length for r in placed.collect())
    assert packing.pack(df.filter("false"), "doc_id", "text", BYTE).count() == 0
    twice = packing.pack(df.union(df), "doc_id", "text", BYTE, 64, 0)
    assert twice.count() == 2 * placed.count()
    packed = packing.pack(spark.createDataFrame(rows(), SCHEMA), "doc_id", "text", BYTE, 64, None).collect()
    assert any(r.doc_id is None for r in packed)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), min_size=1))
@settings(max_examples=100, deadline=None)
def test_fill_is_best(counts):
    """Against every reachable sum."""
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= 40}
    chosen = packing.best_fill(counts, 40, 24, 64)
    got = sum(k * v for k, v in chosen.items())
    assert all(v <= counts[k] for k, v in chosen.items()) and got in sums
    assert packing.padding(24 + got, 64) == min(packing.padding(24 + s, 64) for s in sums)


def test_op8_whole_table(spark):
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op8_token_files(spark, SF).collect()}
    start = 0
    for doc_id, text in docs:
        ids = np.array([*word.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[doc_id])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_split_words_as_the_pattern_does():
    plain = [c for c in map(chr, range(0x2100)) if re.match(token_files.PLAIN, c) and not c.isspace()]
    plain = sorted({c.lower() for c in plain if len(c.lower()) == 1})
    runs = ["", "it's", "'''s", "3.14", "a.,", "...", "don't.", "é.", "$$$", "x,y", *plain, *(f"a{c}" for c in plain), *(f"{c}." for c in plain), *(f"{c}'s{c}" for c in plain)]
    want = [regex.findall(token_files.WORD_PATTERN, r) for r in runs]
    assert [[w for w in x if w] for x in token_files.split_words(pa.array(runs)).to_pylist()] == want
    assert [[w for w in x if w] for x in token_files.split_words(pa.array(["skip", *runs]).slice(1)).to_pylist()] == want


def test_word_is_encoded_once_whatever_stands_beside_it(monkeypatch):
    tok, seen = token_files.WordTokenizer(WORD), []
    encode = tok.encode_words
    monkeypatch.setattr(tok, "encode_words", lambda words: [seen.extend(w for w in words if w), encode(words)][1])
    for t in ["Memory", "memory, and memory.", "and (memory)!", ""]:
        ids, n = tok.encode_batch(pa.array([t]))
        assert ids.tolist() == tok.whole.encode(t, add_special_tokens=False).ids and n.tolist() == [len(ids)]
    assert sorted(seen) == sorted({"memory", ",", "and", ".", "(", ")!"})


def test_token_files_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, "doc_id", "text", WORD, path, 1, shard_bytes=2000)
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(got) == df.count()
    for a, b in zip(got, got[1:], strict=False):
        assert b.start == a.start + a.n_tokens
    some = token_files.read_tokens(spark, path, 2, 4, ["doc_id", "n_tokens"])
    assert "PushedFilters: [IsNotNull(doc_id)" in some._jdf.queryExecution().toString() and "ids" not in some._jdf.queryExecution().toString().split("ReadSchema")[1]
    assert sorted(r.doc_id for r in some.collect()) == [2, 3, 3, 4]
    assert token_files.token_files(df.filter("false"), "doc_id", "text", WORD).count() == 0


def test_many_shards_and_a_hot_id(spark, tmp_path, monkeypatch):
    """Sums over blocks of shards, and an id whose rows fill several shards."""
    monkeypatch.setattr(token_files, "BLOCK", 3)
    df = spark.createDataFrame([(7 if i % 3 else i, f"text {i} " * 20) for i in range(300)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, "doc_id", "text", WORD, path, 1, shard_bytes=2000)
    files = token_files.read_tokens(spark, path)
    assert files.filter("doc_id = 7").select("shard").distinct().count() > 5 and files.select("shard").distinct().count() > 10
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in df.collect())
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0


def test_pack_copies_of_one_row(spark, byte):
    """Equal rows under one id are packed a row each, and numbered in several groups."""
    df = spark.createDataFrame([(1, "the same text")] * 4000 + [(2, "another")] * 10, "doc_id long, text string").repartition(3)
    got = packing.pack(df, "doc_id", "text", BYTE, 64, 0).collect()
    assert len(got) == 4010 and len({(r.sequence_id, r.offset) for r in got}) == 4010
    pieces = spark.range(50).selectExpr("id % 5 + 1 as length", "id as tie", "'x' as _group", "id as _number")
    placed = packing.place(pieces, 8)
    assert placed.columns == ["length", "_group", "_number", "sequence_id", "offset"] and {r._group for r in placed.collect()} == {"x"}


def test_token_file_encodings(spark, tmp_path):
    """Dictionary pages for ids, delta encoding for metadata, page indexes for both."""
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", WORD, path)
    group = max((pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")), key=lambda m: m.num_rows).row_group(0)
    by = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(v for k, v in by.items() if k.startswith("ids."))
    assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in by["doc_id"].encodings
    assert ids.has_offset_index and by["doc_id"].has_offset_index and by["doc_id"].has_column_index
