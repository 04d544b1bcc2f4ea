"""Operator 1: byte-level BPE encoding and decoding over a pair occurrence index.

The pretokens of a batch of documents are reduced to the distinct ones, laid out in one flat
symbol sequence, and every adjacent pair is mapped to all its positions in it. The active merge
ranks are then taken in ascending order; each is applied to all its positions at once and the lists
of the pairs that it touches are updated. A document's ids are its pretokens' ids, concatenated.

No pretoken crosses a single space but for the one that it starts with, so plain texts are cut at spaces into
runs inside Arrow, and Python sees each distinct run of a batch once.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import SLICE_CHARS, Recent, gather, text_slices

#: Distinct pretokens, and runs between spaces, that a Python worker keeps (about 200 bytes each).
CACHE_WORDS, CACHE_RUNS = 400_000, 150_000

#: A pair's key is left << SHIFT | right; symbols from WALL on are no ids.
SHIFT, WALL, GONE = 20, 1 << 19, (1 << 19) + 1

#: The public byte-level pretoken pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on which this module's pattern library and the tokenizer's own surely agree.
PLAIN_TEXT = r"[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*"
PLAIN = regex.compile(PLAIN_TEXT)
#: Spaces that do not stand alone between two runs.
SPACED = "^ |  | $"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexBPE:
    """A byte-level BPE vocabulary file, applied by pair occurrence index."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec, path)
        vocab, of_byte = spec["model"]["vocab"], byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first = np.zeros(256, np.int64)
        for shown, b in of_byte.items():
            self.first[b] = vocab[shown]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank_of = {a << SHIFT | b: rank for rank, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.keys = np.array(sorted(self.rank_of), np.int64)
        self.ranks = np.array([self.rank_of[k] for k in self.keys.tolist()], np.int64)
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for shown, i in vocab.items():
            self.tokens[i] = bytes(of_byte[c] for c in shown)
        for text, i in self.added.items():
            self.tokens[i] = text.encode()
        self.find = regex.compile(PATTERN).findall
        self.exotic = Tokenizer.from_file(path).pre_tokenizer
        self.words, self.runs = Recent(CACHE_WORDS), Recent(CACHE_RUNS)
        self.sizes = np.array([*map(len, self.tokens), 0], np.int32)
        self.bytes, self.starts = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def pretokens(self, text: str) -> list[str]:
        """Pretokens; where Unicode versions may differ, those of the tokenizer library itself."""
        if PLAIN.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self._with_offsets(text)]

    def _with_offsets(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.exotic.pre_tokenize_str(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as packed little-endian unsigned 32-bit integers.

        Symbols lie in one flat sequence, a wall before each word and at the end; ``before`` and
        ``after`` link those that are left. ``index`` has the positions of each rank's pair.
        """
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.full(int(lengths.sum()) + len(raw) + 1, WALL, np.int64)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(np.concatenate([[0], lengths + 1]))] = False
        flat[inside] = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        keys = flat[:-1] << SHIFT | flat[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == keys)
        ranks = self.ranks[at[hits]]
        order = np.argsort(ranks, kind="stable")
        active, starts = np.unique(ranks[order], return_index=True)
        index: dict[int, list[int]] = dict(zip(active.tolist(), (x.tolist() for x in np.split(hits[order], starts[1:])), strict=True)) if len(hits) else {}
        heap, symbol, get = active.tolist(), flat.tolist(), self.rank_of.get
        before, after = list(range(-1, len(symbol) - 1)), list(range(1, len(symbol) + 1))
        while heap:
            rank = heapq.heappop(heap)
            left, right, made = self.merges[rank]
            places = index.pop(rank)
            if left == right:
                places.sort()  # only then can occurrences overlap: the leftmost goes first
            ahead = made << SHIFT
            for i in places:
                j = after[i]
                if symbol[i] != left or symbol[j] != right:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = made, GONE
                k = after[j]
                after[i], before[k] = k, i
                if (r := get(ahead | symbol[k])) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(heap, r)
                h = before[i]
                if (r := get(symbol[h] << SHIFT | made)) is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(heap, r)
        flat = np.array(symbol, np.int64)
        ids = flat < WALL
        ends = np.cumsum(ids)[np.flatnonzero(flat == WALL)] * 4
        packed, ends = flat[ids].astype("<u4").tobytes(), ends.tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode_pieces(self, pieces: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of pretokens."""
        self.words.fetch(list({w for own in pieces for w in own}), self.encode_words)
        get = self.words.young.__getitem__
        return [get(own[0]) if len(own) == 1 else b"".join(map(get, own)) for own in pieces]

    def encode_odd(self, text: str) -> bytes:
        """Packed ids of any text; strings of added tokens become their single ids."""
        pieces = self.split.split(text) if self.split else [text]
        found = iter(self.encode_pieces([self.pretokens(p) for p in pieces if p and p not in self.added]))
        return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else next(found) for p in pieces if p)

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        plain = pc.and_(pc.match_substring_regex(texts, f"^{PLAIN_TEXT}$"), pc.invert(pc.match_substring_regex(texts, SPACED)))
        for a in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, a)))
        split = pc.split_pattern(pc.if_else(plain, texts, ""), " ")
        coded, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy() - split.offsets[0].as_py()
        number, runs = coded.indices.to_numpy(zero_copy_only=False).copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = number[offsets[:-1]]  # a text's first run has no space before it
        rest = np.ones(len(number), bool)
        rest[offsets[:-1]] = False
        used = np.zeros(len(runs), bool)
        used[number[rest]] = True
        first, place = np.unique(heads, return_inverse=True)
        own = self.runs.fetch([r for r, u in zip(runs, used.tolist(), strict=False) if u], lambda fresh: self.encode_pieces([self.find(f" {r}") for r in fresh]))
        own += self.encode_pieces([self.find(runs[i]) for i in first.tolist()])
        number = (np.cumsum(used) - 1)[number]
        number[offsets[:-1]] = used.sum() + place
        ids, ends = gather(own, number)
        stops = ends[offsets]
        if (odd := np.flatnonzero(~plain.to_numpy(zero_copy_only=False))).size:
            parts = [ids[a:b].tobytes() for a, b in zip(stops, stops[1:], strict=False)]
            for i in odd.tolist():
                parts[i] = self.encode_odd(texts[i].as_py())
            return pa.array(parts, pa.binary())
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((stops * 4).astype(np.int32)), pa.py_buffer(ids)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        tokens, top = self.tokens, len(self.tokens)
        return b"".join([tokens[i] for i in ids.tolist() if i < top]).decode("utf-8", "replace")

    def decode_batch(self, packed: pa.Array) -> pa.Array:
        """``decode`` of a column of packed ids; null stays null. Bytes of whole slices are laid out at once and used as they are if they are UTF-8."""
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(packed), 0).to_numpy(zero_copy_only=False))]) // 4
        ids = np.minimum(np.frombuffer(b"".join(pc.fill_null(packed, b"").to_pylist()), "<u4"), len(self.tokens)).astype(np.int64)
        n = self.sizes[ids]
        stops = np.concatenate([[0], np.cumsum(n, dtype=np.int32)])
        places = np.repeat(self.starts[ids] - stops[:-1].astype(np.int32), n)
        places += np.arange(stops[-1], dtype=np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(stops[ends].astype(np.int32)), pa.py_buffer(self.bytes[places])])
        try:
            texts = made.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([self.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())
        return pc.if_else(pc.is_valid(packed), texts, None)


def check_spec(spec: dict, path: str) -> None:
    """Refuse vocabulary files that ask for other rules than this module's: ids would be wrong without a sign."""
    own = {"normalizer": None, "pre_tokenizer.type": "ByteLevel", "pre_tokenizer.add_prefix_space": False, "pre_tokenizer.use_regex": True, "post_processor": None, "model.type": "BPE"}
    own |= {f"model.{k}": None for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")} | {f"model.{k}": False for k in ("byte_fallback", "ignore_merges")}
    for name, want in own.items():
        at = spec
        for part in name.split("."):
            at = (at or {}).get(part)
        if (at or None) != (want or None):
            raise ValueError(f"{path}: {name} is {at!r}; only {want!r} is known here")
    for token in spec["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"{path}: the added token {token['content']!r} has rules that are not known here")


@functools.lru_cache(4)
def model(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def bpe_encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(id, ids_le): each text's token ids as packed little-endian unsigned 32-bit integers.

    Null text counts as empty and gives no ids; null and repeated ids are kept as they are, a row
    each; other columns are not carried, so their names cannot clash. One narrow stage, no shuffle:
    memory is bounded by a slice of texts, its distinct pretokens, and the pretoken cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in batches:
            for first, rows in text_slices(batch.column(1), 2048, 2_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), bpe.encode_batch(batch.column(1).slice(first, rows))], ["id", "ids_le"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids_le binary")
    return out.withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, id_col: str, ids_col: str, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """(id, [ids_le,] text): the text of packed ids. Null ids give null; an empty sequence the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in batches:
            for first, rows in text_slices(batch.column(1), most_bytes=4 * SLICE_CHARS):
                part = batch.slice(first, rows)
                texts = bpe.decode_batch(part.column(1))
                own = [part.column(0), part.column(1)] if keep_ids else [part.column(0)]
                yield pa.RecordBatch.from_arrays([*own, texts], ["id", *(["ids_le"] if keep_ids else []), "text"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids_le"))
    out = out.mapInArrow(run, f"id {kind}, {'ids_le binary, ' if keep_ids else ''}text string")
    return out.withColumnRenamed("id", id_col)


def n_ids(packed: Column) -> Column:
    """Number of ids in a packed column."""
    return (F.octet_length(packed) / 4).cast("long")
