"""Operator 8: token ids in Parquet list columns.

Documents are dealt to shards by ranges of their id, sorted, encoded and written one file a shard.
Ids are dictionary-encoded (bit-packed to the vocabulary's width); row metadata is delta-encoded;
row groups and pages have set sizes, and page indexes let a reader fetch the tokens or the metadata
of a range of documents without the rest.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import Recent, fresh_path, gather, lay, materialise, text_slices

#: Bytes of text meant for one shard, and so one file.
SHARD_BYTES = 48_000_000
#: Distinct words that a Python worker keeps (about 200 bytes each).
CACHE_WORDS = 300_000
#: Shards whose sizes one task adds up.
BLOCK = 1024

#: Characters whose lower case, normal form and class do not depend on their neighbours.
PLAIN = r"^[\t\n\r\x20-\x7e¡-įı-ɏ‐-‧€]*$"
#: The public word pattern of this kind of vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The rules by which a vocabulary file of this kind prepares a text.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: Ids by dictionary pages, metadata by delta encoding; sizes of row groups and pages.
FILE_FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


class WordTokenizer:
    """A word-level BPE vocabulary file. No token crosses white space, and the runs between it are split into words
    that repeat, so the library encodes each distinct word once. A file with other rules is left to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core already
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.shown = {b: c for c, b in byte_symbols().items()}
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = all(spec.get(k) == v for k, v in RULES.items())
        self.words = Recent(CACHE_WORDS)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words that are normalised and split already, so the library's model alone is wanted."""
        tokenize = self.model.tokenize
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in words]
        return [array("i", [t.id for t in tokenize(w)]).tobytes() if w else b"" for w in shown]

    def encode_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, n): where in ``ids`` those of each run begin, and how many they are. Runs are distinct, of plain
        lower-case text without white space; Python sees each distinct word of theirs once.
        """
        words = split_words(runs)
        coded = words.flatten().dictionary_encode()
        own = self.words.fetch(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.encode_words)
        ids, ends = gather(own, coded.indices.to_numpy(zero_copy_only=False))
        stops = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return ids, stops[:-1], np.diff(stops)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many of each text): as the library gives them with add_special_tokens=False; null counts as empty.

        Plain texts are lowered, split and reduced to distinct runs, and these to distinct words, inside Arrow.
        """
        texts = pc.fill_null(texts, "")
        plain = pc.match_substring_regex(texts, PLAIN) if self.known else pc.is_null(texts)
        for a in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, a)))
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(plain, texts, "")))
        coded = split.flatten().dictionary_encode()
        ids, ends = lay(*self.encode_runs(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        ids = ids.view("<i4")
        stops = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if (odd := np.flatnonzero(~plain.to_numpy(zero_copy_only=False))).size:
            parts = [ids[a:b] for a, b in zip(stops, stops[1:], strict=False)]
            for i in odd.tolist():
                parts[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<i4")
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, np.diff(stops).astype(np.int64)


def split_words(runs: pa.Array) -> pa.ListArray:
    """The words of runs of plain lower-case text, as WORD_PATTERN splits them. Most runs are a word, or a word and a stop, and
    are told by their characters' classes; the others go through the pattern.
    """
    word, head, last = pc.utf8_is_alpha(runs), pc.utf8_slice_codeunits(runs, 0, -1), pc.utf8_slice_codeunits(runs, -1)
    stopped = pc.and_(pc.utf8_is_alpha(head), pc.is_in(last, pa.array([".", ","], runs.type)))
    other = pc.invert(pc.or_(word, stopped))
    spaced = pc.if_else(word, runs, pc.binary_join_element_wise(head, last, pa.scalar(" ", runs.type)))
    spaced = pc.replace_with_mask(spaced, other, pc.replace_substring_regex(runs.filter(other), WORD_PATTERN, r"\0 "))
    return pc.utf8_split_whitespace(spaced)


@functools.lru_cache(4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str, path: str, end_id: int | None = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text and write (shard, shard_start, doc_id, n_tokens, ids) to ``path``, in ascending doc_id order.

    Null text counts as empty (the end id alone). Null ids come first; rows that repeat an id lie
    next to each other, ordered by a hash of their texts, also where they fill more than a shard. Other columns are not
    carried. An empty table gives a folder without rows. ``shard_start`` counts the ids before a row in its shard.
    Shards are ranges of ids, found by Spark's own range partitioning: bounds are sampled, one a shard.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = max(1, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, start = tokenizer(vocabulary), 0
        extra = end_id is not None
        for batch in batches:
            for first, rows in text_slices(batch.column(2), 8192, 4_000_000):
                ids, n = tok.encode_batch(batch.column(2).slice(first, rows))
                n = n + extra
                stops = np.concatenate([[0], np.cumsum(n)])
                if extra:
                    last = np.zeros(stops[-1], bool)
                    last[stops[1:] - 1] = True
                    whole = np.full(stops[-1], end_id, np.int32)
                    whole[~last] = ids
                    ids = whole
                column = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(start + stops[:-1]), batch.column(1).slice(first, rows), pa.array(n), column], ["shard", "shard_start", "doc_id", "n_tokens", "ids"])
                start += int(stops[-1])

    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie")
    ordered = dealt.sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    out = ordered.mapInArrow(encode, "shard int, shard_start long, doc_id long, n_tokens long, ids array<int>")
    out.write.options(**FILE_FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of the files, by document range and columns; both reach the Parquet reader."""
    schema = "shard int, shard_start long, doc_id long, n_tokens long, ids array<int>"
    rows = spark.read.schema(schema).parquet(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.select(*columns) if columns else rows


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    A shard's first id comes from a sum over metadata columns only: one row a shard, running sums over BLOCK shards
    each, and one over the blocks.
    """
    rows = read_tokens(spark, path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    totals = materialise(totals.withColumn("block", F.floor(F.col("shard") / BLOCK)), "shards")
    blocks = totals.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
    before = totals.withColumn("within", within).join(blocks, "block").select(F.col("shard").alias("of"), (F.col("base") + F.col("within")).alias("shard_base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            ends = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], ["shard", "shard_start", "doc_id", "n_tokens", "ids_crc32"])

    checked = rows.mapInArrow(run, "shard int, shard_start long, doc_id long, n_tokens long, ids_crc32 long")
    joined = checked.join(before, checked["shard"] == before["of"])
    return joined.select("doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, id_col: str, text_col: str, vocabulary: str, path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """``write_tokens`` to a path (a new one in the shared folder, if not given), then ``token_index`` of it."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_tokens(df, id_col, text_col, vocabulary, path, end_id)
    return token_index(spark, path)
