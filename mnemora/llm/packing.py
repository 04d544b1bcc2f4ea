"""Operator 3: sequence packing by minimum bin slack.

A document is cut into windows of the capacity; what remains of it is a piece of less. How often
each remaining length occurs is a table of at most ``capacity`` rows, so the plan is made on the
driver from counts alone, whatever the corpus size: each window starts with the longest length
left, a bitset subset-sum over the multiset of the others finds the fill closest to capacity, the
counts are backtracked from the bitsets, and the pattern is repeated as often as the counts allow.
Executors then number the pieces of each length and look their places up.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PATTERN, PLAIN, byte_symbols, check_spec
from .common import materialise, slices, unused

#: Pieces of one length are numbered in groups of at least so many, and there are at most so many more groups than lengths.
GROUP_PIECES, MORE_GROUPS = 1_000, 8_192


@functools.lru_cache(4)
def encoder(path: str):
    """A function from texts to lists of ids, equal to the vocabulary file's own tokenizer.

    Plain text goes through tiktoken, which applies the same ranks several times faster; text with
    added-token strings or rare characters goes through the tokenizers library itself, and so does all text
    if the file asks for other rules than byte-level BPE whose ids ascend with the merges.
    """
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    vocab = whole.get_vocab(with_added_tokens=False)
    back = byte_symbols()
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token) and token not in added}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if same_rules(path) else None

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if fast and PLAIN.fullmatch(text) and not any(a in text for a in added):
                out.append(fast.encode_to_numpy(text, disallowed_special=()).astype("<u4"))
            else:
                out.append(np.array(whole.encode(text, add_special_tokens=False).ids, "<u4"))
        return out

    return encode


def same_rules(path: str) -> bool:
    """Whether a vocabulary file is byte-level BPE with the known pattern, and its ids are the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    try:
        check_spec(spec, path)
    except ValueError:
        return False
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
    return made == sorted(made) and len(set(made)) == len(made) and all(vocab[c] < made[0] for c in byte_symbols() if made)


def padding(filled: int, capacity: int) -> int:
    """Pad ids of a sequence: up to capacity, none where its length is a power of two."""
    return 0 if filled & (filled - 1) == 0 else capacity - filled


def best_fill(counts: dict[int, int], room: int, base: int, capacity: int) -> dict[int, int]:
    """The multiset of available lengths, summing to at most ``room``, that leaves ``base + sum`` the least padding.

    Bounded subset-sum over a bitset: bit s of a stage is set if the lengths so far can sum to s.
    A length's copies enter in doubling groups. The stages are kept and walked backwards to recover counts.
    """
    stages: list[tuple[int, int, int]] = []  # (length, copies, bits before)
    bits, full = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            stages.append((length, take, bits))
            bits |= (bits << (length * take)) & full
            left -= take
            copies *= 2
        if bits >> room & 1:
            break
    if bits >> room & 1:
        best = room
    else:
        best = min((s for s in range(room + 1) if bits >> s & 1), key=lambda s: (padding(base + s, capacity), -s))
    chosen: dict[int, int] = {}
    for length, take, earlier in reversed(stages):
        if not earlier >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, first sequence, copies in a sequence, first offset) placing every piece.

    Piece number r (from 0) of a length belongs to the row with the largest first number up to r; it
    lies in sequence first_sequence + (r - first) // copies, at first_offset + (r - first) % copies * length.
    Each pattern is repeated until one of its lengths runs short, so there are few patterns for any corpus.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = best_fill({k: v for k, v in left.items() if v}, capacity - longest, longest, capacity)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(left[k] // v for k, v in pattern.items()), 0
        for k in sorted(pattern, reverse=True):
            rows.append((k, used[k], sequence, pattern[k], offset))
            offset += k * pattern[k]
            used[k] += pattern[k] * times
            left[k] -= pattern[k] * times
            if not left[k]:
                del left[k]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int | None) -> DataFrame:
    """Pieces of every document: (id, start, length, doc_tokens, ids_le, nth), windows first, then the rest; ``nth`` counts a task's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth = encoder(vocabulary), 0
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                rows, starts, lengths, totals, ids = [], [], [], [], []
                for i, own in enumerate(encode(texts)):
                    own = np.concatenate([own, tail])
                    for at in range(0, len(own), capacity):
                        piece = own[at : at + capacity]
                        rows.append(first + i)
                        starts.append(at)
                        lengths.append(len(piece))
                        totals.append(len(own))
                        ids.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.arange(nth, nth + len(rows)))],
                    ["id", "start", "length", "doc_tokens", "ids_le", "nth"],
                )
                nth += len(rows)

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, ids_le binary, nth long")
    return out.withColumnRenamed("id", id_col)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (any table with a ``length`` of 1 to capacity and a column ``tie``, which goes) with sequence_id and offset.

    Two small facts reach the driver, both bounded: how many pieces each length has (at most
    ``capacity`` rows) and how many each numbering group has (that, plus MORE_GROUPS). A common
    length is dealt over groups by hash, so no task numbers all of it.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    most = max(GROUP_PIECES, sum(counts.values()) // MORE_GROUPS)
    deal = [max(1, -(-counts.get(n, 0) // most)) for n in range(capacity + 1)]
    dealt = F.element_at(F.array(*map(F.lit, deal)), F.col("length").cast("int") + 1)
    group, number = unused(pieces, "group"), unused(pieces, "number")
    pieces = pieces.withColumn(group, F.pmod(F.xxhash64("tie"), dealt).cast("int"))
    base: dict[tuple[int, int], int] = {}
    running: dict[int, int] = {}
    for length, g, n in sorted(tuple(r) for r in pieces.groupBy("length", group).count().collect()):
        base[length, g] = running.get(length, 0)
        running[length] = base[length, g] + n
    rows = spark.sparkContext.broadcast((plan(counts, capacity), base))
    order = Window.partitionBy("length", group).orderBy("tie")
    numbered = pieces.withColumn(number, F.row_number().over(order) - 1)
    others = [c for c in numbered.columns if c not in (group, number, "tie", "sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start = rows.value
        first = {n: i for i, n in reversed(list(enumerate(table[:, 0].tolist())))}
        last = {n: i + 1 for i, n in enumerate(table[:, 0].tolist())}
        for batch in batches:
            length, own_group, nth = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", group, number))
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            nth = nth + np.fromiter((start[k] for k in zip(length.tolist(), own_group.tolist(), strict=True)), np.int64, len(batch))
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                part = table[first[n] : last[n]]
                at = part[np.searchsorted(part[:, 1], nth[own], "right") - 1]
                within = nth[own] - at[:, 1]
                sequence[own] = at[:, 2] + within // at[:, 3]
                offset[own] = at[:, 4] + within % at[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sequence), pa.array(offset)], [*others, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name in others)
    return numbered.drop("tie").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = 1024, end_id: int | None = 0) -> DataFrame:
    """Where every piece of every document lies: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null text counts as empty and gives the end id alone (nothing, if there is none). Null and
    repeated ids are kept, each row packed by itself; other columns are not carried; an empty table
    gives an empty result. Texts are tokenised once: the cut is kept in the shared folder without
    its ids, and ``sequences`` makes them again where they are wanted.
    """
    pieces = cut(df, id_col, text_col, vocabulary, capacity, end_id).withColumn("ids_crc32", F.crc32("ids_le")).drop("ids_le")
    pieces = materialise(pieces.select(F.col(id_col).alias("_id"), "start", "length", "ids_crc32", "doc_tokens", "nth"), "pieces")
    placed = place(pieces.withColumn("tie", F.struct("_id", "start", "ids_crc32", "nth")).drop("nth"), capacity)
    return placed.withColumnRenamed("_id", id_col)


def sequences(df: DataFrame, id_col: str, text_col: str, placed: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int | None = 0, pad_id: int = 0) -> DataFrame:
    """The packed training sequences themselves: (sequence_id, ids array<int>), padded as ``padding`` says.

    ``df`` must have no repeated ids; each sequence gathers at most ``capacity`` pieces.
    """
    pieces = cut(df, id_col, text_col, vocabulary, capacity, end_id).select(id_col, "start", "ids_le")
    joined = placed.select(id_col, "start", "sequence_id", "offset").join(pieces, [id_col, "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids_le"] for p in parts), "<u4").astype(np.int32)
                out.append(np.concatenate([ids, np.full(padding(len(ids), capacity), pad_id, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    gathered = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids_le"))).alias("parts"))
    return gathered.mapInArrow(run, "sequence_id long, ids array<int>")
