"""Embedding: a deterministic hashed bag of words, and a plug-in point for real models."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Words of a slice that is hashed at once.
SLICE_WORDS = 1 << 18


@functools.lru_cache(1 << 16)
def digest_slots(word: str, dimensions: int) -> tuple[int, int]:
    """The two dimensions of a word: eight hex digits of its digest each."""
    digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dimensions, int(digest[8:16], 16) % dimensions


def hashed(words: pa.Array, dimensions: int) -> np.ndarray:
    """A row a list of words: 1 is added to one dimension of each word's hash and 0.5 to another; unit length, or zero without words."""
    rows = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    coded = pc.list_flatten(words).dictionary_encode()
    slots = np.array([digest_slots(w, dimensions) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
    out = sum(np.bincount(rows * dimensions + slots[:, i], np.full(len(rows), w), len(words) * dimensions) for i, w in enumerate((1.0, 0.5)))
    out = out.reshape(len(words), dimensions).astype(float)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def sliced(words: pa.Array, most: int = SLICE_WORDS) -> Iterator[pa.Array]:
    """Rows in slices of at most ``most`` words, or of one row that has more: what hashing holds does not follow the length of texts."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield words.slice(at, end - at)
        at = end


def hash_embed(df: DataFrame, keys: list[str], text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(keys, embedding): each word adds 1 to one dimension of its hash and 0.5 to another; unit length, or zero without words.

    Weights are multiples of a half, so sums are exact in any order. Words are found in SQL and counted into their slots
    a batch at a time; nothing is shuffled, and each distinct word of a batch is hashed once.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            made = np.concatenate([hashed(part, dimensions) for part in sliced(words)] or [np.zeros((0, dimensions))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, dimensions, np.int32)), pa.array(made.ravel()))

    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return df.select(*keys, run(words).alias("embedding"))


def model_embed(df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray], dimensions: int, batch: int = 128) -> DataFrame:
    """``df`` with column ``embedding`` from a callable on lists of texts, in Arrow batches; a wrong shape is an error."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [np.zeros((0, dimensions))]
            for i in range(0, len(texts), batch):
                own = ["" if t is None else t for t in texts.slice(i, batch).to_pylist()]
                got = np.asarray(embed(own), float)
                if got.shape != (len(own), dimensions):
                    raise ValueError(f"the model returned {got.shape}, not {(len(own), dimensions)}")
                parts.append(got)
            made = np.concatenate(parts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, dimensions, np.int32)), pa.array(made.ravel()))

    return df.withColumn("embedding", run(F.col(text_col)))


def ordered(reply: list[dict], n: int) -> list[list[float]]:
    """The vectors of a provider's reply in the order of what was asked: by ``index`` where it says one, else as they come.

    A reply with another number of vectors, or whose numbers are not those from 0 on, is an error.
    """
    if len(reply) != n:
        raise ValueError(f"asked for {n} embeddings, got {len(reply)}")
    rows = sorted((entry.get("index", i), i) for i, entry in enumerate(reply))
    if [at for at, _ in rows] != list(range(n)):
        raise ValueError("the embeddings are not numbered from 0 on, each once")
    return [[float(x) for x in reply[i]["embedding"]] for _, i in rows]


def remote_embed(df: DataFrame, text_col: str, post: Callable[[list[str]], list[dict]], dimensions: int, batch: int = 128, attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """``df`` with ``embedding`` from a provider: ``post`` sends a list of texts and gives entries {index, embedding} in any order.

    Lost connections and statuses that may pass are tried again; a reply that does not fit what was asked stops the job.
    """
    from .ingest import patiently

    def embed(texts: list[str]) -> np.ndarray:
        return np.asarray(ordered(patiently(lambda: post(texts), attempts, wait), len(texts)), float)

    return model_embed(df, text_col, embed, dimensions, batch)


def other_pins(collections: DataFrame, model: str, dimensions: int) -> DataFrame:
    """(model, dimensions, collections) of the pins that do not fit a model."""
    other = collections.filter(~(F.col("model").eqNullSafe(model) & F.col("dimensions").eqNullSafe(dimensions)))
    return other.groupBy("model", "dimensions").agg(F.count("*").alias("collections"))


def check_pins(collections: DataFrame, model: str, dimensions: int) -> None:
    """Refuse to go on if any collection was embedded by another model or width. Distinct pins are few."""
    other = collections.select("model", "dimensions").distinct().filter((F.col("model") != model) | (F.col("dimensions") != dimensions)).take(1)
    if other:
        raise ValueError(f"a collection is pinned to {other[0].model} with {other[0].dimensions} dimensions, not {model} with {dimensions}: reindex first")
