"""Operator 9: language identification by string kernels.

A text is the set of its letter n-grams of every length up to ORDER (presence, not counts). The
blended-spectrum kernel of two texts is the number of n-grams they share, normalised to 1 for a text
with itself. Kernel ridge regression, one language against the rest, is fitted in the space of
Nystroem landmarks. A batch is scored by a sparse matrix product: because the kernel is linear in presence, the
landmarks' presence and weights are multiplied once, and a text's scores are the sum of its n-grams' rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ORDER = 4
#: Hash buckets of n-grams (2**BUCKET_BITS): the longest natural texts fill some tenths of them.
BUCKET_BITS = 17
#: The fit's documented bounds: training texts and landmarks a language.
TRAIN_ROWS = 400
LANDMARKS = 64
RIDGE = 1e-3
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows of n-gram presence: all texts' buckets, ascending and without repeats in each text, and how many each has.

    Runs of other characters than letters count as one space; a text without letters has no n-grams.
    """
    is_letter, shift = letters(), np.uint32(32 - BUCKET_BITS)
    here = np.zeros(1 << BUCKET_BITS, bool)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        word = is_letter[code]
        if not word.any():
            continue
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] = True
        code = np.where(word, code, 32)[keep] * np.uint32(0x9E3779B1)
        mixed = code
        for n in range(1, ORDER + 1):
            if n > 1:
                if len(mixed) < 2:
                    break
                mixed = mixed[:-1] * np.uint32(0x01000193) + code[n - 1 :]
            spread = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            here[spread >> shift] = True
        found = np.flatnonzero(here)
        here[found] = False
        sizes[row] = len(found)
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.int64), sizes


@dataclass(frozen=True)
class LanguageModel:
    """The landmarks (packed presence), a weight a landmark and language, and their product: a row of ``table`` a bucket."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    @functools.cached_property
    def table(self) -> np.ndarray:
        out = np.zeros((1 << BUCKET_BITS, len(self.languages)))
        for bits, weight in zip(self.landmarks, self.weights, strict=True):
            own = np.flatnonzero(np.unpackbits(bits))
            out[own] += weight / np.sqrt(max(1, len(own)))
        return out

    def score(self, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One-versus-rest outputs of a batch of sparse rows: near 1 for the language, near 0 for others; 0 without n-grams."""
        out = np.zeros((len(sizes), len(self.languages)))
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = np.add.reduceat(self.table[buckets], starts, axis=0) / np.sqrt(sizes[some])[:, None]
        return out


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """About ``rows`` labelled texts a language by hash of their ids, all of a rarer one's: (lang, text, h).

    How common each language is comes from one count with partial sums, so no task ever gathers a language. That
    table has a row a language, far less than the model holds of each, and is broadcast: texts are not shuffled.
    """
    buckets = 1 << 40
    hashed = df.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    share = hashed.groupBy("lang").agg((F.lit(rows) / F.count("*") * buckets).cast("long").alias("limit"))
    return hashed.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(buckets)) < F.col("limit")).select("lang", "text", F.pmod("h", F.lit(buckets)).alias("h"))


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on a bounded sample; the texts are turned into packed presence rows by the executors.

    Rows without text, letters, label or id teach nothing. Without any row the model knows no language.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                buckets, sizes = presence(texts)
                packed = []
                for own in np.split(buckets, np.cumsum(sizes)[:-1]):
                    bits = np.zeros(1 << BUCKET_BITS, bool)
                    bits[own] = True
                    packed.append(np.packbits(bits).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), pa.array(packed, pa.binary())], ["lang", "h", "bits"])

    taken = sample(df, id_col, text_col, lang_col, rows).mapInArrow(features, "lang string, h long, bits binary")
    got = sorted((r.lang, r.h, bytes(r.bits)) for r in taken.filter("bits is not null").collect())
    languages = tuple(sorted({x[0] for x in got}))
    if not languages:
        return LanguageModel((), np.zeros((0, 1 << BUCKET_BITS - 3), np.uint8), np.zeros((0, 0)))
    bits = np.frombuffer(b"".join(x[2] for x in got), np.uint8).reshape(len(got), -1)
    label = np.array([languages.index(x[0]) for x in got])
    first = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(languages))])
    words, size = bits.view(np.uint64), np.bitwise_count(bits.view(np.uint64)).sum(1, dtype=np.int64)
    shared = np.stack([np.bitwise_count(words & words[i]).sum(1, dtype=np.int64) for i in first.tolist()], 1)
    kernel = shared / np.sqrt(size[:, None] * size[None, first])
    value, vector = np.linalg.eigh(kernel[first])
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    mapped = kernel @ root
    wanted = (label[:, None] == np.arange(len(languages))).astype(np.float64)
    share = 1 / np.bincount(label, minlength=len(languages))[label]  # languages weigh the same
    gram = mapped.T @ (mapped * share[:, None]) + RIDGE * np.eye(len(first))
    weights = root @ np.linalg.solve(gram, mapped.T @ (wanted * share[:, None]))
    return LanguageModel(languages, bits[first], weights)


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its score between 0 and 1."""
    return judged(model, texts)[:2]


def judged(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, its score between 0 and 1, and how many n-grams that rests on."""
    buckets, sizes = presence(texts)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), sizes
    got = model.score(buckets, sizes)
    best = got.argmax(1)
    label = [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
    return label, np.where(sizes > 0, np.clip(got[np.arange(len(texts)), best], 0, 1), 0.0), sizes


def identify(df: DataFrame, text_col: str, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1) of every row, from the whole text alone.

    ``und`` with score 0 where text is null or has no letters, or the model knows no language. The
    kept columns' own names do not matter. A narrow stage: a batch is scored by matrix products.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(0)):
                label, score = predict(shared.value, texts)
                kept = [batch.column(i + 1).slice(first, len(texts)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(label), pa.array(score)], [*names, "lang_pred", "score"])

    chosen = df.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    schema = "".join(f"{n} {chosen.schema[n].dataType.simpleString()}, " for n in names)
    out = chosen.mapInArrow(run, f"{schema}lang_pred string, score double")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "lang_pred", "score")


def keep_identified(df: DataFrame, text_col: str, model: LanguageModel, least: float, few: int = 0, least_of_few: float = 0.0) -> DataFrame:
    """``df`` without the rows whose language is unknown or predicted with a score below ``least``; columns stay as they are, whatever their names.

    A text of fewer than ``few`` n-grams, from which no score is sure, goes only below ``least_of_few``. Only the texts go to
    Python, and a yes or no comes back.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [judged(shared.value, texts) for _, texts in slices(column)]
            yield pa.array([x != UNKNOWN and s >= (least if n >= few else least_of_few) for label, score, sizes in parts for x, s, n in zip(label, score.tolist(), sizes.tolist(), strict=True)], pa.bool_())

    return df.filter(known(F.col(text_col).cast("string")))
