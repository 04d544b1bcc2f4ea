"""Phrase collocations from position bitmaps, in the manner of SPAM.

Words are cut into shards of some SHARD positions. In a shard every word has a compressed bitmap of its positions: the
bytes, of 8 positions each, that are not empty. A phrase is extended by shifting its bitmap by one position and ANDing it
with the bitmaps of all words; what is not empty is a longer phrase, and its popcount its number of places. Phrases are
extended depth first, from some first words at a time, so memory is bounded by the shard. A position is left out between
pieces, so no shift crosses their boundary. Popcounts are summed over shards by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SIEVE_BITS, SIEVE_ROW, materialise
from .letters import LOWER, joined, pieces, strings

#: Words of a shard, and bitmap bytes from which phrases are extended at a time.
SHARD, ROOTS = 1 << 17, 1 << 15
#: What parts the words of a piece, and what parts pieces.
BLANK, STOPS = " \t", ".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANK.encode())] = 1
_KIND[list(STOPS.encode())] = 2
_WORD = _KIND == 0


class Shard:
    """Words in order: ``words`` (strings), ``lang`` (numbers) and ``gap`` (another piece begins here), of which phrases begin in the first ``cut``."""

    def __init__(self, parts: list[tuple[pa.Array, np.ndarray, np.ndarray]], ahead: int) -> None:
        self.words = pa.concat_arrays([p[0] for p in parts])
        self.lang, self.gap = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        self.cut = len(self.words) - ahead

    def numbered(self, langs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """A number for each (lang, word) of the shard, and the languages and words that the numbers stand for."""
        coded = self.words.dictionary_encode()
        both = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * langs + self.lang
        seen = np.zeros(len(coded.dictionary) * langs, bool)
        seen[both] = True
        number, found = np.cumsum(seen) - 1, np.flatnonzero(seen)
        return number[both], found % langs, coded.dictionary.take(pa.array(found // langs))


def shards(batches: Iterator[pa.RecordBatch], langs: list[str], ahead: int) -> Iterator[Shard]:
    """The shards of batches (text, lang). A shard ends with up to ``ahead`` words that begin the next one, so that no phrase is lost between them. ``langs`` is filled."""
    held, size, known = [], 0, {}
    for batch in batches:
        names = [UNKNOWN if x is None else x for x in batch.column(1).to_pylist()]
        for name in names:
            if name not in known:
                known[name] = len(langs)
                langs.append(name)
        lang = np.array([known[x] for x in names], np.int64)
        for row, data, begins in joined(batch.column(0)):
            stops, last, before = 0, 0, -1  # stops seen up to the byte ``last``, and before the word before
            for starts, ends, flat in pieces(data, _WORD[data]):
                if not len(starts):
                    continue
                seen = np.flatnonzero(_KIND[data[last : ends[-1]]] == 2) + last
                place = stops + np.searchsorted(seen, starts)
                gap = np.diff(place, prepend=before) > 0
                stops, last, before = stops + len(seen), int(ends[-1]), int(place[-1])
                text = np.searchsorted(begins, starts, "right") - 1
                held.append((strings(ends - starts, LOWER[flat]), lang[row + text], gap))
                size += len(starts)
                if size >= SHARD:
                    yield (shard := Shard(held, ahead))
                    held = [(shard.words[shard.cut :], shard.lang[shard.cut :], shard.gap[shard.cut :])]
                    size = ahead
    if held:
        yield Shard(held, 0)


def turn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of a phrase with hash ``x`` and a further word with hash ``y``."""
    return (x << np.uint64(21) | x >> np.uint64(43)) ^ y


def phrase_hash(key: Column) -> Column:
    """``turn`` over the words' hashes, as a column."""
    return F.aggregate(key, F.lit(0).cast("long"), lambda x, y: F.shiftleft(x, 21).bitwiseOR(F.shiftrightunsigned(x, 43)).bitwiseXOR(y))


class Marks:
    """A Bloom filter of one hash over phrases, for Python workers: at most SIEVE_BITS / 8 bytes whatever the keys. It only saves work: what it lets through is counted exactly."""

    def __init__(self, keys: DataFrame, n: int) -> None:
        bits = min(SIEVE_BITS, max(SIEVE_ROW, 1 << (16 * n).bit_length()))
        at = phrase_hash(F.col("key")).bitwiseAND(F.lit(bits - 1))
        rows = keys.select(F.floor(at / SIEVE_ROW).cast("int").alias("row"), (at % SIEVE_ROW).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("map")).toArrow()
        whole = np.zeros((bits // SIEVE_ROW, SIEVE_ROW // 8), np.uint8)
        for row, bitmap in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            whole[row] = np.frombuffer(bitmap.as_buffer(), np.uint8)[: SIEVE_ROW // 8]
        self.bits, self.map = bits, whole.reshape(-1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Bitmaps:
    """The position bitmaps of a shard's words as entries (word, block, byte), and for every block the up to 8 words that have a bit there."""

    def __init__(self, word: np.ndarray, place: np.ndarray) -> None:
        n = int(place[-1] >> 3) + 2 if len(place) else 1
        both = np.sort(word << 32 | place)
        word, place = both >> 32, both & 0xFFFFFFFF
        block, bit = place >> 3, (1 << (place & 7)).astype(np.uint8)
        first = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.word, self.block = word[first], block[first]
        self.byte = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        both = np.sort(self.block << 32 | np.arange(len(self.block)))
        at, by_block = both >> 32, both & 0xFFFFFFFF
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        slot = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
        self.slot_word, self.slot_byte = np.zeros((n, 8), np.int64), np.zeros((n, 8), np.uint8)
        self.slot_word[at, slot], self.slot_byte[at, slot] = self.word[by_block], self.byte[by_block]

    def extend(self, phrase: np.ndarray, block: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, block, byte) of the bitmaps shifted by one position and ANDed with those of all words."""
        low, carry = (byte << 1).astype(np.uint8), byte >> 7
        stay, over = np.flatnonzero(low), np.flatnonzero(carry)
        phrase = np.concatenate([phrase[stay], phrase[over]])
        block = np.concatenate([block[stay], block[over] + 1])
        hit = np.concatenate([low[stay], carry[over]])[:, None] & self.slot_byte[block]
        row, slot = np.nonzero(hit)
        return phrase[row], self.slot_word[block[row], slot], block[row], hit[row, slot]


def phrases(shard: Shard, langs: list[str], salt: str, words: Marks, known: list[Marks], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words' hashes, a row a phrase; popcounts) of the shard's phrases of ``size`` words whose words are in ``words`` and whose shorter parts are in ``known``, by length."""
    number, lang, names = shard.numbered(len(langs))
    seeds = [xxhash.xxh64_intdigest(x.encode(), xxhash.xxh64_intdigest(salt, 42)) for x in langs]
    own = np.fromiter(map(xxhash.xxh64_intdigest, names.cast(pa.binary()).to_numpy(zero_copy_only=False), map(seeds.__getitem__, lang.tolist())), np.uint64, len(names))
    place = np.arange(len(number)) + np.cumsum(shard.gap)
    good = words.has(own)[number]
    if not good[: shard.cut].any():
        return
    end = place[shard.cut] if shard.cut < len(place) else place[-1] + 1
    maps = Bitmaps(number[good], place[good])
    whole = np.where(maps.block < end >> 3, 255, np.where(maps.block == end >> 3, (1 << (end & 7)) - 1, 0)).astype(np.uint8)
    starts = maps.byte & whole
    edges = np.flatnonzero(np.diff(maps.word, prepend=-1, append=-1))
    a = 0
    while a < len(maps.word):
        b = int(edges[min(len(edges) - 1, np.searchsorted(edges, a + ROOTS))])
        own_edges = np.diff(maps.word[a:b], prepend=-1) != 0
        first, of = maps.word[a:b][own_edges], np.cumsum(own_edges) - 1
        head, full, tail = first[:, None], own[first], np.zeros(len(first), np.uint64)
        block, byte = maps.block[a:b], starts[a:b]
        for length in range(2, size + 1):
            of, word, block, byte = maps.extend(of, block, byte)
            if not len(of):
                break
            order = np.argsort(of * len(own) + word)
            of, word, block, byte = of[order], word[order], block[order], byte[order]
            new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
            parent, added = of[new], word[new]
            head = np.concatenate([head[parent], added[:, None]], 1)
            full, tail = turn(full[parent], own[added]), turn(tail[parent], own[added])
            sizes = np.diff(new, append=len(of))
            # its part without the first word must be known, and, unless it is what is wanted, the phrase itself
            fine = known[length - 3].has(tail) if length > 2 else np.ones(len(new), bool)
            if length < size:
                fine &= known[length - 2].has(full)
            keep = np.repeat(fine, sizes)
            count = np.add.reduceat(np.bitwise_count(byte).astype(np.int64), new)[fine]
            head, full, tail = head[fine], full[fine], tail[fine]
            of, block, byte = np.repeat(np.arange(len(head)), sizes[fine]), block[keep], byte[keep]
            if length == size and len(head):
                yield own[head], count
        a = b


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, f): every word's occurrences in a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        for shard in shards(batches, langs, 0):
            number, lang, names = shard.numbered(len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang)), names, pa.array(np.bincount(number, minlength=len(names)))], ["lang", "word", "f"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, salt: str, words: Marks, known: list[Marks], size: int) -> DataFrame:
    """(key, a): occurrences of the phrases of ``size`` words; ``key`` holds their words' hashes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, known))
    cols = [f"h{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        words, known = shared.value
        for shard in shards(batches, langs, size - 1):
            for key, count in phrases(shard, langs, salt, words, known, size):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(key[:, i]).view(np.int64)) for i in range(size)), pa.array(count)], [*cols, "a"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*cols, "a"]))
    return found.groupBy(*cols).agg(F.sum("a").alias("a")).select(F.array(*cols).alias("key"), "a")


def hashed(words: DataFrame) -> tuple[DataFrame, str]:
    """``words`` with ``h``, and the salt with which no two words of the corpus have one hash: so the hashes stand for the words, exactly."""
    for salt in map(str, range(16)):
        made = words.withColumn("h", F.xxhash64(F.lit(salt), "lang", "word"))
        if made.groupBy("h").count().filter("count > 1").isEmpty():
            return made, salt
    raise RuntimeError("no salt keeps the hashes of all words apart")


def scored(counts: DataFrame) -> DataFrame:
    """(key, a, l, r, score): each phrase's lowest-scoring cut, ties to the shortest first part. ``counts`` holds words and all phrases.

    Arithmetic is in decimals of 38 digits, exact while a * a * 1000000 has no more (occurrences up to 10^15).
    """
    wide = "decimal(16,0)"
    cuts = counts.filter(F.size("key") > 1).select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(key, 1, k)"), "right": F.expr("slice(key, k + 1, size(key))")})
    met = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    value = F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as {wide}) * cast(a as {wide}))) div (cast(l as {wide}) * cast(r as {wide}))")
    best = met.withColumn("score", value).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("key", "a", "b.l", "b.r", "b.score")


def maximal(found: DataFrame, counts: DataFrame, within: int) -> DataFrame:
    """``found`` without phrases that lie in a longer one with at least ``within`` per cent of their occurrences."""
    longer = counts.filter(F.size("key") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("key") - n + 1), lambda i: F.slice(F.col("key"), i, n))))
    most = longer.select(F.explode(spans).alias("key"), F.col("a").alias("_longer")).groupBy("key").agg(F.max("_longer").alias("_longer"))
    return found.join(most, "key", "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < within * F.col("a"))).drop("_longer")


def collocations(docs: DataFrame, text_col: str, lang_col: str, least: int = 10, longest: int = 3, within: int = 50, most: int = 2000, dealt: int = 64) -> DataFrame:
    """Each language's first ``most`` phrases of 2 to ``longest`` words with at least ``least`` occurrences: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und``; a language without phrases has no rows. Phrases are candidates only
    if their parts are, so bounded filters of frequent words and shorter phrases spare most extensions; beyond some ten
    million of them the filters let more through, which costs work and loses nothing. All counts are exact and of whole texts.
    The first ``most`` of a language are first found in ``dealt`` parts of its phrases, so no task sorts them all.
    """
    words, salt = hashed(materialise(word_counts(docs, text_col, lang_col), "words"))
    frequent = materialise(words.filter(F.col("f") >= least).select(F.array("h").alias("key"), F.col("f").alias("a")), "frequent")
    marks = Marks(frequent, frequent.count())
    known, counts = [], frequent
    for size in range(2, longest + 1):
        found = materialise(phrase_counts(docs, text_col, lang_col, salt, marks, known, size).filter(F.col("a") >= least), f"phrases-{size}")
        counts = counts.unionByName(found)
        if size < longest:
            known.append(Marks(found, found.count()))
    kept = materialise(maximal(scored(counts), counts, within), "candidates")
    named = kept.select("key", F.posexplode("key").alias("i", "h")).join(words.filter(F.col("f") >= least).select("h", "lang", "word"), "h")
    texts = named.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = kept.join(texts, "key").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(dealt)))
    part = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
