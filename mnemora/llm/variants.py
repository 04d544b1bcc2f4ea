"""Spelling variants: words one error apart, by forward and backward minimal acyclic automata.

Two words that differ by one inserted, deleted or replaced code point agree in the first or in the last half of the
shorter. So words are dealt by halves; each part of them is put into a minimal automaton whose words are numbered by their
rank (a perfect hash), forwards or reversed; the known half of a word is followed exactly and the rest completed with one error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .letters import LOWER, joined, pieces, strings

#: Runs counted together, runs longer than so many bytes are looked at one by one, rows that share an automaton.
SHARD, LONG, SLICE = 1 << 20, 64, 20_000
#: A group of words is hot, and split further, beyond so many rows and one row in so many: so hot groups are fewer than PARTS.
GROUP, PARTS = 20_000, 1000
#: The least length of a word, its least occurrences, and one run in how many loses a code point.
LENGTH, LEAST, NOISE = 6, 5, 199

_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def _crc_table() -> np.ndarray:
    """The table of the usual CRC-32, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of the runs of bytes in ``flat``, each going on from its seed (the crc32 of what is before it)."""
    order = np.argsort(-np.minimum(lengths, LONG + 1).astype(np.int16), kind="stable")
    sizes, at, state = lengths[order], starts[order], ~seeds[order]
    n = len(order)
    for j in range(min(LONG, int(sizes[0]) if n else 0)):
        while n and sizes[n - 1] <= j:
            n = int(np.searchsorted(-sizes, -j, "left"))
        state[:n] = CRC[(state[:n] ^ flat[at[:n] + j]) & 255] ^ state[:n] >> 8
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = zlib.crc32(flat[starts[i] : starts[i] + lengths[i]], int(seeds[i]))
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A to Z, a to z and U+00C0 to U+00FF."""
    lead = data == _LEAD
    return _ASCII[data] | lead | np.concatenate(([False], lead[:-1]))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The words of at least LENGTH code points that the runs of batches (id, text) become, in columns of strings."""
    for batch in batches:
        own = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()), np.uint32, len(batch))
        for row, data, begins in joined(batch.column(1)):
            for starts, ends, flat in pieces(data, letters(data)):
                flat, size = LOWER[flat], ends - starts
                begin = np.cumsum(size) - size
                leads = np.concatenate(([0], np.cumsum(flat == _LEAD)))
                points = size - (leads[begin + size] - leads[begin])
                long = np.flatnonzero(points >= LENGTH)
                text = row + np.searchsorted(begins, starts[long], "right") - 1
                code = crc_runs(flat, begin[long], size[long], own[text])
                odd = code % NOISE == 0
                same = np.zeros(len(size), bool)
                same[long[~odd]] = True
                yield strings(size[same], flat[np.repeat(same, size)])
                changed = []
                for i, h in zip(long[odd].tolist(), code[odd].tolist(), strict=True):
                    if points[i] > LENGTH:
                        at, word = h % int(points[i]), flat[begin[i] : begin[i] + size[i]].tobytes().decode()
                        changed.append(word[:at] + word[at + 1 :])
                yield pa.array(changed, pa.string())


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the words that occur at least LEAST times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found = pc.value_counts(pa.concat_arrays(held))
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        for part in runs(batches):
            held.append(part)
            size += len(part)
            if size >= SHARD:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def automaton(words: list[str]) -> tuple[list[dict], list[bool], int]:
    """The minimal acyclic automaton of sorted distinct words: (arcs of each state, which states end words, the first state).

    An arc leads to (state, how many words come before those behind it); added up along a word they give its rank.
    """
    register: dict = {}
    arcs: list[dict] = []
    ends: list[bool] = []
    sizes: list[int] = []
    open_: list[list] = [[False, []]]
    last = ""

    def close() -> int:
        end, out = open_.pop()
        key = (end, tuple(out))
        if key not in register:
            register[key], before, made = len(arcs), int(end), {}
            for c, to in out:
                made[c] = (to, before)
                before += sizes[to]
            arcs.append(made)
            ends.append(end)
            sizes.append(before)
        return register[key]

    for word in [*words, ""]:
        k, most = 0, min(len(word), len(last))
        while k < most and word[k] == last[k]:
            k += 1
        for i in range(len(last), k, -1):
            open_[i - 1][1].append((last[i - 1], close()))
        open_.extend([False, []] for _ in word[k:])
        open_[-1][0] |= word != ""
        last = word
    return arcs, ends, close()


def one_error(machine: tuple[list[dict], list[bool], int], word: str, exact: int) -> Iterator[int]:
    """Ranks of the automaton's words that are ``word`` with one code point replaced or inserted after its first ``exact``, each once."""
    arcs, ends, state = machine

    def follow(state: int, rank: int, i: int) -> int:
        for c in word[i:] if i < len(word) else "":
            if c not in arcs[state]:
                return -1
            state, more = arcs[state][c]
            rank += more
        return rank if ends[state] else -1

    rank = 0
    for i in range(len(word) + 1):
        here = word[i] if i < len(word) else ""
        if i >= exact:
            for c, (to, more) in arcs[state].items():
                if c != here:
                    for rest in (i + 1, i) if here else (i,):
                        if (found := follow(to, rank + more, rest)) >= 0:
                            yield found
        if not here or here not in arcs[state]:
            return
        state, more = arcs[state][here]
        rank += more


def neighbours(rows: list[tuple[str, int, int, int, int, int]]) -> list[tuple[str, int, str, int]]:
    """(word, n_near, best, best_n) as far as whole groups of rows (word, n, length, head, tail, differ) tell.

    A row whose length is its word's asks for all words near it that have its first ``head`` and last ``tail`` code points
    and, if ``differ`` is positive, not its first ``differ``; a longer word is told by the shorter one.
    """
    out: dict[str, list] = {}

    def tell(word: str, near: str, n: int) -> None:
        had = out.setdefault(word, [0, near, n])
        had[0] += 1
        if (-n, near) < (-had[2], had[1]):
            had[1:] = near, n

    for forward in (True, False):
        part = [r for r in rows if (r[3] >= r[4]) == forward]
        turned = {(r[0] if forward else r[0][::-1]): r[1] for r in part}
        words = sorted(turned)
        machine = automaton(words)
        for word, n, length, head, tail, differ in part:
            if length != len(word):
                continue
            for at in one_error(machine, word if forward else word[::-1], head if forward else tail):
                key = words[at]
                near = key if forward else key[::-1]
                if near[:head] != word[:head] or (tail and near[-tail:] != word[-tail:]) or (differ and near[:differ] == word[:differ]):
                    continue
                tell(word, near, turned[key])
                if len(near) > length:
                    tell(near, word, n)
    return [(word, *x) for word, x in out.items()]


def split(rows: DataFrame) -> DataFrame:
    """Rows of groups (length, head, tail, differ) dealt to the two halves of the part that may differ: an error in its second half, then one in its first.

    The former pairs are left out of the latter by ``differ``, so each pair is found once. ``length`` is that of a pair's shorter word.
    """
    half = F.floor((F.col("length") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("differ").alias("differ"))
    second = F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail"), F.when(F.col("differ") > 0, F.least("differ", F.col("head") + half)).otherwise(F.col("head") + half).alias("differ"))
    # what must differ within the first ``differ`` cannot when the head covers them
    good = (F.col("differ") == 0) | (F.col("differ") > F.col("head"))
    return rows.select("word", "n", "length", F.explode(F.array(first, second)).alias("w")).select("word", "n", "length", "w.head", "w.tail", "w.differ").filter(good)


def key() -> Column:
    """A group's name: all its words agree in it."""
    return F.concat_ws(":", "length", "head", "tail", "differ", F.expr("substring(word, 1, head)"), F.expr("right(word, tail)"))


def groups(words: DataFrame) -> DataFrame:
    """Every word (word, n) once for each group of words in which its near ones are: (word, n, length, head, tail, differ, key).

    A word belongs to pairs whose shorter word has its length, or one less. Groups that are hot are split once more until
    none is or nothing is left to split.
    """
    size = F.char_length("word")
    lengths = F.filter(F.array(size, size - 1), lambda x: x >= LENGTH)
    zero = F.lit(0)
    rows = split(words.select("word", "n", F.explode(lengths).alias("length"), zero.alias("head"), zero.alias("tail"), zero.alias("differ"))).withColumn("key", key())
    done = None
    for depth in range(32):
        rows = materialise(rows, f"groups-{depth}")
        most = max(GROUP, rows.count() // PARTS)
        large = rows.filter(F.col("length") - F.col("head") - F.col("tail") > 1).groupBy("key").count().filter(F.col("count") > most).select("key")
        large = F.broadcast(materialise(large, "hot"))
        cold = rows.join(large, "key", "left_anti").select(*rows.columns)
        done = cold if done is None else done.unionByName(cold)
        if large.isEmpty():
            return done
        rows = split(rows.join(large, "key", "left_semi").drop("key")).withColumn("key", key())
    return done.unionByName(rows)


def near_words(words: DataFrame, parts: int | None = None) -> DataFrame:
    """(word, n_near, form, form_n): for words with near ones, how many there are and the most frequent of them, ties to the smallest in code-point order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if len(held) >= SLICE and row[-1] != held[-1][-1]:
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    def told(held: list[tuple]) -> pa.RecordBatch:
        found = neighbours([r[:-1] for r in held])
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], ["word", "n_near", "form", "form_n"])

    rows = groups(words).select("word", "n", "length", "head", "tail", "differ", "key")
    dealt = rows.repartition(parts, "key") if parts else rows.repartition("key")
    found = dealt.sortWithinPartitions("key").mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of words (word, form) by following forms to their end. Forms are ``times`` as frequent each step, so twice as long paths a round end soon."""
    at = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < most:
        at = materialise(at, "roots")
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        reach *= 2
    return at


def variants(docs: DataFrame, id_col: str, text_col: str, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a corpus.

    Words are the lower-cased runs of letters (A to Z, a to z, U+00C0 to U+00FF) of at least LENGTH code points that occur
    LEAST times or more, after one run in NOISE, told by the crc32 of its document and text, has lost a code point. A word's form is the most
    frequent word one error away, if it has ``times`` the occurrences; its root is where forms lead. A null text has no
    words, a null id counts as an empty one; repeated rows count as often as they come; other columns take no part.
    """
    words = materialise(word_counts(docs, id_col, text_col), "words")
    near = near_words(words)
    rows = words.join(near, "word", "left").withColumn("_good", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    rows = materialise(rows.select("word", F.when(F.col("_good"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_good"), F.col("form_n")).alias("form_n")), "forms")
    top = words.agg(F.max("n")).first()[0] or 1
    longest = 1
    while LEAST * times**longest <= top:  # a path of so many forms needs that many occurrences at its end
        longest += 1
    ends = roots(rows.filter("form IS NOT NULL").select("word", "form"), longest)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
