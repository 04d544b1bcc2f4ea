"""Shared plumbing of the training-data operators: inputs, shared storage, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled at a time by the Python operators: bounds a worker's memory whatever the Arrow batch size is.
SLICE_ROWS = 512
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of an input folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is empty a folder of this machine is used in local mode only (tests, a laptop); on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``fresh_path`` that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or not name.startswith("_"):
        name = f"_{name}"
    return name


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Elements that a running total appends one by one before it starts another piece.
PIECE = 256


def running(values: Column, kind: str, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What an array adds up to before each of its elements, as array<kind>, under an associative ``add`` with identity ``zero``.

    Appending to an array copies it, so elements are added up in pieces, and then the pieces: PIECE / 2 copies an element
    instead of half the array. ``values`` must not be empty.
    """

    def fold(part: Column) -> Column:
        start = F.struct(zero.alias("total"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(add(acc["total"], x).alias("total"), F.concat(acc["out"], F.array(acc["total"])).alias("out")))

    def whole(v: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE).cast("int")), lambda i: fold(F.slice(v, i * PIECE + 1, F.lit(PIECE))))
        return let(pieces, lambda ps: F.flatten(F.zip_with(ps, fold(F.transform(ps, lambda p: p["total"]))["out"], lambda p, before: F.transform(p["out"], lambda x: add(before, x)))))

    return let(values, whole)


#: A key with more than one row in so many is hot. There are fewer hot keys than this, so their table is small whatever the input.
HOT = 1000


def meet(rows: DataFrame, table: DataFrame, keys: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``keys`` with a written table of one row a key, where ``count`` says how many rows a key has.

    A hot key's rows are dealt by ``spread`` over as many parts as its count asks for, and its table row is repeated for each.
    """
    most = max(1, int(table.agg(F.sum(count)).first()[0] or 0) // HOT)
    hot = F.broadcast(table.filter(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(spread, parts).cast("int")).drop("_parts")
    wide = table.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(wide, [*keys, "_part"], how).drop("_part")


#: Bits of a sieve at most (32 MB), and of one of its rows.
SIEVE_BITS, SIEVE_ROW = 1 << 28, 1 << 15


class Sieve:
    """A Bloom filter of one hash, made and asked by column functions: keeps rows apart that cannot be in a table of keys.

    It has 16 bits a key, SIEVE_BITS at most, so its broadcast is bounded whatever the keys. Rows that it lets through must
    still meet the keys; beyond some ten million keys it lets more and more through, which costs work and loses nothing.
    """

    def __init__(self, keys: DataFrame, key: str, n: int) -> None:
        self.bits = min(SIEVE_BITS, max(SIEVE_ROW, 1 << (16 * n).bit_length()))
        at = self.place(F.col(key))
        rows = keys.select(F.floor(at / SIEVE_ROW).cast("int").alias("row"), (at % SIEVE_ROW).alias("bit"))
        self.rows = rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("map"))

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def split(self, df: DataFrame, key: Column, within: bool) -> DataFrame:
        """Rows of ``df`` that may be in the table (all of those that are), or the others. Null keys count as any other."""
        place, row, map_ = unused(df, "place"), unused(df, "row"), unused(df, "map")
        placed = df.withColumn(place, self.place(key)).withColumn(row, F.floor(F.col(place) / SIEVE_ROW).cast("int"))
        met = placed.join(F.broadcast(self.rows.select(F.col("row").alias(row), F.col("map").alias(map_))), row, "left")
        bit = F.col(place) % SIEVE_ROW
        byte = F.conv(F.hex(F.substring(F.col(map_), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
        return met.filter(hit if within else ~hit).select(*df.columns)


def text_slices(texts: pa.Array, most_rows: int = SLICE_ROWS, most_bytes: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(first row, rows) pieces of an Arrow string column, bounded in rows and bytes; a longer text is a piece by itself."""
    start, n = 0, len(texts)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    while start < n:
        room = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, "right"))
        stop = min(n, start + most_rows, max(room, start + 1))
        yield start, stop - start
        start = stop


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of such pieces; null counts as empty."""
    for start, rows in text_slices(texts):
        yield start, [x or "" for x in texts.slice(start, rows).to_numpy(zero_copy_only=False).tolist()]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one NumPy array a row, without Python objects."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that lie next to each other with equal values in the first ``keys`` columns (integers)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], 1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            mark = tuple(marks[a].tolist())
            if held and mark != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = mark
    if held:
        yield pa.Table.from_batches(held)


def gather(own: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the packed 32-bit ids of the parts ``number``, one after another, and where each part ends, after a first zero."""
    size = np.fromiter(map(len, own), np.int32, len(own)) // 4
    return lay(np.frombuffer(b"".join(own), "<u4"), np.cumsum(size, dtype=np.int32) - size, size, number)


def lay(flat: np.ndarray, first: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) as of ``gather``, from parts that begin at ``first`` in ``flat`` and are ``size`` long."""
    n = size[number]
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
    places = np.repeat(first[number] - ends[:-1], n)
    places += np.arange(ends[-1], dtype=np.int32)
    return flat[places], ends


class Recent:
    """A cache of at most ``most`` entries in two generations: what was wanted of late stays when the older half goes."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def fetch(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of distinct ``keys``, those that are not kept by ``make``; all are in ``young`` afterwards."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old.get
        got = list(map(young.get, keys))
        fresh = []
        for i in [i for i, v in enumerate(got) if v is None]:
            if (v := old(keys[i])) is None:
                fresh.append(i)
            else:
                got[i] = young[keys[i]] = v
        wanted = [keys[i] for i in fresh]
        for i, k, v in zip(fresh, wanted, make(wanted), strict=True):
            got[i] = young[k] = v
        return got


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long, null-free lists as a float64 matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
