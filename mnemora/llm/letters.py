"""Runs of bytes in Arrow text columns, cut by NumPy without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_slices

#: Bytes looked at together; a longer run of one word is taken whole.
CHUNK = 1 << 20

#: A byte as it is, A to Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each text begins) of slices of a column, with a line end after each text; null counts as empty."""
    for start, n in text_slices(texts, most_bytes=CHUNK):
        part = pc.fill_null(texts.slice(start, n), "").cast(pa.string())
        lengths = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part), "\n")[0].as_buffer()
        yield start, np.frombuffer(whole, np.uint8), begins


def pieces(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, bytes of the runs) of the maximal runs of bytes that are ``inside``, some CHUNK bytes at a time, each run whole."""
    at, n = 0, len(data)
    while at < n:
        size = CHUNK
        while True:
            within = inside[at : at + size]
            edges = np.flatnonzero(np.diff(within, prepend=False, append=False))
            cut = at + len(within) < n and within[-1]
            if not cut or edges[-2] > 0:
                break
            size *= 2  # a single run fills the chunk
        stop = int(edges[-2]) if cut else len(within)
        edges = edges[:-2] if cut else edges
        yield edges[0::2] + at, edges[1::2] + at, data[at : at + stop][within[:stop]]
        at += stop


def strings(lengths: np.ndarray, flat: np.ndarray) -> pa.Array:
    """The string column of runs that lie one after another in ``flat``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat)))
