"""MD5 that can be taken up again. Its state is bytes, so that tasks can read a text of any length one after another."""

from __future__ import annotations

import ctypes
import math
import struct

#: Four words, the length so far, and what does not fill a block of 64 bytes yet.
START = struct.pack("<4IQ", 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0)
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def plain(words: bytes, blocks: bytes) -> bytes:
    """The four words after whole blocks, in Python alone: a few hundred kilobytes a second."""
    state = struct.unpack("<4I", words)
    for at in range(0, len(blocks), 64):
        m, (a, b, c, d) = struct.unpack_from("<16I", blocks, at), state
        for i in range(64):
            f, k = ((b & c | ~b & d, i), (d & b | ~d & c, 5 * i + 1), (b ^ c ^ d, 3 * i + 5), (c ^ (b | ~d & 0xFFFFFFFF), 7 * i))[i // 16]
            x = (a + f + SINES[i] + m[k % 16]) & 0xFFFFFFFF
            r = TURNS[i // 16][i % 4]
            a, d, c, b = d, c, b, (b + (x << r | x >> (32 - r))) & 0xFFFFFFFF
        state = tuple((x + y) & 0xFFFFFFFF for x, y in zip(state, (a, b, c, d), strict=True))
    return struct.pack("<4I", *state)


def native(words: bytes, blocks: bytes) -> bytes:
    """The same by the OpenSSL that Python's hashlib is linked with: its context begins with the four words and is otherwise empty between blocks."""
    context = ctypes.create_string_buffer(words, 256)
    _update(context, blocks, len(blocks))
    return context.raw[:16]


try:
    import _hashlib

    _update = ctypes.CDLL(_hashlib.__file__).MD5_Update
    _update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
    compress = native if native(START[:16], b"a" * 128) == plain(START[:16], b"a" * 128) else plain
except (ImportError, OSError, AttributeError):  # hashlib without OpenSSL, or an OpenSSL without these functions
    compress = plain


def more(state: bytes, text: bytes) -> bytes:
    """``state`` after ``text``."""
    length, body = struct.unpack_from("<Q", state, 16)[0] + len(text), state[24:] + text
    full = len(body) // 64 * 64
    return compress(state[:16], body[:full]) + struct.pack("<Q", length) + body[full:]


def closed(state: bytes) -> str:
    """The digest of all that ``state`` has read, in hexadecimal."""
    length, tail = struct.unpack_from("<Q", state, 16)[0], state[24:]
    end = tail + b"\x80" + bytes((55 - len(tail)) % 64) + struct.pack("<Q", length * 8 % 2**64)
    return compress(state[:16], end).hex()
