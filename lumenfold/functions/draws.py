"""Hashed draws by the array: the first 48 bits of md5(prefix || i), modulo n, for i from 0 to n - 1.

These are the draws that SQL writes as ('0x' || left(md5(prefix || i), 12))::bigint % n. One step of MD5 runs over
a chunk of numbers at once, so a draw costs a small part of a hash of its own, and memory does not grow with n.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
_AT = [*range(16), *[(5 * s + 1) % 16 for s in range(16)], *[(3 * s + 5) % 16 for s in range(16)], *[7 * s % 16 for s in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
CHUNK = 16384


def _first48(words: list, size: int) -> np.ndarray:
    """Of the digests of size blocks: 16 words, a number where all blocks agree, else an array."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for s in range(64):
        if s < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif s < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif s < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[_AT[s]]
        f += a
        if isinstance(w, int):
            f += np.uint32((_K[s] + w) & 0xFFFFFFFF)
        else:
            f += np.uint32(_K[s])
            f += w
        np.left_shift(f, np.uint32(_TURN[s]), out=t)
        f >>= np.uint32(32 - _TURN[s])
        t |= f
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(16) | (b.byteswap() >> np.uint32(16)).astype(np.uint64)


def hashed(prefix: str, start: int, stop: int) -> np.ndarray:
    """The 48 bits for i in [start, stop), all of one number of decimal digits."""
    head, width = prefix.encode(), len(str(start))
    if len(head) + width > 55:  # more than one block
        return np.array([int.from_bytes(hashlib.md5(head + b"%d" % i).digest()[:6], "big") for i in range(start, stop)], np.uint64)
    block = bytearray(head + bytes(width) + b"\x80").ljust(64, b"\0")
    block[56:] = (8 * (len(head) + width)).to_bytes(8, "little")
    words: list = [int.from_bytes(block[k : k + 4], "little") for k in range(0, 64, 4)]
    rest = np.arange(start, stop, dtype=np.int64)
    for at in reversed(range(len(head), len(head) + width)):
        rest, digit = np.divmod(rest, 10)
        words[at // 4] = (digit + 48).astype(np.uint32) * np.uint32(1 << 8 * (at % 4)) + (np.uint32(w) if isinstance(w := words[at // 4], int) else w)
    return _first48(words, stop - start)


def drawn(prefix: str, n: int) -> Iterator[np.ndarray]:
    """Chunks of the n draws from range(n)."""
    start, top = 0, 10
    while start < n:
        stop = min(start + CHUNK, n, top)
        yield (hashed(prefix, start, stop) % np.uint64(n)).astype(np.int64)
        start = stop
        if start == top:
            top *= 10
