"""MD5 of one prefix with each of many numbers behind it, by numpy: a row's replicates are hashed together."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MASK = 0xFFFFFFFF


@lru_cache(maxsize=64)
def _suffixes(at: int, count: int) -> tuple[int | np.ndarray, ...]:
    """The 16 words of a block that holds 1 .. `count` from byte `at` on, padded; a word equal in all is a number."""
    block = np.zeros((count, 64), np.uint8)
    for n in range(1, count + 1):
        digits = b"%d\x80" % n
        block[n - 1, at : at + len(digits)] = np.frombuffer(digits, np.uint8)
        block[n - 1, 56:58] = np.frombuffer((8 * (at + len(digits) - 1)).to_bytes(2, "little"), np.uint8)
    words = block.view("<u4").T
    return tuple(int(w[0]) if (w == w[0]).all() else np.ascontiguousarray(w) for w in words)


def _mixed(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if i < 16:
        return ((c ^ d) & b) ^ d
    if i < 32:
        return ((b ^ c) & d) ^ c
    return b ^ c ^ d if i < 48 else c ^ (b | ~d)


def md5_of_numbered(prefix: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First two 32-bit words (little-endian) of the MD5 of `prefix` + decimal n, for n = 1 .. `count`."""
    if len(prefix) + len(str(count)) > 55:  # more than one block
        digests = b"".join(hashlib.md5(prefix + b"%d" % n).digest()[:8] for n in range(1, count + 1))
        both = np.frombuffer(digests, "<u4").reshape(-1, 2)
        return both[:, 0], both[:, 1]
    own = np.frombuffer(prefix.ljust(64, b"\0"), "<u4").tolist()
    words = [w | o if isinstance(w, int) else w | np.uint32(o) for w, o in zip(_suffixes(len(prefix), count), own)]
    a, b, c, d = (np.full(count, x, np.uint32) for x in _START)
    for i, (shift, sine) in enumerate(zip(_SHIFTS, _SINES)):
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        f = _mixed(i, b, c, d)
        f += a
        if isinstance(word, int):
            f += np.uint32((word + sine) & _MASK)
        else:
            f += word
            f += np.uint32(sine)
        high = f << np.uint32(shift)
        f >>= np.uint32(32 - shift)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])
