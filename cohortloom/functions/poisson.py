"""Bootstrap weights of many cases and draws at once: Poisson numbers of mean 1 from md5(case-draw), whose rounds run over whole arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]


def poisson_steps() -> list[str]:
    """Eight hexadecimal digits each: the shares of the numbers up to 0, 1, 2, ... under a Poisson law of mean 1."""
    out, p, total, k = [], math.exp(-1), 0.0, 0
    while (total := total + p) < 1 - 2**-32:
        out.append(f"{int(total * 2**32):08x}")
        k += 1
        p /= k
    return out


STEPS = poisson_steps()


def md5_heads(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first 32 bits of the md5 of n messages of one block, of which the words that aren't all 0 are given."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = _WORD[i]
        np.add(f, a, out=f), np.add(f, np.uint32(_ADD[i]), out=f)
        if word in words:
            np.add(f, words[word], out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=t), np.right_shift(f, np.uint32(32 - _TURN[i]), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_START[0])).byteswap()


def weights(prefixes: pa.Array, draws: int) -> np.ndarray:
    """A row of weights for each prefix (`case-`), a column for each draw from 1 on."""
    text = prefixes.cast(pa.string())
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    size, steps = np.diff(ends), [np.uint32(int(s, 16)) for s in STEPS]
    heads, out = np.empty((draws, len(text)), np.uint32), np.zeros((draws, len(text)), np.uint8)
    # Messages of one block are hashed together, whatever their lengths; longer ones one by one.
    short = size + len(str(draws)) <= 55
    for i in np.flatnonzero(~short).tolist():
        start = hashlib.md5(data[ends[i] : ends[i + 1]].tobytes())
        for draw in range(1, draws + 1):
            (own := start.copy()).update(str(draw).encode())
            heads[draw - 1, i] = int.from_bytes(own.digest()[:4], "big")
    at, size = np.flatnonzero(short), size[short]
    block, rows = np.zeros((len(at), 64), np.uint8), np.arange(len(at))
    row = np.repeat(rows, size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    block[row, column] = data[np.repeat(ends[at], size) + column]
    view, least, most = block.view("<u4"), int(size.min(initial=55)), int(size.max(initial=0))
    words: dict[int, np.ndarray] = {}
    for draw in range(1, draws + 1 if len(at) else 1):
        tail = [*str(draw).encode(), 0x80]
        for i, x in enumerate(tail):
            block[rows, size + i] = x
        words |= {j: np.ascontiguousarray(view[:, j]) for j in range(-(-(most + len(tail)) // 4)) if j not in words or j >= least // 4}
        if len(tail) > len(str(draw - 1)) + 1 or draw == 1:
            words[14] = (8 * (size + len(tail) - 1)).astype(np.uint32)
        heads[draw - 1, at] = md5_heads(words, len(at))
    for s in steps:
        out += heads >= s
    return np.ascontiguousarray(out.T)
