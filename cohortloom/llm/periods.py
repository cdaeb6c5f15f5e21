"""Periodic runs of words: maximal stretches that repeat a period at least EXPONENT times over.

Words are `[^\\x20\\x09-\\x0D]+`. A run of period q is a stretch of words in which words q apart are identical, q being its smallest period, of at
least max(LEAST, EXPONENT * q) words, that no neighbouring word extends.

At each dyadic scale B the text is cut into blocks of B words. A run of EXPONENT periods q with 2 * B <= 3 * q + 1 holds a whole block and its copy q
words on, so every period is looked for at one scale: the largest such B. The sum of squared differences between a block and each placement in the
following window is a convolution, made exactly by number-theoretic transforms modulo as many primes as the largest possible sum needs; placements of sum zero are
occurrences, and their distances are the seeds. A seed is extended word by word to both sides; periods grow from scale to scale, so a seed inside a run whose period divides it is
skipped. Only blocks are transformed that can occur again: a pair of words at the start, in the middle and at the end of a block must come again near enough.

A document is parsed inside one slice of whole documents; work is about n log^2 n in its words. Nulls and texts without words have no runs. A very
long text makes a slice of its own. Rows that repeat a doc_id are parsed one by one, whatever it is. Of runs with the same exponent the first is told, then that with the
smaller period. Empty tables give none.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import SPACE, Words, adding, mix, packed, slices

EXPONENT, LEAST = 4, 6
#: Primes c * 2**k + 1 with 3 as a generator.
PRIMES = (998244353, 469762049, 167772161)
#: Words that one batch of transforms holds.
BATCH = 1 << 19
U = np.uint64


@lru_cache(maxsize=64)
def _roots(size: int, prime: int, inverse: bool) -> list[np.ndarray]:
    """Twiddle factors for each pass over `size` values."""
    out, half = [], size // 2
    while half:
        root = pow(3, (prime - 1) // (2 * half), prime)
        root = pow(root, prime - 2, prime) if inverse else root
        powers = np.ones(half, U)
        done = 1
        while done < half:
            more = min(done, half - done)
            powers[done : done + more] = powers[:more] * U(pow(root, done, prime)) % U(prime)
            done += more
        out.append(powers)
        half //= 2
    return out


def _transformed(rows: np.ndarray, prime: int) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    p, (k, size) = U(prime), rows.shape
    for powers in _roots(size, prime, False):
        half = len(powers)
        view = rows.reshape(k, -1, 2, half)
        low, high = view[:, :, 0], view[:, :, 1]
        rows = np.stack(((low + high) % p, (low + p - high) % p * powers % p), 2).reshape(k, size)
    return rows


def _restored(rows: np.ndarray, prime: int) -> np.ndarray:
    """The inverse of _transformed."""
    p, (k, size) = U(prime), rows.shape
    for powers in reversed(_roots(size, prime, True)):
        half = len(powers)
        view = rows.reshape(k, -1, 2, half)
        low, high = view[:, :, 0], view[:, :, 1] * powers % p
        rows = np.stack(((low + high) % p, (low + p - high) % p), 2).reshape(k, size)
    return rows * U(pow(size, prime - 2, prime)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray, prime: int) -> np.ndarray:
    """For each row and d the sum over i of (block[i] - window[d + i]) ** 2 modulo prime, for d up to the window's length less the block's.

    The window's length is a power of two; placements that would wrap around aren't returned."""
    size, long = blocks.shape[1], windows.shape[1]
    p = U(prime)
    x, y = blocks.astype(U) % p, windows.astype(U) % p
    turned = np.zeros_like(y)
    turned[:, 0], turned[:, long - size + 1 :] = x[:, 0], x[:, :0:-1]
    cross = _restored(_transformed(turned, prime) * _transformed(y, prime) % p, prime)[:, : long - size + 1]
    squares = np.concatenate((np.zeros((len(y), 1), U), np.cumsum(y * y % p, 1)), 1)
    return ((x * x % p).sum(1)[:, None] + squares[:, size:] - squares[:, : long - size + 1] + (p - cross) + (p - cross)) % p


def scales(longest: int):
    """(block, smallest period, largest period) of the scales that a text of so many words needs."""
    size = 2
    while (first := -(-(2 * size - 1) // 3)) * EXPONENT <= longest:
        yield size, first, (4 * size - 2) // 3
        size *= 2


def _occurrences(ids: np.ndarray, at: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the copies of the blocks ids[at:at + size] at distances low to high. ids are padded."""
    long = 1 << (size + high - 1).bit_length()
    bound, starts, gaps = int(ids.max()) ** 2 * size, [], []
    for i in range(0, len(at), max(1, BATCH // long)):
        own = at[i : i + max(1, BATCH // long)]
        blocks, windows = ids[own[:, None] + np.arange(size)], ids[own[:, None] + np.arange(long)]
        same, modulus = np.ones((len(own), high - low + 1), bool), 1
        for prime in PRIMES:
            same &= squared_differences(blocks, windows, prime)[:, low : high + 1] == 0
            modulus *= prime
            if modulus > bound or not same.any():
                break
        row, d = np.nonzero(same)
        starts.append(own[row])
        gaps.append(d + low)
    return (np.concatenate(starts), np.concatenate(gaps)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _reach(same, most: int) -> int:
    """How many of `most` steps hold until the first that doesn't; same(a, b) tells for steps a to b - 1."""
    done, chunk = 0, 32
    while done < most:
        step = same(done, min(most, done + chunk))
        if not step.all():
            return done + int(np.argmin(step))
        done, chunk = done + len(step), chunk * 2
    return most


def _next_pair(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far on the pair of words at each place comes again in its document; very far where it doesn't."""
    n = len(ids)
    far = np.full(n, 1 << 60)
    if n < 3:
        return far
    key = mix(mix((doc[:-1].astype(U) << U(32)) + ids[:-1].astype(U)) + ids[1:].astype(U))  # equal hashes of unequal pairs only cost a transform
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def runs(ids: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the documents ids[edges[i]:edges[i + 1]], by growing period. Equal words of a document have equal ids, from 1 on."""
    lengths = np.diff(edges)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    begin, end = np.repeat(edges[:-1], lengths), np.repeat(edges[1:], lengths)
    far, found = _next_pair(ids, doc), []
    longest = int(lengths.max(initial=0))
    padded = np.concatenate((ids, np.zeros(8 * longest + 16, ids.dtype)))
    for size, low, high in scales(longest):
        at = np.arange(0, len(ids) - size - low + 1, size)
        at = at[at + size + low <= end[at]]
        for probe in sorted({0, (size - 2) // 2, size - 2}):
            at = at[far[at + probe] <= high]
        for start, length, period in found:  # inside a run only its multiples occur
            if period <= size:
                at = at[(at < start) | (at + size + high > start + length)]
        starts, gaps = _occurrences(padded, at, size, low, high)
        fits = starts + size + gaps <= end[starts]
        starts, gaps = starts[fits], gaps[fits]
        for start, length, period in found:
            if period <= size:
                new = (starts < start) | (starts + size + gaps > start + length) | (gaps % period != 0)
                starts, gaps = starts[new], gaps[new]
        for period in np.unique(gaps).tolist():
            seeds, i = np.sort(starts[gaps == period]), 0
            while i < len(seeds):
                b = int(seeds[i])
                right = b + size + _reach(lambda a, c: padded[b + size + a : b + size + c] == padded[b + size + a + period : b + size + c + period], int(end[b]) - b - size - period)  # noqa: B023
                left = b - _reach(lambda a, c: (padded[b - c : b - a] == padded[b - c + period : b - a + period])[::-1], b - int(begin[b]))  # noqa: B023
                length = right - left + period
                if length >= max(LEAST, EXPONENT * period) and not any(s <= left and s + n >= left + length for s, n, _ in found):
                    found.append((left, length, period))
                i = int(np.searchsorted(seeds, right - size + 1))
    return found


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exponent, the first of these, then that of the smaller period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _identified(words: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of some documents, from 1 on, equal for equal words of one document."""
    out = []
    for own in words:
        number = {w: i for i, w in enumerate(dict.fromkeys(own), 1)}
        out.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
    return np.concatenate([np.zeros(0, np.int64), *out])


def _parsed(batches):
    for batch in batches:
        for rows, data, at in slices(batch):
            raw = data.tobytes()
            words = [raw[a:b].split() for a, b in pairwise(at.tolist())]  # bytes are split at the separators of words exactly
            edges = np.concatenate(([0], np.cumsum([len(w) for w in words])))
            of: dict[int, list] = {}
            for start, length, period in runs(_identified(words), edges):
                i = int(np.searchsorted(edges, start, "right")) - 1
                of.setdefault(i, []).append((start - int(edges[i]), length, period))
            kept = []
            for i, own in enumerate(words):
                if i in of:
                    stays = np.ones(len(own), bool)
                    for start, length, period in of[i]:
                        stays[start + period : start + length] = False
                    own = [own[j] for j in np.flatnonzero(stays).tolist()]
                kept.append(b" ".join(own).decode())
            told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in sorted(of.get(i, []), key=lambda r: (r[0], r[2]))] for i in range(len(words))]
            top = [dict(zip(("start", "length", "period"), best(of[i]), strict=True)) if i in of else None for i in range(len(words))]
            run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("text"), pa.array(np.diff(edges)), pa.array(told, pa.list_(run)), pa.array(top, run), pa.array(kept, pa.string())], ["row", "text", "n_words", "runs", "best", "kept_text"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """row (a struct of docs' other columns) and text with n_words, runs (array of start, length, period, by start, then period), best (the run of the
    greatest exponent, null without one) and kept_text: the words that no run repeats, joined by one space. A run keeps its first period."""
    rows = packed(docs).drop("k")
    run = "start: long, length: long, period: long"
    return rows.mapInArrow(_parsed, adding(rows, f"n_words long, runs array<struct<{run}>>, best struct<{run}>, kept_text string"))
