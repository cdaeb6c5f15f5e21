"""Language-model scoring: log-bilinear models over word classes and over the words of a class; the classes' is trained in numpy with
noise-contrastive estimation.

Tokens are the lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` of a text and one end token. The counts of all training tokens are exact and cover all
training documents. The number of classes grows with the cube root of V for V distinct tokens, so that matrices of classes stay small at any size (V = 10**9: 2,288 classes, 21 MB a matrix): OWN + cbrt(V) of the most
frequent tokens are a class each, and RARE + cbrt(V) classes share the other tokens in equal parts, ordered by their last two bytes, then by hash. A token's probability is P(class | two classes before) * P(token | class, class before):

* P(class | context) is log-bilinear: the context's class vectors, each times the matrix of its position, predict a vector whose products with the
  class vectors, plus biases, are the scores. Every training token is learned from once: documents are dealt by hash to ROUNDS rounds and, within a
  round, to replicas of about PART tokens, which start from the last average, train with noise-contrastive estimation (noise: class frequencies) and are
  averaged, weighted by tokens. A document's replica and place depend on its key only, not on the partitions. A score is a sum of one term for
  each context position, so the sums of a softmax over all contexts are one matrix product.
* P(token | class, class before) has a vector and a bias for every token of the class: the softmax of bias + vector * context vector, where the context vectors
  come from the class model. Vectors are fitted in closed form (linear discriminants) from the contexts of all occurrences of the token, drawn to the
  class's mean by SHRINK further ones; without context the bias is log(c + 1). An unknown token counts as one more, without a vector. A fit takes
  sums only - of context vectors by token, of contexts by class, of exponentials by class and context - each merged before it is shuffled, so no class is held in one task.
  Tokens are dealt by hash to parts of about TOKENS; how often each follows each class is kept packed, one line for each part.

Vectors of the most frequent tokens, KNOWN at most, are broadcast; those of the other tokens are joined by part. Null or empty texts
have the end token only; a null doc_id is kept. Rows that repeat a doc_id are scored one by one, equal texts alike. Very long texts are scored whole. Tokens with
equal counts are ordered by hash. Other columns aren't read. doc_id keeps its type. An empty table gives an empty result. Without training documents all counts are 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, cut, mix, row_key, signed, slices

#: Numbers of tokens with a class of their own and of shared classes for the smallest vocabularies.
OWN, RARE, KNOWN = 159, 128, 200_000
CLASSES, WIDTH = 1 + OWN + RARE, 12
BATCH, NOISE, RATE = 1024, 24, 0.1
ROUNDS, PART, SHRINK, FAN = 8, 500_000, 5.0, 64
#: Least number of parts in which tokens are kept, and tokens of a part.
SPREAD, TOKENS = 128, 1 << 17
END = np.uint64(0x5EED0FE4D)
#: The model and its logarithms of sums last used in this worker, by the name of its broadcast.
_models: dict[str, tuple] = {}


def suffixes(data: np.ndarray, words: Words) -> np.ndarray:
    """The last two bytes of each word as a number."""
    last = data[words.ends - 1].astype(np.int64)
    before = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0).astype(np.int64)
    return last * 256 + before


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix (-1: the end) of the tokens of all texts, one after the other, and where each text starts."""
    from ._text import LOWER

    data = LOWER[data]
    words = Words(data, at)
    n = len(words.counts)
    starts = words.doc + np.arange(n + 1)
    hashes, rare = np.full(starts[-1], END, np.uint64), np.full(starts[-1], -1, np.int64)
    keep = np.ones(len(hashes), bool)
    keep[starts[1:] - 1] = False
    hashes[keep], rare[keep] = words.hashes(), suffixes(data, words) if len(words.starts) else 0
    return hashes, rare, starts


def _count(batches):
    parts, held = [], 0

    def flush():
        hashes = np.concatenate([p[0] for p in parts])
        unique, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        rare = np.concatenate([p[1] for p in parts])[first]
        return unique, rare, np.bincount(at, np.concatenate([p[2] for p in parts])).astype(np.int64)

    for batch in batches:
        for _, data, at in slices(batch):
            hashes, rare, _ = tokens(data, at)
            parts.append((hashes, rare, np.ones(len(hashes))))
            held += len(hashes)
            if held > 3_000_000:
                parts = [flush()]
                held = len(parts[0][0])
                if held > 1_500_000:
                    yield _counted(*parts[0])
                    parts, held = [], 0
    if parts:
        yield _counted(*flush())


def _counted(hashes, rare, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(rare.astype(np.int32)), pa.array(counts.astype(np.int64))], ["h", "rare", "n"])


class Vocabulary:
    """The classes of tokens, from the most frequent tokens (h, rare, n) and the totals of each suffix (rare, n, v)."""

    def __init__(self, top: pd.DataFrame, totals: pd.DataFrame):
        self.n, self.v = int(totals["n"].sum()), int(totals["v"].sum())
        self.end = int(totals["n"][totals["rare"] < 0].sum())
        self.own, self.shared = self.sizes(self.v)
        self.size = 1 + self.own + self.shared
        own = top[top["rare"] >= 0].head(self.own)
        hashes = own["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts, self.classes = hashes[order], own["n"].to_numpy(np.int64)[order], 1 + order
        kinds = np.zeros(1 << 16)
        words = totals[totals["rare"] >= 0]
        kinds[words["rare"].to_numpy(np.int64)] = words["v"]
        np.subtract.at(kinds, own["rare"].to_numpy(np.int64), 1)
        self.share = kinds / max(1, kinds.sum())
        self.below = np.cumsum(self.share) - self.share

    @staticmethod
    def sizes(v: int) -> tuple[int, int]:
        """Tokens with a class of their own and shared classes for v distinct tokens."""
        more = round(v ** (1 / 3))
        return OWN + more, RARE + more

    def broadcast_from(self, ranks: pd.DataFrame) -> None:
        """Sets from which number on tokens of shared classes are broadcast, KNOWN at most, from how many tokens v have each number n."""
        own = ranks["n"].map(pd.Series(self.counts).value_counts()).fillna(0)
        frequent = ranks["n"][(ranks["v"] - own).cumsum() <= KNOWN]
        self.least = int(frequent.min()) if len(frequent) else self.n + 1

    def look_up(self, hashes: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each token; -1 is the count of a token of a shared class."""
        at = np.maximum(rare, 0)
        place = self.below[at] + self.share[at] * ((mix(hashes) >> np.uint64(11)) / float(1 << 53))
        classes = 1 + self.own + np.minimum((place * self.shared).astype(np.int64), self.shared - 1)
        classes[rare < 0] = 0
        counts = np.where(rare < 0, self.end, -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = (self.hashes[at] == hashes) & (rare >= 0)
            classes[known], counts[known] = self.classes[at[known]], self.counts[at[known]]
        return classes, counts


def contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token, nearest first; the end stands before a text."""
    one, two = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts[:-1]] = two[starts[:-1]] = 0
    second = starts[:-1][np.diff(starts) > 1] + 1
    two[second] = 0
    return one, two


class LogBilinear:
    """Class vectors, one matrix for each context position, and biases."""

    def __init__(self, noise: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.noise = noise / noise.sum()
        self.size = len(noise)
        self.r = rng.normal(0, 0.1, (self.size, WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (self.size, WIDTH)).astype(np.float32)
        self.c = np.stack([np.eye(WIDTH), 0.5 * np.eye(WIDTH)]).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.rng, self.seen = rng, 0
        self.squares = {x: np.full_like(getattr(self, x), 1e-10) for x in "rqcb"}

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """One pass of noise-contrastive estimation over some positions; each batch shares its noise words."""
        offset = np.log(NOISE * self.noise).astype(np.float32)
        for low in range(0, len(target), BATCH):
            a, b, w = one[low : low + BATCH], two[low : low + BATCH], target[low : low + BATCH]
            n = len(w)
            drawn = self.rng.choice(self.size, NOISE, p=self.noise)
            x, y = self.r[a], self.r[b]
            p = x @ self.c[0] + y @ self.c[1]
            good = np.einsum("ij,ij->i", p, self.q[w]) + self.b[w] - offset[w]
            bad = p @ self.q[drawn].T + (self.b[drawn] - offset[drawn])
            up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
            down = 1 / (1 + np.exp(-np.clip(bad, -30, 30)))
            dp = up[:, None] * self.q[w] - down @ self.q[drawn]
            dq = np.zeros_like(self.q)
            self._add(dq, w, up[:, None] * p)
            np.add.at(dq, drawn, -(down.T @ p))
            db = np.bincount(w, up, self.size) - np.bincount(drawn, down.sum(0), self.size)
            dr = np.zeros_like(self.r)
            self._add(dr, a, dp @ self.c[0].T)
            self._add(dr, b, dp @ self.c[1].T)
            dc = np.stack((x.T @ dp, y.T @ dp))
            for name, step in (("r", dr), ("q", dq), ("c", dc), ("b", db)):  # Adagrad
                step = (step / n).astype(np.float32)
                self.squares[name] += step * step
                setattr(self, name, getattr(self, name) + RATE * step / np.sqrt(self.squares[name]))
            self.seen += n

    @staticmethod
    def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(at.astype(np.uint16) if len(out) <= 1 << 16 else at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] += np.add.reduceat(rows[order], first, axis=0)

    def flat(self) -> np.ndarray:
        """The parameters and the sums of their squared steps."""
        return np.concatenate([x.ravel() for held in ([self.r, self.q, self.c, self.b], self.squares.values()) for x in held])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for held in (self.__dict__, self.squares):
            for name in ("r", "q", "c", "b"):
                old = held[name]
                held[name] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
                at += old.size

    def near(self) -> np.ndarray:
        """The context vector of the class before a token."""
        return self.r @ self.c[0]

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, y, z with log P(class | one, two) = x[one, class] + y[two, class] - z[one, two]."""
        x, y = self.near() @ self.q.T, (self.r @ self.c[1]) @ self.q.T + self.b
        top = y.max(1, keepdims=True)
        right = np.exp(y - top, dtype=np.float64).T
        z = np.empty((self.size, self.size), np.float32)
        for low in range(0, self.size, 256):
            rows = x[low : low + 256]
            most = rows.max(1, keepdims=True)
            z[low : low + 256] = np.log(np.exp(rows - most, dtype=np.float64) @ right) + most + top.T
        return x, y, z

    def table(self) -> np.ndarray:
        """log10 P(class | one, two) at [one * size + two, class]."""
        x, y, z = self.terms()
        return ((x[:, None] + y[None] - z[:, :, None]) / np.log(10)).reshape(-1, self.size)


def _encode(shared, parts):
    """The replica, key and classes of each document."""

    def run(batches):
        vocabulary = shared.value
        kind = np.uint16 if vocabulary.size <= 1 << 16 else np.uint32
        for batch in batches:
            for rows, data, at in slices(batch):
                hashes, rare, starts = tokens(data, at)
                classes, _ = vocabulary.look_up(hashes, rare)
                raw, edges = classes.astype(kind).tobytes(), starts * kind().itemsize
                keys = np.asarray(rows.column("k"))
                replica = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                text = pa.array([raw[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(replica), pa.array(keys), text], ["replica", "k", "classes"])

    return run


def _class_sizes(shared):
    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            hashes, rare, n = (np.asarray(batch.column(c)) for c in ("h", "rare", "n"))
            classes, _ = vocabulary.look_up(hashes.view(np.uint64), rare.astype(np.int64))
            n = np.bincount(classes, n, vocabulary.size)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["c", "n"])

    return run


def _train(shared):
    """Trains a replica on all its tokens: its parameters in blocks, each with the replica's number of tokens."""

    def run(key, table):
        noise, start = shared.value
        table = table.sort_by("k")
        kind = np.uint16 if len(noise) <= 1 << 16 else np.uint32
        classes = np.frombuffer(b"".join(table.column("classes").to_pylist()), kind).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(classes == 0) + 1))
        model = LogBilinear(noise)
        if start is not None:
            model.set(start)
        model.rng = np.random.default_rng([7, key[0].as_py()])
        one, two = contexts(classes, starts)
        order = model.rng.permutation(len(classes))
        model.train(one[order], two[order], classes[order])
        blocks = np.array_split(model.flat().astype(np.float64), 8)
        return pa.table({"block": pa.array(range(8), pa.int32()), "replica": pa.array([key[0].as_py()] * 8, pa.int64()), "seen": pa.array([model.seen] * 8, pa.int64()), "values": pa.array(blocks, pa.list_(pa.float64()))})

    return run


_BLOCK = "block int, replica long, seen long, values array<double>"


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("replica")
    values = np.average(np.stack(rows["values"].to_list()), axis=0, weights=rows["seen"])
    return pd.DataFrame({"block": rows["block"].iloc[:1], "replica": rows["replica"].iloc[:1], "seen": [rows["seen"].sum()], "values": [values]})


def train_classes(learned: DataFrame, vocabulary: Vocabulary, noise: np.ndarray) -> tuple[LogBilinear, np.ndarray]:
    """The model of classes, from texts with their keys, and how often each shared class follows each class."""
    context, model, shape = learned.sparkSession.sparkContext, LogBilinear(noise), (vocabulary.shared, vocabulary.size)
    if not vocabulary.n:
        return model, np.zeros(shape)
    parts = ROUNDS * max(1, round(vocabulary.n / ROUNDS / PART))
    encoded, start = cut(learned.mapInArrow(_encode(context.broadcast(vocabulary), parts), "replica long, k long, classes binary")), None
    for turn in range(ROUNDS):
        blocks = encoded.where(F.col("replica") % ROUNDS == turn).groupBy("replica").applyInArrow(_train(context.broadcast((noise, start))), _BLOCK)
        left, span = parts // ROUNDS, ROUNDS
        while left > FAN:
            left, span = -(-left // FAN), span * FAN
            blocks = blocks.groupBy("block", F.floor(F.col("replica") / span).alias("_")).applyInPandas(_average, _BLOCK)
        found = blocks.groupBy("block").applyInPandas(_average, _BLOCK).toPandas().sort_values("block")
        if len(found):
            start = np.concatenate([np.asarray(v) for v in found["values"]])
    model.set(start)
    return model, total(encoded.mapInArrow(_after(context.broadcast((vocabulary.own, *shape))), _SUMS), shape)


def spread(v: int) -> int:
    """The number of parts in which v distinct tokens are kept, of about TOKENS each."""
    return max(SPREAD, -(-v // TOKENS))


def _edges(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each token; parts are ranges of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _merged(h: np.ndarray, c: np.ndarray, i: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct tokens by hash (h, c), the number of contexts of each (m), and, token by token, contexts and how often they are seen (i, n)."""
    order = np.argsort(h)
    h = h[order]
    first = _edges(h)
    key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h)))) * size + i[order]
    at = np.argsort(key)
    key = key[at]
    new = _edges(key)
    n = np.add.reduceat(n[order][at], new) if len(new) else n
    key = key[new]
    return h[first], c[order][first], np.bincount(key // size, minlength=len(first)), key % size, n


def _raw(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _numbers(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // count}") if count else np.zeros(0, np.uint8)


_PAIRS = "part int, h binary, c binary, m binary, i binary, n binary"


def _packed(h: np.ndarray, c: np.ndarray, m: np.ndarray, i: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """A line for each part of some merged pairs; numbers in bytes, as a line for each pair costs more than all that is done with it."""
    part, at = _parts(h, parts), np.append(0, np.cumsum(m))
    low = _edges(part)
    high = np.append(low[1:], len(part))
    lines = [[_raw(x[a:b]).tobytes() for x in (c, m)] + [_raw(x[at[a] : at[b]]).tobytes() for x in (i, n)] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    hashes = [h[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    columns = [hashes, *([line[k] for line in lines] for k in range(4))]
    return pa.RecordBatch.from_arrays([pa.array(part[low].astype(np.int32)), *(pa.array(x, pa.binary()) for x in columns)], ["part", "h", "c", "m", "i", "n"])


def _unpacked(h: bytes, c: bytes, m: bytes, i: bytes, n: bytes) -> tuple[np.ndarray, ...]:
    """What `_merged` gives, from a line."""
    h = np.frombuffer(h, np.uint64)
    c, m = (_numbers(x, len(h)).astype(np.int64) for x in (c, m))
    return h, c, m, *(_numbers(x, int(m.sum())).astype(np.int64) for x in (i, n))


def _rows(batch: pa.RecordBatch, names: str):
    return zip(*(batch.column(x).to_pylist() for x in names.split()), strict=True)


def _seen_after(shared, parts: int):
    """How often each token of a shared class comes after each class, merged 2,000,000 tokens at a time."""

    def run(batches):
        vocabulary, held, size = shared.value, [], 0

        def flush():
            h, c, i = (np.concatenate([p[k] for p in held]) for k in range(3))
            return _packed(*_merged(h, c, i, np.ones(len(h), np.int64), vocabulary.size), parts)

        for batch in batches:
            for _, data, at in slices(batch):
                hashes, rare, starts = tokens(data, at)
                classes, counts = vocabulary.look_up(hashes, rare)
                one, _ = contexts(classes, starts)
                left = np.flatnonzero(counts < 0)
                held.append((hashes[left], classes[left], one[left]))
                size += len(left)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge(size: int, parts: int):
    """One line for each part, from lines sorted by part; what is held is merged whenever it has doubled."""

    def run(batches):
        part, held, pairs, least = None, [], 0, 0

        def merged():
            h, c, m, i, n = (np.concatenate([p[k] for p in held]) for k in range(5))
            return _merged(np.repeat(h, m), np.repeat(c, m), i, n, size)

        for batch in batches:
            for p, *line in _rows(batch, "part h c m i n"):
                if held and p != part:
                    yield _packed(*merged(), parts)
                    held, pairs, least = [], 0, 0
                part = p
                held.append(_unpacked(*line))
                pairs += len(held[-1][3])
                if pairs > 1_000_000 + 2 * least:
                    held = [merged()]
                    pairs = least = len(held[0][3])
        if held:
            yield _packed(*merged(), parts)

    return run


def _after(shared):
    """How often each shared class comes after each class, from the classes of documents."""

    def run(batches):
        own, shared_, size = shared.value
        kind, sums = np.uint16 if size <= 1 << 16 else np.uint32, np.zeros(shared_ * size)
        for batch in batches:
            classes = np.frombuffer(b"".join(batch.column("classes").to_pylist()), kind).astype(np.int64)
            one = np.append(0, classes[:-1])[: len(classes)]  # a text begins after an end, of class 0
            left = np.flatnonzero(classes > own)
            sums += np.bincount((classes[left] - own - 1) * size + one[left], minlength=len(sums))
        yield _matrix(sums.reshape(shared_, size))

    return run


_SUMS = "c int, v array<double>"


def _matrix(sums: np.ndarray) -> pa.RecordBatch:
    """A line for each row of sums that isn't all 0."""
    some = np.flatnonzero(sums.any(1))
    lists = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * sums.shape[1]).astype(np.int32)), pa.array(sums[some].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], ["c", "v"])


def _added(batches):
    """Adds up the lines of each row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, v in zip(batch.column("c").to_pylist(), np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1) if batch.num_rows else (), strict=True):
            sums[c] = sums[c] + v if c in sums else v
    if sums:
        width = len(next(iter(sums.values())))
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(sums) + 1) * width).astype(np.int32)), pa.array(np.concatenate(list(sums.values()))))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), lists], ["c", "v"])


def total(lines: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices that came in lines; a row is added up in one task, line by line."""
    out = np.zeros(shape)
    found = lines.repartition("c").mapInArrow(_added, _SUMS).toArrow()
    if found.num_rows:
        out[np.asarray(found.column("c"))] = np.asarray(found.column("v").combine_chunks().flatten()).reshape(-1, shape[1])
    return out


def discriminant(x: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse spread of the context vectors x, each seen as often as `after` says."""
    total = max(1, after.sum())
    mean = after @ x / total
    centred = x - mean
    spread = (centred * after[:, None]).T @ centred / total
    spread += np.eye(x.shape[1]) * (1e-6 + 0.01 * np.trace(spread) / x.shape[1])
    return mean, np.linalg.inv(spread)


def word_vectors(n: np.ndarray, sums: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Vectors, with the bias last, of tokens seen n times with these sums of context vectors; mean and inverse are of each token's class, or of the class of all."""
    off = (sums - n[:, None] * mean) / (n + SHRINK)[:, None]
    vectors = off @ inverse if inverse.ndim == 2 else np.einsum("ij,ijk->ik", off, inverse)
    bias = np.log(n + 1) - ((0.5 * off + mean) * vectors).sum(1)
    return np.concatenate([vectors, bias[:, None]], 1).astype(np.float32)


def exponentials(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each context the sum of exp(vector * x + bias) over some tokens."""
    out, x = np.zeros(len(x)), np.append(x, np.ones((len(x), 1)), 1).astype(np.float32).T
    for low in range(0, len(w), step := max(1, (1 << 17) // x.shape[1])):
        scores = w[low : low + step] @ x
        wide = scores.max() > 80  # near the end of what single floats hold
        out += np.exp(np.minimum(scores, 600), dtype=np.float64 if wide else np.float32).sum(0, dtype=np.float64)
    return out


class Discriminants:
    """Context vectors, and mean and inverse spread of each shared class."""

    def __init__(self, first_shared: int, near: np.ndarray, after: np.ndarray):
        self.first, self.near = first_shared, near
        self.mean, self.inverse = (np.stack(x) for x in zip(*(discriminant(near, a) for a in after), strict=True))

    def by_class(self, c: np.ndarray, n: np.ndarray, sums: np.ndarray):
        """For each class among some tokens: its number among the shared ones, where its tokens are, and their vectors."""
        c = c - self.first
        order = np.argsort(c, kind="stable")
        low = _edges(c[order])
        for a, b in zip(low.tolist(), np.append(low[1:], len(c)).tolist(), strict=True):
            at = order[a:b]
            yield (k := int(c[at[0]])), at, word_vectors(n[at], sums[at], self.mean[k], self.inverse[k])

    def vectors(self, c: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
        out = np.empty((len(c), self.near.shape[1] + 1), np.float32)
        for _, at, w in self.by_class(c, n, sums):
            out[at] = w
        return out


def _runs(batches, near: np.ndarray):
    """From pairs in runs of equal tokens, which may go on in the next batch: c, h, n, one context, whether it is the only one, sum of context vectors."""
    last = None
    for batch in batches:
        c, h, i, n = (np.asarray(batch.column(x)) for x in "chin")
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        some = [c[first], h[first], np.add.reduceat(n, first), i[first], np.maximum.reduceat(i, first) == np.minimum.reduceat(i, first), np.add.reduceat(n[:, None] * near[i], first)]
        if last is not None and last[1][0] == h[0]:
            some[4][0] &= last[4][0] and last[3][0] == some[3][0]
            some[2][0] += last[2][0]
            some[5][0] += last[5][0]
        elif last is not None:
            yield last
        last = [x[-1:].copy() for x in some]
        if len(first) > 1:
            yield [x[:-1] for x in some]
    if last is not None:
        yield last


def _pairs(line, least: int = 0):
    """The pairs of a line, one by one (c, h, i, n), of tokens seen `least` times at least."""
    h, c, m, i, n = _unpacked(*line)
    if least > 1 and len(h):
        keep = np.add.reduceat(n, np.cumsum(m) - m) >= least
        pairs = np.repeat(keep, m)
        h, c, m, i, n = h[keep], c[keep], m[keep], i[pairs], n[pairs]
    h, c = np.repeat(h, m), np.repeat(c, m)
    for low in range(0, len(h), 1 << 18):
        part = slice(low, low + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (c, signed(h), i, n)], list("chin"))


def _vectors(shared, least: int):
    """Lines of tokens seen `least` times at least, with their vectors."""

    def run(batches):
        fitted = shared.value
        for c, h, n, _, _, sums in _runs((x for batch in batches for line in _rows(batch, "h c m i n") for x in _pairs(line, least)), fitted.near):
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(c) + 1) * (WIDTH + 1)).astype(np.int32)), pa.array(fitted.vectors(c, n, sums).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(h), pa.array(n), lists], ["c", "h", "n", "w"])

    return run


def _exponentials(shared):
    """The sums of each class of a task's tokens."""

    def run(batches):
        fitted = shared.value
        sums = np.zeros((len(fitted.mean), len(fitted.near)))
        for c, _, n, _, _, seen in _runs((x for batch in batches for line in _rows(batch, "h c m i n") for x in _pairs(line)), fitted.near):
            for k, _, w in fitted.by_class(c, n, seen):
                sums[k] += exponentials(fitted.near, w)
        yield _matrix(sums)

    return run


def fit_words(learned: DataFrame, vocabulary: Vocabulary, near: np.ndarray, after: np.ndarray) -> tuple[DataFrame, Discriminants, np.ndarray]:
    """How often each token of a shared class follows each class (a line for each part of the tokens, see `_packed`), the discriminants of the classes, and
    for each class and class before the logarithm of the sum of exponentials over its tokens and the unknown one. after: how often each shared class follows each class.

    Only these numbers are kept: most tokens have one context, so vectors take more room than what they follow from."""
    context, parts = learned.sparkSession.sparkContext, spread(vocabulary.v)
    pairs = learned.select("text").mapInArrow(_seen_after(context.broadcast(vocabulary), parts), _PAIRS)
    pairs = cut(pairs.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(vocabulary.size, parts), _PAIRS), 1)
    fitted = Discriminants(1 + vocabulary.own, near, after)
    z = np.zeros((vocabulary.size, vocabulary.size))
    z[1 + vocabulary.own :] = np.log1p(total(pairs.mapInArrow(_exponentials(context.broadcast(fitted)), _SUMS), after.shape))
    return pairs, fitted, z.astype(np.float32)


def word_lines(pairs: DataFrame, fitted: Discriminants, least: int = 0) -> DataFrame:
    """For each token of a shared class that is seen `least` times at least its class, hash, number and vector."""
    return pairs.mapInArrow(_vectors(pairs.sparkSession.sparkContext.broadcast(fitted), least), "c int, h long, n long, w array<float>")


class Finder:
    """Finds hashes among sorted distinct ones, from where each range of hashes starts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(62 - min(24, len(hashes).bit_length()))
        self.first = np.searchsorted(hashes, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(hashes)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some hashes are there, in order, and where."""
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        place = np.full(len(hashes), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.hashes[at[left]] == hashes[left]
            place[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        some = np.flatnonzero(place >= 0)
        return some, place[some]


class Scorer:
    """The models with the vectors of the most frequent tokens of shared classes."""

    def __init__(self, vocabulary: Vocabulary, model: LogBilinear, top: pa.Table, z: np.ndarray):
        self.vocabulary, self.model, self.name = vocabulary, model, uuid.uuid4().hex
        h, n, w = (top.column(c).combine_chunks() for c in ("h", "n", "w"))
        hashes = np.asarray(h).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], np.asarray(n)[order]
        self.w = np.asarray(w.flatten()).reshape(-1, WIDTH + 1)[order]
        self.z = z

    def score(self, data: np.ndarray, at: np.ndarray):
        """Of each token its hash, the class before, the count (-1: to be joined), and its log10 probability, without the token's own score where it is to be joined."""
        if self.name not in _models:
            _models.clear()
            _models[self.name] = (*self.model.terms(), self.model.near(), Finder(self.hashes))
        x, y, z, near, finder = _models[self.name]
        hashes, rare, starts = tokens(data, at)
        classes, counts = self.vocabulary.look_up(hashes, rare)
        one, two = contexts(classes, starts)
        log = (x[one, classes] + y[two, classes] - z[one, two]).astype(np.float64) - self.z[classes, one]
        left = np.flatnonzero(counts < 0)
        some, place = finder.find(hashes[left])
        known = left[some]
        counts[known] = self.counts[place]
        log[known] += np.einsum("ij,ij->i", near[one[known]], self.w[place, :-1]) + self.w[place, -1]
        return hashes, one, counts, log / np.log(10), starts


_LINES = "part int, h binary, i binary, keys binary, k long, doc_id {}, n_tokens long, n_known long, base double, log double"
_JOINED = "k long, doc_id {}, n_tokens long, n_known long, base double, log double"


def _score(shared, parts: int):
    """For each row one line of sums (k: its key), and for each part of the tokens lines of those whose scores must be joined: hashes, classes before and keys."""

    def run(batches):
        scorer, held, size = shared.value, [], 0

        def flush(kind):
            h, i, keys = (np.concatenate([p[k] for p in held]) for k in range(3))
            order = np.argsort(h)
            h, i, keys = h[order], i[order], keys[order]
            part = _parts(h, parts)
            low = _edges(part)
            columns = [[(_raw(x[a:b]) if x is i else x[a:b]).tobytes() for a, b in zip(low.tolist(), np.append(low[1:], len(h)).tolist(), strict=True)] for x in (h, i, keys)]
            return _filled({"part": pa.array(part[low].astype(np.int32)), **{name: pa.array(x, pa.binary()) for name, x in zip(("h", "i", "keys"), columns, strict=True)}}, kind)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for rows, data, at in slices(batch):
                hashes, one, counts, log, starts = scorer.score(data, at)
                own = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 1.0), 0)
                base, log, known = (np.add.reduceat(x, starts[:-1]) for x in (own, log, (counts > 0).astype(np.int64)))
                keys, n = np.asarray(rows.column("k")), np.diff(starts)
                part = _parts(mix(keys.view(np.uint64)), parts).astype(np.int32)
                yield _filled({"part": pa.array(part), "k": rows.column("k"), "doc_id": rows.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known), "base": pa.array(base), "log": pa.array(log)}, kind)
                left = np.flatnonzero(counts < 0)
                held.append((hashes[left], one[left], np.repeat(keys, n)[left]))
                size += len(left)
                if size > 2_000_000:
                    yield flush(kind)
                    held, size = [], 0
        if size:
            yield flush(kind)

    return run


def _filled(columns: dict[str, pa.Array], kind: pa.DataType) -> pa.RecordBatch:
    """A batch with the columns of _LINES; those that aren't given are null."""
    kinds = {"part": pa.int32(), "h": pa.binary(), "i": pa.binary(), "keys": pa.binary(), "k": pa.int64(), "doc_id": kind, "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "log": pa.float64()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, t) for x, t in kinds.items()], list(kinds))


def _joined(shared):
    """The sums of rows, and those of joined tokens, summed by key; an unknown token's are 0. Of each part, its pairs come first."""

    def run(batches):
        fitted, part, held, size = shared.value, None, [], 0

        def flush(kind):
            k, base, log = (np.concatenate([p[j] for p in held]) for j in range(3))
            order = np.argsort(k)
            k = k[order]
            first = _edges(k)
            n = np.diff(np.append(first, len(k)))
            base, log = (np.add.reduceat(x[order], first) for x in (base, log))
            m = len(first)
            return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.array(n), pa.array(base), pa.array(log)], ["k", "doc_id", "n_tokens", "n_known", "base", "log"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            docs = batch.filter(batch.column("k").is_valid())
            if docs.num_rows:
                yield docs.select(["k", "doc_id", "n_tokens", "n_known", "base", "log"])
            for p, h, c, m, i, n, keys in _rows(batch.filter(batch.column("h").is_valid()), "part h c m i n keys"):
                if keys is None:
                    part = p
                    runs = [(x[1], x[2], fitted.vectors(x[0], x[2], x[5])) for x in _runs(_pairs((h, c, m, i, n)), fitted.near)]
                    hashes, counts, w = (np.concatenate([x[k] for x in runs]) for k in range(3))
                    hashes = hashes.view(np.uint64)
                elif p == part:
                    h = np.frombuffer(h, np.uint64)
                    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    some = np.flatnonzero(hashes[place] == h)
                    place = place[some]
                    if len(some):
                        log = (np.einsum("ij,ij->i", fitted.near[_numbers(i, len(h))[some]], w[place, :-1]) + w[place, -1]) / np.log(10)
                        held.append((np.frombuffer(keys, np.int64)[some], np.log10(counts[place] + 1.0), log))
                        size += len(some)
                        if size > 1_000_000:
                            yield flush(kind)
                            held, size = [], 0
        if size:
            yield flush(kind)

    return run


def fit(learned: DataFrame) -> tuple[Vocabulary, LogBilinear, DataFrame, Discriminants, np.ndarray]:
    """Vocabulary, model of classes, and the words in their classes (see `fit_words`), from texts with their keys (k)."""
    context = learned.sparkSession.sparkContext
    counts = cut(learned.select("text").mapInArrow(_count, "h long, rare int, n long").groupBy("h").agg(F.min("rare").alias("rare"), F.sum("n").alias("n")))
    totals = counts.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    top = counts.where("rare >= 0").orderBy(F.desc("n"), "h").limit(Vocabulary.sizes(int(totals["v"].sum()))[0]).toPandas()
    vocabulary = Vocabulary(top, totals)
    sizes = counts.mapInArrow(_class_sizes(context.broadcast(vocabulary)), "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    noise = np.ones(vocabulary.size)
    noise[sizes["c"].to_numpy(np.int64)] += sizes["n"]
    # No more than KNOWN different numbers can matter.
    ranks = counts.where("rare >= 0").groupBy("n").agg(F.count("*").alias("v")).orderBy(F.desc("n")).limit(KNOWN + vocabulary.own).toPandas()
    vocabulary.broadcast_from(ranks)
    model, after = train_classes(learned, vocabulary, noise)
    return vocabulary, model, *fit_words(learned, vocabulary, model.near().astype(np.float64), after)


def score(docs: DataFrame, train: Column) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, n_known (tokens that occur in training), train_tokens, base_score (log10 of the add-one unigram
    probability) and score (the model's log10 probability of the text)."""
    context = docs.sparkSession.sparkContext
    vocabulary, model, pairs, fitted, z = fit(docs.where(train).select(row_key().alias("k"), "text"))
    top = word_lines(pairs, fitted, vocabulary.least)
    scorer, parts = Scorer(vocabulary, model, top.select("h", "n", "w").toArrow(), z), spread(vocabulary.v)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = docs.select(row_key().alias("k"), "doc_id", "text").mapInArrow(_score(context.broadcast(scorer), parts), _LINES.format(kind))
    both = pairs.unionByName(lines, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.col("keys").isNotNull())
    joined = both.mapInArrow(_joined(context.broadcast(fitted)), _JOINED.format(kind))
    sums = joined.groupBy("k").agg(F.count("n_tokens").alias("rows"), F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base", "log")))
    # Equal rows have one key: their sums are divided, and each gets its line.
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    base = F.col("base") / F.col("rows") - F.col("n_tokens") * F.lit(float(np.log10(vocabulary.n + vocabulary.v + 1.0)))
    return each.select("doc_id", "n_tokens", (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log") / F.col("rows")).alias("score"))
