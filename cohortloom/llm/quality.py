"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents whose label is 1, at most SAMPLE of them; the unlabelled set is all distinct texts, whose labels aren't used. With the class
prior pi, a one-layer network f minimises pi * R_p(f = 1) + max(0, R_u(f = 0) - pi * R_p(f = 0)), with the logistic loss; where the bracket is
negative, the step goes against it, as in the published algorithm. The prior is estimated first: for a classifier of positives against
unlabelled texts, the smallest ratio of the shares of held-back unlabelled texts and positives above a threshold, from a histogram of the logits of all
held-back texts. Scores are given at even odds: the log-odds of the prior are taken off the logit.

Features of a text: shares of byte values, of word lengths and of capitalised words, mean word length, distinct words, repeated lines, and length.
They are computed on whole texts by vectorised numpy, and kept in half precision for learning. Texts are dealt by hash to replicas of about PART; in each of ROUNDS
rounds every replica starts from the last average and takes STEPS steps or a pass, whichever is more, and the replicas are averaged, FAN at a time. The result doesn't
depend on the partitions.

Null or empty texts have all-zero features and get the score of those. Without positives every score is 0.5. Rows that repeat are scored one by one, equal texts
alike; for learning, copies of a text count once. Very long texts are read whole. An empty table gives an empty result. Other columns stay in the struct `row`,
so that none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, adding, cut, packed, slices
from .labelled import Adam, sample_labels, sigmoid

SAMPLE, HIDDEN = 4000, 16
PART, ROUNDS, STEPS, BATCH, FAN = 16_384, 4, 250, 256, 64
#: Logits of held-back texts are counted in so many bins between -EDGE and EDGE.
BINS, EDGE = 4000, 20.0
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _distinct_share(words: Words, hashes: np.ndarray) -> np.ndarray:
    n, doc = len(words.counts), words.of()
    order = np.lexsort((hashes, doc))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.bincount(doc[order][new], minlength=n) / np.maximum(1, words.counts)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row for each text."""
    n, size = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n), size)
    bytes_ = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(1, size)[:, None]
    words, lines = Words(data, at), Words(data, at, _LINE)
    own, count = words.of(), np.maximum(1, words.counts)[:, None]
    length = words.ends - words.starts
    lengths = np.bincount(own * 24 + np.minimum(length, 24) - 1, minlength=n * 24).reshape(n, 24) / count if n else np.zeros((0, 24))
    first, last = data[words.starts], data[words.ends - 1]
    capital = (first >= 65) & (first <= 90)
    caps = capital & (last >= 65) & (last <= 90) | (last == 33)
    shares = np.stack([np.bincount(own, x, n) for x in (capital, caps, length)], 1) / count if n else np.zeros((0, 3))
    rest = np.stack([_distinct_share(words, words.hashes()), _distinct_share(lines, lines.hashes()), np.log1p(words.counts)], 1)
    return np.concatenate([np.sqrt(bytes_), lengths, shares, rest], 1).astype(np.float32)


def _featurise(batches):
    for batch in batches:
        for rows, data, at in slices(batch):
            x = features(data, at).astype("<f2")
            yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array([r.tobytes() for r in x], pa.binary())], ["k", "x"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(len(column), -1).astype(np.float64)


class Network:
    """Standardised features, one hidden layer of tanh, one logit."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.shift = mean, 1 / (std + 1e-3), 0.0
        self.p = {"w": rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.25, HIDDEN), "c": np.zeros(1)}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for name, old in self.p.items():
            self.p[name] = np.array(flat[at : at + old.size]).reshape(old.shape)
            at += old.size

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -5, 5)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p["w"] + self.p["b"]) @ self.p["v"] + self.p["c"]

    def gradient(self, z: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss whose derivative by each row's logit is d, with weight decay."""
        h = np.tanh(z @ self.p["w"] + self.p["b"])
        dh = d[:, None] * self.p["v"] * (1 - h * h)
        return {"w": z.T @ dh + 1e-3 * self.p["w"], "b": dh.sum(0), "v": h.T @ d + 1e-3 * self.p["v"], "c": d.sum(keepdims=True)}


def learn(net: Network, p: np.ndarray, u: np.ndarray, prior: float | None, seed: list[int]) -> None:
    """Steps of non-negative PU learning, or of positives against unlabelled rows where no prior is given."""
    zp, zu, rng, done = net.standard(p), net.standard(u), np.random.default_rng(seed), 0
    adam, steps = Adam(net.p, 0.003), max(1, -(-len(u) // BATCH))
    while done < STEPS:
        b = rng.permutation(len(zu))
        for i in range(steps):
            x, y = zp[rng.integers(0, len(zp), min(len(zp), BATCH))], zu[b[i * len(b) // steps : (i + 1) * len(b) // steps]]
            fx, fy = sigmoid(net.logits(x)), sigmoid(net.logits(y))
            both = np.concatenate([x, y])
            done += 1
            if prior is None:
                adam.step(net.gradient(both, np.concatenate([(fx - 1) / len(x), fy / len(y)])))
                continue
            bracket = -np.log(1 - fy + 1e-9).mean() + prior * np.log(1 - fx + 1e-9).mean()
            dx, dy = -prior * fx / len(x), fy / len(y)
            if bracket < 0:
                dx, dy = -dx, -dy
            else:
                dx = dx + prior * (fx - 1) / len(x)
            adam.step(net.gradient(both, np.concatenate([dx, dy])))


_SUMS = "part long, n long, values array<double>"


def _sums(key, table):
    x = _matrix(table.column("x"))
    return _row(key[0].as_py(), len(x), np.concatenate([x.mean(0), (x * x).mean(0)]))


def _row(part: int, n: int, values: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()), "values": pa.array([values], pa.list_(pa.float64()))})


def _replica(shared):
    def run(key, table):
        net, flat, p, prior, turn = shared.value
        net.set(flat)
        part = key[0].as_py()
        learn(net, p, _matrix(table.sort_by("k").column("x")), prior, [turn, part])
        return _row(part, table.num_rows, net.flat())

    return run


def _mean(key, table):
    values = np.stack(table.sort_by("part").column("values").to_pylist())
    n = np.asarray(table.sort_by("part").column("n"))
    return _row(table.column("part")[0].as_py() // FAN, int(n.sum()), np.average(values, axis=0, weights=n))


def averaged(rows: DataFrame, parts: int) -> np.ndarray | None:
    """The weighted mean of the values of all parts: FAN at a time, then of what is left."""
    while parts > FAN:
        rows = rows.groupBy(F.floor(F.col("part") / FAN).alias("_")).applyInArrow(_mean, _SUMS)
        parts = -(-parts // FAN)
    found = rows.groupBy(F.lit(0).alias("_")).applyInArrow(_mean, _SUMS).collect()
    return np.array(found[0]["values"]) if found else None


def _histogram(shared):
    """How many held-back texts have their logit in each bin."""

    def run(batches):
        net, count = shared.value, np.zeros(BINS, np.int64)
        for batch in batches:
            if batch.num_rows:
                count += np.bincount(_bin(net.logits(net.standard(_matrix(pa.chunked_array([batch.column("x")]))))), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count).astype(np.int32)), pa.array(count[count > 0])], ["bin", "n"])

    return run


def _bin(logits: np.ndarray) -> np.ndarray:
    return ((np.clip(logits, -EDGE, EDGE - 1e-9) + EDGE) * (BINS / (2 * EDGE))).astype(np.int64)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the counts of both in bins of their logits; at least 0.05 of the positives lie above each
    threshold that is tried."""
    above = lambda x: np.cumsum(x[::-1])[::-1] / max(1, x.sum())
    qp, qu = above(p), above(u)
    tried = np.flatnonzero(qp >= 0.05)
    if not len(tried) or not u.sum():
        return 0.5
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(u.sum()) + 1 / np.sqrt(p.sum()))
    best = tried[np.argmin((qu[tried] + slack) / qp[tried])]
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Network | None:
    """Learns from the positives among the labels that `train` (a condition on doc_id) allows, and from all unlabelled texts."""
    spark, schema = docs.sparkSession.sparkContext, "k long, x binary"
    positives = sample_labels(docs, labels, "quality", train, sample).where("y = 1").select(F.xxhash64("text").alias("k"), "text")
    p = positives.mapInArrow(_featurise, schema).orderBy("k", "x").toArrow()
    if not p.num_rows:
        return None
    p = _matrix(p.column("x"))[np.random.default_rng(1).permutation(p.num_rows)]
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text").mapInArrow(_featurise, schema)
    rows = cut(texts.groupBy("k").agg(F.min("x").alias("x")))  # copies count once
    parts = max(1, round(rows.count() / PART))
    rows = rows.withColumn("part", F.pmod(F.shiftright("k", 8), F.lit(parts)))
    moments = averaged(rows.groupBy("part").applyInArrow(_sums, _SUMS), parts)
    mean, square = np.split(moments, 2)
    net = Network(mean, np.sqrt(np.maximum(0, square - mean * mean)))

    def train_on(of: DataFrame, positive: np.ndarray, prior: float | None, rounds: int) -> None:
        flat = net.flat()
        for turn in range(rounds):
            found = averaged(of.groupBy("part").applyInArrow(_replica(spark.broadcast((net, flat, positive, prior, turn))), _SUMS), parts)
            flat = flat if found is None else found
        net.set(flat)

    half, start = len(p) // 2, net.flat()
    prior = 0.5
    if half:
        back = F.pmod("k", F.lit(2)) == 1
        train_on(rows.where(~back), p[:half], None, 2)
        counted = rows.where(back).select("x").mapInArrow(_histogram(spark.broadcast(net)), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
        u = np.zeros(BINS, np.int64)
        for r in counted:
            u[r["bin"]] = r["n"]
        prior = estimate_prior(np.bincount(_bin(net.logits(net.standard(p[half:]))), minlength=BINS), u)
        net.set(start)
    train_on(rows, p, prior, ROUNDS)
    net.shift = float(np.log(prior / (1 - prior)))
    return net


def _score(shared):
    def run(batches):
        net = shared.value
        for batch in batches:
            for rows, data, at in slices(batch):
                scores = np.full(rows.num_rows, 0.5) if net is None else sigmoid(net.logits(net.standard(features(data, at))) - net.shift)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores.astype(np.float64))], [*rows.schema.names, "score"])

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """row (a struct of docs' other columns) and text with score: higher where the label 1 is likelier."""
    rows = packed(docs).drop("k")
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(net)), adding(rows, "score double"))
