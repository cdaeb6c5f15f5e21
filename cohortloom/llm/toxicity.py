"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, trained and run in numpy.

Words `[^\\x20\\x09-\\x0D]+` are lower-cased (A-Z). A word's input is its vector by a hash to 2**15 places beside the mean of the vectors of its byte 4-grams
(hashed to 2**15 places; the word is framed). A place of no labelled document counts as place 0; log-odds of rare ones are shrunk. All overlapping windows of WINDOW words, one from every word that has WINDOW - 1
behind it (a shorter text is one window), are scored: gated recurrences in both directions, attention over the words of the window, one logit. A document's score is that of its largest window.

Labels say which documents are toxic, not where, so learning is multi-instance: the vectors start with the log-odds of words and 4-grams among
labelled documents, a toxic document stands for its window of largest evidence - later, of largest logit -, clean documents for their largest
and for random windows, and all weights and vectors are trained by backpropagation. At most SAMPLE documents of each label are learned from.

Null or empty texts have one empty window. Without labels of both kinds every score is 0.5. Rows that repeat are scored one by one, equal texts alike; of rows
that repeat a doc_id one text is learned from. Very long texts have all their windows scored, CHUNK at a time. Ties between windows change no score; in learning, lots decide between them. An empty table gives an
empty result. Other columns stay in the struct `row`, so that none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ._text import LOWER, Words, adding, mix, packed, slices, word_hashes
from .labelled import Adam, sample_labels, sigmoid

SAMPLE, WINDOW, CHUNK = 1500, 16, 4096
WORDS, GRAMS = 1 << 15, 1 << 15
WIDTH, UNITS, ROUNDS, EPOCHS = 4, 8, 2, 4


class Tokens:
    """Distinct words of some texts (place by hash, places of 4-grams) and the windows over them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = LOWER[data]
        words = Words(data, at)
        hashes = word_hashes(data, words.starts, words.ends)
        _, first, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.places = (hashes[first] >> np.uint64(20)).astype(np.int64) % WORDS
        starts, size = words.starts[first], words.ends[first] - words.starts[first]
        self.gram_at = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(self.gram_at[-1]) - np.repeat(self.gram_at[:-1], size)
        byte = np.repeat(starts, size) + inside
        left = np.where(inside > 0, data[np.maximum(byte - 1, 0)], 1).astype(np.uint64)
        right = np.where(inside < np.repeat(size, size) - 1, data[np.minimum(byte + 1, max(0, len(data) - 1))] if len(data) else 0, 2).astype(np.uint64)
        next_ = np.where(inside < np.repeat(size, size) - 2, data[np.minimum(byte + 2, max(0, len(data) - 1))] if len(data) else 0, 3).astype(np.uint64)
        codes = (left << np.uint64(24)) | (data[byte].astype(np.uint64) << np.uint64(16)) | (right << np.uint64(8)) | next_
        self.grams = (mix(codes) >> np.uint64(40)).astype(np.int64) % GRAMS
        # Windows: one from each word with WINDOW - 1 behind it, one at least.
        counts = np.maximum(1, words.counts - (WINDOW - 1))
        self.doc, self.word_doc = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(counts)), words.counts)
        self.of = np.concatenate(([0], np.cumsum(counts)))
        self.start = words.doc[self.doc] + np.arange(len(self.doc)) - self.of[self.doc]
        self.end = np.minimum(self.start + WINDOW, words.doc[self.doc + 1])

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of some windows, and which of their places hold one."""
        place = self.start[rows, None] + np.arange(WINDOW)
        mask = place < self.end[rows, None]
        return np.where(mask, self.ids[np.minimum(place, max(0, len(self.ids) - 1))] if len(self.ids) else 0, 0), mask

    def largest(self, values: np.ndarray) -> np.ndarray:
        """Of each window the largest value of its words; -9 without words."""
        padded, out = np.concatenate([values, np.full(WINDOW, -9, values.dtype)]), np.full(len(self.start), -9, values.dtype)
        for t in range(WINDOW):
            np.maximum(out, np.where(self.start + t < self.end, padded[self.start + t], -9), out=out)
        return out

    def known(self, words: np.ndarray, grams: np.ndarray) -> None:
        """Places that aren't marked become place 0."""
        self.places, self.grams = np.where(words[self.places], self.places, 0), np.where(grams[self.grams], self.grams, 0)

    def flat(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the 4-grams of some distinct words are, and how many each has."""
        size = np.diff(self.gram_at)[used]
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.gram_at[:-1][used], size), size

    def inputs(self, p: dict[str, np.ndarray], used: np.ndarray) -> np.ndarray:
        """The input vectors of some distinct words."""
        if not len(self.places):
            return np.zeros((1, 2 * WIDTH), np.float32)
        at, size = self.flat(used)
        grams = np.add.reduceat(p["g"][self.grams[at]], np.cumsum(size) - size, axis=0) / size[:, None]
        return np.concatenate([p["e"][self.places[used]], grams], 1).astype(np.float32)


def _gru(x: np.ndarray, ids: np.ndarray, mask: np.ndarray, p: dict, side: str, keep: bool):
    """States after each step; x: inputs of the distinct words. side: 'f' forward, 'b' backward."""
    gates = x @ p[side + "x"] + p[side + "c"]
    wh = p[side + "h"]
    h, states, cache = np.zeros((len(ids), UNITS), np.float32), np.zeros((*ids.shape, UNITS), np.float32), []
    for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
        g, m = gates[ids[:, t]], mask[:, t, None]
        zr = sigmoid(g[:, : 2 * UNITS] + h @ wh[:, : 2 * UNITS])
        z, r = zr[:, :UNITS] * m, zr[:, UNITS:]
        n = np.tanh(g[:, 2 * UNITS :] + (r * h) @ wh[:, 2 * UNITS :])
        if keep:
            cache.append((t, h, z, r, n, m))
        h = h + z * (n - h)
        states[:, t] = h
    return states, cache


def _gru_back(d: np.ndarray, cache: list, p: dict, side: str, grad: dict) -> np.ndarray:
    """Gradient by the gates' inputs, given that by the states."""
    wh, dh, out = p[side + "h"], np.zeros(d[:, 0].shape, np.float32), np.zeros((*d.shape[:2], 3 * UNITS), np.float32)
    for t, h, z, r, n, m in reversed(cache):
        dh = dh + d[:, t]
        dn = dh * z * (1 - n * n)
        drh = dn @ wh[:, 2 * UNITS :].T
        dz = dh * (n - h) * z * (1 - z) * m
        dr = drh * h * r * (1 - r)
        out[:, t] = np.concatenate([dz, dr, dn], 1)
        grad[side + "h"] += np.concatenate([h.T @ np.concatenate([dz, dr], 1), (r * h).T @ dn], 1)
        dh = dh * (1 - z) + drh * r + np.concatenate([dz, dr], 1) @ wh[:, : 2 * UNITS].T
    return out


class Network:
    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.p = {"e": normal(WORDS, WIDTH) / 3, "g": normal(GRAMS, WIDTH) / 3, "aw": normal(2 * UNITS, UNITS), "ab": np.zeros(UNITS, np.float32), "av": normal(UNITS), "o": normal(2 * UNITS), "c": np.full(1, -1, np.float32)}
        self.p["e"][:, 0], self.p["g"][:, 0] = words, grams
        for side in "fb":
            self.p |= {side + "x": normal(2 * WIDTH, 3 * UNITS), side + "h": normal(UNITS, 3 * UNITS), side + "c": np.zeros(3 * UNITS, np.float32)}

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """A logit for each window."""
        p = self.p
        f, fc = _gru(x, ids, mask, p, "f", keep)
        b, bc = _gru(x, ids, mask, p, "b", keep)
        s = np.concatenate([f, b], 2)
        u = np.tanh(s @ p["aw"] + p["ab"])
        e = np.where(mask, u @ p["av"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True)) * mask
        a = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,ntk->nk", a, s)
        return pooled @ p["o"] + p["c"], (fc, bc, s, u, a, pooled) if keep else None

    def gradient(self, tokens: Tokens, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (ids, mask) = self.p, tokens.windows(rows)
        used, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(mask.shape)
        x = tokens.inputs(p, used)
        logits, (fc, bc, s, u, a, pooled) = self.forward(x, ids, mask, True)
        d = ((sigmoid(logits) - y) / len(y)).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["o"], grad["c"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["o"]
        da = np.einsum("nk,ntk->nt", dp, s)
        de = a * (da - (a * da).sum(1, keepdims=True))
        du = de[:, :, None] * p["av"] * (1 - u * u)
        grad["av"], grad["aw"], grad["ab"] = np.einsum("nt,ntk->k", de, u), np.einsum("ntk,ntj->kj", s, du), du.sum((0, 1))
        ds = a[:, :, None] * dp[:, None, :] + du @ p["aw"].T
        dx = np.zeros(x.shape, np.float32)
        for side, part, cache in (("f", ds[:, :, :UNITS], fc), ("b", ds[:, :, UNITS:], bc)):
            dg = _gru_back(part, cache, p, side, grad)
            by_word = np.zeros((len(x), 3 * UNITS), np.float32)
            np.add.at(by_word, ids.ravel(), dg.reshape(-1, 3 * UNITS))
            grad[side + "x"], grad[side + "c"] = x.T @ by_word, by_word.sum(0)
            dx += by_word @ p[side + "x"].T
        if len(tokens.places):
            np.add.at(grad["e"], tokens.places[used], dx[:, :WIDTH])
            at, size = tokens.flat(used)
            np.add.at(grad["g"], tokens.grams[at], np.repeat(dx[:, WIDTH:] / size[:, None], size, axis=0))
        return grad

    def sliding(self, gates: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """The logits of the windows from every word but the last WINDOW - 1; gates: of the distinct words, forward and backward. Values lie by
        unit, then window, so that a step of all windows is a shifted view, and a chunk stays in the cache."""
        p, n = self.p, len(ids) - WINDOW + 1
        states = np.empty((WINDOW, 2 * UNITS, n), np.float32)
        for k, side in enumerate("fb"):
            g, wh = np.ascontiguousarray(gates[k][ids].T), p[side + "h"].T
            np.clip(-g[: 2 * UNITS], -80, 80, out=g[: 2 * UNITS])  # beyond, a gate is 0 or 1 in any case
            both, last = -wh[: 2 * UNITS], np.ascontiguousarray(wh[2 * UNITS :])
            h = np.zeros((UNITS, n), np.float32)
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                zr = both @ h
                zr += g[: 2 * UNITS, t : t + n]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new = last @ (zr[UNITS:] * h)
                new += g[2 * UNITS :, t : t + n]
                np.tanh(new, out=new)
                new -= h
                new *= zr[:UNITS]
                h = np.add(h, new, out=states[t, k * UNITS : (k + 1) * UNITS])
        u = np.matmul(np.ascontiguousarray(p["aw"].T), states)
        u += p["ab"][:, None]
        e = p["av"] @ np.tanh(u, out=u)
        e = np.exp(e - e.max(0))
        return (e * (p["o"] @ states)).sum(0) / e.sum(0) + p["c"]

    def logits(self, tokens: Tokens) -> np.ndarray:
        """Of every window."""
        x, n = tokens.inputs(self.p, np.arange(len(tokens.places))), len(tokens.ids)
        gates = [x @ self.p[side + "x"] + self.p[side + "c"] for side in "fb"]
        full = tokens.end - tokens.start == WINDOW
        out, short = np.empty(len(full), np.float32), np.flatnonzero(~full)
        for low in range(0, len(short), CHUNK):
            out[short[low : low + CHUNK]] = self.forward(x, *tokens.windows(short[low : low + CHUNK]))[0]
        full = np.flatnonzero(full)
        start = tokens.start[full]
        for low in range(0, n, CHUNK):
            i, j = np.searchsorted(start, (low, low + CHUNK))
            if i < j:
                out[full[i:j]] = self.sliding(gates, tokens.ids[low : low + CHUNK + WINDOW - 1])[start[i:j] - low]
        return out


def _log_odds(tokens: Tokens, y: np.ndarray, places: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of documents that hold a place, toxic against clean, and whether it is known; places belong to the distinct words in owner."""
    n = len(tokens.places)
    doc, word = np.divmod(np.unique(tokens.word_doc * n + tokens.ids), max(1, n))
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(n + 1))
    count = np.diff(at)[word]
    flat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1][word], count)
    doc, place = np.divmod(np.unique(np.repeat(doc, count) * size + places[order][flat]), size)
    one, zero = (np.bincount(place[y[doc] == v], minlength=size) for v in (1, 0))
    odds = np.log((one + 0.2) / (max(1, (y == 1).sum()) + 1)) - np.log((zero + 0.2) / (max(1, (y == 0).sum()) + 1))
    known = one + zero > 0
    known[0] = False
    return np.where(known, odds * (one + zero) / (one + zero + 5.0), 0).astype(np.float32), known


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Network | None:
    """Learns from labels that `train` (a condition on doc_id) allows."""
    rows = sorted((r["text"] or "", r["y"]) for r in sample_labels(docs, labels, "toxic", train, sample).collect())
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    raw = [r[0].encode() for r in rows]
    tokens = Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    words, known_words = _log_odds(tokens, y, tokens.places, np.arange(len(tokens.places)), WORDS)
    grams, known_grams = _log_odds(tokens, y, tokens.grams, np.repeat(np.arange(len(tokens.places)), np.diff(tokens.gram_at)), GRAMS)
    net, rng = Network(words, grams), np.random.default_rng(2)
    net.known = known_words, known_grams
    tokens.known(*net.known)
    evidence = tokens.inputs(net.p, np.arange(len(tokens.places)))
    merit = tokens.largest((evidence[:, 0] + evidence[:, WIDTH])[tokens.ids] if len(tokens.ids) else np.zeros(0, np.float32))
    adam = Adam(net.p, 0.01)
    for _ in range(ROUNDS):
        order = np.lexsort((rng.random(len(merit)), merit, tokens.doc))
        top = order[tokens.of[1:] - 1]
        some = [tokens.of[:-1] + rng.integers(0, np.diff(tokens.of)) for _ in range(3)]
        rows_ = np.concatenate([top, *(s[y == 0] for s in some)])
        target = np.concatenate([y, np.zeros(3 * (y == 0).sum(), np.int64)])
        for _ in range(EPOCHS):
            turn = rng.permutation(len(rows_))
            for low in range(0, len(turn), 128):
                adam.step(net.gradient(tokens, rows_[turn[low : low + 128]], target[turn[low : low + 128]]))
        merit = net.logits(tokens)
    return net


def _score(shared):
    def run(batches):
        net = shared.value
        for batch in batches:
            for rows, data, at in slices(batch, limit=1 << 20):
                scores = np.full(rows.num_rows, 0.5)
                if net is not None:
                    tokens = Tokens(data, at)
                    tokens.known(*net.known)
                    scores = sigmoid(np.maximum.reduceat(net.logits(tokens), tokens.of[:-1]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], [*rows.schema.names, "score"])

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """row (a struct of docs' other columns) and text with score: higher where the label 1 is likelier."""
    rows = packed(docs).drop("k")
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(net)), adding(rows, "score double"))
