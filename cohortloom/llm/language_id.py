"""Language identification with blended-spectrum string kernels, Nystrom landmarks and kernel ridge regression.

The kernel of two texts is the mean over n = 1..3 of the cosine between their n-gram presence vectors (byte
n-grams of the lower-cased text; trigrams are hashed to 2**16 places). A bounded sample of labelled documents gives the landmarks; texts are mapped to
the Nystrom features k(x, landmarks) K^(-1/2), and a ridge regression against one-versus-rest targets is solved on the sample.

Scoring is linear in the presence vectors, so landmarks, K^(-1/2) and regression weights are multiplied into one matrix of
n-grams by languages ahead of scoring, and the sparse presence matrix of a slice of texts is multiplied with it at once: the same numbers as with the
landmark kernels.

A text that is null or has no letter is `und` with score 0. Documents with a null language, or that aren't marked as training
rows, are never learned from. Without any training row every text is `und`. Ties go to the first language in order. Very long texts are read whole: presence
doesn't grow beyond the number of places. Rows that repeat are predicted one by one, equal texts alike. An empty table gives an empty result. Other
columns stay in the struct `row`, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import LOWER, adding, packed, slices

#: Labelled documents to learn from for each language, and those that are landmarks.
SAMPLE, LANDMARKS = 300, 64
RIDGE = 1e-2
#: Bytes of text whose presence matrix is made at once.
PART = 1 << 18
SIZES = (256, 1 << 16, 1 << 16)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(raw: np.ndarray) -> list[np.ndarray]:
    """Distinct n-grams of a text for n = 1, 2, 3."""
    return [_presence(raw, np.array([0, len(raw)]), order)[1] for order in range(len(SIZES))]


def _dense(grams: list[list[np.ndarray]], n: int) -> np.ndarray:
    """Rows: unit presence vectors of order n."""
    out = np.zeros((len(grams), SIZES[n]), np.float32)
    for row, own in zip(out, grams, strict=True):
        if len(own[n]):
            row[own[n]] = 1 / np.sqrt(len(own[n]))
    return out


class Model:
    """Weights (n-grams by languages) of each order."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs), key=lambda x: x.encode())
        grams = [presence(np.frombuffer(t.encode(), np.uint8)) for t in texts]
        seen = {x: 0 for x in self.langs}
        marks = []
        for i, lang in enumerate(langs):
            if seen[lang] < LANDMARKS:
                marks.append(i)
            seen[lang] += 1
        if not marks:
            self.weights, self.bias = [], np.zeros(0, np.float32)
            return
        kernel = np.zeros((len(texts), len(marks)))
        for n in range(len(SIZES)):
            for low in range(0, len(texts), 256):
                block = _dense(grams[low : low + 256], n)
                kernel[low : low + 256] += block @ _dense([grams[i] for i in marks], n).T / len(SIZES)
        values, vectors = np.linalg.eigh(kernel[marks])
        good = values > 1e-8 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = kernel @ root
        y = 2.0 * (np.array(langs)[:, None] == np.array(self.langs)) - 1
        center, middle = z.mean(0), y.mean(0)
        z, y = z - center, y - middle
        solved = np.linalg.solve(z.T @ z + RIDGE * len(texts) * np.eye(z.shape[1]), z.T @ y)
        each = root @ solved / len(SIZES)
        self.bias = (middle - center @ solved).astype(np.float32)
        self.weights = [(_dense([grams[i] for i in marks], n).T @ each).astype(np.float32) for n in range(len(SIZES))]

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row for each text of a slice: its presence matrix times the weights, order by order."""
        n = len(at) - 1
        out = np.tile(self.bias, (n, 1))
        for order, weights in enumerate(self.weights):
            row, column = _presence(data, at, order)
            edges = np.searchsorted(row, np.arange(n + 1))
            some = np.flatnonzero(np.diff(edges))
            if len(some):
                # The rows' columns are sorted and have one value each: the product is a sum of weight rows over each row's run.
                out[some] += np.add.reduceat(weights[column], edges[some], axis=0) / np.sqrt(np.diff(edges)[some, None]).astype(np.float32)
        return out


def _presence(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the nonzero places of the presence matrix of all texts, for n-grams of order + 1 bytes, by row."""
    one = LOWER[data].astype(np.int64)
    if order == 0:
        codes = one
    elif order == 1:
        codes = (one[:-1] << 8) | one[1:]
    else:
        codes = (((one[:-2] << 16) | (one[1:-1] << 8) | one[2:]) * 0x9E3779B1 >> 11) & 0xFFFF
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(codes)]
    inside = np.arange(len(codes)) + order < at[1:][row]
    return np.divmod(_distinct(row[inside] * SIZES[order] + codes[inside], (len(at) - 1) * SIZES[order]), SIZES[order])


def _distinct(keys: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct keys below size."""
    if size <= 1 << 24:
        seen = np.zeros(size, bool)
        seen[keys] = True
        return np.flatnonzero(seen)
    return np.unique(keys)


def _predict(model):
    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch, limit=PART):
                lettered = np.add.reduceat(np.append(_LETTER[data], False), at[:-1]) > 0 if len(at) > 1 else np.zeros(0, bool)
                lettered &= np.diff(at) > 0
                for i in np.flatnonzero(~lettered & (np.diff(at) > 0)).tolist():
                    lettered[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode())
                lang, score = np.full(len(lettered), "und", object), np.zeros(len(lettered))
                if lettered.any() and model.value.langs:
                    values = model.value.scores(data, at)[lettered]
                    odds = np.exp(4 * (values - values.max(1, keepdims=True)))
                    lang[lettered] = np.array(model.value.langs, object)[values.argmax(1)]
                    score[lettered] = odds.max(1) / odds.sum(1)
                names = [c for c in rows.schema.names]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(lettered)], [*names, "lang_pred", "score", "lettered"])

    return run


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` documents of each language among the training rows, by a hash of doc_id."""
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("order"))
    first = labelled.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))).where(F.col("rn") <= sample)
    rows = sorted(first.select("lang", "rn", "text").toLocalIterator(), key=lambda r: (r["lang"], r["rn"]))
    return Model([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of docs' other columns) and text with lang_pred, score and lettered (whether the text has a letter)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs).drop("k")
    return rows.mapInArrow(_predict(shared), adding(rows, "lang_pred string, score double, lettered boolean"))
