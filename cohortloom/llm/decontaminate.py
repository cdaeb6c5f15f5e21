"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the corpus.

Words are lower-cased (A-Z) and `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `size` consecutive words of an item; an item
with fewer words, but some, is one window. Every word of a document inside an occurrence of a window is hit; hash hits
are verified on the words themselves.

The set is broadcast in blocks of at most GRAMS windows, a bound that doesn't depend on the benchmark: a larger benchmark makes
more blocks, each scanned by a pass of its own, and the hits of all passes are put together.

Null texts have no words. Items without words never occur; an item_id that repeats names all of its texts, and a null
item_id marks hits without being listed. Rows that repeat a doc_id are judged one by one. A word that several windows cover is hit once, and all their
items are listed. Very long texts and items are read whole. Other columns stay in the struct `row`, so that none can clash. Empty tables: no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, PUNCT, Words, adding, cut, ngram_hashes, packed, sequence_hashes, signed, slices

GRAMS = 200_000
_FILTER = (1 << 20) - 1


def _grams(size: int):
    """The windows of items: item, number of words, hash and words. The words of a slice are hashed and joined once; a window is a cut of them."""

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                data = LOWER[data]
                words = Words(data, at, PUNCT)
                hashes, ids = words.hashes(), rows.column("item_id").cast(pa.string())
                n = np.minimum(size, words.counts)
                many = np.where(n > 0, words.counts - n + 1, 0)  # windows of each item
                item = np.repeat(np.arange(len(many)), many)
                low = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + words.doc[item]
                high = low + n[item]
                lengths = words.ends - words.starts
                begin = np.concatenate(([0], np.cumsum(lengths + 1)))
                inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                joined = np.full(begin[-1], 0x20, np.uint8)
                joined[inner + np.repeat(begin[:-1], lengths)] = data[inner + np.repeat(words.starts, lengths)]
                raw = joined.tobytes()
                texts = [raw[i:j] for i, j in zip(begin[low].tolist(), (begin[high] - 1).tolist(), strict=True)]
                columns = [ids.take(pa.array(item)), pa.array(n[item].astype(np.int32)), pa.array(signed(sequence_hashes(hashes, low, high))), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "n", "h", "words"])

    return run


class GramSet:
    """A block of windows for lookup by hash."""

    def __init__(self, rows):
        self.items: dict[tuple[int, int, bytes], set[str]] = {}
        for row in rows:
            self.items.setdefault((row["n"], row["h"], row["words"].encode()), set()).add(row["item"])
        self.hashes = {n: np.array(sorted({h for m, h, _ in self.items if m == n}), np.int64).view(np.uint64) for n in {m for m, _, _ in self.items}}
        for n, h in self.hashes.items():
            self.hashes[n] = np.sort(h)
        self.filters = {n: np.bincount((h & np.uint64(_FILTER)).astype(np.int64), minlength=_FILTER + 1) > 0 for n, h in self.hashes.items()}

    def find(self, data: np.ndarray, words: Words, hashes: np.ndarray) -> dict[int, list[tuple[int, int, set]]]:
        """document -> (first word, end, items) of verified occurrences; words counted in the document."""
        found: dict[int, list[tuple[int, int, set]]] = {}
        ends, raw = np.repeat(words.doc[1:], words.counts), None
        for n, known in self.hashes.items():
            grams = ngram_hashes(hashes, n)
            at = np.flatnonzero(self.filters[n][(grams & np.uint64(_FILTER)).astype(np.int64)])
            at = at[known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]]
            at = at[ends[at] - at >= n]
            for low in at.tolist():
                raw = data.tobytes() if raw is None else raw
                text = b" ".join([raw[s:e] for s, e in zip(words.starts[low : low + n].tolist(), words.ends[low : low + n].tolist(), strict=True)])
                items = self.items.get((n, int(grams[low : low + 1].view(np.int64)[0]), text))
                if items:
                    doc = int(np.searchsorted(words.doc, low, "right")) - 1
                    found.setdefault(doc, []).append((low - int(words.doc[doc]), low - int(words.doc[doc]) + n, items))
        return found


def _clean(raw: bytes, low: int, high: int, starts: list[int], ends: list[int], hit: np.ndarray) -> str:
    """The text raw[low:high] without its runs of hit words."""
    out, at = [], low
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:high]]).decode()


def _mark(block):
    """Adds n_words, n_hit, items and kept_text (null without hits); the hits are found in a broadcast block, or read from `spans`."""

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                low = LOWER[data]
                words = Words(low, at, PUNCT)
                if block is not None:
                    found = block.value.find(low, words, words.hashes())
                else:
                    found = {i: [(s["low"], s["high"], {s["item"]}) for s in own] for i, own in enumerate(rows.column("spans").to_pylist()) if own}
                n_hit, items, kept, raw = [0] * rows.num_rows, [[] for _ in range(rows.num_rows)], [None] * rows.num_rows, data.tobytes() if found else b""
                for i, spans in found.items():
                    hit, a, b = np.zeros(words.counts[i], bool), words.doc[i], words.doc[i + 1]
                    for first, end, _ in spans:
                        hit[first:end] = True
                    n_hit[i], items[i] = int(hit.sum()), sorted({x for *_, ids in spans for x in ids if x is not None})
                    kept[i] = _clean(raw, int(at[i]), int(at[i + 1]), words.starts[a:b].tolist(), words.ends[a:b].tolist(), hit)
                names = [c for c in rows.schema.names if c != "spans"]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(words.counts.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(kept, pa.string())], [*names, "n_words", "n_hit", "items", "kept_text"])

    return run


def _spans(block):
    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                low = LOWER[data]
                words, keys = Words(low, at, PUNCT), rows.column("k").to_pylist()
                out = [(keys[i], a, b, item) for i, own in block.value.find(low, words, words.hashes()).items() for a, b, items in own for item in items]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["k", "low", "high", "item"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, grams: int | None = None) -> DataFrame:
    """row (a struct of docs' other columns) and text with n_words, n_hit, items (sorted ids of the items that occur) and kept_text: the text
    without its runs of hit words, null where there are none (the text stays as it is)."""
    spark, bound = docs.sparkSession, GRAMS if grams is None else grams
    table = benchmark.select("item_id", "text").mapInArrow(_grams(size), "item string, n int, h long, words string").distinct()
    table = cut(table)  # counted, and read by each pass
    passes = max(1, -(-table.count() // max(1, bound // 2)))  # half as many windows as fit on average: blocks are dealt by hash
    block = lambda i: spark.sparkContext.broadcast(GramSet(table.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == i).toLocalIterator()))
    added = "n_words long, n_hit long, items array<string>, kept_text string"
    keyed = packed(docs)
    rows = keyed.drop("k")
    if passes == 1:
        return rows.mapInArrow(_mark(block(0)), adding(rows, added))
    found = None
    for i in range(passes):
        more = keyed.select("k", "text").mapInArrow(_spans(block(i)), "k long, low int, high int, item string")
        found = more if found is None else found.unionByName(more)
    spans = found.groupBy("k").agg(F.collect_set(F.struct("low", "high", "item")).alias("spans"))
    return keyed.join(spans, "k", "left").drop("k").mapInArrow(_mark(None), adding(rows, added))
