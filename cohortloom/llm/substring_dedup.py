"""Substring deduplication by relative Lempel-Ziv (RLZ) parsing.

Every run of `window` words that starts at two or more places of the corpus is a duplicate, and the words it covers are
removed. The reference is the corpus itself, cut into indexed blocks:

1. Each window belongs to its minimiser: the smallest hash among its runs of `GRAM` words. Equal windows have equal
   minimisers, so the windows of one anchor form a short segment of text, and a window can only repeat in segments of
   the same anchor. Segments are dealt to blocks by anchor: this replaces parsing every document against every block,
   as a factor of `window` words or more can't lie in another block.
2. Anchors that occur once are dropped on counts alone. Segments of equal content are counted, not gathered: if two or
   more are equal, all their windows are duplicates. One of each kind stays as reference.
3. What is left - segments that share their anchor but differ - is parsed: a block's segments are indexed by a suffix
   array and each is factored greedily: the longest match anywhere else in the block is looked up where a factor starts, and nowhere else. Factors of `window`
   words or more become spans. A window that isn't inside a factor can only repeat if the factor that starts at the first boundary
   in it reaches its end, as that factor is at least as long as the rest of the window's own match: only such windows are looked up too.
4. An anchor with more than HOT kinds of segments doesn't fit one block. Such anchors are few (at most KEYS, as the bound rises with the kinds) and are broadcast;
   a further scan cuts their segments by where the anchor lies in a window, 16 places together, then 4, then each alone: all windows of a piece share more words than the
   anchor, which are its new key, so equal windows meet again, in smaller blocks. At the last cut a piece is one window and the key the whole of it, so that no
   key has several kinds.

Counts of an anchor are made by partial aggregation. Where its rows must meet its count, those of anchors above HEAVY are salted.

Texts: null counts as empty; documents of fewer words than the window keep all. Rows that repeat a doc_id are documents
of their own (equal rows remove each other's windows, as any copies do). Of equal windows none is preferred: all go, so there are no ties to break. Very long texts are read whole. An empty table gives an empty result. Other columns
are carried in the struct `row`, so that none can clash. Hashes have 64 bits; a segment's are compared under an equal 64-bit anchor only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, adding, cut, mix, ngram_hashes, packed, row_key, sequence_hashes, signed, slices

GRAM = 6
#: Distinct segments of one anchor that a block takes; segments of a block before it is closed.
HOT, BLOCK = 2000, 12000
#: Keys that can have more kinds than a block takes: the bound for a block is a KEYS-th of all kinds, or HOT.
KEYS = 1_000_000
#: Rows of an anchor from which they are salted: this many, or a ten-thousandth of the documents, which bounds how many such anchors there are; and the salts.
HEAVY, SALTS = 20_000, 64
_AT = np.uint64((1 << 28) - 1)


def segments(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, document, first window's start in the document, windows, anchor's place after that start) of each segment."""
    n = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    grams = ngram_hashes(hashes, min(GRAM, window))
    least = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)
    span, have = window - min(GRAM, window) + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    anchor_at = (least & _AT).astype(np.int64)
    ends = np.repeat(words.doc[1:], words.counts)[:n]
    valid = np.flatnonzero(ends - np.arange(n) >= window)
    if not len(valid):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    at = anchor_at[valid]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    starts, counts = valid[first], np.diff(np.concatenate((first, [len(valid)])))
    doc = np.searchsorted(words.doc, starts, "right") - 1
    return grams[at[first]], sequence_hashes(hashes, starts, starts + counts + window - 1), doc, starts - words.doc[doc], counts, at[first] - starts


def pieces(hashes: np.ndarray, a: np.ndarray, start: np.ndarray, n: np.ndarray, place: np.ndarray, window: int, width: int) -> tuple[np.ndarray, ...]:
    """Cuts segments (anchor, first word, windows, the anchor's place after it) by where the anchor lies in a window, `width` places together: key, content
    hash, segment, first window and windows of each piece."""
    out = []
    for least in range(0, window - min(GRAM, window) + 1, width):
        most = min(least + width, window - min(GRAM, window) + 1) - 1
        # A window that starts at word j of the segment has the anchor at `place - j`.
        low, high = np.maximum(0, place - most), np.minimum(n - 1, place - least)
        some = np.flatnonzero(low <= high)
        low, high, base = low[some], high[some], start[some]
        key = sequence_hashes(hashes, base + place[some] - least, base + place[some] - most + window)
        out.append((mix(key ^ mix(a[some] + np.uint64(width * 64 + least))), sequence_hashes(hashes, base + low, base + high + window), some, low, high - low + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _find_segments(window: int, hot=None, above: int | None = None, width: int | None = None):
    """The segments of all texts; or, of those with a hot anchor - or a hot key when cut by `above` places -, the pieces of `width` places."""

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                words = Words(data, at)
                hashes = words.hashes()
                key, content, doc, start, count, place = segments(words, hashes, window)
                if hot is not None:
                    base = words.doc[doc] + start
                    if above is None:
                        some = np.flatnonzero(_among(key, hot.value))
                        key, doc, base, count, place = key[some], doc[some], base[some], count[some], place[some]
                    else:
                        own, _, seg, low, many = pieces(hashes, key, base, count, place, window, above)
                        some = np.flatnonzero(_among(own, hot.value))
                        seg, low, many = seg[some], low[some], many[some]
                        key, doc, base, count, place = key[seg], doc[seg], base[seg] + low, many, place[seg] - low
                    key, content, seg, low, count = pieces(hashes, key, base, count, place, window, width)
                    doc = doc[seg]
                    start = base[seg] + low - words.doc[doc]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(content)), rows.column("k").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["a", "h", "k", "start", "n"])

    return run


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _lists(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list column of values[start:end] for each range."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[flat]))


def _cut_out(window: int):
    """The word hashes of the segments listed in column `parts` of each document."""

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                words = Words(data, at)
                hashes, parts = signed(words.hashes()), rows.column("parts")
                size = np.diff(np.asarray(parts.offsets))
                flat = parts.flatten()
                doc = np.repeat(np.arange(rows.num_rows), size)
                start = np.asarray(flat.field("start")).astype(np.int64)
                low = words.doc[doc] + start
                high = low + np.asarray(flat.field("n")) + window - 1
                yield pa.RecordBatch.from_arrays([flat.field("a"), rows.column("k").take(pa.array(doc)), flat.field("start"), _lists(hashes, low, high)], ["a", "k", "start", "words"])

    return run


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


class Index:
    """Suffix array of some segments (each ended by a symbol of its own), by prefix doubling on word ranks."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, window: int):
        n = len(offsets) - 1
        self.starts = offsets[:-1] + np.arange(n)
        self.ends = offsets[1:] + np.arange(n)
        ranks = np.zeros(len(values) + n, np.int64)
        keep = np.ones(len(ranks), bool)
        keep[self.ends] = False
        ranks[keep] = _ranks(values)
        ranks[self.ends] = len(values) + np.arange(n)
        self.levels, size = [_ranks(ranks)], 1
        while size < max(int((self.ends - self.starts).max(initial=1)), window):
            self.levels.append(self._pair(self.levels[-1], size))
            size *= 2
        self.order = np.argsort(self.levels[-1], kind="stable")
        self.rank = np.empty(len(ranks), np.int64)
        self.rank[self.order] = np.arange(len(ranks))

    def match(self, at: np.ndarray) -> np.ndarray:
        """Length of the longest match of each of these suffixes, anywhere else: with a neighbour in the suffix array."""
        rank, longest = self.rank[at], np.zeros(len(at), np.int64)
        for step in (-1, 1):
            some = np.flatnonzero((rank + step >= 0) & (rank + step < len(self.order)))
            longest[some] = np.maximum(longest[some], self._common(at[some], self.order[rank[some] + step]))
        return longest

    def _shift(self, ranks: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(ranks), np.int64)
        if by < len(ranks):
            out[: len(ranks) - by] = ranks[by:] + 1
        return out

    def _pair(self, ranks: np.ndarray, by: int) -> np.ndarray:
        return _ranks(ranks * (len(ranks) + 2) + self._shift(ranks, by))

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y."""
        length, n = np.zeros(len(x), np.int64), len(self.levels[0])
        for level in range(len(self.levels) - 1, -1, -1):
            p, q = x + length, y + length
            inside = (p < n) & (q < n)
            ranks = self.levels[level]
            length += (inside & (ranks[np.minimum(p, n - 1)] == ranks[np.minimum(q, n - 1)])).astype(np.int64) << level
        return length


def parse(values: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """For each position of the segments values[offsets[i]:offsets[i+1]], whether a duplicate window starts there."""
    index = Index(values, offsets, window)
    n = len(index.rank)
    edge = np.zeros(n + 1, np.int64)
    at, end, before = index.starts.copy(), index.ends, index.starts - 1
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):  # one factor of every segment at a time
        step = np.maximum(1, index.match(at))
        long = step >= window
        np.add.at(edge, at[long], 1)
        np.add.at(edge, at[long] + step[long] - window + 1, -1)
        # Windows that start in the factor before, aren't inside it, and end in this one.
        low.append(np.maximum(before + 1, at - window + 1))
        high.append(np.minimum(at - 1, at + step - window))
        before, at = at, at + step
        going = at < end
        before, at, end = before[going], at[going], end[going]
    duplicate = np.cumsum(edge[:-1]) > 0
    low, high = np.concatenate(low), np.concatenate(high)
    size = np.maximum(0, high - low + 1)
    across = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
    duplicate[across[index.match(across) >= window]] = True
    keep = np.ones(n, bool)
    keep[index.ends] = False
    return duplicate[keep]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _parse_blocks(window: int):
    """Batches sorted by anchor; a block is closed between two anchors once it has BLOCK segments."""

    def emit(block: pa.Table):
        parts = block.column("words").combine_chunks()
        offsets = np.asarray(parts.offsets).astype(np.int64)
        found = parse(np.asarray(parts.flatten()), offsets - offsets[0], window)
        low, high = runs(found)
        seg = np.searchsorted(offsets[1:] - offsets[0], low, "right")
        start = np.asarray(block.column("start")).astype(np.int64)[seg] + low - (offsets[:-1] - offsets[0])[seg]
        yield pa.RecordBatch.from_arrays([block.column("k").combine_chunks().take(pa.array(seg)), pa.array(start.astype(np.int32)), pa.array((start + high - low + window - 1).astype(np.int32))], ["k", "low", "high"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > BLOCK:
                anchors = np.asarray(held.column("a"))
                edges = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
                edges = edges[edges >= min(BLOCK, edges[-1])] if len(edges) else edges
                if not len(edges):
                    break
                yield from emit(held.slice(0, edges[0]).combine_chunks())
                held = held.slice(edges[0]).combine_chunks()
        if held is not None and held.num_rows:
            yield from emit(held.combine_chunks())

    return run


def with_counts(rows: DataFrame, counts: DataFrame, heavy: int) -> DataFrame:
    """rows with the columns of counts (a, c, ...), inner; rows of anchors with c above `heavy` are salted."""
    few = counts.where(F.col("c") > heavy).select("a", F.lit(True).alias("_heavy"))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64("k", "start"), F.lit(SALTS))).otherwise(0).cast("int")
    salted = rows.join(F.broadcast(few), "a", "left").withColumn("_salt", salt).drop("_heavy")
    each = F.when(F.col("c") > heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(counts.withColumn("_salt", F.explode(each)), ["a", "_salt"]).drop("_salt")


def duplicate_spans(docs: DataFrame, window: int = 35, hot: int | None = None) -> DataFrame:
    """(k, low, high): word ranges of document k (see row_key) that duplicate windows cover; they may overlap."""
    hot, heavy = HOT if hot is None else hot, max(HEAVY, docs.count() // 10_000)
    keyed = packed(docs)

    def contents(of: DataFrame) -> DataFrame:
        listed = of.groupBy("k").agg(F.collect_list(F.struct("a", "start", "n")).alias("parts"))
        # The texts are shuffled by k as remove_duplicates shuffles them, so that Spark does it once.
        return keyed.join(listed, "k").mapInArrow(_cut_out(window), "a long, k long, start int, words array<long>")

    texts, schema = docs.select(row_key().alias("k"), "text"), "a long, h long, k long, start int, n int"
    segs, spans, above, width = texts.mapInArrow(_find_segments(window), schema), None, None, 16
    while True:
        shared = segs.groupBy("a").agg(F.count("*").alias("c")).where("c > 1")
        # One row for each segment whose anchor repeats: a part of the corpus, used by all that follows.
        repeated = cut(with_counts(segs, shared, heavy).drop("c"))
        kinds = cut(repeated.groupBy("a", "h").agg(F.count("*").alias("copies"), F.min(F.struct("k", "start", "n")).alias("one")))
        equal = repeated.join(kinds.where("copies > 1").select("a", "h"), ["a", "h"], "left_semi")
        found = equal.select("k", F.col("start").alias("low"), (F.col("start") + F.col("n") + (window - 1)).alias("high"))
        # A kind that occurs once in a mixed group is a candidate; the others of its group are its reference.
        mixed = kinds.groupBy("a").agg(F.count("*").alias("c")).where("c > 1")
        bound = max(hot, kinds.count() // KEYS)
        blocks = contents(with_counts(kinds.select("a", "one.*"), mixed.where(F.col("c") <= bound), heavy)).repartition("a").sortWithinPartitions("a")
        found = found.unionByName(blocks.mapInArrow(_parse_blocks(window), "k long, low int, high int"))
        spans = found if spans is None else spans.unionByName(found)
        keys = mixed.where(F.col("c") > bound).select("a").toPandas()["a"].to_numpy(np.int64)  # at most KEYS
        if above == 1 or not len(keys):
            return spans
        known = docs.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))
        segs = texts.mapInArrow(_find_segments(window, known, above, width), schema)
        above, width = width, width // 4


def _kept(batches):
    for batch in batches:
        for rows, data, at in slices(batch):
            words, raw = Words(data, at), data.tobytes()
            spans = rows.column("spans").to_pylist()
            texts, removed, digest = [], [], []
            for i, own in enumerate(spans):
                n, base = int(words.counts[i]), int(words.doc[i])
                keep = np.ones(n, bool)
                for span in own or ():
                    keep[span["low"] : span["high"]] = False
                kept = base + np.flatnonzero(keep)
                text = b" ".join([raw[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)])
                texts.append(text.decode() if own else None)
                removed.append(n - len(kept))
                digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names if c != "spans"), pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], [*(c for c in rows.schema.names if c != "spans"), "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_duplicates(docs: DataFrame, window: int = 35, hot: int | None = None) -> DataFrame:
    """row (a struct of docs' other columns) and text with n_words, n_removed, kept_sha256 (of the kept words, joined by a
    space) and kept_text (null where nothing goes: the text stays as it is)."""
    spans = duplicate_spans(docs, window, hot).groupBy("k").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    rows = packed(docs).join(spans, "k", "left").drop("k")
    return rows.mapInArrow(_kept, adding(rows.drop("spans"), "n_words long, n_removed long, kept_sha256 string, kept_text string"))
