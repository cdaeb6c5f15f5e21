"""I-Match fingerprints: terms in a band of inverse document frequency, hashed over randomised lexicon subsets.

The lexicon is the set of terms (words `[^\\x20\\x09-\\x0D]+`) that occur in a share of the documents between LOW and HIGH, that is idf between
ln(1/HIGH) and ln(1/LOW). Frequencies are exact and cover all documents. A term with that share overall has at least the share LOW in one of the
parts of the table, so parts nominate terms, and nominees are counted in a second scan. At most (terms in a document) / LOW
terms can be in the lexicon, whatever the corpus; if more than NOMINEES are nominated, all terms are counted by a shuffle instead.

A subset of level j keeps each term with probability 4**-j, by a seeded hash; level 0 is the whole lexicon, and each other level has SUBSETS
subsets. The fingerprint is the number of terms followed by, for each subset, a 32-bit hash of the sorted distinct terms of the text in it (0 if none), as a
string of 8 hex digits each. A text without terms in the band is fingerprinted on all its terms.

The likeness of two fingerprints is the share of subsets with equal hashes among those where either has terms, on the levels that are sparse enough
for the larger of them; 1 if the fingerprints are equal. Texts: null counts as empty, and its fingerprint is all zeros. Equal texts have equal fingerprints.
Very long texts are read whole. doc_id is a number; rows of one doc_id are ordered by text, and rows without come last. An empty table gives an empty
result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import Words, mix, sequence_hashes, signed, slices

LOW, HIGH = 1e-3, 0.2
NOMINEES = 2_000_000
LEVELS, SUBSETS = 6, 16
_FILTER = (1 << 22) - 1
_SALTS = mix(np.arange(1, LEVELS * SUBSETS + 1, dtype=np.uint64))


def _once(words: Words) -> np.ndarray:
    """Hashes of the distinct words of each document, one document after the other."""
    hashes = words.hashes()
    own = mix(hashes ^ mix(words.of().astype(np.uint64) + np.uint64(1)))
    return hashes[np.unique(own, return_index=True)[1]]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(at, np.concatenate([c for _, c in parts]), len(terms)).astype(np.int64)


def _frequencies(known, low: float):
    """Document frequencies of the part's terms: of the known ones, or of those with the share `low` in the part."""

    def run(batches):
        parts, docs, held = [], 0, 0
        for batch in batches:
            for rows, data, at in slices(batch):
                docs += rows.num_rows
                terms = _once(Words(data, at))
                if known is not None:
                    terms = terms[known.value.has(terms)]
                terms, counts = np.unique(terms, return_counts=True)
                parts.append((terms, counts))
                held += len(terms)
                if held > 4_000_000:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
        if parts:
            terms, counts = _merge(parts)
            keep = counts >= low * docs
            yield pa.RecordBatch.from_arrays([pa.array(signed(terms[keep])), pa.array(counts[keep])], ["term", "n"])

    return run


class Terms:
    """A set of term hashes."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms.view(np.uint64))
        self.filter = np.zeros(_FILTER + 1, bool)
        self.filter[(self.terms & np.uint64(_FILTER)).astype(np.int64)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self.filter[(hashes & np.uint64(_FILTER)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(self.terms):
            out[at] = self.terms[np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)] == hashes[at]
        return out


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, nominees: int | None = None) -> Terms:
    """The terms whose share of the documents is in the band."""
    texts, bound = docs.select("text"), NOMINEES if nominees is None else nominees
    total = docs.count()
    named = texts.mapInArrow(_frequencies(None, low), "term long, n long").select("term").distinct().limit(bound + 1).toPandas()["term"].to_numpy(np.int64)
    known = docs.sparkSession.sparkContext.broadcast(Terms(named)) if len(named) <= bound else None
    counted = texts.mapInArrow(_frequencies(known, 0), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return Terms(counted.where((F.col("n") >= low * total) & (F.col("n") <= max(1.0, high * total))).select("term").toPandas()["term"].to_numpy(np.int64))


def fingerprints(texts: list[bytes], terms: Terms) -> np.ndarray:
    """A row for each text."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), np.uint8), at)
    hashes, doc = words.hashes(), words.of()
    inside = terms.has(hashes)
    none = np.bincount(doc[inside], minlength=len(texts)) == 0
    keep = inside | none[doc] if len(doc) else inside
    hashes, doc = hashes[keep], doc[keep]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[first], doc[first]
    out = np.zeros((len(texts), 2 + (LEVELS - 1) * SUBSETS), np.int64)
    out[:, 0] = np.bincount(doc, minlength=len(texts))
    for j in range(out.shape[1] - 1):
        level = 0 if j == 0 else 1 + (j - 1) // SUBSETS
        member = mix(hashes ^ _SALTS[j]) & np.uint64(4**level - 1) == 0 if level else np.ones(len(hashes), bool)
        ends = np.searchsorted(doc[member], np.arange(len(texts) + 1))
        some = np.diff(ends) > 0
        out[some, j + 1] = (sequence_hashes(hashes[member], ends[:-1][some], ends[1:][some]) >> np.uint64(32)).astype(np.int64) | 1
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    most = np.maximum(x[:, 0], y[:, 0])
    level = np.concatenate(([0], np.repeat(np.arange(1, LEVELS), SUBSETS)))
    sparse = (level[None, :] >= np.minimum(LEVELS - 1, np.ceil(np.log(np.maximum(most, 1) / 1.5) / np.log(4)))[:, None]) & (level > 0)[None, :]
    some = sparse & ((x[:, 1:] != 0) | (y[:, 1:] != 0))
    same = some & (x[:, 1:] == y[:, 1:])
    share = same.sum(1) / np.maximum(1, some.sum(1))
    return np.where((x == y).all(1), 1.0, share)


def edited(text: str, after: str) -> str:
    """text with its last third (whole code points, rounded down) replaced by as many first code points of `after`."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _compare(rows: list[tuple], terms: Terms):
    """rows: (doc_id, text, next text)."""
    own, after = [t.encode() for _, t, _ in rows], [t.encode() for *_, t in rows]
    changed = [edited(t, x).encode() for _, t, x in rows]
    prints = fingerprints([*own, *changed, *after], terms)
    n = len(rows)
    width = 4 * prints.shape[1]
    raw = prints.astype(">u4").tobytes()
    text = [raw[i : i + width].hex() for i in range(0, 2 * n * width, width)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed]), pa.array(text[:n]), pa.array(text[n:]), pa.array(likeness(prints[:n], prints[n : 2 * n])), pa.array(likeness(prints[:n], prints[2 * n :]))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(terms):
    """Rows in order within each part: every row with the next one of its part."""

    def run(batches):
        last, held, size = None, [], 0
        for batch in batches:
            for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
                if last is not None and last[0] == part:
                    held.append((last[1], last[2], text))
                    size += len(last[2]) + len(text)
                    if size > 2_000_000:
                        yield _compare(held, terms.value)
                        held, size = [], 0
                last = (part, doc_id, text)
        if held:
            yield _compare(held, terms.value)

    return run


def _ends(batches):
    """The first and the last row of each part."""
    first = last = None
    for batch in batches:
        out = []
        for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
            if last is None or last[0] != part:
                out += [(last[0], first, last[1:])] if last is not None else []
                first = (doc_id, text)
            last = (part, doc_id, text)
        yield _end_rows(out)
    if last is not None:
        yield _end_rows([(last[0], first, last[1:])])


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][1] for r in rows], pa.string()), pa.array([r[2][0] for r in rows], pa.int64()), pa.array([r[2][1] for r in rows], pa.string())], ["part", "first", "doc_id", "text"])


def _compare_ends(terms):
    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True))
            if rows:
                yield _compare(rows, terms.value)

    return run


def compare_with_next(docs: DataFrame, terms: Terms, parts: int | None = None) -> DataFrame:
    """For each row of docs: its fingerprint and that of its edited text (see `edited`), which takes from the next document by descending doc_id
    (null last; after the last the first; rows of one doc_id by text), and how like they and the next document are.

    Rows are dealt to parts by ranges of doc_id, whose bounds are quantiles. Only the ends of the parts meet in one task.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, F.lit(10 * parts))).first()[0] or [])) if parts > 1 else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b >= F.col("doc_id"))) if bounds else F.lit(0)
    placed = rows.withColumn("part", F.coalesce(F.when(F.col("doc_id").isNotNull(), part), F.lit(len(bounds) + 1)).cast("int"))
    placed = placed.repartition("part").sortWithinPartitions("part", F.col("doc_id").desc_nulls_last(), "text")
    ends = placed.mapInArrow(_ends, "part int, first string, doc_id long, text string")
    # Only numbers of parts meet in one task; the texts at their ends are then joined.
    order = Window.orderBy("part")
    turn = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = placed.select("part").distinct().withColumn("next", F.coalesce(F.lead("part").over(order), turn))
    first = ends.select(F.col("part").alias("next"), F.col("first").alias("after"))
    linked = ends.select("part", "doc_id", "text").join(following, "part").join(first, "next").select("doc_id", "text", "after")
    return placed.mapInArrow(_pairs(shared), _SCHEMA).unionByName(linked.mapInArrow(_compare_ends(shared), _SCHEMA))
