"""Vectorised tokenisation and hashing of Arrow string columns.

Words are found and hashed on the raw UTF-8 buffers with numpy, so no Python code runs per word. A batch is cut into
slices of whole documents of about SLICE bytes of text, which bounds memory whatever the batch size; one very long
document makes one larger slice.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 20
U64 = np.uint64
_P, _Q = U64(0x9E3779B97F4A7C55), U64(0xC2B2AE3D27D4EB4F)

#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
PUNCT = np.zeros(256, bool)
PUNCT[:0x80] = True
PUNCT[0x30:0x3A] = PUNCT[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1)
        inverse = U64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        have = _powers[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range, independent of where the range lies."""
    up, down = _pow(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    table = _BYTE[LOWER] if lower else _BYTE
    return mix(_range_hash(table[data], starts, ends, _P) + (ends - starts).astype(U64))


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the word sequence words[start:end] for each range."""
    return mix(_range_hash(words, starts, ends, _Q) + (ends - starts).astype(U64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; empty if there are fewer. Equal to sequence_hashes of the same run."""
    starts = np.arange(max(0, len(words) - n + 1))
    return sequence_hashes(words, starts, starts + n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each row starts (one more at the end); null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of some documents: starts and ends in data; document i has words doc[i]:doc[i+1]."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.at = data, at
        inside = ~separators[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        before = np.concatenate(([False], inside[:-1])) & ~cut[:-1] if len(data) else inside
        after = np.concatenate((inside[1:], [False])) & ~cut[1:] if len(data) else inside
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.doc)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, lower)

    def of(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE):
    """(rows of the batch, bytes, offsets) for runs of whole documents with about `limit` bytes."""
    if not batch.num_rows:
        return
    data, at = buffers(batch.column(batch.schema.get_field_index(text)))
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def runs(batches, key: str):
    """Tables of the consecutive rows that share key, for batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(edges[:-2].tolist(), edges[1:-1].tolist(), strict=True):
            yield pa.Table.from_batches([*held, batch.slice(low, high - low)])
            held = []
        held.append(batch.slice(int(edges[-2])))
    if held:
        yield pa.Table.from_batches(held)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def row_key() -> Column:
    """Names a document: rows of one doc_id with different texts differ, equal rows share it. Null-safe."""
    return F.xxhash64("doc_id", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Names a checkpoint folder where the cluster names none, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp")))


#: Rows that a partition of a table kept by `cut` should have at least.
ROWS = 10_000


def cut(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: later reads survive lost executors.

    Small tables are read in fewer partitions, of about `rows` rows at least, as each further shuffle writes files for each of them. Checkpoint
    files go with the last reference to them where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return kept.coalesce(max(1, -(-seen.get["n"] // rows)))


def packed(docs: DataFrame) -> DataFrame:
    """k (row_key), row (a struct of all columns but text) and text: no column of docs can clash with an added one."""
    return docs.select(row_key().alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")


def unpacked(df: DataFrame, text: Column | None = None, also: Sequence[Column] = ()) -> DataFrame:
    """The columns of the documents again, with another text and its n_chars if given, and further columns."""
    names = [f.name for f in df.schema["row"].dataType.fields]
    new = F.col("text") if text is None else text
    columns = [F.col("row").getField(c).alias(c) if c != "n_chars" or text is None else F.length(new).cast("long").alias(c) for c in names]
    at = names.index("lang") if "lang" in names else len(names)
    return df.select(*columns[:at], new.alias("text"), *columns[at:], *also)


def adding(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with more columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
