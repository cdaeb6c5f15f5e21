"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Sources share `epochs_total` times the size of all documents by weight. A source can't give more than `max_epochs` times its
size: where its share is more, its target is that cap and the excess goes to the others by weight, until none is above
its cap. This fixed point has a closed form: with the sources in order of cap / weight, those before the first
one whose cap holds the level of the rest are the capped ones.

A source at a ratio of target to size of r repeats each document floor(r) times, and a sample of its documents once more. The sample
is drawn within bins of about BIN documents of a source: by size class, largest first, and in seeded order within a class,
each document is taken if that brings the words taken nearest to the bin's share. A bin so misses its share by about
half of its smallest documents, the largest source is spread over many tasks, and reruns agree.

Sizes are counts of words `[^\\x20\\x09-\\x0D]+`; null and empty texts have size 0 and are taken floor(r) times or once more,
with no words. Null is a source of its own, last in order. Documents of one size class are taken in seeded order, equal rows as it
comes. Very long texts are counted whole. `repetitions` reads doc_id, text and source only; other columns can't clash. Rows that repeat a doc_id are documents of their own. The
table of sources (one row each) is the only thing that one task sees whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import packed, row_key, unpacked

BIN = 4096


def word_count(text: str = "text"):
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), epochs_total: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, docs, target) of sizes (source, size); weights repeat over the sources in code-point order, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sources.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.lit(epochs_total) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
    ranked = weighted.select("*", level.alias("level"), F.row_number().over(order).alias("rn")).withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    first = F.min(F.when(F.col("open"), F.struct("rn", "level"))).over(every)
    return ranked.withColumn("first", first).select("source", "source_size", "docs", F.when(F.col("rn") < F.coalesce("first.rn", F.col("rn") + 1), F.col("cap")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def choose(sizes: np.ndarray, order: np.ndarray, share: float) -> np.ndarray:
    """Which documents are taken so that about `share` of the words are: by size class, largest first, then by `order`."""
    classes = np.frexp(sizes.astype(float))[1]
    taken, want, have = np.zeros(len(sizes), bool), 0.0, 0.0
    for i in np.lexsort((sizes, order, -classes)).tolist():
        size = float(sizes[i])
        want += share * size
        if want - have > 0 and want - have >= size / 2:
            taken[i] = True
            have += size
    return taken


def _take(rows: pd.DataFrame) -> pd.DataFrame:
    size, ratio = rows["size"].to_numpy(), float(rows["ratio"].iloc[0])
    whole = int(np.floor(ratio))
    more = choose(size, rows["order"].to_numpy(), ratio - whole)
    rows["repeats"] = (whole + more).astype(np.int64)
    rows["taken"] = rows["repeats"] * size
    return rows.drop(columns=["ratio", "order", "bin"])


def repetitions(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), epochs_total: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """For each row of docs: k (row_key), doc_id, source, size, source_size, target (of its source), repeats and taken (words)."""
    sized = docs.select(row_key().alias("k"), "doc_id", "source", word_count().alias("size"))
    plan = targets(sized, weights, epochs_total, max_epochs).withColumnRenamed("source", "s")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = F.xxhash64("k", F.lit(seed))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(0.0)
    dealt = rows.select("k", "doc_id", "source", "size", "source_size", "target", ratio.alias("ratio"), order.alias("order"), F.pmod(F.xxhash64("k", F.lit(seed + 1)), F.ceil(F.col("docs") / BIN)).alias("bin"))
    kinds = dict(dealt.dtypes)
    return dealt.groupBy("source", "bin").applyInPandas(_take, f"k long, doc_id {kinds['doc_id']}, source string, size long, source_size long, target double, repeats long, taken long")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is repeated, with `epoch` 1, 2, ... (`epoch_`, `epoch__`, ... where docs has such a column).
    Rows equal in doc_id and text count together: their repetitions are added up and given to one of them."""
    often = repetitions(docs, **options).groupBy("k").agg(F.sum("repeats").cast("int").alias("repeats")).where("repeats > 0")
    epoch, lower = "epoch", {c.lower() for c in docs.columns}
    while epoch in lower:
        epoch += "_"
    rows = packed(docs).join(often, "k").dropDuplicates(["k"]).withColumn("epoch", F.explode(F.sequence(F.lit(1), "repeats")))
    return unpacked(rows, also=[F.col("epoch").alias(epoch)])
