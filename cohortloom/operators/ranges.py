"""Exact order statistics without a global sort in one task: values are dealt to ranges, totals of the ranges are added up (a few rows), and
ranks are completed inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values, and the accuracy with which their bounds halve the rows; both bound what a task or the driver sees.
RANGES, ACCURACY = 64, 10_000


def _bounds(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, _edges): about equal shares of the rows lie between two edges."""
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    return df.groupBy(*group).agg(F.percentile_approx(value, shares, F.lit(ACCURACY)).alias("_edges"))


def _range(value: Column) -> Column:
    return F.size(F.filter("_edges", lambda e: e < value))


def before(df: DataFrame, value: str, sums: dict[str, str], descending: bool = False, group: list[str] = ()) -> DataFrame:
    """df, which has one row for each value (of a group), with `name: the sum of a column over all smaller values` (larger ones, if descending).

    df is read three times: for the edges, for the totals of the ranges, and for the ranks within them.
    """
    group, edges = list(group), _bounds(df, list(group), value)
    placed = df.join(F.broadcast(edges), group) if group else df.crossJoin(F.broadcast(edges))
    placed = placed.withColumn("_range", _range(F.col(value))).drop("_edges")
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    whole = Window.partitionBy(*group).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = placed.groupBy(*group, "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    totals = totals.select(*group, "_range", *(F.coalesce(F.sum(f"_{n}").over(whole), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*group, "_range").orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(totals), [*group, "_range"])
    return ranked.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("_range", *(f"_{n}" for n in sums))


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """(group, q): exact quantiles of the values that aren't NULL, interpolated linearly between ranks, in the order of shares."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    edges = _bounds(df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double")), group, "_x")
    placed = (counts.join(F.broadcast(edges), group) if group else counts.crossJoin(F.broadcast(edges))).withColumn("_range", _range(F.col("_x"))).drop("_edges")
    every = Window.partitionBy(*group)
    totals = placed.groupBy(*group, "_range").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_all", F.sum("_t").over(every)).withColumn("_before", F.sum("_t").over(every.orderBy("_range")) - F.col("_t"))
    # The two ranks on either side of each share; only ranges that hold one are ranked.
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(shares)))).alias("s")
    wanted = totals.select("*", at).withColumn("low", F.floor("s.at")).withColumn("high", F.ceil("s.at"))
    wanted = wanted.where("(low >= _before AND low < _before + _t) OR (high >= _before AND high < _before + _t)")
    kept = wanted.groupBy(*group, "_range", "_before").agg(F.collect_list(F.struct("s.i", "s.at", "low", "high")).alias("_s"))
    inside = Window.partitionBy(*group, "_range").orderBy("_x")
    rows = placed.join(F.broadcast(kept), [*group, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    rows = rows.select(*group, "_x", (F.col("_upto") - F.col("_n")).alias("_from"), "_upto", F.explode("_s").alias("s"))
    side = lambda c: F.max(F.when((F.col(f"s.{c}") >= F.col("_from")) & (F.col(f"s.{c}") < F.col("_upto")), F.col("_x")))
    each = rows.groupBy(*group, "s.i", "s.at", "s.low").agg(side("low").alias("x"), side("high").alias("y"))
    q = F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.col("low"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda s: s["q"]).alias("q"))


def shuffled_rank(df: DataFrame, by: list[str], shuffled: Column, key: str, name: str) -> DataFrame:
    """df with the rank (1 first) of each row within `by` in the order of a hexadecimal hash, ties by key: ranges are the first three digits."""
    rows = df.withColumn("_h", shuffled).withColumn("_b", F.substring("_h", 1, 3))
    bands = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    bands = bands.select(*by, "_b", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).alias("_before"))
    return rows.join(bands, [*by, "_b"]).withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))).drop("_h", "_b", "_before")
