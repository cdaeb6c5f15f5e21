"""Claims features: code lookups, one-hot and recurrence nodes, outcomes, samples and descriptive tables."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import above
from . import ranges


def last_mapping(mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row for each key: that of the last row of the file."""
    return mapping.groupBy(key).agg(F.max_by(value, order).alias(value))


def lookup(df: DataFrame, mapping: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left keeps unmatched codes with NULL, inner drops them, left_anti is what is rejected."""
    return df.join(mapping, key, how)


def onehot(nodes: DataFrame, case: str, node: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each value. Values are given: no job to find them, and a stable schema."""
    return nodes.groupBy(case).pivot(node, values).agg(F.lit(1)).na.fill(0)


def recurrence(events: DataFrame, case: str, node: str) -> DataFrame:
    """(case, node, occurrence): one row up to the number of times that a node occurs."""
    counted = events.groupBy(case, node).agg(F.count("*").cast("int").alias("n"))
    return counted.select(case, node, F.explode(F.sequence(F.lit(1), "n")).alias("occurrence"))


def occurrence_name(node: Column, occurrence: Column) -> Column:
    return F.concat(node, F.when(occurrence == 1, "").when(occurrence == 2, "_R").otherwise(F.concat(F.lit("_R"), (occurrence - 1).cast("string"))))


def above_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """1 where value is strictly above the median of the table, else 0, also for NULL."""
    middle = ranges.quantiles(df, [], value, [0.5]).select(F.col("q")[0].alias("_m"))
    return df.join(F.broadcast(middle), how="left").withColumn(name, above(F.col(value), F.col("_m"))).drop("_m")


def binarised(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target, which becomes 0 or 1: above its median where it has more than two values."""
    rows = df.where(F.col(target).isNotNull())
    if rows.select(target).distinct().limit(3).count() <= 2:
        return rows.withColumn(target, F.col(target).cast("int"))
    return above_median(rows, target, "_flag").drop(target).withColumnRenamed("_flag", target)


def cohort(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column has the value; all rows, with a warning, where there is no such column; an error where no row is left."""
    if column not in df.columns:
        warnings.warn(f"no column {column}: rows aren't filtered", stacklevel=2)
        return df
    rows = df.where(F.col(column) == value)
    if rows.isEmpty():
        raise ValueError(f"no rows with {column} = {value}")
    return rows


def deepest(events: DataFrame, case: str, node: str) -> DataFrame:
    """(node, depth): the largest number of times that a node occurs in one case."""
    return events.groupBy(case, node).agg(F.count("*").alias("n")).groupBy(node).agg(F.max("n").alias("depth"))


def spread_of_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """Standard deviation over groups of their mean."""
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.stddev_samp("m").alias("spread"))


def readmission(stays: DataFrame, patient: str, admitted: str, discharged: str, key: str, days: int = 30) -> DataFrame:
    """1 if the stay begins within `days` of the end of the patient's stay before; 0 for first stays and unknown patients."""
    order = Window.partitionBy(patient).orderBy(F.col(admitted).asc_nulls_last(), key)
    gap = F.datediff(admitted, F.lag(discharged).over(order))
    return stays.withColumn("gap", F.when(F.col(patient).isNotNull(), gap)).withColumn("readmitted", F.coalesce(F.col("gap").between(0, days).cast("int"), F.lit(0)))


def describe_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: n, missing, mean, standard deviation, and exact median and quartiles."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")
    long = df.select(values).select("v.*")
    plain = long.groupBy("variable").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    q = ranges.quantiles(long, ["variable"], "x", [0.25, 0.5, 0.75])
    return plain.join(q, "variable", "left").select("variable", "n", "missing", "mean", "sd", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def describe_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and percent of each value of each column, NULL included."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")
    counted = df.select(values).select("v.*").groupBy("variable", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("variable")))


def shuffled(key: Column, seed: str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def sample_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n)


def stratified_split(df: DataFrame, key: str, y: str, seed: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """split is train, val or test by rank within each class. The rank of a row is that of its range of the shuffled order plus that within it, so
    that no task sorts a whole class."""
    rows = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    bands = rows.groupBy(y, "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(y)
    bands = bands.withColumn("_total", F.sum("_n").over(whole)).withColumn("_before", F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    ranked = rows.join(bands, [y, "_b"]).withColumn("_share", (F.col("_before") + F.row_number().over(Window.partitionBy(y, "_b").orderBy("_h", key))) / F.col("_total"))
    return ranked.withColumn("split", F.when(F.col("_share") <= train, "train").when(F.col("_share") <= train + val, "val").otherwise("test")).drop("_h", "_b", "_total", "_before", "_share")
