"""Readers and writers: CSV as text with cleaned headers, typed CSV, optional files, timelines as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace("'", "").replace(" ", "") for c in df.columns))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so that leading zeros stay."""
    return clean_headers(spark.read.option("header", True).csv(path))


def read_csv_typed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV at path, or no rows where there is no such file."""
    try:
        return read_csv_typed(spark, path, schema)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def find_column(df: DataFrame, word: str) -> str:
    """The first column whose name holds a word, whatever its case."""
    for c in df.columns:
        if word.lower() in c.lower():
            return c
    raise ValueError(f"no column with {word} among {df.columns}")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an explicit order."""
    return df.orderBy(*order).limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    """A new dataset; the input of df must not be at path."""
    df.write.option("header", True).csv(path)


def write_timelines(timelines: DataFrame, path: str) -> None:
    timelines.select("patient_id", "timeline").write.json(path)


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("patient_id string, timeline map<string,int>").json(path)


def slots_to_events(df: DataFrame, key: str, code: str, date: str, slots: int) -> DataFrame:
    """Long (key, slot, code, date) of repeated columns code1.., date1..; rows without either are dropped."""
    pairs = F.array(*(F.struct(F.lit(i).alias("slot"), F.col(f"{code}{i}").alias("code"), F.col(f"{date}{i}").alias("date")) for i in range(1, slots + 1)))
    return df.select(key, F.explode(pairs).alias("e")).select(key, "e.*").where("code is not null and date is not null")


def synthetic_missingness(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """Ten variables, an outcome, and planted missingness: heart_rate and liver at random, bmi by age, pulmonary by chf, systolic_bp by its own value, length_of_stay by the outcome.
    Comorbidities hang together: chf on age and diabetes, renal failure on blood pressure and chf."""
    u, n = (lambda i: F.rand(seed + i)), (lambda i, mean, sd: mean + sd * F.randn(seed + i))
    likely = lambda z: 1 / (1 + F.exp(-z))
    flag = lambda i, p: (F.col(f"u{i}") < p).cast("int")
    x = spark.range(rows).select("id", n(0, 60, 18).alias("age"), n(1, 27, 5).alias("bmi"), n(2, 80, 12).alias("heart_rate"), n(3, 130, 20).alias("systolic_bp"), F.exp(n(4, 1.2, 0.8)).alias("length_of_stay"), *(u(10 + i).alias(f"u{i}") for i in range(12)))
    x = x.withColumn("diabetes", flag(0, 0.25)).withColumn("chf", flag(1, likely((F.col("age") - 70) / 12 + F.col("diabetes") / 2))).withColumn("renal", flag(2, likely((F.col("systolic_bp") - 150) / 30 + F.col("chf"))))
    x = x.withColumn("pulmonary", flag(3, 0.15)).withColumn("liver", flag(4, 0.05)).withColumn("outcome", flag(5, likely((F.col("age") - 75) / 10 + F.col("chf") + F.col("renal") + F.log("length_of_stay") / 2)))
    gone = {
        "heart_rate": F.col("u6") < 0.15, "liver": F.col("u7") < 0.05, "bmi": (F.col("age") > 80) & (F.col("u8") < 0.6), "pulmonary": (F.col("chf") == 1) & (F.col("u9") < 0.45),
        "systolic_bp": (F.col("systolic_bp") > 160) & (F.col("u10") < 0.75), "length_of_stay": (F.col("outcome") == 1) & (F.col("u11") < 0.8),
    }
    return x.select("id", "age", "diabetes", "chf", "renal", "outcome", *(F.when(~when, F.col(c)).alias(c) for c, when in gone.items()))


def write_matrix(df: DataFrame, columns: list[str], path: str) -> None:
    """The chosen columns of a feature table, for inspection."""
    write_csv(df.select(*columns), path)


def dual_triggers(spark: SparkSession, rows: int = 3000, seed: int = 11) -> DataFrame:
    """Columns whose gaps depend on two others each: bmi on age and chf, a1c on diabetes and bmi, age on the outcome and itself."""
    u = lambda i: F.rand(seed + i)
    x = spark.range(rows).select("id", (65 + 15 * F.randn(seed)).alias("age"), (27 + 5 * F.randn(seed + 1)).alias("bmi"), (6 + F.randn(seed + 2)).alias("a1c_lab"), (u(3) < 0.3).cast("int").alias("elixhauser_diabetes"), (u(4) < 0.25).cast("int").alias("elixhauser_chf"), u(5).alias("p"), u(6).alias("q"), u(7).alias("r"), u(8).alias("s"))
    x = x.withColumn("outcome", (F.col("s") < 1 / (1 + F.exp(-(F.col("age") - 70) / 10 - F.col("elixhauser_chf")))).cast("int"))
    gone = lambda when, draw, rate: when & (F.col(draw) < rate)
    return x.select(
        "id", "elixhauser_diabetes", "elixhauser_chf", "outcome",
        F.when(~gone((F.col("age") > 75) & (F.col("elixhauser_chf") == 1), "p", 0.75), F.col("bmi")).alias("bmi"),
        F.when(~gone((F.col("elixhauser_diabetes") == 0) & (F.col("bmi") < 25), "q", 0.9), F.col("a1c_lab")).alias("a1c_lab"),
        F.when(~gone((F.col("outcome") == 1) & (F.col("age") < 40), "r", 0.5), F.col("age")).alias("age"),
    )
