"""The corpus pipeline: five stages, each an operator of cohortloom.llm over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last one adds `epoch`, as a document can be
taken more than once. Between stages the rows are written as Parquet and read again; a stage's files go once its successor's are written.

Nulls and empty texts go in the first stage. Very long texts are read whole. Rows equal in doc_id and text become one in the second stage; rows that only share a
doc_id are documents of their own. Of linked documents the one with the smallest doc_id stays, null last. Further columns of documents are carried
through whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import language_id
from cohortloom.llm._text import documents, packed, shared_dir, unpacked
from cohortloom.llm.decontaminate import decontaminate
from cohortloom.llm.mixing import mixture
from cohortloom.llm.near_dedup import near_duplicates
from cohortloom.llm.substring_dedup import remove_duplicates


#: How much likelier than an even guess the language of a document must be.
CLEAR = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose best language is less than CLEAR times as likely as by an even guess. Where no
    language can be learned, all documents with letters stay."""
    model = language_id.fit(docs, F.lit(True))
    least = CLEAR / len(model.langs) if len(model.langs) > 1 else 0.0
    return unpacked(language_id.identify(docs, model).where(F.col("lettered") & (F.col("score") >= least)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on shingles of five words, the one with the smallest doc_id stays."""
    stays = near_duplicates(docs, shingle=5, percent=80).where("kept").select("k")
    return unpacked(packed(docs).join(stays, "k", "left_semi").dropDuplicates(["k"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that occur more than once go; so do documents of which nothing is left."""
    kept = remove_duplicates(docs, window=35).where("n_removed = 0 or n_removed < n_words")
    return unpacked(kept, F.coalesce("kept_text", "text"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 10 words of a benchmark item go; so do documents of which nothing is left."""
    marked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10).where("n_hit = 0 or n_hit < n_words")
    return unpacked(marked, F.coalesce("kept_text", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """150 % of all words, sources by weight, none more than twice."""
    return mixture(docs, weights=(3, 1, 2), epochs_total=1.5, max_epochs=2.0)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: The classifier of the first stage and the sampling of the last can't be put as SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, on documents."""
    shared_dir(spark)
    top = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{top}/{name}"
    return docs
