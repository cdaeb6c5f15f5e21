"""Micro-fixtures with results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import scalars as S
from cohortloom.operators import features, metrics, mining, missingness, temporal


def test_recurrence(spark):
    e = spark.createDataFrame([(1, "X")] * 4 + [(1, "Y")], "case_id int, node string")
    r = features.recurrence(e, "case_id", "node")
    assert sorted(x[0] for x in r.select(features.occurrence_name(F.col("node"), F.col("occurrence"))).collect()) == ["X", "X_R", "X_R2", "X_R3", "Y"]


def test_readmission_window(spark):
    d = datetime.date
    rows = [(1, "p", d(2024, 1, 1), d(2024, 1, 10)), (2, "p", d(2024, 1, 9), d(2024, 2, 1)), (3, "p", d(2024, 2, 1), d(2024, 2, 2)), (4, "p", d(2024, 3, 3), d(2024, 3, 4)), (5, "p", d(2024, 4, 4), d(2024, 4, 5)), (6, None, d(2024, 4, 6), d(2024, 4, 6)), (7, None, d(2024, 4, 7), d(2024, 4, 7))]
    out = features.readmission(spark.createDataFrame(rows, "k int, p string, a date, e date"), "p", "a", "e", "k")
    assert [r["readmitted"] for r in out.orderBy("k").collect()] == [0, 0, 1, 1, 0, 0, 0]


def test_pair_score(spark):
    pairs = spark.createDataFrame([("A", "B", 16, 4, 20, 50, 100, 10)], "a string, b string, n_ab int, pos_ab int, n_a int, n_b int, total int, positives int")
    r = mining.score_pairs(pairs, 0.1, 0.05).first()
    assert (r["src"], r["dst"]) == ("A", "B")
    assert [round(r[c], 6) for c in ("diff", "markov", "lift", "power")] == [0.48, 0.6, 2.5, 1.8]


def test_chi2_and_lift(spark):
    row = spark.range(1).select(S.chi2(F.lit(25), F.lit(50), F.lit(50), F.lit(100)).alias("a"), S.chi2(F.lit(40), F.lit(50), F.lit(50), F.lit(100)).alias("b"), S.chi2(F.lit(0), F.lit(50), F.lit(50), F.lit(100)).alias("c"), S.outcome_lift(F.lit(0), F.lit(5), F.lit(0.1)).alias("d"), S.outcome_lift(F.lit(5), F.lit(100), F.lit(0.1)).alias("e"), S.outcome_lift(F.lit(0), F.lit(0), F.lit(0.1)).alias("f")).first()
    assert (row["a"], row["b"], row["c"]) == (0, 36, None)
    assert [round(row[c], 6) for c in "def"] == [10, 2, 1]


def test_step_up(spark):
    df = spark.createDataFrame([("a", 0.012), ("b", 0.03), ("c", 0.036), ("d", 0.2)], "k string, p double")
    assert [r["kept"] for r in mining.step_up(df, "p", ["k"], 0.05).orderBy("k").collect()] == [True, True, True, False]


def test_bundle():
    assert mining.bundle([("a", "b"), ("b", "c"), ("c", "d")]) == [("a", "b"), ("c", "d")]


def test_bundles_match_the_ranked_choice(spark):
    import random

    r = random.Random(3)
    rows = [(a, b, r.randint(50, 60) / 100) for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" if a < b and r.random() < 0.5]
    got = mining.bundles(spark.createDataFrame(rows, "a string, b string, jaccard double")).collect()
    assert sorted(map(tuple, got)) == sorted(mining.bundle([x[:2] for x in sorted(rows, key=lambda x: (-x[2], *x[:2]))]))
    assert mining.bundles(spark.createDataFrame([], "a string, b string, jaccard double")).count() == 0


def test_bundles_have_no_cap(spark, monkeypatch):
    """12,000 pairs of unused nodes are 12,000 bundles, also by the query."""
    from cohortloom.plans import queries

    wide = spark.range(12_000).selectExpr("concat('x', id) AS a", "concat('y', id) AS b", "9 AS n_ab", "10 AS n_a", "10 AS n_b")
    monkeypatch.setattr(queries, "_margins", lambda *_: (wide, None, None))
    assert queries.QUERIES["jaccard_bundles"](spark, "").count() == 12_000


def test_logic_gate(spark):
    pairs = [("A", "A"), ("NOT_A", "NOT_B"), ("A", "NOT_A"), ("A", "NOT_B"), ("CCSR_RES005", "NOT_CCSR_RES006")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(mining.logical(F.col("a"), F.col("b"))).collect()] == [False, False, False, True, True]


def test_missing_gain(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, 1.0), (0, 1.0, None), (0, 1.0, 1.0)], "y int, a double, b double")
    assert {r["variable"]: r["ig"] for r in missingness.missing_ig(df, ["a", "b"]).collect()} == {"a": 1.0, "b": 0.0}


def test_interaction(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (0, 1.0, 1.0), (0, 1.0, 1.0)], "y int, a double, b double")
    assert missingness.interaction(df, ["a", "b"], 2).first()["ii"] == -1.0


def test_timeline(spark):
    d = datetime.date
    e = spark.createDataFrame([(1, "X", d(2024, 1, 1), 1), (1, "Y", d(2024, 1, 3), 2), (1, "X", d(2024, 1, 3), 3)], "case_id int, code string, day date, slot int")
    placed = temporal.timeline_events(e, "case_id", "code", "day", "slot")
    assert temporal.timelines(placed, "case_id", "code").first()["timeline"] == {"X": 1, "Y": 3, "X_R2": 3}


@pytest.mark.parametrize(("days", "score"), [([1, 3, 5], 1), ([3, 1], 0), ([2, 2], 0.5), ([1, 2, 2, 2], 1 / 6)])
def test_order(spark, days, score):
    assert spark.createDataFrame([(days,)], "d array<int>").select(S.order_expectation(F.col("d"))).first()[0] == pytest.approx(score)


def test_subsequence(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert [df.select(temporal.contains(F.col("t"), p)).first()[0] for p in (["a", "c"], ["c", "a"], ["a", "a"])] == [True, False, False]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, score double")
    assert metrics.roc_auc(df).first()[0] == 0.875
    assert metrics.average_precision(df).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_codes(spark):
    df = spark.createDataFrame([("'0A.1 '", "000", "20240230.0"), ("nan", "0120", "20240229")], "c string, z string, d string")
    rows = df.select(S.clean_code(F.col("c")), S.strip_zeros(F.col("z")), S.parse_day(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [("0A1", "0", None), (None, "120", datetime.date(2024, 2, 29))]


@pytest.mark.parametrize("name", ["bernoulli_nb", "l1_logistic"])
def test_models_take_all_supported_nodes(spark, name):
    from cohortloom.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    want = {r["node"] for r in QUERIES["node_support"](spark, d).where("supported").collect()}
    assert {r["feature"] for r in QUERIES[name](spark, d).collect()} == want
