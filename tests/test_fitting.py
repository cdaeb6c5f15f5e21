"""Many models at once: steps, ranks, bootstrap weights and designs, against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import poisson
from cohortloom.operators import fitting, metrics, missingness, models, sequences


def _rows(seed=1, n=600, k=7):
    r, out = random.Random(seed), []
    for i in range(n):
        held = [f for f in range(k) if r.random() < 0.4]
        out.append((i, int((0 in held) != (r.random() < 0.1)), held))
    return out


@pytest.fixture(scope="module")
def design(spark):
    return spark.createDataFrame(_rows(), "case_id int, y int, held array<int>").repartition(3).persist()


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_cells_share_their_steps(spark, design):
    """Every cell, L1 or L2, on all rows or without a fold, reaches its own optimum; a search of 24 cells takes fewer jobs than steps of one fit each would."""
    p = fitting.patterns(design.withColumn("fold", F.col("case_id") % 3), 7, "fold")
    cells = [fitting.Cell(keep, c, l1, without) for keep in (tuple(range(7)), (0, 2, 5)) for c in (0.02, 1.0) for l1 in (True, False) for without in (None, 0, 2)]
    found, jobs = _jobs(spark, "cells", lambda: models.fit_cells(p, cells))
    assert jobs < 100
    for cell, model in zip(cells, found, strict=True):
        rows = [r for r in _rows() if r[0] % 3 != cell.without]
        x, y = np.array([[float(f in h) for f in range(7)] for _, _, h in rows]), np.array([y for _, y, _ in rows])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        b = np.array(model.coefficients)
        slope = (w * (1 / (1 + np.exp(-(model.intercept + x @ b))) - y)) @ np.column_stack([x, np.ones(len(y))])
        assert abs(slope[-1]) < 0.01
        for f in range(7):
            if f not in cell.keep:
                assert b[f] == 0
            elif not cell.l1:
                assert abs(slope[f] + b[f] / cell.c) < 0.01
            elif b[f]:
                assert abs(slope[f] + np.sign(b[f]) / cell.c) < 0.01
            else:
                assert abs(slope[f]) < 1 / cell.c + 0.01


def test_ranks_in_ranges(spark, design, monkeypatch):
    """Average precision and AUC are the same however many ranges margins are dealt to."""
    given = [models.Linear(0.125, (1.0, 0.5, 0.25, -0.5, 0, 0, 2.0)), models.Linear(0.0, (0, 0, 0, 0, 1.0, 0, 0))]
    want = [(metrics.average_precision(s).first()[0], metrics.roc_auc(s).first()[0]) for s in (models.scores(m, design) for m in given)]
    for most in (50_000, 10):
        monkeypatch.setattr(fitting, "RANKED", most)
        got = models.ranked(fitting.patterns(design, 7), dict(enumerate(given)))
        for i, pair in enumerate(want):
            assert got[i] == pytest.approx(pair)


def test_poisson_weights():
    """Weights follow the md5 of every case and draw, whatever the length of its key."""
    keys, steps = ["-", "7-", "123456789-", "x" * 60 + "-", "é-", ""], [int(s, 16) for s in poisson.STEPS]
    got = poisson.weights(pa.array(keys), 120)
    for key, row in zip(keys, got.tolist(), strict=True):
        assert row == [sum(int(hashlib.md5(f"{key}{d}".encode()).hexdigest()[:8], 16) >= s for s in steps) for d in range(1, 121)]


def test_designs_and_pairs_of_a_miner(spark):
    """Designs made from masks are those of the join, dealt to more than one task although the table is small; pairs are those that the join counts."""
    r = random.Random(5)
    rows = [[n for n in "ABCDE" if r.random() < 0.4] * (1 + i % 2) for i in range(5000)]
    cases = spark.createDataFrame([(i, int("A" in x)) for i, x in enumerate(rows)], "case_id int, y int")
    present = sequences.atoms(spark.createDataFrame([(i, n) for i, x in enumerate(rows) for n in x], "case_id int, node string"), 2)
    miner = sequences.Miner(present, cases, sequences.build_nodes(present, 5000, 3), 5000, sum("A" in x for x in rows), 3)
    wanted = [["A"], ["NOT_B"], ["A_R", "C"], ["NOT_A_R", "D", "E"]]
    design = models.design(miner, wanted)
    assert design.rdd.getNumPartitions() > 1
    assert {r["case_id"]: r["held"] for r in design.collect()} == {r["case_id"]: r["held"] for r in models.designed(cases, models.feature_rows(miner, wanted)).collect()}
    k = len(miner.nodes)
    joined = miner.counts(spark.createDataFrame([([i, j],) for i in range(k) for j in range(i + 1, k)], "items array<int>"))
    assert {tuple(x["items"]): (x["n"], x["pos"]) for x in miner.pairs().collect()} == {tuple(x["items"]): (x["n"], x["pos"]) for x in joined.collect()}
    t = spark.createDataFrame([([i, j, m],) for i in range(k) for j in range(i + 1, k) for m in range(j + 1, k)], "items array<int>")
    assert {tuple(x["items"]): (x["n"], x["pos"]) for x in miner.triples().collect()} == {tuple(x["items"]): (x["n"], x["pos"]) for x in miner.counts(t).collect()}


def test_equal_rows_grow_one_tree(spark):
    """Trees on rows that stand for many equal ones are those of all rows, and so are their ranks."""
    r = random.Random(8)
    rows = [(r.randint(0, 5), r.randint(0, 3)) for _ in range(900)]
    every = spark.createDataFrame([(float(a), float(b), int(r.random() < 0.2 + 0.6 * (a > b))) for a, b in rows], "a double, b double, y int")
    alike = every.groupBy("a", "b", "y").agg(F.count("*").alias("n")).persist()
    assert alike.count() < 60
    fitted = [missingness._boosted(own, ["a", "b"], 2, 0.3, 3, 1.0, 1.5) for own in (every, alike)]
    scored = [sorted(round(x["s3"], 9) for x in missingness._margins(m, every, ["a", "b"], [3]).collect()) for m in fitted]
    assert scored[0] == scored[1]
    ranks = [metrics.ranked(x.select(F.lit("m").alias("m"), "y", (F.col("a") - F.col("b")).alias("score"), *(["n"] if "n" in x.columns else [])), "m", *(["n"] if "n" in x.columns else [])).first() for x in (every, alike)]
    assert ranks[0]["auc"] == pytest.approx(ranks[1]["auc"]) and ranks[0]["average_precision"] == pytest.approx(ranks[1]["average_precision"])
