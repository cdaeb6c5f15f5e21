"""Models on mined features, dose encoding, bootstrap, variants, imputation and boosted trees, against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortloom.functions import scalars, text
from cohortloom.operators import metrics, mining, missingness, models, ranges, sequences, temporal
from cohortloom.sources import tables


def _rows(seed=1, n=240, k=5):
    """Cases that hold some of k features; the first tells the outcome, mostly."""
    r, out = random.Random(seed), []
    for i in range(n):
        held = [f for f in range(k) if r.random() < 0.4]
        out.append((i, int((0 in held) != (r.random() < 0.15)), held))
    return out


@pytest.fixture(scope="module")
def design(spark):
    return spark.createDataFrame(_rows(), "case_id int, y int, held array<int>").repartition(3).persist()


def _matrix(rows, k):
    return np.array([[float(f in h) for f in range(k)] for _, _, h in rows]), np.array([y for _, y, _ in rows])


def test_scores_after_an_observation(spark, design):
    """An Observation leaves something in the session that can't be sent to tasks; models mustn't hold on to the session."""
    seen = Observation()
    design.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 240
    model = models.fit(design, 5, 1.0, True)
    assert metrics.average_precision(models.scores(model, design)).first()[0] > 0.7


def test_fit_and_score(design):
    x, y = _matrix(_rows(), 5)
    model = models.fit(design, 5, 100.0, False)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(model.intercept + x @ np.array(model.coefficients))))
    slope = np.column_stack([np.ones(len(y)), x]).T @ (w * (y - p))
    assert np.abs(slope - np.array([0, *model.coefficients]) / 100).max() < 0.5  # the loss is flat there
    got = {r["case_id"]: r["s"] for r in design.select("case_id", model.score(F.col("held")).alias("s")).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(p.tolist())
    assert models.fit(design.where("y = 1"), 5, 1.0, True).coefficients == (0.0,) * 5 and models.fit(design, 0, 1.0, True).coefficients == ()


def test_subsets_and_spread(design):
    small = models.subset(design, [3, 0])
    assert {r["case_id"]: r["held"] for r in small.collect()} == {i: sorted([0] * (3 in h) + [1] * (0 in h)) for i, _, h in _rows()}
    model = models.fit(small, 2, 1.0, True).spread([3, 0], 5)
    assert model.coefficients[1] == model.coefficients[2] == model.coefficients[4] == 0 and model.coefficients[0] != 0
    assert models.subset(design, []).where("size(held) > 0").count() == 0


def test_naive_bayes(design):
    x, y = _matrix(_rows(), 5)
    p = np.array([(x[y == k].sum(0) + 1) / ((y == k).sum() + 2) for k in (0, 1)])
    want = math.log((y == 1).sum() / (y == 0).sum()) + (x * np.log(p[1] / p[0]) + (1 - x) * np.log((1 - p[1]) / (1 - p[0]))).sum(1)
    model = models.naive_bayes(design, 5)
    assert (model.intercept + x @ np.array(model.coefficients)).tolist() == pytest.approx(want.tolist())


def test_folds_and_evaluation(spark, design):
    dealt = models.folds(design, 3).collect()
    for k in (0, 1):
        order = sorted((r for r in dealt if r["y"] == k), key=lambda r: hashlib.md5(f"{r['case_id']}cv".encode()).hexdigest())
        assert [r["fold"] for r in order] == [(i + 1) % 3 for i in range(len(order))]
    a, b = models.Linear(0.0, (1.0, 0.5, 0, 0, 0)), models.Linear(0.0, (0, 0, 0.25, 0, 1.0))
    both = models.evaluated(design, {"a": a, "b": b})
    for name, m in (("a", a), ("b", b)):
        one = models.scores(m, design)
        assert both[name] == pytest.approx((metrics.average_precision(one).first()[0], metrics.roc_auc(one).first()[0]))
    part = models.evaluated(design, {"a": a}, {"a": F.col("case_id") % 2 == 0})["a"]
    assert part[0] == pytest.approx(metrics.average_precision(models.scores(a, design.where("case_id % 2 = 0"))).first()[0])


def test_grouped_running_sums(spark):
    r = random.Random(3)
    rows = [(g, float(v), r.randint(1, 9)) for g in "ab" for v in r.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for x in ranges.before(df, "v", {"below": "n"}, group=["g"]).collect():
        assert x["below"] == sum(n for g, v, n in rows if g == x["g"] and v < x["v"])


def test_search(design):
    train, val = design.where("case_id % 2 = 0"), design.where("case_id % 2 = 1")
    climbed, every = (models.searched(train, val, 1, [1, 2, 4], [0.01, 0.1, 1.0], climb) for climb in (True, False))
    assert climbed[0] <= every[0] and every[0] == pytest.approx(max(models.evaluated(val, {str((s, c)): models.fit(train, 1 + s, c, True) for s in (1, 2, 4) for c in (0.01, 0.1, 1.0)}).values())[0])
    tried = models.cross_validated(design, 5, [0.01, 1.0])
    assert [c for c, _ in tried] == [0.01, 1.0] and tried[1][1] > 0.7


def test_winners_fall_back():
    names = ["A", "SEQ_A_TO_B", "SEQ_B_TO_C"]
    none, some = models.Linear(0.0, (1.0, 0.0, 0.0)), models.Linear(0.0, (0.1, -0.5))
    assert models.winners([("hybrid", none, names), ("sequences", some, names[1:])]) == ("sequences", [("SEQ_B_TO_C", -0.5), ("SEQ_A_TO_B", 0.1)])
    assert models.winners([("hybrid", models.Linear(0.0, (1.0, 0.0, 2.0)), names), ("sequences", some, names[1:])]) == ("hybrid", [("SEQ_B_TO_C", 2.0)])
    assert models.winners([("hybrid", none, names)]) == (None, [])


def test_dose_encoding(spark):
    """Levels are those of training; a level that only the others have gives no indicator; level 0 exists where a training case lacks the dose."""
    doses = spark.createDataFrame([(1, "p", 1, 2), (2, "p", 1, 3), (3, "p", 1, 9), (1, "q", 1, 2), (2, "q", 1, 2), (5, "q", 1, 4)], "case_id int, path string, node int, dose int")
    train, every = spark.createDataFrame([(1,), (2,), (4,)], "case_id int"), spark.createDataFrame([(i, 0) for i in range(1, 6)], "case_id int, y int")
    encoder = models.dose_encoder(doses, train)
    assert [(r["path"], r["level"], r["feature"]) for r in encoder.orderBy("feature").collect()] == [("p", 0, 0), ("p", 2, 1), ("p", 3, 2), ("q", 0, 3), ("q", 2, 4)]
    assert encoder.where("feature = 1").first()["name"] == "p_[NODE_1_DOSE]_2"
    got = {r["case_id"]: r["held"] for r in models.designed(every, models.dose_rows(every, doses, encoder)).collect()}
    assert got == {1: [1, 4], 2: [2, 4], 3: [3], 4: [0, 3], 5: [0]}


def test_bootstrap_weights_and_intervals(spark, design):
    rows, draws = _rows(), 12

    def weight(i, draw):
        u, p, total, k = int(hashlib.md5(f"{i}-{draw}".encode()).hexdigest()[:8], 16), math.exp(-1), 0.0, 0
        while True:
            total += p
            if u < int(total * 2**32):
                return k
            k += 1
            p /= k

    want = {}
    for i, y, h in rows:
        for d in range(1, draws + 1):
            if w := weight(i, d):
                key = (tuple(h), y, d)
                want[key] = want.get(key, 0) + w
    got = models.bootstrap_weights(design, draws)
    assert {(tuple(r["held"]), r["y"], r["draw"]): r["w"] for r in got.collect()} == want
    assert 0.9 < sum(want.values()) / (len(rows) * draws) < 1.1
    odds = {}
    for f in range(6):
        for d in range(1, draws + 1):
            a, b, c, e = (sum(w for (h, y, k), w in want.items() if k == d and (f in h) == inside and y == out) + 0.5 for inside, out in ((True, 1), (True, 0), (False, 1), (False, 0)))
            odds.setdefault(f, []).append(a * e / (b * c))
    for r in models.crude_intervals(design, 6, draws).collect():
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(odds[r["feature"]], [0.025, 0.975])))
    assert models.crude_intervals(design, 6, draws).where("feature = 0").first()["excludes_one"]


def test_bootstrap_of_refits(spark, design):
    """Every draw's coefficients are those of a weighted fit of its own."""
    small = models.subset(design, [0, 1])
    want = []
    for d in range(1, 6):
        rows = [(r["held"], r["y"], r["w"]) for r in models.bootstrap_weights(small, 5).where(F.col("draw") == d).collect()]
        z, y, w = np.array([[1, 0 in h, 1 in h] for h, _, _ in rows], float), np.array([y for _, y, _ in rows]), np.array([w for _, _, w in rows], float)
        w = w * np.where(y == 1, w.sum() / (2 * w[y == 1].sum()), w.sum() / (2 * w[y == 0].sum()))
        beta = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(3), z.T @ (w * (y - p)) - 1e-6 * beta)
        want.append(np.exp(beta[1:]))
    got = {r["feature"]: (r["low"], r["high"]) for r in models.bootstrap_odds(small, ["A", "B"], 5).collect()}
    for i, name in enumerate("AB"):
        assert got[name] == pytest.approx(tuple(np.quantile([x[i] for x in want], [0.025, 0.975])), rel=1e-6)


def test_variants(spark):
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["b"]), (4, ["b", "a"]), (5, [])], "case_id int, trace array<string>")
    known = temporal.variant_dictionary(t.where("case_id <= 3"))
    assert [(r["feature"], r["trace"], r["cases"]) for r in known.orderBy("feature").collect()] == [(0, ["a", "b"], 2), (1, ["b"], 1)]
    assert sorted(map(tuple, temporal.variant_rows(t, "case_id", known).collect())) == [(1, 0), (2, 0), (3, 1)]
    assert temporal.variant_dictionary(t, least=2).count() == 1 and temporal.variant_dictionary(t, most=1).count() == 1


def test_chained_imputation_of_train(spark):
    """Learned on some rows, filled in all; a plain version round by round."""
    r = random.Random(7)
    rows = []
    for i in range(300):
        a = r.gauss(0, 1)
        rows.append((i, *((v if r.random() > 0.2 else None) for v in (a, 2 * a + r.gauss(0, 0.1), r.gauss(3, 1)))))
    x = np.array([[np.nan if v is None else v for v in row[1:]] for row in rows])
    gap, fit = np.isnan(x), np.arange(300) % 3 > 0
    now = np.where(gap, np.nanmean(x[fit], 0), x)
    for _ in range(3):
        new = now.copy()
        for k in range(3):
            use, others = fit & ~gap[:, k], [i for i in range(3) if i != k]
            b = np.linalg.lstsq(np.column_stack([np.ones(use.sum()), now[use][:, others]]), now[use, k], rcond=None)[0]
            new[gap[:, k], k] = np.column_stack([np.ones(gap[:, k].sum()), now[gap[:, k]][:, others]]) @ b
        now = new
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    out = sorted(map(tuple, missingness.chained_imputation(df, ["a", "b", "c"], 3, F.col("i") % 3 > 0).collect()))
    assert np.array([o[1:] for o in out]).ravel().tolist() == pytest.approx(now.ravel().tolist())
    assert out[0][0] == 0 and missingness.chained_imputation(df.limit(0), ["a", "b"], 1).count() == 0


def test_boosted_grid_finds_planted_gaps(spark):
    """The outcome depends on whether a is missing; trees see it by the indicator, and by the filled value only in part."""
    r = random.Random(5)
    rows = []
    for i in range(600):
        y = int(r.random() < 0.4)
        a = None if r.random() < (0.8 if y else 0.1) else r.gauss(0, 1)
        rows.append((i, a, r.gauss(0, 1), y))
    df = missingness.indicators(spark.createDataFrame(rows, "i int, a double, b double, y int"), ["a"])
    filled = missingness.impute_mean(df, ["a"], F.col("i") < 400).persist()
    cells = {"depths": [2, 3], "rates": [0.3], "trees": [2, 4], "shares": [1.0]}
    got = missingness.boosted_grid(filled.where("i < 400"), filled.where("i >= 400"), ["b", "a_missing"], "i", **cells)
    assert got["importances"][0][0] == "a_missing" and got["auc"] > 0.75 and got["recall"] > 0.6 and got["brier"] < 0.25 and got["trees"] in (2, 4)
    model = missingness._boosted(filled.where("i < 400"), ["b", "a_missing"], 2, 0.3, 4, 1.0, 1.5)
    ours = {round(x["s4"], 9) for x in missingness._margins(model, filled, ["b", "a_missing"], [2, 4]).collect()}
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    theirs = {round(x["p"], 9) for x in model.transform(VectorAssembler(inputCols=["b", "a_missing"], outputCol="_f").transform(filled)).select(vector_to_array("probability")[1].alias("p")).collect()}
    assert ours == theirs


def test_reports_choose_columns(spark):
    df = spark.createDataFrame([(1.0, None, 1), (None, 2.0, 0)], "a double, b double, y int")
    told = spark.createDataFrame([("a", "Pure Noise"), ("b", "Isolated Predictive Missingness")], "variable string, classification string")
    assert missingness.without_noise(df, ["a", "b"], told).columns == ["b", "y", "b_missing"]


def test_counts_of_combinations(spark):
    from itertools import combinations

    r = random.Random(9)
    held = {i: sorted(r.sample("ABCDEFG", r.randint(0, 6))) for i in range(80)}
    nodes = spark.createDataFrame([(i, n, i % 2) for i, own in held.items() for n in own], "case_id int, node string, y int")
    for size, count in ((2, mining.pair_counts), (3, mining.triple_counts)):
        want = {}
        for i, own in held.items():
            for c in combinations(own, size):
                n, pos = want.get(c, (0, 0))
                want[c] = (n + 1, pos + i % 2)
        assert {tuple(x[:size]): tuple(x[size:]) for x in count(nodes).collect()} == want
    assert mining.triple_counts(nodes.limit(0)).count() == 0


def test_step_up_in_ranges(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0.001, 0.01, 0.02, 0.2, 0.9]) * r.choice([1, 1, r.random()])) for i in range(300)]
    got = {x["i"]: (x["rank"], x["kept"]) for x in mining.step_up(spark.createDataFrame(rows, "i int, p double").repartition(7), "p", ["i"], 0.05).collect()}
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    last = max((k for k, (_, p) in enumerate(order, 1) if p <= k / 300 * 0.05), default=0)
    assert got == {i: (k, k <= last) for k, (i, _) in enumerate(order, 1)} and 0 < last < 300


def test_older_growth(spark):
    """A beam keeps the best of a level; the Markov gate is waived for nodes that most cases hold; absences without a floor."""
    r = random.Random(3)
    rows = [[n for n in "ABCD" if r.random() < {"A": 0.3, "B": 0.5, "C": 0.8, "D": 0.4}[n]] for _ in range(120)]
    cases = spark.createDataFrame([(i, int("A" in x)) for i, x in enumerate(rows)], "case_id int, y int")
    present = sequences.atoms(spark.createDataFrame([(i, n) for i, x in enumerate(rows) for n in x], "case_id int, node string"))
    nodes = sequences.build_nodes(present, 120, 3, None)
    assert {n.name for n in nodes if n.negated} == {f"NOT_{n}" for n in "ABCD"}
    miner = sequences.Miner(present, cases, nodes, 120, sum("A" in x for x in rows), 3)
    plain = {tuple(x["seq"]): x for x in miner.mine(3).collect()}
    waived = {tuple(x["seq"]): x for x in miner.mine(3, waived=0.5).collect()}
    of = {n.name: n.n for n in nodes}
    assert set(plain) <= set(waived) and all(len(s) == 3 and of[s[-1]] > 60 and abs(x["markov"]) < 0.05 <= x["diff"] for s, x in waived.items() if s not in plain)
    assert len(waived) > len(plain)
    narrow = [tuple(x["seq"]) for x in miner.mine(3, beam=2).collect()]
    best = sorted((s for s in plain if len(s) == 2), key=lambda s: (-plain[s]["power"], ",".join(s)))[:2]
    assert {s[:2] for s in narrow if len(s) == 3} <= set(best) and set(narrow) <= set(plain)


def test_blank_and_zeros(spark):
    df = spark.createDataFrame([("  ",), ("",), ("a ",), ("007",), ("000",)], "s string")
    assert [x[0] for x in df.select(scalars.blank_to_null(F.col("s"))).collect()][:2] == [None, None]
    assert [x[0] for x in df.select(scalars.strip_zeros(F.col("s"))).collect()][3:] == ["7", "0"]


def test_escalation_sentences(spark):
    df = spark.createDataFrame([("A", "C", "B", 0.1, 0.25), ("A", "C", None, 0.1, 0.05)], "a string, c string, b string, p double, q double")
    got = [x[0] for x in df.select(text.escalation(F.col("a"), F.col("c"), "death", F.col("p"), F.col("q"), F.col("b"))).collect()]
    assert got == ["A: death risk 10.0%. After B, with C, the risk is 25.0% (+15.0%).", "A: death risk 10.0%. with C, the risk is 5.0% (-5.0%)."]
    assert spark.range(1).select(text.thousands(F.lit(1234567))).first()[0] == "1,234,567"


def test_planted_ten_variables(spark):
    """The report finds what was planted: gaps that tell the outcome, and gaps that tell nothing."""
    x = tables.synthetic_missingness(spark, 4000).withColumnRenamed("outcome", "y")
    columns = ["age", "bmi", "heart_rate", "systolic_bp", "length_of_stay", "diabetes", "chf", "renal", "pulmonary", "liver"]
    told = {r["variable"]: r for r in missingness.report(x, columns, 2).collect()}
    assert set(told) == set(columns)
    assert told["length_of_stay"]["missing_ig"] > 0.3 and told["length_of_stay"]["classification"] != "Pure Noise"
    assert told["heart_rate"]["missing_ig"] < 0.01 and told["liver"]["missing_ig"] < 0.01 and told["age"]["missing_ig"] == 0 and told["age"]["baseline_ig"] > 0.05
