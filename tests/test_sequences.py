"""The miner against brute force, order statistics, temporal validation, older variants, models and sources."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import text as T
from cohortloom.operators import features, metrics, mining, missingness, models, ranges, sequences, temporal
from cohortloom.sources import tables


def _miner(spark, rows, y, floor=2, bundled=()):
    cases = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "case_id int, y int")
    events = spark.createDataFrame([(i, n) for i, r in enumerate(rows) for n in r], "case_id int, node string")
    present = sequences.atoms(events)
    nodes = sequences.build_nodes(present, len(y), floor, 0.05, list(bundled))
    return sequences.Miner(present, cases, nodes, len(y), sum(y), floor)


def test_mining_equals_brute_force(spark):
    r = random.Random(3)
    rows = [[x for x in "ABCD" for _ in range(r.choice([0, 0, 1, 1, 2]))] for _ in range(60)]
    y = [int(("A" in x) != (r.random() < 0.2)) for x in rows]
    miner = _miner(spark, rows, y, 3)
    total, base, floor, crit = 60, sum(y) / 60, 3, 3.841458820694124

    def mask(node):
        bare = node.removeprefix("NOT_")
        name, need = bare.split("_R")[0], 2 if "_R" in bare else 1
        if "_R" in bare and bare.split("_R")[1]:
            need = 1 + int(bare.split("_R")[1])
        has = np.array([x.count(name) >= need for x in rows])
        return has if bare == node else (np.array([name in x for x in rows]) & ~has if need > 1 else ~has)

    names = [n.name for n in miner.nodes]
    m = {n: mask(n) for n in names}
    assert all(m[n.name].sum() == n.n for n in miner.nodes)
    root = {n.name: n.root for n in miner.nodes}

    def ok(a, b):
        x, z = a.startswith("NOT_"), b.startswith("NOT_")
        return not (x and z) and not (root[a] == root[b] and x != z)

    def chi(a, b, within):
        n = within.sum()
        o = [(a & b & within).sum(), (a & ~b & within).sum(), (~a & b & within).sum(), (~a & ~b & within).sum()]
        return None if min(o) == 0 else n * (o[0] * o[3] - o[1] * o[2]) ** 2 / ((o[0] + o[1]) * (o[2] + o[3]) * (o[0] + o[2]) * (o[1] + o[3]))

    def trap(seq, z):
        for x in seq[:-1]:
            free, tied = chi(m[x], m[z], np.ones(total, bool)), chi(m[x], m[z], m[seq[-1]])
            if free is not None and tied is not None and free <= crit and tied > crit:
                return True
        return False

    want, front = {}, [s for s in permutations(names, 2) if ok(*s) and (m[s[0]] & m[s[1]]).sum() >= floor]
    grown = front
    for _ in range(2):
        for s in front:
            both, before = np.logical_and.reduce([m[x] for x in s]), np.logical_and.reduce([m[x] for x in s[:-1]])
            n = both.sum()
            diff, own = n / before.sum() - n / m[s[-1]].sum(), m[s[-1]].sum() / total
            markov = (n / before.sum() - own) / own
            if diff >= 0.1 and abs(markov) >= 0.05:
                p = (both & np.array(y, bool)).sum() / n
                lift = 1 / base if p == 0 else min(1 / base, max(p / base, base / p))
                want[s] = round(diff * abs(markov) * lift * lift, 9)
        front = [(*s, z) for s in grown for z in names if z not in s and ok(s[-1], z) and not trap(s, z) and (np.logical_and.reduce([m[x] for x in s]) & m[z]).sum() >= floor]
        grown = front
    got = {tuple(x["seq"]): round(x["power"], 9) for x in miner.mine(3).collect()}
    assert got == pytest.approx(want) and len(want) > 50


def test_bundles_and_word_boundary(spark):
    """70 nodes take two words; a bundle is minable and its members aren't."""
    rows = [[f"n{j:02d}" for j in range(70) if (i + j) % 3] for i in range(30)]
    miner = _miner(spark, rows, [i % 2 for i in range(30)], 3, bundled=[("n00", "n01", 10)])
    names = [n.name for n in miner.nodes]
    assert miner.words == 2 and "BUNDLE_n00_n01" in names and "n00" not in names and "NOT_n01" not in names
    asked = spark.createDataFrame([(["n62", "n63"],), (["n65", "NOT_n64"],), (["BUNDLE_n00_n01"],)], "seq array<string>")
    numbered = miner.numbered(asked)
    n = {tuple(r["seq"]): r["n"] for r in numbered.join(miner.counts(numbered.select("items")), "items").collect()}
    has = lambda i, *js: all((i + j) % 3 for j in js)
    assert n == {("n62", "n63"): sum(has(i, 62, 63) for i in range(30)), ("n65", "NOT_n64"): sum(has(i, 65) and not has(i, 64) for i in range(30)), ("BUNDLE_n00_n01",): sum(has(i, 0, 1) for i in range(30))}


def test_null_and_selection(spark):
    found = spark.createDataFrame([(["a", "b"], 100, 0.5, 0.5, 3.0), (["b", "c"], 100, 0.2, 0.5, 0.1), (["c", "d"], 50, 0.3, 0.5, 0.2)], "seq array<string>, n long, diff double, markov double, power double")
    null = sequences.hypergeometric_null(found, 1000, 300, 2000).toPandas()
    assert null["times"].sum() == 6000
    p = {tuple(r["seq"]): r["p_value"] for r in sequences.empirical_p(found, spark.createDataFrame(null)).collect()}
    for seq, power in ((("a", "b"), 3.0), (("b", "c"), 0.1), (("c", "d"), 0.2)):
        assert p[seq] == pytest.approx((null["times"][null["power"].round(9) >= power].sum() + 1) / 6001)
    tested = sequences.significant(sequences.empirical_p(found, spark.createDataFrame(null)))
    assert [r["kept"] for r in tested.orderBy("rank").collect()][0] is True
    assert [r["seq"] for r in sequences.top(found, 2).collect()] == [["a", "b"], ["c", "d"]]


def test_doses(spark):
    families = sequences.dose_families(["SEQ_x_R2_TO_y", "SEQ_x_R3_TO_y", "SEQ_z_R2_TO_y", "SEQ_x_R_TO_y"])
    assert families == {"SEQ_x_TO_y": [("SEQ_x_R2_TO_y", [2]), ("SEQ_x_R3_TO_y", [3])]}
    held = spark.createDataFrame([(1, "SEQ_x_R2_TO_y"), (1, "SEQ_x_R3_TO_y"), (2, "SEQ_x_R2_TO_y"), (2, "SEQ_z_R2_TO_y")], "case_id int, name string")
    assert {(r["case_id"], r["dose"]) for r in sequences.doses(held, families).collect()} == {(1, 3), (2, 2)}


def test_quantiles_and_ranks(spark):
    r = random.Random(5)
    rows = [("ab"[i % 2], round(r.gauss(0, 5), r.choice([0, 3])), r.randint(0, 1)) for i in range(2000)] + [("c", 1.0, 1), ("a", None, 0)]
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(5)
    for x in ranges.quantiles(df, ["g"], "x", [0.0, 1 / 3, 0.5, 0.9, 1.0]).collect():
        own = [v for g, v, _ in rows if g == x["g"] and v is not None]
        assert x["q"] == pytest.approx(list(np.quantile(own, [0.0, 1 / 3, 0.5, 0.9, 1.0])))
    assert ranges.quantiles(df.where("x > 99"), ["g"], "x", [0.5]).count() == 0
    scored = df.where("x is not null").select("y", F.col("x").alias("score"))
    s, y = np.array([v for _, v, _ in rows if v is not None]), np.array([t for _, v, t in rows if v is not None])
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1][:400] for b in s[y == 0]])
    few = spark.createDataFrame([(int(t), float(v)) for v, t in zip([*s[y == 1][:400], *s[y == 0]], [1] * 400 + [0] * int((y == 0).sum()), strict=True)], "y int, score double")
    assert metrics.roc_auc(few).first()[0] == pytest.approx(want) and metrics.average_precision(scored).first()[0] > 0.3


def test_chi2_of_large_counts(spark):
    from cohortloom.functions import scalars as S

    n = 4_000_000_000
    row = spark.range(1).select(S.chi2(F.lit(n // 4), F.lit(n // 2), F.lit(n // 2), F.lit(n)).alias("x")).first()
    assert row["x"] == 0


def test_temporal_validation(spark):
    lines = spark.createDataFrame([(1, {"a": 1, "b": 3}), (2, {"a": 4, "b": 2}), (3, {"a": 1, "b": 2, "c": 2}), (4, {"a": 2, "d": 1, "b": 2})], "case_id int, timeline map<string,int>")
    names = spark.createDataFrame([("SEQ_a_TO_b", 8), ("SEQ_a_TO_NOT_c_TO_b", 4), ("SEQ_X_TO_b", 4), ("SEQ_a_[NODE_1_DOSE]", 4)], "name string, total int")
    asked = temporal.parsed(names, {"X": ["d", "a"]})
    out = {r["name"]: r for r in temporal.validated(lines, asked).collect()}
    assert (out["SEQ_a_TO_b"]["matches"], out["SEQ_a_TO_b"]["accuracy"], out["SEQ_a_TO_b"]["coverage"]) == (4, (1 + 0 + 1 + 0.5) / 4, 0.5)
    assert (out["SEQ_a_TO_NOT_c_TO_b"]["matches"], out["SEQ_a_TO_NOT_c_TO_b"]["lift"]) == (3, 0.0)
    assert (out["SEQ_X_TO_b"]["matches"], out["SEQ_X_TO_b"]["accuracy"]) == (1, 0.5)
    assert (out["SEQ_a_[NODE_1_DOSE]"]["matches"], out["SEQ_a_[NODE_1_DOSE]"]["accuracy"]) == (0, None)
    assert temporal.validated(lines, asked, first_member_only=True).where("name = 'SEQ_X_TO_b'").first()["accuracy"] == 1.0
    assert [r["name"] for r in temporal.best_ordered(temporal.validated(lines, asked), 1).collect()] == ["SEQ_a_TO_b"]


def test_clashing_timeline_names(spark):
    placed = spark.createDataFrame([(1, "X", 2, 5), (1, "X_R2", 1, 9)], "case_id int, code string, occurrence int, relative_day int")
    assert temporal.timelines(placed, "case_id", "code").first()["timeline"] == {"X_R2": 9}


def test_older_gates(spark):
    rows = [(["A", "B"],), (["A", "A"],), (["U", "A"],), (["U", "NOT_A"],), (["CCS_ADM_DX_1", "CCS_ADM_DX_2"],), (["A", "NOT_A"],)]
    df = spark.createDataFrame(rows, "s array<string>")
    assert [r[0] for r in df.select(mining.path_valid(F.col("s"), {"U": ("A", "B")})).collect()] == [True, False, False, False, False, False]
    rows = [(["CCS_ADM_DX_1", "A", "OUT"],), (["A", "CCS_ADM_DX_1"],), (["OUT", "A"],), (["A", "OUT", "B"],), (["A", "B"],)]
    df = spark.createDataFrame(rows, "s array<string>")
    assert [r[0] for r in df.select(mining.chronological(F.col("s"), "OUT")).collect()] == [True, False, False, False, True]
    row = spark.range(1).select(mining.uncapped_lift(F.lit(5), F.lit(10), F.lit(0.1)).alias("a"), mining.uncapped_lift(F.lit(0), F.lit(10), F.lit(0.1)).alias("b")).first()
    assert (row["a"], row["b"]) == (5.0, 1000.0)
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.99)], "a string, b string, jaccard double")
    assert [tuple(r) for r in mining.bundles_in_order(pairs).collect()] == [("a", "b")]


def test_missing_report_on_planted_gaps(spark):
    x = tables.dual_triggers(spark, 3000).withColumnRenamed("outcome", "y")
    told = {r["variable"]: r for r in missingness.report(x, ["bmi", "a1c_lab", "age", "elixhauser_chf"]).collect()}
    assert told["age"]["classification"].startswith(("Predictive", "Non-Informative")) and told["elixhauser_chf"]["missing_ig"] == 0
    assert told["a1c_lab"]["missing_ig"] >= 0
    text = spark.createDataFrame([(1, "u"), (1, "u"), (0, "v"), (0, None)], "y int, c string")
    assert missingness.baseline_ig(text, ["c"]).first()["ig"] == pytest.approx(0.918296, abs=1e-6)
    assert missingness.risk_zones(text, ["c"]).first()["zone"] == "Unmappable"
    assert [r["c"] for r in missingness.impute_mode(text, ["c"], F.lit(True)).collect()] == ["u", "u", "v", "u"]


def test_chained_imputation(spark):
    rows = [(float(i), 2.0 * i + 1 if i % 4 else None) for i in range(40)]
    out = missingness.chained_imputation(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 2)
    assert all(r["b"] == pytest.approx(2 * r["a"] + 1, abs=1e-2) for r in out.collect())


def test_search_and_models(spark):
    calls = []

    def value(size, c):
        calls.append((size, c))
        return {50: 0.5, 100: 0.6}.get(size, 0.4) - abs(c - 0.1)

    assert models.hill_climb(value, [50, 100, 150, 200, 300], [0.01, 0.1, 0.5, 1.0, 2.0])[1:] == (100, 0.1)
    assert (300, 0.1) not in calls and (50, 2.0) not in calls
    assert models.grid(value, [50, 100], [0.01, 0.1])[1:] == (100, 0.1)
    assert [models.conclusion(x, 0.5) for x in (0.502, 0.5, 0.49)] == ["improves", "equal", "degrades"]
    r = random.Random(2)
    rows = [["A"] * (i % 2) + ["B"] * r.randint(0, 1) for i in range(200)]
    miner = _miner(spark, rows, [int(("A" in x) != (r.random() < 0.15)) for x in rows])
    data = models.design(miner, [["A"], ["B"], ["A", "B"]])
    assert models.selected(data, ["A", "B", "AB"], 0.05, 1.0)[0] == "A"
    assert max(models.cross_validated(data, 3, [0.1, 1.0]), key=lambda x: x[1])[1] > 0.7
    odds = {x["feature"]: x for x in models.bootstrap_odds(models.design(miner, [["A"], ["B"]]), ["A", "B"], 30).collect()}
    assert odds["A"]["excludes_one"] and odds["A"]["low"] > 5 and not odds["B"]["low"] > 2


def test_text(spark):
    df = spark.createDataFrame([("CCSR_X_R2",), ("NOT_CCSR_X",), ("BUNDLE_CCSR_X_CCSR_Y",), ("DIED",)], "n string")
    assert [r[0] for r in df.select(T.described(F.col("n"), {"X": "heart"})).collect()] == ["heart (Recurrence)", "Absence of heart", "Concurrent [heart & Y]", "DIED"]
    row = spark.range(1).select(T.percent(F.lit(0.1234)).alias("a"), T.percent(F.lit(0.05), True).alias("b")).first()
    assert (row["a"], row["b"], T.share(5), T.share(0.05)) == ("12.3%", "+5.0%", 0.05, 0.05)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("007", "x"), ("8", None)], "code string, name string")
    tables.write_csv(df, f"{tmp_path}/t")
    assert sorted(r["code"] for r in tables.read_csv_text(spark, f"{tmp_path}/t").collect()) == ["007", "8"]
    assert {r["code"] for r in tables.read_csv_typed(spark, f"{tmp_path}/t", "code int, name string").collect()} == {7, 8}
    assert tables.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    assert tables.find_column(df, "COD") == "code"
    with pytest.raises(ValueError, match="no column"):
        tables.find_column(df, "zzz")
    lines = spark.createDataFrame([("p", {"a": 1})], "patient_id string, timeline map<string,int>")
    tables.write_timelines(lines, f"{tmp_path}/j")
    assert tables.read_timelines(spark, f"{tmp_path}/j").first()["timeline"] == {"a": 1}
    assert [r["code"] for r in tables.head(df, 1, "code").collect()] == ["007"]
    tables.write_matrix(df, ["name"], f"{tmp_path}/m")
    assert tables.read_csv_text(spark, f"{tmp_path}/m").columns == ["name"]
    assert tables.synthetic_missingness(spark, 500).where("heart_rate is null").count() > 20


def test_cohort(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 9.0)], "k string, t double")
    with pytest.warns(UserWarning):
        assert features.cohort(df, "none", "a").count() == 4
    with pytest.raises(ValueError, match="no rows"):
        features.cohort(df, "k", "zz")
    assert sorted(r["t"] for r in features.binarised(features.cohort(df, "k", "a"), "t").collect()) == [0, 0, 1]
