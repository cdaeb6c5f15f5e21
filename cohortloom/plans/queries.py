"""Registered queries of the analytics library, each with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars as S
from ..operators import features, metrics, mining, missingness, models, temporal
from ..streaming import timelines
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = Config()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _margins(spark, d):
    nodes, cases = A.basket(spark, d), A.cases(spark, d)
    return mining.with_margins(mining.pair_counts(nodes), nodes, cases), nodes, cases


def _supported_pairs(spark, d):
    """Pairs above the support floor, with margins."""
    floor = F.greatest(F.lit(C.min_support), F.floor(F.col("total") * C.support))
    return _margins(spark, d)[0].where(F.col("n_ab") >= floor)


_LIFT = "CASE WHEN n = 0 THEN 1.0 WHEN pos = 0 THEN 1 / base ELSE least(1 / base, greatest((pos / n) / base, base / (pos / n))) END"
_LIFTED = "(SELECT *, greatest(CAST(positives AS DOUBLE) / total, 0.0001) AS base FROM {})"


def _scored_sql(diff: str) -> str:
    return f"""WITH {A.PAIRS}, p AS (SELECT *, CAST(n_ab AS DOUBLE) / n_a AS ba, CAST(n_ab AS DOUBLE) / n_b AS ab, CAST(pos_ab AS DOUBLE) AS pos, n_ab AS n FROM wide WHERE n_ab >= greatest(3, floor(total * 0.005))),
q AS (SELECT *, {diff} AS d FROM {_LIFTED.format('p')}),
s AS (SELECT CASE WHEN d > 0 THEN a ELSE b END AS src, CASE WHEN d > 0 THEN b ELSE a END AS dst, n_ab, abs(d) AS diff,
CASE WHEN d > 0 THEN (ba - CAST(n_b AS DOUBLE) / total) / (CAST(n_b AS DOUBLE) / total) ELSE (ab - CAST(n_a AS DOUBLE) / total) / (CAST(n_a AS DOUBLE) / total) END AS markov, {_LIFT} AS lift FROM q WHERE abs(d) >= 0.1)
SELECT src, dst, n_ab, round(diff, 6) AS diff, round(markov, 6) AS markov, round(lift, 6) AS lift, round(diff * abs(markov) * lift * lift, 6) AS power FROM s WHERE abs(markov) >= 0.05"""


@query(_scored_sql("ba - ab"))
def pair_power(spark, d):
    return mining.score_pairs(_supported_pairs(spark, d), C.asymmetry, C.markov).select("src", "dst", "n_ab", *_r("diff", "markov", "lift", "power"))


@query(_scored_sql("(ba - ab) / (ba + ab)"))
def pair_power_normalized(spark, d):
    return mining.score_pairs(_supported_pairs(spark, d), C.asymmetry, C.markov, normalized=True).select("src", "dst", "n_ab", *_r("diff", "markov", "lift", "power"))


@query(f"WITH {A.PAIRS} SELECT a, b, n_ab, CAST(pos_ab AS BIGINT) AS pos_ab, round(greatest(CAST(n_b AS DOUBLE) / n_a, CAST(n_a AS DOUBLE) / n_b), 6) AS ratio FROM wide WHERE greatest(CAST(n_b AS DOUBLE) / n_a, CAST(n_a AS DOUBLE) / n_b) >= 1.1")
def pair_divergence_ratio(spark, d):
    wide, *_ = _margins(spark, d)
    ratio = F.greatest(F.col("n_b") / F.col("n_a"), F.col("n_a") / F.col("n_b"))
    return wide.where(ratio >= 1.1).select("a", "b", "n_ab", "pos_ab", F.round(ratio, 6).alias("ratio"))


@query(f"WITH {A.BASKET}, {A.SUPPORT} SELECT node, n, CAST(pos AS BIGINT) AS pos, round(n / CAST(total AS DOUBLE), 6) AS prevalence, n >= greatest(3, floor(total * 0.005)) AS supported FROM sup CROSS JOIN tot")
def node_support(spark, d):
    total = mining.totals(A.cases(spark, d))
    return mining.support(A.basket(spark, d)).crossJoin(F.broadcast(total)).select("node", "n", "pos", F.round(F.col("n") / F.col("total"), 6).alias("prevalence"), (F.col("n") >= F.greatest(F.lit(C.min_support), F.floor(F.col("total") * C.support))).alias("supported"))


@query(f"""WITH {A.BASKET}, {A.SUPPORT}, rep AS (SELECT case_id, node, count(*) AS k FROM ev WHERE node IS NOT NULL GROUP BY 1, 2), rec AS (SELECT node, count(*) AS m FROM rep WHERE k > 1 GROUP BY node)
SELECT 'NOT_' || node AS node, total - n AS n FROM sup CROSS JOIN tot WHERE (total - n) / CAST(total AS DOUBLE) >= 0.05 UNION ALL SELECT 'NOT_' || node || '_R', n - coalesce(m, 0) FROM sup JOIN rec USING (node)""")
def absence_nodes(spark, d):
    """Absence of a node, and of its recurrence where the node is there: counts by complement, no dense columns."""
    total, sup = mining.totals(A.cases(spark, d)), mining.support(A.basket(spark, d))
    base = sup.crossJoin(F.broadcast(total)).select("node", (F.col("total") - F.col("n")).alias("n"), "total").where(F.col("n") / F.col("total") >= C.negative_floor)
    again = features.recurrence(A.basket_events(spark, d), "case_id", "node").where("occurrence = 2").groupBy("node").agg(F.count("*").alias("m"))
    rec = sup.join(again, "node").select(F.concat(F.lit("NOT_"), "node", F.lit("_R")).alias("node"), (F.col("n") - F.col("m")).alias("n"))
    return base.select(F.concat(F.lit("NOT_"), "node").alias("node"), "n").unionByName(rec)


@query(f"WITH {A.PAIRS} SELECT a, b, n_ab, round(CAST(n_ab AS DOUBLE) / (n_a + n_b - n_ab), 6) AS jaccard FROM wide WHERE n_ab >= 5 AND CAST(n_ab AS DOUBLE) / (n_a + n_b - n_ab) >= 0.5")
def jaccard_pairs(spark, d):
    wide, *_ = _margins(spark, d)
    return mining.jaccard(wide, C.min_cooccurrence, 0.5).select("a", "b", "n_ab", *_r("jaccard"))


@query()
def jaccard_bundles(spark, d):
    wide, *_ = _margins(spark, d)
    return mining.bundles(mining.jaccard(wide, C.min_cooccurrence, 0.5)).select(F.concat(F.lit("BUNDLE_"), "a", F.lit("_"), "b").alias("bundle"), "a", "b")


@query(f"""WITH {A.TRIPLES}, p AS (SELECT o.*, n_ab, sup.n AS n_3, total, positives, n_abc AS n, CAST(pos_abc AS DOUBLE) AS pos FROM ord AS o JOIN pairs ON a = least(s1, s2) AND b = greatest(s1, s2) JOIN sup ON sup.node = s3 CROSS JOIN tot
WHERE n_abc >= greatest(3, floor(total * 0.005))), q AS (SELECT s1, s2, s3, n_abc, CAST(n_abc AS DOUBLE) / n_ab - CAST(n_abc AS DOUBLE) / n_3 AS diff, (CAST(n_abc AS DOUBLE) / n_ab - CAST(n_3 AS DOUBLE) / total) / (CAST(n_3 AS DOUBLE) / total) AS markov, {_LIFT} AS lift FROM {_LIFTED.format('p')})
SELECT s1, s2, s3, n_abc, round(diff, 6) AS diff, round(markov, 6) AS markov, round(lift, 6) AS lift, round(diff * abs(markov) * lift * lift, 6) AS power FROM q WHERE diff >= 0.1 AND abs(markov) >= 0.05""")
def extend_level3(spark, d):
    wide, nodes, cases = _margins(spark, d)
    floor = F.greatest(F.lit(C.min_support), F.floor(mining.totals(cases).first()["total"] * F.lit(C.support)))
    return mining.extend(mining.triple_counts(nodes), wide, nodes, cases, floor, C.asymmetry, C.markov).select("s1", "s2", "s3", "n_abc", *_r("diff", "markov", "lift", "power"))


def _chi2_sql(a: str, x: str, y: str, n: str) -> str:
    b, c = f"({x} - {a})", f"({y} - {a})"
    e = f"({n} - {x} - {y} + {a})"
    return f"CASE WHEN {a} > 0 AND {b} > 0 AND {c} > 0 AND {e} > 0 THEN CAST({n} AS DOUBLE) * ({a} * {e} - {b} * {c}) * ({a} * {e} - {b} * {c}) / (CAST({x} AS DOUBLE) * ({n} - {x}) * {y} * ({n} - {y})) END"


@query(f"""WITH {A.TRIPLES}, bth AS (SELECT a AS p, b AS q, n_ab AS n FROM pairs UNION ALL SELECT b, a, n_ab FROM pairs),
t AS (SELECT s1, s2, s3, n_abc, {_chi2_sql('x13.n', 'a1.n', 'a3.n', 'total')} AS whole, {_chi2_sql('n_abc', 'x12.n', 'x23.n', 'a2.n')} AS given FROM ord JOIN sup AS a1 ON a1.node = s1 JOIN sup AS a2 ON a2.node = s2 JOIN sup AS a3 ON a3.node = s3
JOIN bth AS x13 ON x13.p = s1 AND x13.q = s3 JOIN bth AS x12 ON x12.p = s1 AND x12.q = s2 JOIN bth AS x23 ON x23.p = s2 AND x23.q = s3 CROSS JOIN tot)
SELECT s1, s2, s3, n_abc, round(whole, 6) AS chi2, round(given, 6) AS chi2_given, coalesce(whole <= 3.841458820694124 AND given > 3.841458820694124, false) AS rejected FROM t""")
def collider_chi2(spark, d):
    nodes, cases = A.basket(spark, d), A.cases(spark, d)
    return mining.collider(mining.triple_counts(nodes), mining.pair_counts(nodes), nodes, cases, C.chi2_critical).select("s1", "s2", "s3", "n_abc", *_r("chi2", "chi2_given"), "rejected")


@query(f"""WITH {A.TRIPLES}, p AS (SELECT o.*, n_ab, n_abc AS n, CAST(pos_abc AS DOUBLE) AS pos, total, positives, sup.n AS n_3 FROM ord AS o JOIN pairs ON a = least(s1, s2) AND b = greatest(s1, s2) JOIN sup ON sup.node = s3 CROSS JOIN tot WHERE n_abc >= greatest(3, floor(total * 0.005))),
q AS (SELECT *, CAST(n_abc AS DOUBLE) / n_ab - CAST(n_abc AS DOUBLE) / n_3 AS diff, row_number() OVER (PARTITION BY list_sort([s1, s2, s3]) ORDER BY CAST(n_abc AS DOUBLE) / n_ab - CAST(n_abc AS DOUBLE) / n_3 DESC, s1, s2, s3) AS rn FROM p)
SELECT s1, s2, s3, n_abc, round(diff, 6) AS diff FROM q WHERE rn = 1""")
def best_per_set(spark, d):
    wide, nodes, cases = _margins(spark, d)
    floor = F.greatest(F.lit(C.min_support), F.floor(mining.totals(cases).first()["total"] * F.lit(C.support)))
    every = mining.extend(mining.triple_counts(nodes), wide, nodes, cases, floor, -1.0, 0.0)
    return mining.best_of_sets(every, ["s1", "s2", "s3"], "diff").select("s1", "s2", "s3", "n_abc", *_r("diff"))


@query(f"""WITH {A.PAIRS} SELECT a, b, round(CAST(pos_ab AS DOUBLE) / n_ab - CAST(pos AS DOUBLE) / n, 6) AS escalation FROM pairs JOIN sup ON sup.node = a WHERE n_ab >= 5 ORDER BY CAST(pos_ab AS DOUBLE) / n_ab - CAST(pos AS DOUBLE) / n DESC, a, b LIMIT 5""")
def risk_escalation(spark, d):
    nodes = A.basket(spark, d)
    first = mining.support(nodes).select(F.col("node").alias("a"), "n", "pos")
    x = mining.pair_counts(nodes).where("n_ab >= 5").join(F.broadcast(first), "a").withColumn("e", F.col("pos_ab") / F.col("n_ab") - F.col("pos") / F.col("n"))
    return x.orderBy(F.desc("e"), "a", "b").limit(5).select("a", "b", F.round("e", 6).alias("escalation"))


@query(f"""WITH {A.PAIRS}, t AS (SELECT a, b, {_chi2_sql('n_ab', 'n_a', 'n_b', 'total')} AS c FROM wide), r AS (SELECT a, b, c, row_number() OVER (ORDER BY exp(-c / 2), a, b) AS rank, count(*) OVER () AS m FROM t WHERE c IS NOT NULL),
k AS (SELECT max(rank) AS k FROM r WHERE exp(-c / 2) <= rank / CAST(m AS DOUBLE) * 0.05) SELECT a, b, round(exp(-c / 2), 6) AS p_bound, CAST(rank AS INTEGER) AS rank, rank <= coalesce(k, 0) AS kept FROM r CROSS JOIN k""")
def bh_fdr(spark, d):
    """Step-up selection of node pairs by exp(-chi2/2), an upper bound of the p-value that both engines compute alike."""
    wide, *_ = _margins(spark, d)
    tests = wide.select("a", "b", S.chi2(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("total")).alias("c")).where("c is not null").withColumn("p", F.exp(-F.col("c") / 2))
    return mining.step_up(tests, "p", ["a", "b"], C.fdr).select("a", "b", F.round("p", 6).alias("p_bound"), "rank", "kept")


@query(f"""WITH {A.PAIRS}, g AS (SELECT i / 20.0 AS g FROM range(1, 11) AS r(i)) SELECT CAST(g AS DOUBLE) AS asymmetry, CAST(l.m AS DOUBLE) AS markov, count(*) AS pairs FROM (SELECT abs(CAST(n_ab AS DOUBLE) / n_a - CAST(n_ab AS DOUBLE) / n_b) AS d,
abs(CASE WHEN n_b > n_a THEN (CAST(n_ab AS DOUBLE) / n_a - CAST(n_b AS DOUBLE) / total) / (CAST(n_b AS DOUBLE) / total) ELSE (CAST(n_ab AS DOUBLE) / n_b - CAST(n_a AS DOUBLE) / total) / (CAST(n_a AS DOUBLE) / total) END) AS k FROM wide) AS x
JOIN g ON d >= g JOIN (SELECT i / 20.0 AS m FROM range(1, 11) AS r(i)) AS l ON k >= l.m GROUP BY 1, 2""")
def threshold_grid(spark, d):
    """Pairs that pass each cell of a grid of gates: one pass, a row per pair and cell of a fixed grid."""
    wide, *_ = _margins(spark, d)
    s = mining.score_pairs(wide, 0.0, 0.0)
    steps = F.array(*(F.lit(i / 20.0) for i in range(1, 11)))
    x = s.select("diff", F.abs("markov").alias("k"), F.explode(steps).alias("asymmetry")).where("diff >= asymmetry")
    return x.select("asymmetry", "k", F.explode(steps).alias("markov")).where("k >= markov").groupBy("asymmetry", "markov").agg(F.count("*").alias("pairs"))


@query(f"WITH {A.PAIRS}, p AS (SELECT a, b, n_ab FROM pairs WHERE n_ab >= 5), e AS (SELECT 1 AS depth, '' AS parent, a AS child, a AS path, n_ab FROM p UNION ALL SELECT 2, a, b, a || ' > ' || b, n_ab FROM p) SELECT depth, parent, child, path, count(*) AS paths, CAST(sum(n_ab) AS BIGINT) AS value FROM e GROUP BY 1, 2, 3, 4")
def path_tree_edges(spark, d):
    pairs = mining.pair_counts(A.basket(spark, d)).where("n_ab >= 5").withColumnRenamed("n_ab", "value")
    return mining.path_edges(pairs, ["a", "b"])


@query(f"WITH {A.EVENTS}, c AS (SELECT case_id, node, count(*) AS k FROM ev WHERE node IS NOT NULL GROUP BY 1, 2), x AS (SELECT node, unnest(range(1, k + 1)) AS occurrence FROM c) SELECT node || CASE WHEN occurrence = 1 THEN '' WHEN occurrence = 2 THEN '_R' ELSE '_R' || (occurrence - 1) END AS node, count(*) AS cases FROM x GROUP BY 1")
def recurrence_flags(spark, d):
    r = features.recurrence(A.basket_events(spark, d), "case_id", "node")
    return r.groupBy(features.occurrence_name(F.col("node"), F.col("occurrence")).alias("node")).agg(F.count("*").alias("cases"))


_FLAGS = ", ".join(f"CAST(count(*) FILTER (node = '{n}') AS INTEGER) AS \"{n}\"" for n in A.NODES)


@query(f"WITH {A.BASKET} SELECT case_id, {_FLAGS} FROM nodes GROUP BY case_id")
def onehot_presence(spark, d):
    """All nodes of the adapter as columns."""
    return features.onehot(A.basket(spark, d), "case_id", "node", A.NODES)


_DIRTY = "l_orderkey AS k, CASE WHEN l_partkey % 7 = 0 THEN 'nan' ELSE '''' || ' x.' || l_partkey || ' ' END AS raw"


def _lookups(spark, d):
    raw = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_partkey") % 7 == 0, "nan").otherwise(F.concat(F.lit("' x."), F.col("l_partkey").cast("string"), F.lit(" "))).alias("raw"))
    mapping = A.table(spark, d, "part").where("p_partkey % 5 != 0").select(F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_brand").alias("category"), "p_partkey")
    return raw.select("k", S.clean_code(F.col("raw")).alias("code")), features.last_mapping(mapping, "code", "category", "p_partkey")


_LOOK = f"raw AS (SELECT {_DIRTY} FROM lineitem), c AS (SELECT k, CASE WHEN x IN ('', 'NAN', 'NONE', 'NULL') THEN NULL ELSE x END AS code FROM (SELECT k, upper(trim(replace(replace(raw, '''', ''), '.', ''))) AS x FROM raw)), m AS (SELECT 'X' || p_partkey AS code, p_brand AS category FROM part WHERE p_partkey % 5 != 0)"


@query(f"WITH {_LOOK} SELECT category, count(*) AS n FROM c LEFT JOIN m USING (code) GROUP BY category")
def code_lookup(spark, d):
    codes, mapping = _lookups(spark, d)
    return features.lookup(codes, mapping, "code").groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {_LOOK} SELECT code, count(*) AS n FROM c ANTI JOIN m USING (code) WHERE code IS NOT NULL GROUP BY code")
def code_rejects(spark, d):
    codes, mapping = _lookups(spark, d)
    return features.lookup(codes.where("code is not null"), mapping, "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {A.STAYS}, m AS (SELECT median(date_diff('day', admitted, discharged)) AS m FROM stays) SELECT stay_id, CAST(trim(status) = '20' AS INTEGER) AS died, CAST(date_diff('day', admitted, discharged) AS INTEGER) AS los, CAST(date_diff('day', admitted, discharged) > m AS INTEGER) AS los_flag FROM stays CROSS JOIN m")
def outcomes(spark, d):
    x = A.stays(spark, d).select("stay_id", S.died(F.col("status")).alias("died"), S.days_between(F.col("discharged"), F.col("admitted")).alias("los"))
    return features.above_median(x, "los", "los_flag")


@query(f"WITH {A.STAYS}, g AS (SELECT stay_id, date_diff('day', lag(discharged) OVER (PARTITION BY patient ORDER BY admitted, stay_id), admitted) AS gap FROM stays) SELECT stay_id, CAST(gap AS INTEGER) AS gap, CASE WHEN gap BETWEEN 0 AND 30 THEN 1 ELSE 0 END AS readmitted FROM g")
def readmission_30(spark, d):
    return features.readmission(A.stays(spark, d), "patient", "admitted", "discharged", "stay_id", C.readmission_days).select("stay_id", "gap", "readmitted")


@query("SELECT variable, count(x) AS n, count(*) - count(x) AS missing, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(quantile_cont(x, 0.25), 4) AS q25, round(median(x), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q75 FROM (SELECT 'l_quantity' AS variable, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY variable")
def table1_numbers(spark, d):
    return features.describe_numbers(A.table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).select("variable", "n", "missing", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "q25", "median", "q75")))


@query("WITH v AS (SELECT 'segment' AS variable, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR) FROM customer) SELECT variable, value, count(*) AS n, round(100 * count(*) / CAST(sum(count(*)) OVER (PARTITION BY variable) AS DOUBLE), 6) AS percent FROM v GROUP BY 1, 2")
def table1_values(spark, d):
    c = A.table(spark, d, "customer").select(S.map_values(F.col("c_mktsegment"), {"BUILDING": "Construction"}).alias("segment"), F.col("c_nationkey").alias("nation"))
    return features.describe_values(c, ["segment", "nation"]).select("variable", "value", "n", *_r("percent"))


@query(f"WITH {A.CASES}, r AS (SELECT case_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(case_id || 's1'), case_id) / CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) AS s FROM cases) SELECT case_id, y, CASE WHEN s <= 0.6 THEN 'train' WHEN s <= 0.8 THEN 'val' ELSE 'test' END AS split FROM r")
def stratified_split(spark, d):
    return features.stratified_split(A.cases(spark, d), "case_id", "y", "s1").select("case_id", "y", "split")


@query(f"WITH {A.CASES} SELECT case_id, y FROM cases ORDER BY md5(case_id || 's2'), case_id LIMIT 500")
def sample_n(spark, d):
    return features.sample_rows(A.cases(spark, d), "case_id", 500, "s2")


@query(f"WITH {A.DATED} SELECT case_id, slot, code, CAST(date_diff('day', min(day) OVER (PARTITION BY case_id), day) + 1 AS INTEGER) AS relative_day, CAST(row_number() OVER (PARTITION BY case_id, code ORDER BY day, slot) AS INTEGER) AS occurrence FROM dated")
def timeline_days(spark, d):
    return temporal.timeline_events(A.dated(spark, d), "case_id", "code", "day", "slot").select("case_id", "slot", "code", "relative_day", "occurrence")


_PLACED = f"{A.DATED}, placed AS (SELECT case_id, code, CAST(date_diff('day', min(day) OVER (PARTITION BY case_id), day) + 1 AS INTEGER) AS d, row_number() OVER (PARTITION BY case_id, code ORDER BY day, slot) AS o FROM dated)"


@query(f"WITH {_PLACED}, named AS (SELECT case_id, code || CASE WHEN o > 1 THEN '_R' || o ELSE '' END AS name, d FROM placed) SELECT case_id, string_agg(name || '=' || d, ',' ORDER BY name) AS timeline FROM named GROUP BY case_id")
def timeline_map(spark, d):
    lines = temporal.timelines(temporal.timeline_events(A.dated(spark, d), "case_id", "code", "day", "slot"), "case_id", "code")
    text = F.array_join(F.array_sort(F.transform(F.map_entries("timeline"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return lines.select("case_id", text.alias("timeline"))


@query(f"""WITH {_PLACED}, f AS (SELECT case_id, code, d FROM placed WHERE o = 1), p AS (SELECT x.code AS a, y.code AS b, count(*) AS matches, avg(CASE WHEN x.d < y.d THEN 1.0 WHEN x.d = y.d THEN 0.5 ELSE 0.0 END) AS acc FROM f AS x JOIN f AS y ON x.case_id = y.case_id AND x.code != y.code GROUP BY 1, 2)
SELECT a, b, matches, round(acc, 6) AS accuracy, 0.5::DOUBLE AS null_accuracy, round(acc - 0.5, 6) AS lift FROM p""")
def order_accuracy(spark, d):
    placed = temporal.timeline_events(A.dated(spark, d), "case_id", "code", "day", "slot")
    first = placed.where("occurrence = 1").select("case_id", "code")
    pairs = first.withColumnRenamed("code", "a").join(first.withColumnRenamed("code", "b"), "case_id").where("a != b").groupBy("a", "b").agg(F.count("*").alias("total"))
    asked = pairs.select("a", "b", "total", F.to_json(F.array("a", "b")).alias("name"), F.array(F.array("a"), F.array("b")).alias("needs"), F.array().cast("array<string>").alias("absent"))
    out = temporal.validated(temporal.timelines(placed, "case_id", "code"), asked)
    return asked.select("a", "b", "name").join(out, "name").select("a", "b", "matches", *_r("accuracy", "null_accuracy", "lift"))


@query(f"WITH {A.DATED}, t AS (SELECT case_id, string_agg(code, ',' ORDER BY day, slot) AS variant FROM dated GROUP BY case_id) SELECT variant, count(*) AS cases FROM t GROUP BY variant")
def trace_variants(spark, d):
    return temporal.variants(temporal.traces(A.dated(spark, d), "case_id", "code", ["day", "slot"]))


@query(f"WITH {A.DATED}, t AS (SELECT case_id, string_agg(code, ',' ORDER BY day, slot) AS v FROM dated GROUP BY case_id), k AS (SELECT min(code) AS a, max(code) AS b FROM dated) SELECT case_id, regexp_matches(',' || v || ',', ',' || a || ',(.*,)?' || b || ',(.*,)?' || a || ',') AS found FROM t CROSS JOIN k")
def subsequence_match(spark, d):
    e = A.dated(spark, d)
    a, b = e.agg(F.min("code"), F.max("code")).first()
    return temporal.traces(e, "case_id", "code", ["day", "slot"]).select("case_id", temporal.contains(F.col("trace"), [a, b, a]).alias("found"))


@query(f"""WITH RECURSIVE {A.DATED}, e AS (SELECT case_id, code, row_number() OVER (PARTITION BY case_id ORDER BY day, slot) AS i FROM dated), fl AS (SELECT ceil(0.05 * count(DISTINCT case_id)) AS least FROM dated),
g AS (SELECT code AS p, 1 AS k, case_id, min(i) AS i FROM e GROUP BY 1, 3 QUALIFY count(*) OVER (PARTITION BY p) >= (SELECT least FROM fl)
UNION ALL SELECT p, k, case_id, i FROM (SELECT g.p || ',' || e.code AS p, any_value(g.k) + 1 AS k, e.case_id, min(e.i) AS i FROM g JOIN e ON e.case_id = g.case_id AND e.i > g.i GROUP BY 1, 3) QUALIFY count(*) OVER (PARTITION BY p) >= (SELECT least FROM fl))
SELECT p AS pattern, count(*) AS freq FROM g WHERE k > 1 GROUP BY p ORDER BY freq DESC, p LIMIT 500""")
def prefixspan(spark, d):
    """Frequent subsequences of two codes or more, of any length."""
    return models.frequent_sequences(temporal.traces(A.dated(spark, d), "case_id", "code", ["day", "slot"]), 0.05, most=C.prune)


def _h(p: str) -> str:
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0.0 ELSE -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) END)"


def _gain_sql(by: str, source: str, state: str) -> str:
    return f"""g AS (SELECT {by}, {state} AS state, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM {source} GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY {by}) AS nn, sum(pos) OVER (PARTITION BY {by}) AS kk FROM g),
ig AS (SELECT {by}, max({_h('(kk / nn)')}) - sum(n / nn * {_h('(pos / n)')}) AS ig FROM w GROUP BY {by})"""


@query(f"WITH {A.GAPPED}, {_gain_sql('variable', 'long', 'x IS NULL')} SELECT variable, round(ig, 6) AS ig FROM ig")
def missing_ig(spark, d):
    return missingness.missing_ig(A.gaps(spark, d), A.GAPS).select("variable", *_r("ig"))


_COMBOS = """pick AS (SELECT y, [a_qty, b_tax, c_qty, d_disc, e_price, f_price] AS v, ['a_qty', 'b_tax', 'c_qty', 'd_disc', 'e_price', 'f_price'] AS nm FROM gaps),
combo AS (SELECT y, array_to_string(list_transform(c, lambda i: nm[i]), ',') AS combo, array_to_string(list_transform(c, lambda i: (v[i] IS NULL)::INT), '') AS st FROM pick CROSS JOIN
(SELECT [a.i, b.i] AS c FROM range(1, 7) AS a(i) JOIN range(1, 7) AS b(i) ON a.i < b.i UNION ALL SELECT [a.i, b.i, c.i] FROM range(1, 7) AS a(i) JOIN range(1, 7) AS b(i) ON a.i < b.i JOIN range(1, 7) AS c(i) ON b.i < c.i))"""


@query(f"WITH {A.GAPPED}, {_COMBOS}, {_gain_sql('combo', 'combo', 'st')} SELECT combo, round(ig, 6) AS ig FROM ig")
def joint_ig(spark, d):
    """All pairs and triples of the columns."""
    return missingness.joint_ig(A.gaps(spark, d), A.GAPS, 3).where("size > 1").select("combo", *_r("ig"))


_ONE = _gain_sql("variable", "long", "x IS NULL").replace("g AS", "g1 AS", 1).replace("FROM g)", "FROM g1)").replace("w AS", "w1 AS", 1).replace("FROM w ", "FROM w1 ").replace("ig AS", "one AS", 1)
_II = f"{_COMBOS}, {_gain_sql('combo', 'combo', 'st')}, {_ONE}, ii AS (SELECT combo, max(ig.ig) AS joint, max(ig.ig) - sum(one.ig) AS ii FROM ig JOIN one ON list_contains(string_split(combo, ','), one.variable) GROUP BY combo)"


@query(f"WITH {A.GAPPED}, {_II} SELECT combo, round(joint, 6) AS joint, round(ii, 6) + 0.0 AS ii FROM ii")
def interaction_info(spark, d):
    x = missingness.interaction(A.gaps(spark, d), A.GAPS, 3)
    return x.select("combo", F.round("joint", 6).alias("joint"), (F.round("ii", 6) + F.lit(0.0)).alias("ii"))


_BINS = "e AS (SELECT variable, min(x) AS e0, quantile_cont(x, 1/3::DOUBLE) AS e1, quantile_cont(x, 2/3::DOUBLE) AS e2, max(x) AS e3 FROM long WHERE x IS NOT NULL GROUP BY variable), t AS (SELECT variable, y, x, CASE WHEN e0 < e1 AND e1 < e2 AND e2 < e3 THEN CASE WHEN x <= e1 THEN 0 WHEN x <= e2 THEN 1 ELSE 2 END END AS bin FROM long JOIN e USING (variable) WHERE x IS NOT NULL)"


@query(f"WITH {A.GAPPED}, {_BINS}, {_gain_sql('variable', 't', 'coalesce(bin::VARCHAR, x::VARCHAR)')} SELECT variable, round(ig, 6) AS ig FROM ig")
def baseline_ig(spark, d):
    return missingness.baseline_ig(A.gaps(spark, d), A.GAPS).select("variable", *_r("ig"))


_ZONES = f"""{_BINS}, p AS (SELECT variable, avg(y) FILTER (bin = 0) AS p_low, avg(y) FILTER (bin = 1) AS p_mid, avg(y) FILTER (bin = 2) AS p_high FROM t GROUP BY variable),
m AS (SELECT variable, avg(y) FILTER (x IS NULL) AS p_missing, count(x) = 0 AS none FROM long GROUP BY variable),
zones AS (SELECT variable, p_missing, p_low, p_mid, p_high, CASE WHEN p_missing IS NULL THEN 'No Missing Data' WHEN none THEN '100% Missing' WHEN p_low IS NULL OR p_mid IS NULL OR p_high IS NULL THEN 'Unmappable'
WHEN NOT ((p_low <= p_mid AND p_mid <= p_high) OR (p_low >= p_mid AND p_mid >= p_high)) THEN 'Non-Monotonic' WHEN p_missing > greatest(p_low, p_high) THEN 'Extrapolated (Extreme Risk)'
WHEN p_missing < least(p_low, p_high) THEN 'Extrapolated (Benign)' ELSE 'Interpolated (Proxy)' END AS zone FROM m LEFT JOIN p USING (variable))"""


@query(f"WITH {A.GAPPED}, {_ZONES} SELECT variable, round(p_missing, 6) AS p_missing, round(p_low, 6) AS p_low, round(p_mid, 6) AS p_mid, round(p_high, 6) AS p_high, zone FROM zones")
def risk_zones(spark, d):
    return missingness.risk_zones(A.gaps(spark, d), A.GAPS).select("variable", *_r("p_missing", "p_low", "p_mid", "p_high"), "zone")


_BASE = _gain_sql("variable", "t", "coalesce(bin::VARCHAR, x::VARCHAR)").replace("g AS", "g2 AS", 1).replace("FROM g)", "FROM g2)").replace("w AS", "w2 AS", 1).replace("FROM w ", "FROM w2 ").replace("ig AS", "bas AS", 1)


@query(f"""WITH {A.GAPPED}, {_II}, {_ZONES}, {_BASE}, red AS (SELECT combo, string_split(combo, ',') AS c, ii FROM ii WHERE ii < -0.01), each AS (SELECT unnest(c) AS variable, c, len(c) AS size FROM red),
first AS (SELECT variable, arg_min(c, (len(c), array_to_string(c, ','))) AS c FROM each GROUP BY variable),
k AS (SELECT one.variable, one.ig AS missing_ig, coalesce(bas.ig, 0) AS baseline_ig, zone, c FROM one LEFT JOIN bas USING (variable) JOIN zones USING (variable) LEFT JOIN first USING (variable))
SELECT variable, CASE WHEN missing_ig > 0.01 AND baseline_ig <= 0.01 AND c IS NOT NULL THEN CASE len(c) WHEN 2 THEN 'Order 2 (Pair)' ELSE 'Order 3 (Triplet)' END ELSE 'Single Variable' END AS detection_level,
CASE WHEN missing_ig > 0.01 AND baseline_ig <= 0.01 AND c IS NOT NULL THEN array_to_string(list_filter(c, lambda x: x <> variable), ' & ') ELSE 'N/A' END AS linked_to, round(baseline_ig, 4) AS baseline_ig, round(missing_ig, 4) AS missing_ig,
CASE WHEN missing_ig > 0.01 AND baseline_ig > 0.01 THEN 'Predictive Missingness (Informative)' WHEN missing_ig > 0.01 AND c IS NOT NULL THEN 'Structural Block (Redundant)' WHEN missing_ig > 0.01 THEN 'Isolated Predictive Missingness'
WHEN baseline_ig > 0.01 THEN 'Non-Informative Missingness' ELSE 'Pure Noise' END AS classification, CASE WHEN missing_ig > 0.01 AND baseline_ig > 0.01 THEN zone ELSE 'N/A' END AS zone FROM k""")
def missing_report(spark, d):
    return missingness.report(A.gaps(spark, d), A.GAPS, C.interaction_order, C.signal, C.redundancy).withColumns({c: F.bround(c, 4) for c in ("baseline_ig", "missing_ig")})


@query(f"WITH {A.GAPPED}, m AS (SELECT avg(c_qty) AS m FROM gaps WHERE l_orderkey % 10 < 7) SELECT l_orderkey, l_linenumber, round(coalesce(c_qty, m), 6) AS c_qty, CAST(c_qty IS NULL AS INTEGER) AS c_qty_missing FROM gaps CROSS JOIN m")
def impute_and_flag(spark, d):
    x = missingness.indicators(A.gaps(spark, d), ["c_qty"])
    return missingness.impute_mean(x, ["c_qty"], F.col("l_orderkey") % 10 < 7).select("l_orderkey", "l_linenumber", *_r("c_qty"), "c_qty_missing")


@query(f"WITH {A.SCORED}, r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM scored) SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(count(*) - sum(y) AS DOUBLE)), 6) AS auc FROM r")
def auc_roc(spark, d):
    return metrics.roc_auc(A.scored(spark, d)).select(*_r("auc"))


@query(f"WITH {A.SCORED}, g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM g) SELECT round(sum(pos * CAST(tp AS DOUBLE) / seen) / CAST(sum(pos) AS DOUBLE), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return metrics.average_precision(A.scored(spark, d)).select(*_r("average_precision"))


@query(f"WITH {A.SCORED} SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM scored")
def brier(spark, d):
    return metrics.brier(A.scored(spark, d)).select(*_r("brier"))


@query(f"WITH {A.SCORED} SELECT count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn FROM scored")
def confusion(spark, d):
    return metrics.confusion(A.scored(spark, d), 0.5)


def _supported(spark, d):
    """The one-hot table of all nodes above the support floor with the outcome, and their names."""
    nodes, cases = A.basket(spark, d), A.cases(spark, d)
    floor = F.greatest(F.lit(C.min_support), F.floor(F.col("total") * C.support))
    rows = mining.support(nodes).crossJoin(F.broadcast(mining.totals(cases))).where(F.col("n") >= floor).select("node").collect()
    values = sorted(r["node"] for r in rows)
    return features.onehot(nodes, "case_id", "node", values).join(cases, "case_id").withColumnsRenamed({v: f"v{i}" for i, v in enumerate(values)}), values


def _named(found, values):
    """The result of a model of the columns v0, v1, ... with the names of the nodes."""
    names = F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (f"v{i}", v)))
    return found.withColumn("feature", names[F.col("feature")])


@query()
def l1_logistic(spark, d):
    wide, values = _supported(spark, d)
    return _named(models.logistic(wide, [f"v{i}" for i in range(len(values))], "y", c=0.1, l1=True), values)


@query(f"""WITH {A.BASKET}, {A.SUPPORT} SELECT node AS feature, (n - pos + 1) / CAST(total - positives + 2 AS DOUBLE) AS p_given_0, (pos + 1) / CAST(positives + 2 AS DOUBLE) AS p_given_1 FROM sup CROSS JOIN tot
WHERE n >= greatest(3, floor(total * 0.005))""")
def bernoulli_nb(spark, d):
    wide, values = _supported(spark, d)
    return _named(models.bernoulli_nb(wide, [f"v{i}" for i in range(len(values))], "y"), values)


_WINDOWS = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query(_WINDOWS)
def event_windows(spark, d):
    return timelines.windowed_counts(A.table(spark, d, "events"), "ts", "event_type")


@query(_WINDOWS)
def event_windows_streamed(spark, d):
    """The same from a stream over the table, with its state in a checkpoint."""
    mining.checkpoint_dir(spark)
    top = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    kind = dict(spark.read.parquet(path).dtypes)["ts"]  # streams take times with a zone only, and a single file only by a pattern
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = timelines.kept_up(timelines.windowed_counts(events, "ts", "event_type"), f"{top}/out", f"{top}/state")
    return kept.withColumn("start", F.col("start").cast(kind))
