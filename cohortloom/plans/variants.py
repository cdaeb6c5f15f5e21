"""Registered queries of the temporal validation, the older mining variants, models over mined sequences, and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import features, metrics, mining, missingness, models, temporal
from ..sources import tables
from . import adapters as A
from .queries import _PLACED, C, _margins, _r, query


def _asked(spark, d):
    """Ordered pairs of the event types, alone and with each third type absent; total: cases with the first code."""
    e = A.dated(spark, d)
    codes = mining.cut(e.select("code").distinct())
    a, b, c = (codes.select(F.col("code").alias(x)) for x in "abc")
    pairs = a.join(b, F.col("a") != F.col("b"))
    name = lambda *parts: F.concat(F.lit("SEQ_"), *(x for i, p in enumerate(parts) for x in ((F.lit("_TO_"), p) if i else (p,)))).alias("name")
    third = pairs.join(c, (F.col("c") != F.col("a")) & (F.col("c") != F.col("b")))
    table = temporal.parsed(pairs.select(name(F.col("a"), F.col("b"))).unionByName(third.select(name(F.col("a"), F.concat(F.lit("NOT_"), "c"), F.col("b")))))
    sizes = e.select("case_id", "code").distinct().groupBy("code").agg(F.count("*").alias("total"))
    return table.withColumn("code", F.col("needs")[0][0]).join(sizes, "code").drop("code")


_VALID = f"""{_PLACED}, f AS (SELECT case_id, code, d FROM placed WHERE o = 1), code AS (SELECT code, count(*) AS total FROM f GROUP BY code),
s AS (SELECT x.code AS a, y.code AS b, NULL AS c, x.total, 'SEQ_' || x.code || '_TO_' || y.code AS name FROM code AS x JOIN code AS y ON x.code <> y.code
UNION ALL SELECT x.code, y.code, z.code, x.total, 'SEQ_' || x.code || '_TO_NOT_' || z.code || '_TO_' || y.code FROM code AS x JOIN code AS y ON x.code <> y.code JOIN code AS z ON z.code NOT IN (x.code, y.code)),
h AS (SELECT name, count(*) AS matches, avg(CASE WHEN x.d < y.d THEN 1.0 WHEN x.d = y.d THEN 0.5 ELSE 0.0 END) AS accuracy FROM s JOIN f AS x ON x.code = a JOIN f AS y ON y.code = b AND y.case_id = x.case_id
WHERE c IS NULL OR NOT EXISTS (SELECT 1 FROM f AS z WHERE z.case_id = x.case_id AND z.code = c) GROUP BY name),
v AS (SELECT name, CAST(2 AS INTEGER) AS nodes, coalesce(matches, 0) AS matches, coalesce(matches, 0) / CAST(total AS DOUBLE) AS coverage, CASE WHEN matches > 0 THEN 0.5::DOUBLE END AS null_accuracy, accuracy, accuracy - 0.5 AS lift FROM s LEFT JOIN h USING (name))"""


@query(f"WITH {_VALID} SELECT name, nodes, matches, round(coverage, 6) AS coverage, null_accuracy, round(accuracy, 6) AS accuracy, round(lift, 6) AS lift FROM v")
def temporal_validation(spark, d):
    """Whether cases that hold a sequence, absences included, have its events in order."""
    lines = temporal.timelines(temporal.timeline_events(A.dated(spark, d), "case_id", "code", "day", "slot"), "case_id", "code")
    return temporal.validated(lines, _asked(spark, d)).select("name", "nodes", "matches", *_r("coverage", "null_accuracy", "accuracy", "lift"))


@query(f"WITH {_VALID} SELECT name, round(lift, 6) AS lift, round(coverage, 6) AS coverage FROM v WHERE matches > 0 ORDER BY round(lift, 3) DESC, round(coverage, 3) DESC, name LIMIT 5")
def temporal_top5(spark, d):
    lines = temporal.timelines(temporal.timeline_events(A.dated(spark, d), "case_id", "code", "day", "slot"), "case_id", "code")
    return temporal.best_ordered(temporal.validated(lines, _asked(spark, d))).select("name", *_r("lift", "coverage"))


_ABS = "abso AS (SELECT CASE WHEN n_ab::DOUBLE / n_a > n_ab::DOUBLE / n_b THEN a ELSE b END AS src, CASE WHEN n_ab::DOUBLE / n_a > n_ab::DOUBLE / n_b THEN b ELSE a END AS dst, n_ab, abs(n_ab::DOUBLE / n_a - n_ab::DOUBLE / n_b) AS asymmetry FROM wide WHERE n_ab >= 10 AND abs(n_ab::DOUBLE / n_a - n_ab::DOUBLE / n_b) >= 0.1)"


@query(f"WITH {A.PAIRS}, {_ABS} SELECT src, dst, n_ab, round(asymmetry, 6) AS asymmetry FROM abso")
def pair_asymmetry(spark, d):
    return mining.score_absolute(_margins(spark, d)[0], 10, C.asymmetry).withColumn("asymmetry", F.round("asymmetry", 6))


@query(f"""WITH {A.TRIPLES}, {_ABS}, bth AS (SELECT a AS p, b AS q, n_ab AS n, n_a AS n_p FROM wide UNION ALL SELECT b, a, n_ab, n_b FROM wide),
x AS (SELECT s1, s2, s3, n_abc, CAST(n_abc AS DOUBLE) / abso.n_ab - CAST(bth.n AS DOUBLE) / bth.n_p AS lift FROM ord JOIN abso ON src = s1 AND dst = s2 JOIN bth ON p = s2 AND q = s3 WHERE n_abc >= 10) SELECT s1, s2, s3, n_abc, round(lift, 6) AS lift FROM x WHERE lift >= 0.05""")
def markov_lift3(spark, d):
    """Older growth: lift of the third node over that given the second alone."""
    wide, nodes, _ = _margins(spark, d)
    return mining.lift_over_last(mining.score_absolute(wide, 10, C.asymmetry), mining.triple_counts(nodes), wide, 10, C.markov).withColumn("lift", F.round("lift", 6))


@query(f"""WITH {A.TRIPLES}, bth AS (SELECT a AS p, b AS q, n_ab AS n FROM pairs UNION ALL SELECT b, a, n_ab FROM pairs),
o AS (SELECT x.p AS s1, x.q AS s2, y.q AS s3, x.n AS n12, y.n AS n23, z.n AS n13 FROM bth AS x JOIN bth AS y ON y.p = x.q AND y.q <> x.p JOIN bth AS z ON z.p = x.p AND z.q = y.q),
r AS (SELECT s1, s2, s3, n13 * total / (CAST(a.n AS DOUBLE) * c.n) AS ratio, coalesce(n_abc, 0) * b.n / (CAST(n12 AS DOUBLE) * n23) AS given FROM o JOIN sup AS a ON a.node = s1 JOIN sup AS b ON b.node = s2 JOIN sup AS c ON c.node = s3 CROSS JOIN tot LEFT JOIN ord USING (s1, s2, s3))
SELECT s1, s2, s3, round(ratio, 6) AS ratio, round(given, 6) AS ratio_given, ratio BETWEEN 0.75 AND 1.33 AND (given >= 1.5 OR given <= 0.66) AS rejected FROM r""")
def collider_ratio(spark, d):
    wide, nodes, _ = _margins(spark, d)
    return mining.ratio_collider(mining.triple_counts(nodes), wide).withColumns({c: F.round(c, 6) for c in ("ratio", "ratio_given")})


@query(f"WITH {A.PAIRS} SELECT DISTINCT 'NOT_' || CASE WHEN n_ab::DOUBLE / n_a > n_ab::DOUBLE / n_b THEN b ELSE a END AS node, total - CASE WHEN n_ab::DOUBLE / n_a > n_ab::DOUBLE / n_b THEN n_b ELSE n_a END AS n FROM wide WHERE n_ab >= 5 AND greatest(n_ab::DOUBLE / n_a, n_ab::DOUBLE / n_b) >= 0.5")
def contextual_absence(spark, d):
    return mining.expected_targets(_margins(spark, d)[0])


@query(f"WITH {A.EVENTS}, c AS (SELECT case_id, node, count(*) AS n FROM ev WHERE node IS NOT NULL GROUP BY 1, 2) SELECT node, max(n) AS depth FROM c GROUP BY node")
def recurrence_depth(spark, d):
    return features.deepest(A.basket_events(spark, d), "case_id", "node")


@query("SELECT round(stddev_samp(m), 6) AS spread FROM (SELECT avg(l_quantity) AS m FROM lineitem GROUP BY l_orderkey)")
def spread_of_means(spark, d):
    return features.spread_of_means(A.table(spark, d, "lineitem"), "l_orderkey", "l_quantity").select(*_r("spread"))


@query("WITH t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'), m AS (SELECT median(o_totalprice) AS m FROM t) SELECT o_orderkey, CAST(o_totalprice > m AS INTEGER) AS o_totalprice FROM t CROSS JOIN m")
def binarised_cohort(spark, d):
    """A cohort by an equality filter, its target above or below the median."""
    rows = features.cohort(A.table(spark, d, "orders"), "o_orderpriority", "1-URGENT").select("o_orderkey", "o_totalprice")
    return features.binarised(rows, "o_totalprice").select("o_orderkey", "o_totalprice")


@query(f"WITH {A.SCORED} SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, score))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END), 6) AS log_loss FROM scored")
def log_loss(spark, d):
    return metrics.log_loss(A.scored(spark, d)).select(*_r("log_loss"))


@query(f"WITH {A.SCORED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM scored) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def classification_report(spark, d):
    return metrics.report(A.scored(spark, d), 0.5).select(*_r("precision", "recall", "f1"))


@query(f"WITH {A.GAPPED}, m AS (SELECT c_qty AS m FROM gaps WHERE c_qty IS NOT NULL AND l_orderkey % 10 < 7 GROUP BY c_qty ORDER BY count(*) DESC, CAST(c_qty AS VARCHAR) LIMIT 1) SELECT l_orderkey, l_linenumber, coalesce(c_qty, m) AS c_qty FROM gaps CROSS JOIN m")
def impute_mode(spark, d):
    return missingness.impute_mode(A.gaps(spark, d), ["c_qty"], F.col("l_orderkey") % 10 < 7).select("l_orderkey", "l_linenumber", "c_qty")


@query(f"WITH {A.PAIRS} SELECT CASE WHEN a = 'Q_HIGH' THEN 'High quantity' ELSE regexp_replace(a, '_R$', ' (Recurrence)') END || '  --->  ' || CASE WHEN b = 'Q_HIGH' THEN 'High quantity' ELSE regexp_replace(b, '_R$', ' (Recurrence)') END AS narrative, round(100.0 * n_ab / total, 6) AS percent FROM wide")
def narrative_text(spark, d):
    """All pairs in words with the share of the cases that hold them. Names are read by their rule, so the flag F_R is told as a recurrence of F."""
    x = _margins(spark, d)[0]
    return x.select(T.narrative(F.array("a", "b"), {"Q_HIGH": "High quantity"}, prefix="").alias("narrative"), F.round(100 * F.col("n_ab") / F.col("total"), 6).alias("percent"))


@query("SELECT l_orderkey AS key, list_position([l_shipdate, l_shipdate], l_shipdate)::INT AS slot, upper(l_returnflag) AS code, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem")
def slots_to_events(spark, d):
    """Repeated code and date columns, one of them blank, as dated events; codes cleaned and days parsed from text."""
    rows = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("'"), F.lower("l_returnflag"), F.lit(" '")).alias("code1"), F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".0")).alias("date1"), F.lit("nan").alias("code2"), F.lit(None).cast("string").alias("date2"))
    return tables.slots_to_events(rows, "key", "code", "date", 2).select("key", "slot", S.clean_code(F.col("code")).alias("code"), S.parse_day(F.col("date")).cast("string").alias("day"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def csv_text(spark, d):
    """A table written as CSV and read again as text, its headers cleaned."""
    mining.checkpoint_dir(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"
    tables.write_csv(A.table(spark, d, "nation").select(F.col("n_nationkey").alias("'key'"), F.col("n_name").alias(" name")), path)
    return tables.read_csv_text(spark, path)


@query(f"""WITH {A.DATED}, p AS (SELECT DISTINCT x.case_id, x.code || ',' || y.code AS pattern FROM dated AS x JOIN dated AS y ON x.case_id = y.case_id AND (x.day, x.slot) < (y.day, y.slot))
SELECT pattern, count(*) AS freq FROM p GROUP BY pattern HAVING count(*) >= ceil(0.05 * (SELECT count(DISTINCT case_id) FROM dated))""")
def prefixspan_pairs(spark, d):
    """Frequent subsequences of two codes."""
    return models.frequent_sequences(temporal.traces(A.dated(spark, d), "case_id", "code", ["day", "slot"]), 0.05, 2)


@query(f"""WITH {A.PAIRS}, r AS (SELECT CASE WHEN n_b >= n_a THEN a ELSE b END AS src, CASE WHEN n_b >= n_a THEN b ELSE a END AS dst, n_ab, CAST(greatest(n_a, n_b) AS DOUBLE) / least(n_a, n_b) AS ratio,
(CAST(n_ab AS DOUBLE) / least(n_a, n_b) - CAST(greatest(n_a, n_b) AS DOUBLE) / total) / (CAST(greatest(n_a, n_b) AS DOUBLE) / total) AS lift FROM wide WHERE n_ab >= 10)
SELECT src, dst, n_ab, round(ratio, 6) AS ratio, round(lift, 6) AS lift, round(ratio * abs(lift), 6) AS power FROM r WHERE ratio >= 1.1""")
def pair_ratio_power(spark, d):
    """Pairs directed by the ratio of their conditional probabilities."""
    return mining.score_ratio(_margins(spark, d)[0]).select("src", "dst", "n_ab", *_r("ratio", "lift", "power"))


@query(f"""WITH {A.PAIRS}, e AS (SELECT a, b, n_ab, CAST(pos AS DOUBLE) / n AS before, CAST(pos_ab AS DOUBLE) / n_ab AS after FROM pairs JOIN sup ON sup.node = a WHERE n_ab >= 5)
SELECT a || ': finished risk ' || printf('%.1f%%', 100 * before) || '. with ' || b || ', the risk is ' || printf('%.1f%%', 100 * after) || ' (' || printf('%+.1f%%', 100 * (after - before)) || ').' AS sentence, format('{{:,}}', n_ab) AS cases
FROM e ORDER BY after - before DESC, a, b LIMIT 5""")
def escalation_text(spark, d):
    """The five pairs whose second node raises the risk most, as sentences."""
    nodes = A.basket(spark, d)
    first = mining.support(nodes).select(F.col("node").alias("a"), "n", "pos")
    x = mining.pair_counts(nodes).where("n_ab >= 5").join(F.broadcast(first), "a").withColumn("before", F.col("pos") / F.col("n")).withColumn("after", F.col("pos_ab") / F.col("n_ab"))
    top = x.orderBy((F.col("after") - F.col("before")).desc(), "a", "b").limit(5)
    return top.select(T.escalation(F.col("a"), F.col("b"), "finished", F.col("before"), F.col("after")).alias("sentence"), T.thousands(F.col("n_ab")).alias("cases"))
