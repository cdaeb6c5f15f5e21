"""Registered queries of the trajectory miner, with SQL.

Case: an order; nodes: part types and high quantity with their first recurrence, and their absences. The given tables hold no planted structure: nearly nothing passes the
false-discovery step at its default, so `bh_power` returns all sequences with a flag, and `top_sequences` ranks at FDR 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, mining, sequences
from . import adapters as A
from .queries import C, query

ROUNDS = 4


def _miner(spark, d, deepest: int | None = 2, only: str | None = "node LIKE 'T%' OR node = 'Q_HIGH'") -> sequences.Miner:
    """A miner over the nodes that `only` names (None: all), with recurrences up to `deepest` occurrences, and absences."""
    events = A.basket_events(spark, d)
    present = sequences.atoms(events if only is None else events.where(only), deepest)
    cases = A.cases(spark, d)
    whole = mining.totals(cases).first()
    floor = sequences.support_floor(whole["total"], C.support, C.min_support)
    nodes = sequences.build_nodes(present, whole["total"], floor, C.negative_floor)
    return sequences.Miner(present, cases, nodes, whole["total"], whole["positives"], floor, C.chi2_critical)


def _gate(x: str, z: str) -> str:
    return f"NOT ({x}.neg AND {z}.neg) AND NOT ({x}.root = {z}.root AND {x}.neg <> {z}.neg)"


def _chi2(a: str, x: str, y: str, n: str) -> str:
    a, x, y, n = (f"CAST({v} AS DOUBLE)" for v in (a, x, y, n))
    b, c, e = f"({x} - {a})", f"({y} - {a})", f"({n} - {x} - {y} + {a})"
    return f"CASE WHEN {a} > 0 AND {b} > 0 AND {c} > 0 AND {e} > 0 THEN {n} * ({a} * {e} - {b} * {c}) * ({a} * {e} - {b} * {c}) / ({x} * ({n} - {x}) * {y} * ({n} - {y})) END"


def _level(k: int) -> str:
    """Sequences of k nodes i1..ik that grow from those of k - 1."""
    old = ", ".join(f"s.i{j}" for j in range(1, k))
    traps = " ".join(f"AND NOT EXISTS (SELECT 1 FROM trap WHERE x = s.i{j} AND trap.y = s.i{k - 1} AND trap.z = m.i)" for j in range(1, k - 1))
    other = " AND ".join(f"m.i <> s.i{j}" for j in range(1, k))
    return f"""s{k} AS (SELECT {old}, m.i AS i{k}, c.n, c.pos, s.n AS n_seq, m.n AS n_last FROM s{k - 1} AS s JOIN node AS m ON {other} JOIN node AS l ON l.i = s.i{k - 1} JOIN c{k} AS c ON c.k = list_sort([{old}, m.i])
WHERE {_gate('l', 'm')} {traps})"""


_MINE = f"""{A.CASES}, {A.EVENTS},
cnt AS (SELECT case_id, node AS base, least(count(*), 2) AS k FROM ev WHERE node LIKE 'T%' OR node = 'Q_HIGH' GROUP BY 1, 2),
atom AS (SELECT case_id, base AS atom, base, 1 AS occ FROM cnt UNION ALL SELECT case_id, base || '_R', base, 2 FROM cnt WHERE k = 2),
tot AS (SELECT count(*) AS total, CAST(sum(y) AS BIGINT) AS positives, greatest(3, floor(count(*) * 0.005)) AS fl FROM cases),
sup AS (SELECT atom, base, occ, count(*) AS n FROM atom GROUP BY 1, 2, 3),
every AS (SELECT atom AS name, base AS root, false AS neg, n FROM sup UNION ALL SELECT 'NOT_' || atom, base, true, total - n FROM sup CROSS JOIN tot WHERE occ = 1 AND n / CAST(total AS DOUBLE) >= 0.05
UNION ALL SELECT 'NOT_' || s.atom, s.base, true, b.n - s.n FROM sup AS s JOIN sup AS b ON b.atom = s.base WHERE s.occ = 2),
node AS (SELECT name, root, neg, n, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS i FROM every CROSS JOIN tot WHERE n >= fl),
held AS (SELECT case_id, i FROM atom JOIN node ON name = atom UNION ALL SELECT cases.case_id, i FROM cases JOIN node ON neg AND name = 'NOT_' || root WHERE NOT EXISTS (SELECT 1 FROM cnt WHERE cnt.case_id = cases.case_id AND base = root)
UNION ALL SELECT case_id, i FROM cnt JOIN node ON name = 'NOT_' || base || '_R' WHERE k = 1),
shape AS (SELECT case_id, any_value(y) AS y, list(i ORDER BY i) AS l FROM held JOIN cases USING (case_id) GROUP BY case_id),
pat AS (SELECT l, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM shape GROUP BY l), pi AS (SELECT l, n, pos, unnest(l) AS i FROM pat),
c2 AS (SELECT [a.i, b.i] AS k, CAST(sum(a.n) AS BIGINT) AS n, CAST(sum(a.pos) AS BIGINT) AS pos FROM pi AS a JOIN pi AS b ON a.l = b.l AND a.i < b.i GROUP BY 1 HAVING sum(a.n) >= (SELECT fl FROM tot)),
c3 AS (SELECT [a.i, b.i, c.i] AS k, CAST(sum(a.n) AS BIGINT) AS n, CAST(sum(a.pos) AS BIGINT) AS pos FROM pi AS a JOIN pi AS b ON a.l = b.l AND a.i < b.i JOIN pi AS c ON b.l = c.l AND b.i < c.i GROUP BY 1 HAVING sum(a.n) >= (SELECT fl FROM tot)),
c4 AS (SELECT [a.i, b.i, c.i, d.i] AS k, CAST(sum(a.n) AS BIGINT) AS n, CAST(sum(a.pos) AS BIGINT) AS pos FROM pi AS a JOIN pi AS b ON a.l = b.l AND a.i < b.i JOIN pi AS c ON b.l = c.l AND b.i < c.i JOIN pi AS d ON c.l = d.l AND c.i < d.i
GROUP BY 1 HAVING sum(a.n) >= (SELECT fl FROM tot)),
o3 AS (SELECT k[p[1]] AS x, k[p[2]] AS y, k[p[3]] AS z, n FROM c3 CROSS JOIN (SELECT unnest([[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]) AS p)),
trap AS (SELECT o3.x, o3.y, o3.z FROM o3 JOIN c2 AS xz ON xz.k = list_sort([o3.x, o3.z]) JOIN c2 AS xy ON xy.k = list_sort([o3.x, o3.y]) JOIN c2 AS zy ON zy.k = list_sort([o3.z, o3.y]) JOIN node AS a ON a.i = o3.x JOIN node AS b ON b.i = o3.y JOIN node AS c ON c.i = o3.z CROSS JOIN tot
WHERE {_chi2('xz.n', 'a.n', 'c.n', 'total')} <= 3.841458820694124 AND {_chi2('o3.n', 'xy.n', 'zy.n', 'b.n')} > 3.841458820694124),
s2 AS (SELECT a.i AS i1, b.i AS i2, c.n, c.pos, a.n AS n_seq, b.n AS n_last FROM c2 AS c JOIN node AS a ON a.i IN (c.k[1], c.k[2]) JOIN node AS b ON b.i IN (c.k[1], c.k[2]) AND b.i <> a.i WHERE {_gate('a', 'b')}),
{_level(3)}, {_level(4)},
grown AS (SELECT [i1, i2] AS items, n, pos, n_seq, n_last FROM s2 UNION ALL SELECT [i1, i2, i3], n, pos, n_seq, n_last FROM s3 UNION ALL SELECT [i1, i2, i3, i4], n, pos, n_seq, n_last FROM s4),
raw AS (SELECT *, CAST(n AS DOUBLE) / n_seq - CAST(n AS DOUBLE) / n_last AS diff, (CAST(n AS DOUBLE) / n_seq - CAST(n_last AS DOUBLE) / total) / (CAST(n_last AS DOUBLE) / total) AS markov, greatest(CAST(positives AS DOUBLE) / total, 0.0001) AS base FROM grown CROSS JOIN tot),
lifted AS (SELECT *, CASE WHEN n = 0 THEN 1.0 WHEN pos = 0 THEN 1 / base ELSE least(1 / base, greatest((CAST(pos AS DOUBLE) / n) / base, base / (CAST(pos AS DOUBLE) / n))) END AS lift FROM raw WHERE diff >= 0.1 AND abs(markov) >= 0.05),
found AS (SELECT (SELECT string_agg(m.name, ' > ' ORDER BY list_position(f.items, m.i)) FROM node AS m WHERE list_contains(f.items, m.i)) AS seq, items, CAST(len(items) AS INTEGER) AS length, n, pos, diff, markov, base, lift, abs(diff) * abs(markov) * lift * lift AS power FROM lifted AS f)"""


def _shown(found):
    return found.withColumn("seq", F.array_join("seq", " > "))


@query(f"WITH {_MINE} SELECT seq, length, n, pos, round(diff, 6) AS diff, round(markov, 6) AS markov, round(lift, 6) AS lift, round(power, 6) AS power FROM found")
def mine_sequences(spark, d):
    """Sequences of up to four nodes that pass the support floor, the logic gate, the collider gate and both thresholds."""
    found = _miner(spark, d).mine(4, C.asymmetry, C.markov)
    return _shown(found).select("seq", "length", "n", "pos", *(F.round(c, 6).alias(c) for c in ("diff", "markov", "lift", "power")))


_TESTED = f"""{_MINE}, few AS (SELECT * FROM found WHERE length <= 3),
perm AS (SELECT l, r, (row_number() OVER (PARTITION BY r ORDER BY md5(case_id || '-' || r), case_id) <= (SELECT positives FROM tot))::INT AS y FROM shape CROSS JOIN (SELECT unnest(range(1, {ROUNDS + 1})) AS r)),
pr AS (SELECT l, r, CAST(sum(y) AS BIGINT) AS pos FROM perm GROUP BY 1, 2),
drawn AS (SELECT DISTINCT list_sort(items) AS k FROM few), hit AS (SELECT k, l FROM drawn JOIN pat ON list_has_all(l, k)), nul AS (SELECT k, r, CAST(sum(pos) AS BIGINT) AS pos FROM hit JOIN pr USING (l) GROUP BY 1, 2),
np AS (SELECT abs(diff) * abs(markov) * q * q AS power FROM (SELECT diff, markov, CASE WHEN nul.pos = 0 THEN 1 / base ELSE least(1 / base, greatest((CAST(nul.pos AS DOUBLE) / n) / base, base / (CAST(nul.pos AS DOUBLE) / n))) END AS q FROM few JOIN nul ON nul.k = list_sort(items))),
both_ AS (SELECT round(power, 9) AS v, 1 AS w FROM np UNION ALL SELECT round(power, 9), 0 FROM few), reach AS (SELECT DISTINCT v, sum(w) OVER (ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM both_),
tested AS (SELECT few.*, (c + 1) / CAST((SELECT count(*) FROM np) + 1 AS DOUBLE) AS p_value FROM few JOIN reach ON v = round(power, 9))"""
_RANKED = f"""{_TESTED}, ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, -power, replace(seq, ' > ', ',')) AS rank, count(*) OVER () AS m FROM tested)"""


def _tested(spark, d):
    miner = _miner(spark, d)
    found = mining.cut(miner.mine(3, C.asymmetry, C.markov))
    return miner, sequences.empirical_p(found, sequences.permuted_null(miner, found, ROUNDS))


@query(f"WITH {_TESTED} SELECT seq, round(power, 6) AS power, round(p_value, 9) AS p_value FROM tested")
def empirical_p(spark, d):
    """Share of pooled null powers, under real shuffles of the labels, at or above each sequence's power."""
    return _shown(_tested(spark, d)[1]).select("seq", F.round("power", 6).alias("power"), F.round("p_value", 9).alias("p_value"))


@query(f"WITH {_RANKED}, k AS (SELECT max(rank) AS k FROM ranked WHERE p_value <= rank / CAST(m AS DOUBLE) * 0.05) SELECT seq, round(p_value, 9) AS p_value, CAST(rank AS INTEGER) AS rank, rank <= coalesce(k, 0) AS kept FROM ranked CROSS JOIN k")
def bh_power(spark, d):
    """The step-up procedure over the empirical p-values."""
    return _shown(sequences.significant(_tested(spark, d)[1], C.fdr)).select("seq", F.round("p_value", 9).alias("p_value"), "rank", "kept")


_TOP = f"""{_RANKED}, k AS (SELECT max(rank) AS k FROM ranked WHERE p_value <= rank / CAST(m AS DOUBLE) * 1.0), best AS (SELECT * FROM ranked CROSS JOIN k WHERE rank <= coalesce(k, 0) ORDER BY power DESC, replace(seq, ' > ', ',') LIMIT {{}})"""


@query(f"WITH {_TOP.format(500)} SELECT seq, n, round(power, 6) AS power FROM best")
def top_sequences(spark, d):
    kept = sequences.significant(_tested(spark, d)[1], 1.0).where("kept")
    return _shown(sequences.top(kept, C.prune)).select("seq", "n", F.round("power", 6).alias("power"))


_SPLIT = "split AS (SELECT case_id, CASE WHEN s <= 0.6 THEN 'train' WHEN s <= 0.8 THEN 'val' ELSE 'test' END AS split FROM (SELECT case_id, row_number() OVER (PARTITION BY y ORDER BY md5(case_id || 's1'), case_id) / CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) AS s FROM cases))"


@query(f"WITH {_TOP.format(20)}, {_SPLIT} SELECT seq, s.split, count(c.case_id) AS patients FROM best CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS split) AS s LEFT JOIN (SELECT case_id, split, l FROM shape JOIN split USING (case_id)) AS c ON c.split = s.split AND list_has_all(c.l, best.items) GROUP BY 1, 2")
def support_by_split(spark, d):
    """Cases of each split that hold the best sequences."""
    miner, tested = _tested(spark, d)
    best = mining.cut(sequences.top(sequences.significant(tested, 1.0).where("kept"), 20))
    return _shown(sequences.support_report(miner, best, features.stratified_split(A.cases(spark, d), "case_id", "y", "s1")))


@query(f"""WITH {A.CASES}, {A.EVENTS}, cnt AS (SELECT case_id, node, count(*) AS k FROM ev WHERE node LIKE 'T%' GROUP BY 1, 2), q AS (SELECT DISTINCT case_id FROM ev WHERE node = 'Q_HIGH'),
v AS (SELECT node, occ - 1 AS r FROM (SELECT node, unnest(range(3, k + 1)) AS occ FROM cnt) GROUP BY node, occ HAVING count(*) >= (SELECT greatest(3, floor(count(*) * 0.005)) FROM cases)), f AS (SELECT node FROM v GROUP BY node HAVING count(*) > 1),
m AS (SELECT cnt.case_id, cnt.node, max(r) AS dose FROM cnt JOIN q USING (case_id) JOIN f USING (node) JOIN v ON v.node = cnt.node AND r < k GROUP BY 1, 2) SELECT 'SEQ_' || node || '_TO_Q_HIGH' AS path, CAST(1 AS INTEGER) AS node, CAST(dose AS INTEGER) AS dose, count(*) AS cases FROM m GROUP BY 1, 2, 3""")
def dose_compression(spark, d):
    """Families of sequences that differ in the number of a recurrence become one dose a node."""
    miner = _miner(spark, d, deepest=None)
    names = [x.name for x in miner.nodes if not x.negated and x.name.startswith("T")]
    families = sequences.dose_families([f"SEQ_{x}_TO_Q_HIGH" for x in names])
    rows = spark.createDataFrame([(f"SEQ_{x}_TO_Q_HIGH", [x, "Q_HIGH"]) for x in names], "name string, seq array<string>")
    held = miner.matches(miner.numbered(rows)).select("case_id", "name")
    return sequences.doses(held, families).groupBy("path", "node", "dose").agg(F.count("*").alias("cases"))


@query()
def permutation_null(spark, d):
    """empirical_p with the default number of draws for each sequence, whatever the number of cases."""
    miner = _miner(spark, d)
    found = mining.cut(miner.mine(3, C.asymmetry, C.markov))
    return _shown(sequences.empirical_p(found, sequences.hypergeometric_null(found, miner.total, miner.positives, C.permutations))).select("seq", "power", "p_value")

