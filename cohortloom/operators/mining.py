"""Trajectory mining on long (case, node) tables: support, bundles, directed pairs and triples, gates, ranking and inference.

Sets are counted, sequences are scored: every measure is a function of n(S) and n(S and y), so each unordered set is counted once and the orders are
a projection. Counts come from the combinations within a case, whose number is their cost; the tables of nodes and of
candidate sets are small and don't grow with the cases.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import chi2, outcome_lift


def checkpoint_dir(spark: SparkSession) -> None:
    """Names a checkpoint folder where the session names none, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp")))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def support(nodes: DataFrame) -> DataFrame:
    """(node, n, pos) of nodes (case_id, node, y), distinct by case and node."""
    return nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))


def totals(cases: DataFrame) -> DataFrame:
    """(total, positives) of cases (case_id, y)."""
    return cases.agg(F.count("*").alias("total"), F.sum("y").cast("long").alias("positives"))


def _combined(nodes: DataFrame, size: int) -> DataFrame:
    """(y, a, b, ...) of the ordered combinations of the nodes of each case: one row for each, made one after the other from the case's sorted nodes, so that no case meets itself in a join
    and a long one is only streamed through."""
    x, names = nodes.groupBy("case_id").agg(F.max("y").alias("y"), F.array_sort(F.collect_set("node")).alias("l")), []
    for name in "abc"[:size]:
        x = x.select("y", *names, "l", F.posexplode("l").alias("i", name))
        names.append(name)
        x = x.select("y", *names, F.slice("l", F.col("i") + 2, F.size("l")).alias("l"))
    return x.drop("l")


def pair_counts(nodes: DataFrame) -> DataFrame:
    """(a, b, n_ab, pos_ab) of the unordered pairs a < b."""
    return _combined(nodes, 2).groupBy("a", "b").agg(F.count("*").alias("n_ab"), F.sum("y").cast("long").alias("pos_ab"))


def triple_counts(nodes: DataFrame) -> DataFrame:
    """(a, b, c, n_abc, pos_abc) of the unordered triples a < b < c."""
    return _combined(nodes, 3).groupBy("a", "b", "c").agg(F.count("*").alias("n_abc"), F.sum("y").cast("long").alias("pos_abc"))


def with_margins(pairs: DataFrame, nodes: DataFrame, cases: DataFrame) -> DataFrame:
    """Pair counts with the support of both nodes and the totals."""
    s = support(nodes)
    return pairs.join(s.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(s.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(totals(cases)))


def jaccard(pairs: DataFrame, least: int = Config.min_cooccurrence, threshold: float = Config.jaccard) -> DataFrame:
    """Pairs (with margins) of at least that many joint cases and Jaccard similarity."""
    j = F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))
    return pairs.where(F.col("n_ab") >= least).withColumn("jaccard", j).where(F.col("jaccard") >= threshold)


def bundle(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of pairs in order of preference, those that use no node twice. A list over nodes, not cases."""
    used, out = set(), []
    for a, b in pairs:
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def bundles(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b, jaccard) that `bundle` chooses in order of falling jaccard, then a, b: in rounds, every pair that is the best of both its
    nodes is taken, and pairs with a taken node are dropped, until none is left. The best pair of all is taken in each round, so rounds end."""
    left, taken = cut(pairs.select("a", "b", "jaccard")), None
    while not left.isEmpty():
        ends = left.select(F.struct((-F.col("jaccard")).alias("j"), "a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("node"))
        best = ends.groupBy("node").agg(F.min("pair").alias("best"))
        chosen = cut(best.groupBy("best.a", "best.b").agg(F.count("*").alias("_n")).where("_n = 2").select("a", "b"))
        used = chosen.select(F.explode(F.array("a", "b")).alias("node"))
        for end in "ab":
            left = left.join(used.withColumnRenamed("node", end), end, "left_anti")
        left, taken = cut(left.select("a", "b", "jaccard")), chosen if taken is None else cut(taken.unionByName(chosen))
    return pairs.select("a", "b").limit(0) if taken is None else taken


def score_pairs(pairs: DataFrame, asymmetry: float, markov: float, normalized: bool = False) -> DataFrame:
    """Directed pairs (src, dst, diff, markov, lift, power) that pass both gates.

    diff is P(b|a) - P(a|b), or that over their sum; the pair points the way of the larger probability.
    """
    ba, ab = F.col("n_ab") / F.col("n_a"), F.col("n_ab") / F.col("n_b")
    diff = (ba - ab) / (ba + ab) if normalized else ba - ab
    x = pairs.withColumn("d", diff).where(F.abs("d") >= asymmetry)
    total = F.col("total")
    forward = F.col("d") > 0
    p_b, p_a = F.col("n_b") / total, F.col("n_a") / total
    m = F.when(forward, (ba - p_b) / p_b).otherwise((ab - p_a) / p_a)
    lift = outcome_lift(F.col("pos_ab"), F.col("n_ab"), F.col("positives") / total)
    x = x.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), "n_ab", F.abs("d").alias("diff"), m.alias("markov"), lift.alias("lift")).where(F.abs("markov") >= markov)
    return x.withColumn("power", F.col("diff") * F.abs("markov") * F.col("lift") * F.col("lift"))


def permuted(sets: DataFrame, names: list[str]) -> DataFrame:
    """Every order of the columns `names` of unordered sets, as columns s1, s2, ..."""
    from itertools import permutations

    orders = F.array(*(F.struct(*(F.col(c).alias(f"s{i}") for i, c in enumerate(p, 1))) for p in permutations(names)))
    return sets.withColumn("o", F.explode(orders)).select("*", "o.*").drop("o", *names)


def root(node: Column) -> Column:
    """The node without its negation and occurrence."""
    return F.regexp_replace(F.regexp_replace(node, "^NOT_", ""), r"_R\d*$", "")


def logical(src: Column, dst: Column) -> Column:
    """Whether dst may follow src: not the same, not both negated, not one the opposite of the other."""
    a, b = src.startswith("NOT_"), dst.startswith("NOT_")
    return (src != dst) & ~(a & b) & ~((root(src) == root(dst)) & (a != b))


def extend(triples: DataFrame, pairs: DataFrame, nodes: DataFrame, cases: DataFrame, floor: int, asymmetry: float, markov: float) -> DataFrame:
    """Sequences s1, s2 -> s3 above the support floor whose third node is directed and lifted: P(s3|s1 s2) - P(s1 s2|s3) and the Markov lift."""
    x = permuted(triples.where(F.col("n_abc") >= floor), ["a", "b", "c"])
    n_pair = pairs.select("a", "b", "n_ab")
    x = x.withColumn("a", F.least("s1", "s2")).withColumn("b", F.greatest("s1", "s2")).join(n_pair, ["a", "b"])
    x = x.join(F.broadcast(support(nodes).select(F.col("node").alias("s3"), F.col("n").alias("n_3"))), "s3").crossJoin(F.broadcast(totals(cases)))
    p, p3 = F.col("n_abc") / F.col("n_ab"), F.col("n_3") / F.col("total")
    lift = outcome_lift(F.col("pos_abc"), F.col("n_abc"), F.col("positives") / F.col("total"))
    x = x.select("s1", "s2", "s3", "n_abc", (p - F.col("n_abc") / F.col("n_3")).alias("diff"), ((p - p3) / p3).alias("markov"), lift.alias("lift"))
    x = x.where(logical(F.col("s2"), F.col("s3")) & logical(F.col("s1"), F.col("s2")) & (F.col("diff") >= asymmetry) & (F.abs("markov") >= markov))
    return x.withColumn("power", F.col("diff") * F.abs("markov") * F.col("lift") * F.col("lift"))


def collider(triples: DataFrame, pairs: DataFrame, nodes: DataFrame, cases: DataFrame, critical: float) -> DataFrame:
    """Ordered triples x, y, z with the chi-squares of x and z, over all cases and given y; rejected if independent over all but dependent given y.

    A table with an empty cell doesn't reject.
    """
    z = permuted(triples, ["a", "b", "c"])
    s = support(nodes)
    n = lambda name: s.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    both = lambda p, q, name: pairs.select(F.col("a").alias(p), F.col("b").alias(q), F.col("n_ab").alias(name)).unionByName(pairs.select(F.col("b").alias(p), F.col("a").alias(q), F.col("n_ab").alias(name)))
    z = z.join(n("s1"), "s1").join(n("s2"), "s2").join(n("s3"), "s3").join(both("s1", "s3", "n_13"), ["s1", "s3"]).join(both("s1", "s2", "n_12"), ["s1", "s2"]).join(both("s2", "s3", "n_23"), ["s2", "s3"]).crossJoin(F.broadcast(totals(cases).select("total")))
    whole = chi2(F.col("n_13"), F.col("n_s1"), F.col("n_s3"), F.col("total"))
    given = chi2(F.col("n_abc"), F.col("n_12"), F.col("n_23"), F.col("n_s2"))
    z = z.select("s1", "s2", "s3", "n_abc", whole.alias("chi2"), given.alias("chi2_given"))
    return z.withColumn("rejected", F.coalesce((F.col("chi2") <= critical) & (F.col("chi2_given") > critical), F.lit(False)))


def best_of_sets(scored: DataFrame, steps: list[str], score: str) -> DataFrame:
    """Of the orders of one set, the one with the largest score, the first by name on ties."""
    key = F.array_sort(F.array(*steps))
    order = Window.partitionBy(key).orderBy(F.desc(score), *steps)
    return scored.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its row number (1 first) in an order: rows are put in ranges, numbered inside each, and shifted by the sizes of the ranges before."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_i", 33))
    sizes = ranged.groupBy("_range").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = sizes.select("_range", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return ranged.join(F.broadcast(before), "_range").withColumn(name, (F.col("_i") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_i", "_range", "_first", "_before")


def step_up(tests: DataFrame, p: str, order: list[str], alpha: float) -> DataFrame:
    """Benjamini-Hochberg: rank by p and keep flag for all up to the largest rank i with p <= i / m * alpha."""
    ranked = cut(numbered(tests, [F.col(c) for c in (p, *order)], "rank"))
    size = ranked.agg(F.count("*").alias("_m"))
    passing = ranked.crossJoin(F.broadcast(size)).agg(F.max(F.when(F.col(p) <= F.col("rank") / F.col("_m") * alpha, F.col("rank"))).alias("_last"))
    return ranked.crossJoin(F.broadcast(passing)).withColumn("kept", F.col("rank") <= F.coalesce("_last", F.lit(0))).drop("_last")


def path_edges(paths: DataFrame, steps: list[str]) -> DataFrame:
    """The tree of paths (steps, value): an edge for each prefix, with its depth, paths and the sum of their values."""
    prefix = lambda i: F.array_join(F.array(*steps[:i]), " > ")
    each = F.array(*(F.struct(F.lit(i).alias("depth"), (prefix(i - 1) if i > 1 else F.lit("")).alias("parent"), F.col(c).alias("child"), prefix(i).alias("path")) for i, c in enumerate(steps, 1)))
    return paths.select(F.explode(each).alias("e"), "value").groupBy("e.depth", "e.parent", "e.child", "e.path").agg(F.count("*").alias("paths"), F.sum("value").cast("long").alias("value"))


def score_absolute(pairs: DataFrame, least: int, asymmetry: float) -> DataFrame:
    """Older form: (src, dst, n_ab, asymmetry) of pairs with margins whose probabilities differ by that much, towards the larger; b to a on ties."""
    ba, ab = F.col("n_ab") / F.col("n_a"), F.col("n_ab") / F.col("n_b")
    x = pairs.where(F.col("n_ab") >= least).withColumn("asymmetry", F.abs(ba - ab)).where(F.col("asymmetry") >= asymmetry)
    return x.select(F.when(ba > ab, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(ba > ab, F.col("b")).otherwise(F.col("a")).alias("dst"), "n_ab", "asymmetry")


def lift_over_last(directed: DataFrame, triples: DataFrame, pairs: DataFrame, least: int, lift: float) -> DataFrame:
    """Older growth: directed pairs (src, dst, n_ab) and a third node: P(third | both) - P(third | dst), from that lift on. pairs have margins."""
    x = permuted(triples.where(F.col("n_abc") >= least), ["a", "b", "c"])
    x = x.join(directed.select(F.col("src").alias("s1"), F.col("dst").alias("s2"), "n_ab"), ["s1", "s2"])
    both = pairs.select(F.col("a").alias("s2"), F.col("b").alias("s3"), F.col("n_ab").alias("n_23"), F.col("n_a").alias("n_2")).unionByName(pairs.select(F.col("b").alias("s2"), F.col("a").alias("s3"), F.col("n_ab").alias("n_23"), F.col("n_b").alias("n_2")))
    return x.join(both, ["s2", "s3"]).withColumn("lift", F.col("n_abc") / F.col("n_ab") - F.col("n_23") / F.col("n_2")).where(F.col("lift") >= lift).select("s1", "s2", "s3", "n_abc", "lift")


def ratio_collider(triples: DataFrame, pairs: DataFrame, low: float = 0.75, high: float = 1.33, least: float = 0.66, most: float = 1.5) -> DataFrame:
    """Older gate: (s1, s2, s3, ratio, ratio_given) of ordered triples whose pairs all occur, rejected where s1 and s3 look independent (ratio from low to high) but not
    given s2 (up to least, or from most on). A triple that never occurs has the ratio 0. pairs have margins."""
    ends = pairs.select("a", "b", "n_ab")
    closed = ends.toDF("a", "b", "n_xy").join(ends.toDF("a", "c", "n_xz"), "a").where("b < c").join(ends.toDF("b", "c", "n_yz"), ["b", "c"])
    every = closed.join(triples.select("a", "b", "c", "n_abc"), ["a", "b", "c"], "left").na.fill(0, ["n_abc"])
    x = permuted(every, ["a", "b", "c"]).select("s1", "s2", "s3", "n_abc")
    side = lambda p, q, n: pairs.select(F.col("a").alias(p), F.col("b").alias(q), F.col("n_ab").alias(n), F.col("n_a").alias(f"{n}_{p}"), "total").unionByName(pairs.select(F.col("b").alias(p), F.col("a").alias(q), F.col("n_ab").alias(n), F.col("n_b").alias(f"{n}_{p}"), "total"))
    x = x.join(side("s1", "s3", "n13"), ["s1", "s3"]).drop("total").join(side("s1", "s2", "n12").drop("n12_s1", "total"), ["s1", "s2"]).join(side("s2", "s3", "n23"), ["s2", "s3"]).join(side("s3", "s2", "n32").drop("n32", "total"), ["s3", "s2"])
    ratio = F.col("n13") * F.col("total") / (F.col("n13_s1").cast("double") * F.col("n32_s3"))
    given = F.col("n_abc") * F.col("n23_s2") / (F.col("n12").cast("double") * F.col("n23"))
    x = x.select("s1", "s2", "s3", ratio.alias("ratio"), given.alias("ratio_given"))
    return x.withColumn("rejected", F.col("ratio").between(low, high) & ((F.col("ratio_given") >= most) | (F.col("ratio_given") <= least)))


def expected_targets(pairs: DataFrame, least: int = 5, expected: float = 0.5) -> DataFrame:
    """Older absence: (node, n), NOT_ of nodes that are expected, as their probability given another node is that much. pairs have margins."""
    ba, ab = F.col("n_ab") / F.col("n_a"), F.col("n_ab") / F.col("n_b")
    x = pairs.where((F.col("n_ab") >= least) & (F.greatest(ba, ab) >= expected))
    target = F.when(ba > ab, F.struct(F.col("b").alias("t"), F.col("n_b").alias("n"))).otherwise(F.struct(F.col("a").alias("t"), F.col("n_a").alias("n")))
    return x.select(target.alias("t"), "total").select(F.concat(F.lit("NOT_"), "t.t").alias("node"), (F.col("total") - F.col("t.n")).alias("n")).distinct()


def path_valid(nodes: Column, members: dict[str, tuple[str, str]], admission: str = "CCS_ADM_DX_") -> Column:
    """Older gate on a whole path: no node twice, one admission at most, no bundle beside its member, nothing both there and absent."""
    ok = (F.size(F.array_distinct(nodes)) == F.size(nodes)) & (F.size(F.filter(nodes, lambda n: n.startswith(admission))) <= 1)
    for bundle_, pair in members.items():
        ok = ok & ~(F.array_contains(nodes, bundle_) & F.arrays_overlap(nodes, F.array(*(F.lit(x) for x in pair))))
    table = F.create_map(*(x for b, p in (members or {"": ("", "")}).items() for x in (F.lit(b), F.array(F.lit(p[0]), F.lit(p[1])))))
    there = F.flatten(F.transform(F.filter(nodes, lambda n: ~n.startswith("NOT_")), lambda n: F.coalesce(F.try_element_at(table, n), F.array(n))))
    absent = F.transform(F.filter(nodes, lambda n: n.startswith("NOT_")), lambda n: F.regexp_replace(n, "^NOT_", ""))
    return ok & ~F.arrays_overlap(there, absent)


def chronological(nodes: Column, outcome: str, admission: str = "CCS_ADM_DX_") -> Column:
    """Older rules: an admission only first, the outcome only last."""
    return F.forall(nodes, lambda n: ~n.startswith(admission) | (n == nodes[0])) & (F.size(F.filter(nodes, lambda n: n.startswith(admission))) <= 1) & ((F.array_position(nodes, outcome) == 0) | ((F.array_position(nodes, outcome) == F.size(nodes)) & (F.size(nodes) > 1)))


def uncapped_lift(pos: Column, n: Column, base: Column) -> Column:
    """Older lift without the cap at 1/base; base / .0001 for no positives, 1 for no cases."""
    floor = F.greatest(base, F.lit(1e-4))
    p = pos / n
    return F.when(n == 0, F.lit(1.0)).when(pos == 0, floor / F.lit(1e-4)).otherwise(F.greatest(p / floor, floor / p))


def bundles_in_order(pairs: DataFrame) -> DataFrame:
    """Older bundling: pairs (a, b) chosen in column order instead of by similarity."""
    return bundles(pairs.withColumn("jaccard", F.lit(0.0)))


def overlapping_bundles(pairs: DataFrame) -> DataFrame:
    """Oldest bundling: every similar pair is a bundle, so bundles share members, and members stay."""
    return pairs.select("a", "b", "n_ab")


def score_ratio(pairs: DataFrame, least: int = 10, threshold: float = 1.1) -> DataFrame:
    """Older form: (src, dst, n_ab, ratio, lift, power) of pairs (with margins) whose conditional probabilities differ by that factor, towards the larger; power is the ratio times the
    absolute Markov lift. The ratio is that of the margins, so the pair points to the more frequent node."""
    forward = F.col("n_b") >= F.col("n_a")
    ratio = F.greatest(F.col("n_b") / F.col("n_a"), F.col("n_a") / F.col("n_b"))
    given, own = F.col("n_ab") / F.least("n_a", "n_b"), F.greatest("n_a", "n_b") / F.col("total")
    x = pairs.where((F.col("n_ab") >= least) & (ratio >= threshold))
    x = x.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), "n_ab", ratio.alias("ratio"), ((given - own) / own).alias("lift"))
    return x.withColumn("power", F.col("ratio") * F.abs("lift"))
