"""Timelines: relative days, occurrences, order checks, trace variants and subsequences of dated events (case, code, day, slot)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import order_expectation


def timeline_events(events: DataFrame, case: str, code: str, day: str, slot: str) -> DataFrame:
    """Adds relative_day (1 on the case's first day) and occurrence (of the code in the case, by day and slot)."""
    by_case, by_code = Window.partitionBy(case), Window.partitionBy(case, code).orderBy(day, slot)
    return events.withColumn("relative_day", F.datediff(day, F.min(day).over(by_case)) + 1).withColumn("occurrence", F.row_number().over(by_code))


def timeline_name(code: Column, occurrence: Column) -> Column:
    """The code, and _R2, _R3 ... from its second occurrence on."""
    return F.concat(code, F.when(occurrence > 1, F.concat(F.lit("_R"), occurrence.cast("string"))).otherwise(""))


def timelines(placed: DataFrame, case: str, code: str) -> DataFrame:
    """A map of names to relative days for each case."""
    named = placed.select(case, timeline_name(F.col(code), F.col("occurrence")).alias("name"), "relative_day")
    listed = named.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("name", "relative_day"))).alias("e"))
    # A code can be called like another one's occurrence: the later day stays.
    last = F.filter("e", lambda x, i: F.coalesce(F.get("e", i + 1)["name"] != x["name"], F.lit(True)))
    return listed.select(case, F.map_from_entries(last).alias("timeline"))


def parsed(names: DataFrame, members: dict[str, list[str]] | None = None) -> DataFrame:
    """names (name, ...) with needs, the codes of each node that must be there, in order, and absent, the codes that must not.

    A name is SEQ_a_TO_b..., doses count as their sequence, NOT_ nodes are absent, and bundles stand for their members (bundle: [code, ...])."""
    nodes = F.split(F.regexp_replace(F.regexp_replace("name", r"_\[NODE_\d+_DOSE\]", ""), "SEQ_", ""), "_TO_")
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(v) for v in x)) for kv in (members or {"": [""]}).items() for x in kv))
    codes = lambda n: F.coalesce(F.try_element_at(table, n), F.array(n))
    needs = F.transform(F.filter("_n", lambda n: ~n.startswith("NOT_")), codes)
    absent = F.flatten(F.transform(F.filter("_n", lambda n: n.startswith("NOT_")), lambda n: codes(F.regexp_replace(n, "^NOT_", ""))))
    return names.withColumn("_n", nodes).withColumn("needs", needs).withColumn("absent", absent).drop("_n")


def validated(lines: DataFrame, sequences: DataFrame, first_member_only: bool = False) -> DataFrame:
    """Sequences (name, needs, absent, total) with nodes, matches, coverage, null_accuracy, accuracy and lift.

    A timeline matches if it has all codes needed and none that is absent; `total` is the number of cases that hold the sequence. A bundle lies on the last
    day of its members, or with first_member_only on that of the first, without asking for the others. The accuracy is the mean expected order score; sequences of fewer than two needed nodes aren't checked.
    Timelines meet sequences by the code that these need first, so a case is compared with those only.
    """
    needs = F.transform("needs", lambda n: F.slice(n, 1, 1)) if first_member_only else F.col("needs")
    asked = sequences.withColumn("needs", needs).where("size(needs) >= 2").select("name", "needs", "absent", F.col("needs")[0][0].alias("_key"))
    met = lines.select("timeline", F.explode(F.map_keys("timeline")).alias("_key")).join(asked, "_key")
    day = lambda n: F.when(F.forall(n, lambda c: F.map_contains_key(F.col("timeline"), c)), F.array_max(F.transform(n, lambda c: F.try_element_at(F.col("timeline"), c))))
    days = met.withColumn("days", F.transform("needs", day)).where(F.forall("days", lambda d: d.isNotNull()) & ~F.exists("absent", lambda c: F.map_contains_key(F.col("timeline"), c)))
    scored = days.groupBy("name").agg(F.count("*").alias("matches"), F.avg(order_expectation(F.col("days"))).alias("accuracy"))
    out = sequences.select("name", "total", F.size("needs").alias("nodes")).join(scored, "name", "left").na.fill(0, ["matches"])
    out = out.withColumn("coverage", F.when(F.col("total") > 0, F.col("matches") / F.col("total")).otherwise(0.0))
    out = out.withColumn("null_accuracy", F.when(F.col("matches") > 0, 1 / F.factorial("nodes")))
    return out.withColumn("lift", F.col("accuracy") - F.col("null_accuracy"))


def best_ordered(checked: DataFrame, most: int = 5) -> DataFrame:
    """The best by lift, then coverage, both on three decimals as they are shown, then by name."""
    shown = checked.where("matches > 0 and lift is not null").withColumn("_l", F.round("lift", 3)).withColumn("_c", F.round("coverage", 3))
    return shown.orderBy(F.desc("_l"), F.desc("_c"), "name").limit(most).drop("_l", "_c")


def traces(events: DataFrame, case: str, code: str, order: list[str]) -> DataFrame:
    """The codes of each case in order."""
    return events.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(code).alias("code")))), lambda e: e["code"]).alias("trace"))


def variants(trace: DataFrame) -> DataFrame:
    return trace.groupBy(F.array_join("trace", ",").alias("variant")).agg(F.count("*").alias("cases"))


def contains(trace: Column, pattern: list[str]) -> Column:
    """Whether the pattern occurs in order, gaps allowed: a fold that keeps how much of it has been seen."""
    p = F.array(*(F.lit(x) for x in pattern))
    return F.aggregate(trace, F.lit(0), lambda k, x: F.when((k < len(pattern)) & (F.get(p, k) == x), k + 1).otherwise(k)) == len(pattern)


def variant_dictionary(trace: DataFrame, least: int = 1, most: int = 500) -> DataFrame:
    """(feature, trace, cases) of the most frequent whole traces of training cases (case, trace), ties by name, with at least that many cases."""
    counted = trace.groupBy("trace").agg(F.count("*").alias("cases")).where(F.col("cases") >= least)
    best = counted.orderBy(F.desc("cases"), F.array_join("trace", ",")).limit(most)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("cases")).alias("n"), F.array_join("trace", ",").alias("name"), "trace", "cases"))).alias("l"))  # at most `most` rows
    return listed.select(F.posexplode("l").alias("feature", "x")).select("feature", "x.trace", "x.cases")


def variant_rows(trace: DataFrame, case: str, dictionary: DataFrame) -> DataFrame:
    """(case, feature): cases of any split whose whole trace is in the dictionary, met by a hash of the trace and then compared."""
    known = dictionary.select("feature", F.col("trace").alias("_trace"), F.xxhash64("trace").alias("_h"))
    return trace.withColumn("_h", F.xxhash64("trace")).join(F.broadcast(known), "_h").where("trace = _trace").select(case, "feature")
