"""Clinical shapes over the given tables: cases with nodes, stays, dated events, and a table with derived gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, y): orders that have lines, and whether they are finished."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id")), "case_id", "left_semi")


def basket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, line, node): brand, type, return flag and high quantity of each line."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = l.join(p, l.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "p_brand", "p_type")
    rows = rows.repartition("l_orderkey")  # lines are shuffled once, not each of their nodes whenever these are grouped by case
    nodes = F.array(F.concat(F.lit("B_"), "p_brand"), F.concat(F.lit("T_"), "p_type"), F.concat(F.lit("F_"), "l_returnflag"), F.when(F.col("l_quantity") >= 40, "Q_HIGH"))
    return rows.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), F.explode(nodes).alias("node")).where("node is not null")


#: Nodes that basket_events can give: 25 brands, 6 types, 3 flags and high quantity.
NODES = [*(f"B_Brand#{i}" for i in range(1, 26)), *(f"T_{t}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")), *(f"F_{f}" for f in "ANR"), "Q_HIGH"]


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, node, y), distinct by case and node."""
    return basket_events(spark, sf_dir).select("case_id", "node").distinct().join(cases(spark, sf_dir), "case_id")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stay_id, patient, admitted, discharged, status)."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("patient"), day.alias("admitted"), F.date_add(day, (F.col("o_orderkey") % 14).cast("int")).alias("discharged"), F.when(F.col("o_orderstatus") == "F", " 20 ").otherwise("01").alias("status"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, code, day, slot): events of a user within a week."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("case_id"), F.col("event_type").alias("code"), F.to_date("ts").alias("day"), F.col("event_id").alias("slot"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with an outcome y (a price above the median) and columns whose gaps depend on the price or on a hash."""
    l = table(spark, sf_dir, "lineitem")
    edges = ranges.quantiles(l, [], "l_extendedprice", [0.5, 0.85]).select(F.col("q").alias("e"))
    x = l.crossJoin(F.broadcast(edges)).withColumn("k", F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))))
    price, dear = F.col("l_extendedprice"), F.col("l_extendedprice") > F.col("e")[1]
    keep = F.substring("k", 1, 2) >= "26"
    return x.select("l_orderkey", "l_linenumber", (price > F.col("e")[0]).cast("int").alias("y"), F.when(~dear, F.col("l_quantity")).alias("a_qty"), F.when(~dear, F.col("l_tax")).alias("b_tax"), F.when(keep, F.col("l_quantity")).alias("c_qty"), F.when(keep, F.col("l_discount")).alias("d_disc"), F.when(keep, price).alias("e_price"), F.when(~dear, price).alias("f_price"))


GAPS = ["a_qty", "b_tax", "c_qty", "d_disc", "e_price", "f_price"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, score): the outcome of orders and a score from price and key."""
    o = table(spark, sf_dir, "orders")
    score = ((F.col("o_orderkey") * 7919) % 1000 + F.when(F.col("o_orderstatus") == "F", 150).otherwise(0)) / 1150
    return o.select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.round(score, 3).alias("score"))


# The same shapes as DuckDB SQL.
CASES = "cases AS (SELECT o_orderkey AS case_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
EVENTS = """ev AS (SELECT l_orderkey AS case_id, l_linenumber AS line, unnest(['B_' || p_brand, 'T_' || p_type, 'F_' || l_returnflag, CASE WHEN l_quantity >= 40 THEN 'Q_HIGH' END]) AS node
FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BASKET = f"{CASES}, {EVENTS}, nodes AS (SELECT DISTINCT case_id, node, y FROM ev JOIN cases USING (case_id) WHERE node IS NOT NULL)"
SUPPORT = "sup AS (SELECT node, count(*) AS n, sum(y) AS pos FROM nodes GROUP BY node), tot AS (SELECT count(*) AS total, sum(y) AS positives FROM cases)"
PAIRS = f"""{BASKET}, {SUPPORT},
pairs AS (SELECT l.node AS a, r.node AS b, count(*) AS n_ab, sum(l.y) AS pos_ab FROM nodes AS l JOIN nodes AS r ON l.case_id = r.case_id AND l.node < r.node GROUP BY 1, 2),
wide AS (SELECT pairs.*, x.n AS n_a, z.n AS n_b, total, positives FROM pairs JOIN sup AS x ON x.node = a JOIN sup AS z ON z.node = b CROSS JOIN tot)"""
TRIPLES = f"""{PAIRS}, tri AS (SELECT x.node AS a, y.node AS b, z.node AS c, count(*) AS n_abc, sum(x.y) AS pos_abc FROM nodes AS x JOIN nodes AS y ON x.case_id = y.case_id AND x.node < y.node
JOIN nodes AS z ON z.case_id = y.case_id AND y.node < z.node GROUP BY 1, 2, 3),
ord AS (SELECT a AS s1, b AS s2, c AS s3, n_abc, pos_abc FROM tri UNION ALL SELECT a, c, b, n_abc, pos_abc FROM tri UNION ALL SELECT b, a, c, n_abc, pos_abc FROM tri
UNION ALL SELECT b, c, a, n_abc, pos_abc FROM tri UNION ALL SELECT c, a, b, n_abc, pos_abc FROM tri UNION ALL SELECT c, b, a, n_abc, pos_abc FROM tri)"""
STAYS = """stays AS (SELECT o_orderkey AS stay_id, o_custkey AS patient, CAST(o_orderdate AS DATE) AS admitted, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INTEGER) AS discharged,
CASE WHEN o_orderstatus = 'F' THEN ' 20 ' ELSE '01' END AS status FROM orders)"""
DATED = "dated AS (SELECT user_id || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS case_id, event_type AS code, CAST(ts AS DATE) AS day, event_id AS slot FROM events)"
GAPPED = """edge AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.85) AS h FROM lineitem),
keyed AS (SELECT *, substr(md5(l_orderkey || '-' || l_linenumber), 1, 2) >= '26' AS keep FROM lineitem CROSS JOIN edge),
gaps AS (SELECT CAST(l_extendedprice > m AS INTEGER) AS y, CASE WHEN l_extendedprice <= h THEN l_quantity END AS a_qty, CASE WHEN l_extendedprice <= h THEN l_tax END AS b_tax, CASE WHEN keep THEN l_quantity END AS c_qty,
CASE WHEN keep THEN l_discount END AS d_disc, CASE WHEN keep THEN l_extendedprice END AS e_price, CASE WHEN l_extendedprice <= h THEN l_extendedprice END AS f_price, l_orderkey, l_linenumber FROM keyed),
long AS (SELECT y, variable, x FROM (SELECT y, unnest(['a_qty', 'b_tax', 'c_qty', 'd_disc', 'e_price', 'f_price']) AS variable, unnest([a_qty, b_tax, c_qty, d_disc, e_price, f_price]) AS x FROM gaps))"""
SCORED = "scored AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, round(((o_orderkey * 7919) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 150 ELSE 0 END) / CAST(1150 AS DOUBLE), 3) AS score FROM orders)"
