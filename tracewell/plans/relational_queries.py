"""The relational substrate under the operators: joins of each kind, sets, grouping sets, pivots and ranges."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS part FROM orders GROUP BY 1")
def pivot_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.select("priority", F.col("F").alias("finished"), F.col("O").alias("open"), F.col("P").alias("part"))


SIDES = "(SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority {} GROUP BY 1)"


@query(f"SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM {SIDES.format("= '1-URGENT'")} a FULL JOIN {SIDES.format("= '5-LOW'")} b ON a.k = b.k")
def pair_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda p, n: o.filter(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    return side("1-URGENT", "left_n").join(side("5-LOW", "right_n"), "k", "full")


KEYS = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = '{}'"


@query(f"SELECT k, 'both' AS side FROM ({KEYS.format('F')} INTERSECT {KEYS.format('P')}) UNION ALL SELECT k, 'left' FROM ({KEYS.format('F')} EXCEPT {KEYS.format('P')})")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return keys("F").intersect(keys("P")).withColumn("side", F.lit("both")).unionByName(keys("F").subtract(keys("P")).withColumn("side", F.lit("left")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, a, b = table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus")
    return li.groupingSets([[a, b], [a], []], a, b).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS big FROM customer")
def semi_anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").withColumn("big", F.lit(True)).unionByName(c.join(big, "c_custkey", "left_anti").withColumn("big", F.lit(False)))


@query("SELECT a.p_partkey AS k, count(*) AS n FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey - 5 AND a.p_partkey + 5 AND b.p_size = a.p_size GROUP BY 1")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys within five of each other: an equi-join on buckets of eleven keys, each row sent to the buckets its range meets."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lo, hi = F.expr("floor((p_partkey - 5) / 11)"), F.expr("floor((p_partkey + 5) / 11)")
    a = p.select(F.col("p_partkey").alias("k"), "p_size", F.explode(F.sequence(lo, hi)).alias("bucket"))
    b = p.select("p_partkey", "p_size", F.expr("floor(p_partkey / 11)").alias("bucket"))
    return a.join(b, ["bucket", "p_size"]).filter("p_partkey BETWEEN k - 5 AND k + 5").groupBy("k").agg(F.count("*").alias("n"))


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.sum(cents).alias("cents"), F.count("*").alias("n"))


@query(
    """SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    per = o.join(c, "c_custkey").groupBy("n_nationkey").agg(F.sum("n").alias("orders"), F.count("*").alias("customers"))
    return per.join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("n_name").agg(F.sum("orders").alias("orders"), F.sum("customers").alias("customers"))
