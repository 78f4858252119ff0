"""Relational reach beyond retrieval, on the order tables: joins, grouping sets, windows, set operations. Built-ins of Spark, as extra coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.plans import REGISTRY
from vellum.sources.tables import table


@REGISTRY.query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, directory: str) -> DataFrame:
    li = table(spark, directory, "lineitem").filter(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@REGISTRY.query("nation_revenue", """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def nation_revenue(spark: SparkSession, directory: str) -> DataFrame:
    """A five-way join under a rollup; lines are reduced to one row an order before they meet the customers."""
    lines = table(spark, directory, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.count(F.lit(1)).alias("m"))
    j = per_order.join(table(spark, directory, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, directory, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, directory, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, directory, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.round(F.sum("net"), 2).alias("revenue"), F.sum("m").alias("n"))


@REGISTRY.query("customer_gaps", "SELECT o_custkey, o_orderkey, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS INT) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def customer_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """Days since each customer's order before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, directory, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return o.select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))


@REGISTRY.query("silent_customers", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def silent_customers(spark: SparkSession, directory: str) -> DataFrame:
    c = table(spark, directory, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    rich = c.filter(F.col("c_acctbal") > c.agg(F.avg("c_acctbal").alias("a")).scalar())
    o = table(spark, directory, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'")
    return rich.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@REGISTRY.query("segment_set_ops", "(SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def segment_set_ops(spark: SparkSession, directory: str) -> DataFrame:
    c = table(spark, directory, "customer", "c_nationkey", "c_mktsegment").filter("c_mktsegment = 'BUILDING'").select("c_nationkey")
    s = table(spark, directory, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("c_nationkey"))
    n = table(spark, directory, "nation", "n_nationkey", "n_regionkey").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return c.intersect(s).subtract(n)
