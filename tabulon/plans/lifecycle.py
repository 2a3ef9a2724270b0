"""The flagship query: first event on or after, conditional counts and exact quantiles by fiscal year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.dates import fiscal_year
from tabulon.operators.joins import first_on_or_after
from tabulon.plans.registry import register
from tabulon.sources.tables import table


@register(
    "rule_lifecycle",
    """
    WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS od, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
    f AS (SELECT o.o_orderkey, min(l_shipdate::DATE) AS first_ship FROM o JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate::DATE >= od GROUP BY 1),
    d AS (SELECT o.*, date_diff('day', od, first_ship) AS days FROM o LEFT JOIN f USING (o_orderkey))
    SELECT c_mktsegment AS segment, year(od + INTERVAL 3 MONTH)::INT AS fiscal_year, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open_orders,
      count(days) AS shipped, quantile_cont(days, 0.25) FILTER (days IS NOT NULL) AS q25, quantile_cont(days, 0.5) FILTER (days IS NOT NULL) AS q50,
      quantile_cont(days, 0.75) FILTER (days IS NOT NULL) AS q75
    FROM d GROUP BY 1, 2 HAVING count(*) >= 1
    """,
)
def rule_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("od", F.to_date("o_orderdate")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", "od", "o_orderstatus", "c_mktsegment")
    ships = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("ship"))
    joined = first_on_or_after(orders, ships, on="o_orderkey", at="od", event="ship", out="first_ship")
    days = joined.withColumn("days", F.datediff("first_ship", "od"))
    # exact, and kept as counts of distinct days (a few thousand), whatever a group's size
    q = [F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY days)").alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return days.groupBy(F.col("c_mktsegment").alias("segment"), fiscal_year("od").alias("fiscal_year")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count("days").alias("shipped"), *q)
