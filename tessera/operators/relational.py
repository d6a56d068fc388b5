"""Seven parameterised queries over a star schema.

The small sides (nation, supplier, part, customer) carry no broadcast hint: Catalyst compares their sizes
with ``spark.sql.autoBroadcastJoinThreshold`` and AQE does so again at run time, so a grown dimension is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _on(column: str, date: str) -> Column:
    """The column's day is ``date``; written as a range, which reaches the Parquet scan."""
    day = F.lit(date).cast("timestamp_ntz")
    at = F.col(column).cast("timestamp_ntz")
    return (at >= day) & (at < day + F.expr("INTERVAL 1 DAY"))


def shipped_count(lineitem: DataFrame, date: str) -> DataFrame:
    """Q1: how many line items shipped on the day."""
    return lineitem.where(_on("l_shipdate", date)).agg(F.count("*").alias("n_items"))


def shipped_clerks(lineitem: DataFrame, orders: DataFrame, date: str, clerk: str = "o_orderpriority", limit: int = 20) -> DataFrame:
    """Q2: the orders' clerk column and key of items shipped on the day, duplicates kept, the first by order key."""
    items = lineitem.where(_on("l_shipdate", date)).select("l_orderkey")
    joined = items.join(orders.select("o_orderkey", clerk), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(clerk, "o_orderkey").orderBy("o_orderkey", clerk).limit(limit)


def shipped_parts(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, date: str, limit: int = 20) -> DataFrame:
    """Q3: order key, part and supplier names of items shipped on the day, the first by order key (then by names)."""
    items = lineitem.where(_on("l_shipdate", date)).select("l_orderkey", "l_partkey", "l_suppkey")
    joined = items.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(
        supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return joined.select("l_orderkey", "p_name", "s_name").orderBy("l_orderkey", "p_name", "s_name").limit(limit)


def _by_nation(items: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, *keys: str) -> DataFrame:
    """Count items by their customer's nation (and keys); names are attached after aggregating."""
    joined = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    counted = joined.groupBy("c_nationkey", *keys).agg(F.count("*").alias("n_items"))
    named = counted.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_nationkey", "n_name", *keys, "n_items").orderBy("n_nationkey", "n_name", *keys)


def shipped_by_nation(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, date: str) -> DataFrame:
    """Q4: items shipped on the day, by the customer's nation."""
    return _by_nation(lineitem.where(_on("l_shipdate", date)).select("l_orderkey"), orders, customer, nation)


def monthly_by_nation(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, nations: tuple[int, ...] = (3, 24)) -> DataFrame:
    """Q5: items by month of shipping for customers of two nations, over all dates."""
    items = lineitem.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return _by_nation(items, orders, customer.where(F.col("c_nationkey").isin(*nations)), nation, "month")


def pricing_summary(lineitem: DataFrame, date: str) -> DataFrame:
    """Q6: sums, means and count by return flag and line status, for items shipped on the day."""
    discounted = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.where(_on("l_shipdate", date)).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(discounted), 2).alias("sum_disc_price"),
        F.round(F.sum(discounted * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


def unshipped_orders(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, date: str, keys: tuple[str, ...] = (), limit: int = 5) -> DataFrame:
    """Q7: orders placed before the day with items shipped after it, by revenue. ``keys``: further order columns to group by."""
    day = F.lit(date).cast("timestamp_ntz")
    shipped = F.col("l_shipdate").cast("timestamp_ntz") >= day + F.expr("INTERVAL 1 DAY")
    items = lineitem.where(shipped).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    revenue = items.groupBy("l_orderkey").agg(F.round(F.sum("value"), 2).alias("revenue"))
    placed = orders.where(F.col("o_orderdate").cast("timestamp_ntz") < day).select("o_orderkey", "o_custkey", "o_orderdate", *keys)
    joined = revenue.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("c_name", "l_orderkey", "revenue", "o_orderdate", *keys).orderBy(F.desc("revenue"), "l_orderkey", "c_name").limit(limit)
