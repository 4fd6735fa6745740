"""The sales tables seen as weekly category rows.

``lineitem`` joined to its order, customer, nation and part gives one row per
(channel, material, category, week) observation. ``fine`` uses nation and
type × brand, ``coarse`` market segment and brand, ``customer`` customer name
and brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.operators.reshape import densify, sum_duplicates
from stockweave.schema import (
    CATEGORY, CHANNEL, CHANNEL_INV, CUST_SALES, MATERIAL, QTY, SELL_IN, SERIES, SKU, WEEK,
)

# Parameters that take the place of calendar constants for these tables.
FIRST_WEEK = 199501
LAST_WEEK = 200152
LAST_SALES_WEEK = 200144
CUTOFF_WEEK = 200052
REFERENCE_WEEK = 200133
YEAR_RANGE = (1995, 2002)
FOLDS = [
    (1, 199952, 200001, 200013),
    (2, 200013, 200014, 200026),
    (3, 200026, 200027, 200039),
    (4, 200039, 200040, 200052),
    (5, 200052, 200101, 200113),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, grain: str = "fine") -> DataFrame:
    """One row per line item: key columns, week, quantity, line number."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    df = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    if grain == "fine":
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        df = df.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        channel, material = F.col("n_name"), F.concat_ws(",", "p_type", "p_brand")
    elif grain == "customer":
        channel, material = F.col("c_name"), F.col("p_brand")
    else:
        channel, material = F.col("c_mktsegment"), F.col("p_brand")
    flag = F.col("l_returnflag")
    return df.select(
        channel.alias(CHANNEL),
        material.alias(MATERIAL),
        F.when(flag == "N", SELL_IN)
        .when(flag == "A", CUST_SALES)
        .otherwise(CHANNEL_INV)
        .alias(CATEGORY),
        wk.week_label("l_shipdate").alias(WEEK),
        F.col("l_quantity").alias(QTY),
        "l_linenumber",
    )


def signed_observations(spark: SparkSession, sf_dir: str, grain: str = "fine") -> DataFrame:
    """As :func:`observations`; line number 7 carries a negative quantity."""
    return observations(spark, sf_dir, grain).withColumn(
        QTY, F.when(F.col("l_linenumber") == 7, -F.col(QTY)).otherwise(F.col(QTY))
    )


def long_table(spark: SparkSession, sf_dir: str, grain: str = "fine") -> DataFrame:
    return sum_duplicates(observations(spark, sf_dir, grain).drop("l_linenumber"))


def dense_table(
    spark: SparkSession,
    sf_dir: str,
    grain: str = "coarse",
    category: str | None = None,
    last_week: int = LAST_WEEK,
) -> DataFrame:
    """Every observed series on every week of the calendar, 0 where absent."""
    df = long_table(spark, sf_dir, grain)
    if category:
        df = df.filter(F.col(CATEGORY) == category)
    return densify(df, SERIES, FIRST_WEEK, last_week, cluster=SKU)


def sell_in(spark: SparkSession, sf_dir: str, grain: str = "coarse") -> DataFrame:
    """Sparse weekly Sell-in (only weeks with a row)."""
    return long_table(spark, sf_dir, grain).filter(F.col(CATEGORY) == SELL_IN)


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows with a four-token material description."""
    size = F.col("p_size") % 4
    tail = F.when(size == 0, "CO").when(size == 1, "LTC").when(size == 2, "USA").otherwise("XYZW")
    first = F.upper(F.element_at(F.split("p_name", " "), 1))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(",", "p_type", "p_brand", first, tail).alias(MATERIAL)
    )
