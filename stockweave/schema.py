"""Column names and label values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

CHANNEL = "Channel"
MATERIAL = "Material Description"
CATEGORY = "Category"
WEEK = "year_week"
QTY = "quantity"

SKU = [CHANNEL, MATERIAL]
SERIES = [CHANNEL, MATERIAL, CATEGORY]

# Category labels of the source files.
SELL_IN = "Sell-in"
CUST_SALES = "Cust. Sales"
CHANNEL_INV = "Channel Inv."
CATEGORIES = [SELL_IN, CUST_SALES, CHANNEL_INV]

# Tier labels, in report order.
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CHURN_TIERS = ["ALTO", "MEDIO", "BAJO", "ACTIVO"]

SILVER = T.StructType(
    [
        T.StructField(CHANNEL, T.StringType()),
        T.StructField(MATERIAL, T.StringType()),
        T.StructField(CATEGORY, T.StringType()),
        T.StructField(WEEK, T.IntegerType()),
        T.StructField(QTY, T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("week_num", T.IntegerType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("product_model", T.StringType()),
        T.StructField("product_color", T.StringType()),
        T.StructField("product_country", T.StringType()),
    ]
)
