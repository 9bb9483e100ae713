"""Canonical panels from the supplied star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import month_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prices(rows: DataFrame, *keys) -> DataFrame:
    """Volume-weighted price and dollar volume; sums of cents, so they don't depend on the order of rows."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100
    dollars = F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")).cast("double") / 10000
    return rows.groupBy(*keys).agg((cents / F.sum("l_quantity")).alias("close"), dollars.alias("dvol"), F.count(F.lit(1)).alias("n"))


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, month_idx, close, dvol, n``."""
    return _prices(table(spark, sf_dir, "lineitem"), F.col("l_suppkey").alias("entity"), month_index("l_shipdate").alias("month_idx"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, date, close, dvol, n``; sparse."""
    return _prices(table(spark, sf_dir, "lineitem"), F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``month_idx, bench``: the market's price."""
    return _prices(table(spark, sf_dir, "lineitem"), month_index("l_shipdate").alias("month_idx")).select("month_idx", F.col("close").alias("bench"))


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, month_idx, open, high, low, close``; price and quantity end the order, so ties do no harm."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), month_index("l_shipdate").alias("month_idx"), unit.alias("u"), order.alias("o"))
    return rows.groupBy("entity", "month_idx").agg(F.min_by("u", "o").alias("open"), F.max("u").alias("high"), F.min("u").alias("low"), F.max_by("u", "o").alias("close"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, sector``: the supplier's region."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("sector"))
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, supplier["s_nationkey"] == nation["k"], "left").select(F.col("s_suppkey").alias("entity"), "sector")


def facts(spark: SparkSession, sf_dir: str, lag_days: int = 45) -> DataFrame:
    """``entity, period_end, available_date, value``: quarterly revenue by customer, known some days after the quarter."""
    orders = table(spark, sf_dir, "orders")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100
    rows = orders.groupBy(F.col("o_custkey").alias("entity"), end.alias("period_end")).agg(cents.alias("value"))
    return rows.withColumn("available_date", F.date_add("period_end", lag_days))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, entity, ts, type, value, k``."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), "ts", F.col("event_type").alias("type"), "value", k.alias("k"))
