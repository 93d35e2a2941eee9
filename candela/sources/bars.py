"""Bars and the tables around them, derived from the star schema.

``lineitem`` has no prices of one instrument over time, so a supplier's shipments of a day give a bar: volume and amount
are its sums, and the mean discount drives the close from day to day.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from candela.functions.series import by_symbol, lit, prior, ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The largest double whose exponential is finite.
LARGEST = math.log(sys.float_info.max)


@F.pandas_udf(DoubleType())
def exponential(x: pd.Series) -> pd.Series:
    """e to the power of x as the C library rounds it.

    The JVM's own is often one unit in the last place away, and where means or levels are equal that unit decides a comparison.
    """
    return pd.Series([math.exp(v) if v <= LARGEST else v if math.isnan(v) else math.inf for v in x.tolist()], dtype="float64")


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """(symbol, date, open, high, low, close, volume, amount)."""
    day = lineitem.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("volume"), F.round(F.avg("l_discount"), 9).alias("r"), F.round(F.avg("l_tax"), 9).alias("x"), F.sum("l_extendedprice").alias("amount")
    )
    walk = F.sum((F.col("r") - lit(0.05)) * lit(0.6)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    closed = day.withColumn("close", lit(100) * exponential(F.round(walk, 9)))  # rounded, so that equal moves give equal prices
    opened = closed.withColumn("open", F.coalesce(F.lag("close").over(by_symbol()), lit(100)))
    high = F.greatest("open", "close") * (lit(1) + F.col("x") * lit(0.2))
    low = F.least("open", "close") * (lit(1) - F.col("x") * lit(0.2))
    return opened.select("symbol", "date", "open", high.alias("high"), low.alias("low"), "close", "volume", "amount")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def with_change(frame: DataFrame) -> DataFrame:
    """Adds change_rate (per cent against the previous close), amplitude and turnover (per cent of the symbol's total volume)."""
    before = F.lag("close").over(by_symbol())
    total = F.sum("volume").over(Window.partitionBy("symbol"))
    return frame.select(
        "*",
        F.round(ratio(F.col("close") - before, before) * lit(100), 9).alias("change_rate"),
        (ratio(F.col("high") - F.col("low"), before) * lit(100)).alias("amplitude"),
        (ratio(F.col("volume"), total) * lit(100)).alias("turnover"),
    )


def basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, name, nation, balance)."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sector_code, sector_name, sector_type, symbol): nations are industries, regions are concepts."""
    stock = basics(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = stock.join(F.broadcast(nation), F.col("nation") == F.col("n_nationkey"))  # 25 nations

    def sector(prefix: str, key: str, name: str, kind: str) -> DataFrame:
        return placed.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("sector_code"), F.col(name).alias("sector_name"),
            F.lit(kind).alias("sector_type"), "symbol")

    return sector("N", "n_nationkey", "n_name", "industry").unionByName(sector("R", "r_regionkey", "r_name", "concept"))


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each symbol as a market snapshot."""
    frame = with_change(bars(spark, sf_dir))
    year = Window.partitionBy("symbol", F.year("date")).orderBy("date")
    last = frame.select(
        "*",
        ratio(F.col("volume"), F.avg("volume").over(prior(5))).alias("volume_ratio"),
        ((ratio(F.col("close"), F.lag("close", 60).over(by_symbol())) - lit(1)) * lit(100)).alias("change_60d"),
        ((ratio(F.col("close"), F.first("open").over(year)) - lit(1)) * lit(100)).alias("change_ytd"),
        F.sum("volume").over(Window.partitionBy("symbol")).alias("shares"),
        F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))).alias("rn"),
    ).where("rn = 1")
    return last.join(basics(spark, sf_dir), "symbol").select(
        "symbol", "name", F.col("date").alias("trade_date"), F.col("close").alias("latest_price"), "change_rate", "volume", "amount", "amplitude",
        "volume_ratio", F.col("turnover").alias("turnover_rate"),
        (F.col("balance") / lit(100)).alias("pe_dynamic"), (F.abs("balance") / lit(1000)).alias("pb"), (F.col("close") * F.col("shares")).alias("total_market_cap"),
        (F.col("close") * F.col("shares") * lit(0.7)).alias("float_market_cap"), "change_60d", "change_ytd",
    )


def ranks(frame: DataFrame) -> DataFrame:
    """(rank_date, symbol, rank): symbols by volume each day."""
    order = Window.partitionBy("date").orderBy(F.desc("volume"), "symbol")
    return frame.select(F.col("date").alias("rank_date"), "symbol", F.row_number().over(order).alias("rank"))


def sector_bars(frame: DataFrame, member: DataFrame) -> DataFrame:
    """(sector_code, date, open, high, low, close, volume, amount): members' mean return, compounded from 1000."""
    before = F.lag("close").over(by_symbol())
    moved = frame.select("*", F.coalesce(ratio(F.col("close"), before) - lit(1), lit(0)).alias("r"), ratio(F.col("high") - F.col("low"), F.col("close")).alias("span"))
    day = moved.join(member.select("sector_code", "symbol"), "symbol")
    mean = day.groupBy("sector_code", "date").agg(F.avg("r").alias("r"), F.avg("span").alias("span"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
    window = by_symbol("sector_code")
    closed = mean.withColumn("close", lit(1000) * F.exp(F.sum(F.log(lit(1) + F.col("r"))).over(window.rowsBetween(Window.unboundedPreceding, 0))))
    opened = closed.withColumn("open", F.coalesce(F.lag("close").over(window), lit(1000)))
    return opened.select("sector_code", "date", "open", (F.greatest("open", "close") * (lit(1) + F.col("span") / lit(4))).alias("high"),
        (F.least("open", "close") * (lit(1) - F.col("span") / lit(4))).alias("low"), "close", "volume", "amount")


def flows(frame: DataFrame) -> DataFrame:
    """(symbol, date, net_inflow): the day's amount, signed by its return."""
    before = F.lag("close").over(by_symbol())
    return frame.select("symbol", "date", (F.col("amount") * F.coalesce(F.signum(F.col("close") - before), lit(0))).alias("net_inflow"))
