"""Readers: Parquet tables, typed CSV, and the daily bars that the time-series operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the text inputs. Column names with spaces are those of the files.
OHLCV = T.StructType([T.StructField("ts_ms", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume"))])
TRANSACTIONS = T.StructType([T.StructField("account_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("date", "type", "operation")), *(T.StructField(n, T.DoubleType()) for n in ("amount", "balance")), *(T.StructField(n, T.StringType()) for n in ("k_symbol", "bank", "account"))])
YIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("Date", "Open", "High", "Low", "Close")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """An empty table with a schema."""
    return spark.createDataFrame([], schema)


def ohlcv_files(spark: SparkSession, folder: str) -> DataFrame:
    """All {pair}.csv of a folder as one table; pair is the file's name."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    return spark.read.schema(OHLCV).option("header", True).csv(f"{folder}/*.csv").select("*", name.alias("pair"))


def percent(text) -> F.Column:
    """'7.270%' as 7.27; empty, null or broken as 0."""
    return F.coalesce(F.replace(F.replace(text, F.lit("%"), F.lit("")), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def any_date(text) -> F.Column:
    """The first format that fits: month/day/year, ISO, day-month-year, day/month/year; else null."""
    return F.coalesce(*(F.try_to_date(text, f) for f in ("MM/dd/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")))


def yield_files(spark: SparkSession, folder: str) -> DataFrame:
    """All {n}y.csv of a folder: date, open, high, low, close (percent strings as numbers) and maturity from the name; undated rows go."""
    years = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)y\.csv$", 1).try_cast("int")
    rows = spark.read.schema(YIELDS).option("header", True).csv(f"{folder}/*.csv")
    return rows.select(any_date("Date").alias("date"), *(percent(F.col(n)).alias(n.lower()) for n in ("Open", "High", "Low", "Close")), years.alias("maturity")).where("date is not null")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, ts_ms, day, open, high, low, close, volume): a bar per return flag and shipping day of the line items.

    The first and last price of a day are those of the least and greatest full tie tuple, as the items have no unique key.
    """
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    bars = rows.groupBy(F.col("l_returnflag").alias("pair"), F.to_date("l_shipdate").alias("day")).agg(
        F.min_by("price", tie).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", tie).alias("close"), F.sum("l_quantity").alias("volume")
    )
    return bars.select("pair", (F.unix_date("day").cast("long") * 86_400_000).alias("ts_ms"), "day", "open", "high", "low", "close", "volume")


#: The same bars in SQL, as a common table expression named bars.
BARS_SQL = """bars AS (
  SELECT l_returnflag AS pair, CAST(l_shipdate AS DATE) AS day,
    arg_min(price, tie) AS open, max(price) AS high, min(price) AS low, arg_max(price, tie) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS price,
          row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS tie FROM lineitem)
  GROUP BY ALL)"""
