"""Global ranks without a single task: range partitions, their counts, and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def exact_sum(x: Column, digits: int = 8) -> Column:
    """Sum of doubles of up to `digits` decimals that no order of the rows changes, so that equal sums are ties.

    Values that no decimal holds (not a number, infinite, over twenty whole digits) are added up as doubles."""
    d = x.try_cast(f"decimal(28,{digits})")
    return F.when(F.count(d) == F.count(x), F.coalesce(F.try_sum(d).cast("double"), F.sum(x))).otherwise(F.sum(x))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 1, 2, ... by `order`. Rows are dealt to range partitions and written, as a second sampling of the ranges could
    deal them otherwise; each partition needs the number of rows before it, one number a partition."""
    folder = shared_folder(df.sparkSession, "ranked")
    df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).write.parquet(folder)
    parts = df.sparkSession.read.parquet(folder)
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.join(F.broadcast(before), "__p").withColumn(name, (inner + F.col("__before")).cast("long")).drop("__p", "__before")


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key by `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def page(df: DataFrame, order: list[Column], skip: int, limit: int, most: int = 200) -> DataFrame:
    """Rows skip + 1 to skip + limit by `order`; limit is at most `most`."""
    return df.orderBy(*order).offset(skip).limit(min(limit, most))
