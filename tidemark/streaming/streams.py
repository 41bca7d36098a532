"""Structured Streaming jobs: event-time windows, deduplication, stateful regression and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cashflow import window_features
from ..operators.models import FEATURES, Online
from ..operators.news import upsert
from ..sources.shared import shared_folder


def files(spark: SparkSession, path: str, schema, format: str = "parquet", per_trigger: int | None = None, **options) -> DataFrame:
    """A stream of the files that match a path."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def kafka(spark: SparkSession, servers: str, topic: str, schema: str, starting: str = "latest", per_trigger: int | None = None, **options) -> DataFrame:
    """A stream of a topic's JSON values as columns; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).options(**options)
    reader = reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def to_kafka(stream: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """Writes rows as JSON, compressed, acknowledged by all replicas."""
    out = stream.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*stream.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.compression.type", "gzip").option("checkpointLocation", checkpoint).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream has now, through a file sink with a checkpoint in the shared folder, read back as a table."""
    spark = stream.sparkSession
    out, checkpoint = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def closed_windows(transactions: DataFrame, days: int = 7, late: str = "7 days") -> DataFrame:
    """Cash-flow windows of a stream, each once, when the watermark has passed its end."""
    return window_features(transactions, days, watermark=late)


def tumbling(stream: DataFrame, time: str, key: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    w = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct_within(stream: DataFrame, time: str, keys: list[str], late: str = "24 hours") -> DataFrame:
    """The first row of each key within the watermark's delay; state expires with it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


ONLINE = "maturity bigint, n bigint, intercept double, weights array<double>, last_close double"
STATE = "n bigint, bias double, w array<double>, mean array<double>, dev array<double>"


def online_models(stream: DataFrame) -> DataFrame:
    """A stream of samples (maturity, day, close, target, features) as a stream of models: the state is the model, rows of a batch are learnt by day."""

    def learn(key, batches, state) -> Iterator:
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("day")
        model = Online()
        if state.exists:
            model.n, model.bias, w, mean, dev = state.get
            model.w, model.mean, model.dev = np.array(w), np.array(mean), np.array(dev)
        x = rows[list(FEATURES)].fillna(0.0).to_numpy(float)
        for xi, y in zip(x, rows["target"], strict=True):
            if y is not None and y == y:
                model.learn(xi, float(y))
        state.update((int(model.n), float(model.bias), model.w.tolist(), model.mean.tolist(), model.dev.tolist()))
        yield pd.DataFrame([{"maturity": key[0], "n": model.n, "intercept": model.bias, "weights": model.w, "last_close": rows["close"].iloc[-1]}])

    return stream.groupBy("maturity").applyInPandasWithState(learn, ONLINE, STATE, "append", "NoTimeout")


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """Keeps a table of the latest row a key: each batch merges into a new version v<number>, then the file `current` names it.

    Readers use `current_version`. The version before stays for readers that have just looked it up; older ones go. A batch
    that is repeated after a failure writes its version again, from the same one before it.
    """
    spark = stream.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{path}/v{number - 1}"
        stored = batch.sparkSession.read.parquet(before) if fs.exists(hadoop.Path(before)) else batch.limit(0)
        upsert(stored, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")
        out = fs.create(hadoop.Path(f"{path}/current"), True)
        out.writeBytes(f"v{number}")
        out.close()
        fs.delete(hadoop.Path(f"{path}/v{number - 2}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current_version(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_stream's file `current` names."""
    name = spark.read.text(f"{path}/current").head()[0]
    return spark.read.parquet(f"{path}/{name}")
