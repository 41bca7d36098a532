"""Queries that run streams over the event table, and models of yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, walkforward
from ..sources.tables import daily_bars, table
from ..streaming import stateful, streams
from .market_queries import _TX, _WIN, as_transactions
from .news_queries import as_articles
from .registry import query, rounded


#: Times in results, as text.
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    return streams.files(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL) SELECT CAST(start AS DATE) AS day, event_type, n, round(total, 4) AS total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"
)
def stream_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days of a stream, emitted once the watermark has passed them."""
    found = streams.drain(streams.tumbling(event_stream(spark, sf_dir), "ts", "event_type", "value"))
    return rounded(found.select(F.to_date("start").alias("day"), "event_type", "n", "total"), 4)


@query(
    f"WITH {_TX}, {_WIN} SELECT CAST(ws AS DATE) AS window_start, count(*) FILTER (type = 'INCOME') AS incomes, round(max(amount), 4) AS amount_max, count(DISTINCT account_id) AS accounts FROM win WHERE ws + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ws"
)
def stream_cashflow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding cash-flow windows of a stream: the same plan as the batch one behind a watermark."""
    found = streams.drain(streams.closed_windows(as_transactions(event_stream(spark, sf_dir))))
    return rounded(found.select(F.to_date("window_start").alias("window_start"), F.col("type_INCOME_count").alias("incomes"), "amount_max", F.col("unique_account_id_count").alias("accounts")), 4)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events of each user and type within a delay as long as the history."""
    return streams.drain(streams.distinct_within(event_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "60 days")).select("user_id", "event_type")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime("end", '%Y-%m-%d %H:%M:%S.%f') AS "end", user_id, n FROM s WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 HOUR"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows by user."""
    found = streams.drain(streams.sessions(event_stream(spark, sf_dir), "ts", "user_id", "6 hours"))
    return found.withColumns({n: F.date_format(n, MICROS) for n in ("start", "end")})


@query()
def stream_title_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories by similar titles of a company's day on a stream, titles expiring after a day."""
    docs = streams.files(spark, f"{sf_dir}/document[s].parquet", table(spark, sf_dir, "documents").schema)
    return streams.drain(stateful.title_clusters(as_articles(docs).withColumn("seen", F.col("published")))).select("id", "cluster")


@query(
    """SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, n, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high
    FROM (SELECT user_id, ts::TIMESTAMP AS ts, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev(value) OVER w AS std, min(value) OVER w AS low, max(value) OVER w AS high FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW)) WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY"""
)
def stream_interval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the three days before each event, by user, once the watermark has reached it."""
    found = streams.drain(stateful.interval_windows(event_stream(spark, sf_dir), "user_id", "ts", "value", 3 * stateful.DAY_MS))
    return rounded(found.withColumn("ts", F.date_format("ts", MICROS)))


@query("SELECT user_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) = 1")
def stream_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as the sums of a log of changes give it."""
    log = streams.drain(stateful.changes(event_stream(spark, sf_dir).select("user_id", "ts", "event_id", "value"), ["user_id"], "ts"))
    return rounded(stateful.table_at(log).select("user_id", "event_id", "value"))


def yield_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily open, high, low and close per maturity from the events."""
    at = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy((F.col("user_id") % 5).alias("maturity"), F.to_date("ts").alias("day")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))


@query()
def online_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online regression per maturity and its recursive forecast of 21 business days."""
    return rounded(models.forecast(models.train_online(models.samples(yield_levels(spark, sf_dir)))))


def bar_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars as levels; a bar's pair is its maturity."""
    return daily_bars(spark, sf_dir).withColumn("maturity", F.ascii("pair").cast("long"))


@query()
def elastic_net_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elastic net of the next close per pair and its recursive forecast of 14 business days, from 30 samples on."""
    return rounded(models.forecast_levels(models.elastic_net(models.level_samples(bar_samples(spark, sf_dir)))))


@query()
def boosted_tree_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of the next return on the last fifth of each pair's days."""
    return rounded(models.boosted_trees(models.samples(bar_samples(spark, sf_dir)))[0])


@query()
def walk_forward_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next returns of each pair's bars by a model of each walk-forward fold, and what each feature has to do with them."""
    found = walkforward.walk_forward(models.samples(bar_samples(spark, sf_dir)), list(models.FEATURES))
    shares = [F.round(F.col("importance")[k], 6).alias(f"by_{f}") for k, f in enumerate(models.FEATURES)]
    return rounded(found.select("pair", "fold", "day", "train_end", "actual", "predicted", *shares))


@query()
def stream_online_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online regression as a stateful stream over samples."""
    from ..sources.shared import shared_folder

    path = shared_folder(spark, "samples")
    s = models.samples(yield_levels(spark, sf_dir)).select("maturity", "day", "close", "target", *models.FEATURES)
    s.write.parquet(path)
    return rounded(streams.drain(streams.online_models(streams.files(spark, path, s.schema))).select("maturity", "n", "intercept", "last_close"))
