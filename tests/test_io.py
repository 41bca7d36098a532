"""Files, streams, vectors and pages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import models, news, vectors
from tidemark.sources import tables
from tidemark.streaming import streams


def test_yield_and_bar_files(spark, tmp_path):
    (tmp_path / "2y.csv").write_text('Date,Open,High,Low,Close\n01/31/2024,7.270%,7.3%,7.2%,7.25%\nnonsense,1%,1%,1%,1%\n')
    (tmp_path / "7y.csv").write_text('Date,Open,High,Low,Close\n2024-02-01,,7.3%,7.2%,7.25%\n')
    got = {r.maturity: r for r in tables.yield_files(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and got[2].open == 7.27 and got[7].open == 0.0 and str(got[7].date) == "2024-02-01"
    bars = tmp_path / "bars"
    bars.mkdir()
    (bars / "EURUSD.csv").write_text("ts_ms,open,high,low,close,volume\n0,1,2,0.5,1.5,10\n")
    assert [(r.pair, r.close) for r in tables.ohlcv_files(spark, str(bars)).collect()] == [("EURUSD", 1.5)]
    assert tables.empty(spark, "a int").count() == 0


def test_stream_of_csv_and_upserts(spark, tmp_path):
    source, table = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text("1,1,x\n2,1,y\n")
    stream = streams.files(spark, str(source), "k int, t int, v string", "csv")
    for rows in (None, "1,2,z\n3,1,w\n"):
        if rows:
            (source / "b.csv").write_text(rows)
        streams.upsert_stream(stream, str(table), "k", "t", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(f"{table}/v1").collect()} == {1: "z", 2: "y", 3: "w"}
    assert {r.k: r.v for r in streams.current_version(spark, str(table)).collect()} == {1: "z", 2: "y", 3: "w"}
    for k in range(3):
        (source / f"c{k}.csv").write_text(f"9,{k},u{k}\n")
        streams.upsert_stream(stream, str(table), "k", "t", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert streams.current_version(spark, str(table)).where("k = 9").head().v == "u2"
    assert sorted(x.name for x in table.iterdir() if not x.name.startswith(".")) == ["current", "v3", "v4"]


def test_stateful_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(m, f"2024-01-{d:02d}", *map(float, sorted(rng.uniform(5, 9, 2))), float(rng.uniform(5, 9))) for m in (1, 2) for d in range(1, 29)]
    levels = spark.createDataFrame(rows, "maturity long, d string, low double, high double, close double").select("*", F.col("d").cast("date").alias("day"), F.col("close").alias("open")).drop("d")
    samples = models.samples(levels).select("maturity", "day", "close", "target", *models.FEATURES)
    samples.coalesce(1).write.parquet(str(tmp_path / "s"))
    batch = {r.maturity: r for r in models.train_online(spark.read.parquet(str(tmp_path / "s"))).collect()}
    got = streams.drain(streams.online_models(streams.files(spark, str(tmp_path / "s"), samples.schema))).collect()
    assert {r.maturity for r in got} == {1, 2}
    for r in got:
        assert r.n == batch[r.maturity].n == 27
        assert r.weights == pytest.approx(batch[r.maturity].weights)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<float>")
    for metric in ("l2", "cosine"):
        got = {}
        for r in vectors.nearest(df.where("vec_id % 20 = 0"), df, 3, metric, block=7).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id))
        unit = data / np.linalg.norm(data, axis=1, keepdims=True)
        for q in range(0, 300, 20):
            d = np.linalg.norm(data - data[q], axis=1) if metric == "l2" else 1 - unit @ unit[q]
            d[q] = np.inf
            assert [i for _, i in sorted(got[q])] == np.argsort(d, kind="stable")[:3].tolist()


def test_nearest_vectors_in_slices(spark, monkeypatch):
    """A task holds QUERIES x ROWS distances at a time; ties over slices go by id, short slices and vectors of other lengths included."""
    monkeypatch.setattr(vectors, "QUERIES", 4)
    monkeypatch.setattr(vectors, "ROWS", 7)
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, size=(120, 3)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "vec_id long, embedding array<float>").coalesce(2)
    got = {}
    for r in vectors.nearest(df.where("vec_id % 5 = 0"), df, 9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(0, 120, 5):
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [i for _, i in sorted(got[q])] == np.argsort(d, kind="stable")[:9].tolist()


def test_nearest_vectors_rank_as_sql_on_near_ties(spark, tmp_path):
    """Distances are the SQL's to the last bit: copies, permuted differences, and values of which squares overflow or vanish."""
    import duckdb

    from tidemark.plans import catalogue

    rng = np.random.default_rng(8)
    base = rng.normal(size=64).astype(np.float32)
    step = (rng.normal(size=64) * 0.1).astype(np.float32)
    data = [base + rng.permutation(step) for _ in range(600)]
    data += data[:60] + [np.full(64, x, np.float32) for x in (1e20, -1e20, 3e19, 1e-24, 2e-24, -1e-24, 0.0, 0.0)]
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["nearest_vectors"](spark, str(tmp_path)).select("query_id", "id", "rank", "distance", "relevance").collect()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"select query_id, id, rank, distance, relevance from ({catalogue.ORACLES['nearest_vectors']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 34 * 5


def test_pages_and_events(spark):
    html = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><nav>menu</nav><p>Shares of X&nbsp;rose &lt;5%&gt;</p><!-- no --><script>var a='<p>';</script></body></html>"
    r = spark.createDataFrame([(html,), (None,)], "h string").select(tx.html_title(F.col("h")).alias("t"), tx.html_text(F.col("h")).alias("x"), tx.events(F.lower(F.lit("The CEO resigned after a lawsuit; Q3 revenue fell"))).alias("e")).collect()
    assert r[0].t == " A & B " or r[0].t == " A &amp; B "
    assert r[0].x == "Shares of X rose <5%>" and r[1].x is None
    assert r[0].e == ["earnings", "lawsuit", "executive_change"]


def test_exact_layers(spark):
    body = "x" * 200
    rows = [(1, "http://a.com/1?utm_source=z", body), (2, "http://A.com/1", "y" * 200), (3, "http://a.com/3", body), (4, None, "short"), (5, None, "short"), (6, "http://a.com/3", body)]
    got = {r.id: r.duplicate for r in news.exact_duplicates(spark.createDataFrame(rows, "id long, url string, content string")).collect()}
    assert got == {1: "", 2: "url", 3: "content", 4: "", 5: "", 6: "url"}


def test_page_metadata_tables_and_feeds(spark):
    html = """<head><meta property="og:site_name" content="The &amp; Paper"><meta content="Ann Lee" name="author"><link rel="shortcut icon" href="/f.ico">
    <script type="application/ld+json">{"datePublished": "2024-02-03T04:05:06Z", "author": {"@type": "Person", "name": "Bob"}}</script></head>
    <table><tr><th>Day</th><th>Rate</th></tr><tr><td>1</td><td><b>7.5%</b></td></tr><tr></tr></table>"""
    h = F.col("h")
    r = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(
        tx.html_meta(h, "og:site_name").alias("site"), tx.html_author(h).alias("author"), tx.html_published(h).alias("published"), tx.html_icon(h).alias("icon"), tx.html_rows(h).alias("rows")
    ).collect()
    assert tuple(r[0]) == ("The & Paper", "Ann Lee", "2024-02-03T04:05:06Z", "/f.ico", [["Day", "Rate"], ["1", "7.5%"]])
    assert tuple(r[1]) == (None,) * 5 and tuple(r[2]) == (None, None, None, None, [])
    item = "<item><title><![CDATA[{}]]></title><link>{}</link><pubDate>{}</pubDate><source url='x'>S</source></item>"
    xml = "<rss><channel>" + item.format("A & B", "https://a/1", "Tue, 02 Jan 2024 10:00:00 GMT") + item.format("old", "https://a/2", "Mon, 01 Jan 2024 10:00:00 GMT") + item.format("no link", "", "") + item.format("undated", "http://a/3", "soon") + "</channel></rss>"
    got = news.feed_articles(spark.createDataFrame([("co", xml), ("none", None)], "company string, xml string"), F.lit("2024-01-02").cast("timestamp")).collect()
    assert [(x.company, x.title, x.link, x.source) for x in got] == [("co", "A & B", "https://a/1", "S"), ("co", "undated", "http://a/3", "S")]
