"""Article deduplication in three layers, story clusters and search."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, normal_title, normal_url, rss_items, similarity
from ..sources.shared import shared_folder
from .ranking import global_rank
from .timeseries import keep_latest


def exact_duplicates(articles: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """articles (id, url, content, ...) with url_hash, content_hash and duplicate: '', 'url' or 'content', of an article with a lesser id.

    seen (url_hash) has addresses of earlier runs. A page under 100 characters has no content hash and repeats none; a null
    url repeats none. First ids are aggregated before they are joined back, so an address of very many rows is one row there.
    """
    a = articles.withColumns({"url_hash": F.md5(normal_url(F.col("url"))), "content_hash": content_hash(F.coalesce("content", F.lit("")))})
    first = a.where("url_hash is not null").groupBy("url_hash").agg(F.min("id").alias("__first"))
    a = a.join(first, "url_hash", "left").withColumn("__url", F.coalesce(F.col("id") > F.col("__first"), F.lit(False))).drop("__first")
    if seen is not None:
        known = seen.select("url_hash").distinct().withColumn("__seen", F.lit(True))
        a = a.join(known, "url_hash", "left").withColumn("__url", F.col("__url") | F.col("__seen").isNotNull()).drop("__seen")
    # of contents, only those of articles with a new address register
    first = a.where(~F.col("__url") & (F.col("content_hash") != "")).groupBy("content_hash").agg(F.min("id").alias("__first"))
    a = a.join(first, "content_hash", "left")
    same = ~F.col("__url") & F.coalesce(F.col("id") > F.col("__first"), F.lit(False))
    return a.withColumn("duplicate", F.when(F.col("__url"), "url").when(same, "content").otherwise("")).drop("__url", "__first")


class Titles:
    """The registered titles of a block in their order, `most` at most (None: all), each for ttl_ms from when it was added (None: for good)."""

    #: Code points of a title that are compared in words of 64 bits; longer titles are compared one by one.
    WORDS = 2
    #: Classes of characters there, so that a title's letters take no more room than its words.
    CLASSES = 256

    def __init__(self, least: float, most: int | None = None, ttl_ms: int | None = None):
        self.least, self.most, self.ttl_ms = least, most, ttl_ms
        self.titles: list[str] = []
        self.clusters: list[int] = []
        self.now: int | None = None
        self.times, self.lengths = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.counts = np.zeros((64, 64), np.uint32)
        self.masks = np.zeros((self.CLASSES, self.WORDS, 64), np.uint64)

    def load(self, titles: list[str], clusters: list[int], added: list[int]) -> None:
        for t, c, at in zip(titles, clusters, added, strict=True):
            self._add(t, c, at)

    def dump(self) -> tuple[list[str], list[int], list[int]]:
        self._drop()
        return self.titles, self.clusters, self.times[: len(self.titles)].tolist()

    def last(self) -> int:
        return int(self.times[: len(self.titles)].max())

    def expire(self, now: int) -> None:
        """Titles that have lived for ttl_ms match no more, and go once they are half of all, so that each is moved few times."""
        if self.ttl_ms is not None:
            self.now = now
            dead = np.count_nonzero(self.times[: len(self.titles)] + self.ttl_ms <= now)
            if dead and (self.most is not None or 2 * dead > len(self.titles)):
                self._drop()

    def _drop(self) -> None:
        if self.ttl_ms is None or self.now is None:
            return
        live = np.flatnonzero(self.times[: len(self.titles)] + self.ttl_ms > self.now)
        if len(live) < len(self.titles):
            for x in self._arrays():
                x[..., : len(live)] = x[..., live]
                x[..., len(live) : len(self.titles)] = 0
            self.titles, self.clusters = ([x[k] for k in live] for x in (self.titles, self.clusters))

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.times, self.lengths, self.counts, self.masks

    def _add(self, title: str, cluster: int, at: int) -> None:
        n, code = len(self.titles), self._codes(title)
        if n == len(self.times):
            self.times, self.lengths, self.counts, self.masks = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in self._arrays())
        self.times[n], self.lengths[n], self.counts[:, n] = at, len(code), self._count(code)
        place = np.arange(min(len(code), 64 * self.WORDS))
        np.bitwise_or.at(self.masks, (code[: len(place)], place // 64, n), np.uint64(1) << (place % 64).astype(np.uint64))
        self.titles.append(title)
        self.clusters.append(cluster)

    def place(self, number: int, title: str | None, now: int = 0) -> int:
        """The cluster of an article's normalised title: that of the first similar one, else its own number."""
        if not title or len(title) < 10:
            return number
        self.expire(now)
        k = self.match(title, now)
        if k is not None:
            return self.clusters[k]
        if self.most is None or len(self.titles) < self.most:
            self._add(title, number, now)
        return number

    def place_rest(self, numbers: list[int], titles: list[str | None], times: list[int] | None = None, rows: int = 4096) -> list[int]:
        """As place for each, where none registers: equal titles are compared once, with `rows` registered ones at a time."""
        out, done = list(numbers), {}
        for k, (t, now) in enumerate(zip(titles, times or [0] * len(titles), strict=True)):
            if t and len(t) >= 10:
                if (t, now) not in done:
                    done[t, now] = self.match(t, now, rows)
                if done[t, now] is not None:
                    out[k] = self.clusters[done[t, now]]
        return out

    def match(self, title: str, now: int = 0, rows: int = 4096) -> int | None:
        """The place of the first registered title that is similar and lives.

        Titles that share too few characters, counted in 64 classes, can't be similar and are not compared.
        """
        code, n = self._codes(title), len(self.titles)
        count = self._count(code)
        there = np.flatnonzero(count)
        for at in range(0, n, rows):
            some = slice(at, min(at + rows, n))
            limit = self.least * (self.lengths[some] + len(code)) / 2 - 1e-9
            near = np.minimum(self.counts[there, some], count[there, None]).sum(axis=0, dtype=np.uint32) >= limit
            if self.ttl_ms is not None:
                near &= self.times[some] + self.ttl_ms > now
            near = np.flatnonzero(near)
            close = (self._common(code, near + at) >= limit[near]) | (self.lengths[near + at] > 64 * self.WORDS)
            for k in (near[close] + at).tolist():
                if similarity(title, self.titles[k]) >= self.least:
                    return k
        return None

    def _common(self, code: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of a text and registered ones, or more where classes hold several characters.

        As in `similarity`, a bit of v is a place of the registered title; the carry goes from the first word to the second.
        """
        v = np.full((self.WORDS, len(places)), ~np.uint64(0))
        met, total, carry = np.empty_like(v), np.empty_like(v), np.empty(len(places), bool)
        masks = {c: np.take(self.masks[c], places, axis=1) for c in set(code.tolist())} if len(places) else {}
        for c in code.tolist() if len(places) else []:
            np.bitwise_and(v, masks[c], out=met)
            np.add(v, met, out=total)
            np.less(total[0], met[0], out=carry)
            total[1] += carry
            np.bitwise_xor(v, met, out=v)
            np.bitwise_or(v, total, out=v)
        return 64 * self.WORDS - np.bitwise_count(v).sum(axis=0, dtype=np.int64)

    @classmethod
    def _codes(cls, title: str) -> np.ndarray:
        return (np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32) % cls.CLASSES).astype(np.int64)

    @staticmethod
    def _count(code: np.ndarray) -> np.ndarray:
        return np.bincount(code % 64, minlength=64).astype(np.uint32)


#: Titles of a block that one task compares with each other, and titles after them that one task compares with those.
HEAD, SLICE = 4096, 2048
_TITLES = "block long, n long, chunk long, id long, t string, at long, cluster long, placed boolean, first boolean"


def fuzzy_clusters(articles: DataFrame, least: float = 0.65, ttl_ms: int | None = None) -> DataFrame:
    """(id, cluster): articles (id, company, day, title) join the earliest registered title of their company and day with similarity `least`.

    In order of id within a block, or of `seen` (a time) and id where titles expire after ttl_ms; all articles that match
    none register. Titles under 10 characters stand alone. One block is one company's day.

    Equal titles are one. Of each block, HEAD titles at a time are placed in their order by a task; those that register go to
    tasks with SLICE of the block's later titles each, and what matches none of them is left for the next step. So each title
    meets the registered ones before it, up to the first similar one: comparisons grow with the square of a block's
    different titles, but a task holds HEAD and SLICE of them.
    """
    spark = articles.sparkSession
    at = F.lit(0).cast("long") if ttl_ms is None else F.unix_millis("seen")
    rows = articles.select(F.col("id").cast("long").alias("id"), "company", "day", normal_title(F.col("title")).alias("t"), at.alias("at"))
    keys = ["company", "day", "t"] if ttl_ms is None else ["company", "day", "t", "at", "id"]
    long = rows.where(F.char_length("t") >= 10)
    titles = long.groupBy(*keys).agg(F.min("at").alias("at"), F.min("id").alias("id")) if ttl_ms is None else long.distinct()
    titles = global_rank(titles, [F.col(n).asc() for n in ("company", "day", "at", "id", "t")], "n")
    top, paths, step = shared_folder(spark, "titles"), [], 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(df, name):
        df.write.parquet(f"{top}/{name}")
        return spark.read.parquet(f"{top}/{name}")

    first = titles.groupBy("company", "day").agg(F.min("n").alias("block")).withColumnsRenamed({"company": "__c", "day": "__d"})
    titles = titles.join(first, F.col("company").eqNullSafe(F.col("__c")) & F.col("day").eqNullSafe(F.col("__d"))).drop("__c", "__d")
    titles = written(titles.withColumn("chunk", F.floor((F.col("n") - F.col("block")) / HEAD).cast("long")), "all")
    todo = titles.select("block", "n", "chunk", "id", "t", "at")

    def place(head):
        head = head.sort_by("n")
        known, ids = Titles(least, None, ttl_ms), head["id"].to_pylist()
        found = [known.place(k, t, now) for k, (t, now) in enumerate(zip(head["t"].to_pylist(), head["at"].to_pylist(), strict=True))]
        return _with_clusters(head, [ids[k] for k in found], [True] * len(found), [k == j for j, k in enumerate(found)])

    def meet(rest, firsts):
        rest, known, ids = rest.drop_columns("slice"), Titles(least, None, ttl_ms), []
        if len(firsts):
            firsts = firsts.sort_by("__n")
            ids = firsts["__id"].to_pylist()
            known.load(firsts["__t"].to_pylist(), list(range(len(ids))), firsts["__at"].to_pylist())
        found = known.place_rest([-1] * len(rest), rest["t"].to_pylist(), rest["at"].to_pylist())
        return _with_clusters(rest, [ids[k] if k >= 0 else None for k in found], [k >= 0 for k in found], [False] * len(found))

    while True:
        head = written(todo.where(F.col("chunk") == step).repartition(parts, "block").groupBy("block").applyInArrow(place, _TITLES), f"head-{step}")
        paths.append(f"{top}/head-{step}")
        rest = todo.where(F.col("chunk") > step).withColumn("slice", F.floor(F.col("n") / SLICE).cast("long"))
        if rest.isEmpty():
            break
        firsts = head.where("first").select("block", "n", "id", "t", "at").join(rest.select("block", "slice").distinct(), "block")
        firsts = firsts.toDF(*(f"__{n}" for n in firsts.columns)).repartition(parts, "__block", "__slice").groupBy("__block", "__slice")
        rest = rest.repartition(parts, "block", "slice").groupBy("block", "slice")
        met = written(rest.cogroup(firsts).applyInArrow(meet, _TITLES), f"rest-{step}")
        paths.append(f"{top}/rest-{step}")
        todo = met.where("not placed").select(*todo.columns)
        step += 1
    clusters = spark.read.parquet(*paths).where("placed").select("n", "cluster")
    by = titles.join(clusters, "n").select(*(F.col(n).alias(f"__{n}") for n in keys), "cluster")
    same = functools.reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"__{n}")) for n in keys))
    alone = F.coalesce(F.char_length("t") < 10, F.lit(True))
    return rows.join(by, same, "left").select("id", F.when(alone, F.col("id")).otherwise(F.col("cluster")).alias("cluster"))


def _with_clusters(titles, clusters: list, placed: list[bool], first: list[bool]):
    import pyarrow as pa

    return titles.append_column("cluster", pa.array(clusters, pa.int64())).append_column("placed", pa.array(placed, pa.bool_())).append_column("first", pa.array(first, pa.bool_()))


def stories(articles: DataFrame) -> DataFrame:
    """Per cluster: sources, article count, first and last time, first title, majority label and mean confidence."""
    label = lambda x: F.count_if(F.col("label") == x)
    g = articles.groupBy("cluster").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("article_count"), F.min("published").alias("first_seen"), F.max("published").alias("last_updated"), F.min_by("title", F.struct("published", "id")).alias("title"),
        label("positive").alias("p"), label("negative").alias("n"), label("neutral").alias("u"), F.avg("score").alias("score"),
    )
    p, n, u = F.col("p"), F.col("n"), F.col("u")
    return g.select("cluster", "title", "sources", "article_count", "first_seen", "last_updated", F.when((p > n) & (p > u), "positive").when((n > p) & (n > u), "negative").otherwise("neutral").alias("label"), "score")


def search(articles: DataFrame, equal: dict[str, str] | None = None, pattern: dict[str, str] | None = None, since: tuple[str, str] | None = None, until: tuple[str, str] | None = None) -> DataFrame:
    """Articles for which every given condition holds: equality and patterns without regard to case, and limits of a time column."""
    keep: Column = F.lit(True)
    for c, v in (equal or {}).items():
        keep = keep & (F.lower(c) == v.lower())
    for c, v in (pattern or {}).items():
        keep = keep & F.col(c).rlike(f"(?i){v}")
    if since:
        keep = keep & (F.col(since[0]) >= since[1])
    if until:
        keep = keep & (F.col(until[0]) <= until[1])
    return articles.where(keep)


def feed_articles(feeds: DataFrame, since: Column, xml: str = "xml") -> DataFrame:
    """A row per item of the feeds published at or after `since`, with the feeds' other columns; items without a date stay."""
    rest = [n for n in feeds.columns if n != xml]
    rows = feeds.select(*rest, F.explode(rss_items(F.col(xml))).alias("__i"))
    return rows.where(F.col("__i.published").isNull() | (F.col("__i.published") >= since)).select(*rest, "__i.*")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, one a key: the latest by `order`, a new one before a stored one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, [key], [F.col(order).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def fuzzy_dimension(left: DataFrame, right: DataFrame, name: str, key: str) -> DataFrame:
    """left (name) with the right row (key, label) that its name fits best, by the first tier that has one, then the least key.

    1: one label holds the other; 2: two words of over two letters in common; 3: a code such as 11JN37 in common. Each tier
    is an equi-join: on the whole label's words and codes, so that no pairs are made beyond those that share one.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) > 2))
    code = lambda c: F.regexp_extract_all(F.upper(c), F.lit(r"\d{2}[A-Z]{2}\d{2}"), F.lit(0))
    l = left.select(name, F.explode(F.concat(words(F.col(name)), F.transform(code(F.col(name)), lambda x: F.concat(F.lit("#"), x)))).alias("w"))
    r = right.select(key, "label", F.explode(F.concat(words(F.col("label")), F.transform(code(F.col("label")), lambda x: F.concat(F.lit("#"), x)))).alias("w"))
    j = l.distinct().join(r.distinct(), "w").groupBy(name, key, "label").agg(F.count_if(~F.col("w").startswith("#")).alias("shared"), F.count_if(F.col("w").startswith("#")).alias("codes"))
    tier = F.when(F.lower("label").contains(F.lower(name)) | F.lower(name).contains(F.lower("label")), 1).when(F.col("shared") >= 2, 2).when(F.col("codes") > 0, 3)
    best = keep_latest(j.withColumn("tier", tier).where("tier is not null"), [name], [F.col("tier").asc(), F.col(key).asc()])
    return left.join(best.select(name, key, "tier"), name, "left")
