"""Quality rules with cross-document line frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def with_repeated_words(df: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """df with the number of words inside `window`-word runs that occur twice or more in the array `words`, first time included.

    Runs are told apart by a hash chained over their words. Only where some hash repeats are they sorted with their places,
    and the places of repeated ones, in order, each cover up to `window` new words. One projection for each step: an array
    that a lambda reads must be a column, or it would be computed again for each element.
    """
    w, h, p, t = F.col(words), F.col("__h"), F.col("__p"), F.col("__t")
    n = F.size(w)
    df = df.withColumn("__h", F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(window))))))
    df = df.withColumn("__p", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.get(p, k)["h"].eqNullSafe(x["h"])
    df = df.withColumn("__t", F.transform(p, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("covered"))
    places = F.sort_array(F.filter(t, lambda i: i.isNotNull()))
    covered = F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["covered"] + F.least(F.lit(window), i - acc["last"])).alias("covered")), lambda acc: acc["covered"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__p", "__t")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that depend on one text alone, and base_failed; null texts have no words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line),
    n_repeat_words (see with_repeated_words); base_failed is under 10 words, or over 20 of 100 words in repeated runs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    docs = docs.withColumns({"__words": words, "__lines": lines})
    docs = docs.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": _without(text, SPACES).cast("long"),
            "n_symbols": (F.char_length(text) - _without(text, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    docs = with_repeated_words(docs, "__words", "n_repeat_words").drop("__words", "__lines")
    return docs.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_docs: int = 20, max_share: float = 0.1, least_docs: int = 3, min_left: float = 0.3, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row of docs: doc_id, the base rules, and kept, the verdict after lines that many documents of a host share are removed.

    Lines are normalised (lower case, runs of digits to 0, runs of spaces to one) and hashed; lines without a word don't
    count. A line is removed if more than max_docs different documents of a host carry it, or, on a small host, more than
    max_share of its documents (of those with a line) and more than least_docs; a document of which less than min_left of
    its words' characters remain is depleted and not kept. Also returns n_frequent_lines and frequent_chars.
    Each document's different lines are counted once before any shuffle; the frequent ones are joined by a broadcast if
    they are few, and by a shuffle of the lines otherwise. A null host is a host; null texts are empty and fail the base
    rules; rows that repeat an id and text are judged alike and count as one document, and so do rows with one id in the
    counts of documents. Other columns, whatever their names, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    based = base_rules(rows)
    normal = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0"))
    lines = rows.select("doc_id", "host", "th", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select("doc_id", "host", "th", normal.alias("n"), _without(F.col("line"), SPACES).alias("chars")).where("chars > 0")
    lines = lines.groupBy("host", F.xxhash64("n").alias("h"), "doc_id", "th").agg(F.sum("chars").alias("chars"), F.count("*").alias("k"))
    lines = cut(lines)
    often = lines.select("host", "h", "doc_id").distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    small = lines.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") * max_share < max_docs)
    small = small.select(F.col("host").alias("__host"), (F.col("all") * max_share).alias("limit"))
    often = often.join(small, F.col("host").eqNullSafe(F.col("__host")), "left")
    frequent = cut(often.where(F.col("docs") > F.coalesce("limit", F.lit(max_docs))).select("host", "h"))
    few = frequent.limit(broadcast_rows + 1).count() <= broadcast_rows
    on = [lines["host"].eqNullSafe(frequent["host"]), lines["h"] == frequent["h"]]
    removed = lines.join(F.broadcast(frequent) if few else frequent, on, "left_semi")
    removed = removed.groupBy("doc_id", "th").agg(F.sum("chars").alias("frequent_chars"), F.sum("k").alias("n_frequent_lines"))
    on = [based["doc_id"].eqNullSafe(removed["doc_id"]), based["th"] == removed["th"]]
    out = based.drop("text").join(removed, on, "left").select(based["doc_id"], *("n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_frequent_lines", "frequent_chars")))
    left = F.col("word_chars") - F.col("frequent_chars") >= min_left * F.col("word_chars")
    return out.withColumn("kept", ~F.col("base_failed") & left)
