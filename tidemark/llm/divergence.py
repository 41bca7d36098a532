"""Divergence of sources from each other and from their language: joint histograms of term counts."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, pieces

# Fixed by the operator's contract: bytes of terms (letters and what is not ASCII), A-Z lower-cased, all others a space.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Different terms that a task counts before it hands its counts on.
ENTRIES = 500_000


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", entries: int = ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group; a row with an empty term for every group.

    Tasks count before the shuffle, so a group or a term that most rows hold costs a row a task. Rows are dealt by language
    and term, which also serves those who group by these two.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in counts.items():
                n[b""] = in_docs[b""] = 0
                batch = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array(list(map(in_docs.__getitem__, n)), pa.int64())]
                yield pa.RecordBatch.from_arrays(batch, ["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in batches:
            for piece in pieces(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    n, in_docs = counts[lang, source]
                    terms = text.translate(TERM).split()
                    n.update(terms)
                    in_docs.update(set(terms))
                if sum(len(n) for n, _ in counts.values()) > entries:
                    yield from rows()
        yield from rows()

    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(task, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), in whole numbers of up to 38 digits."""
    above = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", above, (n + SMOOTH * v).cast("decimal(20,0)"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of docs.

    A language keeps the terms of `least_docs` or more of its rows. Part `pair`: for each other source of the language the sum
    of abs(p - q) over the kept terms, by joint_counts; part `term`: the `top` kept terms of the group whose share exceeds the
    language's most, by p - q. Nulls in the three columns are ''; each row is a document, repeated or not; a group
    without kept terms has shares from zero counts, and a language without kept terms pairs of value 0 and no term rows. An
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    counts = term_counts(docs, lang_col, source_col, text_col).withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term")))
    counts = counts.where((F.col("all") >= least_docs) | (F.col("term") == ""))
    kept = keep(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells")))
    terms = kept.where("term != ''")
    cells = terms.select("lang", "term", "total", F.explode("cells").alias("x")).select("lang", "x.source", "term", "total", F.col("x.n").alias("c"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = kept.where("term = ''").select("lang", F.explode("cells.source").alias("source"))
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")))
    groups = keep(groups)
    named = cells.join(groups, ["lang", "source"])
    above = share(F.col("c"), F.col("n"), F.col("v")) - share(F.col("total"), F.col("lang_n"), F.col("v"))
    named = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where("value > 0")
    pairs = groups.alias("a").join(groups.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    pairs = keep(pairs.select("a.lang", F.col("a.source").alias("s"), F.col("b.source").alias("o"), F.col("a.n").alias("s_n"), F.col("b.n").alias("o_n"), "a.v"))
    f = F.abs(share(F.col("c"), F.col("s_n"), F.col("v")) - share(F.col("d"), F.col("o_n"), F.col("v")))
    apart = joint_counts(terms, cells, pairs).join(pairs, ["lang", "s", "o"]).groupBy("lang", "s", "o").agg(F.sum(f * F.col("m")).alias("value"))
    apart = pairs.select("lang", "s", "o").join(apart, ["lang", "s", "o"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ways = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("o").alias("item")), F.struct(F.col("o").alias("source"), F.col("s").alias("item"))))
    apart = apart.select("lang", "value", ways.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(apart.withColumn("rank", F.row_number().over(order)))


def joint_counts(terms: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, s, o, c, d, m): m kept terms of the language occur c times in source s and d times in source o, zeros included.

    Only cells that both sources fill are met term by term, from the term's own row. What one source fills alone is its
    histogram less what it fills with the other; the rest of the language's terms are the cell (0, 0). All parts are
    signed tallies of one aggregate, so each combination ends as one row.
    """
    first = terms.select("lang", "cells", F.posexplode("cells").alias("i", "x"))
    both = first.select("lang", "x", F.explode(F.expr("slice(cells, i + 2, size(cells))")).alias("y"))
    met = both.groupBy("lang", F.col("x.source").alias("s"), F.col("y.source").alias("o"), F.col("x.n").alias("c"), F.col("y.n").alias("d")).agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    tally = lambda c, d, m: F.struct(c.alias("c"), d.alias("d"), m.alias("m"))
    c, d, m, h = (F.col(x) for x in ("c", "d", "m", "h"))
    met = met.select("lang", "s", "o", F.inline(F.array(tally(c, d, m), tally(c, zero, -m), tally(zero, d, -m), tally(zero, zero, m))))
    alone = cells.groupBy("lang", "source", "c").agg(F.count("*").alias("h"))
    left = pairs.select("lang", "s", "o").join(alone.withColumnRenamed("source", "s"), ["lang", "s"]).select("lang", "s", "o", F.inline(F.array(tally(c, zero, h), tally(zero, zero, -h))))
    right = pairs.select("lang", "s", "o").join(alone.withColumnRenamed("source", "o"), ["lang", "o"]).select("lang", "s", "o", F.inline(F.array(tally(zero, c, h), tally(zero, zero, -h))))
    none = pairs.select("lang", "s", "o", zero.alias("c"), zero.alias("d"), F.col("v").alias("m"))
    return met.unionByName(left).unionByName(right).unionByName(none).groupBy("lang", "s", "o", "c", "d").agg(F.sum("m").alias("m")).where("m > 0")
