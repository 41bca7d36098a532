"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, uniform

#: Members of one fold; a level leaves one fractional member of each fold to the next.
FAN = 128
#: Equal rows made at once from their number.
BLOCK = 10_000
#: Up to so many sources are broadcast, a row each.
BROADCAST = 100_000


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, docs, target) from (source, size, and k: how many rows each row stands for): `share` of all sizes, dealt by weight, at most cap times a source's size.

    Sources in code-point order, null last, take the weights in turn. Resharing the excess over the caps by weight ends at
    target = min(cap * source_size, level * weight), and the level is the greatest (total - capped so far) / (weights left)
    over the sources in order of cap / weight. The windows run over one row per source.
    """
    k = F.col("k") if "k" in sized.columns else F.lit(1)
    by = sized.groupBy("source").agg(F.sum(F.col("size") * k).alias("source_size"), F.count("*").alias("docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn)).withColumn("most", cap * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return by.select("source", "source_size", "docs", F.least("most", F.col("level") * F.col("w")).alias("target"))


_MEMBERS = "array<struct<less:bigint,u:bigint,id:bigint,th:bigint,size:bigint,k:bigint,base:bigint,f:double>>"


def _fold(level: int) -> Column:
    """Of an array `m` of members the same members with all f but at most one, the last one's, integral.

    Two fractional members i, j with sizes a, b move to where size_i * f_i + size_j * f_j is the same and one of them is 0
    or 1: either i up or j up, with chances that leave both expectations as they were. Folds have about FAN members.
    """
    one, zero = F.lit(1.0), F.lit(0.0)

    def settle(acc: Column, y: Column) -> Column:
        x = acc["carry"]
        up = F.least(x["size"] * (1 - x["f"]), y["size"] * y["f"])
        down = F.least(x["size"] * x["f"], y["size"] * (1 - y["f"]))
        rise = uniform(F.lit(level), x["id"], y["id"], x["u"], y["u"]) * (up + down) < down
        move = F.when(rise, up).otherwise(-down)
        x_done = F.when(rise, x["size"] * (1 - x["f"]) <= y["size"] * y["f"]).otherwise(x["size"] * x["f"] <= y["size"] * (1 - y["f"]))
        end = F.when(rise, F.when(x_done, one).otherwise(zero)).otherwise(F.when(x_done, zero).otherwise(one))
        within = lambda f: F.greatest(zero, F.least(one, f))
        new_x, new_y = within(x["f"] + move / x["size"]), within(y["f"] - move / y["size"])
        done = F.when(x_done, x.withField("f", end)).otherwise(y.withField("f", end))
        left = F.when(x_done, y.withField("f", new_y)).otherwise(x.withField("f", new_x))
        whole = lambda z: (z["f"] <= 0) | (z["f"] >= 1)
        return F.when(x.isNull(), F.struct(y.alias("carry"), acc["out"].alias("out"))).when(
            whole(x), F.struct(y.alias("carry"), F.concat(acc["out"], F.array(x)).alias("out"))
        ).when(whole(y), F.struct(x.alias("carry"), F.concat(acc["out"], F.array(y)).alias("out"))).otherwise(
            F.struct(left.alias("carry"), F.concat(acc["out"], F.array(done)).alias("out"))
        )

    start = F.struct(F.lit(None).cast(_MEMBERS[6:-1]).alias("carry"), F.array().cast(_MEMBERS).alias("out"))
    return F.aggregate("m", start, settle, lambda a: F.concat(a["out"], F.array(a["carry"])))


def _closed(m: Column, seed: int) -> Column:
    """The members of a source's last fold with all f integral, and their sum as near the target as single steps bring it.

    The last member's fraction is rounded by chance. What this misses is then taken from, or given to, the others from the
    largest down, where that lessens it: in the end it is about half the smallest member.
    """
    last = F.element_at(m, -1)
    up = F.when(uniform(F.lit(seed), last["id"], last["u"]) < last["f"], 1.0).otherwise(0.0)
    others = F.array_sort(F.slice(m, 1, F.size(m) - 1))
    start = F.struct((last["size"] * (up - last["f"])).alias("miss"), F.array(last.withField("f", up)).cast(_MEMBERS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        less, more = (x["f"] >= 1) & (2 * acc["miss"] > x["size"]), (x["f"] <= 0) & (x["size"] > 0) & (-2 * acc["miss"] > x["size"])
        miss = acc["miss"] + F.when(less, -x["size"]).when(more, x["size"]).otherwise(0)
        f = F.when(less, 0.0).when(more, 1.0).otherwise(x["f"])
        return F.struct(miss.alias("miss"), F.concat(acc["out"], F.array(x.withField("f", f))).alias("out"))

    return F.aggregate(others, start, step, lambda a: a["out"])


def _members(rows: DataFrame, seed: int) -> DataFrame:
    """Equal rows as one member: each takes `base` copies, `more` of them one more, and at most one's chance f is left to round."""
    x = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns({"u": F.xxhash64(F.lit(seed), "id", "th", "size"), "base": F.floor(x).cast("long"), "f": x - F.floor(x)})
    return rows.withColumns({"more": F.floor(F.col("k") * F.col("f")).cast("long"), "f": F.when(F.col("f") > 0, F.col("k") * F.col("f") - F.floor(F.col("k") * F.col("f"))).otherwise(0.0)})


def shares(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 8, fan: int = FAN, text_col: str = "text") -> DataFrame:
    """(id, source, th, size, k, base, more, source_size, target): of the k rows with this id, source, text hash and size each
    is taken base times, and `more` of them once more.

    A document wants target / source_size copies. The whole part is certain; the fractions are rounded by pivoting inside
    folds of about `fan` members of one source, which keep the sum of size times fraction, and each fold hands its one
    fractional member to the next level, until a source is one fold. There the last fraction is rounded, and what it misses
    is made up for by other members of the fold. Equal rows are one member, so folds are hash groups of bounded expected
    size at every level, whatever repeats; a source of any size is many of them. Chances come from hashes of the seed, ids
    and texts: reruns agree.
    """
    size = n_words(F.col(text_col)) if size is None else size
    th = F.xxhash64(F.col(text_col)) if text_col in docs.columns else F.lit(0).cast("long")
    sized = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), th.alias("th"), size.alias("size"))
    sized = cut(sized.groupBy("id", "source", "th", "size").agg(F.count("*").alias("k")))
    by = cut(targets(sized, weights, share, cap))
    sources, most = by.agg(F.count("*"), F.max("docs")).head()
    levels = 1
    while fan**levels < (most or 0):
        levels += 1
    few = F.broadcast(by) if sources <= BROADCAST else by
    facts = cut(_members(sized.join(few, sized["source"].eqNullSafe(by["source"])).drop(by["source"]), seed))
    rows = facts.where("f > 0").select("source", "docs", "u", "id", "th", "size", "k", "base", "f")
    done = []
    for level in range(levels):
        folds = F.ceil(F.col("docs") / F.lit(float(fan) ** (level + 1))).cast("long")
        member = F.struct((-F.col("size")).alias("less"), "u", "id", "th", "size", "k", "base", "f")
        grouped = rows.groupBy("source", "docs", folds.alias("folds"), F.pmod(F.xxhash64(F.lit(level), "u"), folds).alias("fold")).agg(F.array_sort(F.collect_list(member)).alias("m"))
        grouped = grouped.select("source", "docs", "folds", _fold(level).alias("m"))
        grouped = grouped.select("source", "docs", "folds", F.when(F.col("folds") == 1, _closed(F.col("m"), seed)).otherwise(F.col("m")).alias("m"))
        out = cut(grouped.select("source", "docs", F.explode("m").alias("d")).select("source", "docs", "d.*").drop("less"))
        rows = out.where("f > 0 and f < 1")
        done.append(out.where("f >= 1"))
    up = done[0]
    for each in done[1:]:
        up = up.unionByName(each)
    up = up.select(F.col("u").alias("__u"), F.col("source").alias("__source"), F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("size").alias("__size"))
    on = (F.col("u") == F.col("__u")) & F.col("id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("th") == F.col("__th")) & (F.col("size") == F.col("__size"))
    more = (F.col("more") + F.when(F.col("__u").isNotNull(), 1).otherwise(0)).alias("more")
    return facts.join(up, on, "left").select("id", "source", "th", "size", "k", "base", more, "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 8, fan: int = FAN, text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row; copies is the whole number of times the mix takes it.

    See `shares`. Null texts and ids, a null source (a source of its own) and size 0 (no copies) are fine; of several rows
    that repeat id, source and text some may have one copy more than the others. Other columns, whatever their names, are
    ignored; an id that is no number is null.
    """
    found = shares(docs, id_col, source_col, size, weights, share, cap, seed, fan, text_col)
    # one row for each equal one, by blocks, so that no array is longer than BLOCK
    found = found.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(BLOCK).cast("long"))))
    found = found.withColumn("at", F.explode(F.sequence("at", F.least(F.col("k"), F.col("at") + BLOCK) - 1)))
    copies = F.col("base") + F.when(F.col("at") < F.col("more"), 1).otherwise(0)
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"))
