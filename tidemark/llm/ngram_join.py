"""Jaccard self-join of n-gram sets: prefixes under a global order bring sets together, tries of them decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, keep, pieces
from .components import components
from .shingles import SKETCH, sketch
from .simhash import fingerprints, links as near_fingerprints

SHINGLE, PERCENT, SEED = 5, 80, 42
#: Up to so many of the most common n-grams are put last in the global order. It bounds what the driver gets and tasks are sent
#: (16 bytes each); the order decides how many sets meet, never which of them link.
COMMON = 1 << 20
#: Node ids combined with these choose more pivots: the least of each.
MORE = tuple(0x5851F42D4C957F2D * k % (1 << 62) for k in range(1, 9))
#: Sets and n-grams of a trie, about.
SETS, GRAMS = 256, 1 << 21
#: Bytes of texts that are cut into words at a time: their words take about ten times that.
TEXTS = 1 << 20
#: Up to so many texts to compare, their ids are broadcast to find them; more are found by a shuffle of the texts.
BROADCAST = 500_000
LAST = np.uint64(1 << 63)


class Words(dict):
    """64-bit hashes of words, remembered until there are 200,000 of them."""

    def learn(self, words: set[bytes]) -> None:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self.update((w, xxhash.xxh64_intdigest(w, SEED)) for w in words.difference(self))


def windows(texts: list[bytes | None], words: Words, shingle: int = SHINGLE) -> list[np.ndarray]:
    """63-bit hashes of the word n-grams of each UTF-8 text, repeats included; a shorter text is one n-gram, none without words."""
    found = [(t or b"").lower().split() for t in texts]  # on bytes: lowers A-Z only, splits at the six ASCII spaces
    flat = list(chain.from_iterable(found))
    words.learn(set(flat))
    w = np.fromiter(map(words.__getitem__, flat), np.uint64, len(flat))
    full, out, at = _mixed(w, shingle), [], 0
    for n in map(len, found):
        out.append(full[at : at + n - shingle + 1] if n >= shingle else _mixed(w[at : at + n], n))
        at += n
    return out


def _mixed(w: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` neighbours in w."""
    n = max(0, len(w) - size + 1) if size else 0
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k : n + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(1)


def ngrams(texts: list[bytes | None], words: Words, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted different n-grams of each text."""
    return [np.unique(g) for g in windows(texts, words, shingle)]


def common_ngrams(docs: DataFrame, text_col: str = "text", most: int = COMMON, shingle: int = SHINGLE) -> np.ndarray:
    """Up to `most` n-grams that occur most often, the commonest last, by counts over all documents.

    A task counts an n-gram of a batch only if it meets it twice there; that may put a rare one in another's place. Where
    there are more than `most`, those from some count on are taken, by a tally of the counts' sizes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for piece in pieces(batch):
                grams, n = np.unique(np.concatenate([g for part in pieces(piece, TEXTS) for g in windows(part.column(0).to_pylist(), words, shingle)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1])], ["gram", "n"])

    counts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = keep(counts.withColumn("size", F.floor(8 * F.log2("n"))))
    least, left = None, most
    for size, n in sorted(map(tuple, counts.groupBy("size").count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = size
    top = counts.where(F.col("size") >= least if least is not None else F.lit(False)).select("gram", "n").toArrow()
    gram, n = (top.column(c).to_numpy() for c in ("gram", "n"))
    return gram[np.lexsort((-gram, n))].view(np.uint64)


class Order:
    """The global order of n-grams as keys: uncommon ones by their hash, then the common ones, the commonest last."""

    def __init__(self, common: np.ndarray):
        self.rank = np.argsort(common)
        self.common = common[self.rank]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Sorted keys of a set."""
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
            grams = np.sort(np.where(self.common[at] == grams, LAST | self.rank[at].astype(np.uint64), grams))
        return grams

    def first(self, grams: np.ndarray, most: int) -> np.ndarray:
        """The first `most` of a set's keys."""
        if not len(self.common):
            return grams[:most]
        some = grams[: 2 * most]
        uncommon = some[self.common[np.minimum(np.searchsorted(self.common, some), len(self.common) - 1)] != some]
        return uncommon[:most] if len(uncommon) >= most else self.keys(grams)[:most]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of a set of n in order, any set that is similar enough shares one of so many first members: it shares percent % of n at least."""
    return n - -(-percent * n // 100) + 1


def enough(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    """Whether sets of a and b members, `both` of them shared, have percent % of their union in common."""
    return (100 + percent) * both >= percent * (a + b)


def similar(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Places of the sets that share enough with the query. All are sorted keys; the sets are different from each other.

    The sets, sorted, are a trie: neighbours share a path as long as their common prefix. It is walked from the root, and the
    query's overlap with a path is counted once for all sets below it. A subtree goes when what its paths and the query
    still have to come can't bring the overlap that its smallest set needs.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].byteswap().tobytes())
    rows = [sets[k] for k in order]
    size = np.array([len(s) for s in rows])
    shared = np.zeros(len(rows), np.int64)  # with the row before
    for k in range(1, len(rows)):
        m = min(size[k - 1], size[k])
        differ = np.flatnonzero(rows[k - 1][:m] != rows[k][:m])
        shared[k] = differ[0] if len(differ) else m
    out, todo = [], [(0, len(rows), 0, 0)] if rows else []
    while todo:
        low, high, depth, both = todo.pop()
        left = len(query) - (np.searchsorted(query, rows[low][depth - 1], side="right") if depth else 0)
        best = both + min(int(size[low:high].max()) - depth, int(left))
        if not enough(best, len(query), int(size[low:high].min()), percent):
            continue
        down = int(shared[low + 1 : high].min()) if high - low > 1 else int(size[low])
        path = rows[low][depth:down]
        at = np.searchsorted(query, path)
        both += int(np.count_nonzero(query[np.minimum(at, len(query) - 1)] == path))
        if size[low] == down:  # a set ends here; it is the first of its subtree
            if enough(both, len(query), down, percent):
                out.append(order[low])
            if high - low == 1:
                continue
        forks = [low, *(low + 1 + np.flatnonzero(shared[low + 1 : high] == down)).tolist(), high]
        todo += [(a, b, down, both) for a, b in zip(forks, forks[1:], strict=False) if not (a == low and size[low] == down)]
    return out


def wide_sketch(grams: np.ndarray) -> bytes:
    """As `sketch`, with a power of two of bits, twice the set's size at least; of two sizes the larger folds into the smaller."""
    bits = max(64 * SKETCH, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ: never more than the n-grams that one of the sets has alone."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def sets(docs: DataFrame, order: Broadcast, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, node, n, sketch, wide, prefix): th hashes the text, node its set of n members; node is null without words."""
    import xxhash

    words = Words()

    def make(cols):
        out = {"node": [], "n": [], "sketch": [], "wide": [], "prefix": []}
        for grams in ngrams(cols["text"].to_pylist(), words, shingle):
            n = len(grams)
            out["node"].append(xxhash.xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63) if n else None)
            out["n"].append(n)
            out["sketch"].append(sketch(grams))
            out["wide"].append(wide_sketch(grams))
            out["prefix"].append(order.value.first(grams, prefix_length(n, percent) if n else 0).view(np.int64))
        return {"doc_id": cols["doc_id"], "th": cols["th"], **out}

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    return in_arrow(rows, make, "doc_id long, th long, node long, n int, sketch array<long>, wide binary, prefix array<long>", TEXTS)


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sets a and b can be similar enough by their sizes and sketches: bits that differ are members of one set alone."""
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(SKETCH)), F.lit(0))
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * low >= percent * high) & ((100 + percent) * apart <= (100 - percent) * (low + high))


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(u, v, n) of the pairs (u, v) of which the wide sketches allow the similarity; n is the size of v."""

    def close(cols):
        both = zip(*(cols[c].to_pylist() for c in ("a", "b", "m", "n")), strict=True)
        keep_ = pa.array([(100 + percent) * apart(a, b) <= (100 - percent) * (m + n) for a, b, m, n in both], pa.bool_())
        return {c: cols[c].filter(keep_) for c in ("u", "v", "n")}

    side = lambda c, wide, n: nodes.select(F.col("node").alias(c), F.col("wide").alias(wide), F.col("n").alias(n))
    return in_arrow(pairs.select("u", "v").join(side("u", "a", "m"), "u").join(side("v", "b", "n"), "v").select("u", "v", "n", "a", "b", "m"), close, "u long, v long, n int")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, order: Broadcast, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v, n), n the size of v, that are similar enough.

    The partners of one set are dealt over tries of bounded size, each of which comes to a task with that set as its query.
    Texts travel, which are smaller than their sets; the ids that say where a text goes are broadcast if they are few.
    """
    pairs = keep(pairs)
    parts = pairs.groupBy("u").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / GRAMS)).alias("parts"))
    dealt = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v")
    asked = parts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"))
    where = nodes.select("node", F.col("rep.doc_id").alias("__id"), F.col("rep.th").alias("__th"))
    dealt = keep(dealt.unionByName(asked).withColumn("node", F.coalesce("v", "u")).join(where, "node").drop("node"))
    few = F.broadcast(dealt) if dealt.limit(BROADCAST + 1).count() <= BROADCAST else dealt
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    texts = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(few, same).select("u", "part", "v", "text").dropDuplicates(["u", "part", "v"])
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key, query, names, members = Words(), None, None, [], []

        def close() -> pa.RecordBatch:
            hits = [names[k] for k in similar(query, members, percent)]
            return pa.RecordBatch.from_arrays([pa.array([key] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["u", "v"])

        for piece in (p for batch in batches for p in pieces(batch, TEXTS)):
            found = map(order.value.keys, ngrams(piece.column(3).to_pylist(), words, shingle))
            for u, v, keys in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), found, strict=True):
                if v is None:
                    if members:
                        yield close()
                    key, query, names, members = u, keys, [], []
                else:
                    names.append(v)
                    members.append(keys)
        if members:
            yield close()

    return keep(rows.mapInArrow(task, "u long, v long"))


def met(rows: DataFrame) -> DataFrame:
    """(gram, node, pivot, other): the sets of each n-gram that prefixes of different sets share, with the least and greatest of them.

    N-grams with the same sets are one: gram is a hash over those. An n-gram that is not among the common ones has fewer rows than the least of those, of which there are many, so it comes
    to one task; the common ones are combined before the shuffle and joined with their two pivots.
    """
    keyed = rows.select("node", F.explode("prefix").alias("gram"))
    one = Window.partitionBy("gram")
    mark = F.bit_xor(F.xxhash64("node"))
    rare = keyed.where("gram >= 0").withColumns({"pivot": F.min("node").over(one), "other": F.max("node").over(one), "mark": mark.over(one), "k": F.count("*").over(one)}).where("pivot != other")
    common = keyed.where("gram < 0").distinct()
    ends = common.groupBy("gram").agg(F.min("node").alias("pivot"), F.max("node").alias("other"), mark.alias("mark"), F.count("*").alias("k")).where("pivot != other")
    same = lambda df: df.select(F.xxhash64("mark", "k", "pivot", "other").alias("gram"), "node", "pivot", "other").distinct()
    return keep(same(rare).unionByName(same(common.join(ends, "gram"))))


def links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, order: Broadcast, id_col: str, text_col: str, shingle: int, percent: int, proposed: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) between sets that connect exactly what pairs that are similar enough connect.

    Pairs (u, v) of sets that are proposed are compared first; what they connect needs no further comparison.

    Similar sets share an n-gram of both prefixes. The sets of an n-gram are compared with its least and greatest, then,
    where some are still outside the least one's component, with eight others. What is outside after that is compared with
    all those of other components whose size and sketches allow it.
    """
    rest = (nodes, docs, order, id_col, text_col, shingle, percent)
    shared = met(rows)
    known = nodes.select("node", "n", "sketch")
    edges, roots = _starred(proposed, None, None, known, rest) if proposed is not None else (None, None)
    edges, roots = _starred(shared.select(F.explode(F.array("pivot", "other")).alias("u"), F.col("node").alias("v")), edges, roots, known, rest)
    mixed = _mixed_grams(shared, roots)
    ends = mixed.groupBy("gram").agg(F.array_distinct(F.array(*(F.min(F.col("node").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)) for c in MORE))).alias("ends"))
    edges, roots = _starred(mixed.join(ends, "gram").select(F.explode("ends").alias("u"), F.col("node").alias("v")), edges, roots, known, rest)
    mixed = _mixed_grams(mixed, roots)
    sizes = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).alias("class")
    members = keep(mixed.where("node != pivot and node != other").join(known, "node").select("gram", sizes, "node", "n", "sketch", "root", "to"))
    strays = members.where("root != to").withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))))
    first = (F.col("b.root") == F.col("b.to")) | (F.col("a.node") < F.col("b.node"))  # else the pair comes from the other side, too
    near = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.root") != F.col("b.root")) & first & _alike("a", "b", percent)
    more = strays.alias("a").join(members.alias("b"), near)
    more = keep(possible(more.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct(), nodes, percent))
    return edges if more.isEmpty() else edges.unionByName(verified(more, *rest))


def _rooted(df: DataFrame, roots: DataFrame, node: str, to: str) -> DataFrame:
    """df with the root of a column's nodes; a node without an edge is its own."""
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(to)), node, "left").withColumn(to, F.coalesce(to, node))


def _mixed_grams(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of n-grams of which some sets are outside the first pivot's component, with their roots and that component's (to)."""
    rooted = keep(_rooted(_rooted(shared.select("gram", "node", "pivot", "other"), roots, "node", "root"), roots, "pivot", "to"))
    return rooted.join(rooted.where("root != to").select("gram").distinct(), "gram")


def _starred(pairs: DataFrame, edges: DataFrame | None, roots: DataFrame | None, known: DataFrame, rest: tuple) -> tuple[DataFrame, DataFrame]:
    """(edges, roots) with those of the pairs (u, v) added that link two components: first one pair of each v, then what is left."""
    nodes, percent = rest[0], rest[-1]
    apart = lambda df, roots: df if roots is None else _rooted(_rooted(df, roots, "u", "x"), roots, "v", "y").where("x != y").drop("x", "y")
    pairs = pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = apart(pairs, roots)
    pairs = pairs.join(known.alias("a"), F.col("u") == F.col("a.node")).join(known.alias("b"), (F.col("v") == F.col("b.node")) & _alike("a", "b", percent))
    pairs = keep(possible(pairs, nodes, percent))
    if pairs.isEmpty() and edges is not None:
        return edges, roots
    found = verified(pairs.groupBy("v").agg(F.min("u").alias("u"), F.first("n").alias("n")).select("u", "v", "n"), *rest)
    edges = found if edges is None else edges.unionByName(found)
    roots = keep(components(edges))
    left = keep(apart(pairs, roots).select("u", "v", "n"))
    if not left.isEmpty():
        edges = edges.unionByName(verified(left, *rest))
        roots = keep(components(edges))
    return edges, roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: component_id is the least id reachable over links.

    Two texts link if percent % of the union of their different word n-grams is in both. A text of fewer words is one n-gram;
    null texts and texts without words link with nothing, not even each other, so theirs is their own id. Equal sets are one
    set from the start, however many rows have it. Repeated rows give repeated result rows; a null id, or one that is no
    number, is null and never the least one; other columns, whatever their names, are ignored. N-grams are told apart by
    63 bits of hash, sets by 64.
    """
    found, nodes, roots = _grouped(docs, id_col, text_col, shingle, percent, common, False)
    classes = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = keep(classes.join(least, "root").select("node", "component_id"))
    found = found.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")).join(classes, "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, common: int, by_fingerprint: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of `sets`, nodes, roots): the sets of the documents, the different ones, and the root of each in a component of several."""
    order = docs.sparkSession.sparkContext.broadcast(Order(common_ngrams(docs, text_col, common, shingle)))
    found = keep(sets(docs, order, id_col, text_col, shingle, percent))
    rows = found.where("node is not null")
    nodes = keep(rows.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")))
    proposed = fingerprint_pairs(nodes, docs, id_col, text_col, shingle) if by_fingerprint else None
    return found, nodes, components(links(rows, nodes, docs, order, id_col, text_col, shingle, percent, proposed))


def fingerprint_pairs(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Pairs (u, v) of sets whose texts' SimHash fingerprints link: of equal fingerprints all with the least set, which stands for it in links to others."""
    prints = fingerprints(docs, id_col, text_col, shingle).select(F.col("th").alias("__th"), "fp").distinct()
    prints = keep(nodes.select("node", F.col("rep.th").alias("__th")).join(prints, "__th").select("node", "fp"))
    heads = prints.groupBy("fp").agg(F.min("node").alias("head"))
    head = lambda fp, to: heads.select(F.col("fp").alias(fp), F.col("head").alias(to))
    near = near_fingerprints(prints).toDF("a", "b").join(head("a", "u"), "a").join(head("b", "v"), "b").select("u", "v")
    return prints.join(heads, "fp").select(F.col("head").alias("u"), F.col("node").alias("v")).where("u != v").unionByName(near)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """One row of docs for each component of near-duplicates: that with the least id; of several, the one whose text has the least hash.

    Covering hashing of SimHash fingerprints proposes pairs, the n-gram sets decide, and the join finds the links that
    fingerprints miss. Texts without words count as equal. A row with a null id stays only if its whole component has null
    ids. Rows that repeat id and text count as one.
    """
    found, _, roots = _grouped(docs, id_col, text_col, shingle, percent, common, True)
    rooted = found.select("doc_id", "th", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")).alias("k"))
    chosen = keep(chosen.select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th")))
    same = F.col(id_col).try_cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    kept = docs.join(chosen, same).dropDuplicates(["__id", "__th"])
    return kept.select(*(F.col(f"`{n}`") for n in docs.columns))
