"""Near-duplicates by the Jaccard similarity of five-word shingles: MinHash bands propose pairs, the sets themselves decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, keep
from .components import components

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: A pair of similarity s shares one of BANDS keys of ROWS minima with probability 1 - (1 - s^ROWS)^BANDS: 0.99997 at 0.8.
BANDS, ROWS = 20, 4
#: Keys of up to this many different shingle sets are compared pair by pair; larger ones by way of a pivot.
PAIRWISE = 32
#: Longs of a sketch, 64 bits each.
SKETCH = 16


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of the word shingles of a UTF-8 text; a shorter text is one shingle, none without words."""
    import xxhash

    words = (text or b"").lower().split()  # on bytes: lowers A-Z only, splits at the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    whole = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in whole), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima of the hashes under fixed permutations."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    rng = np.random.default_rng(SEED)
    times, plus = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) for _ in range(2))
    times = times << np.uint64(1) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ plus) * times).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits: of each, whether an odd number of the hashes falls on it. Bits in which two sketches differ are
    shingles that one of the sets has alone, so there are no more of these bits than of such shingles."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, node, n, sketch, keys): th hashes the text, node its shingle set of n members."""
    import xxhash

    def make(cols):
        sets = [shingle_hashes(t) for t in cols["text"].to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "th": cols["th"], "node": pa.array(node), "n": [len(s) for s in sets], "sketch": [sketch(s).tolist() for s in sets], "keys": [band_keys(s).tolist() for s in sets]}

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    return in_arrow(rows, make, "doc_id long, th long, node long, n int, sketch array<long>, keys array<long>")


def similarities(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """(u, v, s): the Jaccard similarity of the shingle sets of each pair (u, v), from the texts themselves."""

    def hashed(cols):
        return {"node": cols["node"], "set": [shingle_hashes(t).tobytes() for t in cols["text"].to_pylist()]}

    def compare(cols):
        out = []
        for a, b in zip(cols["a"].to_pylist(), cols["b"].to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / max(1, len(a) + len(b) - both))
        return {"u": cols["u"], "v": cols["v"], "s": out}

    need = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node").select("node", F.col("th").alias("__th"))
    texts = docs.select(F.xxhash64(text_col).alias("__th"), F.col(text_col).cast("binary").alias("text")).join(need, "__th").dropDuplicates(["node"])
    sets = keep(in_arrow(texts.select("node", "text"), hashed, "node long, set binary"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return cut(in_arrow(both.select("u", "v", "a", "b"), compare, "u long, v long, s double"))


def links(docs: DataFrame, nodes: DataFrame, text_col: str = "text", least: float = LEAST, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (u, v) between shingle sets that connect what pairs of similarity `least` or more, meeting under a key, connect.

    Members of a large key are compared with its pivot. What stays outside the pivot's component is compared with every
    member of other components that it can be similar to: 1 - s is a metric, so their distances to the pivot differ by
    1 - least at most. Pairs are made where the sketches allow that similarity, which they always do if it holds; so a
    large group of texts that resemble each other somewhat makes few pairs.
    """
    keyed = nodes.select("node", "n", "sketch", F.posexplode("keys").alias("t", "key"))
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    keyed = cut(keyed.join(counts, ["t", "key"]))
    # sets of similarity s have (1 - s) / (1 + s) of their sizes' sum in one of them alone, and no more bits than that differ
    apart_bits = sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(SKETCH)), F.lit(0))
    near_size = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(least - 1e-9)
    near_size = near_size & (apart_bits <= (F.col("a.n") + F.col("b.n")) * F.lit((1 - least) / (1 + least) + 1e-9))
    same_key = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key"))
    small = keyed.where(F.col("size") <= pairwise)
    pairs = small.alias("a").join(small.alias("b"), same_key & (F.col("a.node") < F.col("b.node")) & near_size).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    hot = keyed.where(F.col("size") > pairwise)
    pivots = hot.where("node != pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    found = similarities(cut(pairs.unionByName(pivots).distinct()), docs, nodes, text_col)
    edges = found.where(F.col("s") >= least).select("u", "v")
    if hot.isEmpty():
        return edges
    roots = cut(components(edges))
    of_pivot = hot.select("pivot").distinct().join(roots, F.col("pivot") == F.col("node"), "left").select("pivot", F.coalesce("root", "pivot").alias("to"))
    members = hot.select("t", "key", "node", "n", "sketch", "pivot").join(roots, "node", "left").select("t", "key", "node", "n", "sketch", "pivot", F.coalesce("root", "node").alias("root"))
    far = found.select(F.col("u").alias("pivot"), F.col("v").alias("node"), (1 - F.col("s")).alias("d"))
    members = cut(members.join(of_pivot, "pivot").join(far, ["pivot", "node"], "left").withColumn("d", F.coalesce("d", F.lit(0.0))))
    apart = same_key & (F.col("a.root") != F.col("b.root")) & (F.col("b.node") != F.col("b.pivot")) & near_size & (F.abs(F.col("a.d") - F.col("b.d")) <= 1 - least + 1e-9)
    more = members.where("root != to").alias("a").join(members.alias("b"), apart)
    more = cut(more.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct())
    if more.isEmpty():
        return edges
    return edges.unionByName(similarities(more, docs, nodes, text_col).where(F.col("s") >= least).select("u", "v"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairwise: int = PAIRWISE) -> DataFrame:
    """One row of docs for each component of near-duplicates: that with the least id; of several, the one whose text has the least hash.

    Texts without words count as equal. A row with a null id stays only if its whole component has null ids. Rows that
    repeat id and text count as one.
    """
    rows = cut(prints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("node").agg(F.min("th").alias("th"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")))
    roots = components(links(docs, nodes, text_col, pairwise=pairwise))
    classes = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(classes.join(least, "root").select("node", "root", "component_id"))
    found = rows.select("doc_id", "th", "node").join(classes, "node").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("root").agg(F.min(F.struct("th", F.col("doc_id").alias("id"))).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"))
    same = F.col(id_col).try_cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    kept = docs.join(chosen, same).dropDuplicates(["__id", "__th"])
    return kept.select(*(F.col(f"`{n}`") for n in docs.columns))
