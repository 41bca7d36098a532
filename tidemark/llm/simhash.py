"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Buckets of up to this many different fingerprints are compared pair by pair inside one task; larger ones by balls.
PAIRWISE = 512


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks of which at least one keeps two fingerprints equal whenever they differ in `radius` bits or fewer.

    Bit i gets a non-zero vector m(i) of radius+1 bits; the mask of a non-zero vector v keeps the bits with odd <v, m(i)>.
    `radius` differing bits give `radius` equations <v, m(i)> = 0 in radius+1 unknowns, so some v masks all of them out.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin(v & (i % n + 1)).count("1") % 2) for v in range(1, n + 1)]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    import xxhash

    words = (text or b"").lower().split()  # on bytes: lowers A-Z only, splits at the six ASCII spaces
    if not words:
        return 0
    whole = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    total, step = max(1, len(words) - shingle + 1), 1 << 14
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in whole), np.uint64, total)
    set_ = np.zeros(BITS, np.int64)
    for at in range(0, total, step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_ > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): th hashes the text, fp is the fingerprint's 64 bits as a signed long. Null texts have no words."""

    def make(cols):
        prints = np.array([fingerprint(t, shingle) for t in cols["text"].to_pylist()], np.uint64)
        return {"doc_id": cols["doc_id"], "th": cols["th"], "fp": pa.array(prints.view(np.int64))}

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    return in_arrow(rows, make, "doc_id long, th long, fp long")


def links(prints: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (u, v) between fingerprints that connect exactly what links at `radius` or fewer differing bits connect.

    Only different fingerprints are keyed. Buckets of bounded size are compared in one task, which emits a spanning forest.
    In larger ones each fingerprint flips up to (radius+1)//2 and radius//2 of the bits its mask hides: two fingerprints
    link exactly when one's outer ball meets the other's inner one. All that share such a point with a centre in the inner
    ball are joined to it, which needs rows in proportion to the fingerprints however dense the bucket is.
    """
    masks = covering_masks(radius)
    table = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks))))
    keyed = prints.select("fp").distinct().select("fp", table.alias("k")).select("fp", "k.t", "k.key")
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(counts, ["t", "key"]))
    small = keyed.where(F.col("n") <= pairwise).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def forest(cols):
        us, vs = [], []
        for fps in cols["fps"].to_pylist():
            a = np.array(sorted(fps), np.int64)
            near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= radius
            rest = np.ones(len(a), bool)
            for i in range(len(a)):
                if rest[i]:
                    rest[i], front = False, [i]
                    while front:
                        j = front.pop()
                        for k in np.flatnonzero(near[j] & rest):
                            rest[k] = False
                            us.append(int(a[j]))
                            vs.append(int(a[k]))
                            front.append(int(k))
        return {"u": us, "v": vs}

    hidden = [[i for i in range(BITS) if not m >> i & 1] for m in masks]
    outer, inner = (radius + 1) // 2, radius // 2

    def balls(cols):
        out = {"t": [], "point": [], "fp": [], "inner": []}
        t_of, fp_of = cols["t"].to_numpy(zero_copy_only=False), cols["fp"].to_numpy(zero_copy_only=False)
        for t in np.unique(t_of):
            flips = [(0, 0)]
            for size in range(1, outer + 1):
                flips += [(d | 1 << b, size) for d, s in list(flips) if s == size - 1 for b in hidden[t] if d >> b == 0]
            deltas = np.array([d for d, _ in flips], np.uint64).view(np.int64)
            near = np.array([s <= inner for _, s in flips])
            fps = fp_of[t_of == t]
            out["t"].append(np.full(len(fps) * len(deltas), t, np.int32))
            out["point"].append((fps[:, None] ^ deltas[None, :]).ravel())
            out["fp"].append(np.repeat(fps, len(deltas)))
            out["inner"].append(np.tile(near, len(fps)))
        return {k: pa.array(np.concatenate(v)) for k, v in out.items()}

    hot = keyed.where(F.col("n") > pairwise).select("t", "fp")
    met = in_arrow(hot, balls, "t int, point long, fp long, inner boolean").groupBy("t", "point")
    met = met.agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("fps")).where("u is not null and size(fps) > 1")
    stars = met.select("u", F.explode("fps").alias("v")).where("u != v")
    return in_arrow(small, forest, "u long, v long").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the least id reachable over links between fingerprints.

    Null and empty texts have fingerprint 0 and link like others. Repeated rows give repeated result rows. A null id, or one
    that is no number, is null and never the least one: a component of null ids alone has a null component_id. Other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, radius, pairwise).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, th, fp, root, component_id) per row; root is one of the component's fingerprints."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints, radius, pairwise))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(nodes.join(least, "root").select("fp", "root", "component_id"))
    return prints.join(classes, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of near-duplicates: that with the least id; of several, the one whose text has the least hash.

    A row with a null id stays only if its whole component has null ids. Rows that repeat id and text count as one.
    """
    found = _grouped(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("root").agg(F.min(F.struct("th", F.col("doc_id").alias("id"))).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"))
    same = F.col(id_col).try_cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    kept = docs.join(keep, same).dropDuplicates(["__id", "__th"])
    return kept.select(*(F.col(f"`{n}`") for n in docs.columns))


def hex64(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
