"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, keep, keep_rows

#: Length of a q-gram, and the share of a unit's bytes that may be edited (substituted, inserted or deleted).
Q, EDITS = 8, 0.1
#: A long item is searched as overlapping units: a passage of WINDOW + STRIDE bytes of it holds a whole unit.
WINDOW, STRIDE = 120, 60
#: Items of under EXACT normalised bytes must match without edits at word borders; those under SHORTEST are no evidence,
#: as common phrases have that length (the given tables' items have 95 bytes or more).
EXACT, SHORTEST = 32, 16
#: Diagonals in a band, but for the overlap, as a power of two.
BAND = 4
#: Benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
BITS = 22
#: Postings looked up at once, and bytes of texts searched at once: a search of 512 KB of prose holds 29 MB, of 2 MB 111.
HITS, TEXTS = 1 << 19, 1 << 19


def normal(text: bytes) -> bytes:
    """A-Z lowered, each run of ASCII spaces one space, none at the ends."""
    return b" ".join(text.lower().split())


@dataclass(frozen=True)
class Units:
    """A block of benchmark units and the index of their q-grams."""

    texts: tuple[bytes, ...]
    items: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    unit_of: np.ndarray
    place_of: np.ndarray
    seen: np.ndarray


def units(rows: list[tuple[int, bytes]], shortest: int = SHORTEST) -> Units | None:
    """The units of (item_id, text) rows: normalised items, long ones in overlapping windows; under `shortest` bytes: none.

    An item of under EXACT bytes is a unit with a space on either side and no edits.
    """
    texts, items = [], []
    for item, text in sorted(rows):
        t = normal(text)
        if len(t) < max(shortest, Q - 2):
            continue
        if len(t) < EXACT:
            t = b" " + t + b" "
        starts = [0] if len(t) <= WINDOW + STRIDE else [*range(0, len(t) - WINDOW, STRIDE), len(t) - WINDOW]
        for s in starts:
            texts.append(t if len(starts) == 1 else t[s : s + WINDOW])
            items.append(item)
    if not texts:
        return None
    size = np.array([len(t) for t in texts])
    edits = np.minimum((EDITS * size).astype(int), (size - Q) // Q)  # so that at least one q-gram must be shared
    edits[[t.startswith(b" ") and t.endswith(b" ") and len(t) < EXACT + 2 for t in texts]] = 0
    grams, unit, place = [], [], []
    for u, t in enumerate(texts):
        g = grams_of(t)
        grams.append(g)
        unit.append(np.full(len(g), u))
        place.append(np.arange(len(g)))
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    different, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << BITS, bool)
    seen[_slot(different)] = True
    return Units(tuple(texts), np.array(items), edits, size - Q + 1 - Q * edits, different, np.append(first, len(every)), np.concatenate(unit)[order], np.concatenate(place)[order], seen)


def grams_of(text: bytes) -> np.ndarray:
    """Each Q bytes of text as one integer."""
    n = len(text) - Q + 1
    out = np.empty(max(0, n), np.uint64)
    for s in range(min(Q, max(0, n))):
        m = (n - s + Q - 1) // Q
        out[s::Q] = np.frombuffer(text, "<u8", m, s)
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def align(unit: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edits of the unit against any part of each region, within the regions' diagonals (columns - unit length + 1)."""
    m, n = len(unit), regions.shape[1]
    width = n - m + 1
    step = np.arange(width, dtype=np.int16)
    cost = np.zeros((len(regions), width), np.int16)
    for i in range(m):
        new = cost + (regions[:, i : i + width] != unit[i])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - step, axis=1) + step
    return cost.min(axis=1)


def search(texts: list[bytes], against: Units) -> list[tuple[int, int, int]]:
    """(text, unit, edits) of each unit that some part of a text matches within the unit's edit budget. Whole texts.

    Texts are joined by line feeds, which normalised texts don't have. A match with e edits shares len + 1 - Q - Q * e
    q-grams with its unit, on e + 1 diagonals (text place - unit place) at most; a band holds 2^BAND diagonals and the
    next e, so one band holds them all: a shared q-gram counts for its own band and for each lower one that reaches it.
    Bands that share as many are aligned, each within one text.
    """
    texts = [b" " + normal(t) + b" " for t in texts]
    joined = b"\n".join([b"", *texts, b""])
    ends = np.cumsum([len(t) + 1 for t in texts])  # place of the line feed after each text
    g = grams_of(joined)
    at = np.flatnonzero(against.seen[_slot(g)])
    g = g[at]
    k = np.minimum(np.searchsorted(against.grams, g), len(against.grams) - 1)
    hit = against.grams[k] == g
    at, k = at[hit], k[hit]
    many = against.first[k + 1] - against.first[k]
    if not many.sum():
        return []
    span = np.int64(len(joined) // (1 << BAND) + WINDOW)
    reach = -(-int(against.edits.max()) // (1 << BAND))
    counted = []
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // HITS, prepend=0, append=np.iinfo(np.int64).max))
    for low, high in zip([0, *cuts[:-1]], cuts, strict=True):  # bounded numbers of postings at once
        own = many[low:high]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        posting = np.repeat(against.first[k[low:high]], own) + inside
        unit = against.unit_of[posting]
        diagonal = np.repeat(at[low:high], own) - against.place_of[posting] + WINDOW + STRIDE
        band, off = diagonal >> BAND, diagonal & ((1 << BAND) - 1)
        keys = [unit * span + band]
        for lower in range(1, reach + 1):
            also = off + ((lower - 1) << BAND) < against.edits[unit]
            keys.append(unit[also] * span + band[also] - lower)
        counted.append(np.unique(np.concatenate(keys), return_counts=True))
    keys, back = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
    n = np.bincount(back, np.concatenate([c[1] for c in counted]))
    keys = keys[n >= against.least[keys // span]]
    found: dict[tuple[int, int], int] = {}
    buffer = np.frombuffer(joined, np.uint8)
    for u in np.unique(keys // span):
        bands = keys[keys // span == u] % span
        unit_text = np.frombuffer(against.texts[u], np.uint8)
        e, m = int(against.edits[u]), len(unit_text)
        start = (bands << BAND) - (WINDOW + STRIDE) - e
        n = m + (1 << BAND) + 3 * e
        place = start[:, None] + np.arange(n)
        region = np.where((place >= 0) & (place < len(buffer)), buffer[np.clip(place, 0, len(buffer) - 1)], 10)
        middle = start + n // 2
        owner = np.searchsorted(ends, np.clip(middle, 0, len(buffer) - 1))
        for shift in (-1, 0, 1):  # texts that a region may touch, each with the others blanked
            text = owner + shift
            valid = (text >= 0) & (text < len(texts))
            low = np.where(text > 0, ends[np.clip(text - 1, 0, len(ends) - 1)], 0)
            high = ends[np.clip(text, 0, len(ends) - 1)]
            own = (place > low[:, None]) & (place < high[:, None])
            valid &= own.sum(axis=1) >= m - e
            if not valid.any():
                continue
            least = align(unit_text, np.where(own[valid], region[valid], 10))
            for t, x in zip(text[valid], least, strict=True):
                if x <= e:
                    found[int(t), int(u)] = min(int(x), found.get((int(t), int(u)), e))
    return [(t, u, x) for (t, u), x in sorted(found.items())]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> Iterator[Units]:
    """The benchmark's units in blocks of about block_bytes of text, one at a time: the driver holds the block in use alone."""
    rows = benchmark.select(F.col(id_col).try_cast("long").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = math.ceil(total / block_bytes)
    if n > 1:
        rows = keep(rows.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartitionByRange("block"))
    else:
        rows = rows.distinct().withColumn("block", F.lit(0))
    for b in range(n):
        block = units([(r["item"], bytes(r["text"])) for r in rows.where(F.col("block") == b).toLocalIterator()], shortest)
        if block:
            yield block


def _searched(rows: DataFrame, block: Units, kind: str) -> DataFrame:
    """rows (doc_id, th, text) with items and edits in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def make(cols):
        items = [set() for _ in range(len(cols["doc_id"]))]
        edits = [None] * len(items)
        for t, u, x in search([t or b"" for t in cols["text"].to_pylist()], shared.value):
            items[t].add(int(shared.value.items[u]))
            edits[t] = x if edits[t] is None else min(x, edits[t])
        return {"doc_id": cols["doc_id"], "th": cols["th"], "items": [sorted(x) for x in items], "edits": edits}

    return in_arrow(rows, make, f"doc_id {kind}, th bigint, items array<bigint>, edits int", TEXTS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """Per row of docs: doc_id, items (ids of the benchmark items with a matching unit, in order) and edits (least of any match, else null).

    The benchmark is a query set, broadcast in bounded blocks. With one block the work is a narrow pass over the documents
    and nothing is shuffled. With more, each block's hits are written, so that one block is in memory at a time, and the
    hits of all blocks meet by id and text; documents without a hit are not part of that. Null and empty texts match
    nothing; repeated rows are judged alike; benchmark rows that are null or under `shortest` normalised bytes are no
    evidence. Other columns, whatever their names, are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found, held = [], None
    for block in blocks(benchmark, block_bytes=block_bytes, shortest=shortest):
        if held is not None:
            found.append(keep(_searched(rows, held, kind).where("edits is not null")))
        held = block
    if held is None:
        return rows.select("doc_id", F.expr("cast(array() as array<bigint>)").alias("items"), F.lit(None).cast("int").alias("edits"))
    last = _searched(rows, held, kind)
    if not found:
        return last.drop("th")
    hits = keep(last.where("edits is not null"))
    for more in found:
        hits = hits.unionByName(more)
    hits = hits.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.min("edits").alias("edits"))
    one, two = rows.drop("text").alias("a"), hits.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    return one.join(two, same, "left").select("a.doc_id", F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), "edits")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs that hold no benchmark unit, unchanged; with several blocks, what each leaves is written for the next."""
    held = None
    for block in blocks(benchmark, block_bytes=block_bytes, shortest=shortest):
        if held is not None:
            docs = keep(_without_hits(docs, held, text_col))
        held = block
    return docs if held is None else _without_hits(docs, held, text_col)


def _without_hits(docs: DataFrame, block: Units, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def judge(texts):
        bad = {t for t, _, _ in search(texts, shared.value)}
        return [t not in bad for t in range(len(texts))]

    return keep_rows(docs, text_col, judge, TEXTS)
