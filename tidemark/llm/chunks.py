"""Substring deduplication: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, keep, pieces

#: A boundary follows a byte at which the gear hash is the least of AROUND bytes to either side, and less than at the LEAST
#: bytes before it, so that boundaries depend on near bytes alone; a chunk of MOST bytes ends in any case. Chunks of prose
#: are longer than AROUND bytes, those of text that repeats itself longer than LEAST.
AROUND, LEAST, MOST = 48, 16, 1024
REACH = 32  # bytes that a 32-bit gear hash depends on
#: Repeated chunks are cut where neighbours of them make up so many bytes; single common phrases stay.
RUN = 64


def gear_table(seed: int = 9) -> np.ndarray:
    """One pseudo-random 32-bit number for each byte value."""
    import xxhash

    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed) for b in range(256)], np.uint32)


def gear_hashes(values: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i-1] + values[i] mod 2^32, by doubling: the hash of 2k bytes is that of k bytes plus the shifted one before."""
    h = values
    for k in (1, 2, 4, 8, 16):
        new = h.copy()
        new[k:] += h[:-k] << np.uint32(k)
        h = new
    return h


def _least_of_next(h: np.ndarray, n: int) -> np.ndarray:
    """The least of h[i : i + n] for each i, by doubling; places past the end count as the greatest number."""
    top = np.iinfo(h.dtype).max
    have, least = 1, h
    while 2 * have <= n:
        least = np.minimum(least, np.append(least[have:], np.full(min(have, len(least)), top, h.dtype)))
        have *= 2
    rest = n - have
    return np.minimum(least, np.append(least[rest:], np.full(min(rest, len(least)), top, h.dtype))) if rest else least


def boundaries(texts: list[bytes], table: np.ndarray, around: int = AROUND, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each text; the last is its length. An empty text has none."""
    gap = max(REACH, around)
    joined = np.frombuffer(b"".join([*(x for t in texts for x in (bytes(gap), t)), bytes(gap)]), np.uint8)
    values = table[joined]
    at = 0
    between = np.ones(len(joined), bool)
    for t in texts:
        values[at : at + gap] = 0  # nothing of the text before counts
        at += gap + len(t)
        between[at - len(t) : at] = False
    h = gear_hashes(values)
    h[between] = np.iinfo(np.uint32).max
    least = _least_of_next(h, around)
    is_end = ~between
    is_end[around:] &= h[around:] <= least[:-around]
    is_end[:-1] &= h[:-1] <= least[1:]
    is_end[LEAST:] &= h[LEAST:] < _least_of_next(h, LEAST)[:-LEAST]
    cuts = np.flatnonzero(is_end) + 1
    out, at = [], 0
    for t in texts:
        at += gap
        ends, last = [], 0
        low, high = np.searchsorted(cuts, (at + 1, at + len(t) + 1))
        for c in (*(cuts[low:high] - at).tolist(), len(t)):
            while c - last > most:
                last += most
                ends.append(last)
            if c > last:
                ends.append(c)
                last = c
        out.append(ends)
        at += len(t)
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, start, size, a, b) per chunk of the UTF-8 texts: th hashes the whole text, a and b are the 128-bit digest.

    Null and empty texts have no chunks; repeated rows give their chunks each; other columns are ignored.
    """

    def make(cols):
        import xxhash

        texts = [t or b"" for t in cols["text"].to_pylist()]
        table = gear_table()
        rows, starts, sizes, digests = [], [], [], []
        for k, (t, ends) in enumerate(zip(texts, boundaries(texts, table), strict=True)):
            rows.append(np.full(len(ends), k))
            begin = [0, *ends][: len(ends)]
            starts += begin
            sizes += [e - s for s, e in zip(begin, ends, strict=False)]
            digests += [xxhash.xxh3_128_digest(t[s:e]) for s, e in zip(begin, ends, strict=False)]
        pick = pa.array(np.concatenate(rows) if rows else [], pa.int64())
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return {"doc_id": cols["doc_id"].take(pick), "th": cols["th"].take(pick), "start": starts, "size": sizes, "a": pa.array(halves[:, 0]), "b": pa.array(halves[:, 1])}

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col).cast("binary")).alias("th"))
    return in_arrow(rows, make, "doc_id long, th long, start long, size int, a long, b long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """Per row of docs: doc_id, th (hash of its text), n_bytes, repeats: array<struct<start, size, doc_id>>, the chunks that stood before.

    A chunk is a repeat unless it is the first of its digest: the one with the least doc_id, then the least start. doc_id in
    the struct is the first one's. Repeats count where they and their neighbouring repeats make up `run` bytes or more. Boundaries depend on the last bytes alone, so an insertion changes the chunks around it
    and no others. Digests meet in an aggregation that keeps one row a digest and task, and only those with two places or
    more are joined back, in which Spark splits the rows of a digest that is very frequent. Null texts are empty; a null
    doc_id, or one that is no number, neither gives nor loses chunks; rows that repeat id and text have the same result and
    don't repeat each other. Other columns, whatever their names, are ignored.
    """
    found = keep(chunks(docs.where(F.col(id_col).try_cast("long").isNotNull()), id_col, text_col))
    first = found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    later = found.join(first, ["a", "b"]).where("doc_id != first_doc or start != first_start")
    later = later.dropDuplicates(["doc_id", "th", "start"])  # tasks merge repeated rows before they meet
    end = F.col("start") + F.col("size")
    before = Window.partitionBy("doc_id", "th").orderBy("start", "size")
    far = F.max(end).over(before.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("start") > F.coalesce(far, F.lit(-1)), 1).otherwise(0))
    later = later.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy("doc_id", "th", "run")
    later = later.withColumn("long", F.max(end).over(one) - F.min("start").over(one)).where(F.col("long") >= run)
    by = later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "size", F.col("first_doc").alias("doc_id")))).alias("repeats"))
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    none = F.expr("cast(array() as array<struct<start:bigint,size:int,doc_id:bigint>>)")
    return rows.join(by, ["doc_id", "th"], "left").select("doc_id", "th", "n_bytes", F.coalesce("repeats", none).alias("repeats"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated chunks cut out of the texts; bytes that no longer form a character become U+FFFD."""
    th = F.xxhash64(F.col(text_col).cast("binary"))
    found = repeated_chunks(docs, id_col, text_col).where("size(repeats) > 0")
    names, at = docs.columns, docs.columns.index(text_col)
    found = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__h"), F.col("repeats").alias("__repeats")).distinct()
    same = (F.col(id_col).try_cast("long") == F.col("__id")) & (th == F.col("__h"))
    wide = docs.join(found, same, "left").select(*(docs[n] for n in names), "__repeats")
    schema = ", ".join(f"`c{k}` {t}" for k, (_, t) in enumerate(docs.dtypes))

    def task(batches):
        for piece in (p for batch in batches for p in pieces(batch)):
            texts, cutouts = piece.column(at).to_pylist(), piece.column(len(names)).to_pylist()
            new = [t if t is None or not c else _without(t.encode(), c).decode(errors="replace") for t, c in zip(texts, cutouts, strict=True)]
            arrays = [*piece.columns[: len(names)]]
            arrays[at] = pa.array(new, piece.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(piece.schema)[: len(names)]))

    return wide.toDF(*(f"c{k}" for k in range(len(names) + 1))).mapInArrow(task, schema).toDF(*names)


def _without(data: bytes, repeats: list[dict]) -> bytes:
    out, end = [], 0
    for r in repeats:
        out.append(data[end : r["start"]])
        end = r["start"] + r["size"]
    return b"".join([*out, data[end:]])
