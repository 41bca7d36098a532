"""Cross-document substring deduplication by suffix arrays, spread over tasks by shared anchors.

Every string of LENGTH bytes has an anchor: the q-gram in it with the least hash, so equal strings have equal anchors at equal
places. The starts of a document that share an anchor form an interval; the bytes that their strings cover are the anchor's
context. Anchors that only one text has are settled by counting. The contexts of the others meet by anchor, and the suffix
array of each anchor's contexts, made by linear grouping, brings equal strings together. Equal texts count as one from the
start. Work goes in pieces of texts and in buckets of anchors, both of bounded expected size however large the input is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep
from .lyndon import suffix_arrays

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a piece of texts and in a bucket of anchors, as expected.
PIECE, BUCKET = 4 << 20, 16 << 20
#: An anchor of more occurrences is hot: each of its strings is a context of its own, by its own hash, once for a piece.
HOT = 4096
#: Suffix arrays are made at once for CELLS bytes of contexts, which a cache holds, or more, so that TEXTS anchors share a step.
CELLS, TEXTS, MOST_CELLS = 1 << 18, 1 << 10, 1 << 21
#: Buckets beyond this number share tasks.
MOST_TASKS = 20_000
#: Strings by the place of their anchor, (least, most), and the bytes that all of these hold before and after the anchor.
CLASSES = tuple((low, high, low, LENGTH - GRAM - high) for low, high in ((0, 10), (11, 19), (20, 30)))


def anchors(text: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, place, hash) of each anchor in the documents text[begin : begin + size]: first and last start, place and hash of its q-gram.

    The text is padded by 8 bytes or more. Anchors rise by place; documents shorter than LENGTH have none.
    """
    n = len(text) - LENGTH - 7
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    valid = np.zeros(n + 1, np.int8)
    long = size >= LENGTH
    np.add.at(valid, begin[long], 1)
    np.add.at(valid, begin[long] + size[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:n], dtype=np.int8).view(bool)
    least, hashes = np.empty(n, np.int64), []
    for at in range(0, n, step):
        m = min(step, n - at)
        h = _hashes(text[at : at + m + LENGTH + 7], m + SPAN - 1)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while 2 * have <= SPAN:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        key = np.minimum(key[: m], key[SPAN - have : SPAN - have + m])
        least[at : at + m] = (key & np.uint64(0xFFFFFFFF)).view(np.int64) + at
        hashes.append(h[:m] if at + m < n else h)
    starts = np.flatnonzero(valid)
    place = least[starts]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    low = starts[new]
    high = starts[np.append(new[1:], len(starts)) - 1] if len(starts) else low
    place = place[new]
    return low, high, place, mixed(np.concatenate(hashes)[place])


def mixed(h: np.ndarray) -> np.ndarray:
    """Least hashes are small; mixed once more, they spread evenly."""
    h = h * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(35)
    return h * np.uint64(0x9E3779B97F4A7C15)


def _hash_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The q-gram's hash at each place, as `_hashes` gives it at all."""
    words = _words(text)
    return _hash_of(words[at], words[at + 8], words[at + GRAM - 8])


def _hashes(text: np.ndarray, n: int) -> np.ndarray:
    eight = np.empty(n + GRAM - 8, np.uint64)
    raw = np.ascontiguousarray(text)
    for s in range(8):
        part = eight[s::8]
        part[:] = np.frombuffer(raw.data, "<u8", len(part), s)
    return _hash_of(eight[:n], eight[8 : 8 + n], eight[GRAM - 8 : GRAM - 8 + n])


def _hash_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += c * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """0 to buckets - 1, rising with the unsigned hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] of them, for each k in turn."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


#: A piece: its texts' hashes, least ids, numbers of rows with that id, sizes and bytes; its anchors' numbers of starts and
#: places; and its different anchors by bucket, each with its number of occurrences (65,535: or more) and a bit: in two texts.
_PIECES = "piece bigint, th array<string>, least binary, k binary, size binary, text binary, starts binary, places binary, counts array<struct<bucket:bigint,h:binary,n:binary,m:binary>>"
_SHARED = "piece bigint, bucket bigint, shared binary, hot binary"
_CONTEXTS = "piece bigint, bucket bigint, h binary, least binary, at binary, size binary, anchor binary, text binary"
_EQUAL = "piece bigint, first binary, last binary, at binary, low binary"
_RESULT = "doc_id bigint, th string, k bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"


def _rows_of(schema: str) -> Callable[[list[dict]], pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return lambda rows: pa.RecordBatch.from_pylist(rows, schema=arrow)


def _mapped(df: DataFrame, make: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """The rows that `make` gives for each row of df; a row is a piece or a bucket, so it is large."""
    of = _rows_of(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if made := make(batch.slice(k, 1).to_pylist()[0]):
                    yield of(made)

    return df.mapInArrow(task, schema)


def pieces_of(texts: DataFrame, piece: int, buckets: int) -> DataFrame:
    """Pieces of about `piece` bytes, or of one longer text, of the rows (th, least, k, text), as they come."""
    of = _rows_of(_PIECES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("th", "least", "k", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= piece:
                    yield of([_piece(number, held, buckets)])
                    number, held, size = number + 1, [], 0
        if held:
            yield of([_piece(number, held, buckets)])

    return texts.select("th", "least", "k", "text").mapInArrow(task, _PIECES)


def _piece(number: int, rows: list[tuple], buckets: int) -> dict:
    ths, least, k, texts = zip(*rows, strict=True)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    low, high, place, h = anchors(text, begin, size)
    doc = np.searchsorted(begin, low, side="right") - 1
    order = np.argsort(h, kind="stable")
    first = _runs(h[order])
    new = np.append(True, np.diff(doc[order]) != 0)[: len(h)]
    new[first] = True
    several = np.add.reduceat(new.astype(np.int64), first) > 1 if len(h) else new
    n = np.minimum(np.diff(np.append(first, len(h))), 65535).astype(np.uint16)
    different = h[order][first]
    bucket = bucket_of(different, buckets)
    counts = []
    for s, e in _pairs(_runs(bucket), len(bucket)):
        counts.append({"bucket": int(bucket[s]), "h": (different[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), "n": n[s:e].tobytes(), "m": np.packbits(several[s:e]).tobytes()})
    return {
        "piece": number, "th": list(ths), "least": _pack(np.array(least, np.int64)), "k": _pack(np.array(k, np.int64)), "size": _pack(size), "text": _pack(text[:-8]),
        "starts": _pack((high - low + 1).astype(np.uint8)), "places": _pack((place - low).astype(np.uint8)), "counts": counts,
    }


def _pairs(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)) if len(starts) else []


class _Piece:
    """A piece read back: text (padded), begin, size and least ids of its texts, and low, high, place, h and text of its anchors."""

    def __init__(self, row: dict) -> None:
        self.size, self.least = _unpack(row["size"], np.int64), _unpack(row["least"], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.text = np.append(_unpack(row["text"], np.uint8), np.zeros(64, np.uint8))
        if "starts" in row:
            starts = _unpack(row["starts"], np.uint8).astype(np.int64)
            valid = np.maximum(self.size - LENGTH + 1, 0)  # starts of each text, one after another
            before = np.cumsum(starts) - starts
            self.doc = np.searchsorted(np.cumsum(valid), before, side="right")
            self.low = before - (np.cumsum(valid) - valid)[self.doc] + self.begin[self.doc]
            self.high = self.low + starts - 1
            self.place = self.low + _unpack(row["places"], np.uint8)
            self.h = mixed(_hash_at(self.text, self.place))


def shared_anchors(parts: list[dict], hot: int) -> list[tuple[bytes, bytes]]:
    """Of one bucket, for each part of a piece: bits of its anchors in order that two texts or more have, and of the hot ones."""
    hs = [np.frombuffer(x["h"], np.uint32) for x in parts]
    n = np.frombuffer(b"".join(x["n"] for x in parts), np.uint16).astype(np.int64)
    several = np.concatenate([np.unpackbits(np.frombuffer(x["m"], np.uint8), count=len(h)) for x, h in zip(parts, hs, strict=True)])
    _, back, pieces = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
    shared = ((pieces > 1) | (np.bincount(back, several) > 0))[back]
    is_hot = (np.bincount(back, n) > hot)[back]
    ends = np.cumsum([len(x) for x in hs])
    return [(np.packbits(shared[e - len(x) : e]).tobytes(), np.packbits(is_hot[e - len(x) : e]).tobytes()) for x, e in zip(hs, ends, strict=True)]


def contexts(row: dict, buckets: int) -> list[dict]:
    """Of one piece with the marks of its anchors: the contexts of shared anchors, and the different strings of hot ones, by bucket."""
    piece = _Piece(row)
    order = np.argsort(piece.h, kind="stable")
    first = _runs(piece.h[order])
    different = piece.h[order][first]
    bucket = bucket_of(different, buckets)
    is_shared, is_hot = np.zeros(len(different), bool), np.zeros(len(different), bool)
    for mark in row["marks"]:
        s, e = np.searchsorted(bucket, (mark["bucket"], mark["bucket"] + 1))
        is_shared[s:e], is_hot[s:e] = (np.unpackbits(np.frombuffer(mark[n], np.uint8), count=e - s) for n in ("shared", "hot"))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    take = np.flatnonzero(is_shared[which])
    hot = is_hot[which[take]]
    cold, hot = take[~hot], take[hot]
    at, h, size = piece.low[cold], piece.h[cold], piece.high[cold] - piece.low[cold] + LENGTH
    least, anchor = piece.least[piece.doc[cold]], piece.place[cold] - piece.low[cold]
    starts, one, low = hot_strings(piece, hot)
    if len(starts):
        at, h = np.append(at, starts[one]), np.append(h, string_hash(piece.text, starts[one]))
        size, least, anchor = np.append(size, np.full(len(one), LENGTH)), np.append(least, low), np.append(anchor, np.full(len(one), 255))
    order = np.argsort(h, kind="stable")
    at, h, size, least, anchor = at[order], h[order], size[order], least[order], anchor[order]
    to = bucket_of(h, buckets)
    rows = []
    for s, e in _pairs(_runs(to), len(to)):
        text = piece.text[_spread(at[s:e], size[s:e])]
        rows.append({
            "piece": row["piece"], "bucket": int(to[s]), "h": _pack(h[s:e]), "least": _pack(least[s:e]), "at": _pack(at[s:e]),
            "size": _pack(size[s:e].astype(np.uint8)), "anchor": _pack(anchor[s:e].astype(np.uint8)), "text": _pack(text),
        })
    return rows


def hot_strings(piece: _Piece, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, one, low) of the strings of hot anchors: starts sorted by string, the first of each different one, and its least id."""
    starts = _spread(piece.low[hot], piece.high[hot] - piece.low[hot] + 1)
    if not len(starts):
        return starts, starts, starts
    h = string_hash(piece.text, starts)
    order = np.argsort(h, kind="stable")
    starts, h = starts[order], h[order]
    for s, e in _pairs(_runs(h), len(h)):  # strings of one hash that differ are put in order
        if e - s > 1 and not _same(piece.text, starts[s : e - 1], starts[s + 1 : e]).all():
            starts[s:e] = sorted(starts[s:e].tolist(), key=lambda x: piece.text[x : x + LENGTH].tobytes())
    one = np.flatnonzero(np.append(True, ~_same(piece.text, starts[1:], starts[:-1])))
    ids = piece.least[np.searchsorted(piece.begin, starts, side="right") - 1]
    return starts, one, np.minimum.reduceat(ids, one)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the text on, as one number."""
    return np.ndarray(len(text) - 7, "<u8", np.ascontiguousarray(text), 0, (1,))


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the strings from the places a and b on are equal."""
    words, same = _words(text), np.ones(len(a), bool)
    left = np.arange(len(a))
    for s in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        equal = words[a[left] + s] == words[b[left] + s]
        same[left[~equal]] = False
        left = left[equal]
    return same


def string_hash(text: np.ndarray, at: np.ndarray, size: int = LENGTH) -> np.ndarray:
    """A hash of the `size` bytes from each place on."""
    words, h = _words(text), np.zeros(len(at), np.uint64)
    for s in (*range(0, size - 8, 8), size - 8):
        h = (h ^ words[at + s]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def equal_strings(parts: list[dict]) -> list[dict]:
    """Of one bucket, back to each piece: starts of strings that a text with a smaller id has, and of hot ones the least id.

    Strings stay in play if another context of their anchor agrees with theirs in the bytes that CLASSES has for the anchor's
    place in them, which equal strings imply.
    """
    column = lambda n, kind: np.concatenate([_unpack(x[n], kind) for x in parts])
    h, least, at = column("h", np.uint64), column("least", np.int64), column("at", np.int64)
    size, anchor = column("size", np.uint8).astype(np.int64), column("anchor", np.uint8).astype(np.int64)
    text = np.append(column("text", np.uint8), np.zeros(64, np.uint8))
    begin = np.cumsum(size) - size
    hot = anchor == 255
    # the starts that stay, from `lo` to `hi`: of the classes that have a twin
    lo, hi = np.where(hot, 0, LENGTH), np.where(hot, 0, -1)
    for least_place, most_place, left, right in CLASSES:
        low_start, high_start = np.maximum(anchor - most_place, 0), np.minimum(anchor - least_place, size - LENGTH)
        has = np.flatnonzero(~hot & (low_start <= high_start))
        both = h[has] ^ string_hash(text, begin[has] + anchor[has] - left, GRAM + left + right)
        order = np.argsort(both)
        both = both[order]
        twin = np.zeros(len(both), bool)
        twin[1:] = both[1:] == both[:-1]
        twin[:-1] |= twin[1:]
        has = has[order[twin]]
        lo[has], hi[has] = np.minimum(lo[has], low_start[has]), np.maximum(hi[has], high_start[has])
    play = np.flatnonzero(lo <= hi)
    begin, at, size = begin + lo, at + lo, hi - lo + LENGTH
    play = play[np.argsort(h[play], kind="stable")]
    starts = _runs(h[play])
    count = np.diff(np.append(starts, len(play)))
    total = np.add.reduceat(size[play] + 1, starts) if len(play) else count
    groups = np.flatnonzero(count > 1)
    groups = groups[np.argsort(total[groups], kind="stable")]  # texts of like length together
    low = least.copy()  # of hot strings, the least id of all equal ones
    found_piece, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    piece = np.repeat([x["piece"] for x in parts], [len(_unpack(x["size"], np.uint8)) for x in parts])
    for some in _batches(groups, total[groups]):
        group = play[_spread(starts[some], count[some])]
        context, offset, smaller = _smaller(text, begin[group], size[group], least[group], np.cumsum(count[some]) - count[some])
        is_hot = hot[group[context]]
        np.minimum.at(low, group[context[is_hot]], smaller[is_hot])
        mine = ~is_hot & (smaller < least[group[context]])
        found_piece.append(piece[group[context[mine]]])
        found_at.append(at[group[context[mine]]] + offset[mine])
    order = np.lexsort((where := np.concatenate(found_at), owner := np.concatenate(found_piece)))
    where, owner = where[order], owner[order]
    hots = np.flatnonzero(hot)
    rows = []
    for p in np.unique(np.append(owner, piece[hots])):
        own = where[slice(*np.searchsorted(owner, (p, p + 1)))]
        first = np.flatnonzero(np.append(True, np.diff(own) > 1))[: len(own)]
        own_hot = hots[piece[hots] == p]
        last = own[np.append(first[1:] - 1, len(own) - 1)] if len(own) else own
        rows.append({"piece": int(p), "first": _pack(own[first]), "last": _pack(last), "at": _pack(at[own_hot]), "low": _pack(low[own_hot])})
    return rows


def _batches(groups: np.ndarray, total: np.ndarray) -> Iterator[np.ndarray]:
    fill, at = np.append(0, np.cumsum(total)), 0
    while at < len(groups):
        most = max(at + 1, int(np.searchsorted(fill, fill[at] + MOST_CELLS, side="right")) - 1)
        end = max(int(np.searchsorted(fill, fill[at] + CELLS)), at + TEXTS)
        yield groups[at : (at := min(end, most, len(groups)))]


def _smaller(text: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, id) of the strings in the contexts: the least id of any equal string of the same anchor, from the suffix order.

    Anchors' contexts start at `first`. Each is closed by a 2, an anchor's last one by a 1 more: neither is in a string.
    """
    last = np.zeros(len(begin), np.int64)
    last[np.append(first[1:], len(begin)) - 1] = 1
    closed = size + 1 + last
    put = np.cumsum(closed) - closed
    raw = np.zeros(int(closed.sum()) + 64, np.uint8)
    raw[_spread(put, size)] = text[_spread(begin, size)]
    symbols = raw[:-64].astype(np.int64) + 3
    symbols[put + size] = 2
    symbols[(put + size + 1)[last > 0]] = 1
    order = suffix_arrays(symbols, np.append(put[first], len(symbols)))
    windows = size - LENGTH + 1
    context_at = np.full(len(symbols), -1)
    context_at[_spread(put, windows)] = np.repeat(np.arange(len(begin)), windows)
    order = order[context_at[order] >= 0]  # strings in the order of their suffixes: equal ones are neighbours
    context = context_at[order]
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begin))))[context]
    same = np.zeros(len(order), bool)
    pair = 1 + np.flatnonzero(row[1:] == row[:-1])
    same[pair] = _same(raw, order[pair], order[pair - 1])
    runs = np.flatnonzero(~same)
    low = np.minimum.reduceat(least[context], runs)
    return context, order - put[context], np.repeat(low, np.diff(np.append(runs, len(order))))


def removals(row: dict) -> list[dict]:
    """Of one piece: per text the maximal runs of covered bytes, and the other bytes."""
    hot = [x for x in row["equal"] or [] if len(_unpack(x["at"], np.int64))]
    piece = _Piece({n: row[n] for n in ("size", "least", "text", *(("starts", "places") if hot else ()))})
    change = np.zeros(len(piece.text) + 1, np.int64)
    for x in row["equal"] or []:
        np.add.at(change, _unpack(x["first"], np.int64), 1)
        np.add.at(change, _unpack(x["last"], np.int64) + LENGTH, -1)
    if hot:
        # the hot strings of the piece again: all anchors that have one of the first places sent back
        at, low = (np.concatenate([_unpack(x[n], np.int64) for x in hot]) for n in ("at", "low"))
        anchor = np.searchsorted(piece.low, at, side="right") - 1
        starts, one, _ = hot_strings(piece, np.flatnonzero(np.isin(piece.h, piece.h[anchor])))
        order = np.argsort(at)
        of = low[order][np.searchsorted(at[order], starts[one])]
        of = np.repeat(of, np.diff(np.append(one, len(starts))))
        mine = starts[of < piece.least[np.searchsorted(piece.begin, starts, side="right") - 1]]
        np.add.at(change, mine, 1)
        np.add.at(change, mine + LENGTH, -1)
    covered = np.cumsum(change)[: int(piece.size.sum())] > 0
    before = np.append(False, covered[:-1])[: len(covered)]
    before[piece.begin] = False  # a text's first byte starts a run of its own
    starts = np.flatnonzero(covered & ~before)
    after = np.append(covered[1:], False)[: len(covered)]
    after[piece.begin[1:] - 1] = False
    ends = np.flatnonzero(covered & ~after) + 1
    rest = np.ascontiguousarray(piece.text[: len(covered)][~covered]).data.tobytes()
    gone = np.append(0, np.cumsum(covered))
    edge = np.append(piece.begin, len(covered))
    run, kept = np.searchsorted(starts, edge), (edge - gone[edge]).tolist()
    starts, ends = starts - np.repeat(piece.begin, np.diff(run)), ends - np.repeat(piece.begin, np.diff(run))
    columns = zip(row["th"], _unpack(row["k"], np.int64).tolist(), piece.least.tolist(), piece.size.tolist(), strict=True)
    return [
        {"doc_id": least, "th": th, "k": k, "n_bytes": n, "starts": starts[run[j] : run[j + 1]].tolist(), "ends": ends[run[j] : run[j + 1]].tolist(), "kept": rest[kept[j] : kept[j + 1]]}
        for j, (th, k, least, n) in enumerate(columns)
    ]


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, th (MD5 of its text), n_bytes, starts and ends of removed runs of bytes, kept (the other bytes).

    A byte is removed where a string of LENGTH bytes covers it that also starts in a document with a smaller id, in the texts
    as they are. Null texts are empty. A null id, or one that is no number, is neither smaller nor larger than another: such
    rows are left whole and take nothing from others. Rows with one id don't take from each other, and rows that repeat id
    and text have one result each. Other columns, whatever their names, are ignored.

    Rows with equal texts are one text from the first shuffle on, in which each task sends a text once, however many rows
    repeat it. Those with a larger id than the least lose all their bytes, and don't go further.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.md5(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    is_long = F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)
    long = rows.where(is_long)
    ids = cut(long.groupBy("th", "doc_id").agg(F.count("*").alias("k"), F.first("n_bytes").alias("n_bytes")))
    owner = ids.groupBy("th").agg(F.min(F.struct("doc_id", "k")).alias("o"), F.first("n_bytes").alias("n_bytes"))
    owner = cut(owner.select("th", F.col("o.doc_id").alias("least"), F.col("o.k").alias("k"), "n_bytes"))
    total = owner.agg(F.sum("n_bytes")).head()[0] or 0
    buckets = math.ceil(max(total, 1) / bucket)
    texts = long.groupBy("th").agg(F.first("text").alias("text")).join(owner.select("th", "least", "k"), "th")
    made = keep(pieces_of(texts, piece, buckets))

    def marks(row: dict) -> list[dict]:
        found = shared_anchors(row["parts"], hot)
        return [{"piece": x["piece"], "bucket": row["bucket"], "shared": a, "hot": b} for x, (a, b) in zip(row["parts"], found, strict=True)]

    part = F.struct("piece", "h", "n", "m")
    spread = max(1, min(buckets, MOST_TASKS))  # a number that is asked for is not coalesced
    counts = made.select("piece", F.explode("counts").alias("c")).select("piece", "c.*").repartition(spread, "bucket").groupBy("bucket").agg(F.collect_list(part).alias("parts"))
    marked = _mapped(counts, marks, _SHARED).groupBy("piece").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("marks"))
    found = _mapped(made.select("piece", "size", "least", "text", "starts", "places").join(marked, "piece"), lambda row: contexts(row, buckets), _CONTEXTS)
    part = F.struct(*(n for n in "piece h least at size anchor text".split()))
    equal = _mapped(found.repartition(spread, "bucket").groupBy("bucket").agg(F.collect_list(part).alias("parts")), lambda row: equal_strings(row["parts"]), _EQUAL)
    equal = keep(equal).groupBy("piece").agg(F.collect_list(F.struct("first", "last", "at", "low")).alias("equal"))
    out = _mapped(made.drop("counts").join(equal, "piece", "left"), removals, _RESULT)

    empty = F.expr("cast(array() as array<bigint>)")
    whole = rows.where(~is_long).select("doc_id", "th", "n_bytes", empty.alias("starts"), empty.alias("ends"), F.col("text").alias("kept"))
    copies = ids.join(owner.select("th", "least"), "th").where("doc_id > least")
    gone = _repeated(copies.select("k", "doc_id", "th", "n_bytes", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"), F.lit(b"").alias("kept")))
    return _repeated(out).unionByName(gone).unionByName(whole)


def _repeated(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """Each row k times, by blocks, so that no array is longer than `block`."""
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(block).cast("long"))))
    return rows.withColumn("at", F.explode(F.sequence("at", F.least(F.col("k"), F.col("at") + block) - 1))).drop("k", "at")
