"""Fill-in-middle transformation by succinct rank and select over packed token boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

# Fixed by the operator's contract: the marks and what a hash's four parts decide.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN, SPM = 1, 10, 20
#: 64-bit words of a block of the directory.
WORDS = 8


class BitVector:
    """A packed bit vector with the ones before each block and before each word of it: rank and select without a scan."""

    def __init__(self, bits: np.ndarray):
        block = 64 * WORDS
        packed = np.zeros((len(bits) // block + 1) * block // 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64).reshape(-1, WORDS)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.inside = np.cumsum(ones, axis=1) - ones
        self.before = np.concatenate(([0], np.cumsum(ones.sum(axis=1))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place; a place may be the vector's length."""
        block, word, bit = at // (64 * WORDS), at // 64 % WORDS, (at % 64).astype(np.uint64)
        below = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + self.inside[block, word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of each one, counted from 0: its block by search, its word by the block's counts, its bit by halves of the word."""
        block = np.minimum(np.searchsorted(self.before, k, side="right") - 1, len(self.words) - 1)
        rest = k - self.before[block]
        word = (self.inside[block] <= rest[:, None]).sum(axis=1) - 1
        rest = rest - self.inside[block, word]
        bits, bit = self.words[block, word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low)
            upper = rest >= ones
            rest = rest - np.where(upper, ones, 0)
            bits = np.where(upper, bits >> np.uint64(half), low)
            bit += np.where(upper, half, 0)
        return (block * WORDS + word) * 64 + bit


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[BitVector, BitVector]:
    """(token starts, code point starts) of concatenated UTF-8 texts. A token is a run of A-Z and a-z, or any other code point."""
    letter = ((data | np.uint8(32)) - np.uint8(97)) < 26
    point = (data & 0xC0) != 0x80
    token = point.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    token[offsets[:-1][offsets[:-1] < offsets[1:]]] = True  # a text begins with a token
    return BitVector(token), BitVector(point)


def rotated(texts: pa.Array, first: np.ndarray, second: np.ndarray, forms: list[str]) -> dict[str, list]:
    """n, prefix_chars, middle_chars and output of each text; the cuts are first and second modulo n + 1 tokens."""
    flat = texts.cast(pa.large_binary())
    _, at, body = flat.buffers()
    offsets = np.frombuffer(at, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = body.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if body is not None else b""
    offsets = offsets - offsets[0]
    token, point = boundaries(np.frombuffer(raw, np.uint8), offsets)
    begin = token.rank(offsets[:-1])
    n = token.rank(offsets[1:]) - begin
    low, high = np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))
    cut = lambda k: np.where(k < n, token.select(np.minimum(begin + k, max(0, token.before[-1] - 1))), offsets[1:])
    a, b = cut(low), cut(high)
    chars = point.rank(np.concatenate((offsets[:-1], a, b))).reshape(3, -1)
    out = []
    for k, form in enumerate(forms):
        s, e = offsets[k], offsets[k + 1]
        prefix, middle, suffix = raw[s : a[k]], raw[a[k] : b[k]], raw[b[k] : e]
        if form == "plain":
            out.append(raw[s:e])
        elif form == "psm":
            out.append(b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle)))
        else:
            out.append(b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle)))
    plain = np.array([form == "plain" for form in forms], bool)
    return {"n": n, "prefix_chars": pa.array(chars[1] - chars[0], mask=plain), "middle_chars": pa.array(chars[2] - chars[1], mask=plain), "output": pa.array(out, pa.binary())}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Per row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output.

    The first four groups of eight hex digits of the SHA-256 of seed:id choose the two cuts and the form, so that reruns
    agree: of 100 texts `plain` stay as they are, and of the others `spm` of 100 put the suffix first. Empty and null texts,
    and texts that hold one of the marks, are plain. A null id is hashed as an empty one; rows that repeat an id and a text
    give equal rows; other columns, whatever their names, are ignored. Rows never meet: no shuffle, and memory follows the
    longest text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("h"))
    part = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (part(2) % 100 >= 100 - plain), "plain").when(part(3) % 100 < spm, "spm").otherwise("psm")
    kind = dict(rows.dtypes)["doc_id"]

    def make(cols):
        first, second = (cols[c].to_numpy(zero_copy_only=False) for c in ("first", "second"))
        made = rotated(cols["text"], first, second, cols["form"].to_pylist())
        return {"doc_id": cols["doc_id"], "n": made["n"], "form": cols["form"], **{c: made[c] for c in ("prefix_chars", "middle_chars", "output")}}

    found = in_arrow(rows.select("doc_id", "text", part(0).alias("first"), part(1).alias("second"), form.alias("form")), make, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle was given, from its output and form: texts with marks stay plain, so the three marks cut exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.element_at(parts, k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))
