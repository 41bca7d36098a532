"""Quality scores from compression: zstandard dictionaries of good and bad texts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, keep_rows

#: A text is compressed in blocks of so many bytes, each on its own, so that the dictionaries count alike along a long text.
BLOCK = 2048
DICT_BYTES = 1 << 16
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad texts and the calibration of what they compress to; no dictionaries: offset alone.

    score = 1 / (1 + exp(-(slope * d + level * r + bend * r * r + offset))) with d the normalised difference of the sizes and
    r the logarithm of the smaller size by the text's: texts that repeat themselves are small with either dictionary.
    """

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    offset: float = 0.0
    level: float = 0.0
    bend: float = 0.0

    def score(self, text: bytes) -> float:
        d, r = measures(text, self.good, self.bad) if self.good else (0.0, 0.0)
        z = max(-30.0, min(30.0, self.slope * d + self.level * r + self.bend * r * r + self.offset))
        return 1 / (1 + math.exp(-z))


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard

    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    book.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)


def measures(text: bytes, good: bytes, bad: bytes) -> tuple[float, float]:
    """Over the whole text: (size with the bad dictionary - size with the good one) / their sum, and ln(smaller size / the text's); 0 for an empty text."""
    if not text:
        return 0.0, 0.0
    sizes = []
    for content in (good, bad):
        compress = _compressor(content).compress
        sizes.append(sum(len(compress(text[k : k + BLOCK])) for k in range(0, len(text), BLOCK)))
    return (sizes[1] - sizes[0]) / sum(sizes), math.log(min(sizes) / len(text))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train one."""
    import zstandard

    blocks = [t[k : k + BLOCK] for t in texts for k in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression of y (0 to 1) on the columns of x, by Newton's method."""
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 1, most_rows: int = 3000, most_bytes: int = 1 << 15) -> Model:
    """The model of labelled rows outside fold `held_out`.

    Up to most_rows ids of each label, of those with one label, are chosen by a hash of the id; texts of over most_bytes
    are not used for fitting, so the driver holds 2 * most_rows * most_bytes bytes at most. Three of five train the
    dictionaries, the others the calibration. With a label missing, every text scores the share of label 1 (0.5: none).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(fold(F.col("id")) != held_out)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    order = [F.xxhash64("id", F.lit(6)), "id"]
    chosen = known.where("y = 1").orderBy(*order).limit(most_rows).unionByName(known.where("y = 0").orderBy(*order).limit(most_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") <= most_bytes)
    rows = texts.join(F.broadcast(chosen.select("id", "y")), "id").select("id", "y", "text").toLocalIterator()
    rows = sorted({(r["id"], r["y"], bytes(r["text"])) for r in rows})
    ys = [y for _, y, _ in rows]
    if not 0 < sum(ys) < len(ys):
        share = (sum(ys) + 0.5) / (len(ys) + 1)
        return Model(offset=math.log(share / (1 - share)))
    seen = {0: 0, 1: 0}
    train: dict[int, list[bytes]] = {0: [], 1: []}
    rest = []
    for _, y, text in rows:
        if seen[y] % 5 < 3:
            train[y].append(text)
        else:
            rest.append((y, text))
        seen[y] += 1
    good, bad = _dictionary(train[1], DICT_BYTES), _dictionary(train[0], DICT_BYTES)
    rest = rest or [(y, t) for y in train for t in train[y]]
    x = np.array([[d, 1.0, r, r * r] for d, r in (measures(t, good, bad) for _, t in rest)])
    y = np.array([float(a) for a, _ in rest])
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1.0
    share = known.agg(F.avg("y")).head()[0] or 0.5
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Model(good, bad, *(logistic(x / scale, y, weight) / scale).tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row; whole texts, null as empty. An empty text has measures 0.

    Rows that repeat an id or a text are scored each for itself, a null id too; other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(cols):
        m = shared.value
        return {"doc_id": cols["doc_id"], "score": [m.score(t or b"") for t in cols["text"].to_pylist()]}

    kind = dict(docs.dtypes)[id_col]
    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")), make, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score `threshold` or more, whatever their ids: null and repeated ids are judged row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts):
        m = shared.value
        return [m.score(t) >= threshold for t in texts]

    return keep_rows(docs, text_col, judge)
