"""Helpers shared by the training-data operators: cutting lineage, words, and code that runs in Arrow tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contract of the word-based operators: words are runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark removes the files of an action's shuffles when the action ends. Else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What an Arrow batch holds, about. Spark's own 64 MB are held by the executor and its Python worker, twice while the next one comes.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a fresh local one where it is unset and the master is local.

    On a cluster a machine's own folder would lose results without a word, so an unset spark.checkpoint.dir is refused there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


@contextmanager
def _written(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind, as nothing reads them once the result is in the shared folder, and goes to Python in small batches."""
    new = {CLEANUP: "true", BATCH: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES where they are larger: for results that the caller writes, so that it can't be set back here."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))
    if now > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs a read and not a recomputation."""
    shared_dir(df.sparkSession)
    with _written(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: df's was made under the setting that held before


def keep(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: compressed, for large results; gone when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _written(spark):
        df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)  # else a job reads it from a file


def in_arrow(df: DataFrame, make: Callable[[dict[str, list]], dict[str, list]], schema: str, most: int = 8 << 20) -> DataFrame:
    """mapInArrow of a function from columns to columns, by parts of about `most` bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most):
                made = make({n: c for n, c in zip(piece.schema.names, piece.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made.values(), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(task, schema)


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes or of one row, so that memory follows the longest text and not the number of rows."""
    rows = batch.num_rows
    if rows <= 1 or batch.nbytes <= most:
        if rows:
            yield batch
        return
    half = rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[list[bytes]], list[bool]], most: int = 8 << 20) -> DataFrame:
    """The rows of docs whose text `judge` accepts, by parts of about `most` bytes, whatever their other columns; null texts are judged as empty."""
    names = docs.columns
    at = names.index(text_col)
    schema = ", ".join(f"`c{k}` {t}" for k, (_, t) in enumerate(docs.dtypes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most):
                texts = piece.column(at).cast(pa.binary()).to_pylist()
                yield piece.filter(pa.array(judge([t or b"" for t in texts]), pa.bool_()))

    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(task, schema).toDF(*names)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that reruns agree."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
