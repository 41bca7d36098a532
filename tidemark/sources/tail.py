"""A streaming source of files that grow: each batch takes the whole lines that came since the last one."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task.
SPLIT = 64 << 20


@dataclass
class Span(InputPartition):
    """Bytes start to end of a file; lines that begin in them are read."""

    path: str
    start: int
    end: int
    limit: int


class TailSource(DataSource):
    """CSV files of a folder, with headers, that others append to: format "tail", options `path`, `suffix` (.csv) and `per_batch`.

    Offsets are the bytes read of each file up to the last whole line, so a restart goes on where the last batch ended. Lines
    that don't fit the schema are skipped. per_batch bounds the bytes of a file in a batch; the first batch after a restart
    takes all there is. The offset names each file: it is for feeds of up to some thousands of files.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TailReader(schema, dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.suffix = schema, options["path"], options.get("suffix", ".csv")
        self.per_batch = int(options.get("per_batch", 0))
        self.last: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(self.suffix):
                began = (self.last or {}).get(info.path, 0)
                size = info.size if not self.per_batch or self.last is None else min(info.size, began + self.per_batch)
                with system.open_input_file(info.path) as f:
                    out[info.path] = max(began, _line_end(f, size, info.size))
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.last = {k: int(v) for k, v in end.items()}
        spans = []
        for path, stop in sorted(end.items()):
            spans += [Span(path, at, min(at + SPLIT, stop), stop) for at in range(int(start.get(path, 0)), int(stop), SPLIT)]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as f:
            names = next(csv.reader([_line(f, 0).decode("utf-8-sig", "replace")]), [])
            at = [names.index(field.name) if field.name in names else None for field in self.schema]
            begin = _next_line(f, partition.start, partition.limit)
            end = _next_line(f, partition.end, partition.limit)
            f.seek(begin)
            lines = io.StringIO(f.read(max(0, end - begin)).decode("utf-8-sig", "replace"))
        for k, row in enumerate(csv.reader(lines)):
            if row and not (k == 0 and begin == 0):
                try:
                    yield tuple(_value(row[i] if i is not None else "", field.dataType) for i, field in zip(at, self.schema, strict=True))
                except (ValueError, IndexError):
                    continue


def _line(f, at: int) -> bytes:
    f.seek(at)
    out = b""
    while b"\n" not in out and (more := f.read(1 << 16)):
        out += more
    return out.partition(b"\n")[0]


def _next_line(f, at: int, limit: int) -> int:
    """The first place from `at` on where a line begins, up to limit."""
    if at == 0 or at >= limit:
        return min(at, limit)
    return min(limit, at - 1 + len(_line(f, at - 1)) + 1)


def _line_end(f, size: int, whole: int) -> int:
    """The end of the last whole line in the first `size` bytes, or of the first line if it is longer than that."""
    at = size
    while at > 0:
        begin = max(0, at - (1 << 16))
        f.seek(begin)
        found = f.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    end = len(_line(f, 0)) + 1
    return end if end <= whole else 0


def _value(text: str, kind: T.DataType):
    text = text.strip()
    if not text:
        return None
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.FractionalType):
        return float(text.replace("%", "").replace(",", ""))
    if isinstance(kind, T.DateType):
        return date.fromisoformat(text)
    if isinstance(kind, T.TimestampType):
        return datetime.fromisoformat(text)
    return text


def tail(spark: SparkSession, path: str, schema: str, per_batch: int = 0):
    """A stream of the lines that are appended to the CSV files of a folder."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").schema(schema).option("path", path).option("per_batch", per_batch).load()
