"""A data source for folders of JSON-lines logs that grow: batch and stream readers, cut by byte ranges.

`spark.read.format("jsonlog").schema(...).load(folder)` reads what is there, `spark.readStream` what is added. Files are
dealt in ranges of `rangeBytes`; a line belongs to the range in which it starts, so no line is read twice or cut. A
stream's offset is the length of each file up to its last whole line: a line that is being written waits for the next
batch. Filters `at >= x` and `at < x` on the column named by the option `timeColumn` are applied while reading, and
files whose name says that they are outside them (<from>_<until>.jsonl, in the column's own form) are not opened.

Files are opened through pyarrow, so a folder may be local or any URI that it knows. Blank lines are skipped, fields
that the schema doesn't name are left out, missing ones are NULL.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "jsonlog"
READ = 1 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """The .json and .jsonl files under a path with their sizes; hidden and unfinished ones are left out."""
    store, at = _store(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.is_file and f.extension in ("json", "jsonl") and not any(p[:1] in "._" for p in f.path[len(at) :].strip("/").split("/"))}


def _whole(store: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The end of the last whole line of a file before `size`, not before start."""
    with store.open_input_file(path) as f:
        end = size
        while end > start:
            a = max(start, end - READ)
            last = f.read_at(end - a, a).rfind(b"\n")
            if last >= 0:
                return a + last + 1
            end = a
    return start


class _Ranges:
    """What both readers share: options, pushed bounds, cutting and reading of ranges."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("rangebytes", options.get("rangeBytes", 32 << 20)))
        self.column = options.get("timecolumn", options.get("timeColumn"))
        self.low: list = []
        self.high: list = []

    def cut(self, start: dict[str, int], end: dict[str, int]) -> list[ByteRange]:
        out = []
        for path, stop in sorted(end.items()):
            if self.outside(path):
                continue
            at = start.get(path, 0)
            out += [ByteRange(path, a, min(a + self.size, stop)) for a in range(at, stop, self.size)]
        return out or [ByteRange("", 0, 0)]

    def outside(self, path: str) -> bool:
        first, _, last = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].partition("_")
        texts = all(isinstance(x, str) for x in self.low + self.high)
        if not last or not texts:
            return False
        return any(last <= x for x in self.low) or any(first >= x for x in self.high)

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = _store(self.path)
        schema = to_arrow_schema(self.schema)
        with store.open_input_file(part.path) as f:
            size = f.size()
            at = part.start
            if at:  # the line that starts before belongs to the range before
                at = self._next_line(f, at - 1, size)
            while at < part.end:
                stop = min(at + READ, part.end)
                stop = self._next_line(f, stop - 1, size)
                yield from self._parsed(f.read_at(stop - at, at), schema)
                at = stop

    @staticmethod
    def _next_line(f, at: int, size: int) -> int:
        """The place after the first line end from `at` on."""
        while at < size:
            block = f.read_at(min(READ, size - at), at)
            end = block.find(b"\n")
            if end >= 0:
                return at + end + 1
            at += len(block)
        return size

    def _parsed(self, raw: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not raw.strip():
            return
        how = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
        found = pj.read_json(io.BytesIO(raw), read_options=pj.ReadOptions(use_threads=False, block_size=len(raw) + 1), parse_options=how)
        if self.column:
            x = found.column(self.column)
            for v in self.low:
                found = found.filter(pc.greater_equal(found.column(self.column), pa.scalar(v, x.type)))
            for v in self.high:
                found = found.filter(pc.less(found.column(self.column), pa.scalar(v, x.type)))
        yield from found.select(schema.names).to_batches()


class JsonLogReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.ranges = _Ranges(schema, options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == (self.ranges.column,):
                self.ranges.low.append(f.value)
            elif isinstance(f, LessThan) and f.attribute == (self.ranges.column,):
                self.ranges.high.append(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[ByteRange]:
        return self.ranges.cut({}, _files(self.ranges.path))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.ranges.read(partition)


class JsonLogStream(DataSourceStreamReader):
    """Offsets are {file: bytes read}; `from` and `until` (options) hold the stream to a half-open slice of time."""

    def __init__(self, schema: StructType, options: dict):
        self.ranges = _Ranges(schema, options)
        self.ranges.low += [options["from"]] if "from" in options else []
        self.ranges.high += [options["until"]] if "until" in options else []
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:  # noqa: N802
        store, _ = _store(self.ranges.path)
        for path, size in _files(self.ranges.path).items():
            before = self.seen.get(path, 0)
            self.seen[path] = _whole(store, path, before, size) if size > before else before
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[ByteRange]:
        return self.ranges.cut(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.ranges.read(partition)

    def commit(self, end: dict) -> None:
        pass


class JsonLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the schema of the logs")

    def reader(self, schema: StructType) -> JsonLogReader:
        return JsonLogReader(schema, self.options)

    def streamReader(self, schema: StructType) -> JsonLogStream:  # noqa: N802
        return JsonLogStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLog)
