"""Files that grow and archives: read from a known byte on, and one archive in one task.

Both are Spark data sources, so the work is dealt by partitions and the files are opened where the tasks run; paths are
of a file system that driver and executors share.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql import types as T

from tidemark.sources.candles import COLUMNS, RAW, ContractError

#: bytes of a partition
PART_BYTES = 16 << 20


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, name


def size_of(path: str) -> int:
    """Bytes of a file; 0 where there is none yet."""
    system, name = _open(path)
    info = system.get_file_info(name)
    return info.size or 0 if info.is_file else 0


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def _lines(path: str, begin: int, end: int, whole: int) -> Iterator[str]:
    """The lines that begin in [begin, end); a last line without an end is not there yet."""
    system, name = _open(path)
    with system.open_input_file(name) as file:
        # a line that began before belongs to the range before
        at = begin
        if begin:
            file.seek(begin - 1)
            at = begin - 1
        held, first = b"", bool(begin)
        while True:
            data = file.read(min(1 << 20, whole - at - len(held))) if at + len(held) < whole else b""
            held += data
            while (cut := held.find(b"\n")) >= 0:
                line, start = held[:cut], at
                held, at = held[cut + 1 :], at + cut + 1
                if first:
                    first = False
                elif start >= end:
                    return
                else:
                    yield line.decode()
            if not data or (at >= end and not first):
                return


class _Tail:
    """What both readers share: the rows of byte ranges of one CSV file."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def ranges(self, begin: int, end: int) -> list[Range]:
        # without any partition Spark asks for None
        return [Range(k, min(k + PART_BYTES, end)) for k in range(begin, end, PART_BYTES)] or [Range(begin, begin)]

    def rows(self, part: Range, whole: int) -> Iterator[tuple]:
        if part.begin >= part.end:
            return
        kinds = [int if isinstance(f.dataType, T.LongType) else float if isinstance(f.dataType, T.DoubleType) else str for f in self.schema]
        for line in _lines(self.path, part.begin, part.end, whole):
            values = line.rstrip("\r").split(",")
            if values == [""] or values[0] == self.schema[0].name:
                continue
            if len(values) != len(kinds):
                raise ContractError(f"{self.path}: {len(values)} fields, not {len(kinds)}")
            yield tuple(k(v) for k, v in zip(kinds, values))


def whole_lines(path: str, begin: int = 0) -> int:
    """Where the last complete line of a file ends, from `begin` on."""
    system, name = _open(path)
    at = size_of(path)
    with system.open_input_file(name) as file:
        while at > begin:
            back = max(begin, at - 4096)
            file.seek(back)
            if (cut := file.read(at - back).rfind(b"\n")) >= 0:
                return back + cut + 1
            at = back
    return begin


class TailReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.tail, self.begin = _Tail(options["path"], schema), int(options.get("begin", 0))
        self.end = int(options["end"])

    def partitions(self) -> list[Range]:
        return self.tail.ranges(self.begin, self.end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.tail.rows(partition, self.end)


class TailStream(DataSourceStreamReader):
    """A stream of one growing file; an offset is a byte that a line begins at."""

    def __init__(self, schema: T.StructType, options: dict):
        self.tail, self.at = _Tail(options["path"], schema), 0

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        self.at = whole_lines(self.tail.path, self.at) if size_of(self.tail.path) else 0
        return {"byte": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["byte"])
        return self.tail.ranges(start["byte"], end["byte"])

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.tail.rows(partition, partition.end)


class TailSource(DataSource):
    """format("tail"): the rows of a CSV file that is only appended to, in byte ranges; batch reads need `end`."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> T.StructType:
        return RAW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TailReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TailStream(schema, self.options)


def read_new(spark: SparkSession, path: str, begin: int = 0) -> tuple[DataFrame, int]:
    """The rows of a growing CSV file from a byte on, and the byte to go on from: the end of its last complete line.

    A file that is shorter than it was is not the same file: an error.
    """
    spark.dataSource.register(TailSource)
    if size_of(path) < begin:
        raise ContractError(f"{path} is shorter than the {begin} bytes that were read")
    end = whole_lines(path, begin) if size_of(path) else begin
    return spark.read.format("tail").schema(RAW).option("begin", begin).option("end", end).load(path), end


def read_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(archive, candle columns) of the CSV files in ZIP archives; each archive is read whole in one task.

    Times in microseconds become milliseconds; a header is passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(paths).select("path", "content")
    kept = [RAW.fieldNames().index(c) for c in COLUMNS]
    whole = {c for c in COLUMNS if isinstance(RAW[c].dataType, T.LongType)}

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(path: str, rows: list[list[str]]) -> pa.RecordBatch:
            columns = [pa.array([(int if c in whole else float)(r[k]) for r in rows], pa.int64() if c in whole else pa.float64()) for c, k in zip(COLUMNS, kept)]
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *columns], ["archive", *COLUMNS])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in sorted(archive.namelist()):
                        if not name.endswith(".csv"):
                            continue
                        rows: list[list[str]] = []
                        with archive.open(name) as file:
                            for line in io.TextIOWrapper(file):
                                values = line.rstrip("\r\n").split(",")
                                if values[0].isdigit():
                                    rows.append(values)
                                if len(rows) == 50_000:
                                    yield made(path, rows)
                                    rows = []
                        if rows:
                            yield made(path, rows)

    from tidemark.functions.columns import epoch_ms

    fields = ", ".join(f"{c} {'long' if c in whole else 'double'}" for c in COLUMNS)
    return files.mapInArrow(unpacked, f"archive string, {fields}").withColumns({c: epoch_ms(F.col(c)) for c in ("open_time", "close_time")})
