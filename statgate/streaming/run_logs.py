"""Raw run logs, one file per run, as a batch table and as a stream.

A Python data source reads files by byte ranges. A line's ``seq`` is the byte
it starts at, so it is the same however the file was cut into ranges or
batches, and after a restart. The stream's offset holds, for every file of the
folder, the byte after the last whole line that was read; a batch takes what
whole lines were appended since, and Spark's own offset log lets a restarted
query go on in the middle of a file.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from statgate.sources.csv_files import open_file

RANGE_BYTES = 64 << 20
BATCH_LINES = 8192
SCHEMA = "run_id string, seq long, line string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def list_files(folder: str) -> dict[str, int]:
    """Size of every file directly in ``folder``."""
    if urlparse(folder).scheme in ("", "file"):
        path = urlparse(folder).path if "://" in folder or folder.startswith("file:") else folder
        with os.scandir(path) as entries:
            return {e.path: e.stat().st_size for e in entries if e.is_file()}
    import pyarrow.fs

    system, inside = pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    base = folder.rstrip("/")
    found = system.get_file_info(pyarrow.fs.FileSelector(inside))
    return {f"{base}/{f.base_name}": f.size for f in found if f.is_file}


def end_of_lines(path: str, start: int, size: int, chunk: int = 1 << 16) -> int:
    """The byte after the last newline in [start, size), or ``start``; read backwards from the end."""
    with open_file(path) as f:
        end = size
        while end > start:
            begin = max(start, end - chunk)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


class LogRange(InputPartition):
    """Lines that start in [start, stop) of a file; ``first`` tells that a line starts at ``start``."""

    def __init__(self, path: str, start: int, stop: int, first: bool):
        super().__init__(0)
        self.path, self.start, self.stop, self.first = path, start, stop, first


def ranges(path: str, start: int, stop: int, size: int) -> list[LogRange]:
    return [LogRange(path, at, min(stop, at + size), at == start) for at in range(start, stop, size)]


def run_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def read_range(part: LogRange) -> Iterator[pa.RecordBatch]:
    """(run_id, seq, line) of the lines that start in the range."""
    run = run_of(part.path)
    seqs: list[int] = []
    lines: list[str] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([run] * len(seqs)), pa.array(seqs, pa.int64()), pa.array(lines, pa.string())], names=["run_id", "seq", "line"])

    with open_file(part.path) as f:
        at = part.start
        f.seek(at if part.first else at - 1)
        if not part.first:
            at += len(f.readline()) - 1  # the rest of a line that starts before
        while at < part.stop:
            line = f.readline()
            if not line:
                break
            seqs.append(at)
            lines.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
            at += len(line)
            if len(seqs) == BATCH_LINES:
                yield batch()
                seqs.clear()
                lines.clear()
    if seqs:
        yield batch()


class _Options:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("maxbytespertrigger", 0))


class RunLogReader(DataSourceReader, _Options):
    def __init__(self, options: dict):
        _Options.__init__(self, options)

    def partitions(self) -> list[InputPartition]:
        files = sorted(list_files(self.folder).items())
        return [r for path, size in files for r in ranges(path, 0, size, self.range_bytes)] or [LogRange("", 0, 0, True)]

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_range(partition)


class RunLogStreamReader(DataSourceStreamReader, _Options):
    """Offsets are {path: byte}; a file that is not in an offset has not been read."""

    def __init__(self, options: dict):
        _Options.__init__(self, options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Up to the last whole line of every file, at most ``maxBytesPerTrigger`` further than the last offset asked for."""
        left = self.batch_bytes or None
        for path, size in sorted(list_files(self.folder).items()):
            start = self.known.get(path, 0)
            if size <= start or left == 0:
                continue
            # a line longer than the limit is taken whole
            stop = size if left is None else min(size, start + left)
            end = end_of_lines(path, start, stop)
            if end == start and stop < size:
                end = end_of_lines(path, start, size)
            if end > start:
                self.known[path] = end
                left = None if left is None else max(0, left - (end - start))
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for path, byte in end.items():  # after a restart the offset log knows more than this reader
            self.known[path] = max(self.known.get(path, 0), byte)
        grown = [(path, start.get(path, 0), byte) for path, byte in sorted(end.items()) if byte > start.get(path, 0)]
        return [r for path, a, b in grown for r in ranges(path, a, b, self.range_bytes)]

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)

    def commit(self, end: dict) -> None:
        pass


class RunLogSource(DataSource):
    """``format("run_logs")``; options ``path`` (a folder), ``rangeBytes``, ``maxBytesPerTrigger`` (streams)."""

    @classmethod
    def name(cls) -> str:
        return "run_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RunLogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RunLogStreamReader(self.options)


def read_run_logs(spark: SparkSession, path: str, stream: bool = False, range_bytes: int = RANGE_BYTES, max_bytes: int = 0) -> DataFrame:
    """(run_id, seq, line) of the raw logs in folder ``path``; the run's id is the file's name without its ending.

    As a batch a last line without a newline counts; a stream waits for the
    newline. Bytes that are no UTF-8 become replacement characters.
    """
    spark.dataSource.register(RunLogSource)
    reader = (spark.readStream if stream else spark.read).format("run_logs").option("rangeBytes", range_bytes)
    if stream and max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)
