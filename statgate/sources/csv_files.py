"""CSV files by many tasks, with quoted newlines and exact record numbers.

*Headers* come from a Python data source: one partition per group of files,
each file is opened, its first record is read, and the file is closed again.

*Records* of a file are found by a prefix scan over quote parity. A newline
ends a record if the number of quotes before it in the file is even (a doubled
quote adds two). A split cannot know how many quotes came before it, so its
lines are numbered for both cases at once, while they stream past in file
order; a table of one row per split (parity and record ends for both cases) is
summed along each file and tells which case holds and how many records came
before. A line that starts and ends outside quotes is a record as it stands;
only the lines of records that span several are brought together.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from statgate.functions.scalars import strip_blanks
from statgate.session import cut

MALFORMED = "__malformed"
FILES_PER_TASK = 256
BROADCAST_SPLITS = 100_000  # rows of a path and five numbers; beyond it lines and splits are joined by a shuffle
CHUNK = 1 << 16
OPENABLE = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")

# classes of a data source are pickled for its workers, which have no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_file(path: str):
    """A binary file, named as Spark names it, from any place on."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(unquote(url.path), "rb")
    import pyarrow.fs

    system, inside = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inside)


def first_record(stream, chunk: int = CHUNK) -> str:
    """The text up to the first newline after an even number of quotes, without its line end."""
    data, quotes, at = b"", 0, 0
    while True:
        more = stream.read(chunk)
        data += more
        while (end := data.find(b"\n", at)) >= 0:
            quotes += data.count(b'"', at, end)
            if quotes % 2 == 0:
                return data[:end].removesuffix(b"\r").decode("utf-8-sig")
            at = end + 1
        if not more:
            return data.removesuffix(b"\r").decode("utf-8-sig")
        quotes += data.count(b'"', at)
        at = len(data)


def record_names(record: str) -> list[str]:
    """The cells of a header record, as they are."""
    return next(csv.reader(io.StringIO(record, newline="")), [])


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.size = int(options.get("filespertask", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.paths[i : i + self.size]) for i in range(0, len(self.paths), self.size)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open_file(path) as stream:
                yield path, record_names(first_record(stream))


class HeaderSource(DataSource):
    """``format("csv_header")``: (file, names) of every file, from its first record alone."""

    @classmethod
    def name(cls) -> str:
        return "csv_header"

    def schema(self) -> str:
        return "file string, names array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HeaderReader(self.options)


def csv_headers(spark: SparkSession, paths, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """(file, names): the cells of each file's first record; none for an empty file or an empty first line.

    File systems that only Spark can open are read through its text source.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    # local paths as ``_metadata.file_path`` writes them, with one slash
    files = sorted(re.sub("^file:/+", "file:/", f) for f in spark.read.text(paths).inputFiles())
    if all(urlparse(f).scheme in OPENABLE for f in files):
        spark.dataSource.register(HeaderSource)
        return spark.read.format("csv_header").option("paths", json.dumps(files)).option("filesPerTask", files_per_task).load()
    cells = F.udf(record_names, "array<string>", useArrow=False)
    first = records(spark, paths).where("__ord = 0").select(F.col("__file").alias("file"), cells("record").alias("names"))
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.join(first, "file", "left").select("file", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def csv_header_table(spark: SparkSession, paths) -> DataFrame:
    """Header names of each CSV file: (file, ord, name), names trimmed, duplicates kept.

    A file without a header has one row, of null ``ord`` and ``name``.
    """
    exploded = csv_headers(spark, paths).select("file", F.posexplode_outer("names").alias("pos", "raw"))
    return exploded.select("file", (F.col("pos") + 1).alias("ord"), strip_blanks(F.col("raw")).alias("name"))


def column_names(names: list[str]) -> list[str]:
    """Header cells as column names: repeated ones get their position appended."""
    return [n if names.count(n) == 1 else f"{n}{i}" for i, n in enumerate(names)]


# ---------------------------------------------------------------------------
# records by quote parity
# ---------------------------------------------------------------------------


def _lines(spark: SparkSession, paths) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


class _SplitState:
    """What has been read of one split: lines, parity of its quotes, record ends for an even and an odd start."""

    def __init__(self):
        self.split = None
        self.restart(None)

    def restart(self, split) -> None:
        self.split, self.lines, self.parity, self.ends = split, 0, 0, [0, 0]

    def advance(self, values: pa.Array) -> dict[str, np.ndarray]:
        """Numbers of each line of a run of lines of this split, in file order."""
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.is_in(values, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        after = (self.parity + np.cumsum(quotes)) % 2
        before = np.concatenate([[self.parity], after[:-1]])
        line = self.lines + np.arange(len(quotes))
        out = {"line": line, "before": before, "after": after}
        for start in (0, 1):
            ends = ((after ^ start) == 0) & ~(blank & ((before ^ start) == 0))
            total = self.ends[start] + np.cumsum(ends)
            out[f"ends{start}"] = total - ends
            self.ends[start] = int(total[-1])
        self.lines, self.parity = int(line[-1]) + 1, int(after[-1])
        return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(split, start, stop) of the runs of consecutive lines of one split."""
    files = batch.column("__file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    blocks = batch.column("__block").to_numpy()
    cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield (batch.column("__file")[a].as_py(), int(blocks[a])), a, b


def _numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _SplitState()
    for batch in batches:
        for split, a, b in _runs(batch):
            if split != state.split:
                state.restart(split)
            part = batch.slice(a, b - a)
            made = state.advance(part.column("value"))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, pa.int64()) for v in made.values()]], names=[*part.schema.names, *made])


def _split_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["__file", "__block", "parity", "all0", "all1"]
    state = _SplitState()

    def fact() -> Iterator[pa.RecordBatch]:
        if state.split is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, [*state.split, state.parity, *state.ends], strict=True))])

    for batch in batches:
        for split, a, b in _runs(batch):
            if split != state.split:
                yield from fact()
                state.restart(split)
            state.advance(batch.column("value").slice(a, b - a))
    yield from fact()


def _split_starts(lines: DataFrame) -> DataFrame:
    """Per split: parity of the quotes before it and record ends before it in its file; per file: parity and record ends."""
    facts = lines.mapInArrow(_split_facts, "__file string, __block long, parity long, all0 long, all1 long")
    file = Window.partitionBy("__file")
    before = file.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("odd", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    facts = facts.withColumn("own", F.when(F.col("odd") == 0, F.col("all0")).otherwise(F.col("all1")))
    return facts.select(
        "__file", "__block", "odd",
        F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"),
        F.sum("own").over(file).alias("in_file"),
        (F.sum("parity").over(file) % 2).alias("file_odd"),
    )


def records(spark: SparkSession, paths) -> DataFrame:
    """(__file, __ord, record, closed): every record's text, numbered from 0 in its file; empty lines are none.

    A last record whose quotes never close is no record but so many lines:
    they come one by one, with its number and ``closed`` false, so that one
    stray quote gathers nothing.
    """
    lines = _lines(spark, paths)
    ddl = "value string, __file string, __block long, line long, before long, after long, ends0 long, ends1 long"
    starts = cut(_split_starts(lines))  # a row per split, computed once
    if starts.count() <= BROADCAST_SPLITS:  # the lines stay where they were read
        starts = F.broadcast(starts)
    placed = lines.mapInArrow(_numbered_lines, ddl).join(starts, ["__file", "__block"])
    at = F.when(F.col("odd") == 0, F.col("ends0")).otherwise(F.col("ends1")) + F.col("earlier")
    spans = (F.col("before") != F.col("odd")) | (F.col("after") != F.col("odd"))
    placed = placed.select(
        "__file", "__block", "line", "value", at.alias("__ord"), spans.alias("spans"), ((F.col("file_odd") == 1) & (at == F.col("in_file"))).alias("open")
    )
    bare = F.regexp_replace("value", "\r$", "")
    whole = placed.where(~F.col("spans") & (bare != "")).select("__file", "__ord", bare.alias("record"), F.lit(True).alias("closed"))
    alone = F.when(F.col("open"), F.struct("__block", "line"))  # lines after an unclosed quote are groups of their own
    joined = (
        placed.where("spans")
        .groupBy("__file", "__ord", "open", alone.alias("alone"))
        .agg(F.array_sort(F.collect_list(F.struct("__block", "line", "value"))).alias("parts"))
        .select("__file", "__ord", F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), "\r$", "").alias("record"), (~F.col("open")).alias("closed"))
    )
    return whole.unionByName(joined)


def read_records(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """Cells of all data records of ``files``, which share one header, with ``__malformed``, ``__file`` and ``__row``."""
    columns = column_names(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*columns, MALFORMED]])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(columns) + 1))}
    found = records(spark, [unquote(f) for f in files]).where("__ord > 0")  # listed as URIs, taken as paths
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
    cells = F.from_csv(F.when(F.col("closed"), F.col("record")), ddl, options)
    parsed = found.select(cells.alias("c"), "record", "closed", "__file", (F.col("__ord") + 1).alias("__row"))
    quoted = [f"`{n.replace('`', '``')}`" for n in columns]
    return parsed.select(
        *[F.col(f"c.{q}").alias(n) for q, n in zip(quoted, columns, strict=True)],
        F.when(F.col("closed"), F.col(f"c.`{MALFORMED}`")).otherwise(F.col("record")).alias(MALFORMED),
        "__file",
        "__row",
    )


def read_csv(spark: SparkSession, paths, dataset_id: str | None = None) -> DataFrame:
    """Observation CSVs as strings + ``__file`` and 1-based ``__row`` (header is row 1).

    RFC 4180: a doubled quote stands for one, a backslash for itself, quoted
    newlines stay inside their record; every file is read by as many tasks as
    it has splits. Files are read by groups of equal headers and united by
    column name, so another column order or a missing column moves no cell. A
    record with more or fewer cells than its header keeps its whole text in
    ``__malformed``, as do the lines of a record whose quotes never close. A
    file without a header has no records.
    """
    # one row per distinct header, each with the names of its files; Spark lists the files on the driver as well
    groups = csv_headers(spark, paths).where(F.size("names") > 0).groupBy("names").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    parts = [read_records(spark, g["files"], g["names"]) for g in sorted(groups, key=lambda g: g["names"])]
    if not parts:
        out = spark.createDataFrame([], f"{MALFORMED} string, __file string, __row long")
    else:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
    tail = [MALFORMED, "__file", "__row"]
    out = out.select(*[F.col(f"`{c}`") for c in out.columns if c not in tail], *tail)
    return out if dataset_id is None else out.withColumn("dataset_id", F.lit(dataset_id))
