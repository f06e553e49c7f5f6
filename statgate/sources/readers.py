"""Sources (S2, S4, S5, S6, S12; S1 is in ``csv_files``): files -> DataFrames.

Record numbers are computed without a single-partition window: every file
split is read in order by one task, so ``monotonically_increasing_id`` is
consecutive inside a split; a tiny per-split table (one row per split) gives
each split its offset in the file, and a broadcast join applies it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statgate.functions.scalars import strip_blanks
from statgate.sources.csv_files import MALFORMED, csv_header_table, csv_headers, read_csv  # noqa: F401


def with_row_index(df: DataFrame, order_by: list[str], bucket: Column, start: int = 1, name: str = "__row") -> DataFrame:
    """Add the position of each row in the order of ``order_by``, lazily.

    ``bucket`` is a number that does not fall along that order (a coarsened
    leading key). Rows are numbered inside their bucket; the rows of earlier
    buckets come from counts per bucket, summed in two levels, so no task sees
    more than a bucket, or the counts of a few thousand.
    """
    order = [F.col(c).asc_nulls_first() for c in order_by]
    b = F.coalesce(bucket.cast("bigint"), F.lit(-(2**62)))
    rows = df.withColumn("__b", b)
    counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__hi", F.expr("__b div 4096"))
    running = Window.orderBy("__hi").rowsBetween(Window.unboundedPreceding, -1)
    high = counts.groupBy("__hi").agg(F.sum("__n").alias("__n")).select("__hi", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__off_hi"))
    within = Window.partitionBy("__hi").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(high, "__hi")
    offsets = offsets.select("__b", (F.col("__off") + F.col("__off_hi")).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return rows.withColumn("__in", inside).join(offsets, "__b").withColumn(name, F.col("__in") + F.col("__off") + F.lit(start - 1)).drop("__b", "__in", "__off")


def _file_offsets(tagged: DataFrame, count_col: Column | None = None) -> DataFrame:
    """Per (file, split): first id in the split and the number of units before it in the file."""
    n = count_col if count_col is not None else F.lit(1)
    splits = tagged.groupBy("__file", "__block").agg(F.min("__mid").alias("__m0"), F.sum(n).alias("__n"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("__file", "__block", "__m0", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))


def read_lines(spark: SparkSession, paths, line_sep: str | None = None) -> DataFrame:
    """Text records with ``__file`` and their 1-based line number in the file.

    With ``line_sep`` a record may span several physical lines; its line number
    is the first physical line, computed from the line counts of earlier records.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    raw = reader.text(paths)
    tagged = raw.select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__mid"),
    )
    if not line_sep:
        offsets = _file_offsets(tagged)
        return tagged.join(offsets, ["__file", "__block"]).select(
            "value", "__file", (F.col("__mid") - F.col("__m0") + F.col("__off") + F.lit(1)).alias("__line")
        )
    # lines a record spans = newlines inside it + the separator's own newline
    extra_lines = line_sep.count("\n")
    nl = F.size(F.split(F.col("value"), "\n")) - 1 + F.lit(extra_lines)
    tagged = tagged.withColumn("__nl", nl)
    offsets = _file_offsets(tagged, F.col("__nl"))
    # running line count inside a split: bounded by the split size (maxPartitionBytes)
    within = Window.partitionBy("__file", "__block").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(offsets, ["__file", "__block"])
        .withColumn("__before", F.coalesce(F.sum("__nl").over(within), F.lit(0)))
        .select("value", "__file", (F.col("__off") + F.col("__before") + F.lit(1)).alias("__line"))
    )


NODE_SEPARATOR = "\nNode:"


def read_nodes(spark: SparkSession, paths, dataset_id: str = "") -> DataFrame:
    """Template / node files -> triples (dataset_id, file, node_line, node, prop, value, prop_line).

    Records are split at a line starting with 'Node:', so a large node file is
    parsed by many tasks. Inside a record, a line whose stripped text starts
    with 'node:' in any case (say, an indented header) opens a further node; lines before the
    first header (a leading comment block) belong to no node and are dropped.
    ``#`` starts a comment, a ``key: value`` line splits at the first colon,
    surrounding quotes are dropped. The window that tracks the current header
    runs inside one record, so it is bounded by a node's size.
    """
    recs = read_lines(spark, paths, line_sep=NODE_SEPARATOR)
    lines = recs.select("__file", "__line", F.posexplode(F.split(F.col("value"), "\n")).alias("i", "text"))
    clean = strip_blanks(F.regexp_replace(F.col("text"), "#.*$", ""))
    # a record after the first one lost its 'Node:' to the separator: its line 0 is a header
    cut_header = (F.col("i") == 0) & (F.col("__line") > 1)
    text_header = F.lower(clean).startswith("node:")
    is_hdr = cut_header | text_header
    name = F.when(cut_header, clean).when(text_header, strip_blanks(F.expr("substring(text, instr(lower(text), 'node:') + 5)")))
    w = Window.partitionBy("__file", "__line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.select(
        "__file", "__line", "i", "text", clean.alias("clean"), is_hdr.alias("hdr"),
        strip_blanks(F.regexp_replace(name, "#.*$", "")).alias("name"),
    ).withColumn("node_i", F.max(F.when(F.col("hdr"), F.col("i"))).over(w))
    tagged = tagged.where(F.col("node_i").isNotNull())
    unquote = lambda c: F.replace(F.regexp_replace(c, r'^"(.*)"$', "$1"), F.lit('\\"'), F.lit('"'))
    nodes = tagged.where("hdr").select("__file", "__line", "node_i", unquote(F.col("name")).alias("node"))
    props = tagged.where(~F.col("hdr") & (F.col("clean") != "") & F.col("clean").contains(":")).select(
        "__file",
        "__line",
        "node_i",
        "i",
        strip_blanks(F.substring_index(F.col("clean"), ":", 1)).alias("prop"),
        unquote(strip_blanks(F.expr("substring(regexp_replace(text, '#.*$', ''), instr(regexp_replace(text, '#.*$', ''), ':') + 1)"))).alias(
            "value"
        ),
    )
    return props.join(nodes, ["__file", "__line", "node_i"]).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.col("__file").alias("file"),
        (F.col("__line") + F.col("node_i")).alias("node_line"),
        "node",
        "prop",
        "value",
        (F.col("__line") + F.col("i")).alias("prop_line"),
    )


def count_observation_nodes(nodes: DataFrame) -> DataFrame:
    """Per dataset, nodes whose typeOf contains StatVarObservation."""
    return (
        nodes.where((F.col("prop") == "typeOf") & F.col("value").contains("StatVarObservation"))
        .groupBy("dataset_id")
        .agg(F.countDistinct("file", "node_line").alias("observation_nodes"))
    )


# Lint report schema (the values inside problem points may be scalars or structs,
# so they are read as raw JSON text).
_LOCATION = T.StructType([T.StructField("file", T.StringType()), T.StructField("lineNumber", T.StringType())])
LINT_REPORT_SCHEMA = T.StructType(
    [
        T.StructField(
            "levelSummary",
            T.MapType(T.StringType(), T.StructType([T.StructField("counters", T.MapType(T.StringType(), T.StringType()))])),
        ),
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("level", T.StringType()),
                        T.StructField("counterKey", T.StringType()),
                        T.StructField("counter", T.StringType()),
                        T.StructField("levelSummary", T.StringType()),
                        T.StructField("userMessage", T.StringType()),
                        T.StructField("location", _LOCATION),
                    ]
                )
            ),
        ),
        T.StructField(
            "statsCheckSummary",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("placeDcid", T.StringType()),
                        T.StructField("observationAbout", T.StringType()),
                        T.StructField("statVarDcid", T.StringType()),
                        T.StructField("observationPeriod", T.StringType()),
                        T.StructField("scalingFactor", T.StringType()),
                        T.StructField(
                            "validationCounters",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("counterKey", T.StringType()),
                                        T.StructField("percentDifference", T.StringType()),
                                        T.StructField("additionalDetails", T.StringType()),
                                        T.StructField("problemPoints", T.ArrayType(T.StringType())),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
        T.StructField(
            "commandArgs",
            T.StructType(
                [
                    T.StructField("inputFiles", T.ArrayType(T.StringType())),
                    T.StructField("existenceChecks", T.BooleanType()),
                    T.StructField("resolution", T.StringType()),
                ]
            ),
        ),
    ]
)


def read_lint_report(spark: SparkSession, paths, dataset_id: str = "") -> dict[str, DataFrame]:
    """Nested lint report -> {'counters', 'entries', 'points'} flat tables."""
    rep = spark.read.schema(LINT_REPORT_SCHEMA).option("multiLine", True).json(paths)
    rep = rep.withColumn("dataset_id", F.lit(dataset_id))
    counters = (
        rep.select("dataset_id", F.explode("levelSummary").alias("level", "s"))
        .select("dataset_id", "level", F.explode("s.counters").alias("counterKey", "count"))
    )
    entries = rep.select("dataset_id", F.explode("entries").alias("e")).select(
        "dataset_id",
        F.coalesce(F.nullif(F.col("e.level"), F.lit("")), F.col("e.levelSummary")).alias("level"),
        F.col("e.counterKey").alias("counterKey"),
        F.col("e.counter").alias("counter"),
        F.col("e.userMessage").alias("userMessage"),
        F.col("e.location.file").alias("file"),
        F.col("e.location.lineNumber").alias("lineNumber"),
    )
    series = rep.select("dataset_id", F.posexplode("statsCheckSummary").alias("item_ord", "s"))
    counters_per_item = series.select(
        "dataset_id",
        "item_ord",
        F.coalesce(F.nullif(F.col("s.placeDcid"), F.lit("")), F.col("s.observationAbout"), F.lit("")).alias("placeDcid"),
        F.col("s.statVarDcid").alias("statVarDcid"),
        F.coalesce(F.col("s.observationPeriod"), F.lit("")).alias("observationPeriod"),
        F.posexplode_outer("s.validationCounters").alias("counter_ord", "vc"),
    )
    points = counters_per_item.select(
        "dataset_id",
        "item_ord",
        "placeDcid",
        "statVarDcid",
        "observationPeriod",
        "counter_ord",
        F.col("vc.counterKey").alias("counterKey"),
        F.col("vc.percentDifference").try_cast("double").alias("percentDifference"),
        F.explode_outer("vc.problemPoints").alias("pt"),
    ).select(
        "dataset_id",
        "item_ord",
        "placeDcid",
        "statVarDcid",
        "observationPeriod",
        "counter_ord",
        "counterKey",
        "percentDifference",
        F.get_json_object("pt", "$.date").alias("date"),
        # a value may be a scalar or {"value": ...}
        F.coalesce(
            F.get_json_object("pt", "$.values[0].value.value"), F.get_json_object("pt", "$.values[0].value")
        ).alias("value"),
        F.coalesce(F.get_json_object("pt", "$.values[0].scalingFactor"), F.get_json_object("pt", "$.scalingFactor")).alias("scalingFactor"),
        F.coalesce(F.get_json_object("pt", "$.values[0].unit"), F.get_json_object("pt", "$.unit")).alias("unit"),
        F.from_json(F.get_json_object("pt", "$.values[0].locations"), "array<struct<file string, lineNumber string>>").alias("locations"),
    )
    return {"counters": counters, "entries": entries, "points": points, "report": rep}


def read_goldens(spark: SparkSession, paths, fmt: str = "csv") -> DataFrame:
    """Golden (expected) records, every column as a trimmed string."""
    df = spark.read.option("header", True).csv(paths) if fmt == "csv" else spark.read.parquet(paths)
    return df.select(*[strip_blanks(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def list_objects(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """The objects directly under ``root`` (or, if ``recursive``, at any depth) as (path, size); contents are not read.

    Without ``recursive`` one listing of the root's own folder is asked for, so
    folders below it cost nothing, whatever their names.
    """
    if recursive:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return found.select("path", F.col("length").alias("size"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    children = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(folder)
    rows = []
    while children.hasNext():
        child = children.next()
        if child.isFile():
            rows.append((child.getPath().toString(), child.getLen()))
    return spark.createDataFrame(rows, "path string, size long")


OBSERVATION_PROPS = [
    "observationAbout", "observationDate", "variableMeasured", "value",
    "unit", "measurementMethod", "observationPeriod", "scalingFactor",
]
_COLUMN_REF = r"^C:[^>]+->(.+)$"


def observations(csv: DataFrame, template: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """S3: apply a template to a CSV: one ``select`` per observation node, ``unionByName``.

    Each property is a column reference (``C:table->column``) or a literal.
    The template is a handful of triples per dataset (configuration-sized),
    so it is read on the driver to build the projections; the CSV itself is
    only ever projected, never collected.
    """
    rows = (
        template.where(F.col("prop").isin("typeOf", *OBSERVATION_PROPS))
        .select("file", "node_line", "prop", "value")
        .collect()  # template triples only (a few per node, a few nodes per template)
    )
    nodes: dict[tuple, dict[str, str]] = {}
    for r in rows:
        nodes.setdefault((r["file"], r["node_line"]), {})[r["prop"]] = r["value"]
    parts = []
    for key in sorted(nodes):
        props = nodes[key]
        if "statvarobservation" not in (props.get("typeOf") or "").lower():
            continue
        cols = []
        for p in OBSERVATION_PROPS:
            v = (props.get(p) or "").strip()
            m = re.match(_COLUMN_REF, v)
            if m:
                cols.append(F.col(f"`{m.group(1).strip()}`").cast("string").alias(p))
            else:
                cols.append(F.lit(v).alias(p))
        ds = F.lit(dataset_id) if dataset_id is not None else F.col("dataset_id")
        parts.append(csv.select(ds.alias("dataset_id"), *cols, F.col("__file"), F.col("__row")))
    if not parts:
        schema = ", ".join(f"{c} string" for c in ["dataset_id", *OBSERVATION_PROPS, "__file"]) + ", __row bigint"
        return csv.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
