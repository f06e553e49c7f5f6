"""Sinks (S7-S11): results, quality details, CSV shards, advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statgate.operators.quality import META, shard_assign, source_key
from statgate.session import cut


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rule results as JSON lines, one directory per dataset."""
    results.write.mode(mode).partitionBy("dataset_id").json(path)


def write_quality(details: DataFrame, path: str, non_numeric: DataFrame | None = None, mode: str = "overwrite") -> None:
    """CSV-quality details per file; the complete list of non-numeric records (``non_numeric_rows``) as a table beside them."""
    details.write.mode(mode).json(f"{path}/files" if non_numeric is not None else path)
    if non_numeric is not None:
        non_numeric.write.mode(mode).json(f"{path}/non_numeric_rows")


TASK_ROWS = 500_000


def shard_tasks(shards: int, rows_per_shard: int, partitions: int) -> int:
    """Tasks that write the shards: one each up to the shuffle's partitions, beyond that as many as ``TASK_ROWS`` rows a task ask for."""
    return min(shards, max(partitions, -(-shards * rows_per_shard // TASK_ROWS)))


def write_shards(
    csv: DataFrame, out_dir: str, rows_per_shard: int, columns: list[str] | None = None, mode: str = "overwrite", root: str = ""
) -> None:
    """Size-bounded CSV shards, each with its header, one directory per dataset, source file and shard number.

    A source is named by its path below ``root``, so files of one base name in
    several folders keep apart. Every shard has a file of its own: by its number
    among all shards, from the row counts of the files before it, it goes whole
    to one task, which takes a run of shards and writes them one after another,
    each in the order of its rows. So many small shards cost no task each.
    """
    cols = columns or [c for c in csv.columns if c not in META]
    sizes = csv.groupBy("dataset_id", "__file").agg(F.count(F.lit(1)).alias("n"))  # one row per file
    sizes = cut(sizes.withColumn("shards", F.ceil(F.col("n") / rows_per_shard)))
    total = sizes.agg(F.sum("shards")).first()[0]
    if not total:
        return
    # files by the thousand are summed first, so that no window holds more
    group = F.pmod(F.xxhash64("dataset_id", "__file"), F.lit(4096))
    of_group = sizes.withColumn("g", group).groupBy("g").agg(F.sum("shards").alias("s"))
    running = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    of_group = of_group.select("g", F.coalesce(F.sum("s").over(running), F.lit(0)).alias("g_first"))
    inside = Window.partitionBy("g").orderBy("dataset_id", "__file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("g", group).withColumn("first", F.coalesce(F.sum("shards").over(inside), F.lit(0))).join(of_group, "g")
    # names as the manifest writes them, from the table of files; never null, empty or a literal of ``csv``,
    # for then the plan holds another sort for the writer, without the rows' order
    def key(name: Column) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))

    d, f = key(source_key(F.col("dataset_id"))).alias("__d"), key(source_key(F.col("__file"), root)).alias("__f")
    firsts = firsts.select("dataset_id", "__file", d, f, (F.col("first") + F.col("g_first")).alias("__first"))
    s = shard_assign(csv, rows_per_shard).join(firsts, ["dataset_id", "__file"])
    # 'source' keys would clash with the columns of the file
    place = (F.col("__first") + F.col("shard")).cast("int").alias("__place")
    rows = s.select("__d", "__f", F.col("shard").alias("__s"), "__row", place, *[F.col(f"`{c}`").alias(f"c_{c}") for c in cols])
    tasks = shard_tasks(int(total), rows_per_shard, int(csv.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    task = F.floor(F.col("__place") * F.lit(tasks).cast("bigint") / F.lit(int(total))).cast("int")
    rows = rows.withColumn("__task", task).repartitionById(tasks, "__task").sortWithinPartitions("__d", "__f", "__s", "__row")
    named = rows.select(
        *[F.col(f"`c_{c}`").alias(c) for c in cols], F.col("__d").alias("dataset_id"), F.col("__f").alias("file"), F.col("__s").alias("shard")
    )
    named.write.mode(mode).partitionBy("dataset_id", "file", "shard").option("header", True).option("escape", '"').csv(out_dir)


# The columns of the advisory export, in its order.
ADVISORY_COLUMNS = [
    "type", "severity", "rule_id", "file", "line", "statvar", "place_id", "period", "previous_value", "current_value",
    "percent_change", "series_points", "message", "details", "source_file", "dataset", "run_id", "expected_from_source", "notes",
]


def write_advisories(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Combined advisory export (19 columns, empty text where there is nothing) as CSV with a header."""
    df.select(*ADVISORY_COLUMNS).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """The export as text; what is empty in the file is empty text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).na.fill("")
