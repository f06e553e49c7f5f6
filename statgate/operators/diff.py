"""Baseline diff (D1-D9): classify observations against an accepted baseline.

D1 is one shuffle: both sides are unioned with a side flag and grouped by the
observation key; each side collapses to its sorted distinct values.
Baselines are versioned Parquet directories with an append-only manifest.
An accepted baseline lies in buckets of the observation key, with a digest and
the number of keys per bucket beside it. A later run sums up its own buckets
where its rows are read, and only buckets of unlike digests are compared: of
the others no row of the baseline is read and none of the run is moved.
"""

from __future__ import annotations

import datetime
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statgate.functions.scalars import is_blank, normalize_variable, strip_blanks, to_double

DIFF_KEY = ["StatVar", "observationAbout", "observationDate", "observationPeriod", "measurementMethod", "unit", "scalingFactor"]
BUCKET = "__bucket"
BUCKETS = 64  # of a baseline; more of them make a changed one smaller
SUMS = ("s0", "s1", "s2", "s3")  # of a digest
DIFF_SCHEMA = "dataset_id string, StatVar string, DELETED bigint, MODIFIED bigint, ADDED bigint"


def _keyed_columns() -> dict:
    """The columns of the observation key, normalised."""
    plain = {c: F.coalesce(strip_blanks(F.col(c)), F.lit("")) for c in DIFF_KEY[1:]}
    return {"StatVar": normalize_variable("variableMeasured"), **plain}


def _keyed(obs: DataFrame, side: str) -> DataFrame:
    return obs.select(
        "dataset_id",
        *[x.alias(c) for c, x in _keyed_columns().items()],
        F.lit(side).alias("side"),
        to_double("value").alias("num"),
        F.when(to_double("value").isNull() & ~is_blank(F.col("value")), strip_blanks(F.col("value"))).alias("txt"),
    )


def diff_observations(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Status per observation key: ADDED, DELETED, MODIFIED or SAME.

    Values compare as numbers when numeric (1 == 1.0, -0 == 0), else as trimmed
    text; a key is MODIFIED when its set of distinct values differs between
    the sides. Each (key, value) is first reduced to the sides it is on, by an
    aggregate whose grouping includes the value, so a hot key spreads over
    many tasks; a key differs if any of its values is on one side only.
    """
    return _status(_keyed(current, "cur").unionByName(_keyed(baseline, "base")))


def _value():
    """An observation's value as text that is equal for equal values; null without one."""
    return F.coalesce(F.concat(F.lit("n:"), (F.col("num") + F.lit(0.0)).cast("string")), F.concat(F.lit("t:"), F.col("txt")))


def _status(u: DataFrame) -> DataFrame:
    """D1 of keyed rows; the side is ``cur``, ``base`` or ``both``."""
    sides = u.groupBy("dataset_id", *DIFF_KEY, _value().alias("v")).agg(
        F.max((F.col("side") != "base").cast("int")).alias("cur"), F.max((F.col("side") != "cur").cast("int")).alias("base")
    )
    has_v = F.col("v").isNotNull()
    g = sides.groupBy("dataset_id", *DIFF_KEY).agg(
        F.max("cur").alias("in_cur"),
        F.max("base").alias("in_base"),
        F.count_if((F.col("cur") == 1) & has_v).alias("n_new"),
        F.count_if((F.col("base") == 1) & has_v).alias("n_old"),
        F.bool_or(has_v & (F.col("cur") != F.col("base"))).alias("differs"),
    )
    status = (
        F.when(F.col("in_base") == 0, F.lit("ADDED"))
        .when(F.col("in_cur") == 0, F.lit("DELETED"))
        .when(F.col("differs"), F.lit("MODIFIED"))
        .otherwise(F.lit("SAME"))
    )
    return g.select("dataset_id", *DIFF_KEY, status.alias("status"), F.col("n_old").cast("bigint"), F.col("n_new").cast("bigint"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Differ table per variable: StatVar, DELETED, MODIFIED, ADDED (changed variables only)."""
    g = diff.where(F.col("status") != "SAME").groupBy("dataset_id", "StatVar").agg(
        F.count_if(F.col("status") == "DELETED").cast("bigint").alias("DELETED"),
        F.count_if(F.col("status") == "MODIFIED").cast("bigint").alias("MODIFIED"),
        F.count_if(F.col("status") == "ADDED").cast("bigint").alias("ADDED"),
    )
    return g


def diff_sizes(diff: DataFrame) -> DataFrame:
    """D3: previous/current observation counts and the number of changed keys."""
    return diff.groupBy("dataset_id").agg(
        F.count_if(F.col("status") != "ADDED").cast("bigint").alias("previous_obs_size"),
        F.count_if(F.col("status") != "DELETED").cast("bigint").alias("current_obs_size"),
        F.count_if(F.col("status") != "SAME").cast("bigint").alias("obs_diff_size"),
        F.lit(False).alias("first_run"),
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    """Per (dataset, variable): DELETED, MODIFIED, ADDED and SAME key counts, from one pass over D1.

    Both the differ table (D2) and the sizes (D3) derive from this small table,
    so the diff itself is computed once.
    """
    return diff.groupBy("dataset_id", "StatVar").agg(
        *[F.count_if(F.col("status") == s).cast("bigint").alias(s) for s in ("DELETED", "MODIFIED", "ADDED", "SAME")]
    )


def differ_and_sizes(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(D2, D3) from ``diff_counts``."""
    differ = counts.where(F.col("DELETED") + F.col("MODIFIED") + F.col("ADDED") > 0).select(
        "dataset_id", "StatVar", "DELETED", "MODIFIED", "ADDED"
    )
    sizes = counts.groupBy("dataset_id").agg(
        F.sum(F.col("DELETED") + F.col("MODIFIED") + F.col("SAME")).cast("bigint").alias("previous_obs_size"),
        F.sum(F.col("ADDED") + F.col("MODIFIED") + F.col("SAME")).cast("bigint").alias("current_obs_size"),
        F.sum(F.col("DELETED") + F.col("MODIFIED") + F.col("ADDED")).cast("bigint").alias("obs_diff_size"),
        F.lit(False).alias("first_run"),
    )
    return differ, sizes


def change_totals(differ: DataFrame, sizes: DataFrame) -> DataFrame:
    """Totals, number of changed variables and round(modified / previous * 100, 1)."""
    t = differ.groupBy("dataset_id").agg(
        F.sum("DELETED").cast("bigint").alias("deleted"),
        F.sum("MODIFIED").cast("bigint").alias("modified"),
        F.sum("ADDED").cast("bigint").alias("added"),
        F.countDistinct("StatVar").cast("bigint").alias("n_statvars"),
    )
    j = t.join(sizes.select("dataset_id", "previous_obs_size"), "dataset_id", "left")
    pct = F.when(
        F.col("previous_obs_size") > 0,
        F.round(F.col("modified").cast("decimal(38,10)") * 100 / F.col("previous_obs_size").cast("decimal(38,10)"), 1),
    )
    return j.select("dataset_id", "deleted", "modified", "added", "n_statvars", pct.cast("decimal(10,1)").alias("modified_pct"))


def top_changed(differ: DataFrame, n: int = 10) -> DataFrame:
    """Top-n variables by total change (ties by name), 'dcid:' prefix removed."""
    total = F.coalesce(F.col("DELETED"), F.lit(0)) + F.coalesce(F.col("MODIFIED"), F.lit(0)) + F.coalesce(F.col("ADDED"), F.lit(0))
    t = differ.select(
        "dataset_id",
        F.regexp_replace("StatVar", "^dcid:", "").alias("name"),
        F.coalesce("DELETED", F.lit(0)).cast("bigint").alias("deleted"),
        F.coalesce("MODIFIED", F.lit(0)).cast("bigint").alias("modified"),
        F.coalesce("ADDED", F.lit(0)).cast("bigint").alias("added"),
        total.cast("bigint").alias("total"),
    ).where(F.col("total") > 0)
    # one row per variable; the rank window per dataset is over the changed variables only
    w = Window.partitionBy("dataset_id").orderBy(F.desc("total"), "name")
    return t.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


# ---------------------------------------------------------------------------
# Versioned baselines on a shared file system
# ---------------------------------------------------------------------------

MANIFEST_SCHEMA = "dataset_id string, version string, run_id string, updated_at string, path string, buckets int, row_schema string"


def _manifest_dir(root: str, dataset_id: str) -> str:
    return f"{root.rstrip('/')}/{dataset_id}/_manifest"


def baseline_versions(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Accepted versions, newest first by numeric version. Only a missing manifest means that there are none."""
    path = _manifest_dir(root, dataset_id)
    try:
        m = spark.read.schema(MANIFEST_SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return m.orderBy(F.substring("version", 2, 20).cast("int").desc())


def _newest(spark: SparkSession, root: str, dataset_id: str):
    """The newest entry of the manifest, or None."""
    rows = baseline_versions(spark, root, dataset_id).limit(1).collect()  # at most one manifest row
    return rows[0] if rows else None


def _rows_of(spark: SparkSession, entry) -> DataFrame:
    """The observations of a version, with their bucket if it has buckets."""
    if entry["buckets"] is None:
        return spark.read.parquet(entry["path"])
    # the schema is given, for a version without rows has no file to take it from
    return spark.read.schema(T.StructType.fromJson(json.loads(entry["row_schema"])).add(BUCKET, T.IntegerType())).parquet(entry["path"])


def latest_baseline(spark: SparkSession, root: str, dataset_id: str) -> DataFrame | None:
    """The observations of the newest version, or None on a first run."""
    entry = _newest(spark, root, dataset_id)
    return None if entry is None else _rows_of(spark, entry).drop(BUCKET)


def _bucketed(obs: DataFrame, side: str, buckets: int) -> DataFrame:
    """Keyed rows with the bucket of their key."""
    return _keyed(obs, side).withColumn(BUCKET, F.pmod(F.xxhash64(*DIFF_KEY), F.lit(buckets)).cast("int"))


def bucket_digests(obs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per bucket the number of observations and four sums over 60-bit pieces of the SHA-256 of (key, value).

    Sums don't depend on the order of rows, so every task adds up its own rows
    and only a row per bucket is moved. Buckets of equal digests hold the same
    observations, as D1 compares them, the same number of times each.
    """
    hashed = _bucketed(obs, "cur", buckets).select(BUCKET, F.sha2(F.to_json(F.struct(*DIFF_KEY, _value().alias("v"))), 256).alias("h"))
    pieces = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(len(SUMS))]
    return hashed.groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).cast("decimal(38,0)").alias(s) for x, s in zip(pieces, SUMS, strict=True)]
    )


def _changed_buckets(current: DataFrame, entry) -> list[int]:
    """The buckets whose digest differs between the run and the version, or that only one of them has."""
    then = current.sparkSession.read.parquet(f"{entry['path']}-digests")
    both = bucket_digests(current, entry["buckets"]).unionByName(then).groupBy(BUCKET, "n", *SUMS).count()
    return sorted(r[0] for r in both.where(F.col("count") == 1).select(BUCKET).distinct().collect())  # as many as there are buckets at most


def _changed_diff(current: DataFrame, entry, changed: list[int]) -> DataFrame:
    """D1 of the changed buckets; the scan of the version is cut to their folders."""
    rows = _rows_of(current.sparkSession, entry).where(F.col(BUCKET).isin(changed)).drop(BUCKET)
    mine = _bucketed(current, "cur", entry["buckets"]).where(F.col(BUCKET).isin(changed)).drop(BUCKET)
    return _status(mine.unionByName(_keyed(rows, "base")))


def incremental_diff(current: DataFrame, root: str, dataset_id: str) -> DataFrame | None:
    """D1 against the newest version, or None on a first run; only changed buckets of the version are read.

    In an unchanged bucket the run's own rows stand for both sides.
    """
    spark = current.sparkSession
    current = current.where(F.col("dataset_id") == dataset_id)
    entry = _newest(spark, root, dataset_id)
    if entry is None:
        return None
    if entry["buckets"] is None:
        return diff_observations(current, _rows_of(spark, entry))
    changed = _changed_buckets(current, entry)
    same = _bucketed(current, "both", entry["buckets"]).where(~F.col(BUCKET).isin(changed)).drop(BUCKET)
    return _status(same).unionByName(_changed_diff(current, entry, changed))


def incremental_counts(current: DataFrame, entry) -> DataFrame:
    """``diff_counts`` against a version: D1 of the changed buckets, the numbers of keys kept beside the version for the others."""
    changed = _changed_buckets(current, entry)
    kept = current.sparkSession.read.parquet(f"{entry['path']}-keys").where(~F.col(BUCKET).isin(changed))
    none = F.lit(0).cast("bigint")
    unchanged = kept.select("dataset_id", "StatVar", none.alias("DELETED"), none.alias("MODIFIED"), none.alias("ADDED"), F.col("n_keys").alias("SAME"))
    counts = unchanged.unionByName(diff_counts(_changed_diff(current, entry, changed)))
    return counts.groupBy("dataset_id", "StatVar").agg(*[F.sum(s).alias(s) for s in ("DELETED", "MODIFIED", "ADDED", "SAME")])


def _write_bucketed(obs: DataFrame, path: str, buckets: int) -> None:
    """The rows in a folder per bucket, and their digests and numbers of keys beside them.

    Rebalancing lets adaptive execution split a bucket that a hot key makes
    large and join small ones.
    """
    spark = obs.sparkSession
    key = _keyed_columns()
    placed = obs.withColumn(BUCKET, F.pmod(F.xxhash64(*[key[c] for c in DIFF_KEY]), F.lit(buckets)).cast("int"))
    placed.hint("rebalance", F.col(BUCKET)).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
    rows = spark.read.schema(obs.schema).parquet(path)
    bucket_digests(rows, buckets).coalesce(1).write.mode("errorifexists").parquet(f"{path}-digests")
    keys = _bucketed(rows, "base", buckets).groupBy("dataset_id", BUCKET, *DIFF_KEY).agg(F.lit(1))
    keys = keys.groupBy("dataset_id", BUCKET, "StatVar").agg(F.count(F.lit(1)).alias("n_keys"))
    keys.write.mode("errorifexists").parquet(f"{path}-keys")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write ``path`` unless it is there already; False if it is. Of writers at one time only one succeeds."""
    folder, _, name = path.rpartition("/")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and writes then; the kernel does both at once
        try:
            descriptor = os.open(f"{place.toUri().getPath()}/{name}", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(descriptor, "w", encoding="utf-8") as f:
            f.write(text)
        return True
    try:
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(path), False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    return True


def accept_baseline(obs: DataFrame, root: str, dataset_id: str, run_id: str, blocked: bool, buckets: int = BUCKETS) -> str | None:
    """D6 + D9: write the run's observations, then add them to the manifest as the next version.

    Refused (returns None) when the run is blocked or already the newest
    version. Observations go to a folder of their own, and a version is an
    entry of the manifest that is only made if there is none of its number, so
    a reader never sees incomplete data and two runs accepted at one time
    become two versions, the later one on top of the other. Rows that lack
    columns of the observation key are kept without buckets.
    """
    if blocked:
        return None
    spark = obs.sparkSession

    def newest() -> tuple[int, str | None]:
        top = _newest(spark, root, dataset_id)
        return (int(top["version"][1:]), top["run_id"]) if top else (0, None)

    if newest()[1] == run_id:
        return None
    path = f"{root.rstrip('/')}/{dataset_id}/data-{uuid.uuid4().hex}"
    rows = obs.where(F.col("dataset_id") == dataset_id).drop(BUCKET)
    keyed = {"variableMeasured", "value", *DIFF_KEY[1:]} <= set(obs.columns)
    if keyed:
        _write_bucketed(rows, path, buckets)
    else:
        rows.write.mode("errorifexists").parquet(path)
    while True:
        n, run = newest()
        if run == run_id:  # the same run was accepted meanwhile
            return None
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        entry = {"dataset_id": dataset_id, "version": f"v{n + 1}", "run_id": run_id, "updated_at": now, "path": path}
        if keyed:
            entry |= {"buckets": buckets, "row_schema": rows.schema.json()}
        if put_if_absent(spark, f"{_manifest_dir(root, dataset_id)}/{n + 1:09d}.json", json.dumps(entry) + "\n"):
            return f"v{n + 1}"


def empty_differ(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DIFF_SCHEMA)


def diff_or_first_run(current: DataFrame, root: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """(differ, sizes); with no baseline an empty typed differ and ``first_run`` sizes."""
    spark = current.sparkSession
    current = current.where(F.col("dataset_id") == dataset_id)
    entry = _newest(spark, root, dataset_id)
    if entry is None:
        sizes = current.select("dataset_id").distinct().select(
            "dataset_id",
            F.lit(None).cast("bigint").alias("previous_obs_size"),
            F.lit(None).cast("bigint").alias("current_obs_size"),
            F.lit(None).cast("bigint").alias("obs_diff_size"),
            F.lit(True).alias("first_run"),
        )
        return empty_differ(spark), sizes
    if entry["buckets"] is None:
        return differ_and_sizes(diff_counts(diff_observations(current, _rows_of(spark, entry))))
    return differ_and_sizes(incremental_counts(current, entry))
