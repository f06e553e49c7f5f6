"""Bulk operations over many dataset folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statgate.functions.scalars import dataset_id_from_folder

# File-name conventions of a dataset folder.
OUTPUT_TMCF_SUFFIX = "_output.tmcf"
OUTPUT_CSV_SUFFIX = "_output.csv"
STAT_VARS_SUFFIX = "_stat_vars.mcf"
STAT_VARS_SCHEMA_SUFFIX = "_stat_vars_schema.mcf"
VALIDATION_CONFIG_NAME = "validation_config.json"


def classify_folders(listing: DataFrame, root: str) -> DataFrame:
    """B1: one row per immediate child folder of ``root`` with its files or a rejection reason.

    Only direct children of a folder count (nested files and unrelated files
    are ignored); names compare case-insensitively.
    """
    prefix = root.rstrip("/") + "/"
    rel = F.expr(f"substring(path, {len(prefix) + 1})")
    f = listing.where(F.col("path").startswith(prefix)).select(rel.alias("rel"), "path", "size")
    f = f.where(F.col("rel").contains("/") & ~F.col("rel").endswith("/")).select(
        F.substring_index("rel", "/", 1).alias("folder"),
        F.expr("substring(rel, instr(rel, '/') + 1)").alias("base"),
        "path",
        "size",
    )
    direct = f.where(~F.col("base").contains("/")).select("folder", F.lower("base").alias("b"), "path", "size")
    # a name listed twice (any case) counts once, as a dict keyed by the lower-case name would
    direct = direct.groupBy("folder", "b").agg(F.max("path").alias("path"), F.max("size").alias("size"))
    b = F.col("b")
    kind = (
        F.when(b == VALIDATION_CONFIG_NAME, "config")
        .when(b.endswith(STAT_VARS_SCHEMA_SUFFIX) | (b == "stat_vars_schema.mcf"), "schema")
        .when(b.endswith(STAT_VARS_SUFFIX) | (b == "stat_vars.mcf"), "statvars")
        .when(b.endswith(OUTPUT_TMCF_SUFFIX), "tmcf")
        .when(b.endswith(OUTPUT_CSV_SUFFIX), "csv")
    )
    # only the files that take part in the classification are collected: a
    # folder holding millions of unrelated objects adds nothing to any list
    k = direct.withColumn("kind", kind).where(F.col("kind").isNotNull())

    def names(kd):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kd, b)))

    folders = f.select("folder").distinct()
    g = folders.join(k.groupBy("folder").agg(
        names("tmcf").alias("tmcfs"),
        names("csv").alias("csvs"),
        names("statvars").alias("statvars"),
        names("schema").alias("schemas"),
        F.max(F.when(F.col("kind") == "config", F.col("path"))).alias("config"),
        F.map_from_entries(F.collect_list(F.struct(b, F.col("path")))).alias("paths"),
    ), "folder", "left").select(
        "folder",
        *[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("tmcfs", "csvs", "statvars", "schemas")],
        "config",
        F.coalesce(F.col("paths"), F.create_map().cast("map<string,string>")).alias("paths"),
    )
    tmcf = F.try_element_at("tmcfs", F.lit(1))
    expected_csv = F.concat(F.expr("substring(try_element_at(tmcfs, 1), 1, length(try_element_at(tmcfs, 1)) - 5)"), F.lit(".csv"))
    csv_path = F.try_element_at(F.col("paths"), expected_csv)
    reason = (
        F.when(F.size("statvars") > 1, F.concat(F.lit("multiple *_stat_vars.mcf files ("), F.array_join("statvars", ", "), F.lit(")")))
        .when(F.size("schemas") > 1, F.concat(F.lit("multiple *_stat_vars_schema.mcf files ("), F.array_join("schemas", ", "), F.lit(")")))
        .when(F.size("tmcfs") == 0, F.lit("missing *_output.tmcf (exactly one required)"))
        .when(F.size("tmcfs") > 1, F.concat(F.lit("multiple *_output.tmcf files ("), F.array_join("tmcfs", ", "), F.lit(")")))
        .when(F.size("csvs") > 1, F.concat(F.lit("multiple *_output.csv files ("), F.array_join("csvs", ", "), F.lit(")")))
        .when(
            csv_path.isNull() & (F.size("csvs") > 0),
            F.concat(F.lit("no *_output.csv matching "), tmcf, F.lit(" (found "), F.try_element_at("csvs", F.lit(1)), F.lit(" instead)")),
        )
        .when(csv_path.isNull(), F.concat(F.lit("no matching *_output.csv for "), tmcf))
    )
    ok = reason.isNull()
    return g.select(
        "folder",
        F.when(ok, dataset_id_from_folder(F.col("folder"))).alias("dataset_id"),
        F.when(ok, csv_path).alias("csv"),
        F.when(ok, F.try_element_at(F.col("paths"), tmcf)).alias("tmcf"),
        F.when(ok, F.coalesce(F.try_element_at(F.col("paths"), F.try_element_at("statvars", F.lit(1))), F.lit(""))).alias("statvars"),
        F.when(ok, F.coalesce(F.try_element_at(F.col("paths"), F.try_element_at("schemas", F.lit(1))), F.lit(""))).alias("schema"),
        F.when(ok, F.coalesce(F.col("config"), F.lit(""))).alias("config"),
        reason.alias("reason"),
    )


def csv_bytes(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """B2: total bytes of each runnable dataset's CSV."""
    runnable = folders.where(F.col("reason").isNull()).select("folder", "dataset_id", F.col("csv").alias("path"))
    return runnable.join(listing.select("path", "size"), "path", "left").groupBy("folder", "dataset_id").agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("csv_total_bytes")
    )


def dedupe_datasets(folders: DataFrame) -> DataFrame:
    """First folder (by name) per dataset id is kept; later ones are skipped with a reason.

    The window is over runnable folders per id: one row per folder, so tiny.
    """
    w = Window.partitionBy("dataset_id").orderBy("folder")
    runnable = folders.where(F.col("reason").isNull()).withColumn("__rk", F.row_number().over(w))
    dup = F.col("__rk") > 1
    kept = runnable.select(
        *[c for c in folders.columns if c != "reason"],
        F.when(dup, F.concat(F.lit("duplicate dataset id '"), F.col("dataset_id"), F.lit("'"))).alias("reason"),
        F.when(dup, F.lit("skipped")).otherwise(F.lit("submit")).alias("action"),
    )
    skipped = folders.where(F.col("reason").isNotNull()).withColumn("action", F.lit("skipped"))
    return kept.unionByName(skipped)


def bulk_outcome(decisions: DataFrame, submitted: int | None = None) -> DataFrame:
    """Outcome code and message with found / submitted / skipped counts."""
    g = decisions.agg(
        F.count(F.lit(1)).cast("bigint").alias("found"),
        F.count_if(F.col("action") == "submit").cast("bigint").alias("runnable"),
        F.count_if(F.col("action") == "skipped").cast("bigint").alias("skipped"),
    )
    sub = F.col("runnable") if submitted is None else F.lit(submitted).cast("bigint")
    code = (
        F.when(F.col("found") == 0, F.lit("empty_root"))
        .when(sub > 0, F.lit("ok"))
        .when((F.col("runnable") == 0) & (F.col("skipped") > 0), F.lit("no_runnable"))
        .when(F.col("runnable") > 0, F.lit("submit_failed"))
        .otherwise(F.lit("no_runnable"))
    )
    message = (
        F.when(code == "empty_root", F.lit("No dataset folders found under this path."))
        .when(code == "ok", F.lit(""))
        .when(
            (code == "no_runnable") & (F.col("skipped") > 0),
            F.lit("No runnable dataset folders discovered. Every folder was skipped — see reasons below."),
        )
        .when(code == "submit_failed", F.lit("No jobs were submitted. Review per-dataset errors in the table below."))
        .otherwise(F.lit("No runnable dataset folders discovered."))
    )
    return g.select(code.alias("code"), message.alias("message"), "found", sub.alias("submitted"), "skipped")
