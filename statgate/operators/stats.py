"""Statistics and counters.

``dataset_id`` leads every grouping so one job summarises many datasets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statgate.functions.scalars import (
    CONCEPT_KEYWORDS,
    concepts_found,
    is_blank,
    normalize_variable,
    render_list,
    strip_blanks,
    to_double,
)

STATS_COLUMNS = [
    "StatVar", "NumPlaces", "NumObservations", "MinValue", "MaxValue", "NumObservationsDates",
    "MinDate", "MaxDate", "MeasurementMethods", "Units", "ScalingFactors", "observationPeriods",
]

# Resolution diagnostics prefix and level order of the lint report.
RESOLUTION_PREFIX = "Existence_FailedDcCall_"
LEVEL_ORDER = ["LEVEL_FATAL", "LEVEL_ERROR", "LEVEL_WARNING", "LEVEL_INFO"]
KEY_COUNTERS = ["NumRowSuccesses", "NumNodeSuccesses", "NumPVSuccesses"]


def _nonblank(c):
    return F.when(~is_blank(c), strip_blanks(c))


def variable_summary(obs: DataFrame, approx: bool = False) -> DataFrame:
    """A1: one row per (dataset_id, variable) with the 12 summary columns.

    Non-numeric values are counted in NumObservations but ignored for
    Min/MaxValue; blank unit/method/factor/period are left out of the lists.
    Distinct counts are exact by default (Spark expands rows once per distinct
    aggregate, after column pruning); ``approx=True`` uses HyperLogLog.
    """
    o = obs.select(
        "dataset_id",
        normalize_variable("variableMeasured").alias("StatVar"),
        "observationAbout",
        "observationDate",
        to_double("value").alias("v"),
        _nonblank(F.col("measurementMethod")).alias("m"),
        _nonblank(F.col("unit")).alias("u"),
        _nonblank(F.col("scalingFactor")).alias("s"),
        _nonblank(F.col("observationPeriod")).alias("p"),
    )
    distinct = F.approx_count_distinct if approx else F.countDistinct
    return o.groupBy("dataset_id", "StatVar").agg(
        distinct("observationAbout").cast("bigint").alias("NumPlaces"),
        F.count(F.lit(1)).cast("bigint").alias("NumObservations"),
        F.min("v").alias("MinValue"),
        F.max("v").alias("MaxValue"),
        distinct("observationDate").cast("bigint").alias("NumObservationsDates"),
        F.min("observationDate").alias("MinDate"),
        F.max("observationDate").alias("MaxDate"),
        render_list(F.collect_set("m")).alias("MeasurementMethods"),
        render_list(F.collect_set("u")).alias("Units"),
        render_list(F.collect_set("s")).alias("ScalingFactors"),
        render_list(F.collect_set("p")).alias("observationPeriods"),
    )


def _year_only_to_jan1(c):
    return F.when(c.rlike(r"^[0-9]{4}$"), F.concat(c, F.lit("-01-01"))).otherwise(c)


def normalize_year_only(stats: DataFrame) -> DataFrame:
    """A2: MinDate/MaxDate 'YYYY' -> 'YYYY-01-01'."""
    return stats.withColumn("MinDate", _year_only_to_jan1(F.col("MinDate"))).withColumn(
        "MaxDate", _year_only_to_jan1(F.col("MaxDate"))
    )


def _digit_count(c="count"):
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.rlike(r"^[0-9]+$"), col.cast("bigint"))


def lint_totals(counters: DataFrame) -> DataFrame:
    """A3: per dataset and level, sum of counters whose count is a digit string."""
    return counters.groupBy("dataset_id", "level").agg(
        F.coalesce(F.sum(_digit_count()), F.lit(0)).cast("bigint").alias("total")
    )


def counter_breakdown(counters: DataFrame) -> DataFrame:
    """A4: every counter with level rank, group (structural/resolution for errors) and order."""
    level_rank = F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), F.col("level"))
    grp = (
        F.when(F.col("level") != "LEVEL_ERROR", F.lit("all"))
        .when(F.col("counterKey").startswith(RESOLUTION_PREFIX), F.lit("resolution"))
        .otherwise(F.lit("structural"))
    )
    return counters.where(F.col("level").isin(*LEVEL_ORDER)).select(
        "dataset_id",
        "level",
        level_rank.cast("int").alias("level_rank"),
        grp.alias("grp"),
        "counterKey",
        F.col("count"),
        F.coalesce(_digit_count(), F.lit(0)).alias("count_num"),
    ).orderBy("dataset_id", "level_rank", F.desc("count_num"), "counterKey")


def structural_lint_count(counters: DataFrame) -> DataFrame:
    """A5: sum of LEVEL_ERROR counters not starting with the resolution prefix.

    Unlike A3, every count is summed (a non-digit count becomes NULL and is skipped by sum).
    """
    return (
        counters.where((F.col("level") == "LEVEL_ERROR") & ~F.col("counterKey").startswith(RESOLUTION_PREFIX))
        .groupBy("dataset_id")
        .agg(F.coalesce(F.sum(F.col("count").try_cast("bigint")), F.lit(0)).cast("bigint").alias("n"))
    )


def lint_warnings(entries: DataFrame) -> DataFrame:
    """Warning entries by key (resolution keys dropped), count desc then key; ``counter`` stands in for an absent key."""
    level = strip_blanks(F.col("level"))
    key = F.nullif(F.col("counterKey"), F.lit(""))
    if "counter" in entries.columns:
        key = F.coalesce(key, F.nullif(F.col("counter"), F.lit("")))
    return (
        entries.where(level.isin("LEVEL_WARNING", "WARNING"))
        .withColumn("key", key)
        .where(F.col("key").isNotNull() & ~F.col("key").startswith(RESOLUTION_PREFIX))
        .groupBy("dataset_id", "key")
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
        .orderBy("dataset_id", F.desc("count"), "key")
    )


def lint_errors(counters: DataFrame) -> DataFrame:
    """LEVEL_ERROR counters without resolution keys, count desc then key."""
    return (
        counters.where((F.col("level") == "LEVEL_ERROR") & ~F.col("counterKey").startswith(RESOLUTION_PREFIX))
        .select("dataset_id", F.col("counterKey").alias("key"), F.col("count").try_cast("bigint").alias("count"))
        .orderBy("dataset_id", F.desc("count"), "key")
    )


def counters_match(stats: DataFrame, counters: DataFrame) -> DataFrame:
    """sum(NumObservations) == NumNodeSuccesses of LEVEL_INFO; missing counter -> skipped (ok), no number -> error."""
    actual = stats.groupBy("dataset_id").agg(F.sum("NumObservations").cast("bigint").alias("actual"))
    expected = (
        counters.where((F.col("counterKey") == "NumNodeSuccesses") & (F.col("level") == "LEVEL_INFO"))
        .groupBy("dataset_id")
        .agg(F.max(F.col("count").try_cast("double")).alias("expected"), F.count(F.lit(1)).alias("n"))
    )
    j = actual.join(expected, "dataset_id", "left")
    status = (
        F.when(F.col("n").isNull(), F.lit("SKIPPED"))
        .when(F.col("expected").isNull() | F.isnan("expected"), F.lit("ERROR"))
        .when(F.col("actual") == F.col("expected"), F.lit("OK"))
        .otherwise(F.lit("MISMATCH"))
    )
    return j.select(
        "dataset_id",
        status.isin("OK", "SKIPPED").alias("ok"),
        status.alias("status"),
        "actual",
        F.col("expected").cast("bigint").alias("expected"),
    )


def key_counters(stats: DataFrame, counters: DataFrame) -> DataFrame:
    """A10: total observations plus the three success counters (summed over levels)."""
    total = stats.groupBy("dataset_id").agg(F.lit("TotalObservations").alias("name"), F.sum("NumObservations").cast("bigint").alias("value"))
    named = (
        counters.where(F.col("counterKey").isin(*KEY_COUNTERS))
        .groupBy("dataset_id", F.col("counterKey").alias("name"))
        .agg(F.sum(_digit_count()).cast("bigint").alias("value"))
    )
    return total.unionByName(named)


def dataset_profile(stats: DataFrame, keywords=None) -> DataFrame:
    """Variable count, date range, mixed scales flag, concepts found in names."""
    kws = sorted(keywords or CONCEPT_KEYWORDS)
    per_var = stats.select("dataset_id", "StatVar", "MinDate", "MaxDate", "MinValue", "MaxValue", F.explode_outer(concepts_found("StatVar", kws)).alias("kw"))
    return per_var.groupBy("dataset_id").agg(
        F.countDistinct("StatVar").cast("bigint").alias("num_statvars"),
        F.min("MinDate").alias("min_date"),
        F.max("MaxDate").alias("max_date"),
        ((F.max("MaxValue") > 1000) & (F.abs(F.min("MinValue")) < 1)).alias("mixed_scales"),
        render_list(F.collect_set("kw")).alias("concepts"),
    )


def artifact_profile(points: DataFrame, failing: DataFrame | None = None) -> DataFrame:
    """Distinct variables from series points (else from failing rows), mixed units, dates present."""
    p = points.groupBy("dataset_id").agg(
        F.countDistinct("statVarDcid").cast("bigint").alias("from_points"),
        (F.countDistinct(_nonblank(F.col("unit"))) > 1).alias("mixed_units"),
        F.max(F.col("date").isNotNull() & (F.col("date") != "")).alias("dates_present"),
    )
    if failing is None:
        return p.select("dataset_id", F.col("from_points").alias("num_variables"), "mixed_units", "dates_present")
    f = failing.groupBy("dataset_id").agg(F.countDistinct("StatVar").cast("bigint").alias("from_failing"))
    j = p.join(f, "dataset_id", "full")
    return j.select(
        "dataset_id",
        F.when(F.coalesce(F.col("from_points"), F.lit(0)) > 0, F.col("from_points")).otherwise(F.coalesce(F.col("from_failing"), F.lit(0))).alias("num_variables"),
        F.coalesce(F.col("mixed_units"), F.lit(False)).alias("mixed_units"),
        F.coalesce(F.col("dates_present"), F.lit(False)).alias("dates_present"),
    )


def verdict(results: DataFrame) -> DataFrame:
    """Blockers (FAILED), warnings, passed and the overall verdict text."""
    g = results.groupBy("dataset_id").agg(
        F.count_if(F.col("status") == "FAILED").cast("bigint").alias("blockers"),
        F.count_if(F.col("status") == "WARNING").cast("bigint").alias("warnings"),
        F.count_if(F.col("status") == "PASSED").cast("bigint").alias("passed"),
    )
    overall = (
        F.when(F.col("blockers") > 0, F.lit("FAIL"))
        .when(
            F.col("warnings") > 0,
            F.concat(
                F.lit("PASS (with "),
                F.col("warnings").cast("string"),
                F.when(F.col("warnings") == 1, F.lit(" warning)")).otherwise(F.lit(" warnings)")),
            ),
        )
        .otherwise(F.lit("PASS"))
    )
    return g.select("dataset_id", overall.alias("overall"), "blockers", "warnings", "passed")
