"""Failure samples and combined outputs (F1-F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statgate.functions.scalars import row_display, strip_blanks, to_double, to_number, unit_display, variable_suffix_keys
from statgate.operators.quality import smallest_k
from statgate.operators.stats import RESOLUTION_PREFIX

DETAILS_SCHEMA = T.StructType([T.StructField("units", T.ArrayType(T.StringType()))])
PARAMS_SCHEMA = T.StructType([T.StructField("minimum", T.StringType()), T.StructField("condition", T.StringType())])
SAMPLE_COLUMNS = ["dataset_id", "sample_id", "rule", "statVar", "location", "date", "value", "expected", "sourceRow", "message"]
NO_CSV_RULES = ["check_unit_consistency", "check_structural_lint_error_count"]
_SV_KEYS = ["StatVar", "stat_var", "statVar"]


def failure_samples(results: DataFrame, violations: DataFrame) -> DataFrame:
    """one sample per violating row of a failed rule, else one summary sample.

    A failed minimum or golden rule has no summary: its rows are its samples.
    """
    failed = results.where(F.col("status") == "FAILED").select(
        "dataset_id",
        F.col("validation_name").alias("rule"),
        F.coalesce(F.col("message"), F.lit("")).alias("message"),
        F.from_json("details", DETAILS_SCHEMA).alias("d"),
        F.from_json("validation_params", PARAMS_SCHEMA).alias("p"),
    )
    rule = F.col("rule")
    kind = (
        F.when(rule == "check_min_value", F.lit("min")).when(rule == "check_unit_consistency", F.lit("unit"))
        .when(F.col("p.condition").isNotNull(), F.lit("sql")).when(rule == "check_structural_lint_error_count", F.lit("lint"))
    )
    rows = violations.select("dataset_id", F.col("rule_id").alias("rule"), F.col("ordinal").alias("i"), F.col("row").alias("r"))
    ex = failed.withColumn("kind", kind).join(rows, ["dataset_id", "rule"], "left")
    # what violates a bound other than the minimum has one summary; rows of any other rule are missing goldens
    bound = F.exists(F.map_keys("r"), lambda k: k.isin("actual_min_value", "actual_max_value", "actual_num_observations", "actual_num_places"))
    kind = F.coalesce(F.col("kind"), F.when(F.col("r").isNotNull() & ~bound, F.lit("golden")), F.lit("other"))
    ex = ex.withColumn("kind", kind).where(~((F.col("kind") == "other") & (F.coalesce("i", F.lit(0)) > 0)))
    r = F.col("r")
    sv = F.coalesce(r["stat_var"], r["StatVar"], r["statVar"], F.when(F.col("kind") == "golden", r["variableMeasured"]))
    golden_extra = F.map_filter(r, lambda k, v: ~k.isin("StatVar", "stat_var", "variableMeasured") & v.isNotNull() & (v != ""))
    golden_value = F.when(F.size(golden_extra) == 0, F.lit("—")).otherwise(
        F.array_join(F.transform(F.map_entries(golden_extra), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    )
    units_text = F.concat(F.lit("["), F.array_join(F.coalesce(F.col("d.units"), F.array().cast("array<string>")), ", "), F.lit("]"))
    value = (
        F.when(F.col("kind") == "min", F.coalesce(r["actual_min_value"], r["value"], F.lit("—")))
        .when(F.col("kind") == "unit", unit_display(units_text))
        .when(F.col("kind") == "golden", golden_value)
        .when(F.col("kind") == "sql", row_display(r))
    )
    expected = (
        F.when(F.col("kind") == "min", F.concat(F.lit(">= "), F.coalesce(F.col("p.minimum"), F.lit("0"))))
        .when(F.col("kind") == "unit", F.lit("consistent units (one unit per StatVar)"))
        .when(F.col("kind") == "golden", F.lit("present in import output"))
        .when(F.col("kind") == "sql", F.coalesce(F.col("p.condition"), F.lit("")))
        .when(F.col("kind") == "lint", F.lit("0 structural lint errors"))
        .otherwise(F.lit(""))
    )
    return ex.select(
        "dataset_id",
        F.concat_ws("#", "rule", F.coalesce(F.col("i"), F.lit(0)).cast("string")).alias("sample_id"),
        "rule",
        F.when(F.col("kind").isin("min", "golden", "sql"), sv).alias("statVar"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("date"),
        value.alias("value"),
        expected.alias("expected"),
        F.lit(None).cast("string").alias("sourceRow"),
        "message",
    )


def enrich_samples(samples: DataFrame, obs: DataFrame) -> DataFrame:
    """first record (lowest record number) whose variable matches each sample.

    Matching is equal, or ends with ':'+v or '/'+v. Observations are first
    reduced to one first-record per (dataset, variable) by grouped ``min_by``
    (partial aggregation, so a hot variable is never one task); the suffix
    match then joins that small table with the samples on exact keys. A
    min-value sample takes the first record below the minimum of its own rule
    (as its ``expected`` states it), found among its variables' records only.
    """
    o = obs.select(
        "dataset_id",
        strip_blanks(F.col("variableMeasured")).alias("var"),
        F.struct(
            F.col("__row").alias("row"),
            strip_blanks(F.col("observationAbout")).alias("location"),
            strip_blanks(F.col("observationDate")).alias("date"),
            F.regexp_extract(F.col("__file"), r"([^/]*)$", 1).alias("file"),
        ).alias("rec"),
        to_double("value").alias("v"),
    )
    firsts = o.groupBy("dataset_id", "var").agg(F.min_by("rec", F.col("rec.row")).alias("rec"))
    first_any = firsts.select("dataset_id", "var", "rec")
    keys = firsts.select("dataset_id", "var", F.explode(variable_suffix_keys(F.col("var"))).alias("k"))
    pend = samples.where(F.col("statVar").isNotNull() & (F.col("statVar") != "") & ~F.col("rule").isin(*NO_CSV_RULES))
    minimum = F.coalesce(F.regexp_extract("expected", r">= (.*)$", 1).try_cast("double"), F.lit(0.0))
    pend = pend.select("dataset_id", "sample_id", "rule", strip_blanks(F.col("statVar")).alias("k"), minimum.alias("minimum"))
    m = pend.join(keys, ["dataset_id", "k"])
    any_m = m.where(F.col("rule") != "check_min_value").join(first_any, ["dataset_id", "var"])
    wanted = m.where(F.col("rule") == "check_min_value")
    limits = wanted.select("dataset_id", "var", "minimum").distinct()
    first_low = (
        o.join(limits, ["dataset_id", "var"])
        .where(F.col("v") < F.col("minimum"))
        .groupBy("dataset_id", "var", "minimum")
        .agg(F.min_by("rec", F.col("rec.row")).alias("rec"))
    )
    low_m = wanted.join(first_low, ["dataset_id", "var", "minimum"])
    best = any_m.unionByName(low_m).groupBy("dataset_id", "sample_id").agg(F.min_by("rec", F.col("rec.row")).alias("rec"))
    j = samples.join(best, ["dataset_id", "sample_id"], "left")
    found = F.col("rec").isNotNull()
    return j.select(
        "dataset_id",
        "sample_id",
        "rule",
        "statVar",
        F.when(found, F.when(F.col("rec.location") != "", F.col("rec.location"))).otherwise(F.col("location")).alias("location"),
        F.when(found, F.when(F.col("rec.date") != "", F.col("rec.date"))).otherwise(F.col("date")).alias("date"),
        "value",
        "expected",
        F.when(found, F.concat(F.col("rec.file"), F.lit(":"), F.col("rec.row").cast("string"))).otherwise(F.col("sourceRow")).alias("sourceRow"),
        "message",
    )


def expand_units(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """a unit-consistency sample becomes one sample per variable with its units."""
    unit = samples.where(F.col("rule") == "check_unit_consistency")
    rest = samples.where(F.col("rule") != "check_unit_consistency")
    sv = stats.select("dataset_id", F.col("StatVar").alias("__sv"), F.col("Units").alias("__units"))
    per_var = unit.drop("statVar").join(sv, "dataset_id").select(
        "dataset_id",
        F.concat(F.col("sample_id"), F.lit("#"), F.col("__sv")).alias("sample_id"),
        "rule",
        F.col("__sv").alias("statVar"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("date"),
        unit_display(F.col("__units")).alias("value"),
        "expected",
        F.lit(None).cast("string").alias("sourceRow"),
        "message",
    )
    return rest.unionByName(per_var)


# Kinds of advisory rows, the longest details, and the words of a fluctuation.
VALIDATION_ROW, REVIEW_ROW, FLUCTUATION_ROW = "validation_warning", "ai_advisory", "statistical_fluctuation"
DETAILS_CHARS = 500
FLUCTUATION_MESSAGE = "Large fluctuation (>100%) between consecutive points"
PERIOD_ARROW = " → "


def advisory_export(
    results: DataFrame,
    issues: DataFrame | None = None,
    fluctuations: DataFrame | None = None,
    violations: DataFrame | None = None,
    source_file: str = "",
    run_id: str = "",
) -> DataFrame:
    """FAILED/WARNING results, review issues and fluctuations in the export's 19 columns, all text.

    ``violations`` gives a result the place of its first violating row, where
    that row names one. ``fluctuations`` are those of the lint report (W5). A
    column that a kind of row does not have is empty text.
    """
    from statgate.sources.writers import ADVISORY_COLUMNS

    def shape(df: DataFrame, **known: Column) -> DataFrame:
        run = {"source_file": F.lit(source_file), "dataset": F.col("dataset_id"), "run_id": F.lit(run_id), **known}
        return df.select(*[F.coalesce(run.get(c, F.lit("")).cast("string"), F.lit("")).alias(c) for c in ADVISORY_COLUMNS])

    told = results.where(F.col("status").isin("FAILED", "WARNING"))
    if violations is None:
        told = told.withColumn("__place", F.lit(""))
    else:
        first = violations.where("ordinal = 0").select(
            "dataset_id", F.col("rule_id").alias("validation_name"), F.coalesce(F.col("row")["place_dcid"], F.col("row")["location"]).alias("__place")
        )
        told = told.join(first, ["dataset_id", "validation_name"], "left")
    parts = [
        shape(
            told, type=F.lit(VALIDATION_ROW), severity=F.lower(strip_blanks(F.col("status"))), rule_id=F.col("validation_name"),
            message=strip_blanks(F.col("message")), details=F.substring("details", 1, DETAILS_CHARS), place_id=F.col("__place"),
        )
    ]
    if issues is not None:
        suggestion = strip_blanks(F.coalesce("suggestion", F.lit("")))
        parts.append(
            shape(
                issues, type=F.lit(REVIEW_ROW), severity=F.lower(strip_blanks(F.coalesce("severity", F.lit("advisory")))),
                file=strip_blanks(F.col("file")), line=F.col("line"), message=strip_blanks(F.col("message")),
                details=F.when(suggestion != "", F.concat(F.lit("Suggestion: "), suggestion)),
            )
        )
    if fluctuations is not None:
        n = F.size("points")
        last, before = F.element_at("points", F.when(n >= 1, -1)), F.element_at("points", F.when(n >= 2, -2))
        two = n >= 2
        parts.append(
            shape(
                fluctuations, type=F.lit(FLUCTUATION_ROW), severity=F.lit("advisory"), statvar=strip_blanks(F.col("statVar")),
                place_id=strip_blanks(F.col("location")), file=F.lit(source_file.rsplit("/", 1)[-1]), message=F.lit(FLUCTUATION_MESSAGE),
                period=F.when(two, F.concat(before["date"], F.lit(PERIOD_ARROW), last["date"])),
                previous_value=F.when(two, to_number(before["value"])), current_value=F.when(two, to_number(last["value"])),
                percent_change=F.when(F.col("percentDifference").try_cast("double").isNotNull(), F.format_string("%.2f", F.col("percentDifference").try_cast("double"))), series_points=F.col("series_length"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _level_rank():
    return F.when(F.col("level") == "LEVEL_ERROR", 0).when(F.col("level") == "LEVEL_WARNING", 1).when(F.col("level") == "LEVEL_INFO", 2).otherwise(3)


def top_lint(entries: DataFrame, n: int = 10, structural_first: int = 5, width: int = 120) -> DataFrame:
    """first ``structural_first`` structural entries, then resolution entries up to ``n`` in total.

    Ordered by level, file, line number. Picked with ``smallest_k`` (bounded
    per-partition pre-selection), never a window over all entries of a dataset.
    """
    e = entries.select(
        "dataset_id",
        _level_rank().alias("lvl"),
        F.coalesce(F.col("file"), F.lit("")).alias("file"),
        F.coalesce(F.col("lineNumber").try_cast("bigint"), F.lit(0)).alias("line"),
        "level",
        "counterKey",
        "userMessage",
        F.coalesce(F.col("counterKey"), F.lit("")).startswith(RESOLUTION_PREFIX).alias("resolution"),
    ).withColumn("ord", F.struct("lvl", "file", "line", "counterKey", "userMessage"))
    s = smallest_k(e.where(~F.col("resolution")), ["dataset_id"], "ord", structural_first)
    ns = s.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("ns"))
    r = smallest_k(e.where(F.col("resolution")), ["dataset_id"], "ord", n)
    r = r.join(ns, "dataset_id", "left").where(F.col("rank") <= F.lit(n) - F.coalesce(F.col("ns"), F.lit(0))).drop("ns")
    both = s.withColumn("grp", F.lit(0)).unionByName(r.withColumn("grp", F.lit(1)))
    msg = F.coalesce(F.col("userMessage"), F.lit(""))
    cut = F.when(F.length(msg) > width, F.concat(F.substring(msg, 1, width - 3), F.lit("..."))).otherwise(msg)
    return both.select(
        "dataset_id",
        (F.col("grp") * 100 + F.col("rank")).cast("int").alias("position"),
        "file",
        "line",
        F.regexp_replace(F.col("level"), "^LEVEL_", "").alias("level"),
        "counterKey",
        cut.alias("message"),
    )


def review_summary(results: DataFrame, issues: DataFrame | None, fluct: DataFrame | None, samples: DataFrame | None) -> DataFrame:
    """F8: six counters per dataset."""
    base = results.groupBy("dataset_id").agg(
        F.count_if(F.col("status") == "FAILED").cast("bigint").alias("blockers"),
        F.count_if(F.col("status") == "WARNING").cast("bigint").alias("warnings"),
        F.count_if(F.col("status") == "PASSED").cast("bigint").alias("passed"),
    )

    def count_of(df, name):
        if df is None:
            return None
        return df.groupBy("dataset_id").agg(F.count(F.lit(1)).cast("bigint").alias(name))

    out = base
    for df, name in ((issues, "review_issues"), (fluct, "fluctuation_anomalies"), (samples, "rule_failures")):
        c = count_of(df, name)
        if c is None:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
        else:
            out = out.join(c, "dataset_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))
    return out
