"""Validation rules (V1-V18) and rule-set operators.

A rule yields one row per dataset:
``(dataset_id, validation_name, status, message, details, validation_params)``
with ``details`` and ``validation_params`` as JSON text. Rules over the same
source table are compiled into one aggregate per dataset; rules that name the
rows that violate them (bounds, SQL, goldens) get their counts from the
violations table (``operators.violations``), which holds those rows. A dataset
with no rows in the source gets a PASSED row (rules on an empty table pass,
except the differ rules on a first run, which warn).
"""

from __future__ import annotations

import dataclasses
import datetime
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statgate.functions.scalars import strip_blanks
from statgate.operators import violations as V
from statgate.operators.stats import RESOLUTION_PREFIX
from statgate.operators.violations import number_text, scope_condition
from statgate.session import cut

RESULT_COLUMNS = ["dataset_id", "validation_name", "status", "message", "details", "validation_params"]

# Result statuses and the rule-set messages of the reference.
PASSED, WARNING, FAILED, CONFIG_ERROR, DATA_ERROR = "PASSED", "WARNING", "FAILED", "CONFIG_ERROR", "DATA_ERROR"
NOT_EXECUTED_MESSAGE = (
    "Rule did not execute — DC runner exited before producing a result. "
    "Check runner stderr for details (e.g. import errors or crashes)."
)
FIRST_RUN_MESSAGE = "No baseline found — skipping change detection (first run)."
DIFFER_RULE_IDS = [
    "check_deleted_records_count",
    "check_deleted_records_percent",
    "check_modified_records_count",
    "check_added_records_count",
]


def _lit_json(obj) -> Column:
    return F.lit(json.dumps(obj, sort_keys=True))


def scope_filter(df: DataFrame, scope: dict | None, column: str = "StatVar") -> DataFrame:
    """Keep variables whose name contains every ``variables.contains_all`` token."""
    return df.where(scope_condition(scope, column))


# ---------------------------------------------------------------------------
# rules compiled into one aggregate per source table
# ---------------------------------------------------------------------------


@dataclasses.dataclass
class Compiled:
    """What a rule adds to the aggregate of its source (columns named with its prefix) and what it says of the outcome."""

    aggregates: list[Column]
    status: Column
    message: Column
    details: Column


def _distinct(rule: dict, pre: str, column: str, list_name: str, counted: str | None = None) -> Compiled:
    """More than one distinct value of a column across variables."""
    value = F.when(scope_condition(rule.get("scope")), F.col(column))
    n, vals = F.coalesce(F.col(pre + "n"), F.lit(0)), F.col(pre + "vals")
    several = n > 1
    if counted is None:
        value = value.cast("string")
        message = F.when(several, F.concat(F.lit("Found "), n.cast("string"), F.lit(f" distinct {column} values across StatVars."))).otherwise(
            F.lit(f"{column} is consistent across StatVars.")
        )
        none = F.array().cast("array<string>")
    else:
        message = F.when(several, F.concat(n.cast("string"), F.lit(f" distinct {column} counts across StatVars."))).otherwise(
            F.lit(f"{column} counts are consistent across StatVars.")
        )
        none = F.array().cast("array<bigint>")
    return Compiled(
        [F.count_distinct(value).alias(pre + "n"), F.array_sort(F.collect_set(value)).alias(pre + "vals")],
        F.when(several, F.lit(FAILED)).otherwise(F.lit(PASSED)),
        message,
        F.to_json(F.struct(F.coalesce(vals, none).alias(list_name))),
    )


def _max_date_latest(rule: dict, pre: str) -> Compiled:
    """V6: the latest MaxDate is not in the given year (``params.year``, default: this year)."""
    year = str((rule.get("params") or {}).get("year") or datetime.date.today().year)
    latest = F.col(pre + "latest")
    fine = latest.isNull() | (F.substring(latest, 1, 4) == year)
    return Compiled(
        [F.max(F.when(scope_condition(rule.get("scope")), F.col("MaxDate"))).alias(pre + "latest")],
        F.when(fine, F.lit(PASSED)).otherwise(F.lit(FAILED)),
        F.when(fine, F.lit(f"Latest date is in {year}.")).otherwise(F.concat(F.lit("Latest date "), latest, F.lit(f" is not in {year}."))),
        F.to_json(F.struct(latest.alias("max_date"), F.lit(year).alias("expected_year"))),
    )


def _threshold(rule: dict, pre: str, counted: Column, what: str, name: str = "count") -> Compiled:
    """A sum above a threshold."""
    threshold = (rule.get("params") or {}).get("threshold", 0)
    v = F.coalesce(F.col(pre + "n"), F.lit(0))
    return Compiled(
        [F.sum(counted).alias(pre + "n")],
        F.when(v > F.lit(threshold), F.lit(FAILED)).otherwise(F.lit(PASSED)),
        F.concat(F.lit(f"{what}: "), v.cast("string"), F.lit(f" (threshold {number_text(threshold)}).")),
        F.to_json(F.struct(v.alias(name), F.lit(threshold).alias("threshold"))),
    )


def _missing_refs(rule: dict, pre: str) -> Compiled:
    """Counters whose key matches ``params.key_pattern`` summed over all levels > threshold."""
    pattern = (rule.get("params") or {}).get("key_pattern", "(?i)missing.*ref")
    counted = F.when(F.col("counterKey").rlike(pattern) & F.col("count").rlike("^[0-9]+$"), F.col("count").try_cast("bigint"))
    return _threshold(rule, pre, counted, "Missing reference count")


def _structural(rule: dict, pre: str) -> Compiled:
    """LEVEL_ERROR counters outside the resolution prefix > threshold."""
    own = (F.col("level") == "LEVEL_ERROR") & ~F.col("counterKey").startswith(RESOLUTION_PREFIX)
    return _threshold(rule, pre, F.when(own, F.col("count").try_cast("bigint")), "Structural lint errors")


def _granularity(rule: dict, pre: str) -> Compiled:
    """More than one date granularity (W7 output) -> WARNING only."""
    whole = F.col("source") == "all"
    n, names = F.coalesce(F.col(pre + "n"), F.lit(0)), F.col(pre + "names")
    return Compiled(
        [F.max(F.when(whole, F.size("formats"))).alias(pre + "n"), F.max(F.when(whole, F.array_join("formats", ", "))).alias(pre + "names")],
        F.when(n > 1, F.lit(WARNING)).otherwise(F.lit(PASSED)),
        F.when(n > 1, F.concat(F.lit("observationDate mixes granularities: "), names, F.lit("."))).otherwise(
            F.lit("observationDate uses a single granularity.")
        ),
        F.to_json(F.struct(F.coalesce(names, F.lit("")).alias("granularities"))),
    )


def _deleted_percent(rule: dict, pre: str) -> Compiled:
    """100 * deleted / previous_obs_size > threshold; unknown size -> DATA_ERROR."""
    threshold = float((rule.get("params") or {}).get("threshold", 0))
    d, prev = F.coalesce(F.col(pre + "n"), F.lit(0)), F.col("previous_obs_size")
    pct = F.round((d * F.lit(100)).cast("decimal(38,6)") / prev.cast("decimal(38,6)"), 2)
    unknown = prev.isNull() | (prev <= 0)
    return Compiled(
        [F.sum("DELETED").alias(pre + "n")],
        F.when(unknown, F.lit(DATA_ERROR)).when(d * 100.0 / prev > F.lit(threshold), F.lit(FAILED)).otherwise(F.lit(PASSED)),
        F.when(unknown, F.lit("Differ summary is missing required field: 'previous_obs_size'.")).otherwise(
            F.concat(F.lit("Deleted observations: "), pct.cast("string"), F.lit(f"% of the baseline (threshold {number_text(threshold)}%)."))
        ),
        F.to_json(F.struct(d.alias("deleted"), prev.alias("previous_obs_size"), pct.cast("double").alias("percent"))),
    )


#: validator -> (source table, how it compiles)
COMPILERS: dict[str, tuple[str, Callable[[dict, str], Compiled]]] = {
    "UNIT_CONSISTENCY_CHECK": ("stats", lambda r, p: _distinct(r, p, "Units", "units")),
    "MAX_DATE_CONSISTENT": ("stats", lambda r, p: _distinct(r, p, "MaxDate", "max_dates")),
    "NUM_PLACES_CONSISTENT": ("stats", lambda r, p: _distinct(r, p, "NumPlaces", "num_places")),
    "MAX_DATE_LATEST": ("stats", _max_date_latest),
    "MISSING_REFS_COUNT": ("lint", _missing_refs),
    "STRUCTURAL_LINT_ERROR_COUNT": ("lint", _structural),
    "OBSERVATION_DATE_GRANULARITY": ("granularity", _granularity),
    "DELETED_RECORDS_COUNT": ("differ", lambda r, p: _threshold(r, p, F.col("DELETED"), "Deleted observations", "deleted")),
    "DELETED_RECORDS_PERCENT": ("differ", _deleted_percent),
    "MODIFIED_RECORDS_COUNT": ("differ", lambda r, p: _distinct(dict(r, scope=None), p, "MODIFIED", "modified_counts", "MODIFIED")),
    "ADDED_RECORDS_COUNT": ("differ", lambda r, p: _distinct(dict(r, scope=None), p, "ADDED", "added_counts", "ADDED")),
}
DIFFER_VALIDATORS = [name for name, (source, _) in COMPILERS.items() if source == "differ"]


def compiled_rules(datasets: DataFrame, source: str, table: DataFrame, rules: list[dict], sizes: DataFrame | None = None) -> DataFrame:
    """All rules of one source as ONE grouped aggregate per dataset, unfolded into a row per rule.

    Differ rules see the dataset's sizes (D3) beside the aggregate; a dataset
    that is on its first run there gets the first-run WARNING.
    """
    parts = [COMPILERS[rule["validator"]][1](rule, f"r{i}_") for i, rule in enumerate(rules)]
    agg = table.groupBy("dataset_id").agg(*[a for part in parts for a in part.aggregates])
    j = datasets.join(agg, "dataset_id", "left")
    first = F.lit(False)
    if source == "differ":
        if sizes is None:  # there is a differ table, so this is no first run
            j = j.withColumn("previous_obs_size", F.lit(None).cast("bigint"))
        else:
            j = j.join(sizes.select("dataset_id", "previous_obs_size", "first_run"), "dataset_id", "left")
            first = F.coalesce(F.col("first_run"), F.lit(True))
    told = [
        F.struct(
            F.lit(rule.get("rule_id", "")).alias("validation_name"),
            F.when(first, F.lit(WARNING)).otherwise(part.status).alias("status"),
            F.when(first, F.lit(FIRST_RUN_MESSAGE)).otherwise(part.message).alias("message"),
            F.when(first, F.to_json(F.struct(F.lit(True).alias("first_run")))).otherwise(part.details).alias("details"),
            _lit_json(rule.get("params") or {}).alias("validation_params"),
        )
        for rule, part in zip(rules, parts, strict=True)
    ]
    return j.select("dataset_id", F.explode(F.array(*told)).alias("r")).select("dataset_id", "r.*")


# ---------------------------------------------------------------------------
# rules that name the rows that violate them
# ---------------------------------------------------------------------------

SQL_CONTEXT = "Rules are evaluated per StatVar (aggregated across all CSV rows)"


def _words(rule: dict) -> tuple[str, str, str, str]:
    """(message if none, words before the number, after one, after several)."""
    if rule["validator"] == "SQL_VALIDATOR":
        return "SQL validation passed.", "Rule failed for ", " StatVar.", " StatVars."
    if rule["validator"] == "GOLDENS_CHECK":
        return "All golden records found.", "Found ", " missing golden record.", " missing golden records."
    what = V.bound_words(rule)
    return f"No StatVar {what}.", "Found ", f" StatVar {what}.", f" StatVars {what}."


def counted_rules(datasets: DataFrame, counts: DataFrame, rules: list[dict]) -> DataFrame:
    """Result rows of the rules whose violations are stored; ``details`` holds their number and where to find them."""
    listed = [
        F.struct(
            *[F.lit(x).alias(n) for n, x in zip(("none", "before", "one", "several"), _words(rule), strict=True)],
            F.lit(rule.get("rule_id", "")).alias("rule_id"),
            _lit_json(rule.get("params") or {}).alias("params"),
            F.lit(SQL_CONTEXT if rule["validator"] == "SQL_VALIDATOR" else None).cast("string").alias("sql_context"),
        )
        for rule in rules
    ]
    each = datasets.select("dataset_id", F.explode(F.array(*listed)).alias("r")).select("dataset_id", "r.*")
    j = each.join(counts, ["dataset_id", "rule_id"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return j.select(
        "dataset_id",
        F.col("rule_id").alias("validation_name"),
        F.when(n > 0, F.lit(FAILED)).otherwise(F.lit(PASSED)).alias("status"),
        F.when(n > 0, F.concat("before", n.cast("string"), F.when(n == 1, F.col("one")).otherwise(F.col("several")))).otherwise(F.col("none")).alias("message"),
        F.to_json(F.struct(n.alias("violations"), F.col("rule_id").alias("violations_of"), F.col("sql_context"))).alias("details"),
        F.col("params").alias("validation_params"),
    )


def _told_alike(datasets: DataFrame, rule: dict, status: str, message: str, details: dict) -> DataFrame:
    """The same result of a rule for every dataset."""
    return datasets.select(
        "dataset_id",
        F.lit(rule.get("rule_id", "")).alias("validation_name"),
        F.lit(status).alias("status"),
        F.lit(message).alias("message"),
        _lit_json(details).alias("details"),
        _lit_json(rule.get("params") or {}).alias("validation_params"),
    )


# ---------------------------------------------------------------------------
# user rules
# ---------------------------------------------------------------------------

BUILTIN = {*COMPILERS, *V.BOUNDS, "SQL_VALIDATOR", "GOLDENS_CHECK"}
VALIDATORS: dict[str, Callable] = {}


def register_validator(name: str, fn: Callable) -> None:
    """Extension point: ``fn(datasets, tables, rule) -> result rows``; a built-in of that name gives way."""
    VALIDATORS[name] = fn


def is_table_function(spark: SparkSession, name: str) -> bool:
    """Whether the session knows a table function ``name``."""
    return bool(name) and name.isidentifier() and spark.catalog.functionExists(name)


def table_function_rule(tables: dict[str, DataFrame], rule: dict) -> DataFrame:
    """A user rule written as a Python UDTF of the session, called by its name.

    It gets the stats rows of one dataset after another
    (``TABLE(stats) PARTITION BY dataset_id``), so it runs beside the data and
    holds what it keeps itself, and the rule's parameters as JSON text; it
    yields (dataset_id, status, message, details). Whatever further columns
    ``stats`` has reach it, so one function serves any summary.
    """
    spark = tables["stats"].sparkSession
    params = json.dumps(rule.get("params") or {}, sort_keys=True)

    def make(names: dict[str, str]) -> str:
        text = params.replace("\\", "\\\\").replace("'", "\\'")
        return f"SELECT * FROM {rule['validator']}(TABLE(SELECT * FROM {names['stats']}) PARTITION BY (dataset_id), '{text}')"

    told = V.bound_sql(spark, make, {"stats": tables["stats"]})
    return told.select(
        "dataset_id", F.lit(rule.get("rule_id", "")).alias("validation_name"), "status", "message",
        F.coalesce("details", F.lit("{}")).alias("details"), F.lit(params).alias("validation_params"),
    )


def select_rules(rules: list[dict], include=None, skip=None) -> list[dict]:
    """Enabled rules only, then an optional include list or skip list of rule ids."""
    out = [r for r in rules if isinstance(r, dict) and r.get("enabled", True)]
    if include:
        inc = set(include)
        out = [r for r in out if r.get("rule_id") in inc]
    if skip:
        sk = set(skip)
        out = [r for r in out if r.get("rule_id") not in sk]
    return out


def _sources(rule: dict) -> list[str]:
    """The tables without which a rule says nothing (R2 then injects FAILED)."""
    v = rule.get("validator")
    if v in COMPILERS:
        return [COMPILERS[v][0], *(["sizes"] if v == "DELETED_RECORDS_PERCENT" else [])]
    return {"SQL_VALIDATOR": [], "GOLDENS_CHECK": ["goldens", "obs"]}.get(v, ["stats"])


@dataclasses.dataclass
class Outcome:
    """R1's result rows, and the rows that violate rules (``operators.violations``)."""

    results: DataFrame
    violations: DataFrame


def evaluate(
    tables: dict[str, DataFrame],
    rules: list[dict],
    datasets: DataFrame | None = None,
    include=None,
    skip=None,
) -> Outcome:
    """One result row per (dataset, selected rule), with the violating rows beside them.

    ``tables`` holds ``stats`` (A1), ``lint`` (counters), ``differ`` (D2),
    ``sizes`` (D3), ``granularity`` (W7), ``goldens`` and ``obs`` as available.
    A rule whose tables are absent produces no row (R2 then injects FAILED);
    a validator that is neither built in, registered, nor a table function of
    the session yields a WARNING row. Violations and results are computed once
    and kept: a row per violating row, and a row per dataset and rule.
    """
    if datasets is None:
        datasets = tables["stats"].select("dataset_id")
    datasets = datasets.select("dataset_id").distinct()
    spark = datasets.sparkSession
    parts: list[DataFrame] = []
    found: list[DataFrame] = []
    by_source: dict[str, list[dict]] = {}
    bounds: list[dict] = []
    counted: list[dict] = []
    for rule in select_rules(rules, include, skip):
        v = rule.get("validator")
        known = v in BUILTIN and v not in VALIDATORS
        if v in DIFFER_VALIDATORS and known and tables.get("differ") is None:
            parts.append(first_run_results(datasets, rule))  # D8: no baseline yet
        elif v not in VALIDATORS and not known:
            if is_table_function(spark, v) and tables.get("stats") is not None:
                parts.append(table_function_rule(tables, rule))
            else:
                parts.append(_told_alike(datasets, rule, WARNING, f"Unknown custom validator: {v}", {"validator": v}))
        elif any(tables.get(t) is None for t in _sources(rule)):
            continue
        elif v in VALIDATORS:
            parts.append(VALIDATORS[v](datasets, tables, rule).select(*RESULT_COLUMNS))
        elif v in COMPILERS:
            by_source.setdefault(COMPILERS[v][0], []).append(rule)
        elif v in V.BOUNDS:
            bounds.append(rule)
        elif v == "GOLDENS_CHECK":
            found.append(V.golden_violations(tables["goldens"], tables["obs"], rule))
            counted.append(rule)
        else:
            try:
                found.append(V.sql_violations(rule, tables, datasets))
                counted.append(rule)
            except V.SQL_ERRORS as e:
                parts.append(_told_alike(datasets, rule, CONFIG_ERROR, f"Invalid SQL rule: {e}", {"error": str(e)}))
    if bounds:
        found.append(V.bound_violations(tables["stats"], bounds))
    violations, counts = V.store(found, spark)
    parts += [compiled_rules(datasets, source, tables[source], group, tables.get("sizes")) for source, group in by_source.items()]
    if bounds or counted:
        parts.append(counted_rules(datasets, counts, bounds + counted))
    if not parts:
        return Outcome(spark.createDataFrame([], ", ".join(f"{c} string" for c in RESULT_COLUMNS)), violations)
    out = parts[0].select(*RESULT_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*RESULT_COLUMNS))
    return Outcome(cut(out), violations)


def first_run_results(datasets: DataFrame, rule: dict) -> DataFrame:
    """Differ rules without a baseline warn, never fail."""
    return _told_alike(datasets, rule, WARNING, FIRST_RUN_MESSAGE, {"first_run": True})


def run_rules(tables: dict[str, DataFrame], rules: list[dict], datasets: DataFrame | None = None, include=None, skip=None) -> DataFrame:
    """The result rows of ``evaluate``."""
    return evaluate(tables, rules, datasets, include, skip).results


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rule list as a small DataFrame (rule_id, validator, params JSON)."""
    rows = [(r.get("rule_id", ""), r.get("validator", ""), json.dumps(r.get("params") or {}, sort_keys=True)) for r in select_rules(rules)]
    return spark.createDataFrame(rows, "rule_id string, validator string, params string")


def inject_missing(results: DataFrame, rules: list[dict], datasets: DataFrame | None = None) -> DataFrame:
    """R2: every selected rule id without a result (per dataset) gets a synthetic FAILED row.

    Matching is by id, so duplicate names in the results cannot hide a missing
    rule. Per dataset the present ids form a set bounded by the rule count;
    the missing ids are the configured list minus that set (no cross join).
    """
    spark = results.sparkSession
    selected = select_rules(rules)
    ids = [r.get("rule_id", "") for r in selected]
    rf = F.broadcast(rules_frame(spark, rules))  # the rule list: one row per configured rule
    ds = (datasets if datasets is not None else results).select("dataset_id").distinct()
    present = results.groupBy("dataset_id").agg(F.collect_set("validation_name").alias("__have"))
    per_ds = ds.join(present, "dataset_id", "left").select(
        "dataset_id",
        F.explode(
            F.array_except(F.array(*[F.lit(i) for i in ids]).cast("array<string>"), F.coalesce(F.col("__have"), F.array().cast("array<string>")))
        ).alias("rule_id"),
    )
    injected = per_ds.join(rf, "rule_id").select(
        "dataset_id",
        F.col("rule_id").alias("validation_name"),
        F.lit(FAILED).alias("status"),
        F.lit(NOT_EXECUTED_MESSAGE).alias("message"),
        F.lit("{}").alias("details"),
        F.col("params").alias("validation_params"),
    )
    return results.select(*RESULT_COLUMNS).unionByName(injected)


def warn_map_frame(spark: SparkSession, warn_map: dict[str, list[str]]) -> DataFrame:
    rows = [(str(d).strip().lower(), str(r).strip().lower()) for d, ids in (warn_map or {}).items() for r in (ids or [])]
    return spark.createDataFrame(rows, "wds string, wrule string").distinct()


def apply_warn_only(results: DataFrame, warn_map: dict[str, list[str]] | DataFrame) -> DataFrame:
    """FAILED -> WARNING for configured (dataset, rule) pairs; ids trimmed, case-insensitive."""
    spark = results.sparkSession
    wm = warn_map if isinstance(warn_map, DataFrame) else warn_map_frame(spark, warn_map)
    key_ds = F.lower(strip_blanks(F.col("dataset_id")))
    key_rule = F.lower(strip_blanks(F.col("validation_name")))
    j = results.join(
        F.broadcast(wm.withColumn("__hit", F.lit(True))),  # configuration map: a few entries per dataset
        (key_ds == F.col("wds")) & (key_rule == F.col("wrule")),
        "left",
    )
    status = F.when(F.col("__hit") & (F.col("status") == FAILED), F.lit(WARNING)).otherwise(F.col("status"))
    return j.select(*[status.alias("status") if c == "status" else F.col(c) for c in results.columns])


def is_blocked(results: DataFrame) -> DataFrame:
    """Blocked when any FAILED or CONFIG_ERROR remains."""
    return results.groupBy("dataset_id").agg(F.bool_or(F.col("status").isin(FAILED, CONFIG_ERROR)).alias("blocked"))


def config_errors(results: DataFrame) -> DataFrame:
    """(rule id, message) of CONFIG_ERROR results."""
    return results.where(F.col("status") == CONFIG_ERROR).select(
        "dataset_id", F.col("validation_name").alias("rule_id"), "message"
    )


def preview_sql_rule(spark: SparkSession, query: str, condition: str, tables: dict[str, DataFrame] | None = None, sample: int = 10) -> dict:
    """Pass flag, total violations and the first ``sample`` violating rows, over the run's own ``tables``.

    Where several datasets are among them, the query sees all their rows, with
    ``dataset_id`` as a column, as the caller gave them.
    """
    try:
        bad = V.run_sql(V.violations_sql(query, condition), tables or {}, spark)
    except (AnalysisException, ParseException) as e:
        return {"valid": False, "error": str(e)}
    total = bad.count()
    rows = [r.asDict() for r in bad.limit(sample).collect()]  # the preview is a bounded sample by design
    return {"valid": True, "passed": total == 0, "violations": total, "sample_rows": rows}
