"""Registered queries: one Spark callable per operator and its DuckDB oracle.

Every query reads the given tables (through ``statgate.sources.testviews``)
over their whole extent; the oracle inlines the same view definitions.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from statgate.operators import rules as R
from statgate.operators import series as W
from statgate.operators import stats as A
from statgate.plans.default_rules import DEFAULT_RULES
from statgate.session import checkpoint_dir, cut
from statgate.plans.sqlbits import SERIES, dlist, dpairs, dparse, dpct, dperiod_days, dpoints, dvar
from statgate.sources import testviews as TV

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle if callable(oracle) else (lambda s=oracle: s)
        return fn

    return deco


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for what a query writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def this_year() -> int:
    return datetime.date.today().year


# ---------------------------------------------------------------------------
# A1 / A2: variable summary
# ---------------------------------------------------------------------------


def _stats_sql(view: str) -> str:
    return f"""
SELECT dataset_id, {dvar('variableMeasured')} AS StatVar,
       CAST(count(DISTINCT observationAbout) AS BIGINT) AS NumPlaces,
       CAST(count(*) AS BIGINT) AS NumObservations,
       min(TRY_CAST(value AS DOUBLE)) AS MinValue, max(TRY_CAST(value AS DOUBLE)) AS MaxValue,
       CAST(count(DISTINCT observationDate) AS BIGINT) AS NumObservationsDates,
       min(observationDate) AS MinDate, max(observationDate) AS MaxDate,
       {dlist('measurementMethod')} AS MeasurementMethods, {dlist('unit')} AS Units,
       {dlist('scalingFactor')} AS ScalingFactors, {dlist('observationPeriod')} AS observationPeriods
FROM {view} GROUP BY ALL"""


@register("stats_events", lambda: TV.duckdb_with("obs_events") + _stats_sql("obs_events"))
def q_stats_events(spark, sf):
    return A.variable_summary(TV.obs_events(spark, sf))


@register("stats_orders", lambda: TV.duckdb_with("obs_orders") + _stats_sql("obs_orders"))
def q_stats_orders(spark, sf):
    return A.variable_summary(TV.obs_orders(spark, sf))


def _year_only_sql() -> str:
    # orders observed per year: dates are 'YYYY', normalized to 'YYYY-01-01'
    return (
        TV.duckdb_with("obs_orders")
        + """, yearly AS (SELECT * REPLACE (substr(observationDate, 1, 4) AS observationDate) FROM obs_orders),
s AS ("""
        + _stats_sql("yearly")
        + """)
SELECT * REPLACE (CASE WHEN regexp_matches(MinDate, '^[0-9]{4}$') THEN MinDate || '-01-01' ELSE MinDate END AS MinDate,
                  CASE WHEN regexp_matches(MaxDate, '^[0-9]{4}$') THEN MaxDate || '-01-01' ELSE MaxDate END AS MaxDate)
FROM s"""
    )


@register("stats_year_only", _year_only_sql)
def q_stats_year_only(spark, sf):
    yearly = TV.obs_orders(spark, sf).withColumn("observationDate", F.substring("observationDate", 1, 4))
    return A.normalize_year_only(A.variable_summary(yearly))


# ---------------------------------------------------------------------------
# R1 with the default rule set on the events dataset (first run: no baseline)
# ---------------------------------------------------------------------------


def events_tables(spark, sf) -> dict[str, DataFrame]:
    obs = TV.obs_events(spark, sf)
    return {
        "stats": cut(A.variable_summary(obs)),  # a row per variable, which every rule reads
        "lint": TV.lint_counters(spark, sf),
        "granularity": W.date_granularity_mix(obs),
    }


def _rules_events_sql() -> str:
    year = this_year()
    return (
        TV.duckdb_with("obs_events", "lint_entries", "lint_counters")
        + f""", stats AS ({_stats_sql('obs_events')}),
ds AS (SELECT DISTINCT dataset_id FROM stats),
gran AS (
  SELECT dataset_id, count(DISTINCT g) AS n, string_agg(DISTINCT g, ', ' ORDER BY g) AS fmts FROM (
    SELECT dataset_id, CASE WHEN regexp_matches(trim(observationDate), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'YYYY-MM-DD'
                            WHEN regexp_matches(trim(observationDate), '^[0-9]{{4}}-[0-9]{{2}}$') THEN 'YYYY-MM'
                            WHEN regexp_matches(trim(observationDate), '^[0-9]{{4}}$') THEN 'YYYY' END AS g
    FROM obs_events) WHERE g IS NOT NULL GROUP BY dataset_id),
r AS (
  SELECT dataset_id, 'check_min_value' AS validation_name, count(*) FILTER (WHERE MinValue < 0) AS n, NULL AS s FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_num_observations', count(*) FILTER (WHERE NumObservations < 1), NULL FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_unit_consistency', count(DISTINCT Units), NULL FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_scaling_factor_consistency',
      (SELECT count(*) FROM (SELECT COUNT(DISTINCT ScalingFactors) AS distinct_count FROM stats s2
                             WHERE s2.dataset_id = stats.dataset_id AND ScalingFactors IS NOT NULL) WHERE NOT (distinct_count <= 1)), NULL
      FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_max_date_latest', NULL, max(MaxDate) FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_max_date_consistent', count(DISTINCT MaxDate), NULL FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_num_places_consistent', count(DISTINCT NumPlaces), NULL FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_num_places_count', count(*) FILTER (WHERE NumPlaces < 1), NULL FROM stats GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_max_value_percent', count(*) FILTER (WHERE MaxValue > 100 AND contains(StatVar, 'Percent')), NULL FROM stats GROUP BY 1
  UNION ALL SELECT ds.dataset_id, 'check_missing_refs_count', coalesce(sum(CASE WHEN regexp_matches(count, '^[0-9]+$') THEN CAST(count AS BIGINT) END), 0), NULL
      FROM ds LEFT JOIN lint_counters l ON l.dataset_id = ds.dataset_id AND regexp_matches(counterKey, '(?i)missing.*ref') GROUP BY 1
  UNION ALL SELECT ds.dataset_id, 'check_structural_lint_error_count', coalesce(sum(TRY_CAST(count AS BIGINT)), 0), NULL
      FROM ds LEFT JOIN lint_counters l ON l.dataset_id = ds.dataset_id AND level = 'LEVEL_ERROR' AND NOT starts_with(counterKey, 'Existence_FailedDcCall_') GROUP BY 1
  UNION ALL SELECT ds.dataset_id, 'check_observation_date_granularity', coalesce(gran.n, 0), gran.fmts FROM ds LEFT JOIN gran USING (dataset_id)
  UNION ALL SELECT dataset_id, 'check_deleted_records_count', NULL, NULL FROM ds
  UNION ALL SELECT dataset_id, 'check_deleted_records_percent', NULL, NULL FROM ds
  UNION ALL SELECT dataset_id, 'check_modified_records_count', NULL, NULL FROM ds
  UNION ALL SELECT dataset_id, 'check_added_records_count', NULL, NULL FROM ds
)
SELECT dataset_id, validation_name,
  CASE
    WHEN validation_name IN ('check_min_value', 'check_num_observations', 'check_num_places_count', 'check_max_value_percent',
                             'check_scaling_factor_consistency', 'check_missing_refs_count', 'check_structural_lint_error_count')
      THEN CASE WHEN n > 0 THEN 'FAILED' ELSE 'PASSED' END
    WHEN validation_name IN ('check_unit_consistency', 'check_max_date_consistent', 'check_num_places_consistent')
      THEN CASE WHEN n > 1 THEN 'FAILED' ELSE 'PASSED' END
    WHEN validation_name = 'check_max_date_latest' THEN CASE WHEN s IS NULL OR substr(s, 1, 4) = '{year}' THEN 'PASSED' ELSE 'FAILED' END
    WHEN validation_name = 'check_observation_date_granularity' THEN CASE WHEN n > 1 THEN 'WARNING' ELSE 'PASSED' END
    ELSE 'WARNING' END AS status,
  CASE validation_name
    WHEN 'check_min_value' THEN CASE WHEN n > 0 THEN 'Found ' || n || CASE WHEN n = 1 THEN ' StatVar' ELSE ' StatVars' END || ' with MinValue below 0.' ELSE 'No StatVar with MinValue below 0.' END
    WHEN 'check_num_observations' THEN CASE WHEN n > 0 THEN 'Found ' || n || CASE WHEN n = 1 THEN ' StatVar' ELSE ' StatVars' END || ' with fewer than 1 observations.' ELSE 'No StatVar with fewer than 1 observations.' END
    WHEN 'check_num_places_count' THEN CASE WHEN n > 0 THEN 'Found ' || n || CASE WHEN n = 1 THEN ' StatVar' ELSE ' StatVars' END || ' with fewer than 1 places.' ELSE 'No StatVar with fewer than 1 places.' END
    WHEN 'check_max_value_percent' THEN CASE WHEN n > 0 THEN 'Found ' || n || CASE WHEN n = 1 THEN ' StatVar' ELSE ' StatVars' END || ' with MaxValue above 100.' ELSE 'No StatVar with MaxValue above 100.' END
    WHEN 'check_unit_consistency' THEN CASE WHEN n > 1 THEN 'Found ' || n || ' distinct Units values across StatVars.' ELSE 'Units is consistent across StatVars.' END
    WHEN 'check_max_date_consistent' THEN CASE WHEN n > 1 THEN 'Found ' || n || ' distinct MaxDate values across StatVars.' ELSE 'MaxDate is consistent across StatVars.' END
    WHEN 'check_num_places_consistent' THEN CASE WHEN n > 1 THEN 'Found ' || n || ' distinct NumPlaces values across StatVars.' ELSE 'NumPlaces is consistent across StatVars.' END
    WHEN 'check_scaling_factor_consistency' THEN CASE WHEN n > 0 THEN 'Rule failed for ' || n || CASE WHEN n = 1 THEN ' StatVar.' ELSE ' StatVars.' END ELSE 'SQL validation passed.' END
    WHEN 'check_max_date_latest' THEN CASE WHEN s IS NULL OR substr(s, 1, 4) = '{year}' THEN 'Latest date is in {year}.' ELSE 'Latest date ' || s || ' is not in {year}.' END
    WHEN 'check_missing_refs_count' THEN 'Missing reference count: ' || n || ' (threshold 0).'
    WHEN 'check_structural_lint_error_count' THEN 'Structural lint errors: ' || n || ' (threshold 0).'
    WHEN 'check_observation_date_granularity' THEN CASE WHEN n > 1 THEN 'observationDate mixes granularities: ' || s || '.' ELSE 'observationDate uses a single granularity.' END
    ELSE 'No baseline found — skipping change detection (first run).' END AS message
FROM r"""
    )


@register("rules_events", _rules_events_sql)
def q_rules_events(spark, sf):
    rules = [dict(r, params=dict(r["params"], year=this_year())) if r["validator"] == "MAX_DATE_LATEST" else r for r in DEFAULT_RULES]
    res = R.run_rules(events_tables(spark, sf), rules)
    return res.select("dataset_id", "validation_name", "status", "message")


# ---------------------------------------------------------------------------
# W: series on monthly order counts
# ---------------------------------------------------------------------------


def _fluct_sql() -> str:
    return (
        TV.duckdb_with("obs_orders")
        + f""", pts AS ({dpoints('obs_orders')}),
pairs AS ({dpairs('pts')}),
cand AS (SELECT *, abs({dpct('prev_value', 'value')}) AS pct FROM pairs WHERE prev_date IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY pct DESC, d, date) AS rk FROM cand WHERE pct > 100.0)
SELECT {SERIES},
       CASE WHEN pct > 500.0 THEN 'StatsCheck_MaxPercentFluctuationGreaterThan500' ELSE 'StatsCheck_MaxPercentFluctuationGreaterThan100' END AS counter_key,
       prev_date, date AS curr_date, prev_value, value AS curr_value, pct
FROM best WHERE rk = 1"""
    )


@register("fluctuations_orders", _fluct_sql)
def q_fluct(spark, sf):
    return W.fluctuations(TV.obs_orders(spark, sf))


def _signals_sql() -> str:
    return (
        TV.duckdb_with("obs_orders")
        + f""", pts AS ({dpoints('obs_orders')}),
pairs AS (SELECT *, datediff('day', prev_d, d) AS g FROM ({dpairs('pts')})),
agg AS (
  SELECT {SERIES}, arg_max(struct_pack(prev_date, curr_date := date, prev_value, curr_value := value, prev_unit, curr_unit := unit,
                      prev_scalingFactor, curr_scalingFactor := scalingFactor, gap_days := g), struct_pack(k1 := d, k2 := date)) AS last,
         CAST(count(*) AS BIGINT) AS series_length, sum(g) AS gap_sum, count(g) AS gap_n
  FROM pairs GROUP BY ALL)
SELECT {SERIES}, last.prev_date AS prev_date, last.curr_date AS curr_date,
       last.prev_value AS previous_value, last.curr_value AS current_value,
       CASE WHEN last.prev_value IS NOT NULL AND last.curr_value IS NOT NULL THEN {dpct('last.prev_value', 'last.curr_value')} END AS percent_change,
       (last.prev_value IS NOT NULL AND abs(last.prev_value) < 1) AS previous_near_zero,
       (last.prev_value IS NOT NULL AND last.curr_value IS NOT NULL AND last.prev_value <= 0 AND last.curr_value > 0) AS first_valid_after_placeholder,
       CASE WHEN last.gap_days IS NULL THEN NULL
            WHEN {dperiod_days('observationPeriod')} IS NOT NULL THEN last.gap_days > {dperiod_days('observationPeriod')}
            WHEN series_length >= 3 AND gap_n > 0 THEN last.gap_days > greatest(1, CAST(floor(gap_sum / gap_n) AS BIGINT)) END AS missing_intermediate_periods,
       CASE WHEN last.prev_scalingFactor IS NOT NULL AND last.curr_scalingFactor IS NOT NULL THEN last.prev_scalingFactor <> last.curr_scalingFactor END AS scaling_changed,
       CASE WHEN last.prev_unit IS NOT NULL AND last.curr_unit IS NOT NULL THEN last.prev_unit <> last.curr_unit END AS unit_changed,
       CASE WHEN last.gap_days >= 0 THEN CAST(round(CAST(last.gap_days AS DECIMAL(20,6)) / CAST(365.25 AS DECIMAL(20,6)), 1) AS DECIMAL(10,1)) END AS period_gap_years,
       series_length
FROM agg WHERE last.prev_date IS NOT NULL"""
    )


@register("series_signals_orders", _signals_sql)
def q_signals(spark, sf):
    return W.series_signals(TV.obs_orders(spark, sf))


def _varied(sql: str) -> str:
    """An oracle over obs_orders, over the varied orders instead."""
    head = TV.duckdb_with("obs_orders")
    assert sql.startswith(head)
    return head.rstrip() + ",\nobs_orders_varied AS (" + TV.DUCKDB_VIEWS["obs_orders_varied"] + ")\n" + sql[len(head) :].replace("obs_orders", "obs_orders_varied")


@register("series_signals_varied", lambda: _varied(_signals_sql()))
def q_signals_varied(spark, sf):
    return W.series_signals(TV.obs_orders_varied(spark, sf))


def _holes_varied_sql() -> str:
    h = "datediff('day', from_d, d)"
    months = "((year(d) - year(from_d)) * 12 + month(d) - month(from_d))"
    body = (
        TV.duckdb_with("obs_orders")
        + f""", pts AS ({dpoints('obs_orders')}),
p AS (SELECT {SERIES}, date, {dparse('date')} AS d FROM pts),
l AS (SELECT *, lag(date) OVER w AS from_date, lag(d) OVER w AS from_d FROM p WHERE d IS NOT NULL
      WINDOW w AS (PARTITION BY {SERIES} ORDER BY d, date)),
g AS (SELECT *, quantile_cont({h}, 0.5) OVER s AS med, count(*) OVER s AS n FROM l WHERE from_d IS NOT NULL WINDOW s AS (PARTITION BY {SERIES})),
h AS (SELECT {SERIES}, from_date, date AS to_date,
         CAST(CASE observationPeriod WHEN 'P1M' THEN {months} - 1 WHEN 'P3M' THEN ceil({months} / 3.0) - 1 WHEN 'P30D' THEN ceil({h} / 30.0) - 1
              WHEN '' THEN CASE WHEN n >= 2 AND med > 0 THEN ceil({h} / med) - 1 END END AS BIGINT) AS missing FROM g)
SELECT * FROM h WHERE missing > 0"""
    )
    return _varied(body)


@register("data_holes_varied", _holes_varied_sql)
def q_holes_varied(spark, sf):
    return W.data_holes(TV.obs_orders_varied(spark, sf))


def _holes_sql() -> str:
    return (
        TV.duckdb_with("obs_orders")
        + f""", pts AS ({dpoints('obs_orders')}),
p AS (SELECT {SERIES}, date, {dparse('date')} AS d FROM pts),
l AS (SELECT *, lag(date) OVER w AS from_date, lag(d) OVER w AS from_d FROM p WHERE d IS NOT NULL
      WINDOW w AS (PARTITION BY {SERIES} ORDER BY d, date)),
h AS (SELECT {SERIES}, from_date, date AS to_date,
         CAST(ceil(((year(d) - year(from_d)) * 12 + month(d) - month(from_d)) / 1.0) - 1 AS BIGINT) AS missing
      FROM l WHERE from_d IS NOT NULL)
SELECT * FROM h WHERE missing > 0"""
    )


@register("data_holes_orders", _holes_sql)
def q_holes(spark, sf):
    return W.data_holes(TV.obs_orders(spark, sf))


def _gran_sql() -> str:
    g = """CASE WHEN regexp_matches(trim(observationDate), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'YYYY-MM-DD'
                WHEN regexp_matches(trim(observationDate), '^[0-9]{4}-[0-9]{2}$') THEN 'YYYY-MM'
                WHEN regexp_matches(trim(observationDate), '^[0-9]{4}$') THEN 'YYYY' END"""
    return (
        TV.duckdb_with("obs_events", "obs_orders")
        + f""", o AS (SELECT dataset_id, observationDate FROM obs_events UNION ALL
              SELECT dataset_id, observationDate FROM obs_orders
              UNION ALL SELECT dataset_id, substr(observationDate, 1, 4) FROM obs_orders),
g AS (SELECT dataset_id, {g} AS g FROM o)
SELECT dataset_id, src AS source, list_sort(list(DISTINCT g)) AS formats,
       CASE WHEN count(DISTINCT g) > 1 THEN 'WARNING' ELSE 'PASSED' END AS status
FROM (SELECT dataset_id, 'column' AS src, g FROM g UNION ALL SELECT dataset_id, 'all', g FROM g)
WHERE g IS NOT NULL GROUP BY dataset_id, src"""
    )


@register("date_granularity", _gran_sql)
def q_gran(spark, sf):
    ev = TV.obs_events(spark, sf)
    orders = TV.obs_orders(spark, sf)
    # the orders dataset also reported by year: a mixed-granularity dataset
    yearly = orders.withColumn("observationDate", F.substring("observationDate", 1, 4))
    return W.date_granularity_mix(ev.unionByName(orders).unionByName(yearly))


# ---------------------------------------------------------------------------
# Q: CSV quality facts on CSV-shaped views
# ---------------------------------------------------------------------------

from statgate.operators import diff as D  # noqa: E402
from statgate.operators import quality as Q  # noqa: E402

def _trimmed(columns: list[str]) -> str:
    return ", ".join(f"coalesce(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')" for c in columns)


def _first_dup_sql(view: str, columns: list[str]) -> str:
    return f"""SELECT __file AS file, min(__row) AS row FROM (
  SELECT __file, __row, row_number() OVER (PARTITION BY __file, {_trimmed(columns)} ORDER BY __row) AS rn FROM {view}) WHERE rn = 2 GROUP BY 1"""


FLAWED_COLUMNS = [*TV.LINEITEM_COLUMNS, "no_value"]


@register("quality_first_dup_documents", lambda: TV.duckdb_with("csv_documents") + _first_dup_sql("csv_documents", TV.DOCUMENT_COLUMNS))
def q_dup_docs(spark, sf):
    return Q.first_duplicate_row(TV.csv_documents(spark, sf))


@register("quality_first_dup_lineitem", lambda: TV.duckdb_with("csv_lineitem_flawed") + _first_dup_sql("csv_lineitem_flawed", FLAWED_COLUMNS))
def q_dup_lineitem(spark, sf):
    return Q.first_duplicate_row(TV.csv_lineitem(spark, sf, numbered=False, flawed=True), order="__order")


def _seen_list(columns: list[str]) -> str:
    each = ", ".join(f"{{'ord': {i + 1}, 'column': '{c}', 'seen': max(CASE WHEN regexp_matches({c}, '\\S') THEN 1 ELSE 0 END)}}" for i, c in enumerate(columns))
    return f"unnest([{each}], recursive := true)"


@register(
    "quality_empty_columns",
    lambda: TV.duckdb_with("csv_lineitem_flawed")
    + f"""SELECT file, "column", ord FROM (SELECT __file AS file, {_seen_list(FLAWED_COLUMNS)} FROM csv_lineitem_flawed GROUP BY 1) WHERE seen = 0""",
)
def q_empty_cols(spark, sf):
    # the check needs no record numbers, so none are made
    return Q.empty_columns(TV.csv_lineitem(spark, sf, numbered=False, flawed=True), FLAWED_COLUMNS)


@register(
    "quality_non_numeric",
    lambda: TV.duckdb_with("csv_lineitem")
    + """SELECT __file AS file, __row AS row FROM csv_lineitem
WHERE NOT (l_linestatus IS NULL OR NOT regexp_matches(l_linestatus, '\\S') OR regexp_matches(l_linestatus,
 '^\\s*[+-]?((([0-9](_?[0-9])*)(\\.([0-9](_?[0-9])*)?)?|\\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\\s*$'))""",
)
def q_non_numeric(spark, sf):
    return Q.non_numeric_rows(TV.csv_lineitem(spark, sf), "l_linestatus")


#: the header of the flawed CSV names a column twice
FLAWED_HEADER = [*FLAWED_COLUMNS, "l_tax"]


def _quality_facts_sql() -> str:
    """CTEs of the four checks over the flawed CSV: bad, sample (first five and total), dup, empty."""
    return (
        TV.duckdb_with("csv_lineitem_flawed")
        + f""", bad AS (SELECT __file AS file, __row AS row FROM csv_lineitem_flawed WHERE NOT regexp_matches(l_returnflag, '^\\s*[+-]?[0-9]+\\s*$')),
sample AS (SELECT file, list(row ORDER BY row)[1:5] AS sample, count(*) AS total FROM bad GROUP BY file),
dup AS ({_first_dup_sql('csv_lineitem_flawed', FLAWED_COLUMNS)}),
empty AS (SELECT file, "column" FROM (SELECT __file AS file, {_seen_list(FLAWED_COLUMNS)} FROM csv_lineitem_flawed GROUP BY 1) WHERE seen = 0)
"""
    )


def _verdict_sql() -> str:
    return (
        _quality_facts_sql()
        + """SELECT file, 'non_numeric_rows' AS "check",
       'Non-numeric value(s) in column ''l_returnflag'' at row(s) [' || array_to_string(sample, ', ') || ']' ||
       CASE WHEN total > 5 THEN ' (and ' || (total - 5) || ' more)' ELSE '' END AS message, true AS fatal
FROM sample
UNION ALL SELECT file, 'duplicate_rows', 'Duplicate row at 1-based row ' || row || ' (header is row 1)', true FROM dup
UNION ALL SELECT file, 'empty_columns', 'Column is entirely empty: ' || chr(39) || "column" || chr(39), false FROM empty
UNION ALL SELECT 'lineitem.csv', 'duplicate_columns', 'Duplicate column name(s): ' || chr(39) || 'l_tax' || chr(39), true
UNION ALL SELECT 'nothing.csv', 'header', 'CSV has no header row', true"""
    )


def _flawed_header(spark):
    rows = [("lineitem.csv", i + 1, c) for i, c in enumerate(FLAWED_HEADER)] + [("nothing.csv", None, None)]
    return spark.createDataFrame(rows, "file string, ord int, name string")


@register("quality_verdict_lineitem", _verdict_sql)
def q_verdict_lineitem(spark, sf):
    li = TV.csv_lineitem(spark, sf, numbered=False, flawed=True)
    return Q.quality_verdict(li, _flawed_header(spark), value_column="l_returnflag", columns=FLAWED_COLUMNS, order="__order")


@register("quality_duplicate_columns", "SELECT 'l_tax' AS name, 8 AS ord FROM (SELECT count(*) FROM lineitem)")
def q_duplicate_columns(spark, sf):
    # lineitem written as CSV files whose header names a column twice but for a space
    folder = scratch(spark, "named-twice")
    li = TV.table(spark, sf, "lineitem").select(*TV.LINEITEM_COLUMNS, F.col("l_tax").alias(" l_tax"))
    li.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(folder)
    return Q.duplicate_columns(SR.csv_header_table(spark, folder)).select("name", "ord").distinct()


def _manifest_sql(view: str, size: int) -> str:
    """S10 rows of a view without a failed check."""
    return f"""SELECT dataset_id, __file AS original_csv, 'done' AS status,
       list_transform(range(CAST(ceil(count(*) / {size}) AS BIGINT)), lambda k: 'shards/dataset_id=' || dataset_id || '/file=' || __file || '/shard=' || k) AS shard_paths,
       list_transform(range(CAST(ceil(count(*) / {size}) AS BIGINT)), lambda k: least({size}, count(*) - k * {size})) AS shard_rows,
       count(*) AS total_rows, CAST(ceil(count(*) / {size}) AS BIGINT) AS shard_count, CAST({size} AS BIGINT) AS rows_per_shard, CAST(1000 AS BIGINT) AS threshold_rows
FROM {view} GROUP BY dataset_id, __file"""


@register("shard_manifest_lineitem", lambda: TV.duckdb_with("csv_lineitem") + _manifest_sql("csv_lineitem", 10000))
def q_shards(spark, sf):
    # the manifest follows from counts, so no record is numbered
    return Q.shard_manifest(TV.csv_lineitem(spark, sf, numbered=False), rows_per_shard=10000, threshold_rows=1000, out_dir="shards")


@register(
    "shards_round_trip_lineitem",
    lambda: TV.duckdb_with("csv_lineitem")
    + f"""SELECT dataset_id, __file AS file, CAST(floor((__row - 2) / 7000) AS BIGINT) AS shard, count(*) AS rows, count(DISTINCT ({', '.join(TV.LINEITEM_COLUMNS)})) AS records,
       min(CAST(l_orderkey AS BIGINT)) AS first_order, max(CAST(l_orderkey AS BIGINT)) AS last_order, true AS in_order FROM csv_lineitem GROUP BY ALL""",
)
def q_shards_round_trip(spark, sf):
    from statgate.sources.writers import write_shards

    folder = scratch(spark, "shards")
    write_shards(TV.csv_lineitem(spark, sf), folder, 7000)
    back = spark.read.option("header", True).csv(folder).withColumn("at", F.monotonically_increasing_id())
    order = F.col("l_orderkey").cast("bigint")
    # a shard is one file of few bytes: its orders rise along the file
    falls = order < F.lag(order).over(Window.partitionBy("dataset_id", "file", "shard").orderBy("at"))
    return back.withColumn("falls", falls).groupBy("dataset_id", "file", F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(*TV.LINEITEM_COLUMNS).alias("records"), F.min(order).alias("first_order"),
        F.max(order).alias("last_order"), (F.count_if("falls") == 0).alias("in_order"),
    )


@register(
    "quality_details_lineitem",
    lambda: _quality_facts_sql()
    + """SELECT s.file, (SELECT list("column") FROM empty) AS empty_columns, ['l_tax'] AS duplicate_columns, [dup.row] AS duplicate_rows,
       s.total AS non_numeric_count, s.sample AS non_numeric_sample FROM sample s JOIN dup USING (file)
UNION ALL SELECT 'nothing.csv', [], [], [], 0, []""",
)
def q_quality_details(spark, sf):
    # Written and read back
    from statgate.sources.writers import write_quality

    folder = scratch(spark, "quality")
    li = TV.csv_lineitem(spark, sf, flawed=True)
    write_quality(Q.quality_details(li, _flawed_header(spark), "l_returnflag", FLAWED_COLUMNS), folder)
    schema = "file string, empty_columns array<string>, duplicate_columns array<string>, duplicate_rows array<bigint>, non_numeric_count bigint, non_numeric_sample array<bigint>"
    return spark.read.schema(schema).json(folder)


@register(
    "csv_round_trip_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
)
def q_csv_round_trip(spark, sf):
    # Texts with quotes, commas and newlines written as CSV files and read by their splits
    docs = TV.table(spark, sf, "documents").drop("__src")
    folder = scratch(spark, "documents-csv")
    docs.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    return SR.read_csv(spark, folder).select(*docs.columns)


# ---------------------------------------------------------------------------
# D: diff of monthly order counts, current vs baseline snapshot
# ---------------------------------------------------------------------------


def _diff_frame(spark, sf):
    return D.diff_observations(TV.obs_orders(spark, sf, "current"), TV.obs_orders(spark, sf, "baseline"))


_DKEY = "dataset_id, StatVar, observationAbout, observationDate, observationPeriod, measurementMethod, unit, scalingFactor"


def _diff_sql_body() -> str:
    k = f"""dataset_id, {dvar('variableMeasured')} AS StatVar, coalesce(trim(observationAbout), '') AS observationAbout,
       coalesce(trim(observationDate), '') AS observationDate, coalesce(trim(observationPeriod), '') AS observationPeriod,
       coalesce(trim(measurementMethod), '') AS measurementMethod, coalesce(trim(unit), '') AS unit,
       coalesce(trim(scalingFactor), '') AS scalingFactor"""
    return (
        TV.duckdb_with("obs_orders_current", "obs_orders_baseline")
        + f""", u AS (SELECT {k}, 'cur' AS side, TRY_CAST(value AS DOUBLE) AS num FROM obs_orders_current
          UNION ALL SELECT {k}, 'base' AS side, TRY_CAST(value AS DOUBLE) AS num FROM obs_orders_baseline),
g AS (SELECT {_DKEY}, max(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS in_cur, max(CASE WHEN side = 'base' THEN 1 ELSE 0 END) AS in_base,
             list_sort(list(DISTINCT num) FILTER (WHERE side = 'cur' AND num IS NOT NULL)) AS new_num,
             list_sort(list(DISTINCT num) FILTER (WHERE side = 'base' AND num IS NOT NULL)) AS old_num
      FROM u GROUP BY ALL),
diff AS (SELECT {_DKEY}, CASE WHEN in_base = 0 THEN 'ADDED' WHEN in_cur = 0 THEN 'DELETED'
                  WHEN coalesce(new_num, []) <> coalesce(old_num, []) THEN 'MODIFIED' ELSE 'SAME' END AS status FROM g),
differ AS (SELECT dataset_id, StatVar, CAST(count(*) FILTER (WHERE status = 'DELETED') AS BIGINT) AS DELETED,
                  CAST(count(*) FILTER (WHERE status = 'MODIFIED') AS BIGINT) AS MODIFIED,
                  CAST(count(*) FILTER (WHERE status = 'ADDED') AS BIGINT) AS ADDED
           FROM diff WHERE status <> 'SAME' GROUP BY ALL),
sizes AS (SELECT dataset_id, CAST(count(*) FILTER (WHERE status <> 'ADDED') AS BIGINT) AS previous_obs_size,
                 CAST(count(*) FILTER (WHERE status <> 'DELETED') AS BIGINT) AS current_obs_size,
                 CAST(count(*) FILTER (WHERE status <> 'SAME') AS BIGINT) AS obs_diff_size, false AS first_run
          FROM diff GROUP BY ALL)
"""
    )


@register("diff_status_orders", lambda: _diff_sql_body() + f"SELECT {_DKEY}, status FROM diff")
def q_diff_status(spark, sf):
    return _diff_frame(spark, sf).select(*D.DIFF_KEY, "dataset_id", "status")


@register("diff_summary_orders", lambda: _diff_sql_body() + "SELECT * FROM differ")
def q_diff_summary(spark, sf):
    return D.diff_summary(_diff_frame(spark, sf))


@register("diff_sizes_orders", lambda: _diff_sql_body() + "SELECT * FROM sizes")
def q_diff_sizes(spark, sf):
    return D.diff_sizes(_diff_frame(spark, sf))


@register(
    "change_totals_orders",
    lambda: _diff_sql_body()
    + """SELECT d.dataset_id, CAST(sum(DELETED) AS BIGINT) AS deleted, CAST(sum(MODIFIED) AS BIGINT) AS modified,
       CAST(sum(ADDED) AS BIGINT) AS added, CAST(count(DISTINCT StatVar) AS BIGINT) AS n_statvars,
       CAST(CASE WHEN any_value(previous_obs_size) > 0 THEN round(CAST(sum(MODIFIED) AS DECIMAL(38,10)) * 100 / CAST(any_value(previous_obs_size) AS DECIMAL(38,10)), 1) END AS DECIMAL(10,1)) AS modified_pct
FROM differ d LEFT JOIN sizes s USING (dataset_id) GROUP BY d.dataset_id""",
)
def q_change_totals(spark, sf):
    d = _diff_frame(spark, sf)
    return D.change_totals(D.diff_summary(d), D.diff_sizes(d))


@register(
    "top_changed_orders",
    lambda: _diff_sql_body()
    + """, t AS (SELECT dataset_id, regexp_replace(StatVar, '^dcid:', '') AS name, DELETED AS deleted, MODIFIED AS modified, ADDED AS added,
                 CAST(DELETED + MODIFIED + ADDED AS BIGINT) AS total FROM differ)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY total DESC, name) AS rank FROM t WHERE total > 0) WHERE rank <= 10""",
)
def q_top_changed(spark, sf):
    return D.top_changed(D.diff_summary(_diff_frame(spark, sf)))


def orders_tables(spark, sf) -> dict[str, DataFrame]:
    from statgate.session import checkpoint_dir, cut

    cur = TV.obs_orders(spark, sf, "current")
    counts = cut(D.diff_counts(D.diff_observations(cur, TV.obs_orders(spark, sf, "baseline"))))
    differ, sizes = D.differ_and_sizes(counts)
    return {"stats": A.variable_summary(cur), "differ": differ, "sizes": sizes}


DIFFER_RULES = [r for r in DEFAULT_RULES if r["scope"]["data_source"] == "differ"]


@register(
    "rules_differ_orders",
    lambda: _diff_sql_body()
    + """, t AS (SELECT d.dataset_id, sum(DELETED) AS deleted, count(DISTINCT MODIFIED) AS nm, count(DISTINCT ADDED) AS na,
                 any_value(previous_obs_size) AS prev FROM differ d JOIN sizes USING (dataset_id) GROUP BY 1)
SELECT dataset_id, 'check_deleted_records_count' AS validation_name, CASE WHEN deleted > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
       'Deleted observations: ' || deleted || ' (threshold 0).' AS message FROM t
UNION ALL SELECT dataset_id, 'check_deleted_records_percent', CASE WHEN deleted * 100.0 / prev > 5.0 THEN 'FAILED' ELSE 'PASSED' END,
       'Deleted observations: ' || CAST(round(CAST(deleted * 100 AS DECIMAL(38,6)) / CAST(prev AS DECIMAL(38,6)), 2) AS VARCHAR) || '% of the baseline (threshold 5%).' FROM t
UNION ALL SELECT dataset_id, 'check_modified_records_count', CASE WHEN nm > 1 THEN 'FAILED' ELSE 'PASSED' END,
       CASE WHEN nm > 1 THEN nm || ' distinct MODIFIED counts across StatVars.' ELSE 'MODIFIED counts are consistent across StatVars.' END FROM t
UNION ALL SELECT dataset_id, 'check_added_records_count', CASE WHEN na > 1 THEN 'FAILED' ELSE 'PASSED' END,
       CASE WHEN na > 1 THEN na || ' distinct ADDED counts across StatVars.' ELSE 'ADDED counts are consistent across StatVars.' END FROM t""",
)
def q_rules_differ(spark, sf):
    return R.run_rules(orders_tables(spark, sf), DIFFER_RULES).select("dataset_id", "validation_name", "status", "message")


# ---------------------------------------------------------------------------
# Lint report tables, profile, verdict
# ---------------------------------------------------------------------------

from statgate.operators import samples as S  # noqa: E402

_LINT = ("obs_events", "lint_entries", "lint_counters")


@register(
    "lint_totals",
    lambda: TV.duckdb_with(*_LINT)
    + "SELECT dataset_id, level, CAST(coalesce(sum(CASE WHEN regexp_matches(count, '^[0-9]+$') THEN CAST(count AS BIGINT) END), 0) AS BIGINT) AS total FROM lint_counters GROUP BY ALL",
)
def q_lint_totals(spark, sf):
    return A.lint_totals(TV.lint_counters(spark, sf))


@register(
    "counter_breakdown",
    lambda: TV.duckdb_with(*_LINT)
    + """SELECT dataset_id, level, CAST(list_position(['LEVEL_FATAL', 'LEVEL_ERROR', 'LEVEL_WARNING', 'LEVEL_INFO'], level) AS INTEGER) AS level_rank,
       CASE WHEN level <> 'LEVEL_ERROR' THEN 'all' WHEN starts_with(counterKey, 'Existence_FailedDcCall_') THEN 'resolution' ELSE 'structural' END AS grp,
       counterKey, count, coalesce(CASE WHEN regexp_matches(count, '^[0-9]+$') THEN CAST(count AS BIGINT) END, 0) AS count_num
FROM lint_counters WHERE level IN ('LEVEL_FATAL', 'LEVEL_ERROR', 'LEVEL_WARNING', 'LEVEL_INFO')""",
)
def q_counter_breakdown(spark, sf):
    return A.counter_breakdown(TV.lint_counters(spark, sf))


@register(
    "structural_lint_count",
    lambda: TV.duckdb_with(*_LINT)
    + """SELECT dataset_id, CAST(coalesce(sum(TRY_CAST(count AS BIGINT)), 0) AS BIGINT) AS n FROM lint_counters
WHERE level = 'LEVEL_ERROR' AND NOT starts_with(counterKey, 'Existence_FailedDcCall_') GROUP BY ALL""",
)
def q_structural(spark, sf):
    return A.structural_lint_count(TV.lint_counters(spark, sf))


@register(
    "lint_warnings",
    lambda: TV.duckdb_with(*_LINT)
    + """SELECT dataset_id, counterKey AS key, CAST(count(*) AS BIGINT) AS count FROM lint_entries
WHERE trim(level) IN ('LEVEL_WARNING', 'WARNING') AND counterKey IS NOT NULL AND counterKey <> '' AND NOT starts_with(counterKey, 'Existence_FailedDcCall_')
GROUP BY ALL""",
)
def q_lint_warnings(spark, sf):
    return A.lint_warnings(TV.lint_entries(spark, sf))


@register(
    "lint_errors",
    lambda: TV.duckdb_with(*_LINT)
    + """SELECT dataset_id, counterKey AS key, TRY_CAST(count AS BIGINT) AS count FROM lint_counters
WHERE level = 'LEVEL_ERROR' AND NOT starts_with(counterKey, 'Existence_FailedDcCall_')""",
)
def q_lint_errors(spark, sf):
    return A.lint_errors(TV.lint_counters(spark, sf))


def _by_type(spark, sf) -> DataFrame:
    """The variable summary of events with each event type as a dataset."""
    e = TV.obs_events(spark, sf)
    return A.variable_summary(e.withColumn("dataset_id", F.lower(F.regexp_extract("variableMeasured", "([^_]*)$", 1))))


@register(
    "counters_match",
    lambda: TV.duckdb_with("success_counters")
    + """SELECT e.event_type AS dataset_id, any_value(c.count) IS NULL OR (TRY_CAST(any_value(c.count) AS BIGINT) IS NOT NULL AND TRY_CAST(any_value(c.count) AS BIGINT) = count(*)) AS ok,
       CASE WHEN any_value(c.count) IS NULL THEN 'SKIPPED' WHEN TRY_CAST(any_value(c.count) AS BIGINT) IS NULL THEN 'ERROR'
            WHEN TRY_CAST(any_value(c.count) AS BIGINT) = count(*) THEN 'OK' ELSE 'MISMATCH' END AS status,
       count(*) AS actual, TRY_CAST(any_value(c.count) AS BIGINT) AS expected
FROM events e LEFT JOIN success_counters c ON c.dataset_id = e.event_type AND c.counterKey = 'NumNodeSuccesses' AND c.count IS NOT NULL GROUP BY 1""",
)
def q_counters_match(spark, sf):
    return A.counters_match(_by_type(spark, sf), TV.success_counters(spark, sf))


@register(
    "key_counters",
    lambda: TV.duckdb_with("success_counters")
    + """SELECT event_type AS dataset_id, 'TotalObservations' AS name, count(*) AS value FROM events GROUP BY 1
UNION ALL SELECT dataset_id, counterKey, CAST(sum(CASE WHEN regexp_matches(count, '^[0-9]+$') THEN CAST(count AS BIGINT) END) AS BIGINT)
FROM success_counters WHERE counterKey <> 'NumOther' AND count IS NOT NULL GROUP BY ALL""",
)
def q_key_counters(spark, sf):
    return A.key_counters(_by_type(spark, sf), TV.success_counters(spark, sf))


@register(
    "dataset_profile",
    lambda: TV.duckdb_with("obs_events", "obs_orders")
    + f""", stats AS ({_stats_sql('obs_events')} UNION ALL {_stats_sql('obs_orders')}),
kw AS (SELECT dataset_id, list_sort(list(DISTINCT k)) AS ks FROM stats, unnest(['Amount', 'Count', 'Index', 'Mean', 'Median', 'Percent', 'Rate', 'Ratio']) t(k)
       WHERE contains(lower(StatVar), lower(k)) GROUP BY ALL)
SELECT s.dataset_id, CAST(count(DISTINCT StatVar) AS BIGINT) AS num_statvars, min(MinDate) AS min_date, max(MaxDate) AS max_date,
       (max(MaxValue) > 1000 AND abs(min(MinValue)) < 1) AS mixed_scales,
       '[' || array_to_string(coalesce(any_value(kw.ks), []::VARCHAR[]), ', ') || ']' AS concepts
FROM stats s LEFT JOIN kw USING (dataset_id) GROUP BY s.dataset_id""",
)
def q_profile(spark, sf):
    stats = A.variable_summary(TV.obs_events(spark, sf).unionByName(TV.obs_orders(spark, sf)))
    return A.dataset_profile(stats)


@register(
    "artifact_profile",
    lambda: TV.duckdb_with("obs_orders")
    + f""", pts AS ({dpoints('obs_orders')})
SELECT dataset_id, CAST(count(DISTINCT StatVar) AS BIGINT) AS num_variables, count(DISTINCT unit) > 1 AS mixed_units,
       bool_or(date IS NOT NULL AND date <> '') AS dates_present FROM pts GROUP BY ALL""",
)
def q_artifact_profile(spark, sf):
    pts = W.series_points(TV.obs_orders(spark, sf)).select("dataset_id", F.col("StatVar").alias("statVarDcid"), "unit", "date")
    return A.artifact_profile(pts)


def _year_rules(rules):
    return [dict(r, params=dict(r["params"], year=this_year())) if r["validator"] == "MAX_DATE_LATEST" else r for r in rules]


def events_outcome(spark, sf, extra_rules=(), tables=None) -> R.Outcome:
    rules = _year_rules(DEFAULT_RULES) + list(extra_rules)
    made = R.evaluate(tables or events_tables(spark, sf), rules)
    return R.Outcome(R.inject_missing(made.results, rules), made.violations)


def events_results(spark, sf, extra_rules=(), tables=None):
    return events_outcome(spark, sf, extra_rules, tables).results


def _verdict_sql() -> str:
    return f"""{_rules_events_sql()}""".replace("\nFROM r", "\nFROM r") 


def _events_results_sql() -> str:
    # the rules_events oracle, as a CTE named res
    body = _rules_events_sql()
    head, _, tail = body.partition("\nSELECT dataset_id, validation_name,\n  CASE")
    return head + ",\nres AS (SELECT dataset_id, validation_name,\n  CASE" + tail + ")\n"


@register(
    "verdict_events",
    lambda: _events_results_sql()
    + """SELECT dataset_id,
       CASE WHEN blockers > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'PASS (with ' || warnings || CASE WHEN warnings = 1 THEN ' warning)' ELSE ' warnings)' END ELSE 'PASS' END AS overall,
       blockers, warnings, passed
FROM (SELECT dataset_id, CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS blockers,
             CAST(count(*) FILTER (WHERE status = 'WARNING') AS BIGINT) AS warnings,
             CAST(count(*) FILTER (WHERE status = 'PASSED') AS BIGINT) AS passed FROM res GROUP BY ALL)""",
)
def q_verdict(spark, sf):
    return A.verdict(events_results(spark, sf))


WARN_ONLY_EVENTS = {" Events ": ["CHECK_MAX_DATE_LATEST ", "check_unit_consistency"]}


@register(
    "warn_only_events",
    lambda: _events_results_sql()
    + """SELECT dataset_id, validation_name,
       CASE WHEN status = 'FAILED' AND validation_name IN ('check_max_date_latest', 'check_unit_consistency') THEN 'WARNING' ELSE status END AS status
FROM res""",
)
def q_warn_only(spark, sf):
    return R.apply_warn_only(events_results(spark, sf), WARN_ONLY_EVENTS).select("dataset_id", "validation_name", "status")


@register(
    "blocked_events",
    lambda: _events_results_sql() + "SELECT dataset_id, bool_or(status IN ('FAILED', 'CONFIG_ERROR')) AS blocked FROM res GROUP BY ALL",
)
def q_blocked(spark, sf):
    return R.is_blocked(events_results(spark, sf))


CUSTOM_SQL_RULES = [
    {
        "rule_id": "check_events_volume",
        "validator": "SQL_VALIDATOR",
        "scope": {"data_source": "stats"},
        "params": {"query": "SELECT StatVar, NumObservations FROM stats", "condition": "NumObservations < 2000"},
    },
    {
        "rule_id": "check_bad_column",
        "validator": "SQL_VALIDATOR",
        "scope": {"data_source": "stats"},
        "params": {"query": "SELECT StatVar, NoSuchColumn FROM stats", "condition": "NoSuchColumn > 0"},
    },
    {"rule_id": "check_goldens_absent", "validator": "GOLDENS_CHECK", "scope": {"data_source": "stats"}, "params": {}},
]


@register(
    "custom_rules_events",
    lambda: TV.duckdb_with("obs_events")
    + f""", stats AS ({_stats_sql('obs_events')}),
v AS (SELECT dataset_id, count(*) FILTER (WHERE NOT (NumObservations < 2000)) AS n FROM stats GROUP BY ALL)
SELECT dataset_id, 'check_events_volume' AS validation_name, CASE WHEN n > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
       CASE WHEN n > 0 THEN 'Rule failed for ' || n || CASE WHEN n = 1 THEN ' StatVar.' ELSE ' StatVars.' END ELSE 'SQL validation passed.' END AS message FROM v
UNION ALL SELECT dataset_id, 'check_bad_column', 'CONFIG_ERROR', NULL FROM v
UNION ALL SELECT dataset_id, 'check_goldens_absent', 'FAILED',
       'Rule did not execute — DC runner exited before producing a result. Check runner stderr for details (e.g. import errors or crashes).' FROM v""",
)
def q_custom_rules(spark, sf):
    rules = CUSTOM_SQL_RULES
    res = R.inject_missing(R.run_rules(events_tables(spark, sf), rules), rules)
    # the analyzer's error text is engine-specific: compare the status only for CONFIG_ERROR rows
    return res.select(
        "dataset_id", "validation_name", "status", F.when(F.col("status") != "CONFIG_ERROR", F.col("message")).alias("message")
    )


@register(
    "config_errors_events",
    lambda: TV.duckdb_with("obs_events") + "SELECT DISTINCT dataset_id, 'check_bad_column' AS rule_id FROM obs_events",
)
def q_config_errors(spark, sf):
    res = R.run_rules(events_tables(spark, sf), CUSTOM_SQL_RULES[:2])
    return R.config_errors(res).select("dataset_id", "rule_id")


def _samples_sql() -> str:
    year = this_year()
    return (
        TV.duckdb_with("obs_events", "lint_entries", "lint_counters")
        + f""", stats AS ({_stats_sql('obs_events')}),
firstrec AS (SELECT dataset_id, trim(variableMeasured) AS var, arg_min(struct_pack(row := __row, location := trim(observationAbout),
                  date := trim(observationDate), file := __file), __row) AS rec FROM obs_events GROUP BY ALL),
units AS (SELECT dataset_id, 'check_unit_consistency' AS rule, StatVar AS statVar, NULL AS location, NULL AS date,
                 CASE WHEN Units = '[]' THEN '(missing)' ELSE array_to_string(list_filter(list_transform(string_split(regexp_replace(Units, '^\\[|\\]*$', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> ''), ', ') END AS value,
                 'consistent units (one unit per StatVar)' AS expected, NULL AS sourceRow
          FROM stats WHERE (SELECT count(DISTINCT Units) FROM stats) > 1),
latest AS (SELECT DISTINCT dataset_id, 'check_max_date_latest' AS rule, NULL AS statVar, NULL AS location, NULL AS date, NULL AS value, '' AS expected, NULL AS sourceRow
           FROM stats WHERE (SELECT substr(max(MaxDate), 1, 4) FROM stats) <> '{year}'),
refs AS (SELECT DISTINCT dataset_id, 'check_missing_refs_count', NULL, NULL, NULL, NULL, '', NULL FROM lint_counters
         WHERE (SELECT sum(CAST(count AS BIGINT)) FROM lint_counters WHERE regexp_matches(counterKey, '(?i)missing.*ref')) > 0),
lint AS (SELECT DISTINCT dataset_id, 'check_structural_lint_error_count', NULL, NULL, NULL, NULL, '0 structural lint errors', NULL FROM lint_counters
         WHERE (SELECT sum(CAST(count AS BIGINT)) FROM lint_counters WHERE level = 'LEVEL_ERROR' AND NOT starts_with(counterKey, 'Existence_FailedDcCall_')) > 0),
vol AS (SELECT s.dataset_id, 'check_events_volume', s.StatVar, f.rec.location, f.rec.date, 'NumObservations: ' || s.NumObservations,
               'NumObservations < 2000', f.rec.file || ':' || f.rec.row
        FROM stats s LEFT JOIN firstrec f ON f.dataset_id = s.dataset_id AND (f.var = s.StatVar OR ends_with(f.var, ':' || s.StatVar) OR ends_with(f.var, '/' || s.StatVar))
        WHERE NOT (s.NumObservations < 2000))
SELECT * FROM units UNION ALL SELECT * FROM latest UNION ALL SELECT * FROM refs UNION ALL SELECT * FROM lint UNION ALL SELECT * FROM vol"""
    )


@register("failure_samples_events", _samples_sql)
def q_samples(spark, sf):
    tables = events_tables(spark, sf)
    made = events_outcome(spark, sf, CUSTOM_SQL_RULES[:1], tables=tables)
    stats = tables["stats"]
    s = cut(S.failure_samples(made.results, made.violations))
    s = S.expand_units(S.enrich_samples(s, TV.obs_events(spark, sf)), stats)
    return s.select("dataset_id", "rule", "statVar", "location", "date", "value", "expected", "sourceRow")


@register(
    "top_lint",
    lambda: TV.duckdb_with(*_LINT)
    + """, e AS (SELECT dataset_id, CASE level WHEN 'LEVEL_ERROR' THEN 0 WHEN 'LEVEL_WARNING' THEN 1 WHEN 'LEVEL_INFO' THEN 2 ELSE 3 END AS lvl,
                 coalesce(file, '') AS file, coalesce(TRY_CAST(lineNumber AS BIGINT), 0) AS line, level, counterKey, userMessage,
                 starts_with(coalesce(counterKey, ''), 'Existence_FailedDcCall_') AS resolution FROM lint_entries),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, resolution ORDER BY lvl, file, line, counterKey, userMessage) AS rank FROM e),
s AS (SELECT * FROM r WHERE NOT resolution AND rank <= 5),
ns AS (SELECT dataset_id, count(*) AS ns FROM s GROUP BY 1),
x AS (SELECT *, 0 AS grp FROM s UNION ALL
      SELECT r.*, 1 FROM r LEFT JOIN ns USING (dataset_id) WHERE resolution AND rank <= 10 - coalesce(ns, 0))
SELECT dataset_id, CAST(grp * 100 + rank AS INTEGER) AS position, file, line, regexp_replace(level, '^LEVEL_', '') AS level, counterKey,
       CASE WHEN length(coalesce(userMessage, '')) > 120 THEN substr(userMessage, 1, 117) || '...' ELSE coalesce(userMessage, '') END AS message
FROM x""",
)
def q_top_lint(spark, sf):
    return S.top_lint(TV.lint_entries(spark, sf))


@register(
    "goldens_check_orders",
    lambda: TV.duckdb_with("obs_orders_current", "obs_orders_baseline")
    + """, m AS (SELECT DISTINCT dataset_id, variableMeasured, observationAbout, observationDate FROM obs_orders_baseline
           EXCEPT SELECT dataset_id, variableMeasured, observationAbout, observationDate FROM obs_orders_current)
SELECT 'orders' AS dataset_id, 'check_goldens' AS validation_name, CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
       CASE WHEN count(*) > 0 THEN 'Found ' || count(*) || CASE WHEN count(*) = 1 THEN ' missing golden record.' ELSE ' missing golden records.' END
            ELSE 'All golden records found.' END AS message FROM m""",
)
def q_goldens(spark, sf):
    cur = TV.obs_orders(spark, sf, "current")
    goldens = TV.obs_orders(spark, sf, "baseline").select("dataset_id", "variableMeasured", "observationAbout", "observationDate").distinct()
    rule = {"rule_id": "check_goldens", "validator": "GOLDENS_CHECK", "scope": {"data_source": "stats"}, "params": {}}
    tables = {"stats": A.variable_summary(cur), "goldens": goldens, "obs": cur}
    return R.run_rules(tables, [rule]).select("dataset_id", "validation_name", "status", "message")


# ---------------------------------------------------------------------------
# T: template / node review over part-derived node triples
# ---------------------------------------------------------------------------

from statgate.operators import review as T  # noqa: E402

_HDR = "hdr AS (SELECT 'parts' AS dataset_id, * FROM (VALUES (1, 'p_partkey'), (2, 'p_name'), (3, 'p_brand'), (4, 'p_type'), (5, 'p_size'), (6, 'p_retailprice')) h(ord, name))"
_NP = """np AS (SELECT dataset_id, file, node_line, node,
       max(CASE WHEN prop = 'typeOf' THEN value END) AS typeOf, max(CASE WHEN prop = 'variableMeasured' THEN value END) AS variableMeasured,
       max(CASE WHEN prop = 'observationAbout' THEN value END) AS observationAbout, max(CASE WHEN prop = 'observationDate' THEN value END) AS observationDate,
       max(CASE WHEN prop = 'populationType' THEN value END) AS populationType, max(CASE WHEN prop = 'measuredProperty' THEN value END) AS measuredProperty,
       max(CASE WHEN prop = 'unit' THEN value END) AS unit, max(CASE WHEN prop = 'statType' THEN value END) AS statType,
       max(CASE WHEN prop = 'measurementDenominator' THEN value END) AS measurementDenominator
     FROM nodes_parts GROUP BY ALL)"""


def _parts_headers(spark, sf):
    return TV.csv_header(TV.table(spark, sf, "part"), "parts", "parts.csv", TV.PART_COLUMNS)


def _t1_t2_sql() -> str:
    return f""", refs AS (SELECT dataset_id, trim(regexp_extract(value, 'C:[^>]+->(.+)$', 1)) AS ref, node_line FROM nodes_parts),
cref AS (SELECT dataset_id, ref, min(node_line) AS first_line FROM refs WHERE ref <> '' GROUP BY ALL),
{_HDR},
t1 AS (SELECT dataset_id, 'schema' AS type, 'Column reference ''' || ref || ''' does not exist in CSV header (case-sensitive).' AS message,
              'blocker' AS severity, CAST(first_line AS BIGINT) AS ord FROM cref WHERE ref NOT IN (SELECT name FROM hdr)),
un AS (SELECT h.*, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS rk, count(*) OVER (PARTITION BY dataset_id) AS n
       FROM hdr h WHERE name NOT IN (SELECT ref FROM cref)),
t2 AS (SELECT dataset_id, 'unused_column' AS type, 'CSV column ''' || name || ''' is not referenced in the TMCF (unused column).' AS message,
              'warning' AS severity, CAST(rk AS BIGINT) AS ord FROM un WHERE rk <= 10
       UNION ALL SELECT dataset_id, 'unused_column', '… and ' || (n - 10) || ' more unused CSV columns.', 'warning', 11 FROM un WHERE rk = 1 AND n > 10)
"""


@register("review_column_refs", lambda: TV.duckdb_with("nodes_parts") + _t1_t2_sql() + "SELECT * FROM t1 UNION ALL SELECT * FROM t2")
def q_review_refs(spark, sf):
    nodes, hdr = TV.nodes_parts(spark, sf), _parts_headers(spark, sf)
    out = T.column_refs_missing(nodes, hdr).unionByName(T.unused_columns(nodes, hdr))
    return out.select("dataset_id", "type", "message", "severity", "ord")


def _node_checks_sql() -> str:
    return (
        TV.duckdb_with("nodes_parts")
        + f""", {_NP},
obs AS (SELECT * FROM np WHERE contains(lower(coalesce(typeOf, '')), 'statvarobservation')),
t3 AS (SELECT dataset_id, file, node_line AS line, 'missing_required_property' AS type, 'StatVarObservation node is missing ''variableMeasured''.' AS message, 'warning' AS severity FROM obs WHERE coalesce(trim(variableMeasured), '') = ''
       UNION ALL SELECT dataset_id, file, node_line, 'missing_required_property', 'StatVarObservation node is missing ''observationAbout''.', 'warning' FROM obs WHERE coalesce(trim(observationAbout), '') = ''
       UNION ALL SELECT dataset_id, file, node_line, 'missing_required_property', 'StatVarObservation node is missing ''observationDate''.', 'warning' FROM obs WHERE coalesce(trim(observationDate), '') = ''),
t5 AS (SELECT dataset_id, file, node_line, 'format', 'observationDate literal ''' || trim(value) || ''' does not match ISO 8601 (use YYYY, YYYY-MM, or YYYY-MM-DD).', 'warning'
       FROM nodes_parts WHERE lower(prop) = 'observationdate' AND NOT starts_with(trim(value), 'C:') AND NOT regexp_matches(trim(value), '^[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?$')),
sv AS (SELECT * FROM np WHERE contains(lower(trim(coalesce(typeOf, ''))), 'statisticalvariable')),
t8 AS (SELECT dataset_id, file, node_line, 'mcf_required', 'Missing or empty ''populationType'' for StatVar node.', 'warning' FROM sv WHERE coalesce(trim(populationType), '') = ''
       UNION ALL SELECT dataset_id, file, node_line, 'mcf_required', 'Missing or empty ''measuredProperty'' for StatVar node.', 'warning' FROM sv WHERE coalesce(trim(measuredProperty), '') = ''),
t9 AS (SELECT dataset_id, file, node_line, 'missing_measurement_denominator',
              'Consider adding measurementDenominator for percent/rate StatVar ''' ||
              CASE WHEN coalesce(node, '') <> '' THEN {dvar('node')} ELSE 'line ' || node_line END || ''' to improve semantic clarity.', 'warning'
       FROM np WHERE (contains(lower(coalesce(unit, '')), 'percent') OR contains(lower(coalesce(statType, '')), 'rate') OR contains(lower(coalesce(measuredProperty, '')), 'rate'))
         AND replace(lower({dvar("coalesce(statType, '')")}), '-', '_') NOT IN ('growthrate', 'growth_rate', 'changerate', 'change_rate', 'rateofchange', 'rate_of_change')
         AND coalesce(trim(measurementDenominator), '') = '')
SELECT * FROM t3 UNION ALL SELECT * FROM t5 UNION ALL SELECT * FROM t8 UNION ALL SELECT * FROM t9"""
    )


@register("review_node_checks", _node_checks_sql)
def q_review_nodes(spark, sf):
    n = TV.nodes_parts(spark, sf)
    out = T.missing_observation_props(n).unionByName(T.bad_date_literals(n)).unionByName(T.missing_variable_props(n)).unionByName(T.missing_denominator(n))
    return out.select("dataset_id", "file", "line", "type", "message", "severity")


def _gen_vars_sql() -> str:
    return (
        TV.duckdb_with("nodes_parts")
        + f""", vm AS (SELECT dataset_id, trim(value) AS v FROM nodes_parts WHERE prop = 'variableMeasured'),
cols AS (SELECT DISTINCT dataset_id, regexp_extract(v, '->\\s*([^\\s#]+)', 1) AS col FROM vm WHERE starts_with(v, 'C:') AND contains(v, '->')),
vals AS (SELECT 'parts' AS dataset_id, 'p_type' AS col, trim(p_type) AS val FROM part UNION ALL SELECT 'parts', 'p_name', trim(p_name) FROM part
         UNION ALL SELECT 'parts', 'p_brand', trim(p_brand) FROM part),
vars AS (SELECT DISTINCT dataset_id, variable FROM (
           SELECT dataset_id, {dvar('v')} AS variable FROM vm WHERE NOT starts_with(v, 'C:')
           UNION ALL SELECT dataset_id, {dvar('val')} FROM vals JOIN cols USING (dataset_id, col) WHERE val <> '') WHERE variable <> '')
"""
    )


@register("review_generated_variables", lambda: _gen_vars_sql() + "SELECT * FROM vars")
def q_gen_vars(spark, sf):
    return T.generated_variables(TV.nodes_parts(spark, sf), TV.parts_csv(spark, sf))


@register(
    "review_bad_variable_ids",
    lambda: _gen_vars_sql()
    + """SELECT dataset_id, 'format' AS type, 'StatVar DCID ''' || variable || ''' does not match required format (UpperCamelCase segments separated by underscores; decimals like 1.38 allowed).' AS message
FROM vars WHERE NOT regexp_matches(variable, '^[A-Z0-9]([A-Za-z0-9]|\\.[0-9]+)*(_[A-Z0-9]([A-Za-z0-9]|\\.[0-9]+)*)*$')""",
)
def q_bad_ids(spark, sf):
    v = T.generated_variables(TV.nodes_parts(spark, sf), TV.parts_csv(spark, sf))
    return T.bad_variable_ids(v).select("dataset_id", "type", "message")


@register(
    "review_undefined_variables",
    lambda: _gen_vars_sql()
    + f"""SELECT dataset_id, 'unknown_statvar' AS type, 'StatVar ''' || variable || ''' is not defined in the provided node files.' AS message
FROM vars WHERE variable NOT IN (SELECT {dvar('node')} FROM nodes_parts)""",
)
def q_undefined(spark, sf):
    n = TV.nodes_parts(spark, sf)
    v = T.generated_variables(n, TV.parts_csv(spark, sf))
    return T.undefined_variables(v, n).select("dataset_id", "type", "message")


@register(
    "review_structural",
    lambda: TV.duckdb_with("nodes_parts")
    + """, per AS (SELECT dataset_id, file, node_line, node, prop, count(*) AS n FROM nodes_parts GROUP BY ALL),
ni AS (SELECT dataset_id, file, node_line, coalesce(sum(n) FILTER (WHERE prop = 'typeOf'), 0) AS n_type FROM per GROUP BY ALL),
ty AS (SELECT dataset_id, file, node_line, bool_or(contains(lower(value), 'statvarobservation')) AS is_obs,
              bool_or(regexp_matches(value, '^\\s*StatVarObservation\\s*$')) AS no_prefix FROM nodes_parts WHERE prop = 'typeOf' GROUP BY ALL)
SELECT dataset_id, file, node_line AS line, 'duplicate' AS type, 'Property ''' || prop || ''' appears ' || n || ' times in node.' AS message FROM per WHERE n > 1 AND prop <> 'typeOf'
UNION ALL SELECT dataset_id, file, node_line, 'schema', 'Node has no typeOf.' FROM ni WHERE n_type = 0
UNION ALL SELECT dataset_id, file, node_line, 'schema', 'Node has more than one typeOf.' FROM ni WHERE n_type > 1
UNION ALL SELECT n.dataset_id, n.file, n.node_line, 'naming', 'Non-standard property ''' || prop || ''' on StatVarObservation node.'
  FROM nodes_parts n JOIN ty USING (dataset_id, file, node_line) WHERE is_obs AND prop NOT IN ('typeOf', 'variableMeasured', 'observationAbout',
       'observationDate', 'value', 'unit', 'measurementMethod', 'observationPeriod', 'scalingFactor')
UNION ALL SELECT dataset_id, file, node_line, 'namespace', 'typeOf StatVarObservation lacks the dcs: prefix.' FROM ty WHERE no_prefix""",
)
def q_structural_nodes(spark, sf):
    return T.structural_node_lint(TV.nodes_parts(spark, sf)).select("dataset_id", "file", "line", "type", "message")


@register(
    "review_merged",
    lambda: TV.duckdb_with("nodes_parts")
    + _t1_t2_sql()
    + f""", {_NP},
obs AS (SELECT * FROM np WHERE contains(lower(coalesce(typeOf, '')), 'statvarobservation')),
t3 AS (SELECT dataset_id, file, node_line AS line, 'missing_required_property' AS type, 'StatVarObservation node is missing ''variableMeasured''.' AS message, node_line * 10 AS ord FROM obs WHERE coalesce(trim(variableMeasured), '') = ''
       UNION ALL SELECT dataset_id, file, node_line, 'missing_required_property', 'StatVarObservation node is missing ''observationAbout''.', node_line * 10 + 1 FROM obs WHERE coalesce(trim(observationAbout), '') = ''
       UNION ALL SELECT dataset_id, file, node_line, 'missing_required_property', 'StatVarObservation node is missing ''observationDate''.', node_line * 10 + 2 FROM obs WHERE coalesce(trim(observationDate), '') = ''),
p AS (SELECT dataset_id, NULL AS file, NULL AS line, type, message, ord, 0 AS grp FROM t1),
np1 AS (SELECT dataset_id, count(*) AS np FROM p GROUP BY 1),
s AS (SELECT t3.dataset_id, file, line, type, message, ord, 1 AS grp, row_number() OVER (PARTITION BY t3.dataset_id ORDER BY ord, file, message) AS rk, np
      FROM t3 LEFT JOIN np1 USING (dataset_id)),
b AS (SELECT * FROM p UNION ALL SELECT dataset_id, file, line, type, message, ord, grp FROM s WHERE rk <= greatest(0, 25 - coalesce(np, 0))),
d AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, type, regexp_replace(trim(message), '\\s+', ' ', 'g'), coalesce(file, '') ORDER BY grp, ord, line) AS k FROM b)
SELECT dataset_id, file, CAST(line AS BIGINT) AS line, type, message, CAST(ord AS BIGINT) AS ord, grp FROM d WHERE k = 1""",
)
def q_review_merged(spark, sf):
    n, hdr = TV.nodes_parts(spark, sf), _parts_headers(spark, sf)
    m = T.merge_issues(T.column_refs_missing(n, hdr), T.missing_observation_props(n), cap=25)
    return m.select("dataset_id", "file", "line", "type", "message", "ord", F.col("grp").cast("int").alias("grp"))


@register(
    "review_severity",
    lambda: TV.duckdb_with("nodes_parts")
    + _t1_t2_sql()
    + "SELECT type, CASE WHEN type IN ('typo', 'schema', 'unknown_statvar', 'duplicate', 'required', 'namespace') THEN 'blocker' ELSE 'warning' END AS severity, message FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)",
)
def q_review_severity(spark, sf):
    n, hdr = TV.nodes_parts(spark, sf), _parts_headers(spark, sf)
    issues = T.column_refs_missing(n, hdr).unionByName(T.unused_columns(n, hdr)).withColumn("severity", F.lit("info"))
    return T.normalize_severity(issues).select("type", "severity", "message")


# ---------------------------------------------------------------------------
# B: bulk folder discovery over a page-derived object listing
# ---------------------------------------------------------------------------

from statgate.operators import bulk as B  # noqa: E402
from statgate.streaming import run_events as P  # noqa: E402

_CLASSIFY_SQL = """, f AS (SELECT substr(path, 6) AS rel, path, size FROM listing WHERE starts_with(path, 'root/')),
d AS (SELECT split_part(rel, '/', 1) AS folder, substr(rel, strpos(rel, '/') + 1) AS base, path, size FROM f WHERE contains(rel, '/') AND NOT ends_with(rel, '/')),
dd AS (SELECT folder, lower(base) AS b, max(path) AS path, max(size) AS size FROM d WHERE NOT contains(base, '/') GROUP BY ALL),
k AS (SELECT *, CASE WHEN b = 'validation_config.json' THEN 'config'
                     WHEN ends_with(b, '_stat_vars_schema.mcf') OR b = 'stat_vars_schema.mcf' THEN 'schema'
                     WHEN ends_with(b, '_stat_vars.mcf') OR b = 'stat_vars.mcf' THEN 'statvars'
                     WHEN ends_with(b, '_output.tmcf') THEN 'tmcf' WHEN ends_with(b, '_output.csv') THEN 'csv' END AS kind FROM dd),
g AS (SELECT fo.folder, coalesce(list_sort(list(b) FILTER (WHERE kind = 'tmcf')), []) AS tmcfs, coalesce(list_sort(list(b) FILTER (WHERE kind = 'csv')), []) AS csvs,
             coalesce(list_sort(list(b) FILTER (WHERE kind = 'statvars')), []) AS statvars, coalesce(list_sort(list(b) FILTER (WHERE kind = 'schema')), []) AS schemas,
             max(path) FILTER (WHERE kind = 'config') AS config,
             coalesce(map_from_entries(list(struct_pack(k := b, v := path)) FILTER (WHERE b IS NOT NULL)), MAP {}) AS paths
      FROM (SELECT DISTINCT folder FROM d) fo LEFT JOIN k ON k.folder = fo.folder GROUP BY fo.folder),
c AS (SELECT *, tmcfs[1] AS tmcf, substr(tmcfs[1], 1, length(tmcfs[1]) - 5) || '.csv' AS expected_csv,
             paths[substr(tmcfs[1], 1, length(tmcfs[1]) - 5) || '.csv'] AS csv_path FROM g),
r AS (SELECT *, CASE WHEN len(statvars) > 1 THEN 'multiple *_stat_vars.mcf files (' || array_to_string(statvars, ', ') || ')'
                     WHEN len(schemas) > 1 THEN 'multiple *_stat_vars_schema.mcf files (' || array_to_string(schemas, ', ') || ')'
                     WHEN len(tmcfs) = 0 THEN 'missing *_output.tmcf (exactly one required)'
                     WHEN len(tmcfs) > 1 THEN 'multiple *_output.tmcf files (' || array_to_string(tmcfs, ', ') || ')'
                     WHEN len(csvs) > 1 THEN 'multiple *_output.csv files (' || array_to_string(csvs, ', ') || ')'
                     WHEN csv_path IS NULL AND len(csvs) > 0 THEN 'no *_output.csv matching ' || tmcf || ' (found ' || csvs[1] || ' instead)'
                     WHEN csv_path IS NULL THEN 'no matching *_output.csv for ' || tmcf END AS reason FROM c),
slug AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(trim(folder)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '', '') AS s0 FROM r),
cls AS (SELECT folder,
       CASE WHEN reason IS NULL THEN CASE WHEN length(regexp_replace(substr(s0, 1, 48), '-+$', '')) < 3 THEN 'ds-' || substr(sha256(trim(folder)), 1, 8)
            ELSE regexp_replace(substr(s0, 1, 48), '-+$', '') END END AS dataset_id,
       CASE WHEN reason IS NULL THEN csv_path END AS csv, CASE WHEN reason IS NULL THEN paths[tmcf] END AS tmcf,
       CASE WHEN reason IS NULL THEN coalesce(paths[statvars[1]], '') END AS statvars, CASE WHEN reason IS NULL THEN coalesce(paths[schemas[1]], '') END AS schema,
       CASE WHEN reason IS NULL THEN coalesce(config, '') END AS config, reason FROM slug)
"""


@register("bulk_classify", lambda: TV.duckdb_with("listing") + _CLASSIFY_SQL + "SELECT * FROM cls")
def q_bulk_classify(spark, sf):
    return B.classify_folders(TV.listing_pages(spark, sf), "root")


@register(
    "bulk_csv_bytes",
    lambda: TV.duckdb_with("listing") + _CLASSIFY_SQL
    + "SELECT folder, dataset_id, CAST(coalesce(sum(size), 0) AS BIGINT) AS csv_total_bytes FROM cls LEFT JOIN listing ON listing.path = cls.csv WHERE reason IS NULL GROUP BY ALL",
)
def q_bulk_bytes(spark, sf):
    listing = TV.listing_pages(spark, sf)
    return B.csv_bytes(listing, B.classify_folders(listing, "root"))


@register(
    "bulk_outcome",
    lambda: TV.duckdb_with("listing") + _CLASSIFY_SQL
    + """, dec AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY dataset_id, reason IS NULL ORDER BY folder) = 1 THEN 'submit' ELSE 'skipped' END AS action FROM cls),
a AS (SELECT CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE action = 'submit') AS BIGINT) AS runnable, CAST(count(*) FILTER (WHERE action = 'skipped') AS BIGINT) AS skipped FROM dec)
SELECT CASE WHEN found = 0 THEN 'empty_root' WHEN runnable > 0 THEN 'ok' ELSE 'no_runnable' END AS code,
       CASE WHEN found = 0 THEN 'No dataset folders found under this path.' WHEN runnable > 0 THEN ''
            ELSE 'No runnable dataset folders discovered. Every folder was skipped — see reasons below.' END AS message,
       found, runnable AS submitted, skipped FROM a""",
)
def q_bulk_outcome(spark, sf):
    return B.bulk_outcome(B.dedupe_datasets(B.classify_folders(TV.listing_pages(spark, sf), "root")))


# ---------------------------------------------------------------------------
# P: run-event parsing and status replay over event-derived run logs
# ---------------------------------------------------------------------------


@register(
    "run_events_parse",
    lambda: TV.duckdb_with("run_events_expected")
    + "SELECT run_id, seq, kind, step_index, substep_id, failure_code, message, status, exit_code FROM run_events_expected",
)
def q_run_parse(spark, sf):
    return P.parse_events(TV.run_lines(spark, sf)).select(
        "run_id", "seq", "kind", "step_index", "substep_id", "failure_code", "message", "status", "exit_code"
    )


@register(
    "run_status_replay",
    lambda: TV.duckdb_with("run_events_expected")
    + """, e AS (SELECT * FROM run_events_expected WHERE kind NOT IN ('rejected', 'ignored'))
SELECT run_id,
  coalesce(arg_max(status, seq) FILTER (WHERE kind = 'run_finished'),
           CASE WHEN bool_or(kind IN ('progress', 'legacy_step', 'failure', 'legacy_failure')) THEN 'running' END, 'starting') AS status,
  CAST(max(step_index) FILTER (WHERE kind IN ('progress', 'legacy_step')) AS INTEGER) AS step_index,
  arg_max_null(substep_id, struct_pack(a := step_index, b := seq)) FILTER (WHERE kind IN ('progress', 'legacy_step')) AS substep_id,
  arg_max(exit_code, seq) FILTER (WHERE kind = 'run_finished') AS exit_code,
  arg_max(failure_code, seq) FILTER (WHERE kind IN ('failure', 'legacy_failure')) AS failure_code,
  arg_max(message, seq) FILTER (WHERE kind IN ('failure', 'legacy_failure')) AS failure_message,
  CAST(arg_max(step_index, seq) FILTER (WHERE kind IN ('failure', 'legacy_failure') AND step_index IS NOT NULL) AS INTEGER) AS failure_step_index,
  max(seq) AS last_seq
FROM e GROUP BY run_id""",
)
def q_run_replay(spark, sf):
    return P.replay_status(P.parse_events(TV.run_lines(spark, sf))).select(
        "run_id", "status", "step_index", "substep_id", "exit_code", "failure_code", "failure_message", "failure_step_index", "last_seq"
    )


# ---------------------------------------------------------------------------
# Remaining inventory: W5, F4, F8, P7, Q6, B7, S6, T4
# ---------------------------------------------------------------------------

from statgate.sources import readers as SR  # noqa: E402


def _report_points(spark, sf):
    """Lint-report-shaped problem points: every point of each series flagged by W1."""
    obs = TV.obs_orders(spark, sf)
    fl = W.fluctuations(obs)
    pts = obs.select(
        "dataset_id",
        F.col("observationAbout").alias("placeDcid"),
        A.normalize_variable("variableMeasured").alias("statVarDcid"),
        F.col("observationPeriod"),
        F.col("observationDate").alias("date"),
        F.col("value"),
    )
    f = fl.select(
        "dataset_id",
        F.col("observationAbout").alias("placeDcid"),
        F.col("StatVar").alias("statVarDcid"),
        "observationPeriod",
        F.col("counter_key").alias("counterKey"),
        F.col("pct").alias("percentDifference"),
    )
    return f.join(pts, ["dataset_id", "placeDcid", "statVarDcid", "observationPeriod"]).select(
        "dataset_id", F.lit(0).alias("item_ord"), "placeDcid", "statVarDcid", "observationPeriod", F.lit(0).alias("counter_ord"),
        "counterKey", "percentDifference", "date", "value", F.lit(None).cast("string").alias("scalingFactor"), F.lit(None).cast("string").alias("unit"),
    )


def _report_points_sql() -> str:
    return (
        _fluct_sql().replace("\nSELECT " + SERIES + ",\n       CASE WHEN pct > 500.0", ",\nfl AS (SELECT " + SERIES + ",\n       CASE WHEN pct > 500.0", 1)
        + f"""),
rp AS (SELECT fl.dataset_id, fl.observationAbout AS placeDcid, fl.StatVar AS statVarDcid, fl.observationPeriod, fl.counter_key AS counterKey,
              fl.pct AS percentDifference, o.observationDate AS date, o.value
       FROM fl JOIN obs_orders o ON o.dataset_id = fl.dataset_id AND o.observationAbout = fl.observationAbout
            AND {dvar('o.variableMeasured')} = fl.StatVar AND o.observationPeriod = fl.observationPeriod)
"""
    )


@register(
    "report_fluctuations_orders",
    lambda: _report_points_sql()
    + f""", g AS (SELECT dataset_id, statVarDcid AS statVar, placeDcid AS location, observationPeriod, counterKey,
              list(struct_pack(date, value) ORDER BY date, value) AS pts, max(percentDifference) AS percentDifference, count(*) AS n
       FROM rp GROUP BY ALL)
SELECT dataset_id, statVar, location, observationPeriod, counterKey,
       array_to_string(list_transform(pts, lambda p: p.date || '=' || p.value), ';') AS points, percentDifference,
       CASE WHEN n >= 2 AND datediff('day', {dparse('pts[n-1].date')}, {dparse('pts[n].date')}) >= 0
            THEN CAST(round(CAST(datediff('day', {dparse('pts[n-1].date')}, {dparse('pts[n].date')}) AS DECIMAL(20,6)) / CAST(365.25 AS DECIMAL(20,6)), 1) AS DECIMAL(10,1)) END AS period_gap_years,
       CAST(n AS BIGINT) AS series_length,
       CASE WHEN n >= 2 THEN {dpct('CAST(pts[n-1].value AS DOUBLE)', 'CAST(pts[n].value AS DOUBLE)')} END AS percent_change
FROM g""",
)
def q_report_fluct(spark, sf):
    r = W.report_fluctuations(_report_points(spark, sf))
    return r.select(
        "dataset_id", "statVar", "location", "observationPeriod", "counterKey",
        F.array_join(F.transform("points", lambda p: F.concat(p["date"], F.lit("="), p["value"])), ";").alias("points"),
        "percentDifference", "period_gap_years", "series_length", "percent_change",
    )


@register(
    "stale_runs",
    lambda: TV.duckdb_with("run_events_expected")
    + """, e AS (SELECT r.*, ev.ts FROM run_events_expected r JOIN events ev ON ev.event_id = r.seq WHERE kind NOT IN ('rejected', 'ignored')),
s AS (SELECT run_id, coalesce(arg_max(status, seq) FILTER (WHERE kind = 'run_finished'),
                      CASE WHEN bool_or(kind IN ('progress', 'legacy_step', 'failure', 'legacy_failure')) THEN 'running' END, 'starting') AS status,
             max(ts) AS updated_at FROM e GROUP BY run_id)
SELECT run_id, CASE WHEN status = 'starting' THEN 'STARTUP_FAILED' ELSE 'BATCH_JOB_LOST' END AS failure_code FROM s
WHERE status IN ('starting', 'running') AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(updated_at) > 300""",
)
def q_stale(spark, sf):
    ev = P.parse_events(TV.run_lines(spark, sf))
    st = P.replay_status(ev)
    ts = TV.table(spark, sf, "events").select(F.col("event_id").alias("last_seq"), F.col("ts").cast("timestamp").alias("updated_at"))
    # updated_at = time of the run's last accepted line
    return P.stale_runs(st.join(ts, "last_seq"), F.lit("2024-01-31 00:00:00").cast("timestamp"))


def _quality_and_shards_sql() -> str:
    dup = _first_dup_sql("csv_documents", TV.DOCUMENT_COLUMNS)
    return (
        TV.duckdb_with("csv_documents", "csv_lineitem")
        + f""", m AS ({_manifest_sql('csv_documents', 700)} UNION ALL {_manifest_sql('csv_lineitem', 7000).replace('CAST(1000 AS', 'CAST(10 AS')}),
dup AS ({dup}),
q AS (SELECT m.* REPLACE (CAST(10 AS BIGINT) AS threshold_rows), original_csv IN (SELECT file FROM dup) AS failed FROM m)
SELECT dataset_id, original_csv, CASE WHEN failed THEN 'skipped' ELSE status END AS status, CASE WHEN failed THEN [] ELSE shard_paths END AS shard_paths,
       CASE WHEN failed THEN [] ELSE shard_rows END AS shard_rows, total_rows, CASE WHEN failed THEN 0 ELSE shard_count END AS shard_count, rows_per_shard, threshold_rows FROM q"""
    )


@register("quality_and_shards", _quality_and_shards_sql)
def q_quality_shards(spark, sf):
    # documents hold repeated rows, so they are not cut into shards; lineitem passes
    def manifest(csv, columns, size, order):
        header = spark.createDataFrame([(f"{csv[0]}.csv", i + 1, c) for i, c in enumerate(columns)], "file string, ord int, name string")
        made = Q.quality_and_shards(csv[1], header, size, 10, None, columns=columns, order=order)[1]
        return made.withColumn("shard_paths", F.transform("shard_paths", lambda p: F.concat(F.lit("shards"), p)))

    docs = manifest(("documents", TV.csv_documents(spark, sf)), TV.DOCUMENT_COLUMNS, 700, None)
    return docs.unionByName(manifest(("lineitem", TV.csv_lineitem(spark, sf, numbered=False)), TV.LINEITEM_COLUMNS, 7000, "__order"))


@register(
    "observation_nodes",
    lambda: TV.duckdb_with("nodes_parts")
    + "SELECT dataset_id, CAST(count(DISTINCT (file, node_line)) AS BIGINT) AS observation_nodes FROM nodes_parts WHERE prop = 'typeOf' AND contains(value, 'StatVarObservation') GROUP BY ALL",
)
def q_obs_nodes(spark, sf):
    return SR.count_observation_nodes(TV.nodes_parts(spark, sf))


@register(
    "review_value_not_mapped",
    lambda: TV.duckdb_with("nodes_parts")
    + """SELECT dataset_id, 'schema' AS type FROM nodes_parts GROUP BY dataset_id
HAVING bool_or(prop = 'typeOf' AND trim(value) = 'dcs:StatVarObservation') AND NOT bool_or(prop = 'value' AND regexp_matches(value, '^C:[^>]+->'))
UNION ALL SELECT dataset_id || '_novalue', 'schema' FROM nodes_parts WHERE prop <> 'value' GROUP BY dataset_id
HAVING bool_or(prop = 'typeOf' AND trim(value) = 'dcs:StatVarObservation')""",
)
def q_value_not_mapped(spark, sf):
    # the template without its value lines: every observation node lacks the mapping
    n = TV.nodes_parts(spark, sf)
    return T.value_not_mapped(n).select("dataset_id", "type").unionByName(
        T.value_not_mapped(n.where(F.col("prop") != "value")).select(F.concat(F.col("dataset_id"), F.lit("_novalue")).alias("dataset_id"), "type")
    )


def _advisory_sql() -> str:
    ev = _events_results_sql()  # WITH ... res AS (...)
    fl_ctes = _report_points_sql()[len("WITH ") :]
    t12 = TV.DUCKDB_VIEWS["nodes_parts"]
    empty = ", ".join(f"'' AS {c}" for c in ("expected_from_source", "notes"))
    return (
        ev.rstrip()
        + ",\n"
        + fl_ctes
        + f""",
w5 AS (SELECT dataset_id, statVarDcid AS statVar, placeDcid AS location, list(struct_pack(date, value) ORDER BY date, value) AS pts,
              max(percentDifference) AS pct, count(*) AS n FROM rp GROUP BY dataset_id, statVarDcid, placeDcid, observationPeriod, counterKey),
nodes_parts AS ({t12})
{_t1_t2_sql()}
SELECT 'validation_warning' AS type, lower(status) AS severity, validation_name AS rule_id, '' AS file, '' AS line, '' AS statvar, '' AS place_id, '' AS period,
       '' AS previous_value, '' AS current_value, '' AS percent_change, '' AS series_points, message, '(any)' AS details,
       'events.csv' AS source_file, dataset_id AS dataset, 'run-1' AS run_id, {empty}
FROM res WHERE status IN ('FAILED', 'WARNING')
UNION ALL
SELECT 'ai_advisory', lower(severity), '', '', '', '', '', '', '', '', '', '', message,
       'Suggestion: ' || CASE WHEN type = 'schema' THEN 'Use a column ID from the header or fix the typo.'
            WHEN ord = 11 THEN 'Ensure all CSV columns are mapped in the TMCF or remove unused columns.'
            ELSE 'Remove the column from the CSV or add a mapping in the TMCF if it is needed.' END, 'events.csv', dataset_id, 'run-1', '', ''
FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)
UNION ALL
SELECT 'statistical_fluctuation', 'advisory', '', 'events.csv', '', statVar, location,
       CASE WHEN n >= 2 THEN pts[n-1].date || ' → ' || pts[n].date ELSE '' END,
       CASE WHEN n >= 2 THEN pts[n-1].value || '.0' ELSE '' END, CASE WHEN n >= 2 THEN pts[n].value || '.0' ELSE '' END,
       coalesce(printf('%.2f', pct), ''), CAST(n AS VARCHAR), 'Large fluctuation (>100%) between consecutive points', '', 'events.csv', dataset_id, 'run-1', '', ''
FROM w5"""
    )


@register("advisory_export", _advisory_sql)
def q_advisory(spark, sf):
    # Written as the export's CSV and read back
    from statgate.sources import writers as SW

    n, hdr = TV.nodes_parts(spark, sf), _parts_headers(spark, sf)
    issues = T.column_refs_missing(n, hdr).unionByName(T.unused_columns(n, hdr))
    made = events_outcome(spark, sf)
    folder = scratch(spark, "advisories")
    SW.write_advisories(
        S.advisory_export(made.results, issues, W.report_fluctuations(_report_points(spark, sf)), made.violations, "events.csv", "run-1"), folder
    )
    # details of results are the engine's own JSON
    told = F.when(F.col("type") == "validation_warning", F.lit("(any)")).otherwise(F.col("details"))
    return SW.read_advisories(spark, folder).withColumn("details", told)


def _review_summary_sql() -> str:
    body = _samples_sql()
    head = body[: body.rindex("\nvol AS (")]
    head = head.rstrip().rstrip(",")
    res = _events_results_sql()
    res_cte = res[res.index("r AS (") :].rstrip()
    fl = _fluct_sql().replace("\nSELECT " + SERIES + ",\n       CASE WHEN pct > 500.0", ",\nfl AS (SELECT " + SERIES + ",\n       CASE WHEN pct > 500.0", 1)
    issues = f"WITH nodes_parts AS ({TV.DUCKDB_VIEWS['nodes_parts']}) {_t1_t2_sql()} SELECT count(*) FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)"
    return (
        head
        + ",\nds AS (SELECT DISTINCT dataset_id FROM stats),\ngran AS (SELECT dataset_id, 0 AS n, NULL AS fmts FROM ds WHERE false),\n"
        + res_cte.replace("gran AS (", "gran_unused AS (", 1)
        + """,
smp AS (SELECT dataset_id FROM units UNION ALL SELECT dataset_id FROM latest UNION ALL SELECT dataset_id FROM refs UNION ALL SELECT dataset_id FROM lint)
SELECT dataset_id, CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS blockers, CAST(count(*) FILTER (WHERE status = 'WARNING') AS BIGINT) AS warnings,
       CAST(count(*) FILTER (WHERE status = 'PASSED') AS BIGINT) AS passed, (@ISSUES) AS review_issues, (@JUMPS) AS fluctuation_anomalies,
       (SELECT CAST(count(*) AS BIGINT) FROM smp) AS rule_failures
FROM res GROUP BY dataset_id""".replace("@ISSUES", issues).replace("@JUMPS", fl + ") SELECT count(*) FROM fl")
    )


@register("review_summary_events", _review_summary_sql)
def q_review_summary(spark, sf):
    tables = events_tables(spark, sf)
    made = events_outcome(spark, sf, tables=tables)
    samples = S.expand_units(S.failure_samples(made.results, made.violations), tables["stats"])  # F2 fills samples, it adds none
    n, hdr = TV.nodes_parts(spark, sf), _parts_headers(spark, sf)
    run = F.concat(F.substring("dataset_id", 1, 0), F.lit("events"))  # no literal, which would make the join on it one of all pairs
    issues = T.column_refs_missing(n, hdr).unionByName(T.unused_columns(n, hdr)).withColumn("dataset_id", run)
    jumps = W.fluctuations(TV.obs_orders(spark, sf)).withColumn("dataset_id", run)  # of one run, as its review shows them
    return S.review_summary(made.results, issues, jumps, samples)


def _validate_many_sql() -> str:
    year = this_year()
    ev = _events_results_sql()
    d = _diff_sql_body()
    d_ctes = d[len("WITH ") :].rstrip()
    return (
        ev.rstrip()
        + ",\n"
        + d_ctes
        + f""",
so AS ({_stats_sql('obs_orders_current')}),
t AS (SELECT d.dataset_id, sum(DELETED) AS deleted, count(DISTINCT MODIFIED) AS nm, count(DISTINCT ADDED) AS na,
             any_value(previous_obs_size) AS prev FROM differ d JOIN sizes USING (dataset_id) GROUP BY 1),
o AS (
  SELECT dataset_id, 'check_min_value' AS validation_name, CASE WHEN count(*) FILTER (WHERE MinValue < 0) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_num_observations', CASE WHEN count(*) FILTER (WHERE NumObservations < 1) > 0 THEN 'FAILED' ELSE 'PASSED' END FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_unit_consistency', CASE WHEN count(DISTINCT Units) > 1 THEN 'FAILED' ELSE 'PASSED' END FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_scaling_factor_consistency', CASE WHEN count(DISTINCT ScalingFactors) > 1 THEN 'FAILED' ELSE 'PASSED' END FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_max_date_latest', CASE WHEN substr(max(MaxDate), 1, 4) = '{year}' THEN 'PASSED' ELSE 'FAILED' END FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_max_date_consistent', CASE WHEN count(DISTINCT MaxDate) > 1 THEN 'FAILED' ELSE 'PASSED' END FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_num_places_consistent', CASE WHEN count(DISTINCT NumPlaces) > 1 THEN 'FAILED' ELSE 'PASSED' END FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_num_places_count', CASE WHEN count(*) FILTER (WHERE NumPlaces < 1) > 0 THEN 'FAILED' ELSE 'PASSED' END FROM so GROUP BY 1
  UNION ALL SELECT dataset_id, 'check_max_value_percent', CASE WHEN count(*) FILTER (WHERE MaxValue > 100 AND contains(StatVar, 'Percent')) > 0 THEN 'FAILED' ELSE 'PASSED' END FROM so GROUP BY 1
  UNION ALL SELECT DISTINCT dataset_id, 'check_missing_refs_count', 'PASSED' FROM so
  UNION ALL SELECT DISTINCT dataset_id, 'check_structural_lint_error_count', 'PASSED' FROM so
  UNION ALL SELECT DISTINCT dataset_id, 'check_observation_date_granularity', 'PASSED' FROM so
  UNION ALL SELECT dataset_id, 'check_deleted_records_count', CASE WHEN deleted > 0 THEN 'FAILED' ELSE 'PASSED' END FROM t
  UNION ALL SELECT dataset_id, 'check_deleted_records_percent', CASE WHEN deleted * 100.0 / prev > 5.0 THEN 'FAILED' ELSE 'PASSED' END FROM t
  UNION ALL SELECT dataset_id, 'check_modified_records_count', CASE WHEN nm > 1 THEN 'FAILED' ELSE 'PASSED' END FROM t
  UNION ALL SELECT dataset_id, 'check_added_records_count', CASE WHEN na > 1 THEN 'FAILED' ELSE 'PASSED' END FROM t)
SELECT dataset_id, validation_name, status FROM res UNION ALL SELECT * FROM o"""
    )


@register("validate_many", _validate_many_sql)
def q_validate_many(spark, sf):
    from statgate.plans.validate import validate_many

    obs = TV.obs_events(spark, sf).unionByName(TV.obs_orders(spark, sf, "current"))
    res = validate_many(
        spark, obs, _year_rules(DEFAULT_RULES), lint=TV.lint_counters(spark, sf), baselines=TV.obs_orders(spark, sf, "baseline")
    )
    return res.select("dataset_id", "validation_name", "status")


@register(
    "infer_step_events",
    lambda: """SELECT 'run-' || user_id AS run_id, event_id AS seq,
       CAST(CASE ['0', '1', '2', '2.4', '3', '4'][event_id % 6 + 1] WHEN '2.4' THEN 3 WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2
            WHEN '3' THEN 4 WHEN '4' THEN 5 END AS INTEGER) AS inferred_step_index
FROM events""",
)
def q_infer_step(spark, sf):
    # free-text log lines ('Step <token>: <event>') derived from every event
    e = TV.table(spark, sf, "events")
    tok = F.element_at(F.array(*[F.lit(x[3]) for x in P.STEPS]), (F.col("event_id") % 6 + 1).cast("int"))
    lines = e.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("Step "), tok, F.lit(": "), F.col("event_type")).alias("line"),
    )
    return P.infer_step(lines).select("run_id", "seq", F.col("inferred_step_index").cast("int").alias("inferred_step_index"))


@register(
    "bulk_dedupe",
    lambda: TV.duckdb_with("listing") + _CLASSIFY_SQL
    + """SELECT folder, dataset_id, CASE WHEN reason IS NOT NULL THEN reason WHEN rk > 1 THEN 'duplicate dataset id ''' || dataset_id || '''' END AS reason,
       CASE WHEN reason IS NULL AND rk = 1 THEN 'submit' ELSE 'skipped' END AS action
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, reason IS NULL ORDER BY folder) AS rk FROM cls)""",
)
def q_bulk_dedupe(spark, sf):
    return B.dedupe_datasets(B.classify_folders(TV.listing_pages(spark, sf), "root")).select("folder", "dataset_id", "reason", "action")


# S3: a fixed two-node template (configuration) applied to the whole lineitem CSV view
LINEITEM_TEMPLATE = [
    ("lineitem_output.tmcf", 1, "typeOf", "dcs:StatVarObservation"),
    ("lineitem_output.tmcf", 1, "variableMeasured", "dcid:Quantity_LineItem"),
    ("lineitem_output.tmcf", 1, "observationAbout", "C:lineitem->l_suppkey"),
    ("lineitem_output.tmcf", 1, "observationDate", "C:lineitem->l_shipdate"),
    ("lineitem_output.tmcf", 1, "value", "C:lineitem->l_quantity"),
    ("lineitem_output.tmcf", 8, "typeOf", "dcs:StatVarObservation"),
    ("lineitem_output.tmcf", 8, "variableMeasured", "dcid:Amount_LineItem_Price"),
    ("lineitem_output.tmcf", 8, "observationAbout", "C:lineitem->l_partkey"),
    ("lineitem_output.tmcf", 8, "observationDate", "C:lineitem->l_shipdate"),
    ("lineitem_output.tmcf", 8, "value", "C:lineitem->l_extendedprice"),
    ("lineitem_output.tmcf", 8, "unit", "dcs:USDollar"),
]


@register(
    "observations_lineitem",
    lambda: TV.duckdb_with("csv_lineitem")
    + """SELECT 'lineitem' AS dataset_id, l_suppkey AS observationAbout, l_shipdate AS observationDate, 'dcid:Quantity_LineItem' AS variableMeasured,
       l_quantity AS value, '' AS unit, '' AS measurementMethod, '' AS observationPeriod, '' AS scalingFactor, __file, __row FROM csv_lineitem
UNION ALL
SELECT 'lineitem', l_partkey, l_shipdate, 'dcid:Amount_LineItem_Price', l_extendedprice, 'dcs:USDollar', '', '', '', __file, __row FROM csv_lineitem""",
)
def q_observations(spark, sf):
    template = spark.createDataFrame(LINEITEM_TEMPLATE, "file string, node_line bigint, prop string, value string")
    return SR.observations(TV.csv_lineitem(spark, sf), template, dataset_id="lineitem")


# ---------------------------------------------------------------------------
# sinks and states written and read back
# ---------------------------------------------------------------------------


@register("results_round_trip_events", lambda: _events_results_sql() + "SELECT dataset_id, validation_name, status, message FROM res")
def q_results_round_trip(spark, sf):
    from statgate.sources.writers import write_results

    folder = scratch(spark, "results")
    write_results(events_results(spark, sf), folder)
    return spark.read.json(folder).select("dataset_id", "validation_name", "status", "message")


@register(
    "accepted_baseline_orders",
    lambda: _diff_sql_body() + "SELECT 'v2' AS newest, differ.* FROM differ",
)
def q_accepted_baseline(spark, sf):
    # A blocked run, two accepted ones and a repeated one; the diff is against the newest
    root = scratch(spark, "baselines")
    baseline, current = TV.obs_orders(spark, sf, "baseline"), cut(TV.obs_orders(spark, sf, "current"))
    D.accept_baseline(current, root, "orders", "run-0", blocked=True)
    D.accept_baseline(current, root, "orders", "run-1", blocked=False)
    D.accept_baseline(baseline, root, "orders", "run-2", blocked=False)
    D.accept_baseline(current, root, "orders", "run-2", blocked=False)  # already the newest
    differ, _ = D.diff_or_first_run(current, root, "orders")
    versions = D.baseline_versions(spark, root, "orders").limit(1).select("dataset_id", F.col("version").alias("newest"))
    return differ.join(versions, "dataset_id")


@register("incremental_diff_orders", lambda: _diff_sql_body() + f"SELECT {_DKEY}, status FROM diff")
def q_incremental_diff(spark, sf):
    # D1 against an accepted version: only the buckets whose digest differs are read
    root = scratch(spark, "baselines")
    D.accept_baseline(TV.obs_orders(spark, sf, "baseline"), root, "orders", "run-1", blocked=False)
    diff = D.incremental_diff(TV.obs_orders(spark, sf, "current"), root, "orders")
    return diff.drop("n_old", "n_new")


@register(
    "first_run_orders",
    lambda: TV.duckdb_with("obs_orders")
    + """SELECT DISTINCT dataset_id, CAST(NULL AS BIGINT) AS previous_obs_size, CAST(NULL AS BIGINT) AS current_obs_size, CAST(NULL AS BIGINT) AS obs_diff_size,
       true AS first_run FROM obs_orders""",
)
def q_first_run(spark, sf):
    # Nothing was accepted yet
    return D.diff_or_first_run(TV.obs_orders(spark, sf), scratch(spark, "no-baselines"), "orders")[1]


def _status_stream(spark, sf) -> DataFrame:
    """The updates of all runs, streamed from envelope files in several batches and kept by a sink."""
    folder = scratch(spark, "run-events")
    lines = TV.run_lines(spark, sf).select("run_id", "seq", "line", F.pmod("seq", F.lit(3)).alias("portion"))
    # as many tasks as the lines need, each with a file of every portion
    lines.repartition("seq").write.partitionBy("portion").json(f"{folder}/in")
    schema = f"{P.ENVELOPE_SCHEMA}, portion bigint"
    files = len(spark.read.schema(schema).json(f"{folder}/in").inputFiles())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).json(f"{folder}/in")
    events = P.parse_events(stream.drop("portion"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    with P.state_store(spark):
        updates = P.project_status_stream(events, timers=False)
        updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@register("run_status_stream", lambda: ORACLES["run_status_replay"]())
def q_status_stream(spark, sf):
    # Late lines too, as the files of a run come in any order; P4's advances never fall
    updates = _status_stream(spark, sf)
    return P.normalize_status(P.latest_status(updates)).select(
        "run_id", "status", "step_index", "substep_id", "exit_code", "failure_code", "failure_message", "failure_step_index", "last_seq"
    )


@register(
    "run_step_advances",
    lambda: "SELECT run_id, max(step_index) AS step_index FROM (" + ORACLES["run_status_replay"]() + ") GROUP BY run_id HAVING max(step_index) IS NOT NULL",
)
def q_step_advances(spark, sf):
    # The last advance of a run is its step
    return P.step_advances(_status_stream(spark, sf)).groupBy("run_id").agg(F.max("step_index").alias("step_index"))


#: rules whose bounds some variables break, one of them scoped by name
BOUND_RULES = [
    {"rule_id": "low", "validator": "MIN_VALUE_CHECK", "params": {"minimum": 0.5}},
    {"rule_id": "high", "validator": "MAX_VALUE_CHECK", "params": {"maximum": 100}, "scope": {"variables": {"contains_all": ["Event", "i"]}}},
    {"rule_id": "few", "validator": "NUM_OBSERVATIONS_CHECK", "params": {"minimum": 2000}},
    {"rule_id": "few_places", "validator": "NUM_PLACES_COUNT", "params": {"minimum": 1000000}},
    {"rule_id": "never", "validator": "MAX_VALUE_CHECK", "params": {"maximum": 0}, "scope": {"variables": {"contains_all": ["Nowhere"]}}},
]


def _bounds_sql() -> str:
    found = [("low", "actual_min_value", "MinValue", "MinValue < 0.5"), ("high", "actual_max_value", "MaxValue", "MaxValue > 100 AND contains(StatVar, 'Event') AND contains(StatVar, 'i')"),
             ("few", "actual_num_observations", "NumObservations", "NumObservations < 2000"), ("few_places", "actual_num_places", "NumPlaces", "NumPlaces < 1000000")]
    return (
        TV.duckdb_with("obs_events")
        + f", stats AS ({_stats_sql('obs_events')}),\nv AS ("
        + " UNION ALL ".join(f"SELECT dataset_id, '{r}' AS rule_id, StatVar AS stat_var, '{n}' AS cell, CAST({c} AS DOUBLE) AS value FROM stats WHERE {w}" for r, n, c, w in found)
        + """)
"""
    )


@register(
    "rule_violations_events",
    lambda: _bounds_sql() + "SELECT *, row_number() OVER (PARTITION BY dataset_id, rule_id ORDER BY stat_var) - 1 AS ordinal FROM v",
)
def q_violations(spark, sf):
    found = R.evaluate(events_tables(spark, sf), BOUND_RULES).violations
    other = F.map_filter("row", lambda k, v: k != "stat_var")
    return found.select(
        "dataset_id", "rule_id", F.col("row")["stat_var"].alias("stat_var"), F.map_keys(other)[0].alias("cell"),
        F.map_values(other)[0].cast("double").alias("value"), "ordinal",
    )


@register(
    "rule_bounds_events",
    lambda: _bounds_sql()
    + """, c AS (SELECT d.dataset_id, r.rule_id, words, (SELECT count(*) FROM v WHERE v.rule_id = r.rule_id) AS n FROM (SELECT DISTINCT dataset_id FROM stats) d,
     (VALUES ('low', 'with MinValue below 0.5'), ('high', 'with MaxValue above 100'), ('few', 'with fewer than 2000 observations'),
             ('few_places', 'with fewer than 1000000 places'), ('never', 'with MaxValue above 0')) r(rule_id, words))
SELECT dataset_id, rule_id AS validation_name, CASE WHEN n > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
       CASE WHEN n = 0 THEN 'No StatVar ' || words || '.' ELSE 'Found ' || n || CASE WHEN n = 1 THEN ' StatVar ' ELSE ' StatVars ' END || words || '.' END AS message,
       '{"violations":' || n || ',"violations_of":"' || rule_id || '"}' AS details FROM c""",
)
def q_rule_bounds(spark, sf):
    return R.run_rules(events_tables(spark, sf), BOUND_RULES).select("dataset_id", "validation_name", "status", "message", "details")


def _span_rule():
    """V1's kin as a user would write it: fails a dataset whose values span more than a limit."""

    class Span:
        @staticmethod
        def analyze(table, params):
            from pyspark.sql.types import StringType, StructField, StructType
            from pyspark.sql.udtf import AnalyzeResult

            return AnalyzeResult(StructType([StructField(c, StringType()) for c in ("dataset_id", "status", "message", "details")]))

        def __init__(self):
            self.of, self.low, self.high, self.limit = None, None, None, 0.0

        def eval(self, row, params):
            import json

            self.of, self.limit = row["dataset_id"], json.loads(params)["limit"]
            self.low = row["MinValue"] if self.low is None else min(self.low, row["MinValue"])
            self.high = row["MaxValue"] if self.high is None else max(self.high, row["MaxValue"])

        def terminate(self):
            yield self.of, "FAILED" if self.high - self.low > self.limit else "PASSED", f"{self.low} to {self.high}", None

    return udtf(Span)


@register(
    "user_rule_events",
    lambda: TV.duckdb_with("obs_events")
    + f""", stats AS ({_stats_sql('obs_events')})
SELECT dataset_id, 'span' AS validation_name, CASE WHEN max(MaxValue) - min(MinValue) > 10 THEN 'FAILED' ELSE 'PASSED' END AS status,
       min(MinValue) || ' to ' || max(MaxValue) AS message FROM stats GROUP BY 1
UNION ALL SELECT DISTINCT dataset_id, 'other', 'WARNING', 'Unknown custom validator: statgate_no_such_rule' FROM stats""",
)
def q_user_rule(spark, sf):
    # a validator registered in the session as a table function, called by its name, and one that nobody registered
    spark.udtf.register("statgate_span_rule", _span_rule())
    rules = [{"rule_id": "span", "validator": "statgate_span_rule", "params": {"limit": 10}}, {"rule_id": "other", "validator": "statgate_no_such_rule", "params": {}}]
    return R.run_rules(events_tables(spark, sf), rules).select("dataset_id", "validation_name", "status", "message")
