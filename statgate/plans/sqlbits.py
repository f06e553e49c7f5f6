"""DuckDB expression snippets mirroring the Spark scalar helpers (for oracle SQL)."""


def dvar(x: str) -> str:
    """X4 in DuckDB."""
    return f"trim(regexp_replace(trim({x}), '^(dcid:|dcs:)', '', 'i'))"


def dlist(x: str) -> str:
    """Render the sorted distinct non-blank values of x as '[a, b]'."""
    return (
        f"'[' || array_to_string(coalesce(list_sort(list_distinct(list(trim({x})) FILTER (WHERE {x} IS NOT NULL AND trim({x}) <> ''))), "
        f"[]::VARCHAR[]), ', ') || ']'"
    )


def dparse(x: str) -> str:
    """X7 in DuckDB: first 10, then 7, then 4 characters as a date."""
    return (
        f"coalesce(CASE WHEN length({x}) >= 10 THEN CAST(try_strptime(substr({x}, 1, 10), '%Y-%m-%d') AS DATE) END, "
        f"CASE WHEN length({x}) >= 7 THEN CAST(try_strptime(substr({x}, 1, 7), '%Y-%m') AS DATE) END, "
        f"CASE WHEN length({x}) >= 4 THEN CAST(try_strptime(substr({x}, 1, 4), '%Y') AS DATE) END)"
    )


def dpct(prev: str, curr: str) -> str:
    """X9 in DuckDB."""
    return f"CASE WHEN abs({prev}) >= 1e-9 THEN ({curr} - {prev}) / abs({prev}) * 100.0 END"


def dperiod_days(x: str) -> str:
    """X8 in DuckDB."""
    pat = "'^P(([0-9]+)Y)?(([0-9]+)M)?(([0-9]+)D)?'"
    u = f"upper(trim({x}))"

    def part(i, k):
        g = f"regexp_extract({u}, {pat}, {i})"
        return f"(CASE WHEN {g} <> '' THEN CAST({g} AS BIGINT) * {k} ELSE 0 END)"

    days = f"({part(2, 365)} + {part(4, 30)} + {part(6, 1)})"
    return f"(CASE WHEN starts_with({u}, 'P') AND {days} > 0 THEN {days} END)"


def dpoints(view: str) -> str:
    """series_points in DuckDB: one point per (series, date), value of the lowest record."""
    return f"""
SELECT dataset_id, trim(observationAbout) AS observationAbout, {dvar('variableMeasured')} AS StatVar,
       coalesce(trim(observationPeriod), '') AS observationPeriod, coalesce(trim(measurementMethod), '') AS measurementMethod,
       trim(observationDate) AS date,
       arg_min(TRY_CAST(value AS DOUBLE), coalesce(__row, 0)) AS value,
       arg_min(CASE WHEN trim(unit) <> '' THEN trim(unit) END, coalesce(__row, 0)) AS unit,
       arg_min(CASE WHEN trim(scalingFactor) <> '' THEN trim(scalingFactor) END, coalesce(__row, 0)) AS scalingFactor
FROM {view} WHERE observationDate IS NOT NULL AND trim(observationDate) <> ''
GROUP BY ALL"""


SERIES = "dataset_id, observationAbout, StatVar, observationPeriod, measurementMethod"


def dpairs(points: str) -> str:
    return f"""
SELECT *, {dparse('date')} AS d,
       lag(date) OVER w AS prev_date, lag({dparse('date')}) OVER w AS prev_d, lag(value) OVER w AS prev_value,
       lag(unit) OVER w AS prev_unit, lag(scalingFactor) OVER w AS prev_scalingFactor
FROM {points}
WINDOW w AS (PARTITION BY {SERIES} ORDER BY {dparse('date')} NULLS FIRST, date)"""
