"""Every violating row of every rule, as one long table.

``violations`` has one row per violating row: (dataset_id, rule_id, ordinal,
row), ``row`` a map of its cells as text. Results hold the count and name the
rule; whoever wants the rows (F1, F2) reads the table, so no cell grows with
the number of rows that fail.

An SQL rule is one plan for all datasets: its query stands in a lateral
subquery over the list of datasets, in which ``stats``, ``differ`` and
``lint`` mean the rows of the dataset at hand, and Catalyst turns the
correlation into a join on the dataset.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statgate.functions.scalars import strip_blanks
from statgate.session import cut

SQL_TABLES = ("stats", "differ", "lint")
VIOLATIONS_SCHEMA = "dataset_id string, rule_id string, ordinal bigint, row map<string,string>"


def number_text(x) -> str:
    """Number as the config wrote it (int stays int)."""
    if isinstance(x, float) and x.is_integer():
        return str(int(x)) if abs(x) < 1e15 else str(x)
    return str(x)


def scope_condition(scope: dict | None, column: str = "StatVar") -> Column:
    """The variables whose name contains every ``variables.contains_all`` token."""
    cond = F.lit(True)
    for token in ((scope or {}).get("variables") or {}).get("contains_all") or []:
        cond = cond & F.col(column).contains(str(token))
    return cond


#: validator -> (parameter, its default, column of stats, its name in a violating row, comparison, words of the message)
BOUNDS: dict[str, tuple[str, object, str, str, Callable[[Column, Column], Column], str]] = {
    "MIN_VALUE_CHECK": ("minimum", 0, "MinValue", "actual_min_value", lambda c, b: c < b, "with MinValue below {}"),
    "MAX_VALUE_CHECK": ("maximum", None, "MaxValue", "actual_max_value", lambda c, b: c > b, "with MaxValue above {}"),
    "NUM_OBSERVATIONS_CHECK": ("minimum", 1, "NumObservations", "actual_num_observations", lambda c, b: c < b, "with fewer than {} observations"),
    "NUM_PLACES_COUNT": ("minimum", 1, "NumPlaces", "actual_num_places", lambda c, b: c < b, "with fewer than {} places"),
}


def bound_of(rule: dict):
    name, default, *_ = BOUNDS[rule["validator"]]
    return (rule.get("params") or {}).get(name, default)


def bound_words(rule: dict) -> str:
    return BOUNDS[rule["validator"]][5].format(number_text(bound_of(rule)))


def _cells(*columns: Column) -> Column:
    """A row's cells as text, nulls kept, numbers as JSON writes them."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def bound_violations(stats: DataFrame, rules: list[dict]) -> DataFrame:
    """(dataset_id, rule_id, cells) of the variables that violate a bound; one pass for all rules."""
    found = []
    for rule in rules:
        _, _, column, shown, violates, _ = BOUNDS[rule["validator"]]
        hit = scope_condition(rule.get("scope")) & violates(F.col(column), F.lit(float(bound_of(rule))))
        cells = _cells(F.col("StatVar").alias("stat_var"), F.col(column).alias(shown))
        found.append(F.when(hit, F.struct(F.lit(rule.get("rule_id", "")).alias("rule_id"), cells.alias("cells"))))
    each = stats.select("dataset_id", F.explode(F.array_compact(F.array(*found))).alias("v"))
    return each.select("dataset_id", "v.rule_id", "v.cells")


def golden_violations(goldens: DataFrame, obs: DataFrame, rule: dict) -> DataFrame:
    """Golden records absent from the output, compared on the golden file's own columns."""
    cols = [c for c in goldens.columns if c != "dataset_id"]
    left = goldens.select("dataset_id", *[strip_blanks(F.col(c).cast("string")).alias(c) for c in cols])
    right = obs.select("dataset_id", *[strip_blanks(F.col(c).cast("string")).alias(c) for c in cols])
    missing = left.join(right, ["dataset_id", *cols], "left_anti")
    return missing.select("dataset_id", F.lit(rule.get("rule_id", "")).alias("rule_id"), _cells(*[F.col(c) for c in cols]).alias("cells"))


# ---------------------------------------------------------------------------
# V5: SQL rules
# ---------------------------------------------------------------------------


def violations_sql(query: str, condition: str) -> str:
    """Rows of ``query`` where ``NOT (condition)``."""
    return f"SELECT * FROM ({query}) AS _data WHERE NOT ({condition})"


def bound_sql(spark: SparkSession, make: Callable[[dict[str, str]], str], tables: dict[str, DataFrame]) -> DataFrame:
    """The statement that ``make`` writes for the tables' names, analysed, with NULL for a division by zero or a failed cast.

    The tables are bound under names of their own and dropped at once, so the
    caller's views are neither read, replaced nor left behind.
    """
    names = {name: f"__{name}_{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(names[name])
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        out = spark.sql(make(names))
        out.schema  # analysis happens here
        return out
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        for own in names.values():
            spark.catalog.dropTempView(own)


def run_sql(query: str, tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """``query`` over ``tables`` as they are (R7's preview, and one dataset of a rule that cannot be correlated)."""

    def make(names: dict[str, str]) -> str:
        ctes = ", ".join(f"{name} AS (SELECT * FROM {own})" for name, own in names.items())
        return f"WITH {ctes} {query}" if ctes else query

    return bound_sql(spark, make, tables)


class Correlated(Exception):
    """Spark cannot take the query's correlation with the dataset apart."""


def _lateral(query: str, tables: dict[str, DataFrame], datasets: DataFrame) -> DataFrame:
    spark = datasets.sparkSession

    def make(names: dict[str, str]) -> str:
        own = {n: f"SELECT * EXCEPT (dataset_id) FROM {v} WHERE {v}.dataset_id = __d.__dataset" for n, v in names.items() if n in tables}
        ctes = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in own.items()) if own else ""
        return f"SELECT __d.__dataset, __v.* FROM {names['__datasets']} AS __d, LATERAL ({ctes} {query}) AS __v"

    out = bound_sql(spark, make, {**tables, "__datasets": datasets.select(F.col("dataset_id").alias("__dataset"))})
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    except Exception as e:
        raise Correlated(str(e)) from e
    if "outer(" in plan:  # a subquery of the query kept its reference to the dataset
        raise Correlated(query)
    return out


def _one_by_one(query: str, tables: dict[str, DataFrame], datasets: DataFrame) -> DataFrame:
    """The query for each dataset by itself, for the rare rule whose correlation Spark cannot take apart."""
    spark = datasets.sparkSession
    parts = []
    for r in datasets.orderBy("dataset_id").collect():
        own = {n: df.where(F.col("dataset_id").eqNullSafe(r["dataset_id"])).drop("dataset_id") for n, df in tables.items()}
        parts.append(run_sql(query, own, spark).select(F.lit(r["dataset_id"]).alias("__dataset"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sql_violations(rule: dict, tables: dict[str, DataFrame], datasets: DataFrame) -> DataFrame:
    """V5: rows of the rule's query that do not meet its condition, of all datasets. Bad SQL raises Spark's error.

    Division by zero is NULL, which violates nothing. A rule whose query Spark
    cannot decorrelate (a subquery of its own over the same table) runs once
    per dataset; the others do not notice.
    """
    params = rule.get("params") or {}
    query = violations_sql(params.get("query", ""), params.get("condition", ""))
    seen = {n: tables[n] for n in SQL_TABLES if tables.get(n) is not None}
    ids = datasets.select("dataset_id").distinct()
    # analysed by itself first: errors name the rule's own columns, not those of the correlation
    run_sql(query, {n: df.drop("dataset_id") for n, df in seen.items()}, datasets.sparkSession)
    try:
        bad = _lateral(query, seen, ids)
    except (Correlated, AnalysisException):  # its own errors showed above, so this one is of the correlation
        bad = _one_by_one(query, seen, ids)
    cells = [F.col(f"`{c}`") for c in bad.columns if c != "__dataset"]
    return bad.select(F.col("__dataset").alias("dataset_id"), F.lit(rule.get("rule_id", "")).alias("rule_id"), _cells(*cells).alias("cells"))


SQL_ERRORS = (AnalysisException, ParseException)


# ---------------------------------------------------------------------------
# the table
# ---------------------------------------------------------------------------


def store(parts: list[DataFrame], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(violations, counts) of the parts' rows, which are computed once.

    Rows get their ordinal within dataset and rule, by their cells: they are
    sorted by range, so a rule that a third of all rows violate is spread over
    many tasks, and numbered by the counts of each range.
    """
    if not parts:
        return spark.createDataFrame([], VIOLATIONS_SCHEMA), spark.createDataFrame([], "dataset_id string, rule_id string, n bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = ["dataset_id", "rule_id", "cells"]
    ranged = cut(out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("dataset_id", "rule_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("dataset_id", "rule_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    counts = starts.groupBy("dataset_id", "rule_id").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    starts = starts.select(F.col("dataset_id").alias("of"), F.col("rule_id").alias("by"), F.col("part").alias("in_part"), "first", earlier)
    same = F.col("dataset_id").eqNullSafe(F.col("of")) & (F.col("rule_id") == F.col("by")) & (F.col("part") == F.col("in_part"))
    table = ranged.join(starts, same).select(
        "dataset_id", "rule_id", (F.col("at") - F.col("first") + F.col("before")).alias("ordinal"), F.from_json("cells", "map<string,string>").alias("row")
    )
    return table, counts


def write_violations(violations: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The table as Parquet, one directory per rule."""
    violations.write.mode(mode).partitionBy("rule_id").parquet(path)
