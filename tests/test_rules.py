"""R1 and its violations: plan size, hot rules, lateral SQL rules, table functions, previews."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructField, StructType

from statgate.operators import rules as R
from statgate.operators import samples as SM
from statgate.operators import violations as V

STATS = "dataset_id string, StatVar string, NumPlaces bigint, NumObservations bigint, MinValue double, MaxValue double, MaxDate string, Units string"


def stats(spark, n_datasets=2):
    rows = [(f"d{i}", v, 2, 3 + i % 2, float(m), 5.0, "2024", u) for i in range(n_datasets) for v, m, u in (("A", 1, "kg"), ("B", -2, None))]
    return spark.createDataFrame(rows, STATS)


def sql_rule(query, condition, rule="r"):
    return {"rule_id": rule, "validator": "SQL_VALIDATOR", "scope": {"data_source": "stats"}, "params": {"query": query, "condition": condition}}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


QUERIES = [
    ("SELECT StatVar, MinValue FROM stats", "MinValue >= 0"),
    ("SELECT count(DISTINCT Units) AS n FROM stats WHERE Units IS NOT NULL", "n > 1"),
    ("SELECT count(*) AS n FROM stats WHERE MinValue < -100", "n > 0"),
    ("SELECT StatVar, row_number() OVER (ORDER BY MinValue) AS r FROM stats", "r > 1"),
    ("SELECT StatVar FROM stats ORDER BY MinValue LIMIT 1", "StatVar = 'A'"),
    ("SELECT Units, count(*) AS n FROM stats GROUP BY Units", "n > 1"),
    ("SELECT a.StatVar FROM stats a JOIN stats b ON a.StatVar > b.StatVar", "StatVar = 'none'"),
    ("WITH t AS (SELECT StatVar, MinValue / 0 AS z FROM stats) SELECT * FROM t", "z > 1"),
    ("SELECT StatVar FROM stats WHERE MinValue < (SELECT avg(MinValue) FROM stats)", "StatVar = 'none'"),
]


@pytest.mark.parametrize("query, condition", QUERIES, ids=range(len(QUERIES)))
def test_a_rule_over_all_datasets_equals_the_rule_over_each(spark, query, condition):
    table = stats(spark, 4).where("dataset_id <> 'd3' OR StatVar = 'B'")
    ids = table.select("dataset_id").unionByName(spark.createDataFrame([("empty",)], "dataset_id string")).distinct()
    found = V.sql_violations(sql_rule(query, condition), {"stats": table}, ids)
    each = V._one_by_one(V.violations_sql(query, condition), {"stats": table}, ids)
    want = each.select("__dataset", F.to_json(F.struct(*[c for c in each.columns if c != "__dataset"]), {"ignoreNullFields": "false"}))
    assert sorted((r.dataset_id, r.cells) for r in found.collect()) == sorted(tuple(r) for r in want.collect())


def test_the_plan_does_not_grow_with_the_datasets(spark):
    rules = [sql_rule(*QUERIES[0], "low"), sql_rule(*QUERIES[1], "units"), {"rule_id": "min", "validator": "MIN_VALUE_CHECK", "params": {"minimum": 0}}]
    sizes = {}
    for n in (1, 1000):
        table = stats(spark, n).checkpoint()
        sizes[n] = [len(plan_of(V.sql_violations(r, {"stats": table}, table.select("dataset_id").distinct())).splitlines()) for r in rules[:2]]
        made = R.evaluate({"stats": table}, rules)
        assert made.results.count() == 3 * n and made.violations.count() == 3 * n  # one low row each for two rules, one unit each
    assert sizes[1] == sizes[1000]


def test_a_third_of_all_rows_failing_makes_no_large_cell(spark):
    n = 30_000
    table = spark.range(n).select(
        F.lit("d").alias("dataset_id"), F.format_string("V%06d", "id").alias("StatVar"), F.lit(1).cast("long").alias("NumPlaces"),
        F.lit(1).cast("long").alias("NumObservations"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("MinValue"),
        F.lit(1.0).alias("MaxValue"), F.lit("2024").alias("MaxDate"), F.lit("x").alias("Units"),
    )
    rules = [{"rule_id": "check_min_value", "validator": "MIN_VALUE_CHECK", "params": {"minimum": 0}}, sql_rule(*QUERIES[0], "low")]
    made = R.evaluate({"stats": table}, rules)
    rows = made.results.collect()
    assert {r.message for r in rows} == {f"Found {n // 3} StatVars with MinValue below 0.", f"Rule failed for {n // 3} StatVars."}
    assert max(len(r.details) for r in rows) < 200
    for rule in ("check_min_value", "low"):
        kept = made.violations.where(F.col("rule_id") == rule)
        assert [r.ordinal for r in kept.orderBy("ordinal").collect()] == list(range(n // 3))
    assert made.violations.agg(F.max(F.length(F.to_json("row")))).first()[0] < 100
    samples = SM.failure_samples(made.results, made.violations)
    assert samples.count() == 2 * (n // 3) == samples.select("sample_id").distinct().count()


def test_samples_by_kind_of_rule(spark):
    table = stats(spark, 1)
    goldens = spark.createDataFrame([("d0", "A", "geo/1"), ("d0", "B", "")], "dataset_id string, variableMeasured string, observationAbout string")
    obs = spark.createDataFrame([("d0", "Z", "geo/9")], "dataset_id string, variableMeasured string, observationAbout string")
    rules = [
        {"rule_id": "check_min_value", "validator": "MIN_VALUE_CHECK", "params": {"minimum": 0}},
        {"rule_id": "own_min", "validator": "MIN_VALUE_CHECK", "params": {"minimum": 100}},
        {"rule_id": "check_max", "validator": "MAX_VALUE_CHECK", "params": {"maximum": 1}},
        {"rule_id": "gold", "validator": "GOLDENS_CHECK", "params": {}},
        {"rule_id": "check_unit_consistency", "validator": "UNIT_CONSISTENCY_CHECK", "params": {}},
        sql_rule("SELECT StatVar, Units FROM stats", "Units = 'kg' AND Units IS NOT NULL", "sql"),
        {"rule_id": "scoped", "validator": "MIN_VALUE_CHECK", "params": {"minimum": 100}, "scope": {"variables": {"contains_all": ["Z"]}}},
    ]
    made = R.evaluate({"stats": table, "goldens": goldens, "obs": obs}, rules)
    status = {r.validation_name: r.status for r in made.results.collect()}
    assert status == {"check_min_value": "FAILED", "own_min": "FAILED", "check_max": "FAILED", "gold": "FAILED", "check_unit_consistency": "PASSED",
                      "sql": "FAILED", "scoped": "PASSED"}
    got = sorted((r.sample_id, r.statVar, r.value) for r in SM.failure_samples(made.results, made.violations).collect())
    assert got == [
        ("check_max#0", None, None), ("check_min_value#0", "B", "-2.0"), ("gold#0", "A", "observationAbout: geo/1"), ("gold#1", "B", "—"),
        ("own_min#0", None, None), ("sql#0", "B", "Units: —"),
    ]


def test_goldens_of_a_dataset_come_in_one_order(spark):
    goldens = spark.createDataFrame([("d0", f"V{i}") for i in range(50)], "dataset_id string, variableMeasured string")
    obs = spark.createDataFrame([], "dataset_id string, variableMeasured string")
    rule = {"rule_id": "gold", "validator": "GOLDENS_CHECK", "params": {}}
    runs = [R.evaluate({"stats": stats(spark, 1), "goldens": g, "obs": obs}, [rule]).violations for g in (goldens, goldens.orderBy(F.desc("variableMeasured")))]
    assert sorted(map(str, runs[0].collect())) == sorted(map(str, runs[1].collect()))


def test_violations_are_written_by_rule(spark, tmp_path):
    rules = [{"rule_id": r, "validator": "MIN_VALUE_CHECK", "params": {"minimum": m}} for r, m in (("a", 0), ("b", 100))]
    made = R.evaluate({"stats": stats(spark, 3)}, rules)
    V.write_violations(made.violations, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert {r.rule_id: r["count"] for r in back.groupBy("rule_id").count().collect()} == {"a": 3, "b": 6}


def test_user_rules_by_name(spark):
    class RangeRule:
        """Fails a dataset whose values span more than ``limit``."""

        @staticmethod
        def analyze(table, params):
            from pyspark.sql.udtf import AnalyzeResult

            return AnalyzeResult(StructType([StructField(c, StringType()) for c in ("dataset_id", "status", "message", "details")]))

        def __init__(self):
            self.id, self.low, self.high, self.limit = None, None, None, None

        def eval(self, row, params):
            import json

            self.id, self.limit = row["dataset_id"], json.loads(params)["limit"]
            self.low = row["MinValue"] if self.low is None else min(self.low, row["MinValue"])
            self.high = row["MaxValue"] if self.high is None else max(self.high, row["MaxValue"])

        def terminate(self):
            span = self.high - self.low
            yield self.id, "FAILED" if span > self.limit else "PASSED", f"spans {span}", None

    spark.udtf.register("statgate_range_rule", udtf(RangeRule))
    table = stats(spark, 2).where("dataset_id = 'd0' OR StatVar = 'A'")
    rules = [
        {"rule_id": "range", "validator": "statgate_range_rule", "params": {"limit": 6, "why": "it's \\ quoted"}},
        {"rule_id": "other", "validator": "NO_SUCH_RULE", "params": {}},
    ]
    got = {(r.dataset_id, r.validation_name): (r.status, r.message, r.details) for r in R.run_rules({"stats": table}, rules).collect()}
    assert got == {
        ("d0", "range"): ("FAILED", "spans 7.0", "{}"), ("d1", "range"): ("PASSED", "spans 4.0", "{}"),
        ("d0", "other"): ("WARNING", "Unknown custom validator: NO_SUCH_RULE", '{"validator": "NO_SUCH_RULE"}'),
        ("d1", "other"): ("WARNING", "Unknown custom validator: NO_SUCH_RULE", '{"validator": "NO_SUCH_RULE"}'),
    }


def test_a_registered_function_replaces_a_built_in(spark, monkeypatch):
    monkeypatch.setitem(R.VALIDATORS, "MIN_VALUE_CHECK", lambda d, t, r: R._told_alike(d, r, "WARNING", "mine", {}))
    rule = {"rule_id": "m", "validator": "MIN_VALUE_CHECK", "params": {}}
    assert {r.message for r in R.run_rules({"stats": stats(spark)}, [rule]).collect()} == {"mine"}


def test_preview_over_the_runs_own_tables(spark):
    p = R.preview_sql_rule(spark, "SELECT dataset_id, StatVar, MinValue FROM stats", "MinValue >= 0", {"stats": stats(spark)})
    assert p["valid"] and not p["passed"] and p["violations"] == 2 and {r["StatVar"] for r in p["sample_rows"]} == {"B"}
    assert not R.preview_sql_rule(spark, "SELECT * FROM stats_nowhere", "true")["valid"]
