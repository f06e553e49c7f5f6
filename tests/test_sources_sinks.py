"""Files in and out: lint report, shards, results, baselines, SQL rule preview."""

import glob
import json
import os
import tempfile

from pyspark.sql import functions as F

from statgate.operators import diff as D
from statgate.operators import quality as Q
from statgate.operators import rules as R
from statgate.operators import series as W
from statgate.operators import stats as A
from statgate.sources import readers as S
from statgate.sources import writers as SW

REPORT = {
    "levelSummary": {
        "LEVEL_ERROR": {"counters": {"Existence_FailedDcCall_x": "3", "MCF_MissingRef": "2", "Bad": "n/a"}},
        "LEVEL_INFO": {"counters": {"NumNodeSuccesses": "7", "NumRowSuccesses": "7"}},
    },
    "entries": [
        {"level": "LEVEL_WARNING", "counterKey": "CSV_Warn", "userMessage": "w", "location": {"file": "a.csv", "lineNumber": "3"}},
        {"level": "LEVEL_ERROR", "counterKey": "MCF_MissingRef", "userMessage": "e", "location": {"file": "a.csv", "lineNumber": "2"}},
    ],
    "statsCheckSummary": [
        {
            "placeDcid": "geoId/1",
            "statVarDcid": "Count_X",
            "observationPeriod": "P1Y",
            "validationCounters": [
                {
                    "counterKey": "StatsCheck_MaxPercentFluctuationGreaterThan500",
                    "percentDifference": 900,
                    "problemPoints": [
                        {"date": "2021", "values": [{"value": {"value": "10"}, "unit": "USD"}]},
                        {"date": "2020", "values": [{"value": 1}]},
                    ],
                }
            ],
        }
    ],
    "commandArgs": {"inputFiles": ["a.csv"], "existenceChecks": True, "resolution": "RESOLUTION_MODE_FULL"},
}


def test_read_lint_report_and_fluctuation_samples(spark):
    d = tempfile.mkdtemp(prefix="statgate-test-")
    p = os.path.join(d, "report.json")
    with open(p, "w") as f:
        json.dump(REPORT, f, indent=2)
    rep = S.read_lint_report(spark, p, dataset_id="ds")
    totals = {r.level: r.total for r in A.lint_totals(rep["counters"]).collect()}
    assert totals == {"LEVEL_ERROR": 5, "LEVEL_INFO": 14}
    assert A.structural_lint_count(rep["counters"]).collect()[0].n == 2  # 'n/a' is skipped
    assert [(r.key, r["count"]) for r in A.lint_warnings(rep["entries"]).collect()] == [("CSV_Warn", 1)]
    fl = W.report_fluctuations(rep["points"]).collect()
    assert len(fl) == 1
    r = fl[0]
    assert [p.date for p in r.points] == ["2020", "2021"] and [p.value for p in r.points] == ["1", "10"]
    assert (r.series_length, float(r.period_gap_years), r.percent_change) == (2, 1.0, 900.0)


def test_shards_and_results_written(spark):
    d = tempfile.mkdtemp(prefix="statgate-test-")
    csv = spark.range(0, 25).select(
        F.lit("ds").alias("dataset_id"), F.lit("f.csv").alias("__file"), (F.col("id") + 2).alias("__row"), F.col("id").cast("string").alias("value")
    )
    SW.write_shards(csv, os.path.join(d, "shards"), rows_per_shard=10)
    parts = sorted(glob.glob(os.path.join(d, "shards", "dataset_id=ds", "file=f.csv", "shard=*")))  # fewer rows than a shard in the last
    assert [os.path.basename(x) for x in parts] == ["shard=0", "shard=1", "shard=2"]
    for x in parts:
        files = glob.glob(os.path.join(x, "*.csv"))
        assert len(files) == 1  # one task, so one file, per shard
        lines = open(files[0]).read().splitlines()
        assert lines[0] == "value"
    first = open(glob.glob(os.path.join(parts[0], "*.csv"))[0]).read().splitlines()[1:]
    assert first == [str(i) for i in range(10)]
    res = spark.createDataFrame([("ds", "r1", "FAILED", "m", "{}", "{}")], ", ".join(f"{c} string" for c in R.RESULT_COLUMNS))
    SW.write_results(res, os.path.join(d, "results"))
    back = spark.read.json(os.path.join(d, "results"))
    assert back.count() == 1


def test_many_small_shards_share_tasks_and_keep_files_and_order(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    assert (SW.shard_tasks(86, 7000, 200), SW.shard_tasks(5143, 7000, 200), SW.shard_tasks(30858, 7000, 200)) == (86, 200, 433)
    csv = spark.range(0, 1000).select(
        F.lit("ds").alias("dataset_id"), F.concat(F.lit("f"), F.col("id") % 2).alias("__file"), (F.floor(F.col("id") / 2) + 2).alias("__row"), F.col("id").cast("string").alias("value")
    )
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        SW.write_shards(csv.orderBy(F.xxhash64("value")), str(tmp_path / "out"), 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    writers = set()
    for f in range(2):
        for shard in range(50):
            (file,) = glob.glob(str(tmp_path / f"out/dataset_id=ds/file=f{f}/shard={shard}/*.csv"))
            assert open(file).read().split() == ["value", *(str(2 * i + f) for i in range(shard * 10, shard * 10 + 10))]
            writers.add(os.path.basename(file).split("-")[1])
    assert len(writers) == 3  # tasks, not one for each of 100 shards


def test_files_of_one_base_name_keep_apart(spark, tmp_path):
    for name in ("p/a.csv", "q/a.csv", "q_a.csv", "q%20*/a.csv"):
        os.makedirs((tmp_path / "in" / name).parent, exist_ok=True)
        (tmp_path / "in" / name).write_text('k,v\n1,"' + name + '"\n2,"x\ny"\n3,z\n')
    root = f"file:{tmp_path}/in"
    csv = S.read_csv(spark, [str(tmp_path / "in" / n) for n in ("p", "q", "q_a.csv")], dataset_id="d/1")
    out = str(tmp_path / "out")
    SW.write_shards(csv, out, 2, root=root)
    made = Q.shard_manifest(csv, 2, out_dir=out, root=root).collect()
    assert sorted(r.original_csv.removeprefix(root + "/") for r in made) == ["p/a.csv", "q/a.csv", "q_a.csv"]
    for r in made:
        assert (r.shard_rows, r.shard_count, r.total_rows) == ([2, 1], 2, 3)
        cells = []
        for path in r.shard_paths:
            (file,) = glob.glob(path + "/*.csv")
            cells += [(x.k, x.v) for x in S.read_csv(spark, file).orderBy("__row").collect()]
        assert cells == [("1", r.original_csv.removeprefix(root + "/")), ("2", "x\ny"), ("3", "z")]


def test_two_accepts_at_once_are_two_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    schema = "dataset_id string, value string"
    with ThreadPoolExecutor(6) as pool:
        jobs = [pool.submit(D.accept_baseline, spark.createDataFrame([("ds", str(i))], schema), str(tmp_path), "ds", f"run-{i}", False) for i in range(6)]
        versions = sorted(j.result() for j in jobs)
    assert versions == [f"v{i}" for i in range(1, 7)]
    held = D.baseline_versions(spark, str(tmp_path), "ds").collect()
    assert [r.version for r in held] == [f"v{i}" for i in range(6, 0, -1)] and len({r.run_id for r in held}) == 6
    assert {spark.read.parquet(r.path).first().value for r in held} == {str(i) for i in range(6)}
    assert not D.put_if_absent(spark, f"{D._manifest_dir(str(tmp_path), 'ds')}/000000003.json", "x")


def test_accept_baseline_versions(spark):
    root = tempfile.mkdtemp(prefix="statgate-base-")
    obs = spark.createDataFrame(
        [("ds", "geo/1", "2020", "Count_X", "1", "", "", "", "", "f.csv", 2)],
        "dataset_id string, observationAbout string, observationDate string, variableMeasured string, value string, unit string, "
        "measurementMethod string, observationPeriod string, scalingFactor string, __file string, __row bigint",
    )
    differ, sizes = D.diff_or_first_run(obs, root, "ds")
    assert differ.count() == 0 and sizes.collect()[0].first_run
    assert D.accept_baseline(obs, root, "ds", "run-1", blocked=True) is None  # gate (D9)
    assert D.accept_baseline(obs, root, "ds", "run-1", blocked=False) == "v1"
    assert D.accept_baseline(obs, root, "ds", "run-1", blocked=False) is None  # already current
    changed = obs.withColumn("value", F.lit("2"))
    assert D.accept_baseline(changed, root, "ds", "run-2", blocked=False) == "v2"
    assert [r.version for r in D.baseline_versions(spark, root, "ds").collect()] == ["v2", "v1"]
    differ, sizes = D.diff_or_first_run(obs, root, "ds")
    assert [(r.StatVar, r.MODIFIED) for r in differ.collect()] == [("Count_X", 1)]


def test_preview_sql_rule(spark):
    spark.createDataFrame([("A", 5), ("B", -1)], "StatVar string, MinValue int").createOrReplaceTempView("stats")
    p = R.preview_sql_rule(spark, "SELECT StatVar, MinValue FROM stats", "MinValue >= 0")
    assert p["valid"] and not p["passed"] and p["violations"] == 1 and p["sample_rows"] == [{"StatVar": "B", "MinValue": -1}]
    bad = R.preview_sql_rule(spark, "SELECT nope FROM stats", "nope > 0")
    assert not bad["valid"]


def test_list_objects(spark):
    d = tempfile.mkdtemp(prefix="statgate-list-")
    os.makedirs(os.path.join(d, "a"))
    with open(os.path.join(d, "a", "x_output.csv"), "w") as f:
        f.write("abc")
    got = [(os.path.basename(r.path), r.size) for r in S.list_objects(spark, d, recursive=True).collect()]
    assert got == [("x_output.csv", 3)]


def test_advisories_sink_and_goldens_reader(spark):
    from statgate.operators import samples as SM

    d = tempfile.mkdtemp(prefix="statgate-test-")
    res = spark.createDataFrame(
        [("ds", "r1", "FAILED", " bad, \"quoted\"\nand more ", "x" * 600, "{}"), ("ds", "r2", "PASSED", "ok", "{}", "{}"), ("ds", "r3", "WARNING", None, None, None)],
        ", ".join(f"{c} string" for c in R.RESULT_COLUMNS),
    )
    violations = spark.createDataFrame([("ds", "r1", 0, {"location": "geo/1"}), ("ds", "r1", 1, {"location": "geo/2"})], "dataset_id string, rule_id string, ordinal bigint, row map<string,string>")
    issues = spark.createDataFrame([("ds", None, " m ", "f.tmcf", 3, " fix ")], "dataset_id string, severity string, message string, file string, line int, suggestion string")
    points = "dataset_id string, statVar string, location string, points array<struct<date string, value string>>, percentDifference string, series_length bigint"
    fluct = spark.createDataFrame([("ds", "V", "geo/3", [("2020", "4"), ("2021", "10.5")], "162.5", 2), ("ds", "W", None, [("2020", "4")], None, 1)], points)
    adv = SM.advisory_export(res, issues, fluct, violations, "in/out.csv", "run-9")
    SW.write_advisories(adv, os.path.join(d, "adv"))
    back = SW.read_advisories(spark, os.path.join(d, "adv"))
    assert back.columns == SW.ADVISORY_COLUMNS
    got = {(r.type, r.rule_id or r.statvar): r.asDict() for r in back.collect()}
    assert len(got) == 5 and all(v is not None for r in got.values() for v in r.values())
    failed = got["validation_warning", "r1"]
    assert (failed["severity"], failed["message"], len(failed["details"]), failed["place_id"]) == ("failed", 'bad, "quoted"\nand more', 500, "geo/1")
    assert (failed["source_file"], failed["dataset"], failed["run_id"]) == ("in/out.csv", "ds", "run-9")
    issue = got["ai_advisory", ""]
    assert (issue["severity"], issue["line"], issue["details"], issue["message"]) == ("advisory", "3", "Suggestion: fix", "m")
    jump, single = got["statistical_fluctuation", "V"], got["statistical_fluctuation", "W"]
    assert (jump["period"], jump["previous_value"], jump["current_value"], jump["percent_change"]) == ("2020 → 2021", "4.0", "10.5", "162.50")
    assert (jump["series_points"], jump["file"]) == ("2", "out.csv") and (single["period"], single["percent_change"]) == ("", "")
    g = os.path.join(d, "goldens.csv")
    with open(g, "w") as f:
        f.write("variableMeasured,observationAbout\n Count_X ,geo/1\n")
    rows = S.read_goldens(spark, g).collect()
    assert [(r.variableMeasured, r.observationAbout) for r in rows] == [("Count_X", "geo/1")]
