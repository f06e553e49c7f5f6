"""Inputs that once went wrong: CSV quoting and column order, baselines, SQL rules, folders of files."""

import json
import os
import random
import shutil
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from statgate.operators import diff as D
from statgate.operators import quality as Q
from statgate.operators import review as V
from statgate.operators import rules as R
from statgate.operators import samples as SM
from statgate.operators import series as W
from statgate.operators import stats as A
from statgate.plans import catalog
from statgate.sources import readers as S
from statgate.sources import writers as SW
from statgate.streaming import run_events as P

OBS = (
    "dataset_id string, observationAbout string, observationDate string, variableMeasured string, value string, unit string, "
    "measurementMethod string, observationPeriod string, scalingFactor string, __file string, __row bigint"
)


def folder(name="t"):
    return tempfile.mkdtemp(prefix=f"statgate-{name}-")


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_csv_quotes_backslashes_newlines(spark):
    p = write(os.path.join(folder(), "a.csv"), 'name,value\n"a ""b"" c",1\n"x\\",2\ny,3\n"two\nlines",4\n')
    rows = S.read_csv(spark, p).orderBy("__row").collect()
    assert [(r.name, r.value, r["__row"]) for r in rows] == [('a "b" c', "1", 2), ("x\\", "2", 3), ("y", "3", 4), ("two\nlines", "4", 5)]


def test_csv_column_order_missing_columns_and_odd_records(spark):
    d = folder()
    a = write(os.path.join(d, "a.csv"), "place,value\nx,1\n")
    b = write(os.path.join(d, "b.csv"), "value,place,unit\n2,y,kg\n3,z,kg,extra\n4\n")
    rows = {r.place: r for r in S.read_csv(spark, [a, b]).collect()}
    assert (rows["x"].value, rows["x"].unit, rows["y"].value, rows["y"].unit) == ("1", None, "2", "kg")
    assert rows["z"][S.MALFORMED] == "3,z,kg,extra" and rows[None][S.MALFORMED] == "4" and rows["y"][S.MALFORMED] is None


def test_header_table(spark):
    p = write(os.path.join(folder(), "a.csv"), 'a, b ,"c,""d""",a\n1,2,3,4\n')
    assert [(r.ord, r.name) for r in S.csv_header_table(spark, p).orderBy("ord").collect()] == [(1, "a"), (2, "b"), (3, 'c,"d"'), (4, "a")]


def test_csv_round_trip_of_a_table(spark):
    d = folder()
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(*[F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_brand")])
    part.repartition(3).write.option("header", True).option("escape", '"').csv(f"{d}/part")
    files = [os.path.join(d, "part", f) for f in os.listdir(f"{d}/part") if f.endswith(".csv")]
    back = S.read_csv(spark, files)
    assert sorted(map(tuple, back.select(part.columns).collect())) == sorted(map(tuple, part.collect()))


def test_listing_is_of_immediate_children(spark):
    d = folder()
    os.makedirs(f"{d}/sub")
    write(f"{d}/a.csv", "x")
    write(f"{d}/sub/b.csv", "x")
    assert [os.path.basename(r.path) for r in S.list_objects(spark, d).collect()] == ["a.csv"]
    assert S.list_objects(spark, d, recursive=True).count() == 2


def obs(spark, *rows):
    return spark.createDataFrame([(ds, "geo/1", "2020", v, x, "", "", "", "", "f.csv", 2) for ds, v, x in rows], OBS)


def test_diff_compares_values(spark):
    cur = obs(spark, ("ds", "A", "0"), ("ds", "B", "1"), ("ds", "B", "2"), ("ds", "C", "x"))
    base = obs(spark, ("ds", "A", "-0"), ("ds", "B", "1.0"), ("ds", "C", " x "))
    got = {r.StatVar: r.status for r in D.diff_observations(cur, base).collect()}
    assert {k.split("/")[-1].split(":")[-1]: v for k, v in got.items()} == {"A": "SAME", "B": "MODIFIED", "C": "SAME"}


def test_baseline_errors_are_raised_and_versions_kept(spark, monkeypatch):
    root = folder("base")
    first = obs(spark, ("ds", "A", "1"), ("other", "B", "1"))
    assert D.accept_baseline(first, root, "ds", "r1", False) == "v1"
    assert [r.value for r in D.latest_baseline(spark, root, "ds").collect()] == ["1"]
    write(os.path.join(root, "bad"), "")
    monkeypatch.setattr(D, "_manifest_dir", lambda *a: "nosuchscheme://x/y")
    with pytest.raises(Exception):
        D.baseline_versions(spark, root, "ds").collect()


def test_other_datasets_are_not_added(spark):
    root = folder("base")
    both = obs(spark, ("ds", "A", "1"), ("other", "B", "1"))
    D.accept_baseline(both, root, "ds", "r1", False)
    differ, sizes = D.diff_or_first_run(both, root, "ds")
    assert differ.count() == 0
    assert [(r.dataset_id, r.previous_obs_size, r.first_run) for r in sizes.collect()] == [("ds", 1, False)]


STATS = "dataset_id string, StatVar string, NumPlaces bigint, NumObservations bigint, MinValue double, MaxValue double, MaxDate string, Units string"


def stats(spark):
    return spark.createDataFrame([("ds", "A", 0, 5, 1.0, 2.0, "2024", None), ("ds", "B", 2, 3, -4.0, 2.0, "2023", "[kg]")], STATS)


def sql_rule(query, condition, rule="r"):
    return {"rule_id": rule, "validator": "SQL_VALIDATOR", "scope": {"data_source": "stats"}, "params": {"query": query, "condition": condition}}


def test_sql_rules_are_isolated(spark):
    spark.range(3).createOrReplaceTempView("differ")
    rules = [
        sql_rule("SELECT StatVar, NumObservations / NumPlaces AS r FROM stats", "r < 100", "zero"),
        sql_rule("SELECT nope FROM stats", "nope > 0", "bad"),
        sql_rule("SELECT StatVar, Units, MinValue FROM stats", "MinValue >= 2", "low"),
    ]
    made = R.evaluate({"stats": stats(spark)}, rules)
    got = {r.validation_name: r for r in made.results.collect()}
    assert {k: r.status for k, r in got.items()} == {"zero": "PASSED", "bad": "CONFIG_ERROR", "low": "FAILED"}
    assert [(r.rule_id, r.ordinal, r.row) for r in made.violations.orderBy("ordinal").collect()] == [
        ("low", 0, {"StatVar": "A", "Units": None, "MinValue": "1.0"}), ("low", 1, {"StatVar": "B", "Units": "[kg]", "MinValue": "-4.0"})]
    assert spark.table("differ").count() == 3  # the caller's view is as it was
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("__stats")} == set()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    spark.catalog.dropTempView("differ")


def test_deletions_without_sizes_fail(spark):
    differ = spark.createDataFrame([("ds", "A", 9, 0, 0)], D.DIFF_SCHEMA)
    rule = {"rule_id": "d", "validator": "DELETED_RECORDS_COUNT", "scope": {"data_source": "differ"}, "params": {"threshold": 0}}
    (row,) = R.run_rules({"stats": stats(spark), "differ": differ}, [rule]).collect()
    assert row.status == "FAILED"


@pytest.mark.parametrize("rows, status", [([], "SKIPPED"), ([("LEVEL_INFO", "8"), ("LEVEL_ERROR", "2")], "OK"), ([("LEVEL_INFO", "7")], "MISMATCH"), ([("LEVEL_INFO", "abc")], "ERROR")])
def test_counters_match(spark, rows, status):
    counters = spark.createDataFrame([("ds", lv, "NumNodeSuccesses", n) for lv, n in rows], "dataset_id string, level string, counterKey string, count string")
    assert [r.status for r in A.counters_match(stats(spark), counters).collect()] == [status]


def shard_input(spark):
    rows = [("one", f, i + 2, str(i)) for f in ("a.csv", "b.csv") for i in range(3)] + [("two", "c.csv", 2, "x"), ("two", "c.csv", 3, "y")]
    csv = spark.createDataFrame(rows, "dataset_id string, __file string, __row bigint, value string")
    header = spark.createDataFrame([(f, 1, "value") for f in ("a.csv", "b.csv", "c.csv")], "file string, ord int, name string")
    return csv, header


def test_shards_by_dataset_and_file(spark):
    csv, header = shard_input(spark)
    d = folder("shards")
    _, manifest = Q.quality_and_shards(csv, header, 2, out_dir=d)
    got = {(r.dataset_id, r.original_csv): (r.status, [p[len(d) :] for p in r.shard_paths], r.shard_rows) for r in manifest.collect()}
    assert got == {
        ("one", "a.csv"): ("done", ["/dataset_id=one/file=a.csv/shard=0", "/dataset_id=one/file=a.csv/shard=1"], [2, 1]),
        ("one", "b.csv"): ("done", ["/dataset_id=one/file=b.csv/shard=0", "/dataset_id=one/file=b.csv/shard=1"], [2, 1]),
        ("two", "c.csv"): ("skipped", [], []),
    }
    assert sorted(os.listdir(d + "/dataset_id=one")) == ["file=a.csv", "file=b.csv"] and not os.path.exists(d + "/dataset_id=two")


def test_complete_list_of_non_numeric_rows(spark):
    csv, header = shard_input(spark)
    d = folder("quality")
    SW.write_quality(Q.quality_details(csv, header), d, Q.non_numeric_rows(csv, "value"))
    assert sorted((r.file, r.row) for r in spark.read.json(d + "/non_numeric_rows").collect()) == [("c.csv", 2), ("c.csv", 3)]


@pytest.mark.parametrize("name", ["stats_events", "quality_first_dup_lineitem", "shard_manifest_lineitem", "top_lint", "bulk_classify"])
def test_tables_may_be_folders_of_files(spark, name):
    d = folder("parts")
    source = "/root/testdata/sf0.001"
    for t in ("events", "lineitem", "pages"):
        spark.read.parquet(f"{source}/{t}.parquet").repartition(3).write.parquet(f"{d}/{t}.parquet")
    a, b = (sorted(map(str, catalog.QUERIES[name](spark, x).collect())) for x in (source, d))
    assert a == b
    shutil.rmtree(d)


def test_node_headers_in_any_case_and_escaped_quotes(spark):
    p = write(os.path.join(folder(), "a.mcf"), 'Node: dcid:A\nname: "a \\"b\\" c"\nnode: dcid:B\ntypeOf: dcs:X\n\nNODE: "dcid:C"\nname: c\n')
    rows = S.read_nodes(spark, p).orderBy("prop_line").collect()
    assert [(r.node, r.prop, r.value) for r in rows] == [("dcid:A", "name", 'a "b" c'), ("dcid:B", "typeOf", "dcs:X"), ("dcid:C", "name", "c")]
    assert [(r.node_line, r.prop_line) for r in rows] == [(1, 2), (3, 4), (6, 7)]


def test_last_of_repeated_properties_counts(spark):
    text = "Node: dcid:A\ntypeOf: dcs:StatisticalVariable\nstatType: dcs:zRate\nstatType: dcs:measuredValue\n"
    nodes = S.read_nodes(spark, write(os.path.join(folder(), "a.mcf"), text))
    assert V.missing_denominator(nodes).count() == 0


def test_samples_take_the_minimum_of_their_rule(spark):
    rows = [("ds", "A", "2020", "-1", "f.csv", 2), ("ds", "A", "2021", "-9", "f.csv", 3)]
    table = spark.createDataFrame(rows, "dataset_id string, variableMeasured string, observationDate string, value string, __file string, __row bigint")
    wanted = [("ds", f"m#{i}", "check_min_value", "A", f">= {m}") for i, m in enumerate(("0", "-5.0", "-20"))]
    samples = spark.createDataFrame(wanted, "dataset_id string, sample_id string, rule string, statVar string, expected string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("location", "date", "value", "sourceRow", "message")]
    )
    found = SM.enrich_samples(samples, table.withColumn("observationAbout", F.lit("geo/1")))
    assert {r.sample_id: r.date for r in found.collect()} == {"m#0": "2020", "m#1": "2021", "m#2": None}


def run_lines(rng, n):
    out = []
    for seq in range(1, n + 1):
        step = rng.randrange(6)
        out.append(
            rng.choice(
                [
                    {"v": 1, "t": "progress", "step_id": P.STEPS[step][1], "step_index": step, "step_label": P.STEPS[step][2], "substep_id": f"s{seq}"},
                    {"v": 1, "t": "failure", "failure_code": f"E{seq}", "step_id": P.STEPS[step][1], "step_index": step, "step_label": "x", "message": f"m{seq}", "limit": seq},
                    {"v": 1, "t": "run_finished", "status": rng.choice(["succeeded", "failed"]), "exit_code": seq % 3, "step_id": P.STEPS[step][1], "step_index": step},
                    {"v": 1, "t": "run_finished", "status": "failed", "exit_code": 1, "failure_code": f"F{seq}", "message": f"f{seq}"},
                    {"t": "failure", "code": f"L{seq}", "message": f"l{seq}"},
                    {"v": 9},
                ]
            )
        )
    return [(seq + 1, json.dumps(x)) for seq, x in enumerate(out)]


def test_state_of_late_events_equals_replay(spark):
    rng = random.Random(11)
    rows = [(f"run{r}", seq, line) for r in range(25) for seq, line in run_lines(rng, rng.randint(1, 9))]
    events = P.parse_events(spark.createDataFrame(rows, "run_id string, seq bigint, line string")).cache()
    frame = events.toPandas()
    want = {r.run_id: r.asDict() for r in P.replay_status(events).collect()}
    for run_id, own in frame.groupby("run_id"):
        own = own.sample(frac=1, random_state=3).reset_index(drop=True)
        state: dict = {}
        for at in range(0, len(own), 2):
            state = P.apply_events(state, own.iloc[at : at + 2])
        if run_id not in want:
            assert not state
            continue
        got = P.project_state(state)
        assert got == {k: want[run_id][k] for k in got}, run_id


def test_lint_report_fallback_keys_and_locations(spark, tmp_path):
    points = [{"date": "2021", "values": [{"value": 3, "locations": [{"file": "a.csv", "lineNumber": 7}]}]}, {"date": "2020", "values": [{"value": 1}]}]
    report = {
        "entries": [
            {"level": "LEVEL_WARNING", "counterKey": "", "counter": "Other"},
            {"levelSummary": "WARNING", "counter": "Other"},
            {"level": "WARNING", "counterKey": "Own", "counter": "Other"},
            {"level": "WARNING"},
        ],
        "statsCheckSummary": [
            {
                "placeDcid": "", "observationAbout": "geoId/2", "statVarDcid": "V",
                "validationCounters": [{"counterKey": "StatsCheck_MaxPercentFluctuationGreaterThan500", "problemPoints": points}],
            }
        ],
    }
    (tmp_path / "r.json").write_text(json.dumps(report))
    rep = S.read_lint_report(spark, str(tmp_path / "r.json"), "ds")
    assert [(r.key, r["count"]) for r in A.lint_warnings(rep["entries"]).collect()] == [("Other", 2), ("Own", 1)]
    (r,) = W.report_fluctuations(rep["points"]).collect()
    assert r.location == "geoId/2"
    assert [p.locations and [(x.file, x.lineNumber) for x in p.locations] for p in r.points] == [None, [("a.csv", "7")]]


@pytest.mark.parametrize("split", [1, 64, 1 << 27])
def test_raw_run_logs_in_order_of_lines(spark, tmp_path, split):
    lines = ["start", "::STEP::0:Pre-Import Checks", "", *[f"noise {i}" for i in range(200)], "::STEP::4:Results",
             '{"v":1,"t":"run_finished","status":"succeeded","exit_code":0}']
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "run.1.log").write_text("\n".join(lines) + "\n")
    (logs / "run2.log").write_text(lines[1])
    read = P.read_run_logs(spark, str(logs), range_bytes=split)
    got = [r.line for r in read.where("run_id = 'run.1'").orderBy("seq").collect()]
    status = {r.run_id: r.status for r in P.replay_status(P.parse_events(read)).collect()}
    assert got == lines
    assert status["run.1"] == "succeeded" and set(status) == {"run.1", "run2"}


def test_empty_columns_of_the_whole_table(spark, tmp_path):
    from statgate.plans import catalog

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    kind = rows.schema["l_shipdate"].dataType
    rows.withColumn("l_shipdate", F.lit(None).cast(kind)).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["column"], r["ord"]) for r in catalog.QUERIES["quality_empty_columns"](spark, str(tmp_path)).collect()}
    assert got == {("l_shipdate", 11), ("no_value", 12)}
