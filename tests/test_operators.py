"""Edge cases on hand-written inputs (the reference's own tests build inputs inline)."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from statgate.functions import scalars as X
from statgate.operators import bulk as B
from statgate.operators import quality as Q
from statgate.sources import readers as S
from statgate.streaming import run_events as P


def _write(d, name, text):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_is_numeric_matches_python_float(spark):
    cases = [
        "1", " 2.5 ", "1_000", "1__0", "nan", "-inf", "Infinity", "1e5", ".5", "5.", "abc", "12d", "", "  ", "+-1", "0x10", "1,000",
        "-nan", "+NaN", "12D", "0x1p3", "1_000.5", "_1", "1_", "iNfInItY", "1e-5_0", "\t7\n", "1.5f", "e5", ".", "00012",
    ]

    def py(s):
        if not s.strip():
            return True
        try:
            float(s)
            return True
        except ValueError:
            return False

    def pyval(s):
        try:
            return float(s)
        except ValueError:
            return None

    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r.s: r.ok for r in df.select("s", X.is_numeric("s").alias("ok")).collect()}
    assert got == {c: py(c) for c in cases}
    import math

    vals = {r.s: r.v for r in df.select("s", X.to_double("s").alias("v")).collect()}
    for c in cases:
        want = pyval(c) if c.strip() else None
        assert (vals[c] is None and want is None) or (want is not None and vals[c] is not None and (vals[c] == want or (math.isnan(want) and math.isnan(vals[c])))), c


def test_read_csv_row_numbers_and_quality(spark):
    d = tempfile.mkdtemp(prefix="statgate-test-")
    a = _write(d, "a.csv", "x,y,value\n1,2,3\n1,2,3\n4,, x \n\n5,6,7\n")
    b = _write(d, "b.csv", "x,y,value\n9,9,9\n8,8,8\n9,9,9\n")
    df = S.read_csv(spark, [a, b])
    rows = {(os.path.basename(r["__file"]), r["__row"], r["x"]) for r in df.collect()}
    # blank lines are skipped and not counted (as csv.DictReader does)
    assert rows == {("a.csv", 2, "1"), ("a.csv", 3, "1"), ("a.csv", 4, "4"), ("a.csv", 5, "5"), ("b.csv", 2, "9"), ("b.csv", 3, "8"), ("b.csv", 4, "9")}
    dup = {(os.path.basename(r.file), r.row) for r in Q.first_duplicate_row(df, ["x", "y", "value"]).collect()}
    assert dup == {("a.csv", 3), ("b.csv", 4)}
    bad = {(os.path.basename(r.file), r.row) for r in Q.non_numeric_rows(df, "value").collect()}
    assert bad == {("a.csv", 4)}


def test_duplicate_and_empty_columns(spark):
    d = tempfile.mkdtemp(prefix="statgate-test-")
    p = _write(d, "c.csv", "a, b ,a,c\n1,,1,\n2,,2,\n")
    hdr = S.csv_header_table(spark, [p])
    dups = [(r.name, r.ord) for r in Q.duplicate_columns(hdr).collect()]
    assert dups == [("a", 1)]
    csv = S.read_csv(spark, [p])
    empty = sorted(r.column for r in Q.empty_columns(csv).collect())
    assert empty == [" b ", "c"]


def test_read_nodes(spark):
    d = tempfile.mkdtemp(prefix="statgate-test-")
    p = _write(
        d,
        "t.tmcf",
        "# header comment\nNode: E:t->E0\ntypeOf: dcs:StatVarObservation\nvalue: C:t->value # inline\n\nNode: dcid:X\nname: \"Some: name\"\n",
    )
    n = S.read_nodes(spark, [p], dataset_id="ds")
    got = sorted((r.node_line, r.node, r.prop, r.value) for r in n.collect())
    assert got == [
        (2, "E:t->E0", "typeOf", "dcs:StatVarObservation"),
        (2, "E:t->E0", "value", "C:t->value"),
        (6, "dcid:X", "name", "Some: name"),
    ]


def test_read_nodes_indented_header_and_leading_comment(spark):
    d = tempfile.mkdtemp(prefix="statgate-test-")
    p = _write(d, "v.mcf", "# c\n  Node: dcid:A\ntypeOf: dcs:StatisticalVariable\nNode: dcid:B\npopulationType: dcs:Person\n   Node: dcid:C\nname: \"C\"\n")
    got = sorted((r.node_line, r.node, r.prop, r.value) for r in S.read_nodes(spark, [p]).collect())
    assert got == [
        (2, "dcid:A", "typeOf", "dcs:StatisticalVariable"),
        (4, "dcid:B", "populationType", "dcs:Person"),
        (6, "dcid:C", "name", "C"),
    ]


def test_bulk_nested_and_unrelated_files_ignored(spark):
    listing = spark.createDataFrame(
        [
            ("root/ds_a/ds_output.tmcf", 1), ("root/ds_a/ds_output.csv", 10), ("root/ds_a/notes.csv", 5),
            ("root/ds_a/sub/x_output.tmcf", 1), ("root/b/x_output.tmcf", 1), ("root/b/y_output.csv", 3),
        ],
        "path string, size bigint",
    )
    got = {r.folder: (r.dataset_id, r.reason) for r in B.classify_folders(listing, "root").collect()}
    assert got["ds_a"] == ("ds-a", None)
    assert got["b"] == (None, "no *_output.csv matching x_output.tmcf (found y_output.csv instead)")


def test_dataset_id_short_name_gets_hash(spark):
    df = spark.createDataFrame([("Birth Dataset 2024",), ("ab",)], "f string")
    got = [r.d for r in df.select(X.dataset_id_from_folder("f").alias("d")).collect()]
    assert got[0] == "birth-dataset-2024"
    assert got[1].startswith("ds-") and len(got[1]) == 11


def _lines(spark, rows):
    return spark.createDataFrame(rows, "run_id string, seq bigint, line string")


def test_projector_failure_keeps_running_and_backward_progress_ignored(spark):
    rows = [
        ("r", 1, '{"v":1,"t":"progress","step_id":"import_tool","step_index":2,"step_label":"DC import (genmcf)"}'),
        ("r", 2, '{"v":1,"t":"progress","step_id":"pre_import","step_index":0,"step_label":"Pre-import checks"}'),
        ("r", 3, '{"v":1,"t":"failure","failure_code":"X","step_id":"import_tool","step_index":2,"step_label":"L","message":"m"}'),
        ("r", 4, "::STEP::2.4:Differ"),
        ("r", 5, '{"v":1,"t":"progress","step_id":"nope","step_index":1,"step_label":"L"}'),
        ("r", 6, '{"v":1,"t":"progress","step_id":"results","step_index":true,"step_label":"L"}'),
    ]
    ev = P.parse_events(_lines(spark, rows))
    kinds = [r.kind for r in ev.orderBy("seq").collect()]
    assert kinds == ["progress", "progress", "failure", "legacy_step", "rejected", "rejected"]
    st = P.replay_status(ev).collect()[0]
    assert (st.status, st.step_id, st.step, st.failure_code) == ("running", "baseline_diff", "2.4", "X")


def test_stream_projection_equals_batch_replay(spark):
    d = tempfile.mkdtemp(prefix="statgate-stream-")
    ck = tempfile.mkdtemp(prefix="statgate-ckpt-")
    rows = [
        {"run_id": "a", "seq": 1, "line": "::STEP::0:Pre-Import Checks"},
        {"run_id": "a", "seq": 2, "line": '{"t":"failure","code":"CSV_SPLIT_FAILED","message":"split"}'},
        {"run_id": "b", "seq": 1, "line": '{"v":1,"t":"run_finished","status":"failed","exit_code":1,"step_id":"validation","step_index":4}'},
        {"run_id": "a", "seq": 3, "line": '{"v":1,"t":"run_finished","status":"succeeded","exit_code":0}'},
        {"run_id": "a", "seq": 4, "line": '{"v":1,"t":"progress","step_id":"results","step_index":5,"step_label":"Results"}'},
    ]
    pd.DataFrame(rows[:3]).to_json(os.path.join(d, "part1.json"), orient="records", lines=True)
    stream = P.project_status_stream(P.parse_events(P.read_run_events(spark, d)), timers=False)
    q = stream.writeStream.outputMode("update").format("memory").queryName("run_status_t").option("checkpointLocation", ck).start()
    q.processAllAvailable()
    pd.DataFrame(rows[3:]).to_json(os.path.join(d, "part2.json"), orient="records", lines=True)
    q.processAllAvailable()
    q.stop()
    adv = {(r.run_id, r.step_index) for r in P.step_advances(spark.table("run_status_t")).collect()}
    assert ("a", 0) in adv and ("a", 5) in adv and ("b", 4) in adv
    latest = spark.table("run_status_t").groupBy("run_id").agg(F.max_by(F.struct("status", "step_index", "exit_code", "failure_code"), "last_seq").alias("s"))
    got = {r.run_id: tuple(r.s) for r in latest.collect()}
    batch = P.replay_status(P.parse_events(spark.createDataFrame(rows, P.ENVELOPE_SCHEMA)))
    want = {r.run_id: (r.status, r.step_index, r.exit_code, r.failure_code) for r in batch.collect()}
    assert got == want
    assert want["a"] == ("succeeded", 5, 0, "CSV_SPLIT_FAILED")
    assert want["b"] == ("failed", 4, 1, None)


def test_enrich_samples_suffix_match_and_min_threshold(spark):
    from statgate.operators import samples as SM

    obs = spark.createDataFrame(
        [
            ("ds", "geo/1", "2020", "dcid:Count_X", "5", "/data/f.csv", 2),
            ("ds", "geo/2", "2021", "dcid:Count_X", "-1", "/data/f.csv", 3),
            ("ds", "geo/3", "2022", "Other", "-7", "/data/f.csv", 4),
        ],
        "dataset_id string, observationAbout string, observationDate string, variableMeasured string, value string, __file string, __row bigint",
    )
    samples = spark.createDataFrame(
        [("ds", "m#0", "check_min_value", "Count_X"), ("ds", "s#0", "check_sql", "Count_X"), ("ds", "u#0", "check_sql", "Missing")],
        "dataset_id string, sample_id string, rule string, statVar string",
    ).select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("location", "date", "value", "expected", "sourceRow", "message")]
    )
    got = {r.sample_id: (r.location, r.date, r.sourceRow) for r in SM.enrich_samples(samples, obs).collect()}
    assert got["m#0"] == ("geo/2", "2021", "f.csv:3")  # first record below the minimum
    assert got["s#0"] == ("geo/1", "2020", "f.csv:2")  # first record of the variable
    assert got["u#0"] == (None, None, None)


def test_date_granularity_mix_with_template_literals(spark):
    from statgate.operators import series as W

    obs = spark.createDataFrame([("ds", "2020-01"), ("ds", "2020-02")], "dataset_id string, observationDate string")
    nodes = spark.createDataFrame(
        [("ds", "observationDate", "2020"), ("ds", "observationDate", "C:t->date"), ("ds", "observationDate", "2020/1")],
        "dataset_id string, prop string, value string",
    )
    got = {r.source: (list(r.formats), r.status) for r in W.date_granularity_mix(obs, nodes).collect()}
    assert got == {"column": (["YYYY-MM"], "PASSED"), "template": (["YYYY"], "PASSED"), "all": (["YYYY", "YYYY-MM"], "WARNING")}


def test_structural_lint_deals_triples_out_by_node(spark, monkeypatch):
    from statgate.operators import review as T

    rows = [("d", "f", line, f"n{line}", prop, "StatVarObservation") for line in range(20) for prop in ("typeOf", "unit", "unit", "extra")] + [("d", "f", None, None, "unit", "x")] * 3
    nodes = spark.createDataFrame(rows, "dataset_id string, file string, node_line bigint, node string, prop string, value string")
    whole = sorted(map(tuple, T.structural_node_lint(nodes).select("line", "type", "message").collect()), key=str)
    monkeypatch.setattr(T, "TASK_TRIPLES", 10)
    dealt = T.structural_node_lint(nodes)
    assert "hashpartitioning(dataset_id" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, dealt.select("line", "type", "message").collect()), key=str) == whole
    assert len(whole) == 20 * 3 + 2  # duplicate, naming and namespace; the node without a line has a duplicate and no type
