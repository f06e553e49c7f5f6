"""Raw logs as a stream over restarts; run state by transformWithState and event timers."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from statgate.streaming import run_events as P
from statgate.streaming import run_logs as L

PROGRESS = '{"v":1,"t":"progress","step_id":"%s","step_index":%d,"step_label":"x"}'
DONE = '{"v":1,"t":"run_finished","status":"succeeded","exit_code":0}'
START = datetime.datetime(2024, 1, 1)
ENVELOPE = "run_id string, seq bigint, line string, at timestamp"


def append(folder, name, text):
    with open(os.path.join(folder, name), "a", newline="") as f:
        f.write(text)


def taken(spark, stream, checkpoint, out):
    """Run the stream over what is there now, as a restarted job would."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("limit", [0, 25])
def test_a_stream_of_raw_logs_is_the_batch_after_restarts_in_mid_file(spark, tmp_path, limit):
    logs, ck, out = (str(tmp_path / d) for d in ("logs", "ck", "out"))
    os.makedirs(logs)
    append(logs, "a.log", "one\ntwo\r\nthr")  # the last line is not whole yet

    def stream():
        return P.read_run_logs(spark, logs, stream=True, range_bytes=7, max_bytes=limit)

    first = taken(spark, stream(), ck, out)
    assert first == [("a", 0, "one"), ("a", 4, "two")]
    append(logs, "a.log", "ee\n" + "long " * 30 + "\né\n")
    append(logs, "b.log", "\nx\n")
    taken(spark, stream(), ck, out)
    append(logs, "a.log", "last\n")
    for _ in range(3):
        rows = taken(spark, stream(), ck, out)
    assert rows == sorted(tuple(r) for r in P.read_run_logs(spark, logs, range_bytes=5).collect())
    assert [r[2] for r in rows if r[0] == "a"] == ["one", "two", "three", "long " * 30, "é", "last"]


def test_ranges_of_any_size_give_every_line_once(tmp_path):
    text = "a\n\nbb\n" + "c" * 40 + "\nd"
    append(tmp_path, "r.log", text)
    path = str(tmp_path / "r.log")
    want = [(b.column(1).to_pylist(), b.column(2).to_pylist()) for b in L.read_range(L.LogRange(path, 0, len(text), True))]
    for size in range(1, len(text) + 2):
        got = [r for part in L.ranges(path, 0, len(text), size) for b in L.read_range(part) for r in b.to_pylist()]
        assert [(r["seq"], r["line"]) for r in got] == list(zip(*want[0], strict=True)), size


def test_an_empty_folder_of_logs(spark, tmp_path):
    assert P.read_run_logs(spark, str(tmp_path)).collect() == []


class Runs:
    """A stream of envelopes with arrival times, one file of them after another."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        os.makedirs(f"{folder}/in")
        lines = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).json(f"{folder}/in").withWatermark("at", "0 seconds")
        updates = P.project_status_stream(P.parse_events(lines, ("at",)))
        self.seen = []
        self.query = (
            updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/ck")
            .foreachBatch(lambda df, i: self.seen.extend(r.asDict() for r in df.collect())).start()
        )

    def send(self, *events):
        with open(f"{self.folder}/in/.{self.n}.tmp", "w") as f:
            for run, seq, line, minute in events:
                f.write(json.dumps({"run_id": run, "seq": seq, "line": line, "at": f"{START + datetime.timedelta(minutes=minute):%Y-%m-%dT%H:%M:%SZ}"}) + "\n")
        os.rename(f"{self.folder}/in/.{self.n}.tmp", f"{self.folder}/in/{self.n}.json")
        self.n += 1
        self.seen.clear()
        self.query.processAllAvailable()
        return {r["run_id"]: (r["status"], r["failure_code"]) for r in self.seen}

    def entries(self):
        state = self.spark.read.format("statestore").option("stateVarName", "fields").load(f"{self.folder}/ck")
        return {r.k: r.n for r in state.groupBy(F.col("key.run_id").alias("k")).agg(F.count("*").alias("n")).collect()}


def test_lost_and_finished_runs_end_by_event_time(spark, tmp_path):
    runs = Runs(spark, str(tmp_path))
    try:
        assert runs.send(("a", 1, PROGRESS % ("schema_review", 1), 0), ("b", 1, "noise", 0), ("c", 1, DONE, 0), ("d", 1, "::STEP::4:Results", 2)) == {
            "a": ("running", None), "b": ("starting", None), "c": ("succeeded", None), "d": ("running", None)}
        # processAllAvailable returned: no batch runs without data or news of the watermark
        told = runs.send(("e", 1, "::STEP::0:Pre-Import Checks", 6))
        assert told["a"] == ("failed", "BATCH_JOB_LOST") and told["b"] == ("failed", "STARTUP_FAILED") and "c" not in told and "d" not in told
        told = runs.send(("a", 2, DONE, 7))
        assert told["a"] == ("succeeded", None)  # a lost run that speaks again
        assert told["d"] == ("failed", "BATCH_JOB_LOST")  # heard at 2
        told = runs.send(("z", 1, "x", 66))  # 66 minutes: b, lost at 5, and c, finished at 0, are over; a was heard at 7
        assert "c" not in told and "d" not in told and told.get("e") == ("failed", "BATCH_JOB_LOST")
        left = runs.entries()
        assert "b" not in left and "c" not in left and {"a", "d", "e", "z"} <= set(left)
        runs.send(("z", 2, "y", 300))
        assert set(runs.entries()) == {"z"}
    finally:
        runs.query.stop()


def test_late_events_of_a_stream_equal_the_replay(spark, tmp_path):
    events = [
        ("a", 5, DONE), ("a", 1, PROGRESS % ("pre_import", 0)), ("a", 4, PROGRESS % ("results", 5)), ("a", 2, PROGRESS % ("import_tool", 2)),
        ("b", 3, '{"t":"failure","code":"L","message":"late"}'), ("b", 1, '{"v":1,"t":"run_finished","status":"failed","exit_code":1,"step_id":"validation","step_index":4}'),
        ("b", 2, "::STEP::1:Gemini Review"), ("a", 3, '{"t":"failure","code":"M","message":"m"}'), ("c", 1, "nothing"),
    ]
    runs = Runs(spark, str(tmp_path))
    try:
        latest = {}
        for i, (run, seq, line) in enumerate(events):
            runs.send((run, seq, line, i / 60))
            latest.update({r["run_id"]: r for r in runs.seen})
    finally:
        runs.query.stop()
    want = {r.run_id: r.asDict() for r in P.replay_status(P.parse_events(spark.createDataFrame(events, P.ENVELOPE_SCHEMA))).collect()}
    for run, row in want.items():
        assert {k: latest[run][k] for k in row if k in latest[run]} == {k: v for k, v in row.items() if k in latest[run]}


def test_a_later_step_without_a_substep_ends_the_substep_for_all_later_batches(spark, tmp_path):
    sub = '{"v":1,"t":"progress","step_id":"schema_review","step_index":1,"step_label":"x","substep_id":"s"}'
    events = [("a", 1, sub), ("a", 3, PROGRESS % ("results", 5)), ("a", 2, PROGRESS % ("pre_import", 0))]
    runs = Runs(spark, str(tmp_path))
    try:
        seen = []
        for i, (run, seq, line) in enumerate(events):
            runs.send((run, seq, line, i / 60))
            seen += [(r["substep_id"], r["step_index"]) for r in runs.seen]
    finally:
        runs.query.stop()
    assert seen == [("s", 1), (None, 5), (None, 5)]


def test_a_run_reads_and_writes_its_state_once_a_batch():
    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    class Handle:
        def getValueState(self, name, schema):
            self.state = Value()
            return self.state

    handle, status = Handle(), P.RunStatus(timers=False)
    status.init(handle)
    rows = [{"event": json.dumps({"seq": i, "kind": "progress", "step_index": i % 6})} for i in range(100)]
    for part in (rows[50:], rows[:50]):
        (out,) = status.handleInputRows(("a",), iter(part), None)
    assert handle.state.calls == 4 and (out.run_id, out.step_index, out.last_seq, out.advanced) == ("a", 5, 99, False)


def test_the_state_store_must_keep_map_entries(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="stateStore"):
            P.project_status_stream(P.parse_events(spark.createDataFrame([], P.ENVELOPE_SCHEMA)), timers=False)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
