"""Run-progress events (P1-P9): parse, resolve legacy markers, project run status.

Input lines arrive as JSON-lines envelopes ``{run_id, seq, line}`` where
``line`` is one raw stdout line of a validation run (a v1 JSON event, a
legacy failure object or a legacy ``::STEP::`` marker). ``seq`` orders the
lines of a run.

* ``parse_events`` (P1, P2, P5) is a stateless projection, usable on batch
  and streaming frames alike.
* ``project_status_stream`` (P3, P4, P7) keeps a struct of fields per run with
  ``transformWithState`` and ends lost and finished runs by event timers.
* ``replay_status`` (P9) computes the same final state as a grouped
  aggregate (``max_by`` per field), so a run with a huge log is still
  pre-aggregated on the map side.
"""

from __future__ import annotations

import contextlib
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from statgate.functions.scalars import strip_blanks
from statgate.streaming.run_logs import read_run_logs  # noqa: F401

# state functions are pickled for their workers, which have no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The step registry (index, id, label, legacy token, legacy marker line).
STEPS = [
    (0, "pre_import", "Pre-import checks", "0", "::STEP::0:Pre-Import Checks"),
    (1, "schema_review", "Schema review", "1", "::STEP::1:Gemini Review"),
    (2, "import_tool", "DC import (genmcf)", "2", "::STEP::2:DC Import Tool"),
    (3, "baseline_diff", "Baseline comparison", "2.4", "::STEP::2.4:Differ"),
    (4, "validation", "Import validation", "3", "::STEP::3:DC Import Validation"),
    (5, "results", "Results", "4", "::STEP::4:Results"),
]
STEP_SCHEMA = "step_index int, step_id string, step_label string, legacy_token string, marker string"
RUN_STATUSES = ["succeeded", "failed", "cancelled"]
ENVELOPE_SCHEMA = "run_id string, seq bigint, line string"

EVENT_COLUMNS = [
    "run_id", "seq", "kind", "step_index", "step_id", "step_label", "substep_id", "substep_label",
    "failure_code", "message", "failure_limit", "failure_details", "status", "exit_code",
]


def steps_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STEPS, STEP_SCHEMA)


def _step_map(col: Column, key: int, val: int) -> Column:
    return F.create_map(*[x for s in STEPS for x in (F.lit(s[key]), F.lit(s[val]))])[col]


def read_run_events(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Envelopes from JSON-lines files (a stream by default)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ENVELOPE_SCHEMA).json(path)


def _vtype(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def parse_events(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """P1 + P2 + P5: classify each line; output one row per line with ``kind`` and the columns named in ``carry``.

    kind: progress / failure / run_finished (valid v1), legacy_step (marker),
    legacy_failure, rejected (v1 JSON that fails validation) or ignored.
    Integers must be JSON integers (booleans and strings are rejected), keys
    outside the schema are rejected, and an unknown step id is rejected.
    """
    # stage 1: parse once; stage 2: one type/value column per field; stage 3: classify.
    # Each stage is a separate projection so the variant work is not repeated per use.
    text = strip_blanks(F.col("line"))
    is_json = text.startswith("{")
    # One parse per line into map<key, variant>; the per-key JSON types and
    # string values come from two lambdas over that map, so the generated code
    # stays small whatever the number of fields checked.
    obj = F.when(is_json, F.try_parse_json(text).try_cast("map<string,variant>"))
    s1 = lines.select("run_id", "seq", *carry, text.alias("__text"), is_json.alias("__is_json"), obj.alias("__m"))
    s2 = s1.select(
        "run_id",
        "seq",
        *carry,
        "__text",
        "__is_json",
        F.map_keys("__m").alias("__keys"),
        F.transform_values("__m", lambda _, x: F.schema_of_variant(x)).alias("__types"),
        F.transform_values("__m", lambda _, x: F.try_variant_get(x, "$", "string")).alias("__strs"),
    )
    s2 = s2.select(
        "*",
        F.col("__strs")["step_index"].try_cast("bigint").alias("i_step_index"),
        F.col("__strs")["exit_code"].try_cast("bigint").alias("i_exit_code"),
        F.col("__strs")["v"].try_cast("bigint").alias("i_v"),
        F.col("__strs")["limit"].try_cast("double").alias("d_limit"),
        F.col("__strs")["details"].alias("j_details"),
    )
    keys = F.col("__keys")
    intlike = ["BIGINT", "INT", "SMALLINT", "TINYINT"]

    def has(k):
        return F.coalesce(F.array_contains(keys, k), F.lit(False))

    def typ(k):
        return F.col("__types")[k]

    def get(k):
        return F.col("__strs")[k]

    def nonempty_str(k):
        return (typ(k) == "STRING") & (strip_blanks(get(k)) != "")

    def absent_or_null(k):
        return ~has(k) | (typ(k) == "VOID") | typ(k).isNull()

    def nonneg_int(k):
        return typ(k).isin(*intlike) & (F.col("i_step_index") >= 0)

    def only(allowed):
        return F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) == 0, F.lit(False))

    known_step = get("step_id").isin(*[s[1] for s in STEPS])
    v1 = typ("v").isin(*intlike) & (F.col("i_v") == 1)
    t = get("t")
    substep_ok = absent_or_null("substep_id") | (nonempty_str("substep_id") & (absent_or_null("substep_label") | nonempty_str("substep_label")))
    base_keys = ["v", "t", "step_id", "step_index", "step_label"]
    progress_ok = (
        (t == "progress") & nonempty_str("step_id") & nonempty_str("step_label") & nonneg_int("step_index") & substep_ok
        & only(base_keys + ["substep_id", "substep_label"]) & known_step
    )
    failure_ok = (
        (t == "failure") & nonempty_str("failure_code") & nonempty_str("step_id") & nonempty_str("step_label") & nonempty_str("message")
        & nonneg_int("step_index") & (absent_or_null("limit") | typ("limit").isin(*intlike))
        & (absent_or_null("details") | typ("details").startswith("OBJECT")) & substep_ok
        & only(base_keys + ["failure_code", "message", "limit", "details", "substep_id", "substep_label"]) & known_step
    )
    finished_ok = (
        (t == "run_finished") & has("status") & has("exit_code") & get("status").isin(*RUN_STATUSES) & typ("exit_code").isin(*intlike)
        & (absent_or_null("failure_code") | nonempty_str("failure_code")) & (absent_or_null("message") | (typ("message") == "STRING"))
        & (absent_or_null("step_id") | nonempty_str("step_id")) & (absent_or_null("step_index") | nonneg_int("step_index"))
        & only(["v", "t", "status", "exit_code", "failure_code", "message", "step_id", "step_index", "step_label"])
    )
    legacy_code = F.coalesce(F.when(nonempty_str("code"), get("code")), F.when(nonempty_str("failure_code"), get("failure_code")))
    legacy_failure = F.col("__is_json") & (t == "failure") & absent_or_null("v") & legacy_code.isNotNull() & (typ("message") == "STRING")
    marker_idx = F.create_map(*[x for s in STEPS for x in (F.lit(s[4]), F.lit(s[0]))])[F.col("__text")]
    parsed = F.col("__keys").isNotNull()
    kind = (
        F.when(~F.col("__is_json") & marker_idx.isNotNull(), F.lit("legacy_step"))
        .when(~F.col("__is_json") | ~parsed, F.lit("ignored"))
        .when(v1 & progress_ok, F.lit("progress"))
        .when(v1 & failure_ok, F.lit("failure"))
        .when(v1 & finished_ok, F.lit("run_finished"))
        .when(v1, F.lit("rejected"))
        .when(legacy_failure, F.lit("legacy_failure"))
        .otherwise(F.lit("ignored"))
    )
    s3 = s2.select(
        "*", kind.alias("kind"), legacy_code.alias("__legacy_code"), marker_idx.alias("__marker_idx"),
        (typ("step").isNotNull() & (typ("step") != "VOID")).alias("__has_step"),
    )
    k = F.col("kind")
    token = F.when(F.col("__has_step"), strip_blanks(get("step")))
    legacy_step_idx = F.when(F.col("__legacy_code") == "CSV_SPLIT_FAILED", F.lit(0)).otherwise(_step_map(token, 3, 0))
    id_to_idx = _step_map(get("step_id"), 1, 0)
    step_idx = (
        F.when(k == "legacy_step", F.col("__marker_idx"))
        .when(k.isin("progress", "failure", "run_finished"), id_to_idx)
        .when(k == "legacy_failure", legacy_step_idx)
    )
    limit_raw = F.when(typ("limit").isin(*intlike), F.col("d_limit").cast("bigint")).when(
        typ("limit").startswith("DECIMAL") | (typ("limit") == "DOUBLE"), F.col("d_limit").cast("bigint")
    )
    details = F.when(typ("details").startswith("OBJECT"), F.col("j_details"))
    out = s3.select(
        "run_id",
        "seq",
        *carry,
        k.alias("kind"),
        step_idx.cast("int").alias("step_index"),
        _step_map(step_idx, 0, 1).alias("step_id"),
        _step_map(step_idx, 0, 2).alias("step_label"),
        F.when(k.isin("progress", "failure"), get("substep_id")).alias("substep_id"),
        F.when(k.isin("progress", "failure"), get("substep_label")).alias("substep_label"),
        F.when(k == "failure", get("failure_code"))
        .when(k == "legacy_failure", F.col("__legacy_code"))
        .when((k == "run_finished") & nonempty_str("failure_code"), get("failure_code"))
        .alias("failure_code"),
        F.when(k.isin("failure", "legacy_failure"), get("message"))
        .when((k == "run_finished") & (typ("message") == "STRING"), get("message"))
        .alias("message"),
        F.when(k.isin("failure", "legacy_failure"), limit_raw).alias("failure_limit"),
        F.when(k.isin("failure", "legacy_failure"), details).alias("failure_details"),
        F.when(k == "run_finished", get("status")).alias("status"),
        F.when(k == "run_finished", F.col("i_exit_code")).alias("exit_code"),
    )
    return out


def accepted(events: DataFrame) -> DataFrame:
    return events.where(~F.col("kind").isin("rejected", "ignored"))


def rejected(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "rejected")


def infer_step(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """Step index from free log text (fallback); 'Step 2.4' is tested before 'Step 2'."""
    t = F.col(text_col)
    idx = (
        F.when(t.contains("Step 2.4"), 3)
        .when(t.contains("Step 0"), 0)
        .when(t.contains("Step 1"), 1)
        .when(t.contains("Step 2"), 2)
        .when(t.contains("Step 3"), 4)
        .when(t.contains("Step 4"), 5)
    )
    return lines.withColumn("inferred_step_index", idx)


# ---------------------------------------------------------------------------
# Batch replay as grouped aggregates
# ---------------------------------------------------------------------------

STATUS_COLUMNS = [
    "run_id", "status", "step_id", "step_index", "step_label", "substep_id", "substep_label", "step", "exit_code",
    "failure_code", "failure_message", "failure_limit", "failure_details", "failure_step_id", "failure_step_index", "last_seq",
]


def replay_status(events: DataFrame) -> DataFrame:
    """P9 (+P8): final status of each run from all its events, as one grouped aggregate.

    Every field is a ``max_by`` over the events that set it (ordered by seq), so
    the aggregate is map-side combined: a run with a huge log is never sorted
    in one task. A run_finished carrying a step takes it only when it precedes
    every step event of the run.
    """
    # No row filter before the aggregate: a filter on ``kind`` would be pushed
    # below the parse projection and repeat the parse; every aggregate below is
    # already conditioned on the kind, and runs without accepted lines are
    # dropped after the aggregate.
    e = events.select(
        "run_id", "seq", "kind", "step_index", "substep_id", "substep_label", "failure_code", "message",
        "failure_limit", "failure_details", "status", "exit_code",
    )
    k = F.col("kind")
    ok = ~k.isin("rejected", "ignored")
    is_step = k.isin("progress", "legacy_step")
    fin = k == "run_finished"
    fail = k.isin("failure", "legacy_failure")
    seq = F.col("seq")
    sets_code = fail | (fin & F.col("failure_code").isNotNull())
    sets_msg = fail | (fin & F.col("message").isNotNull())
    sets_fstep = (fail | fin) & F.col("step_index").isNotNull()
    g = e.groupBy("run_id").agg(
        F.min(F.when(is_step, seq)).alias("__fs"),
        F.min_by(F.struct(seq.alias("seq"), F.col("step_index").alias("idx")), F.when(fin & F.col("step_index").isNotNull(), seq)).alias("__rf"),
        F.max(F.when(is_step, F.col("step_index"))).alias("__max_step"),
        # (step_index, seq) packed into one long: step indexes are < 64, seq < 2^56
        F.max_by(F.struct("substep_id", "substep_label"), F.when(is_step, F.shiftleft(F.col("step_index").cast("long"), 56) + seq)).alias("__sub"),
        F.max_by(F.struct("status", "exit_code"), F.when(fin, seq)).alias("__fin"),
        F.max_by(F.col("failure_code"), F.when(sets_code, seq)).alias("failure_code"),
        F.max_by(F.col("message"), F.when(sets_msg, seq)).alias("failure_message"),
        F.max_by(F.struct("failure_limit", "failure_details"), F.when(fail, seq)).alias("__f"),
        F.max_by(F.col("step_index"), F.when(sets_fstep, seq)).alias("failure_step_index"),
        F.bool_or(is_step | fail).alias("__active"),
        F.max(F.when(ok, seq)).alias("last_seq"),
    ).where(F.col("last_seq").isNotNull())
    rf_ok = F.col("__rf.seq").isNotNull() & (F.col("__fs").isNull() | (F.col("__rf.seq") < F.col("__fs")))
    rf_wins = rf_ok & (F.col("__max_step").isNull() | (F.col("__rf.idx") > F.col("__max_step")))
    step_index = F.when(rf_wins, F.col("__rf.idx")).otherwise(F.col("__max_step"))
    fin_status = F.when(F.col("__fin").isNotNull(), F.col("__fin.status"))
    status = F.coalesce(fin_status, F.when(F.col("__active") | rf_ok, F.lit("running")), F.lit("starting"))
    s1 = g.select(
        "run_id",
        status.alias("status"),
        step_index.cast("int").alias("step_index"),
        F.when(rf_wins, F.lit(None)).otherwise(F.col("__sub.substep_id")).alias("substep_id"),
        F.when(rf_wins, F.lit(None)).otherwise(F.col("__sub.substep_label")).alias("substep_label"),
        F.col("__fin.exit_code").alias("exit_code"),
        "failure_code",
        "failure_message",
        F.col("__f.failure_limit").alias("failure_limit"),
        F.col("__f.failure_details").alias("failure_details"),
        F.col("failure_step_index").cast("int").alias("failure_step_index"),
        "last_seq",
    )
    return s1.select(
        "run_id",
        "status",
        _step_map(F.col("step_index"), 0, 1).alias("step_id"),
        "step_index",
        _step_map(F.col("step_index"), 0, 2).alias("step_label"),
        "substep_id",
        "substep_label",
        _step_map(F.col("step_index"), 0, 3).alias("step"),
        "exit_code",
        "failure_code",
        "failure_message",
        "failure_limit",
        "failure_details",
        _step_map(F.col("failure_step_index"), 0, 1).alias("failure_step_id"),
        "failure_step_index",
        "last_seq",
    )


def stale_runs(status: DataFrame, now_col: Column, updated_col: str = "updated_at", seconds: int = 300) -> DataFrame:
    """Runs still starting/running with no update for ``seconds``: STARTUP_FAILED or BATCH_JOB_LOST."""
    stale = F.col("status").isin("starting", "running") & (
        F.unix_timestamp(now_col) - F.unix_timestamp(F.col(updated_col)) > seconds
    )
    return status.where(stale).select(
        "run_id",
        F.when(F.col("status") == "starting", F.lit("STARTUP_FAILED")).otherwise(F.lit("BATCH_JOB_LOST")).alias("failure_code"),
    )


# ---------------------------------------------------------------------------
# Streaming projection with per-run state
# ---------------------------------------------------------------------------

OUT_FIELDS = [
    ("status", T.StringType()), ("step_index", T.IntegerType()), ("substep_id", T.StringType()), ("substep_label", T.StringType()),
    ("exit_code", T.LongType()), ("failure_code", T.StringType()), ("failure_message", T.StringType()),
    ("failure_limit", T.LongType()), ("failure_details", T.StringType()), ("failure_step_index", T.IntegerType()),
    ("last_seq", T.LongType()),
]
#: What the state keeps of a run: each value with the seq (or order) of the event that set it, so late events fall into place.
STATE_FIELDS = [
    ("first_step_seq", T.LongType()), ("max_step", T.IntegerType()), ("active", T.BooleanType()), ("last_seq", T.LongType()),
    ("sub_order", T.LongType()), ("substep_id", T.StringType()), ("substep_label", T.StringType()),
    ("rf_seq", T.LongType()), ("rf_step", T.IntegerType()),
    ("fin_seq", T.LongType()), ("fin_status", T.StringType()), ("exit_code", T.LongType()),
    ("code_seq", T.LongType()), ("failure_code", T.StringType()),
    ("msg_seq", T.LongType()), ("failure_message", T.StringType()),
    ("f_seq", T.LongType()), ("failure_limit", T.LongType()), ("failure_details", T.StringType()),
    ("fstep_seq", T.LongType()), ("failure_step_index", T.IntegerType()),
    ("lost", T.BooleanType()), ("at_ms", T.LongType()),
]
STATE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in STATE_FIELDS])
STREAM_OUT_SCHEMA = T.StructType(
    [T.StructField("run_id", T.StringType())] + [T.StructField(n, t) for n, t in OUT_FIELDS] + [T.StructField("advanced", T.BooleanType())]
)
STALE_SECONDS, FINISHED_SECONDS = 300, 3600
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _none(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and pd.isna(x)) else x


def _latest(state: dict, seq_name: str, order: int, values: dict, first: bool = False) -> None:
    """Take ``values`` from an event if its order is the highest (or lowest) so far; of equals the first stays."""
    old = state.get(seq_name)
    if old is None or (order < old if first else order > old):
        state[seq_name] = order
        state.update(values)


def _int(x) -> int | None:
    return None if (x := _none(x)) is None else int(x)


def apply_event(state: dict, row: dict) -> None:
    """Merge one event (what it lacks is null) into a run's state; events may come in any order."""
    kind = row["kind"]
    if kind in ("rejected", "ignored"):
        return
    seq, step = int(row["seq"]), _int(row.get("step_index"))
    is_step, fin, fail = kind in ("progress", "legacy_step"), kind == "run_finished", kind in ("failure", "legacy_failure")
    if is_step:
        _latest(state, "first_step_seq", seq, {}, first=True)
        at = step or 0
        if state.get("max_step") is None or at > state["max_step"]:
            state["max_step"] = at
        _latest(state, "sub_order", at * 2**56 + seq, {"substep_id": _none(row.get("substep_id")), "substep_label": _none(row.get("substep_label"))})
    if fin:
        if step is not None:
            _latest(state, "rf_seq", seq, {"rf_step": step}, first=True)
        _latest(state, "fin_seq", seq, {"fin_status": _none(row.get("status")), "exit_code": _int(row.get("exit_code"))})
    if fail or fin:
        code, message = _none(row.get("failure_code")), _none(row.get("message"))
        if fail or code is not None:
            _latest(state, "code_seq", seq, {"failure_code": code})
        if fail or message is not None:
            _latest(state, "msg_seq", seq, {"failure_message": message})
        if fail:
            _latest(state, "f_seq", seq, {"failure_limit": _int(row.get("failure_limit")), "failure_details": _none(row.get("failure_details"))})
        if step is not None:
            _latest(state, "fstep_seq", seq, {"failure_step_index": step})
    state["active"] = bool(state.get("active")) or is_step or fail
    if state.get("last_seq") is None or seq > state["last_seq"]:
        state["last_seq"] = seq


def apply_events(state: dict, rows: pd.DataFrame) -> dict:
    """Merge a portion of events into a run's state."""
    for row in rows.to_dict("records"):
        apply_event(state, row)
    return state


def project_state(state: dict) -> dict:
    """The status row of a state, by the same rules as ``replay_status``."""
    rf_ok = state.get("rf_seq") is not None and (state.get("first_step_seq") is None or state["rf_seq"] < state["first_step_seq"])
    rf_wins = rf_ok and (state.get("max_step") is None or state["rf_step"] > state["max_step"])
    out = {name: state.get(name) for name, _ in OUT_FIELDS}
    out["step_index"] = state["rf_step"] if rf_wins else state.get("max_step")
    if rf_wins:
        out["substep_id"] = out["substep_label"] = None
    out["status"] = state.get("fin_status") or ("running" if state.get("active") or rf_ok else "starting")
    if state.get("lost") and state.get("fin_status") is None:
        out["failure_code"] = "STARTUP_FAILED" if out["status"] == "starting" else "BATCH_JOB_LOST"
        out["status"] = "failed"
    return out


def _row(run_id: str, state: dict, before: int | None) -> Row:
    out = project_state(state)
    after = out["step_index"]
    advanced = after is not None and (before is None or after > before)
    return Row(run_id=run_id, **out, advanced=advanced)


class RunStatus(StatefulProcessor):
    """P3 + P7: one struct of fields per run, read and written once a batch, and one event timer per run.

    A run's fields are few whatever the length of its log, and its events pass
    by one at a time, so a run costs two calls of the state store and a loop
    over its rows. The timer of a run that has not finished stands
    ``STALE_SECONDS`` after its last news and reports it lost; that of a
    finished or lost run ends its state ``FINISHED_SECONDS`` after.
    """

    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle) -> None:
        self.handle = handle
        self.fields = handle.getValueState("fields", STATE_SCHEMA)

    def _held(self) -> dict:
        held = self.fields.get()
        return {} if held is None else {n: v for (n, _), v in zip(STATE_FIELDS, held, strict=True) if v is not None}

    def _write(self, held: dict, new: dict) -> None:
        if new != held:
            self.fields.update(tuple(new.get(n) for n, _ in STATE_FIELDS))

    def _arm(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        new = dict(held)
        before = project_state(held)["step_index"] if held else None
        last = new.get("at_ms") or 0
        for row in rows:
            event = json.loads(row["event"])
            apply_event(new, event)
            if self.timers:
                last = max(last, event["at_ms"])
        if self.timers:
            new["at_ms"], new["lost"] = last, False  # it speaks again
            self._arm(last + 1000 * (STALE_SECONDS if new.get("fin_status") is None else FINISHED_SECONDS))
        self._write(held, new)
        yield _row(key[0], new, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if held.get("fin_status") is not None or held.get("lost"):
            self.fields.clear()
            return
        self._write(held, {**held, "lost": True})
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + FINISHED_SECONDS * 1000)
        yield _row(key[0], {**held, "lost": True}, project_state(held)["step_index"])


def project_status_stream(events: DataFrame, timers: bool = True) -> DataFrame:
    """P3 + P4 + P7: per-run state over a stream of parsed events (output mode 'update').

    Late and repeated events give what the batch replay of all events gives.
    ``advanced`` is true when the step index rose in that micro-batch (P4).

    With ``timers`` the events carry ``at`` (``parse_events(lines, ("at",))``),
    a timestamp with a watermark, such as the time they were read. A run
    without news for ``STALE_SECONDS`` of that time is reported failed, with
    STARTUP_FAILED or BATCH_JOB_LOST; the state of finished and lost runs ends
    ``FINISHED_SECONDS`` later. Timers fire as the watermark passes them, so
    Spark runs a batch without data only when the watermark moved. Without
    ``timers`` lost runs are left to ``stale_runs`` and all state is kept.

    State lives in RocksDB, outside the heap of the executors: set
    ``spark.sql.streaming.stateStore.providerClass`` to ``STATE_STORE``.
    """
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    # rejected and ignored lines are skipped inside the state function: a row
    # filter on ``kind`` here would be pushed below the parse and repeat it
    fields = [
        "seq", "kind", "step_index", "substep_id", "substep_label", "failure_code", "message", "failure_limit", "failure_details",
        "status", "exit_code", *([F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms")] if timers else []),
    ]
    # an event goes to Python as one cell: there every cell of a row is an object of its own
    e = events.select("run_id", F.to_json(F.struct(*fields)).alias("event"), *(["at"] if timers else []))
    return e.groupBy("run_id").transformWithState(
        statefulProcessor=RunStatus(timers), outputStructType=STREAM_OUT_SCHEMA, outputMode="Update", timeMode="EventTime" if timers else "None"
    )


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that ``project_status_stream`` needs, as it was afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def latest_status(updates: DataFrame) -> DataFrame:
    """The last update of each run, of those that a sink has kept with their ``batch``."""
    last = updates.groupBy("run_id").agg(F.max_by(F.struct(*[n for n, _ in OUT_FIELDS]), "batch").alias("s"))
    return last.select("run_id", "s.*")


def step_advances(status_updates: DataFrame) -> DataFrame:
    """The updates of ``project_status_stream`` where a run's step index rose."""
    return status_updates.where(F.col("advanced")).select("run_id", "step_index", "last_seq")


def normalize_status(status: DataFrame) -> DataFrame:
    """Status rows with step id, label and legacy token from the registry."""
    return status.select(
        "*",
        _step_map(F.col("step_index"), 0, 1).alias("step_id"),
        _step_map(F.col("step_index"), 0, 2).alias("step_label"),
        _step_map(F.col("step_index"), 0, 3).alias("step"),
        _step_map(F.col("failure_step_index"), 0, 1).alias("failure_step_id"),
    )
