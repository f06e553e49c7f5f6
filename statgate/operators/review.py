"""Template and node-file review (T1-T13) as joins and aggregations over node triples.

Triples: ``(dataset_id, file, node_line, node, prop, value)`` from
``sources.readers.read_nodes``. Headers: ``(dataset_id, file, ord, name)``.
Every check returns issue rows
``(dataset_id, file, line, type, message, suggestion, severity, source, ord)``
where ``ord`` keeps the reference's reporting order inside a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statgate.functions.scalars import (
    DATE_LITERAL_PATTERN,
    VARIABLE_ID_PATTERN,
    normalize_stat_type,
    normalize_variable,
    strip_blanks,
)

ISSUE_COLUMNS = ["dataset_id", "file", "line", "type", "message", "suggestion", "severity", "source", "ord"]

# Texts, property lists and type sets of the deterministic review.
REQUIRED_OBSERVATION_PROPS = [
    ("variableMeasured", "Add variableMeasured: C:table->columnId or dcs:StatVarDcid."),
    ("observationAbout", "Add observationAbout: C:table->columnId or dcid:PlaceDcid."),
    ("observationDate", "Add observationDate: C:table->columnId or YYYY-MM-DD literal."),
]
STANDARD_OBSERVATION_PROPS = [
    "typeOf", "variableMeasured", "observationAbout", "observationDate", "value", "unit",
    "measurementMethod", "observationPeriod", "scalingFactor",
]
RATE_OF_CHANGE_STAT_TYPES = ["growthrate", "growth_rate", "changerate", "change_rate", "rateofchange", "rate_of_change"]
BLOCKER_TYPES = ["typo", "schema", "unknown_statvar", "duplicate", "required", "namespace"]
SOFT_TYPES = ["naming", "unused_column", "format"]
COLUMN_REF_PATTERN = r"C:[^>]+->(.+)$"
TASK_TRIPLES = 300_000


def _issue(df: DataFrame, file, line, type_, message, suggestion, severity, ord_: Column | None = None, source="deterministic") -> DataFrame:
    def c(x):
        return x if isinstance(x, Column) else F.lit(x)

    return df.select(
        F.col("dataset_id"),
        c(file).cast("string").alias("file"),
        c(line).cast("bigint").alias("line"),
        c(type_).alias("type"),
        c(message).alias("message"),
        c(suggestion).alias("suggestion"),
        c(severity).alias("severity"),
        F.lit(source).alias("source"),
        (ord_ if ord_ is not None else F.lit(0)).cast("bigint").alias("ord"),
    )


def column_refs(nodes: DataFrame) -> DataFrame:
    """Referenced column ids (value after '->' in C:table->column) with first appearance."""
    ref = strip_blanks(F.regexp_extract(F.col("value"), COLUMN_REF_PATTERN, 1))
    return (
        nodes.select("dataset_id", "node_line", ref.alias("ref"))
        .where(F.col("ref") != "")
        .groupBy("dataset_id", "ref")
        .agg(F.min("node_line").alias("first_line"))
    )


def column_refs_missing(nodes: DataFrame, headers: DataFrame) -> DataFrame:
    """Column references not in the CSV header (case-sensitive), first-appearance order, blocker."""
    h = headers.select("dataset_id", strip_blanks(F.col("name")).alias("ref"))
    missing = column_refs(nodes).join(h, ["dataset_id", "ref"], "left_anti")
    return _issue(
        missing,
        None,
        None,
        "schema",
        F.concat(F.lit("Column reference '"), F.col("ref"), F.lit("' does not exist in CSV header (case-sensitive).")),
        "Use a column ID from the header or fix the typo.",
        "blocker",
        F.col("first_line"),
    )


def unused_columns(nodes: DataFrame, headers: DataFrame, cap: int = 10) -> DataFrame:
    """Header columns never referenced; the first ``cap`` as warnings plus one '... and N more' row."""
    refs = column_refs(nodes).select("dataset_id", F.col("ref").alias("name"))
    unused = headers.where(F.col("name").isNotNull() & (F.col("name") != "")).join(refs, ["dataset_id", "name"], "left_anti")
    w = Window.partitionBy("dataset_id").orderBy("ord")  # one row per header column: tiny
    ranked = unused.withColumn("rk", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dataset_id")))
    first = _issue(
        ranked.where(F.col("rk") <= cap),
        None,
        None,
        "unused_column",
        F.concat(F.lit("CSV column '"), F.col("name"), F.lit("' is not referenced in the TMCF (unused column).")),
        "Remove the column from the CSV or add a mapping in the TMCF if it is needed.",
        "warning",
        F.col("rk"),
    )
    more = _issue(
        ranked.where((F.col("rk") == 1) & (F.col("n") > cap)),
        None,
        None,
        "unused_column",
        F.concat(F.lit("… and "), (F.col("n") - cap).cast("string"), F.lit(" more unused CSV columns.")),
        "Ensure all CSV columns are mapped in the TMCF or remove unused columns.",
        "warning",
        F.lit(cap + 1),
    )
    return first.unionByName(more)


def node_props(nodes: DataFrame, props: list[str]) -> DataFrame:
    """Pivot chosen properties to columns, one row per node.

    A repeated property keeps its last value by ``prop_line``; triples without
    positions (unordered tables) keep the greatest.
    """
    n = nodes.where(F.col("prop").isin(*props))
    at = F.col("prop_line") if "prop_line" in nodes.columns else F.col("value")
    aggs = [F.max_by("value", F.when(F.col("prop") == p, at)).alias(p) for p in props]
    return (
        nodes.select("dataset_id", "file", "node_line", "node")
        .distinct()
        .join(n.groupBy("dataset_id", "file", "node_line").agg(*aggs), ["dataset_id", "file", "node_line"], "left")
    )


def missing_observation_props(nodes: DataFrame) -> DataFrame:
    """StatVarObservation nodes missing variableMeasured / observationAbout / observationDate."""
    p = node_props(nodes, ["typeOf"] + [x for x, _ in REQUIRED_OBSERVATION_PROPS])
    obs = p.where(F.lower(F.coalesce(F.col("typeOf"), F.lit(""))).contains("statvarobservation"))
    parts = []
    for i, (prop, suggestion) in enumerate(REQUIRED_OBSERVATION_PROPS):
        bad = obs.where(F.coalesce(strip_blanks(F.col(prop)), F.lit("")) == "")
        parts.append(
            _issue(
                bad,
                F.col("file"),
                F.col("node_line"),
                "missing_required_property",
                f"StatVarObservation node is missing '{prop}'.",
                suggestion,
                "warning",
                F.col("node_line") * 10 + i,
            )
        )
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def value_not_mapped(nodes: DataFrame) -> DataFrame:
    """T4: observation nodes exist but no 'value' maps to a CSV column (one blocker per dataset)."""
    g = nodes.groupBy("dataset_id").agg(
        F.bool_or((F.col("prop") == "typeOf") & (strip_blanks(F.col("value")) == "dcs:StatVarObservation")).alias("has_obs"),
        F.bool_or((F.col("prop") == "value") & F.col("value").rlike(r"^C:[^>]+->")).alias("has_value"),
    )
    return _issue(
        g.where(F.col("has_obs") & ~F.col("has_value")),
        None,
        None,
        "schema",
        "StatVarObservation node(s) found but no 'value' property mapping to a CSV column (e.g. value: C:table->value).",
        "Add a line mapping value to a numeric CSV column.",
        "blocker",
    )


def bad_date_literals(nodes: DataFrame) -> DataFrame:
    """T5: observationDate literals not shaped YYYY, YYYY-MM or YYYY-MM-DD."""
    v = strip_blanks(F.col("value"))
    bad = nodes.where((F.lower(F.col("prop")) == "observationdate") & ~v.startswith("C:") & ~v.rlike(DATE_LITERAL_PATTERN))
    return _issue(
        bad.withColumn("v", v),
        F.col("file"),
        F.col("node_line"),
        "format",
        F.concat(F.lit("observationDate literal '"), F.col("v"), F.lit("' does not match ISO 8601 (use YYYY, YYYY-MM, or YYYY-MM-DD).")),
        "Use a date in YYYY, YYYY-MM, or YYYY-MM-DD format.",
        "warning",
        F.col("node_line"),
    )


def generated_variables(nodes: DataFrame, csv: DataFrame | None = None) -> DataFrame:
    """Distinct normalized variable ids from variableMeasured literals and mapped CSV columns."""
    vm = nodes.where(F.col("prop") == "variableMeasured").select("dataset_id", strip_blanks(F.col("value")).alias("v"))
    lits = vm.where(~F.col("v").startswith("C:")).select("dataset_id", normalize_variable(F.col("v")).alias("variable"))
    out = lits
    if csv is not None:
        cols = (
            vm.where(F.col("v").startswith("C:") & F.col("v").contains("->"))
            .select("dataset_id", F.regexp_extract(F.col("v"), r"->\s*([^\s#]+)", 1).alias("col"))
            .distinct()
        )
        # the referenced columns are few: turn the CSV into (dataset_id, column, value) for them only
        names = [c for c in csv.columns if c not in ("__file", "__row", "dataset_id")]
        long = csv.select(
            "dataset_id",
            F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("val")) for c in names])).alias("kv"),
        ).select("dataset_id", F.col("kv.col").alias("col"), strip_blanks(F.col("kv.val")).alias("val"))
        vals = long.join(F.broadcast(cols), ["dataset_id", "col"]).where(F.col("val") != "")  # referenced-column list: tiny
        out = out.unionByName(vals.select("dataset_id", normalize_variable(F.col("val")).alias("variable")))
    return out.where(F.col("variable") != "").distinct()


def bad_variable_ids(variables: DataFrame) -> DataFrame:
    """Generated ids not matching the variable id format."""
    bad = variables.where(~F.col("variable").rlike(VARIABLE_ID_PATTERN))
    return _issue(
        bad,
        None,
        None,
        "format",
        F.concat(
            F.lit("StatVar DCID '"),
            F.col("variable"),
            F.lit("' does not match required format (UpperCamelCase segments separated by underscores; decimals like 1.38 allowed)."),
        ),
        "Use letters, numbers, underscores; each segment starts with uppercase letter or digit; decimal points only in numeric portions (e.g. Count_Person, 1.38OrLessRatioToPovertyLine).",
        "warning",
        F.lit(0),
    )


def missing_variable_props(nodes: DataFrame) -> DataFrame:
    """StatisticalVariable nodes without populationType or measuredProperty."""
    p = node_props(nodes, ["typeOf", "populationType", "measuredProperty"])
    sv = p.where(F.lower(strip_blanks(F.coalesce(F.col("typeOf"), F.lit("")))).contains("statisticalvariable"))
    parts = []
    for i, (prop, example) in enumerate((("populationType", "dcs:Person"), ("measuredProperty", "dcs:count"))):
        bad = sv.where(F.coalesce(strip_blanks(F.col(prop)), F.lit("")) == "")
        parts.append(
            _issue(
                bad,
                F.col("file"),
                F.col("node_line"),
                "mcf_required",
                f"Missing or empty '{prop}' for StatVar node.",
                f"Add a non-empty {prop}: (e.g. {example}).",
                "warning",
                F.col("node_line") * 10 + i,
            )
        )
    return parts[0].unionByName(parts[1])


def missing_denominator(nodes: DataFrame) -> DataFrame:
    """percent/rate variables (not rate-of-change) without measurementDenominator."""
    p = node_props(nodes, ["unit", "statType", "measuredProperty", "measurementDenominator"])
    unit = F.lower(F.coalesce(strip_blanks(F.col("unit")), F.lit("")))
    st = F.lower(F.coalesce(strip_blanks(F.col("statType")), F.lit("")))
    mp = F.lower(F.coalesce(strip_blanks(F.col("measuredProperty")), F.lit("")))
    pct_or_rate = unit.contains("percent") | st.contains("rate") | mp.contains("rate")
    roc = normalize_stat_type(F.coalesce(F.col("statType"), F.lit(""))).isin(*RATE_OF_CHANGE_STAT_TYPES)
    no_den = F.coalesce(strip_blanks(F.col("measurementDenominator")), F.lit("")) == ""
    bad = p.where(pct_or_rate & ~roc & no_den)
    dcid = F.when(F.coalesce(F.col("node"), F.lit("")) != "", normalize_variable(F.col("node"))).otherwise(
        F.concat(F.lit("line "), F.col("node_line").cast("string"))
    )
    return _issue(
        bad,
        F.col("file"),
        F.col("node_line"),
        "missing_measurement_denominator",
        F.concat(F.lit("Consider adding measurementDenominator for percent/rate StatVar '"), dcid, F.lit("' to improve semantic clarity.")),
        "Optionally add measurementDenominator: (e.g. dcs:Count_Person) when modeling percent or rate variables.",
        "warning",
        F.col("node_line"),
    )


def undefined_variables(variables: DataFrame, nodes: DataFrame) -> DataFrame:
    """Generated variables with no defining node in the node files."""
    defined = nodes.select("dataset_id", normalize_variable(F.col("node")).alias("variable")).distinct()
    missing = variables.join(defined, ["dataset_id", "variable"], "left_anti")
    return _issue(
        missing,
        None,
        None,
        "unknown_statvar",
        F.concat(F.lit("StatVar '"), F.col("variable"), F.lit("' is not defined in the provided node files.")),
        "Add a StatisticalVariable node for it or fix the id.",
        "blocker",
    )


def structural_node_lint(nodes: DataFrame) -> DataFrame:
    """Duplicate single-valued property, missing/duplicate typeOf, non-standard property on
    observation nodes, schema type without the dcs: prefix.

    Triples are counted and dealt out by their node first, ``TASK_TRIPLES`` a
    task: nearly every triple is a group of its own, so an aggregate would keep
    what its task reads in memory, be that a scan or partitions put together
    by their compressed size.
    """
    nodes = nodes.repartition(max(1, -(-nodes.count() // TASK_TRIPLES)), "dataset_id", "file", "node_line")
    per = nodes.groupBy("dataset_id", "file", "node_line", "node", "prop").agg(F.count(F.lit(1)).alias("n"))
    node_info = per.groupBy("dataset_id", "file", "node_line", "node").agg(
        F.coalesce(F.sum(F.when(F.col("prop") == "typeOf", F.col("n"))), F.lit(0)).alias("n_type")
    )
    types = nodes.where(F.col("prop") == "typeOf").groupBy("dataset_id", "file", "node_line").agg(
        F.bool_or(F.lower(F.col("value")).contains("statvarobservation")).alias("is_obs"),
        F.bool_or(F.col("value").rlike(r"^\s*StatVarObservation\s*$")).alias("no_prefix"),
    )
    dup = _issue(
        per.where((F.col("n") > 1) & (F.col("prop") != "typeOf")),
        F.col("file"), F.col("node_line"), "duplicate",
        F.concat(F.lit("Property '"), F.col("prop"), F.lit("' appears "), F.col("n").cast("string"), F.lit(" times in node.")),
        "Keep a single value for each single-valued property.", "blocker", F.col("node_line"),
    )
    missing_type = _issue(
        node_info.where(F.col("n_type") == 0),
        F.col("file"), F.col("node_line"), "schema", "Node has no typeOf.", "Add exactly one typeOf.", "blocker", F.col("node_line"),
    )
    dup_type = _issue(
        node_info.where(F.col("n_type") > 1),
        F.col("file"), F.col("node_line"), "schema", "Node has more than one typeOf.", "Keep exactly one typeOf.", "blocker", F.col("node_line"),
    )
    nonstd = _issue(
        nodes.join(types.where("is_obs"), ["dataset_id", "file", "node_line"]).where(~F.col("prop").isin(*STANDARD_OBSERVATION_PROPS)),
        F.col("file"), F.col("node_line"), "naming",
        F.concat(F.lit("Non-standard property '"), F.col("prop"), F.lit("' on StatVarObservation node.")),
        "Use one of the standard observation properties.", "warning", F.col("node_line"),
    )
    prefix = _issue(
        types.where("no_prefix"),
        F.col("file"), F.col("node_line"), "namespace", "typeOf StatVarObservation lacks the dcs: prefix.",
        "Write typeOf: dcs:StatVarObservation.", "blocker", F.col("node_line"),
    )
    return dup.unionByName(missing_type).unionByName(dup_type).unionByName(nonstd).unionByName(prefix)


def normalize_severity(issues: DataFrame) -> DataFrame:
    """Blocker for schema-breaking types; soft types keep blocker/warning else warning."""
    sev = F.col("severity")
    valid = sev.isin("blocker", "warning")
    new = F.when(F.col("type").isin(*BLOCKER_TYPES), F.lit("blocker")).when(valid, sev).otherwise(F.lit("warning"))
    return issues.withColumn("severity", new)


def merge_issues(primary: DataFrame, secondary: DataFrame, cap: int = 25) -> DataFrame:
    """Primary issues whole; secondary cut so the total is at most ``cap``; then dedupe by
    (type, whitespace-collapsed message, file) keeping the first; order kept in ``ord``.

    Both steps are skew-safe: the cut keeps the first ``cap`` secondary issues
    per dataset with ``smallest_k`` (bounded pre-selection per partition), and
    the dedupe is a grouped ``min`` over (group, ord, line) — map-side
    combined, so a message repeated for millions of nodes is never one task.
    """
    from statgate.operators.quality import smallest_k

    p = primary.withColumn("grp", F.lit(0))
    n_primary = primary.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("np"))
    sec = secondary.withColumn("__o", F.struct(F.col("ord"), F.coalesce(F.col("file"), F.lit("")), F.col("message")))
    s = (
        smallest_k(sec, ["dataset_id"], "__o", cap)
        .join(n_primary, "dataset_id", "left")
        .where(F.col("rank") <= F.greatest(F.lit(0), F.lit(cap) - F.coalesce(F.col("np"), F.lit(0))))
        .drop("rank", "np", "__o")
        .withColumn("grp", F.lit(1))
    )
    both = p.unionByName(s)
    cols = [c for c in both.columns if c not in ("grp", "ord", "line")]
    first = both.groupBy(
        "dataset_id",
        F.col("type").alias("__t"),
        F.regexp_replace(strip_blanks(F.col("message")), r"\s+", " ").alias("__m"),
        F.coalesce(F.col("file"), F.lit("")).alias("__f"),
    ).agg(F.min(F.struct("grp", "ord", "line", *[c for c in cols if c != "dataset_id"])).alias("__r"))
    return first.select("dataset_id", *[F.col(f"__r.{c}").alias(c) for c in ["grp", "ord", "line"] + [c for c in cols if c != "dataset_id"]])


def review_all(nodes: DataFrame, headers: DataFrame, csv: DataFrame | None = None) -> DataFrame:
    """All deterministic checks (T1-T9, T12, T13) as one issue table, severities normalized."""
    variables = generated_variables(nodes, csv)
    parts = [
        column_refs_missing(nodes, headers),
        unused_columns(nodes, headers),
        missing_observation_props(nodes),
        value_not_mapped(nodes),
        bad_date_literals(nodes),
        bad_variable_ids(variables),
        missing_variable_props(nodes),
        missing_denominator(nodes),
        undefined_variables(variables, nodes),
        structural_node_lint(nodes),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return normalize_severity(out)
