"""Observation-shaped views over the driver's TPC-H-like tables.

The reference validates observation CSVs; the driver only ships parquet
tables. These views turn those tables into the shapes the operators consume
(observations, raw CSV-like string tables, lint report tables, node triples,
run-event lines, object listings). Each view has a DuckDB twin in
``DUCKDB_VIEWS`` so the oracle SQL can inline exactly the same definition.

All work here is a projection or a grouped aggregate over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statgate.sources.readers import with_row_index

OBS_COLUMNS = [
    "dataset_id",
    "observationAbout",
    "observationDate",
    "variableMeasured",
    "value",
    "unit",
    "measurementMethod",
    "observationPeriod",
    "scalingFactor",
    "__file",
    "__row",
]

LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables (a file or a folder of files), with its name as ``__src``.

    The name is read off each row's file path, as dataset ids are in a listing
    of many datasets, so joins on it are planned as they would be for many.
    Where the caller sets ``statgate.scanPartitions`` the scan is dealt out to
    so many tasks; the tests and the benchmark do, as a file of one row group
    is one task. Without the setting the scan's own splits stay.
    """
    path = F.col("_metadata.file_path")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").withColumn("__src", F.substring_index(F.substring_index(path, ".parquet", 1), "/", -1))
    tasks = spark.conf.get("statgate.scanPartitions", None)
    if not tasks:
        return df
    # dealt by a hash of the row: without a key Spark would sort the rows first, and row numbers are no function of the row
    return df.repartition(int(tasks), F.xxhash64(*[c for c in df.columns if c != "__src"]))


def _cap_first(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> one observation per event (a raw, un-aggregated observation CSV)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("__src").alias("dataset_id"),
        F.concat(F.lit("dcid:user/"), F.col("user_id").cast("string")).alias("observationAbout"),
        F.date_format("ts", "yyyy-MM-dd").alias("observationDate"),
        F.concat(F.lit("dcid:Value_Event_"), _cap_first(F.col("event_type"))).alias("variableMeasured"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
        F.when(F.col("event_type") == "purchase", F.lit("USDollar")).otherwise(F.lit("")).alias("unit"),
        F.lit("").alias("measurementMethod"),
        F.lit("P1D").alias("observationPeriod"),
        F.lit("").alias("scalingFactor"),
        F.concat(F.col("__src"), F.lit(".csv")).alias("__file"),
        (F.col("event_id") + 2).alias("__row"),
    )


def obs_orders(spark: SparkSession, sf_dir: str, version: str | None = None) -> DataFrame:
    """orders x customer x nation -> monthly order counts per (nation, priority).

    ``version`` selects the baseline ('baseline': keys with o_orderkey % 10 <> 1)
    or the current snapshot ('current': o_orderkey % 10 <> 0) used by the diff.
    """
    o = table(spark, sf_dir, "orders").select("__src", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if version == "current":
        o = o.where(F.col("o_orderkey") % 10 != 0)
    elif version == "baseline":
        o = o.where(F.col("o_orderkey") % 10 != 1)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # customer and nation are dimension tables; Catalyst/AQE broadcast them only
    # when their measured size is under the broadcast threshold.
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    g = j.groupBy(
        F.col("__src"),
        F.col("n_name"),
        F.col("o_orderpriority"),
        F.date_format("o_orderdate", "yyyy-MM").alias("observationDate"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return g.select(
        F.col("__src").alias("dataset_id"),
        F.concat(F.lit("dcid:nation/"), F.col("n_name")).alias("observationAbout"),
        F.col("observationDate"),
        F.concat(F.lit("dcid:Count_Order_"), F.translate("o_orderpriority", "- ", "")).alias("variableMeasured"),
        F.col("n").cast("string").alias("value"),
        F.lit("").alias("unit"),
        F.lit("").alias("measurementMethod"),
        F.lit("P1M").alias("observationPeriod"),
        F.lit("").alias("scalingFactor"),
        F.concat(F.col("__src"), F.lit(".csv")).alias("__file"),
        F.lit(None).cast("bigint").alias("__row"),
    )


#: observationPeriod of the varied orders, by the last letter of the variable: months, days, none (the median gap), as it is
VARIED_PERIODS = {"T": "P3M", "H": "P30D", "M": "", "W": "P1M"}


def obs_orders_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_orders with other periods, a change of unit and scale, and placeholders of zero or less, so every signal occurs.

    A series lacks the months that are divisible by 3 in even years, reports
    in another unit in odd months, and by nation starts from 0 or -1.
    """
    o = obs_orders(spark, sf_dir)
    month, year = F.substring("observationDate", 6, 2).cast("int"), F.substring("observationDate", 1, 4).cast("int")
    last = F.upper(F.substring("variableMeasured", -1, 1))
    period = F.coalesce(*[F.when(last == k, F.lit(v)) for k, v in VARIED_PERIODS.items()], F.col("observationPeriod"))
    odd = month % 2 == 1
    by_nation = F.length("observationAbout") % 3
    value = F.when(odd & (by_nation == 1), F.lit("0")).when(~odd & (by_nation == 2), F.lit("-1")).otherwise(F.col("value"))
    return o.where(~((month % 3 == 0) & (year % 2 == 0))).withColumns(
        {
            "observationPeriod": period, "value": value, "unit": F.when(odd, F.lit("Thousand")).otherwise(F.lit("One")),
            "scalingFactor": F.when(odd, F.lit("1000")).otherwise(F.lit("1")),
        }
    )


def success_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success counters of a run per event type, each another dataset: right, one off, no number, missing, twice."""
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"))
    told = F.when(F.col("dataset_id") == "purchase", F.col("n").cast("string")).when(F.col("dataset_id") == "click", (F.col("n") + 1).cast("string"))
    told = told.when(F.col("dataset_id") == "view", F.lit("n/a")).when(F.col("dataset_id") == "signup", F.col("n").cast("string"))
    listed = [
        ("LEVEL_INFO", "NumNodeSuccesses", told), ("LEVEL_INFO", "NumRowSuccesses", F.col("n").cast("string")),
        ("LEVEL_WARNING", "NumRowSuccesses", F.lit("7")), ("LEVEL_INFO", "NumPVSuccesses", F.lit("x")), ("LEVEL_INFO", "NumOther", F.lit("1")),
    ]
    rows = F.array(*[F.struct(F.lit(a).alias("level"), F.lit(k).alias("counterKey"), c.alias("count")) for a, k, c in listed])
    return n.select("dataset_id", F.inline(rows)).where("count IS NOT NULL")


def csv_lineitem(spark: SparkSession, sf_dir: str, numbered: bool = True, flawed: bool = False) -> DataFrame:
    """lineitem as a raw CSV: every cell a string, file order = sort by all columns.

    ``numbered`` records carry their number, from counts per range of order
    keys and the position inside a range (``with_row_index``), never from a
    single-partition window; others carry their place in the order as
    ``__order``. ``flawed`` repeats the records of some orders and adds a
    column that is blank in every record.
    """
    li = table(spark, sf_dir, "lineitem").select("__src", *LINEITEM_COLUMNS)
    if flawed:
        times = F.when(F.col("l_orderkey") % 997 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        li = li.withColumn("__time", F.explode(times)).drop("__time")
    cells = [F.col(c).cast("string").alias(c) for c in LINEITEM_COLUMNS] + ([F.lit(" ").alias("no_value")] if flawed else [])
    if numbered:
        li, place = with_row_index(li, LINEITEM_COLUMNS, F.floor(F.col("l_orderkey") / 1024), start=2), F.col("__row")
    else:
        place = F.struct(*LINEITEM_COLUMNS).alias("__order")
    return li.select(F.col("__src").alias("dataset_id"), F.concat(F.col("__src"), F.lit(".csv")).alias("__file"), place, *cells)


DOCUMENT_COLUMNS = ["text", "lang", "source", "n_chars"]


def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a raw CSV of all columns but the id, which is the record number less 2."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("__src").alias("dataset_id"),
        F.concat(F.col("__src"), F.lit(".csv")).alias("__file"),
        (F.col("doc_id") + 2).alias("__row"),
        *[F.col(c).cast("string").alias(c) for c in DOCUMENT_COLUMNS],
    )


def csv_header(df: DataFrame, dataset_id: str, file: str, columns: list[str]) -> DataFrame:
    """Header table (dataset_id, file, ord, name) of a raw CSV-like frame."""
    spark = df.sparkSession
    rows = [(dataset_id, file, i + 1, c) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "dataset_id string, file string, ord int, name string")


def lint_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> lint report entries (level, counterKey, userMessage, location)."""
    e = table(spark, sf_dir, "events")
    level = (
        F.when(F.col("event_id") % 3 == 0, "LEVEL_ERROR")
        .when(F.col("event_id") % 3 == 1, "LEVEL_WARNING")
        .otherwise("LEVEL_INFO")
    )
    key = (
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("Existence_FailedDcCall_"), F.col("event_type")))
        .when(F.col("user_id") % 5 == 1, F.concat(F.lit("Resolution_MissingRef_"), F.col("event_type")))
        .otherwise(F.concat(F.lit("CSV_"), _cap_first(F.col("event_type"))))
    )
    return e.select(
        F.col("__src").alias("dataset_id"),
        level.alias("level"),
        key.alias("counterKey"),
        F.concat(F.lit("Value "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" at "), F.col("props")).alias("userMessage"),
        F.lit("events.csv").alias("file"),
        (F.col("event_id") + 2).cast("string").alias("lineNumber"),
    )


def lint_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter table (level, counterKey, count as text) = the report's levelSummary."""
    return (
        lint_entries(spark, sf_dir)
        .groupBy("dataset_id", "level", "counterKey")
        .agg(F.count(F.lit(1)).cast("string").alias("count"))
    )


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def nodes_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> node triples of a template (small parts) and a variable file (large parts).

    Some properties are left out or malformed by rules on the part key, so
    every review check has findings.
    """
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    is_obs = F.col("p_size") <= 25

    def t(prop, value):
        return F.struct(F.lit(prop).alias("prop"), value.alias("value"))

    obs_props = F.array(
        t("typeOf", F.when(k % 29 == 0, F.lit("StatVarObservation")).otherwise(F.lit("dcs:StatVarObservation"))),
        t(
            "variableMeasured",
            F.when(k % 7 == 0, F.lit(None))
            .when(k % 3 == 0, F.lit("C:parts->p_type"))
            .when(k % 9 == 1, F.concat(F.lit("dcs:count part "), F.lower("p_type")))
            .otherwise(F.concat(F.lit("dcs:Count_Part_"), F.col("p_type"))),
        ),
        t("observationAbout", F.when(k % 11 == 0, F.lit(None)).when(k % 5 == 0, F.lit("C:parts->brand")).otherwise(F.lit("C:parts->p_brand"))),
        t(
            "observationDate",
            F.when(k % 13 == 0, F.concat(F.lit("2024/"), F.col("p_size").cast("string")))
            .when(k % 4 == 0, F.lit("2024"))
            .otherwise(F.lit("C:parts->p_size")),
        ),
        t("value", F.when(k % 17 == 0, F.lit(None)).otherwise(F.lit("C:parts->p_retailprice"))),
        t("observationPerod", F.when(k % 31 == 0, F.lit("P1Y"))),
    )
    var_props = F.array(
        t("typeOf", F.when(k % 19 == 0, F.lit(None)).otherwise(F.lit("dcs:StatisticalVariable"))),
        t("populationType", F.when(k % 7 == 0, F.lit(None)).otherwise(F.lit("dcs:Part"))),
        t("populationType", F.when(k % 23 == 0, F.lit("dcs:Thing"))),
        t("measuredProperty", F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("dcs:"), F.lower(F.translate("p_brand", "#", ""))))),
        t(
            "statType",
            F.when(F.col("p_type") == "PROMO", F.lit("dcs:growthRate"))
            .when(F.col("p_type") == "SMALL", F.lit("dcs:incidenceRate"))
            .otherwise(F.lit("dcs:measuredValue")),
        ),
        t("unit", F.when(F.col("p_type") == "LARGE", F.lit("dcs:Percent"))),
        t("measurementDenominator", F.when(k % 2 == 0, F.lit("dcid:Count_Part"))),
        t("name", F.col("p_name")),
    )
    rows = p.select(
        F.concat(F.col("__src"), F.lit("s")).alias("dataset_id"),
        F.when(is_obs, F.lit("parts_output.tmcf")).otherwise(F.lit("parts_stat_vars.mcf")).alias("file"),
        (k * 8 + 1).alias("node_line"),
        F.when(is_obs, F.concat(F.lit("E:parts->E"), k.cast("string")))
        .otherwise(F.concat(F.lit("dcid:Count_Part_"), F.col("p_type"), F.lit("_"), k.cast("string")))
        .alias("node"),
        F.explode(F.when(is_obs, obs_props).otherwise(var_props)).alias("t"),
    )
    return rows.where(F.col("t.value").isNotNull()).select("dataset_id", "file", "node_line", "node", "t.prop", "t.value")


def parts_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the CSV the template maps (string cells)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lit("parts").alias("dataset_id"), *[F.col(c).cast("string").alias(c) for c in PART_COLUMNS])


# Fixed listing names: file name of a page by page_id % 7.
LISTING_NAMES = [
    "data_output.tmcf", "data_output.csv", "data_stat_vars.mcf", "other_output.csv", "notes.csv", "sub/data.csv", "extra_output.tmcf",
]


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> an object listing: folder = URL host, file by page_id % 7, size = html length."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/]+)", 1)
    name = F.element_at(F.array(*[F.lit(n) for n in LISTING_NAMES]), (F.col("page_id") % 7 + 1).cast("int"))
    return p.select(F.concat(F.lit("root/"), host, F.lit("/"), name).alias("path"), F.length("html").cast("bigint").alias("size"))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> run-log envelopes (run_id, seq, line) covering every line kind."""
    from statgate.streaming.run_events import STEPS

    e = table(spark, sf_dir, "events")
    s = (F.col("event_id") % 6).cast("int")
    sid = F.element_at(F.array(*[F.lit(x[1]) for x in STEPS]), s + 1)
    lab = F.element_at(F.array(*[F.lit(x[2]) for x in STEPS]), s + 1)
    tok = F.element_at(F.array(*[F.lit(x[3]) for x in STEPS]), s + 1)
    mark = F.element_at(F.array(*[F.lit(x[4]) for x in STEPS]), s + 1)
    eid = F.col("event_id")
    progress = F.to_json(
        F.struct(
            F.lit(1).alias("v"), F.lit("progress").alias("t"), sid.alias("step_id"), s.alias("step_index"), lab.alias("step_label"),
            F.when(eid % 4 == 0, F.concat(F.lit("sub"), (eid % 3).cast("string"))).alias("substep_id"),
        )
    )

    def failure(step_index):
        return F.to_json(
            F.struct(
                F.lit(1).alias("v"), F.lit("failure").alias("t"), F.concat(F.lit("E"), (eid % 7).cast("string")).alias("failure_code"),
                sid.alias("step_id"), step_index.alias("step_index"), lab.alias("step_label"),
                F.concat(F.lit("failed at "), eid.cast("string")).alias("message"), (eid % 5).alias("limit"),
            )
        )

    status = F.element_at(F.array(F.lit("succeeded"), F.lit("failed"), F.lit("cancelled")), (eid % 3 + 1).cast("int"))
    finished = F.to_json(
        F.struct(
            F.lit(1).alias("v"), F.lit("run_finished").alias("t"), status.alias("status"), (eid % 3).alias("exit_code"),
            F.when(eid % 8 == 0, F.lit(1)).alias("extra"),
        )
    )
    code = F.when(eid % 4 == 0, F.lit("CSV_SPLIT_FAILED")).otherwise(F.concat(F.lit("LEGACY_"), (eid % 4).cast("string")))
    legacy = F.to_json(F.struct(F.lit("failure").alias("t"), code.alias("code"), F.concat(F.lit("legacy "), eid.cast("string")).alias("message"), tok.alias("step")))
    et = F.col("event_type")
    line = (
        F.when((et == "purchase") & (eid % 5 == 0), finished)
        .when(et.isin("view", "purchase"), progress)
        .when(et == "click", mark)
        .when(et == "error", F.when(eid % 10 == 0, failure(s.cast("string"))).otherwise(failure(s)))
        .otherwise(legacy)
    )
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), eid.alias("seq"), line.alias("line"))


# ---------------------------------------------------------------------------
# DuckDB twins (used verbatim inside oracle SQL as CTEs).
# ---------------------------------------------------------------------------

DUCKDB_VIEWS: dict[str, str] = {
    "obs_events": """
SELECT 'events' AS dataset_id,
       'dcid:user/' || CAST(user_id AS VARCHAR) AS observationAbout,
       strftime(ts, '%Y-%m-%d') AS observationDate,
       'dcid:Value_Event_' || upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS variableMeasured,
       CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value,
       CASE WHEN event_type = 'purchase' THEN 'USDollar' ELSE '' END AS unit,
       '' AS measurementMethod, 'P1D' AS observationPeriod, '' AS scalingFactor,
       'events.csv' AS __file, event_id + 2 AS __row
FROM events""",
    "obs_orders": """
SELECT 'orders' AS dataset_id,
       'dcid:nation/' || n_name AS observationAbout,
       strftime(o_orderdate, '%Y-%m') AS observationDate,
       'dcid:Count_Order_' || replace(replace(o_orderpriority, '-', ''), ' ', '') AS variableMeasured,
       CAST(count(*) AS VARCHAR) AS value,
       '' AS unit, '' AS measurementMethod, 'P1M' AS observationPeriod, '' AS scalingFactor,
       'orders.csv' AS __file, CAST(NULL AS BIGINT) AS __row
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
{where}
GROUP BY n_name, o_orderpriority, strftime(o_orderdate, '%Y-%m')""",
    "csv_lineitem": """
SELECT 'lineitem' AS dataset_id, 'lineitem.csv' AS __file,
       1 + row_number() OVER (ORDER BY l_orderkey NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST,
            l_linenumber NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST,
            l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS __row,
       CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
       CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       CAST(l_quantity AS VARCHAR) AS l_quantity, CAST(l_extendedprice AS VARCHAR) AS l_extendedprice,
       CAST(l_discount AS VARCHAR) AS l_discount, CAST(l_tax AS VARCHAR) AS l_tax,
       l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate
FROM lineitem""",
    "csv_lineitem_flawed": """
SELECT 'lineitem' AS dataset_id, 'lineitem.csv' AS __file,
       1 + row_number() OVER (ORDER BY l_orderkey NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST,
            l_linenumber NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST,
            l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS __row,
       CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
       CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       CAST(l_quantity AS VARCHAR) AS l_quantity, CAST(l_extendedprice AS VARCHAR) AS l_extendedprice,
       CAST(l_discount AS VARCHAR) AS l_discount, CAST(l_tax AS VARCHAR) AS l_tax,
       l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate, ' ' AS no_value
FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 997 = 1)""",
    "csv_documents": """
SELECT 'documents' AS dataset_id, 'documents.csv' AS __file, doc_id + 2 AS __row, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "lint_entries": """
SELECT 'events' AS dataset_id,
       CASE WHEN event_id % 3 = 0 THEN 'LEVEL_ERROR' WHEN event_id % 3 = 1 THEN 'LEVEL_WARNING' ELSE 'LEVEL_INFO' END AS level,
       CASE WHEN user_id % 5 = 0 THEN 'Existence_FailedDcCall_' || event_type
            WHEN user_id % 5 = 1 THEN 'Resolution_MissingRef_' || event_type
            ELSE 'CSV_' || upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) END AS counterKey,
       'Value ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' at ' || props AS userMessage,
       'events.csv' AS file, CAST(event_id + 2 AS VARCHAR) AS lineNumber
FROM events""",
    "nodes_parts": """
SELECT 'parts' AS dataset_id, CASE WHEN p_size <= 25 THEN 'parts_output.tmcf' ELSE 'parts_stat_vars.mcf' END AS file,
       p_partkey * 8 + 1 AS node_line,
       CASE WHEN p_size <= 25 THEN 'E:parts->E' || p_partkey ELSE 'dcid:Count_Part_' || p_type || '_' || p_partkey END AS node,
       t.prop AS prop, t.value AS value
FROM part, unnest(CASE WHEN p_size <= 25 THEN [
    {'prop': 'typeOf', 'value': CASE WHEN p_partkey % 29 = 0 THEN 'StatVarObservation' ELSE 'dcs:StatVarObservation' END},
    {'prop': 'variableMeasured', 'value': CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'C:parts->p_type'
         WHEN p_partkey % 9 = 1 THEN 'dcs:count part ' || lower(p_type) ELSE 'dcs:Count_Part_' || p_type END},
    {'prop': 'observationAbout', 'value': CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'C:parts->brand' ELSE 'C:parts->p_brand' END},
    {'prop': 'observationDate', 'value': CASE WHEN p_partkey % 13 = 0 THEN '2024/' || p_size WHEN p_partkey % 4 = 0 THEN '2024' ELSE 'C:parts->p_size' END},
    {'prop': 'value', 'value': CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'C:parts->p_retailprice' END},
    {'prop': 'observationPerod', 'value': CASE WHEN p_partkey % 31 = 0 THEN 'P1Y' END}]
  ELSE [
    {'prop': 'typeOf', 'value': CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'dcs:StatisticalVariable' END},
    {'prop': 'populationType', 'value': CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'dcs:Part' END},
    {'prop': 'populationType', 'value': CASE WHEN p_partkey % 23 = 0 THEN 'dcs:Thing' END},
    {'prop': 'measuredProperty', 'value': CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'dcs:' || lower(replace(p_brand, '#', '')) END},
    {'prop': 'statType', 'value': CASE WHEN p_type = 'PROMO' THEN 'dcs:growthRate' WHEN p_type = 'SMALL' THEN 'dcs:incidenceRate' ELSE 'dcs:measuredValue' END},
    {'prop': 'unit', 'value': CASE WHEN p_type = 'LARGE' THEN 'dcs:Percent' END},
    {'prop': 'measurementDenominator', 'value': CASE WHEN p_partkey % 2 = 0 THEN 'dcid:Count_Part' END},
    {'prop': 'name', 'value': p_name}] END) AS u(t)
WHERE t.value IS NOT NULL""",
    "listing": """
SELECT 'root/' || regexp_extract(url, '://([^/]+)', 1) || '/' ||
       ['data_output.tmcf', 'data_output.csv', 'data_stat_vars.mcf', 'other_output.csv', 'notes.csv', 'sub/data.csv', 'extra_output.tmcf'][page_id % 7 + 1] AS path,
       CAST(length(html) AS BIGINT) AS size FROM pages""",
    "run_events_expected": """
SELECT 'run-' || user_id AS run_id, event_id AS seq,
  CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'rejected' ELSE 'run_finished' END
    WHEN event_type IN ('view', 'purchase') THEN 'progress' WHEN event_type = 'click' THEN 'legacy_step'
    WHEN event_type = 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'rejected' ELSE 'failure' END ELSE 'legacy_failure' END AS kind,
  CAST(CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN NULL
       WHEN event_type IN ('view', 'purchase', 'click') THEN event_id % 6 WHEN event_type = 'error' AND event_id % 10 <> 0 THEN event_id % 6
       WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 6 END END AS INTEGER) AS step_index,
  CASE WHEN (event_type = 'view' OR (event_type = 'purchase' AND event_id % 5 <> 0)) AND event_id % 4 = 0 THEN 'sub' || (event_id % 3) END AS substep_id,
  CASE WHEN event_type = 'error' AND event_id % 10 <> 0 THEN 'E' || (event_id % 7)
       WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'CSV_SPLIT_FAILED' ELSE 'LEGACY_' || (event_id % 4) END END AS failure_code,
  CASE WHEN event_type = 'error' AND event_id % 10 <> 0 THEN 'failed at ' || event_id WHEN event_type = 'signup' THEN 'legacy ' || event_id END AS message,
  CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 AND event_id % 8 <> 0 THEN ['succeeded', 'failed', 'cancelled'][event_id % 3 + 1] END AS status,
  CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 AND event_id % 8 <> 0 THEN event_id % 3 END AS exit_code
FROM events""",
    "obs_orders_varied": """
SELECT * REPLACE (CASE upper(right(variableMeasured, 1)) WHEN 'T' THEN 'P3M' WHEN 'H' THEN 'P30D' WHEN 'M' THEN '' WHEN 'W' THEN 'P1M' ELSE observationPeriod END AS observationPeriod,
  CASE WHEN m % 2 = 1 AND length(observationAbout) % 3 = 1 THEN '0' WHEN m % 2 = 0 AND length(observationAbout) % 3 = 2 THEN '-1' ELSE value END AS value,
  CASE WHEN m % 2 = 1 THEN 'Thousand' ELSE 'One' END AS unit, CASE WHEN m % 2 = 1 THEN '1000' ELSE '1' END AS scalingFactor)
FROM (SELECT *, CAST(substr(observationDate, 6, 2) AS INTEGER) AS m FROM obs_orders)
WHERE NOT (m % 3 = 0 AND CAST(substr(observationDate, 1, 4) AS INTEGER) % 2 = 0)""",
    "success_counters": """
SELECT dataset_id, unnest([{'level': 'LEVEL_INFO', 'counterKey': 'NumNodeSuccesses', 'count': CASE dataset_id WHEN 'purchase' THEN n::VARCHAR
    WHEN 'click' THEN (n + 1)::VARCHAR WHEN 'view' THEN 'n/a' WHEN 'signup' THEN n::VARCHAR END},
  {'level': 'LEVEL_INFO', 'counterKey': 'NumRowSuccesses', 'count': n::VARCHAR}, {'level': 'LEVEL_WARNING', 'counterKey': 'NumRowSuccesses', 'count': '7'},
  {'level': 'LEVEL_INFO', 'counterKey': 'NumPVSuccesses', 'count': 'x'}, {'level': 'LEVEL_INFO', 'counterKey': 'NumOther', 'count': '1'}], recursive := true)
FROM (SELECT event_type AS dataset_id, count(*) AS n FROM events GROUP BY 1)""",
    "lint_counters": """
SELECT dataset_id, level, counterKey, CAST(count(*) AS VARCHAR) AS count FROM lint_entries GROUP BY ALL""",
}


def duckdb_with(*names: str, where: dict[str, str] | None = None) -> str:
    """WITH clause defining the named views (dependencies listed by the caller in order)."""
    parts = []
    for n in names:
        if n in ("obs_orders_current", "obs_orders_baseline"):
            cond = "WHERE o_orderkey % 10 <> 0" if n.endswith("current") else "WHERE o_orderkey % 10 <> 1"
            body = DUCKDB_VIEWS["obs_orders"].format(where=cond)
        elif n == "obs_orders":
            body = DUCKDB_VIEWS["obs_orders"].format(where="")
        else:
            body = DUCKDB_VIEWS[n]
        parts.append(f"{n} AS ({body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
