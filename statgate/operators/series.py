"""Time-series operators (W1-W7) over observations.

A series is (dataset_id, place, variable, period, method). Unit and scaling
factor stay on the points so their changes can be seen. When a date repeats
inside a series the value of the lowest record number is used; that
dedupe is a grouped aggregate (map-side combined), so a series with many
duplicate rows never reaches a window in full. Windows then run per series
over distinct dates only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statgate.functions.scalars import (
    date_granularity,
    is_blank,
    normalize_variable,
    parse_partial_date,
    percent_change,
    period_days,
    period_months,
    strip_blanks,
    to_double,
    to_number,
)

SERIES_KEY = ["dataset_id", "observationAbout", "StatVar", "observationPeriod", "measurementMethod"]
# The fluctuation counter keys and their thresholds.
FLUCTUATION_500 = "StatsCheck_MaxPercentFluctuationGreaterThan500"
FLUCTUATION_100 = "StatsCheck_MaxPercentFluctuationGreaterThan100"
FLUCTUATION_COUNTER_KEYS = [FLUCTUATION_500, FLUCTUATION_100]


def _blank_to_null(c):
    return F.when(~is_blank(c), strip_blanks(c))


def series_points(obs: DataFrame) -> DataFrame:
    """One point per (series, date): value of the lowest record number for that date."""
    o = obs.select(
        "dataset_id",
        strip_blanks(F.col("observationAbout")).alias("observationAbout"),
        normalize_variable("variableMeasured").alias("StatVar"),
        F.coalesce(strip_blanks(F.col("observationPeriod")), F.lit("")).alias("observationPeriod"),
        F.coalesce(strip_blanks(F.col("measurementMethod")), F.lit("")).alias("measurementMethod"),
        strip_blanks(F.col("observationDate")).alias("date"),
        F.struct(
            F.coalesce(F.col("__row"), F.lit(0)).alias("row"),
            to_double("value").alias("value"),
            _blank_to_null(F.col("unit")).alias("unit"),
            _blank_to_null(F.col("scalingFactor")).alias("scalingFactor"),
        ).alias("pt"),
    ).where(F.col("date").isNotNull() & (F.col("date") != ""))
    # min of a struct orders by its first field: the record number
    first = o.groupBy(*SERIES_KEY, "date").agg(F.min("pt").alias("pt"))
    return first.select(
        *SERIES_KEY,
        "date",
        parse_partial_date(F.col("date")).alias("d"),
        F.col("pt.value").alias("value"),
        F.col("pt.unit").alias("unit"),
        F.col("pt.scalingFactor").alias("scalingFactor"),
    )


def series_pairs(points: DataFrame) -> DataFrame:
    """Consecutive pairs per series (lag over the series ordered by parsed date, then text)."""
    w = Window.partitionBy(*SERIES_KEY).orderBy(F.col("d").asc_nulls_first(), F.col("date"))
    return points.select(
        "*",
        F.lag("date").over(w).alias("prev_date"),
        F.lag("d").over(w).alias("prev_d"),
        F.lag("value").over(w).alias("prev_value"),
        F.lag("unit").over(w).alias("prev_unit"),
        F.lag("scalingFactor").over(w).alias("prev_scalingFactor"),
        F.row_number().over(w).alias("pos"),
    )


def fluctuations(obs: DataFrame, thresholds=(100, 500)) -> DataFrame:
    """Per series, the consecutive pair with the largest |percent change| above a threshold.

    The highest threshold exceeded names the counter; ties go to the earliest date.
    """
    low, high = sorted(thresholds)
    pairs = series_pairs(series_points(obs)).where(F.col("prev_date").isNotNull())
    pct = F.abs(percent_change(F.col("prev_value"), F.col("value")))
    cand = pairs.select(*SERIES_KEY, "prev_date", "date", "prev_value", "value", pct.alias("pct"), "d").where(
        F.col("pct") > F.lit(float(low))
    )
    best = cand.groupBy(*SERIES_KEY).agg(
        F.min_by(
            F.struct("prev_date", "date", "prev_value", "value", "pct"),
            F.struct((-F.col("pct")).alias("k1"), F.col("d").alias("k2"), F.col("date").alias("k3")),
        ).alias("b")
    )
    key = F.when(F.col("b.pct") > F.lit(float(high)), F.lit(f"StatsCheck_MaxPercentFluctuationGreaterThan{high}")).otherwise(
        F.lit(f"StatsCheck_MaxPercentFluctuationGreaterThan{low}")
    )
    return best.select(
        *SERIES_KEY,
        key.alias("counter_key"),
        F.col("b.prev_date").alias("prev_date"),
        F.col("b.date").alias("curr_date"),
        F.col("b.prev_value").alias("prev_value"),
        F.col("b.value").alias("curr_value"),
        F.col("b.pct").alias("pct"),
    )


def series_signals(obs: DataFrame) -> DataFrame:
    """W2 + W3 + W4: technical signals of the last pair of every series with >= 2 points.

    W3 uses the period length in days (P1M = 30, so a 31-day month gap counts
    as missing), else the mean gap of the series when it has >= 3 points.
    """
    pts = series_pairs(series_points(obs))
    gap = F.datediff(F.col("d"), F.col("prev_d"))
    per_pair = pts.select(
        *SERIES_KEY,
        F.struct(
            F.col("d").alias("k1"),
            F.col("date").alias("k2"),
        ).alias("order_key"),
        F.struct(
            F.col("prev_date"),
            F.col("date").alias("curr_date"),
            F.col("prev_value"),
            F.col("value").alias("curr_value"),
            F.col("prev_unit"),
            F.col("unit").alias("curr_unit"),
            F.col("prev_scalingFactor"),
            F.col("scalingFactor").alias("curr_scalingFactor"),
            gap.alias("gap_days"),
        ).alias("pair"),
        gap.alias("g"),
    )
    agg = per_pair.groupBy(*SERIES_KEY).agg(
        F.max_by("pair", "order_key").alias("last"),
        F.count(F.lit(1)).cast("bigint").alias("series_length"),
        F.sum("g").alias("gap_sum"),
        F.count("g").alias("gap_n"),
    )
    last = F.col("last")
    prev, curr = last["prev_value"], last["curr_value"]
    pdays = period_days(F.col("observationPeriod"))
    typical = F.greatest(F.lit(1), F.floor(F.col("gap_sum") / F.col("gap_n")).cast("bigint"))
    missing = (
        F.when(last["gap_days"].isNull(), F.lit(None))
        .when(pdays.isNotNull(), last["gap_days"] > pdays)
        .when((F.col("series_length") >= 3) & (F.col("gap_n") > 0), last["gap_days"] > typical)
    )
    gap_years = F.when(
        last["gap_days"] >= 0, F.round(last["gap_days"].cast("decimal(20,6)") / F.lit(365.25).cast("decimal(20,6)"), 1)
    )
    both = prev.isNotNull() & curr.isNotNull()
    return agg.where(last["prev_date"].isNotNull()).select(
        *SERIES_KEY,
        last["prev_date"].alias("prev_date"),
        last["curr_date"].alias("curr_date"),
        prev.alias("previous_value"),
        curr.alias("current_value"),
        F.when(both, percent_change(prev, curr)).alias("percent_change"),
        (prev.isNotNull() & (F.abs(prev) < 1)).alias("previous_near_zero"),
        (both & (prev <= 0) & (curr > 0)).alias("first_valid_after_placeholder"),
        missing.alias("missing_intermediate_periods"),
        F.when(
            last["prev_scalingFactor"].isNotNull() & last["curr_scalingFactor"].isNotNull(),
            last["prev_scalingFactor"] != last["curr_scalingFactor"],
        ).alias("scaling_changed"),
        F.when(last["prev_unit"].isNotNull() & last["curr_unit"].isNotNull(), last["prev_unit"] != last["curr_unit"]).alias(
            "unit_changed"
        ),
        gap_years.cast("decimal(10,1)").alias("period_gap_years"),
        F.col("series_length"),
    )


def technical_signals(obs: DataFrame) -> DataFrame:
    """W2 only."""
    return series_signals(obs).drop("missing_intermediate_periods", "period_gap_years", "series_length")


def missing_periods(obs: DataFrame) -> DataFrame:
    """W3 only."""
    return series_signals(obs).select(*SERIES_KEY, "missing_intermediate_periods")


def period_gap(obs: DataFrame) -> DataFrame:
    """W4 only."""
    return series_signals(obs).select(*SERIES_KEY, "period_gap_years", "series_length")


def report_fluctuations(points: DataFrame) -> DataFrame:
    """Fluctuation samples from a lint report's problem points.

    One row per (series item, fluctuation counter) with the dated points sorted
    by date (a report-sized list), the reported percent difference and the
    last-pair gap in years. Points carry their locations where the report has them.
    """
    of_point = ["date", "value", "unit", "scalingFactor", *(["locations"] if "locations" in points.columns else [])]
    p = points.where(F.col("counterKey").isin(*FLUCTUATION_COUNTER_KEYS) & F.col("date").isNotNull() & (F.col("date") != ""))
    g = p.groupBy("dataset_id", "item_ord", "counter_ord", "placeDcid", "statVarDcid", "observationPeriod", "counterKey").agg(
        F.array_sort(F.collect_list(F.struct(*of_point))).alias("points"),
        F.max("percentDifference").alias("percentDifference"),
    )
    n = F.size("points")
    prev_d = parse_partial_date(F.element_at("points", -2)["date"])
    curr_d = parse_partial_date(F.element_at("points", -1)["date"])
    gap = F.datediff(curr_d, prev_d)
    return g.select(
        "dataset_id",
        F.col("statVarDcid").alias("statVar"),
        F.col("placeDcid").alias("location"),
        "observationPeriod",
        "counterKey",
        "points",
        "percentDifference",
        F.when((n >= 2) & (gap >= 0), F.round(gap.cast("decimal(20,6)") / F.lit(365.25).cast("decimal(20,6)"), 1).cast("decimal(10,1)")).alias(
            "period_gap_years"
        ),
        n.cast("bigint").alias("series_length"),
        F.when(n >= 2, percent_change(to_number(F.element_at("points", -2)["value"]), to_number(F.element_at("points", -1)["value"]))).alias(
            "percent_change"
        ),
    )


def data_holes(obs: DataFrame) -> DataFrame:
    """Gaps between consecutive points larger than the series step.

    Step: calendar months when the period is whole months (P1M, P3M, P1Y),
    else the period in days, else (no period, >= 3 points) the median gap.
    ``missing`` = number of absent steps inside the gap.
    """
    pts = series_pairs(series_points(obs)).where(F.col("d").isNotNull())
    # re-lag on parsed dates only
    w = Window.partitionBy(*SERIES_KEY).orderBy("d", "date")
    p = pts.select(*SERIES_KEY, "date", "d", F.lag("date").over(w).alias("from_date"), F.lag("d").over(w).alias("from_d"))
    p = p.where(F.col("from_d").isNotNull())
    months = period_months(F.col("observationPeriod"))
    days = period_days(F.col("observationPeriod"))
    gap_days = F.datediff("d", "from_d")
    gap_months = F.months_between("d", "from_d")
    med = (
        p.where(F.col("observationPeriod") == "")
        .groupBy(*SERIES_KEY)
        .agg(F.percentile(gap_days, 0.5).alias("median_gap"), F.count(F.lit(1)).alias("n_pairs"))
    )
    j = p.join(med, SERIES_KEY, "left")
    missing = (
        F.when(months.isNotNull(), F.ceil(gap_months / months) - 1)
        .when(days.isNotNull(), F.ceil(gap_days / days) - 1)
        .when((F.col("n_pairs") >= 2) & (F.col("median_gap") > 0), F.ceil(gap_days / F.col("median_gap")) - 1)
    )
    return j.select(*SERIES_KEY, "from_date", F.col("date").alias("to_date"), missing.cast("bigint").alias("missing")).where(
        F.col("missing") > 0
    )


def date_granularity_mix(obs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Granularity sets of observation dates per source ('column', 'template', 'all').

    The whole column is scanned (no row sample); the sets are tiny (<= 3 labels).
    """
    col_src = obs.select("dataset_id", F.lit("column").alias("source"), date_granularity(F.col("observationDate")).alias("g"))
    parts = col_src
    if nodes is not None:
        lit_src = nodes.where((F.col("prop") == "observationDate") & ~F.col("value").startswith("C:")).select(
            "dataset_id", F.lit("template").alias("source"), date_granularity(F.col("value")).alias("g")
        )
        parts = parts.unionByName(lit_src)
    g = parts.where(F.col("g").isNotNull()).groupBy("dataset_id", "source").agg(F.array_sort(F.collect_set("g")).alias("formats"))
    allg = parts.where(F.col("g").isNotNull()).groupBy("dataset_id").agg(
        F.lit("all").alias("source"), F.array_sort(F.collect_set("g")).alias("formats")
    )
    out = g.unionByName(allg)
    return out.select(
        "dataset_id",
        "source",
        "formats",
        F.when(F.size("formats") > 1, F.lit("WARNING")).otherwise(F.lit("PASSED")).alias("status"),
    )
