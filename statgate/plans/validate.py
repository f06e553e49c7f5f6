"""End-to-end plans: the flagship validation of one or many datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statgate.operators import rules as R
from statgate.plans import catalog


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations -> stats -> default rules (R1) -> missing-result injection (R2)."""
    tables = catalog.events_tables(spark, sf_dir)
    rules = catalog.DEFAULT_RULES
    res = R.run_rules(tables, rules)
    return R.inject_missing(res, rules).select("dataset_id", "validation_name", "status", "message")


def validate_many(
    spark: SparkSession,
    obs: DataFrame,
    rules: list[dict],
    lint: DataFrame | None = None,
    baselines: DataFrame | None = None,
    granularity_nodes: DataFrame | None = None,
) -> DataFrame:
    """One job validates many datasets; every operator is keyed by ``dataset_id``.

    ``baselines`` holds the accepted observations of the datasets that have
    one; the others take the first-run path (D8) of the differ rules.
    """
    from statgate.operators import diff as D
    from statgate.operators import series as W
    from statgate.operators import stats as A

    from statgate.session import cut

    # the stats table (one row per variable) is written once; the dataset list
    # comes from it, so no rule part re-scans the observations for dataset ids
    stats = cut(A.variable_summary(obs))
    datasets = stats.select("dataset_id").distinct()
    tables = {"stats": stats, "granularity": W.date_granularity_mix(obs, granularity_nodes)}
    if lint is not None:
        tables["lint"] = lint
    else:
        tables["lint"] = spark.createDataFrame([], "dataset_id string, level string, counterKey string, count string")
    if baselines is not None:
        with_base = baselines.select("dataset_id").distinct()
        cur = obs.join(with_base, "dataset_id", "left_semi")
        counts = cut(D.diff_counts(D.diff_observations(cur, baselines)))
        tables["differ"], tables["sizes"] = D.differ_and_sizes(counts)
    res = R.run_rules(tables, rules, datasets=datasets)
    return R.inject_missing(res, rules, datasets)
