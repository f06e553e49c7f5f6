"""The bucketed baseline: only changed buckets are read, with the result of the full diff."""

import collections

from pyspark.sql import functions as F

from statgate.operators import diff as D

OBS = (
    "dataset_id string, observationAbout string, observationDate string, variableMeasured string, value string, unit string, "
    "measurementMethod string, observationPeriod string, scalingFactor string"
)


def observations(spark, n: int):
    """Every fourth row belongs to one hot key; some values are text, blank or null."""
    i = F.col("id")
    place = F.when(i % 4 == 0, "geo/hot").otherwise(F.concat(F.lit("geo/"), i.cast("string")))
    value = F.when(i % 11 == 0, "n/a").when(i % 13 == 0, " ").when(i % 17 != 0, (i % 100).cast("string"))
    variable = F.concat(F.lit("dcid:Count_"), (i % 3).cast("string"))
    rows = spark.range(n).select(F.lit("ds"), place, F.lit("2020"), variable, value, *[F.lit(None).cast("string")] * 4)
    return spark.createDataFrame([], OBS).unionByName(rows.toDF(*[c.split()[0] for c in OBS.split(", ")]))


def held(df):
    return collections.Counter(map(tuple, df.select(sorted(df.columns)).collect()))


def check(spark, tmp_path, current, baseline, buckets=32):
    root = str(tmp_path / "b")
    D.accept_baseline(baseline, root, "ds", "r1", False, buckets=buckets)
    full = D.diff_observations(current, baseline)
    made = D.incremental_diff(current, root, "ds")
    assert held(made) == held(full)
    differ, sizes = D.diff_or_first_run(current, root, "ds")
    want_differ, want_sizes = D.differ_and_sizes(D.diff_counts(full))
    assert held(differ) == held(want_differ) and held(sizes) == held(want_sizes)
    return root, made


def test_one_changed_row_reads_one_bucket(spark, tmp_path):
    base = observations(spark, 4000)
    current = base.withColumn("value", F.when(F.col("observationAbout") == "geo/5", "77.5").otherwise(F.col("value")))
    root, _ = check(spark, tmp_path, current, base)
    entry = D._newest(spark, root, "ds")
    changed = D._changed_buckets(current, entry)
    assert len(changed) == 1
    read = D._rows_of(spark, entry).where(F.col(D.BUCKET).isin(changed)).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all(f"{D.BUCKET}={changed[0]}/" in r.f for r in read)
    plan = D._changed_diff(current, entry, changed)._jdf.queryExecution().toString()
    assert f"PartitionFilters: [isnotnull({D.BUCKET}" in plan or f"PartitionFilters: [({D.BUCKET}" in plan


def test_no_change_reads_no_bucket(spark, tmp_path):
    base = observations(spark, 400)
    root, made = check(spark, tmp_path, base.repartition(5), base)
    assert D._changed_buckets(base, D._newest(spark, root, "ds")) == []
    assert {r.status for r in made.select("status").distinct().collect()} == {"SAME"}


def test_added_deleted_and_repeated_rows(spark, tmp_path):
    base = observations(spark, 300)
    kept = base.where("observationAbout <> 'geo/7' OR value IS NULL")
    new = base.where("observationAbout = 'geo/9'").withColumn("observationDate", F.lit("2021"))
    check(spark, tmp_path, kept.unionByName(new).unionByName(base.limit(20)), base)


def test_equal_values_written_otherwise_are_the_same(spark, tmp_path):
    base = observations(spark, 200)
    current = base.withColumn("value", F.when(F.col("value").rlike("^[0-9]+$"), F.concat("value", F.lit(".0"))).otherwise(F.col("value")))
    root, _ = check(spark, tmp_path, current, base)
    assert D._changed_buckets(current, D._newest(spark, root, "ds")) == []


def test_empty_sides(spark, tmp_path):
    some, none = observations(spark, 50), observations(spark, 0)
    check(spark, tmp_path / "1", none, some)
    check(spark, tmp_path / "2", some, none)
    check(spark, tmp_path / "3", none, none)
    assert D.latest_baseline(spark, str(tmp_path / "2" / "b"), "ds").count() == 0


def test_versions_without_buckets_are_compared_whole(spark, tmp_path):
    some = observations(spark, 30)
    path = str(tmp_path / "plain")
    some.write.parquet(path)
    entry = f'{{"dataset_id":"ds","version":"v1","run_id":"r","updated_at":"x","path":"{path}"}}\n'
    D.put_if_absent(spark, f"{D._manifest_dir(str(tmp_path), 'ds')}/000000001.json", entry)
    assert held(D.incremental_diff(some, str(tmp_path), "ds")) == held(D.diff_observations(some, some))
    assert D.diff_or_first_run(some, str(tmp_path), "ds")[0].count() == 0
