"""CSV quality facts (Q1-Q6) over raw string tables.

Input: a frame of string cells with ``__file`` and ``__row`` (see
``sources.readers.read_csv``) plus ``dataset_id``; a header table
``(file, ord, name)`` read from the header line itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statgate.functions.scalars import is_blank, is_numeric, strip_blanks
from statgate.session import cut

META = ("__file", "__row", "__malformed", "__order", "dataset_id")


def _data_columns(csv: DataFrame, columns: list[str] | None) -> list[str]:
    return [c for c in (columns or csv.columns) if c not in META]


def smallest_k(df: DataFrame, group_cols: list[str], order_col: str, k: int) -> DataFrame:
    """The k smallest rows by ``order_col`` per group; Spark keeps k per group of each partition before it shuffles."""
    first = Window.partitionBy(*group_cols).orderBy(order_col)
    return df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


PICKS_BROADCAST = 10_000


def numbers_of(csv: DataFrame, picked: DataFrame, order: str) -> DataFrame:
    """``picked`` (file, at, later, ...) with ``row``, the record number of the record at ``at`` in its file's order.

    For tables whose order is known but whose records are not numbered: the
    records before each picked one are counted, in one pass without a sort.
    ``later`` is how many records equal in order come before it. Few picks
    (their number is looked at) are sent to the records, others are joined.
    """
    picked = cut(picked)
    spots = picked.select(F.col("file").alias("__pf"), F.col("at").alias("__pa")).distinct()
    spots = F.broadcast(spots) if picked.count() <= PICKS_BROADCAST else spots
    before = csv.join(spots, (F.col("__file") == F.col("__pf")) & (F.col(order) < F.col("__pa")))
    counts = before.groupBy("__pf", "__pa").agg(F.count(F.lit(1)).alias("__n"))
    j = picked.join(counts, (F.col("file") == F.col("__pf")) & (F.col("at") == F.col("__pa")), "left")
    return j.withColumn("row", F.coalesce("__n", F.lit(0)) + F.col("later") + 2).drop("__pf", "__pa", "__n", "at", "later")


def _numbered(csv: DataFrame, picked: DataFrame, order: str | None) -> DataFrame:
    """``picked`` with ``row`` in place of ``at`` and ``later``; records without an ``order`` carry their number."""
    if order is None:
        return picked.withColumn("row", F.col("at")).drop("at", "later")
    return numbers_of(csv, picked, order)


def duplicate_columns(header: DataFrame) -> DataFrame:
    """Q1: trimmed header names occurring more than once in a file, in first-seen order."""
    h = header.where(F.col("ord").isNotNull()).select("file", "ord", strip_blanks(F.coalesce(F.col("name"), F.lit(""))).alias("name"))
    return (
        h.groupBy("file", "name")
        .agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("file", "name", F.col("ord").cast("int").alias("ord"))
    )


def empty_columns(csv: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q2: columns with no non-blank cell in a file (files without data rows report nothing)."""
    cols = _data_columns(csv, columns)
    agg = csv.groupBy("__file").agg(*[F.max((~is_blank(F.col(f"`{c}`"))).cast("int")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(f"c{i}").alias("seen")) for i, c in enumerate(cols)])
    return (
        agg.select(F.col("__file").alias("file"), F.explode(pairs).alias("p"))
        .where(F.col("p.seen") == 0)
        .select("file", F.col("p.column").alias("column"), (F.col("p.ord") + 1).alias("ord"))
    )


KEY = ["__file", "__k1", "__k2"]


def _keyed(csv: DataFrame, cols: list[str], at: Column) -> DataFrame:
    """(__file, __k1, __k2, at): a 128-bit digest of each record's trimmed cells (missing cell = empty), which keeps cells apart."""
    names = [f"__c{i}" for i in range(len(cols))]
    cells = [F.coalesce(strip_blanks(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in zip(cols, names, strict=True)]
    trimmed = csv.select("__file", at.alias("at"), *cells)
    return trimmed.select("__file", F.xxhash64(*names).alias("__k1"), F.xxhash64(F.lit(1), *names).alias("__k2"), "at")


def _first_duplicate(csv: DataFrame, columns: list[str] | None, order: str | None) -> DataFrame:
    """(file, at, later) of the first record of each file that equals an earlier one.

    Keys are counted in one map-side combined aggregate; only records of
    repeated keys are looked at again, and of each key two are kept per task
    before they are shuffled.
    """
    cols = [c for c in _data_columns(csv, columns) if c != order]
    keyed = _keyed(csv, cols, F.col(order or "__row"))
    repeated = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    if (few := cut(repeated)).count() <= PICKS_BROADCAST:  # the records stay where they were read
        repeated = F.broadcast(few)
    else:
        repeated = few
    two = smallest_k(keyed.join(repeated, KEY, "left_semi"), KEY, "at", 2)
    seconds = two.groupBy(*KEY).agg(F.max("at").alias("at"), (F.max("at") == F.min("at")).cast("int").alias("later"))
    first = seconds.groupBy(F.col("__file").alias("file")).agg(F.min(F.struct("at", "later")).alias("s"))
    return first.select("file", "s.at", "s.later")


def first_duplicate_row(csv: DataFrame, columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Q3: per file, the smallest record number whose trimmed cells equal an earlier record's.

    ``order`` names a column that orders the records of a file which have no
    ``__row``; then only the records found are numbered. Duplicates are per
    file, never across files.
    """
    return _numbered(csv, _first_duplicate(csv, columns, order), order)


def non_numeric_rows(csv: DataFrame, value_column: str) -> DataFrame:
    """Q4: every record whose value cell is not numeric (blank counts as numeric)."""
    return csv.where(~is_numeric(F.col(f"`{value_column}`"))).select(F.col("__file").alias("file"), F.col("__row").alias("row"))


def non_numeric_summary(csv: DataFrame, value_column: str, sample: int = 5) -> DataFrame:
    """Q4 message parts: first ``sample`` offending rows and the total per file."""
    bad = non_numeric_rows(csv, value_column)
    first = smallest_k(bad, ["file"], "row", sample).groupBy("file").agg(F.array_sort(F.collect_list("row")).alias("sample"))
    total = bad.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    return first.join(total, "file")


def _py_repr(c: Column) -> Column:
    """Python repr of a plain string: single quotes unless it contains one and no double quote."""
    has_sq = c.contains("'")
    has_dq = c.contains('"')
    return (
        F.when(has_sq & ~has_dq, F.concat(F.lit('"'), c, F.lit('"')))
        .when(has_sq, F.concat(F.lit("'"), F.regexp_replace(c, "'", "\\\\'"), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), c, F.lit("'")))
    )


def quality_verdict(
    csv: DataFrame, header: DataFrame, value_column: str | None = "value", allow_empty: bool = True, columns=None, order: str | None = None
) -> DataFrame:
    """Q5: one message row per failed check and file: (file, check, message, fatal).

    Duplicate rows are checked per file; a file without data rows reports
    neither empty columns nor duplicates. ``order`` as in
    ``first_duplicate_row``: the records that are reported are numbered, in
    one pass for all checks.
    """
    dup_cols = (
        duplicate_columns(header)
        .groupBy("file")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda s: _py_repr(s["name"])), ", ").alias("names"))
        .select(
            "file",
            F.lit("duplicate_columns").alias("check"),
            F.concat(F.lit("Duplicate column name(s): "), F.col("names")).alias("message"),
            F.lit(True).alias("fatal"),
        )
    )
    no_header = header.where(F.col("ord").isNull()).select(
        "file", F.lit("header").alias("check"), F.lit("CSV has no header row").alias("message"), F.lit(True).alias("fatal")
    )
    # one per-file aggregate serves both the empty-column check and the
    # non-numeric total, so the records are scanned once for the two
    cols = _data_columns(csv, columns)
    has_value = bool(value_column and value_column in csv.columns)
    aggs = [F.max((~is_blank(F.col(f"`{c}`"))).cast("int")).alias(f"c{i}") for i, c in enumerate(cols)]
    if has_value:
        aggs.append(F.count_if(~is_numeric(F.col(f"`{value_column}`"))).alias("__bad"))
    facts = csv.groupBy("__file").agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(f"c{i}").alias("seen")) for i, c in enumerate(cols)])
    empty = (
        facts.select(F.col("__file").alias("file"), F.explode(pairs).alias("p"))
        .where(F.col("p.seen") == 0)
        .select(
            "file",
            F.lit("empty_columns").alias("check"),
            F.concat(F.lit("Column is entirely empty: "), _py_repr(F.col("p.column"))).alias("message"),
            F.lit(not allow_empty).alias("fatal"),
        )
    )
    picked = _first_duplicate(csv, columns, order).withColumn("bad", F.lit(False))
    if has_value:
        bad = csv.where(~is_numeric(F.col(f"`{value_column}`"))).select(F.col("__file").alias("file"), F.col(order or "__row").alias("at"))
        first = smallest_k(bad, ["file"], "at", 5)
        # records of equal order stand behind one another
        equal = F.row_number().over(Window.partitionBy("file", "at").orderBy("rank")) - 1
        picked = picked.unionByName(first.select("file", "at", equal.alias("later"), F.lit(True).alias("bad")))
    rows = _numbered(csv, picked, order)
    dup_rows = rows.where(~F.col("bad")).select(
        "file",
        F.lit("duplicate_rows").alias("check"),
        F.concat(F.lit("Duplicate row at 1-based row "), F.col("row").cast("string"), F.lit(" (header is row 1)")).alias("message"),
        F.lit(True).alias("fatal"),
    )
    parts = [no_header, dup_cols, empty, dup_rows]
    if has_value:
        first = rows.where("bad").groupBy("file").agg(F.array_sort(F.collect_list("row")).alias("sample"))  # five at most
        s = first.join(facts.select(F.col("__file").alias("file"), F.col("__bad").alias("total")), "file")
        more = F.when(F.col("total") > 5, F.concat(F.lit(" (and "), (F.col("total") - 5).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
        parts.append(
            s.select(
                "file",
                F.lit("non_numeric_rows").alias("check"),
                F.concat(
                    F.lit(f"Non-numeric value(s) in column '{value_column}' at row(s) ["),
                    F.array_join(F.transform("sample", lambda x: x.cast("string")), ", "),
                    F.lit("]"),
                    more,
                ).alias("message"),
                F.lit(True).alias("fatal"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_details(csv: DataFrame, header: DataFrame, value_column: str | None = "value", columns=None) -> DataFrame:
    """S8 payload: per file the four detail lists (empty/duplicate columns, duplicate rows, non-numeric rows)."""
    files = csv.select(F.col("__file").alias("file")).distinct().unionByName(header.select("file").distinct()).distinct()
    dcols = duplicate_columns(header).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("duplicate_columns"))
    ecols = empty_columns(csv, columns).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "column"))), lambda s: s["column"]).alias("empty_columns"))
    drows = first_duplicate_row(csv, columns).select("file", F.array("row").alias("duplicate_rows"))
    out = files.join(dcols, "file", "left").join(ecols, "file", "left").join(drows, "file", "left")
    if value_column and value_column in csv.columns:
        # the full list of offending records stays distributed (non_numeric_rows);
        # the per-file detail row carries the count and the first five
        nn = non_numeric_summary(csv, value_column).select(
            "file", F.col("total").alias("non_numeric_count"), F.col("sample").alias("non_numeric_sample")
        )
        out = out.join(nn, "file", "left")
    else:
        out = out.withColumn("non_numeric_count", F.lit(None).cast("bigint")).withColumn(
            "non_numeric_sample", F.lit(None).cast("array<bigint>")
        )
    empty_str = F.array().cast("array<string>")
    empty_int = F.array().cast("array<bigint>")
    return out.select(
        "file",
        F.coalesce("empty_columns", empty_str).alias("empty_columns"),
        F.coalesce("duplicate_columns", empty_str).alias("duplicate_columns"),
        F.coalesce("duplicate_rows", empty_int).alias("duplicate_rows"),
        F.coalesce("non_numeric_count", F.lit(0)).cast("bigint").alias("non_numeric_count"),
        F.coalesce("non_numeric_sample", empty_int).alias("non_numeric_sample"),
    )


def shard_assign(csv: DataFrame, rows_per_shard: int) -> DataFrame:
    """Shard number per record: floor((row - 2) / rows_per_shard), per file."""
    return csv.withColumn("shard", F.floor((F.col("__row") - 2) / F.lit(rows_per_shard)).cast("bigint"))


def source_key(file: Column, root: str = "") -> Column:
    """A file's path below ``root`` as one folder name: what is no letter, digit, dot, dash or plus becomes ``_`` and two hex digits.

    Different paths get different names; a file that is not below ``root``
    keeps its whole path.
    """
    base = root.rstrip("/") + "/" if root else ""
    below = F.when(file.startswith(base), F.substr(file, F.lit(len(base) + 1))).otherwise(file) if base else file
    safe = F.replace(F.replace(F.url_encode(below), F.lit("_"), F.lit("%5F")), F.lit("*"), F.lit("%2A"))
    return F.replace(safe, F.lit("%"), F.lit("_"))


def shard_path(out_dir: str, root: str = "", dataset: str = "dataset_id", file: str = "file", shard: str = "shard") -> Column:
    """Where ``write_shards`` puts a shard."""
    return F.concat(
        F.lit(f"{out_dir.rstrip('/')}/dataset_id="), source_key(F.col(dataset)), F.lit("/file="), source_key(F.col(file), root), F.lit("/shard="), F.col(shard).cast("string")
    )


def shard_manifest(csv: DataFrame, rows_per_shard: int, threshold_rows: int = 0, failed: bool = False, out_dir: str = "", root: str = "") -> DataFrame:
    """One row per source file: (dataset_id, original_csv, status, shard_paths, shard_rows, total_rows, shard_count, rows_per_shard, threshold_rows).

    Shards are skipped (status 'skipped', no paths) below the row threshold of
    a file or when the quality checks failed. Paths are those of
    ``write_shards`` below ``out_dir``; they follow from the row count, so no
    shard is looked at.
    """
    per = csv.groupBy("dataset_id", F.col("__file").alias("file")).agg(F.count(F.lit(1)).cast("bigint").alias("total_rows"))
    size = F.lit(rows_per_shard).cast("bigint")
    done = (F.col("total_rows") >= F.lit(threshold_rows)) & F.lit(not failed)
    n = F.when(done, F.ceil(F.col("total_rows") / size)).otherwise(F.lit(0)).cast("bigint")
    per = per.withColumn("shard_count", n)
    numbers = F.when(F.col("shard_count") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("shard_count") - 1)).otherwise(F.array().cast("array<bigint>"))
    folder = F.concat(F.lit(f"{out_dir.rstrip('/')}/dataset_id="), source_key(F.col("dataset_id")), F.lit("/file="), source_key(F.col("file"), root), F.lit("/shard="))
    return per.withColumn("folder", folder).select(
        "dataset_id",
        F.col("file").alias("original_csv"),
        F.when(done, F.lit("done")).otherwise(F.lit("skipped")).alias("status"),
        F.transform(numbers, lambda k: F.concat(F.col("folder"), k.cast("string"))).alias("shard_paths"),
        F.transform(numbers, lambda k: F.least(size, F.col("total_rows") - k * size)).alias("shard_rows"),
        "total_rows",
        "shard_count",
        size.alias("rows_per_shard"),
        F.lit(threshold_rows).cast("bigint").alias("threshold_rows"),
    )


def quality_and_shards(
    csv: DataFrame,
    header: DataFrame,
    rows_per_shard: int,
    threshold_rows: int = 0,
    value_column: str | None = "value",
    allow_empty: bool = True,
    out_dir: str | None = None,
    columns=None,
    root: str = "",
    order: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Q6: quality messages and the shard manifest in one plan over the same scan.

    Shards are written (when ``out_dir`` is given) for the files of datasets
    without a failed fatal check that reach ``threshold_rows``; the manifest
    says 'skipped' otherwise. Returns (messages, manifest).
    """
    messages = quality_verdict(csv, header, value_column, allow_empty, columns, order)
    m = shard_manifest(csv, rows_per_shard, threshold_rows, out_dir=out_dir or "", root=root)
    failed = messages.where("fatal").select("file").distinct().join(m.select("dataset_id", F.col("original_csv").alias("file")), "file")
    failed = failed.select("dataset_id").distinct().withColumn("__failed", F.lit(True))
    m = m.join(failed, "dataset_id", "left")
    skipped = F.coalesce(F.col("__failed"), F.lit(False)) | (F.col("status") == "skipped")
    manifest = m.select(
        "dataset_id",
        "original_csv",
        F.when(skipped, F.lit("skipped")).otherwise(F.lit("done")).alias("status"),
        F.when(skipped, F.array().cast("array<string>")).otherwise(F.col("shard_paths")).alias("shard_paths"),
        F.when(skipped, F.array().cast("array<bigint>")).otherwise(F.col("shard_rows")).alias("shard_rows"),
        "total_rows",
        F.when(skipped, F.lit(0).cast("bigint")).otherwise(F.col("shard_count")).alias("shard_count"),
        "rows_per_shard",
        "threshold_rows",
    )
    if out_dir is not None:
        from statgate.sources.writers import write_shards

        done = cut(manifest).where(F.col("status") == "done").select("dataset_id", F.col("original_csv").alias("__file"))
        write_shards(csv.join(done, ["dataset_id", "__file"], "left_semi"), out_dir, rows_per_shard, columns, root=root)
    return messages, manifest
