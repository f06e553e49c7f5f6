"""Exact dedup by skew-safe combining.

Equal texts meet in three steps, and each compares full contents:

1. every scan task deduplicates its own rows (map-side aggregate by text);
2. the task winners meet by (digest, salt, text), the salt being the task's
   number modulo ``salts``: of a text that a third of all rows hold, a reducer
   sees a ``salts``-th of the task winners;
3. the salt winners meet by (digest, text), at most ``salts`` rows a text.

The digest only spreads the rows and, where step 3 has shown it to belong to
one text, links a row to its group without moving the text again. Digests that
stand for several texts are linked by comparing contents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statgate.llm.common import cut, free_name, text_of

SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Null text counts as empty. Of equal texts the row with the largest id
    stays; null ids lose to any other and keep_id is null where a group has no
    other. Where that id is repeated within the group, exactly one of its rows
    is kept. An empty table gives an empty result. Other columns are ignored.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))

    in_task = rows.select("doc_id", "text", digest(F.col("text")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = in_task.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    texts = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    by_digest = cut(
        texts.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("n_texts")
        )
    )
    # Row numbers are drawn once, so that ties can be broken by them.
    members = cut(rows.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    alone = by_digest.where("n_texts = 1").select("digest", "keep_id", "group_size")
    clashing = by_digest.where("n_texts > 1").select("digest")
    grouped = members.join(alone, "digest").withColumn("part", F.lit(""))
    if not clashing.isEmpty():
        clashed = cut(rows.withColumn("digest", digest(F.col("text"))).join(clashing, "digest", "left_semi"))
        winners = clashed.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        grouped = grouped.unionByName(
            clashed.withColumn("row", -1 - F.monotonically_increasing_id())
            .join(winners, ["digest", "text"])
            .withColumn("part", F.sha2(F.concat(F.lit("#"), "text").cast("binary"), 512))
            .drop("text")
        )
    grouped = cut(grouped)
    first = (
        grouped.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "part")
        .agg(F.min("row").alias("row"))
        .select("row", F.lit(True).alias("first"))
    )
    return grouped.join(first, "row", "left").select(
        "doc_id", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"), "digest"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another kept row has; all columns stay as they are.

    Rows that repeat both the id and the text of a kept row go as well.
    """
    groups = exact_groups(docs, id_col, text_col)
    kept = cut(
        groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    digest = free_name(docs, "_digest")
    marked = docs.withColumn(digest, sha256_hex(text_of(text_col)))

    def rows_of(chosen: DataFrame) -> DataFrame:
        same = (marked[digest] == chosen["_digest"]) & marked[id_col].eqNullSafe(chosen["_id"])
        return marked.join(chosen, same, "left_semi")

    out = rows_of(kept.where("_n = 1"))
    if not (repeated := kept.where("_n > 1")).isEmpty():
        out = out.unionByName(rows_of(repeated).dropDuplicates([digest, id_col]))
    return out.drop(digest)
