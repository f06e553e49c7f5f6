"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list entry is a canonical URL prefix: a host, whose subdomains count as
well, and a path prefix. An URL can only be hit by entries made of one of its
host's suffixes and one of its path's prefixes, both of a length (in labels and
in characters) that occurs in the list. These keys are tested against the filter: a key sets one bit in each of
the eight 64-bit words of one block, so a test touches one cache line. URLs
with a possible hit go to an equality join with the list, which removes the
false positives; the others are decided without moving.

The filter has a fixed upper size (``MAX_BLOCKS``, 64 MB), whatever the list:
beyond it only the share of false positives grows. The list is broadcast up to
``BROADCAST_KEYS`` entries and shuffled beyond, where adaptive execution splits
hot hosts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statgate.llm.common import cut, kept_names

KEYS_PER_BLOCK = 24  # 512 bits for 24 keys
MAX_BLOCKS = 1 << 20
BROADCAST_KEYS = 50_000  # a list of up to so many entries is sent to every executor, a longer one is shuffled
WORDS = 8
SEED = 42  # of Spark's xxhash64


def parts(url: Column) -> tuple[Column, Column]:
    """Canonical host and path: see ``judge``."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    has = F.contains(known, F.lit("://"))
    rest = F.regexp_extract(known, r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def _second(key: Column) -> Column:
    return F.xxhash64(F.concat(key, F.lit("\x01")))


def build_filter(keys: DataFrame, key_col: str = "key") -> np.ndarray:
    """(blocks, 8) words of a blocked Bloom filter; bits are combined in the cluster, at most ``MAX_BLOCKS`` rows come back."""
    n = keys.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n // KEYS_PER_BLOCK)))
    key = F.col(key_col)
    hashed = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), _second(key).alias("h"))
    bits = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * i}) & 63 as int))")).alias(f"w{i}") for i in range(WORDS)]
    words = np.zeros((blocks, WORDS), dtype=np.int64)
    for row in hashed.groupBy("block").agg(*bits).toLocalIterator():
        words[row["block"]] = [row[f"w{i}"] for i in range(WORDS)]
    return words.view(np.uint64)


def maybe_listed(words: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Whether each key may be listed; never False for a listed one."""
    if not keys:
        return np.zeros(0, dtype=bool)
    first = np.array([xxhash.xxh64_intdigest(k, SEED) for k in keys], dtype=np.uint64).view(np.int64)
    second = np.array([xxhash.xxh64_intdigest(k + b"\x01", SEED) for k in keys], dtype=np.uint64)
    block = words[np.mod(first, words.shape[0])]
    lanes = (second[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
    return ((block >> lanes) & np.uint64(1)).all(axis=1)


def candidates(host: str, path: str, lengths: list[int], dots: list[int]) -> list[str]:
    """Keys of all entries that could fit an URL: host suffixes of the given numbers of dots with path prefixes of the given lengths."""
    labels = host.rsplit(".", max(dots, default=0) + 1)
    suffixes = [".".join(labels[-n - 1 :]) for n in dots if n < len(labels)]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [f"{s}\t{p}" for s in suffixes if s for p in prefixes]


def judge(
    urls: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """Per row of ``urls``: the columns ``keep``, host, path, rule and verdict.

    ``rules`` has host, path and verdict. Host: after the first ``://`` up to
    ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end; a null url or one without ``://`` has neither. A
    rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule (host and path together) wins, among equals the one of
    the longer host, then ``block``. ``rule`` is its host and path, null where
    no rule fits and the verdict is ``default``. Repeated rows are judged each;
    repeated rules count once; rules with a null host, path or verdict are none.
    Without rules every row has the default, an empty table gives no rows, and
    a long url is read whole. A kept column with the name of a result gets
    underscores before it.
    """
    names = kept_names(keep, ["host", "path", "rule", "verdict"])
    held = [f"keep_{i}" for i in range(len(keep))]  # beside this function's own columns
    listed = cut(
        rules.where("host is not null and host <> '' and path is not null and verdict is not null")
        .groupBy(F.concat_ws("\t", "host", "path").alias("key"))
        .agg(F.max("verdict").alias("rule_verdict"))
    )
    lengths = sorted(r[0] for r in listed.select(F.length(F.substring_index("key", "\t", -1))).distinct().collect())
    listed_host = F.substring_index("key", "\t", 1)
    dots = sorted(r[0] for r in listed.select(F.regexp_count(listed_host, F.lit("[.]"))).distinct().collect())
    words = urls.sparkSession.sparkContext.broadcast(build_filter(listed))
    host, path = parts(F.col(url_col))
    rows = urls.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held, strict=True)], host.alias("host"), path.alias("path"))
    hits = "hits"
    schema = T.StructType([*rows.schema.fields, T.StructField(hits, T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            found = [
                candidates(h.as_py(), p.as_py(), lengths, dots)
                for h, p in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True)
            ]
            flat = [k for keys in found for k in keys]
            maybe = iter(maybe_listed(words.value, [k.encode("utf-8") for k in flat]).tolist())
            possible = [[k for k in keys if next(maybe)] for keys in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(possible, pa.list_(pa.string()))], names=schema.names)

    tested = rows.mapInArrow(run, schema)
    columns = [*[F.col(h) for h in held], F.col("host"), F.col("path")]
    passed = tested.where(F.size(hits) == 0).select(
        *columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
    )
    exploded = tested.where(F.size(hits) > 0).withColumn("_row", F.monotonically_increasing_id()).select("_row", *columns, F.explode(hits).alias("key"))
    host_length = F.length(F.substring_index("key", "\t", 1))
    order = F.struct(F.length("key"), host_length, F.when(F.col("rule_verdict") == "block", 1).otherwise(0), F.col("key"), F.col("rule_verdict").alias("v"))
    best = (
        exploded.join(F.broadcast(listed) if listed.count() <= BROADCAST_KEYS else listed, "key", "left")
        .groupBy("_row", *columns)
        .agg(F.max(F.when(F.col("rule_verdict").isNotNull(), order)).alias("best"))
        .select(*columns, F.replace(F.col("best.key"), F.lit("\t"), F.lit("")).alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
    )
    return passed.unionByName(best).withColumnsRenamed(dict(zip(held, names.values(), strict=True)))
