"""SimHash near-dedup with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most k bits, cut into
k // 2 + 1 segments, agree up to one bit in at least one segment. Each
fingerprint is therefore indexed under every one-wildcard variant of every
segment (64 variants in all), an equality shuffle by variant brings candidates
together, and full fingerprints verify them.

Groups of equal fingerprints are one entry of the index. Within a variant's
bucket no pairs are listed: a bucket yields the links of a spanning forest of
its near pairs, found by growing each tree from a member against what is not
yet reached, so a dense bucket of m members costs m links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statgate.llm.common import cut, free_name, text_of
from statgate.llm.components import components

BITS = 64
SEED = 42
PIECE = 1 << 16  # shingles hashed at a time
HOT = 4096  # a fingerprint of more than this part of all rows is hot
SMALL = 24  # buckets up to this size are compared by shifted copies, all at once

_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a text given as UTF-8: a bit is set if it is set in over half of the shingles' XXH64.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer
    words than ``shingle`` form one shingle; no word gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, PIECE):
        part = [hash_of(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE], strict=True)]
        columns = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(columns[:, byte], minlength=256) @ _OF_BYTE
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row, fp the 64 bits as a signed long. Null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the max_bits // 2 + 1 segments."""
    n = max_bits // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def _forest(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the near pairs among distinct fingerprints."""
    left, right, rest = [], [], members
    while rest.size:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and rest.size:
            at = frontier.pop()
            near = _near(rest, at, max_bits)
            if near.any():
                new, rest = rest[near], rest[~near]
                left.append(np.full(new.size, at))
                right.append(new)
                frontier.extend(new)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; each run's fingerprints are distinct."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, keys.size))
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = [], []
    k, f = keys[small], fps[small]
    for lag in range(1, min(SMALL, k.size)):
        at = np.flatnonzero(k[lag:] == k[:-lag])
        if not at.size:
            break
        at = at[_near(f[at], f[at + lag], max_bits)]
        left.append(f[at])
        right.append(f[at + lag])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        a, b = _forest(fps[s : s + n], max_bits)
        left.append(a)
        right.append(b)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def near_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (column fp) within ``max_bits``, enough for its components."""
    parts = []
    for number, (first, width) in enumerate(_segments(max_bits)):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        for bit in range(width):
            masked = value.bitwiseAND(F.lit(~(1 << bit) if bit < 63 else 2**63 - 1))
            parts.append(F.struct(F.lit(number * BITS + bit).alias("variant"), masked.alias("masked")))
    variants = distinct.select("fp", F.inline(F.array(*parts)))
    sorted_variants = variants.repartition("variant", "masked").sortWithinPartitions("variant", "masked", "fp")

    def run(batches):
        held_keys, held_fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys, fps):
            a, b = _bucket_links(keys, fps, max_bits)
            if a.size:  # a pair meets in several buckets
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                a, b = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        variant, at = -1, 0  # number the buckets as they come
        last = None
        for batch in batches:
            v, m, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not v.size:
                continue
            new = np.concatenate(([last is None or last != (v[0], m[0])], (v[1:] != v[:-1]) | (m[1:] != m[:-1])))
            keys = at + np.cumsum(new)
            at, last = int(keys[-1]), (v[-1], m[-1])
            keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, f.astype(np.int64).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1]))
            held_keys, held_fps = keys[whole:], fps[whole:]
            if whole:
                yield links(keys[:whole], fps[:whole])
        if held_keys.size:
            yield links(held_keys, held_fps)

    return sorted_variants.select("variant", "masked", "fp").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id, root.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest id reachable over links, itself included
    (null ids are smaller than none: a component of null ids only has null).
    Null and repeated ids can name several components; root, a fingerprint of
    the component, names one.
    Repeated rows are rows of their own; an empty table gives an empty result;
    columns besides the id and the text are ignored.
    """
    marked = cut(fingerprints(docs, shingle, id_col, text_col))
    # A number of partitions that adaptive execution does not lower: every row becomes 64 below.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    combined = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = cut(combined.repartition(parts, "fp"))
    roots = cut(components(near_links(distinct.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root"))
    least = distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("linked"))
    of_fp = roots.join(least, "root").select("fp", "root", "linked")
    component = cut(
        distinct.join(of_fp, "fp", "left").select(
            "fp", "n", F.coalesce("linked", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")
        )
    )
    # Fewer than HOT fingerprints have more than a share of 1 / HOT of the rows: they go to the rows, which stay where they are.
    rows = component.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(component.where(F.col("n") * HOT > rows).drop("n"))
    cold = component.where(F.col("n") * HOT <= rows).drop("n")
    rest = marked.join(hot.select("fp"), "fp", "left_anti")
    return marked.join(hot, "fp").unionByName(rest.join(cold, "fp")).select("doc_id", "fp", "component_id", "root")


def hex_of(fp: str = "fp"):
    """The 64 bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest id; all columns stay as they are.

    Where that id is repeated within its group, one of its rows stays; of a group of null ids, one row.
    """
    groups = near_groups(docs, shingle, max_bits, id_col, text_col)
    kept = cut(
        groups.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stay"))
        .where("stay > 0")
    )
    kid = free_name(docs, "_kept")

    def rows_of(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select(F.col("doc_id").alias(kid))
        return docs.join(chosen, docs[id_col].eqNullSafe(chosen[kid]), "left_semi")

    out = rows_of(kept.where("n = 1 and doc_id is not null"))
    if not (repeated := kept.where("n > 1 or doc_id is null")).isEmpty():
        out = out.unionByName(_one_of_repeated(docs, rows_of(repeated), shingle, id_col, text_col, groups))
    return out


def _one_of_repeated(docs, rows, shingle, id_col, text_col, groups) -> DataFrame:
    """Of rows that share an id, one for each group that keeps this id: the one of the least text digest."""
    fp, comp, root, text = (free_name(docs, c) for c in ("_fp", "_component", "_root", "_digest"))

    def run(batches):
        for batch in batches:
            found = [fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column(text_col)]
            yield batch.append_column(fp, pa.array(np.array(found, dtype=np.uint64).view(np.int64)))

    marked = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(fp, T.LongType())]))
    group = groups.groupBy(F.col("fp").alias(fp)).agg(F.min("component_id").alias(comp), F.min("root").alias(root))
    marked = marked.join(group, fp).where(F.col(id_col).eqNullSafe(F.col(comp)))
    marked = marked.withColumn(text, F.sha2(text_of(text_col).cast("binary"), 256))
    # Not by component_id: null and repeated ids name several components.
    of_root, least_text = free_name(marked, "_of_root"), free_name(marked, "_least")
    least = marked.groupBy(F.col(root).alias(of_root)).agg(F.min(text).alias(least_text))
    chosen = marked.join(least, (F.col(root) == F.col(of_root)) & (F.col(text) == F.col(least_text)), "left_semi")
    return chosen.dropDuplicates([root]).select(*docs.columns)
