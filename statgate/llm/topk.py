"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into document-range blocks as they are read. A block is a
forward index (its rows, dense) and, for every term, that is dimension, the
largest and the smallest value in the block. For a query, the sum over terms
of weight times the extreme that helps it bounds every score in the block. A
task gets a batch of queries and a group of blocks; each query takes the
blocks in the order of their bounds and scores them through the forward index
until the next bound falls below its k-th score. Queries meet blocks in a grid
of bounded cells; each cell returns k rows a query, of which the best k stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statgate.llm.common import cut

BLOCK_ROWS = 512
CELL_BLOCKS = 24  # blocks in a cell, about
QUERY_ROWS = 256  # queries in a batch
CELL_BATCHES = 8  # batches in a cell, about
EXACT = 2.0**53


def _valid(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): rows with an id and a vector of finite components only, x the integer vector as doubles."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    fine = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(
        F.col(id_col).cast("long").alias("id"), x.alias("x")
    )


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows padded with zeros to the longest."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), max(1, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = values
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` consecutive rows: key, n, dims, ids and rows as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = _matrix(part.column(1))
                ids = part.column(0).to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh64_intdigest(ids.tobytes() + x.tobytes()) >> 1], pa.int64()),
                        pa.array([x.shape[0]], pa.int32()),
                        pa.array([x.shape[1]], pa.int32()),
                        pa.array([ids.tobytes()], pa.binary()),
                        pa.array([x.astype("<f8").tobytes()], pa.binary()),
                    ],
                    names=["key", "n", "dims", "ids", "rows"],
                )

    return rows.mapInArrow(run, "key long, n int, dims int, ids binary, rows binary")


def _load(frame: pd.DataFrame, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for n, d, ids, rows in zip(frame["n"], frame["dims"], frame["ids"], frame["rows"], strict=True):
        x = np.zeros((n, dims))
        x[:, :d] = np.frombuffer(rows, dtype="<f8").reshape(n, d)
        out.append((np.frombuffer(ids, dtype="<i8"), x))
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products. Beyond the range where doubles are exact, Python integers count (cut to 64 bits)."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return q @ x.T
    exact = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
    return np.array([[min(max(s, -(2**63)), 2**63 - 1) for s in row] for row in exact], dtype=object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, then smaller id."""
    if scores.size > 4 * k and scores.dtype != object:
        kth = np.partition(scores, scores.size - k)[scores.size - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(scores.size)
    return some[np.lexsort((ids[some], [-s for s in scores[some].tolist()]))][:k]


def search_cell(queries: list, blocks: list, k: int) -> tuple[list, int]:
    """Per query row: (query id, its row in the cell, scores, ids); and how many query-block pairs were scored."""
    q_ids = np.concatenate([ids for ids, _ in queries])
    q = np.concatenate([x for _, x in queries])
    high = np.stack([x.max(axis=0) for _, x in blocks])
    low = np.stack([x.min(axis=0) for _, x in blocks])
    # Sums of doubles may round beyond 2**53; the margin keeps the bounds above every score.
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bounds += np.abs(bounds) * 1e-9
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = [(np.empty(0), np.empty(0, dtype=np.int64))] * len(q_ids)
    kth = np.full(len(q_ids), -np.inf)
    alive, scored = np.arange(len(q_ids)), 0
    for turn in range(len(blocks)):
        block = order[alive, turn]
        keep = bounds[alive, block] >= kth[alive]  # bounds fall from turn to turn
        alive, block = alive[keep], block[keep]
        if not alive.size:
            break
        for b in np.unique(block):
            mine = alive[block == b]
            ids, x = blocks[b]
            scores = _scores(q[mine], x)
            scored += mine.size
            for row, s in zip(mine.tolist(), scores, strict=True):
                other = ids != q_ids[row]
                if scores.dtype != object:
                    other &= s >= kth[row]
                if not other.any():
                    continue
                all_s, all_i = np.concatenate([found[row][0], s[other]]), np.concatenate([found[row][1], ids[other]])
                best = _best(all_s, all_i, k)
                found[row] = all_s[best], all_i[best]
                if best.size == k:
                    kth[row] = float(all_s[best[-1]])
    return [(int(q_ids[i]), i, *found[i]) for i in range(len(q_ids))], scored


def top_k(
    rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by ``every``.

    Components become floor(scale * component). Ties go to the smaller id.
    Rows without an id, with a null vector or with a null or non-finite
    component take no part. Shorter vectors end in zeros. Every other row
    counts, repeated ones as often as they come; rows that repeat the query's
    id are the query's own. A query row that is repeated is answered once.
    """
    valid = _valid(rows, id_col, vector_col, scale)
    blocks = cut(_blocks(valid, BLOCK_ROWS))
    queries = cut(_blocks(valid.where(F.col("id") % every == 0).distinct(), QUERY_ROWS))
    block_groups = max(1, -(-blocks.count() // CELL_BLOCKS))
    query_groups = max(1, -(-queries.count() // CELL_BATCHES))

    def spread(df: DataFrame, own: str, own_groups: int, other: str, other_groups: int) -> DataFrame:
        """Each row in one group of its own kind and in all of the other's: a grid, in place of a join."""
        return df.withColumns(
            {own: F.pmod(F.xxhash64("key"), F.lit(own_groups)), other: F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1)).cast("array<bigint>"))}
        )

    left = spread(queries, "qg", query_groups, "bg", block_groups)
    right = spread(blocks, "bg", block_groups, "qg", query_groups)

    def cell(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query_batch", "query_place", "vec_id", "score"]
        if q.empty or b.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        dims = int(max(q["dims"].max(), b["dims"].max()))
        q = q.sort_values("key")
        keys = np.repeat(q["key"].to_numpy(), q["n"].to_numpy())
        inner = np.concatenate([np.arange(n) for n in q["n"]])
        found, _ = search_cell(_load(q, dims), _load(b, dims), k)
        out = [(i, keys[row], inner[row], v, int(s)) for i, row, scores, ids in found for s, v in zip(scores, ids, strict=True)]
        return pd.DataFrame(out, columns=names).astype("int64")

    found = (
        left.groupBy("qg", "bg").cogroup(right.groupBy("qg", "bg")).applyInPandas(cell, "query_id long, query_batch long, query_place long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "query_batch", "query_place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
