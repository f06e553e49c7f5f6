"""Centroid clustering of integer vectors over a VA-file.

Every vector is kept twice in its row: as the *approximation*, the number of
one of ``2 ** BITS`` equal cells for each dimension plus the vector's squared
length, and in full. To find the nearest centroid a task looks up, for every
dimension and cell, the least and the largest that the squared distance less
the squared length can be (``c * c - 2 * x * c`` over the cell), and adds up
the dimensions: an interval that holds the distance to that centroid. Only
centroids whose interval begins at or below the least end of all intervals can
be nearest. Where one is left, the vector is assigned by its approximation
alone; only where intervals overlap is the full vector fetched, and measured
against the centroids that are left.

Rounds move only sums: a task adds up its vectors by cluster, and k times
(dimensions + 1) numbers reach the driver, whatever the table's size.
All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statgate.llm.common import cut

BITS = 6
LIMIT = 2**26  # of a scaled component, so that squared distances and their sums are exact
CHUNK = 4096  # vectors looked up at once


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x): the vectors of ``dims`` components, none null, non-finite or beyond ``LIMIT`` when scaled."""
    v = F.col(f"`{vector_col}`")
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale <= LIMIT)
    )
    return rows.where(v.isNotNull() & (F.size(v) == dims)).where(fine).select(
        F.col(f"`{id_col}`").alias("id"), scaled.cast("array<int>").alias("x")
    )


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:id``; null ids last, equal ids by components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    picked = vectors.select(h.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in picked], dtype=np.int64)


class Cells:
    """Equal cells along every dimension, from the least to the largest value of the whole table."""

    def __init__(self, least: np.ndarray, largest: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.least = least
        self.width = np.maximum(1, -(-(largest - least + 1) // 2**bits))

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of the rows of ``x``, ``bits`` bits each."""
        cells = ((x - self.least) // self.width).astype(np.uint8)
        bit_rows = (cells[:, :, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8)) & 1
        return np.packbits(bit_rows.reshape(len(x), -1), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1, count=len(self.least) * self.bits).reshape(len(packed), len(self.least), self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[dimension, cell, centroid]: least and largest of c * c - 2 * x * c over the cell's x."""
        start = self.least[:, None] + np.arange(2**self.bits) * self.width[:, None]
        ends = np.stack([start, start + self.width[:, None] - 1])  # both ends, dimension, cell
        c = centroids.T[None, :, None, :]
        value = c * c - 2 * ends[:, :, :, None] * c
        return value.min(axis=0), value.max(axis=0)


def nearest(
    packed: np.ndarray, fetch: Callable[[np.ndarray], np.ndarray], cells: Cells, centroids: np.ndarray
) -> tuple[np.ndarray, int]:
    """Nearest centroid (ties: smaller number) of every approximation, and how many vectors were fetched."""
    low_table, high_table = cells.tables(centroids)
    found = np.empty(len(packed), dtype=np.int64)
    fetched = 0
    for at in range(0, len(packed), CHUNK):
        number = cells.unpack(packed[at : at + CHUNK])
        low = np.zeros((len(number), len(centroids)), dtype=np.int64)
        high = np.zeros_like(low)
        for d in range(number.shape[1]):
            low += low_table[d][number[:, d]]
            high += high_table[d][number[:, d]]
        left = low <= high.min(axis=1)[:, None]
        found[at : at + CHUNK] = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_rows):
            fetched += len(open_rows)
            row, centroid = np.nonzero(left[open_rows])
            full = fetch(at + open_rows)
            off = full[row] - centroids[centroid]
            measured = np.full((len(open_rows), len(centroids)), np.iinfo(np.int64).max)
            measured[row, centroid] = (off * off).sum(axis=1)
            found[at + open_rows] = measured.argmin(axis=1)
    return found, fetched


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``width`` bytes."""
    column = column.cast(pa.binary())
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset] if len(column) else 0
    return data[start : start + len(column) * width].reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def approximate(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(id, cells, full): the VA-file, each vector's approximation beside its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(cells.pack(x)), _binary(x.astype("<i4"))], names=["id", "cells", "full"])

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {id_type}, cells binary, full binary")


def _assigned(batch: pa.RecordBatch, cells: Cells, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster of each row, all components, and how many rows the approximation left open."""
    dims = centroids.shape[1]
    packed = _bytes_of(batch.column(batch.schema.get_field_index("cells")), -(-dims * cells.bits // 8))
    full = _bytes_of(batch.column(batch.schema.get_field_index("full")), dims * 4)
    components = full.view("<i4")
    found, fetched = nearest(packed, lambda rows: components[rows].astype(np.int64), cells, centroids)
    return found, components, fetched


def _sums(file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total) of one assignment; dim -1 counts vectors, dim -2 those that were fetched."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 2), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                found, components, fetched = _assigned(batch, cells, centroids)
                order = np.argsort(found, kind="stable")
                present, at = np.unique(found[order], return_index=True)
                total[present, 2:] += np.add.reduceat(components[order], at, axis=0, dtype=np.int64)
                total[present, 1] += np.diff(np.append(at, len(order)))
                total[0, 0] += fetched
        cluster, dim = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster.ravel().astype(np.int32)), pa.array((dim.ravel() - 2).astype(np.int32)), pa.array(total.ravel())],
            names=["cluster", "dim", "total"],
        )

    parts = file.mapInArrow(run, "cluster int, dim int, total long")
    return parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"))


def _distances(file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of the last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, components, _ = _assigned(batch, cells, centroids)
                off = components.astype(np.int64) - centroids[found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found.astype(np.int32)), pa.array((off * off).sum(axis=1))], names=["id", "cluster", "distance"]
                )

    id_type = file.schema["id"].dataType.simpleString()
    return file.mapInArrow(run, f"id {id_type}, cluster int, distance long")


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean; an empty one stays."""
    out = centroids.copy()
    for c in range(len(centroids)):
        n = sums.get((c, -1), 0)
        if n:
            out[c] = [sums[c, d] // n for d in range(centroids.shape[1])]
    return out


def fit(vectors: DataFrame, file: DataFrame, cells: Cells, k: int, rounds: int, seed: int) -> tuple[np.ndarray, list[float]]:
    """Centroids after ``rounds`` rounds, and the share of vectors that each round had to fetch."""
    centroids = first_centroids(vectors, k, seed)
    shares = []
    for _ in range(rounds):
        sums = {(r["cluster"], r["dim"]): r["total"] for r in _sums(file, cells, centroids).collect()}  # k * (dims + 2) rows
        shares.append(sums.get((0, -2), 0) / max(1, sum(n for (_, d), n in sums.items() if d == -1)))
        centroids = moved(centroids, sums)
    return centroids, shares


def cluster(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, seed: int = 2
) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector.

    Null vectors, those of another length, and those with null or non-finite
    components or components beyond ``LIMIT / scale`` take no part; the last
    bound keeps every squared distance in a long. A null id is kept but starts
    no centroid while others can. Repeated ids are vectors of their own; equal
    vectors get equal clusters. With fewer than ``k`` vectors there are as many
    centroids, and an empty table gives no rows. Other columns take no part,
    whatever their names.
    """
    vectors = integer_vectors(rows, id_col, vector_col, dims, scale)
    ends = vectors.agg(*[f(F.col("x")[d]) for f in (F.min, F.max) for d in range(dims)]).first()
    out = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    name = f"_{id_col}" if id_col.lower() in out else id_col
    if ends[0] is None:
        ddl = f"`{name}` {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], ddl)
    cells = Cells(np.array(ends[:dims], dtype=np.int64), np.array(ends[dims:], dtype=np.int64))
    file = cut(approximate(vectors, cells))
    centroids, _ = fit(vectors, file, cells, k, rounds, seed)
    placed = cut(_distances(file, cells, centroids))
    by_cluster = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    texts = [(c, by_cluster.get(c, 0), ",".join(map(str, row))) for c, row in enumerate(centroids.tolist())]
    known = rows.sparkSession.createDataFrame(texts, "cluster int, cluster_inertia long, components string")
    known = known.select("cluster", "cluster_inertia", F.sha2("components", 256).alias("centroid_sha256"))  # k rows
    joined = placed.join(F.broadcast(known), "cluster")
    total: Column = F.lit(sum(by_cluster.values())).cast("long")
    return joined.select(F.col("id").alias(name), "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
