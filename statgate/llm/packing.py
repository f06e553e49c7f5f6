"""Best-fit packing of token sequences, online and in bounded space.

Pieces stream past a packer that holds a fixed number of open bins in a bitset
keyed by free space: one shift and one lowest-set-bit find the tightest bin
that takes the next piece. When all bins are open and none fits, the fullest
closes first. Tasks take equal random shares of the pieces, in the order of a
hash, and pack them on their own as they come: in a random order short pieces
are always about to come, so the fullest of many open bins has little left to
gain and closing it costs little. A share holds enough pieces for the loss at
its end, a few partly filled bins, not to matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statgate.llm import bpe
from statgate.llm.common import cut, free_name

SHARE = 32_768  # pieces a task packs
OPEN_BINS = 1024


class Packer:
    """Bins of ``capacity``, at most ``open_bins`` of them open."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free_bits ^= 1 << free
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``capacity`` tokens."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, its ids.

    A document is the token ids of its text (null: empty) and ``end_id``; only
    documents longer than ``capacity`` are cut, into pieces of ``capacity``
    and a rest. Repeated rows and null ids are documents of their own. An
    empty table gives an empty result.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            at = 0
            for texts in bpe.portions(batch.column(1)):
                owner, number, start, length, crc, tokens = [], [], [], [], [], []
                for i, found in enumerate(encoder.encode_many(texts)):
                    whole = np.append(found, np.uint32(end_id)).astype("<u4")
                    for n, s in enumerate(range(0, whole.size, capacity)):
                        part = whole[s : s + capacity]
                        owner.append(at + i)
                        number.append(n)
                        start.append(s)
                        length.append(part.size)
                        crc.append(zlib.crc32(part.tobytes()))
                        if ids:
                            tokens.append(part.astype(np.int64))
                at += len(texts)
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                columns += [pa.array(tokens, pa.list_(pa.int64()))] if ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int, length_col: str = "length", open_bins: int = OPEN_BINS, share: int = SHARE) -> DataFrame:
    """``items`` with sequence_id and offset: no sequence over ``capacity``, offsets gapless from 0.

    ``items`` is cut by a checkpoint, so that a lost task packs the same
    share again. Every length must be 1 to ``capacity``. Other columns stay;
    existing columns named sequence_id or offset are replaced.
    """
    items = cut(items.drop("sequence_id", "offset"))
    tasks = max(1, -(-items.count() // share))
    # A third of all rows may be equal: what is left after the columns are hashed is spread by row number.
    number = free_name(items, "_row")
    shares = (
        items.withColumn(number, F.monotonically_increasing_id())
        .repartition(tasks, F.xxhash64(number))
        .withColumn("sequence_id", F.spark_partition_id().cast("long") * F.lit(1 << 32))
        .withColumn("offset", F.lit(0).cast("long"))
        .sortWithinPartitions(F.xxhash64(number))
        .drop(number)
    )
    length_at = shares.columns.index(length_col)

    def run(batches):
        packer = Packer(capacity, open_bins)
        for batch in batches:
            lengths = batch.column(length_at).to_pylist()
            found = [packer.put(n) for n in lengths]
            sequence = np.array([s for s, _ in found], dtype=np.int64) + batch.column(batch.num_columns - 2).to_numpy()
            offset = np.array([o for _, o in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], schema=batch.schema)

    return shares.mapInArrow(run, shares.schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents (see ``pieces``) with their sequence and place in it."""
    return pack(pieces(docs, path, capacity, id_col, text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): token ids of each sequence, from packed pieces that carry their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
