"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes slide over the whole
document; each filter's largest response within every chunk of two blocks
(chunks overlap by one block, so they cover every byte) feeds a small dense
layer; the largest value of each hidden unit over all chunks is combined into
one logistic probability. Long documents pass in pieces that share a block, so
memory is bounded by a piece.

The network is fitted on the driver on a bounded sample of labelled rows (see
``Bounds``), weighted back to the labels' own frequencies; its weights, a few
kilobytes, travel with the scoring tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statgate.llm.common import cut, text_of

WIDTH, STEP = 8, 2  # bytes a filter sees, bytes between its places
BLOCK = 128  # bytes; a chunk is two blocks
PIECE = 512 * BLOCK  # bytes of a document taken at a time
DIM, FILTERS, HIDDEN = 8, 32, 16
PAD = 256
LEAST_STEPS = 400
PLACES = BLOCK // STEP


@dataclass(frozen=True)
class Bounds:
    """What fitting may take: rows of each label, short rows of each label besides, bytes of a row, passes."""

    rows_per_label: int = 1500
    short_rows: int = 500
    short_bytes: int = 200
    row_bytes: int = 16_384
    passes: int = 14


@dataclass
class Net:
    embed: np.ndarray  # (257, DIM)
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    filter_bias: np.ndarray
    dense: np.ndarray  # (FILTERS, HIDDEN)
    dense_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray  # (1,)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.dense, self.dense_bias, self.out, self.out_bias]


def fresh(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Net(
        normal(257, DIM, scale=0.5),
        normal(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, scale=HIDDEN**-0.5),
        np.zeros(1, np.float32),
    )


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte numbers of all pieces, padded to whole blocks; blocks per piece; the document of each piece; whether it ends there."""
    parts, blocks, owner, final = [], [], [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text, dtype=np.uint8)
        for start in range(0, max(1, data.size), PIECE):
            ends = data.size <= start + PIECE
            piece = data[start : start + PIECE + (0 if ends else BLOCK + WIDTH)]
            n = max(2, -(-(piece.size + WIDTH) // BLOCK))
            padded = np.full(n * BLOCK, PAD, dtype=np.int64)
            padded[: piece.size] = piece
            parts.append(padded)
            blocks.append(n)
            owner.append(i)
            final.append(ends)
    return np.concatenate(parts), np.array(blocks), np.array(owner), np.array(final)


def _windows(net: Net, codes: np.ndarray) -> np.ndarray:
    """(places, WIDTH * DIM): the embedded bytes that each filter place sees."""
    flat = net.embed[np.append(codes, np.full(WIDTH, PAD))]
    places = codes.size // STEP
    return np.lib.stride_tricks.as_strided(
        flat, (places, WIDTH * DIM), (flat.strides[0] * STEP, flat.strides[1]), writeable=False
    )


def _chunks(blocks: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each chunk, and the piece it belongs to. What follows a piece's shared block is the next piece's."""
    ends = np.cumsum(blocks)
    first = np.arange(ends[-1])
    piece = np.repeat(np.arange(blocks.size), blocks)
    inside = first < (ends - np.where(final, 1, 2))[piece]
    return first[inside], piece[inside]


def _mask_crossing(found: np.ndarray, blocks: np.ndarray, start: int = 0) -> None:
    """Filter places at the padded end of a piece that reach into the next one count for nothing."""
    last = np.cumsum(blocks) - 1 - start
    last = last[(last >= 0) & (last < found.shape[0])]
    found[last, PLACES - (WIDTH // STEP - 1) :] = -np.inf


def logits(net: Net, texts: list[bytes]) -> np.ndarray:
    """One logit per text, over its whole length."""
    codes, blocks, owner, final = _layout(texts)
    pooled = np.empty((codes.size // BLOCK, FILTERS), dtype=np.float32)
    step = 256  # blocks at a time keep the windows in cache
    for at in range(0, pooled.shape[0], step):
        part = codes[at * BLOCK : (at + step) * BLOCK + WIDTH]
        n = min(step, pooled.shape[0] - at)
        found = (_windows(net, part)[: n * PLACES] @ net.filters).reshape(n, PLACES, FILTERS)
        _mask_crossing(found, blocks, at)
        pooled[at : at + n] = found.max(axis=1)
    first, piece = _chunks(blocks, final)
    chunk = np.maximum(pooled[first], pooled[first + 1]) + net.filter_bias
    hidden = np.maximum(chunk, 0) @ net.dense + net.dense_bias
    document = owner[piece]
    starts = np.flatnonzero(np.concatenate(([True], document[1:] != document[:-1])))
    return np.maximum.reduceat(hidden, starts) @ net.out + net.out_bias[0]


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(net, texts).astype(np.float64), -30, 30)))


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], float]:
    codes, blocks, owner, final = _layout(texts)
    windows = _windows(net, codes)
    found = (windows @ net.filters).reshape(-1, PLACES, FILTERS)
    _mask_crossing(found, blocks)
    place = found.argmax(axis=1)
    pooled = np.take_along_axis(found, place[:, None], axis=1)[:, 0]
    place += np.arange(place.shape[0])[:, None] * PLACES
    first, piece = _chunks(blocks, final)
    later = pooled[first + 1] > pooled[first]
    chunk = np.where(later, pooled[first + 1], pooled[first]) + net.filter_bias
    place = np.where(later, place[first + 1], place[first])
    active = np.maximum(chunk, 0)
    hidden = active @ net.dense + net.dense_bias
    document = owner[piece]
    starts = np.flatnonzero(np.concatenate(([True], document[1:] != document[:-1])))
    ends = np.append(starts[1:], document.size)
    best = np.stack([s + hidden[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
    top = np.take_along_axis(hidden, best, axis=0)
    p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.out_bias[0], -30, 30)))
    loss = float(-(weights * np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum())

    d_logit = ((p - labels) * weights).astype(np.float32)
    d_top = d_logit[:, None] * net.out
    d_hidden = np.zeros_like(hidden)
    np.add.at(d_hidden, (best, np.arange(HIDDEN)), d_top)
    rows = np.unique(best)
    d_hidden = d_hidden[rows]
    d_chunk = (d_hidden @ net.dense.T) * (chunk[rows] > 0)
    at = place[rows]
    d_filters = np.empty_like(net.filters)
    d_bytes = np.zeros((257, DIM), dtype=np.float32)
    for f in range(FILTERS):
        d_filters[:, f] = d_chunk[:, f] @ windows[at[:, f]]
    for w in range(WIDTH):
        code = np.append(codes, np.full(WIDTH, PAD))[at * STEP + w]
        for k in range(DIM):
            share = d_chunk * net.filters[w * DIM + k]
            d_bytes[:, k] += np.bincount(code.ravel(), weights=share.ravel(), minlength=257).astype(np.float32)
    return [d_bytes, d_filters, d_chunk.sum(axis=0), active[rows].T @ d_hidden, d_hidden.sum(axis=0), top.T @ d_logit, d_logit.sum(keepdims=True)], loss


def fit(texts: list[bytes], labels: list[int], weights: list[float], passes: int, seed: int = 7, batch: int = 32) -> Net:
    """Adam on the weighted log loss. No rows: a network that answers by its bias only."""
    net, rng = fresh(seed), np.random.default_rng(seed)
    y, w = np.array(labels, dtype=np.float32), np.array(weights, dtype=np.float32)
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.out_bias[:] = 4.0 if 0 not in labels else -4.0
        return net
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    batches = -(-len(texts) // batch)
    passes = max(passes, -(-LEAST_STEPS // batches))  # few rows are gone over more often
    step, steps = 0, passes * batches
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            gradients, _ = _gradients(net, [texts[i] for i in some], y[some], w[some] / w[some].sum())
            step += 1
            rate = 6e-3 * min(1, step / 20) * (1 - 0.95 * step / steps)
            for a, g, m, v in zip(net.arrays(), gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net:
    """A network for P(label = 1) from a bounded sample of labelled rows, drawn by a hash of the id.

    Of each label at most ``bounds.rows_per_label`` rows are taken, and
    ``bounds.short_rows`` more of under ``bounds.short_bytes`` bytes, so that
    short texts are known as well. Rows that are held out, without id or label,
    or of over ``bounds.row_bytes`` bytes are not fitted on. An id that is
    labelled both ways counts as 0; of repeated ids any row may be drawn.
    """
    marked = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"))
    )
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    size = rows.select("id", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= bounds.row_bytes)
    sized = cut(marked.join(size, "id").withColumn("order", F.xxhash64("id")))
    drawn = None
    for y in (0, 1):
        for short, most in ((False, bounds.rows_per_label), (True, bounds.short_rows)):
            some = sized.where((F.col("label") == y) & (F.col("bytes") < (bounds.short_bytes if short else bounds.row_bytes + 1)))
            some = some.orderBy("order", "id").limit(most).select("id", "label")
            drawn = some if drawn is None else drawn.unionByName(some)
    drawn = drawn.distinct()  # at most 2 * (rows_per_label + short_rows) ids
    got = rows.where(F.octet_length("text") <= bounds.row_bytes).join(F.broadcast(drawn), "id").dropDuplicates(["id"]).collect()
    got.sort(key=lambda r: r["id"])
    of_label = {r["label"]: r["n"] for r in sized.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {y: of_label.get(y, 0) / max(1, sum(r["label"] == y for r in got)) for y in (0, 1)}
    return fit([bytes(r["text"]) for r in got], [r["label"] for r in got], [weight[r["label"]] for r in got], bounds.passes)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row; null text counts as empty and is scored like any other, ids may be null or repeat."""

    def run(batches):
        for batch in batches:
            texts, out, size = [], [], 0
            for value in batch.column(1):
                texts.append(value.as_py())
                size += len(texts[-1]) + 2 * BLOCK
                if size > 4 * PIECE:
                    out.append(probabilities(net, texts))
                    texts, size = [], 0
            if texts:
                out.append(probabilities(net, texts))
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, net: Net, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)
    kind = docs.schema

    def run(batches):
        for batch in batches:
            keep, texts, size = [], [], 0
            for value in batch.column(at):
                texts.append((value.as_py() or "").encode("utf-8"))
                size += len(texts[-1]) + 2 * BLOCK
                if size > 4 * PIECE:
                    keep.append(probabilities(net, texts) >= threshold)
                    texts, size = [], 0
            if texts:
                keep.append(probabilities(net, texts) >= threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, kind)
