"""Sharding by k-d tree partitioning, with DataFrame operations only.

The rows' metadata (size, source, language) are split recursively at weighted
medians along the dimension that is widest in the node, until every leaf holds
the target bytes. A node of k leaves is split in the proportion k//2 to the
rest. Medians are found in the cluster: one aggregate per pass gives, for all
nodes of a level at once, a histogram of bytes over a dimension; the bucket
that holds the median is refined by the next pass. Rows that are equal in the
dimension are split by text checksum, then id hash, then row number, so that a
value that a third of all rows share is no obstacle and equal texts part only
where a boundary falls among them. Rows never move for this; what reaches the
driver is at most ``BUCKETS`` sums per node.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statgate.llm.common import cut, text_of
from statgate.llm.merkle import numbered

BUCKETS = 2048
DRIVER_ROWS = 1 << 16  # sums that reach the driver in one pass
EXACTNESS = 1024  # a split may be off by a leaf's bytes over this, or by one row
SLOT_GROUP = 50_000  # rows numbered in one task
ROW_BYTES = 16  # counted for a row besides its text
DIMENSIONS = ("size", "source_code", "lang_code")
TIES = ("text_crc32", "id_hash", "row")


def _with_code(base: DataFrame, value: str, code: str) -> DataFrame:
    """``base`` with the rank of the string ``value`` among its distinct values as ``code``, null first; ``value`` goes.

    Ranks come from the whole strings, however long they agree, and from as
    many tasks as the values fill (``numbered``).
    """
    values = base.where(F.col(value).isNotNull()).select(F.lit("").alias("tree"), F.col(value).alias("value")).distinct()
    ranks = numbered(values, ["value"]).select("value", F.col("pos").alias("rank"))
    ranked = base.join(ranks, F.col(value) == F.col("value"), "left")
    return ranked.withColumn(code, F.coalesce("rank", F.lit(-1).cast("long"))).drop("value", "rank", value)


@dataclass
class Node:
    """A node of the tree; nodes are numbered as in a heap, the root is 1."""

    leaves: int
    rows: int = 0
    total: int = 0
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    dimension: int = -1  # of its split; -1: not split
    bound: tuple[int, ...] = ()  # rows whose (dimension, ties) are less go left
    # of the search for the bound
    fixed: tuple[int, ...] = ()
    range: tuple[int, int] = (0, 0)
    wanted: int = 0  # bytes to find from the start of the range on
    searching: bool = False


Tree = dict[int, Node]


def _by_node(tree: Tree, of) -> Column:
    """Looks up a number for the row's node."""
    return F.get(F.lit([int(of(tree[i])) if i in tree else 0 for i in range(max(tree) + 1)]).cast("array<bigint>"), F.col("node"))


def _of_dimension() -> Column:
    out = F.col(DIMENSIONS[-1])
    for i in reversed(range(len(DIMENSIONS) - 1)):
        out = F.when(F.col("dimension") == i, F.col(DIMENSIONS[i])).otherwise(out)
    return out


def _step_down(base: DataFrame, tree: Tree) -> DataFrame:
    """``base`` with each row one level further down, if its node is split."""
    out = base.withColumns(
        {"dimension": _by_node(tree, lambda n: n.dimension)}
        | {f"b{k}": _by_node(tree, lambda n, k=k: n.bound[k] if k < len(n.bound) else 0) for k in range(4)}
    )
    less, equal = F.lit(False), F.lit(True)
    for k, key in enumerate((_of_dimension(), *map(F.col, TIES))):
        less |= equal & (key < F.col(f"b{k}"))
        equal &= key == F.col(f"b{k}")
    down = 2 * F.col("node") + F.when(less, 0).otherwise(1)
    node = F.when(F.col("dimension") < 0, F.col("node")).otherwise(down).cast("int")
    return out.select(*[c for c in base.columns if c != "node"], node.alias("node"))


def _measure(base: DataFrame, tree: Tree) -> None:
    spans = [f(d) for d in DIMENSIONS for f in (F.min, F.max)]
    rows = base.groupBy("node").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("total"), *[s.alias(f"s{i}") for i, s in enumerate(spans)]
    )
    for row in rows.collect():  # one row per node
        node = tree[row["node"]]
        node.rows, node.total = row["rows"], row["total"]
        node.low = [row[f"s{2 * i}"] for i in range(len(DIMENSIONS))]
        node.high = [row[f"s{2 * i + 1}"] for i in range(len(DIMENSIONS))]


def _pass(base: DataFrame, tree: Tree, wide: dict[int, int], last: list[int]) -> None:
    """One histogram for every searching node; narrows its range or settles its bound."""
    searching = {i: n for i, n in tree.items() if n.searching}
    buckets = max(16, min(BUCKETS, DRIVER_ROWS // len(searching)))
    placed = base.withColumns(
        {
            "dimension": _by_node({i: Node(1, dimension=wide.get(i, 0)) for i in tree}, lambda n: n.dimension),
            "step": _by_node(tree, lambda n: len(n.fixed) if n.searching else -1),
            "low": _by_node(tree, lambda n: n.range[0]),
            "high": _by_node(tree, lambda n: n.range[1]),
            "width": _by_node(tree, lambda n: (n.range[1] - n.range[0]) // buckets + 1),
        }
        | {f"f{k}": _by_node(tree, lambda n, k=k: n.fixed[k] if k < len(n.fixed) else 0) for k in range(3)}
    )
    placed = placed.where("step >= 0").withColumn("x", _of_dimension())
    keys = ("x", *TIES)
    key = F.col(keys[-1])
    for k in reversed(range(len(keys) - 1)):
        key = F.when(F.col("step") == k, F.col(keys[k])).otherwise(key)
    inside = F.lit(True)
    for k in range(3):
        inside &= (F.col("step") <= k) | (F.col(keys[k]) == F.col(f"f{k}"))
    sums = (
        placed.where(inside)
        .withColumn("key", key)
        .where("key between low and high")
        .groupBy("node", F.expr("(key - low) div width").alias("bucket"))
        .agg(F.sum("size").alias("total"), F.min("key").alias("low"), F.max("key").alias("high"))
    )
    found: dict[int, list] = {}
    for row in sums.collect():  # at most DRIVER_ROWS rows, or 16 per node
        found.setdefault(row["node"], []).append((row["bucket"], row["total"], row["low"], row["high"]))
    for i, node in searching.items():
        below = 0
        for _, total, low, high in sorted(found[i]):
            if below + total >= node.wanted:
                break
            below += total
        enough = total <= max(1, node.total // (node.leaves * EXACTNESS))
        finer = low < high or len(node.fixed) + 1 < len(keys)
        if enough or not finer:
            after = node.wanted - below > below + total - node.wanted
            node.bound, node.searching = (*node.fixed, high + 1 if after else low), False
        else:
            node.wanted -= below
            if low < high:
                node.range = (low, high)
            else:
                node.fixed = (*node.fixed, low)
                node.range = (0, last[len(node.fixed) - 1])


def grow(base: DataFrame, leaves: int) -> tuple[Tree, DataFrame]:
    """The k-d tree over ``base`` (size, the dimensions' codes and the tie columns), and ``base`` with each row's leaf.

    Each level's assignment is cut by a checkpoint: a few numbers per row.
    """
    base = base.withColumn("node", F.lit(1))
    tree: Tree = {1: Node(leaves)}
    last = [2**32 - 1, 2**62 - 1, base.agg(F.max("row")).first()[0] or 0]
    spans: list[int] = []
    while True:
        _measure(base, tree)
        spans = spans or [max(1, h - lo) for lo, h in zip(tree[1].low, tree[1].high, strict=True)] or [1] * len(DIMENSIONS)
        level = {i: n for i, n in tree.items() if n.dimension < 0 and n.leaves > 1}
        if not level:
            return tree, base
        wide = {}
        for i, node in level.items():
            node.bound = (0,)  # an empty node: all of its rows, none, go right
            wide[i] = 0
            if node.rows:
                wide[i] = max(range(len(DIMENSIONS)), key=lambda d: (node.high[d] - node.low[d]) / spans[d])
                node.range, node.searching = (node.low[wide[i]], node.high[wide[i]]), True
                node.wanted = node.total * (node.leaves // 2) // node.leaves
        while any(n.searching for n in level.values()):
            _pass(base, tree, wide, last)
        for i, node in level.items():
            node.dimension = wide[i]
            tree[2 * i], tree[2 * i + 1] = Node(node.leaves // 2), Node(node.leaves - node.leaves // 2)
        base = cut(_step_down(base, tree))


def shard(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Either the number of shards or their target size in bytes is given. Size:
    UTF-8 bytes of the text (null: none) plus 16. Shards differ in size by
    little more than a row; slots are gapless from 0, in no order that means
    anything. Null ids and metadata are values like any other, repeated rows
    are rows of their own, and an empty table gives an empty result. A long
    text counts by its bytes; where one is larger than a shard, its shard is.
    The law is ``bytes``: what another shard would change is not fixed, so
    grown_shard is null. Other columns are ignored, whatever their names.
    """
    text = text_of(text_col).cast("binary")
    base = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.col(source_col).cast("string").alias("source_value"),
            F.col(lang_col).cast("string").alias("lang_value"),
            F.shiftrightunsigned(F.xxhash64(id_col), 2).alias("id_hash"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    base = _with_code(_with_code(base, "source_value", "source_code"), "lang_value", "lang_code")
    if shards is None:
        total = base.agg(F.sum("size")).first()[0] or 0
        shards = max(1, round(total / target_bytes))
    tree, base = grow(base, shards)
    # Leaves are numbered from left to right: by their path from the root.
    leaves = sorted((i for i, n in tree.items() if n.dimension < 0), key=lambda i: f"{i:b}")
    most = max(tree[i].rows for i in leaves)
    groups = max(1, -(-most // SLOT_GROUP))
    shard_of = [leaves.index(i) if i in leaves else 0 for i in range(max(tree) + 1)]
    placed = base.withColumn("shard", F.get(F.lit(shard_of).cast("array<int>"), F.col("node")))
    placed = placed.select(
        "doc_id", "size", "text_crc32", "id_hash", "row", "shard",
        F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"),  # not by id: a third of all rows may share one
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id_hash", "row"))
    return (
        placed.withColumn("inside", inside)
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
