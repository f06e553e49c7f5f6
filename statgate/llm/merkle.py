"""Merkle manifest of a table by streaming aligned append with incremental witnesses.

Rows are the leaves of one tree per group (here per language), ordered by an
id; the groups' roots, ordered by group, are the leaves of one more tree. A
*block* is an aligned run of ``2 ** BLOCK_LEVELS`` nodes of a tree. One task
streams a block's nodes in order: each append puts a subtree of one node on
the stack of open subtrees, and two open subtrees of equal height become one.
When that happens both get the step that proves them from their parent, so a
witness grows each time a later sibling completes, and is kept once for a
whole subtree rather than once for each leaf. Block roots are appended in the
same way to the level above, and so on, until a tree has one node; then every
node's witness is its steps inside its block followed by those of its block.

Only rows of a few digests are moved: texts are hashed where they are read.
A node's place is exact: rows are sorted by range over (group, id, digest) and
numbered within ranges, and ranges get their offset from their counts. A group
of a third of all rows is many blocks, as is one id repeated on many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statgate.llm.common import cut

BLOCK_LEVELS = 12
LEFT, RIGHT, ALONE = "L", "R", "S"  # the sibling stands left, right, or there is none


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Subtree:
    """An open or finished subtree: its height, its digest, and the step that proves it from its parent."""

    __slots__ = ("height", "digest", "step", "parent")

    def __init__(self, height: int, value: str):
        self.height, self.digest = height, value
        self.step: str | None = None
        self.parent: Subtree | None = None


class Append:
    """Appends nodes to one aligned run; witnesses of what is appended grow as siblings complete."""

    def __init__(self):
        self.open: list[Subtree] = []  # by falling height

    def add(self, value: str) -> Subtree:
        node = Subtree(0, value)
        self.open.append(node)
        self._complete()
        return node

    def _complete(self) -> None:
        while len(self.open) > 1 and self.open[-1].height == self.open[-2].height:
            right, left = self.open.pop(), self.open.pop()
            above = Subtree(left.height + 1, digest(left.digest, right.digest))
            left.step, right.step = RIGHT + right.digest, LEFT + left.digest
            left.parent = right.parent = above
            self.open.append(above)

    def _lift(self) -> None:
        """The last open subtree has no sibling at its height: its parent holds it alone."""
        alone = self.open.pop()
        above = Subtree(alone.height + 1, digest(alone.digest))
        alone.step, alone.parent = ALONE, above
        self.open.append(above)

    def close(self, height: int | None) -> Subtree:
        """The root of the run; of exactly ``height`` levels if the run is one of several blocks of its tree."""
        while len(self.open) > 1:
            self._lift()
            self._complete()
        while height is not None and self.open[0].height < height:
            self._lift()
        return self.open[0]


def witnesses(nodes: Sequence[Subtree], tail: Sequence[str]) -> Iterable[list[str]]:
    """Each node's steps to the root of its run, then ``tail``; steps of a subtree are put together once."""
    made: dict[int, list[str]] = {}

    def of(node: Subtree) -> list[str]:
        if id(node) not in made:
            made[id(node)] = list(tail) if node.parent is None else [node.step, *of(node.parent)]
        return made[id(node)]

    return (of(node) for node in nodes)


def _field(name: str) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = F.col(f"`{name}`").cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*fields), 256)


def numbered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, the place inside the tree by ``by``, and ``total``, the tree's number of rows.

    ``by`` ends with a column that differs on every row, so that equal ids do
    not make one range.
    """
    order = ["tree", *by]
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part", F.shiftright("mid", 33))
    within = Window.partitionBy("tree")
    starts = (
        ranged.groupBy("tree", "part")
        .agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("n").over(within))
        .drop("n")
    )
    found = ranged.join(starts, ["tree", "part"])
    return found.withColumn("pos", F.col("mid") - F.col("first") + F.col("before")).drop("mid", "part", "first", "before")


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column("pos").to_numpy(), kind="stable")))


def _append_block(values: Iterable[str], total: int, levels: int) -> tuple[list[Subtree], Subtree]:
    run = Append()
    nodes = [run.add(v) for v in values]
    return nodes, run.close(levels if total > 2**levels else None)


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, total, node) one level of blocks up: the root of every block of ``nodes``."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        total = table.column("total")[0].as_py()
        _, root = _append_block(table.column("node").to_pylist(), total, levels)
        made = {"tree": table.column("tree")[:1], "pos": table.column("block")[:1], "total": [-(-total // 2**levels)], "node": [root.digest]}
        return pa.table(made)

    blocks = nodes.select("tree", "pos", "total", "node", F.shiftright("pos", levels).alias("block"))
    return cut(blocks.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, total long, node string"))


def _extend(nodes: DataFrame, above: DataFrame, levels: int, carry: str) -> DataFrame:
    """``nodes`` with ``path``: each node's steps in its block, then the ``path`` of the block in ``above``.

    ``carry`` names, as DDL, the columns of ``above`` that its blocks' nodes get as well.
    """
    names = [c.split()[0] for c in carry.split(",")] if carry else []
    kept = [f for f in nodes.schema.fields if f.name != "block"]
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["path array<string>"] + ([carry] if carry else []))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _sorted(left)
        tail = right.column("path")[0].as_py()
        made, _ = _append_block(left.column("node").to_pylist(), left.column("total")[0].as_py(), levels)
        out = {f.name: left.column(f.name) for f in kept}
        out["path"] = pa.array(list(witnesses(made, tail)), pa.list_(pa.string()))
        for name in names:
            out[name] = pa.array([right.column(name)[0].as_py()] * left.num_rows, pa.string())
        return pa.table(out)

    blocks = nodes.withColumn("block", F.shiftright("pos", levels))
    tails = above.select("tree", F.col("pos").alias("block"), "path", *names)
    return blocks.groupBy("tree", "block").cogroup(tails.groupBy("tree", "block")).applyInArrow(run, ddl)


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the tables of block roots above them, up to one node for each tree."""
    tables = [nodes]
    while True:
        tables.append(_block_roots(tables[-1], levels))
        if (tables[-1].agg(F.max("total")).first()[0] or 0) <= 1:
            return tables


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    changed: Sequence[Column] | None = None,
    changed_where: Column | None = None,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row of ``rows``: (order, leaf, changed_leaf, subroot, root, path).

    ``path`` holds the steps from the leaf to the root, each the side and the
    digest of the sibling, or ``S`` where a node is alone. ``changed`` gives
    the fields of an altered copy of the row, hashed to ``changed_leaf`` where
    ``changed_where`` holds (null elsewhere), to see a witness refuse it.

    Null groups and ids come first; rows of equal id stand by leaf digest, and
    equal rows by where they were read, which no digest shows. Empty texts are
    ``0:``, null ones ``-``. A long text is hashed in its own row. An empty
    table gives no rows. Columns that are not named take no part, whatever
    their names.
    """
    altered = F.lit(None).cast("string") if changed is None else F.when(changed_where, leaf_digest(changed))
    tree = F.when(F.col(f"`{group}`").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")))
    slim = cut(
        rows.select(
            tree.alias("tree"),
            F.col(f"`{order}`").alias("key"),
            leaf_digest([_field(f) for f in fields]).alias("node"),
            altered.alias("changed_leaf"),
            F.monotonically_increasing_id().alias("read"),
        )
    )
    leaves = numbered(slim, ["key", "node", "read"]).drop("read")
    towers = _climb(leaves, levels)
    subroots = towers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node")
    tops = _climb(numbered(subroots, ["key"]), levels)
    root = tops[-1].select("node").first()

    above = tops[-1].withColumn("path", F.array().cast("array<string>"))
    for table in reversed(tops[:-1]):
        above = _extend(table, above, levels, "")
    above = above.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"))
    for table in reversed(towers[:-1]):
        above = _extend(table, above, levels, "subroot string")
    return above.select(
        F.col("key").alias(order), F.col("node").alias("leaf"), "changed_leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path"
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``path`` leads to from ``leaf``."""

    def step(acc: Column, s: Column) -> Column:
        sibling = F.substring(s, 2, 64)
        joined = F.when(s.startswith(LEFT), F.concat(sibling, acc)).when(s.startswith(RIGHT), F.concat(acc, sibling)).otherwise(acc)
        return F.sha2(joined, 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """Digest of the siblings along ``path``."""
    siblings = F.transform(F.filter(path, lambda s: s != ALONE), lambda s: F.substring(s, 2, 64))
    return F.sha2(F.array_join(siblings, ""), 256)


def tampered_where(order: str = "doc_id") -> Column:
    """Rows whose id's crc32 is divisible by 7; a null id has none."""
    return F.coalesce(F.crc32(F.col(f"`{order}`").cast("string")) % 7 == 0, F.lit(False))


def with_count_plus_one(fields: Sequence[str], counted: str) -> list[Column]:
    """The fields of a copy in which only ``counted`` is one larger; a null stays null."""
    more = (F.col(f"`{counted}`").cast("decimal(38,0)") + 1).cast("string")
    plus = F.when(more.isNull(), "-").otherwise(F.concat(F.octet_length(more).cast("string"), F.lit(":"), more))
    return [plus if f == counted else _field(f) for f in fields]


def audit(rows: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and the root its witness leads to from its present content.

    Rows of ``tampered_where`` are taken as changed after the manifest was
    made, by one in ``n_chars``; ``verified`` tells whether the row still
    belongs to the manifest. Where ``n_chars`` is null nothing was changed.
    """
    made = manifest(
        rows, fields, changed=with_count_plus_one(fields, "n_chars"), changed_where=tampered_where(), levels=levels
    ).withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
