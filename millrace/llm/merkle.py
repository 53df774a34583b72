"""Merkle manifest of a dataset: event-driven combining of child digests, frontiers that reshuffle, reverse links for proofs.

Each group of rows is a tree of its own over its rows in order, and the groups' roots are the leaves of the tree above
them. A node's parent is known from its index, and the parent's arity from the size of the level, so digests may arrive
in any order: a partial parent keeps its children by index, and as soon as it has as many as it must have, it is hashed
and becomes a child itself (`_combine`). A task emits what it can't finish, the frontier, and only that is shuffled, by
the block that it belongs to; in a block every parent is finished.

Levels are taken `SPAN` at a time: the tops of the blocks of one stage are the lowest nodes of the next one, so that
10^10 rows need four stages of ever fewer nodes. On the way down each top hands its own chain of siblings to the nodes
of its block (reverse links), and at the lowest stage a row's chain is hashed as its proof and folded from its leaf as
it is seen now. No task holds more than a block's nodes or a partition's partial parents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import Written

ARITY = 2
#: Levels of a stage: a block has ARITY ** SPAN nodes at most.
SPAN = 10
_NODE = "grp string, i long, n long, digest binary"


def digest(parts: list[Column]) -> Column:
    """sha256 of a row's values: `-` for a null, else UTF-8 byte count, `:`, value."""
    spelt = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in spelt]), 256)


def _hash(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def _above(n: int, arity: int, levels: int) -> int:
    for _ in range(levels):
        n = -(-n // arity)
    return n


def _combine(arity: int, span: int):
    """Nodes (grp, level, i, n, digest) -> those that can't rise within `span` levels from what the task has seen.

    n is the number of nodes at the node's level. State is a partial parent for each gap in the indexes, and what
    is left of them at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, dict[int, bytes]] = {}
        done: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            grp, level, i, n, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(grp), pa.array(level, pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.binary())], ["grp", "level", "i", "n", "digest"])

        for batch in batches:
            for grp, level, i, n, d in zip(*[batch.column(c).to_pylist() for c in ("grp", "level", "i", "n", "digest")], strict=True):
                while level < span:
                    parent = (grp, level, i // arity, n)
                    kids = partial.setdefault(parent, {})
                    kids[i] = d
                    first = parent[2] * arity
                    if len(kids) < min(arity, n - first):
                        break
                    d = _hash([kids[k] for k in sorted(kids)]) if n > 1 else d  # a lone node is its group's root and rises as it is
                    del partial[parent]
                    level, i, n = level + 1, i // arity, -(-n // arity)
                else:
                    done.append((grp, level, i, n, d))
            if len(done) >= 4096:
                yield out(done)
                done = []
        done += [(grp, level, i, n, d) for (grp, level, _, n), kids in partial.items() for i, d in kids.items()]
        if done:
            yield out(done)

    return run


def _tops(nodes: DataFrame, arity: int, span: int) -> Written:
    """The top of each block, as nodes of the next stage."""
    schema = "grp string, level int, i long, n long, digest binary"
    step = _combine(arity, span)
    first = nodes.select("grp", F.lit(0).alias("level"), "i", "n", "digest").mapInArrow(step, schema)
    partly = Written(first, "frontier")
    block = F.floor(F.col("i") / F.pow(F.lit(float(arity)), F.lit(span) - F.col("level"))).cast("long")
    open_ = partly.df.where(F.col("level") < span).repartition("grp", block).mapInArrow(step, schema)
    tops = Written(partly.df.where(F.col("level") == span).union(open_).select("grp", "i", "n", "digest"), "tops")
    partly.drop()
    return tops


def placed(rows: DataFrame, order: list[str]) -> Written:
    """`rows` (grp, ...) with i, place from 0 in the group by `order`, and n, the group's size; in runs of a group's rows.

    Rows are parted by range of group and order, so that a group of any size is dealt to many tasks.
    """
    by = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order]]
    parted = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    ranged = Written(parted.withColumn("_p", F.shiftright("_m", 33)), "ranged")
    runs = ranged.df.groupBy("_p", "grp").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    group = Window.partitionBy("grp").orderBy("_p")  # a row for each part of a group
    runs = runs.select("_p", "grp", (F.coalesce(F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_by"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    out = ranged.df.join(runs, ["_p", "grp"]).withColumn("i", F.col("_m") + F.col("_by")).drop("_m", "_by", "_p")
    out = Written(out.sortWithinPartitions("grp", "i"), "placed")
    ranged.drop()
    return out


def _stages(base: DataFrame, arity: int, span: int) -> list[Written]:
    """Tables of the nodes of each stage above `base`; the last one holds the groups' roots alone."""
    out: list[Written] = []
    most = base.agg(F.max("n")).first()[0] or 1
    while most > 1 or not out:
        out.append(_tops(out[-1].df if out else base, arity, span))
        most = _above(most, arity, span)
    return out


def _local(digests: list[bytes], n: int, first: int, arity: int, span: int) -> list[tuple[bytes, bytes]]:
    """(siblings, shape) of each of a block's nodes up to the block's top. Shape has two bytes a level: siblings before and after."""
    chains = [[b"", b""] for _ in digests]
    own, width, at = list(digests), 1, first
    for _ in range(span):
        if n == 1:
            break
        for k, chain in enumerate(chains):
            j = k // width
            start = (at + j) // arity * arity - at
            run = own[start : start + arity]
            chain[0] += b"".join(run[: j - start] + run[j - start + 1 :])
            chain[1] += bytes([j - start, len(run) - 1 - (j - start)])
        own = [_hash(own[s : s + arity]) for s in range(0, len(own), arity)]
        at, width, n = at // arity, width * arity, -(-n // arity)
    return [tuple(c) for c in chains]


def fold(leaf: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its chain of siblings give."""
    at = 0
    for before, after in zip(shape[::2], shape[1::2], strict=True):
        run = [siblings[k : k + 32] for k in range(at, at + 32 * (before + after), 32)]
        leaf, at = _hash(run[:before] + [leaf] + run[before:]), at + 32 * (before + after)
    return leaf


def _down(nodes: DataFrame, chains: DataFrame, arity: int, span: int, finish, schema: str) -> DataFrame:
    """`finish(block's table, [(siblings, shape) up to the root], subroot, root)` for every block of `nodes`.

    chains: (grp, block, siblings, shape, subroot, root) of each block's top.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("i")
        first, n = left.column("i")[0].as_py(), left.column("n")[0].as_py()
        siblings, shape, subroot, root = (right.column(c)[0].as_py() for c in ("siblings", "shape", "subroot", "root"))
        local = _local(left.column("digest").to_pylist(), n, first, arity, span)
        return finish(left, [(s + siblings, h + shape) for s, h in local], subroot, root)

    block = F.floor(F.col("i") / arity**span).cast("long").alias("block")
    return nodes.select("*", block).groupBy("grp", "block").cogroup(chains.groupBy("grp", "block")).applyInArrow(run, schema)


_CHAIN = "grp string, block long, siblings binary, shape binary, subroot binary, root binary"


def _pass_on(left: pa.Table, chains: list, subroot: bytes, root: bytes) -> pa.Table:
    size = len(chains)
    return pa.Table.from_arrays(
        [left.column("grp"), left.column("i"), pa.array([s for s, _ in chains], pa.binary()), pa.array([h for _, h in chains], pa.binary()), pa.array([subroot] * size, pa.binary()), pa.array([root] * size, pa.binary())],
        ["grp", "block", "siblings", "shape", "subroot", "root"],
    )


def _deliver(left: pa.Table, chains: list, subroot: bytes, root: bytes) -> pa.Table:
    size = len(chains)
    now = [d if seen is None else seen for d, seen in zip(left.column("digest").to_pylist(), left.column("seen").to_pylist(), strict=True)]
    folded = [fold(d, s, h) for d, (s, h) in zip(now, chains, strict=True)]
    proof = [_hash([s]).hex() for s, _ in chains]
    columns = {
        "row": left.column("row"),
        "leaf": pa.array([d.hex() for d in left.column("digest").to_pylist()]),
        "subroot": pa.array([subroot.hex()] * size),
        "root": pa.array([root.hex()] * size),
        "proof_sha256": pa.array(proof),
        "folded_root": pa.array([f.hex() for f in folded]),
        "verified": pa.array([f == root for f in folded]),
        "siblings": pa.array([s for s, _ in chains], pa.binary()),
        "shape": pa.array([h for _, h in chains], pa.binary()),
    }
    return pa.table(columns)


def manifest(rows: DataFrame, leaf: Column, seen: Column, group_col: str = "lang", order_col: str = "doc_id", arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """(order_col, leaf, subroot, root, proof_sha256, folded_root, verified, siblings, shape) of every row.

    `leaf` is the hex digest that the manifest is made of, `seen` the one that is checked against it where it isn't null. Leaves ascend by
    `order_col` in their group, nulls first; rows of one order ascend by leaf, equal ones are leaves of their own. Groups
    ascend bytewise, the null one first. A group of one row has its leaf as subroot; one group's subroot is the root.
    `siblings` are the chain's digests from the leaf up, `shape` how many stand before and after the path at each level.
    An empty table gives no rows; other columns are not read.
    """
    if not 2 <= arity <= 128:
        raise ValueError("arity must be between 2 and 128")
    grp = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    base = placed(rows.select(grp.alias("grp"), F.col(order_col).alias("row"), F.unhex(leaf).alias("digest"), F.unhex(seen).alias("seen")), ["row", "digest"])
    stages = _stages(base.df, arity, span)
    # the groups' roots as leaves of the tree above them
    roots = placed(stages[-1].df.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    upper = _stages(roots.df, arity, span)
    chains = upper[-1].df.select("grp", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("siblings"), F.lit(b"").alias("shape"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for table in (*(t.df for t in reversed(upper[:-1])), roots.df):
        chains = _down(table.select("grp", "i", "n", "digest"), chains, arity, span, _pass_on, _CHAIN)
    named = roots.df.select(F.col("i").alias("block"), "name", F.col("digest").alias("_own"))
    chains = Written(chains.drop("grp", "subroot").join(named, "block").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), "siblings", "shape", F.col("_own").alias("subroot"), "root"), "chains")
    for table in reversed(stages[:-1]):
        lower = Written(_down(table.df, chains.df, arity, span, _pass_on, _CHAIN), "chains")
        chains.drop()
        chains = lower
    for spent in (*stages, *upper, roots):
        spent.drop()
    order_type = rows.schema[order_col].dataType.simpleString()
    schema = f"row {order_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings binary, shape binary"
    return _down(base.df, chains.df, arity, span, _deliver, schema).withColumnRenamed("row", order_col)
