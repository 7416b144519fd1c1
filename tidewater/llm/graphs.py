"""Blocks of groups for all-pairs work, and distributed connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import drop_staged, stage


def cells(members: DataFrame, group: str, member: str, block_rows: int, size: str | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """Members of groups of two or more, dealt into cells of bounded size.

    A group's members fall into hash blocks of about ``block_rows`` rows (and ``block_bytes`` of ``size``);
    a cell is a pair of blocks. A member is sent once to each cell its block is part of, so every
    pair of members meets in exactly one cell, and no task ever holds a whole group.
    Adds lo, hi and own (the member's block), partitioned and sorted by cell.
    """
    totals = members.groupBy(group).agg(F.count("*").alias("_n"), (F.sum(size) if size else F.lit(0)).alias("_bytes")).filter("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / block_rows), F.ceil(F.col("_bytes") / block_bytes)).cast("int")
    dealt = members.join(totals, group).withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other"))
    dealt = dealt.drop("_n", "_bytes", "_blocks", "_other")
    return dealt.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def by_cell(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole cells: a table and the rows at which its cells begin and end.

    ``keys`` leading columns are the cell's key, sorted.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        names = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for x in names:
            change[1:] |= x[1:] != x[:-1]
        first = tuple(x[0] for x in names)
        change[0] = last is not None and first != last
        last = tuple(x[-1] for x in names)
        cuts = np.flatnonzero(change)
        if len(cuts):
            held.append(b.slice(0, int(cuts[-1])))
            yield _edges(pa.Table.from_batches(held), keys)
            held = []
            b = b.slice(int(cuts[-1]))
        held.append(b)
    if held:
        yield _edges(pa.Table.from_batches(held), keys)


def _edges(table: pa.Table, keys: int) -> tuple[pa.Table, np.ndarray]:
    n = table.num_rows
    change = np.zeros(n, bool)
    for i in range(keys):
        x = table.column(i).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return table, np.concatenate([[0], np.flatnonzero(change), [n]]) if n else np.zeros(1, np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each of n items' smallest index that the links (a, b) reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (u, v): the smallest node reachable.

    Each round every node hooks onto its smallest lower neighbour, chains of hooks are shortened by
    doubling until they end at a root, and edges are drawn anew between roots. A node that is not
    the lowest around it is gone after the round, so edges and nodes at least halve, and the rounds grow
    with the logarithm of the graph. Nothing but whether rows are left reaches the driver, and every
    step ends in a table in the shared folder.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    left = stage(edges.filter("u <> v").select(high, low).distinct(), "edges")
    labels = stage(left.select(F.col("u").alias("node")).union(left.select(F.col("v").alias("node"))).distinct().withColumn("label", F.col("node")), "labels")
    while left.limit(1).count():
        hooks = stage(left.groupBy("u").agg(F.min("v").alias("up")), "hooks")
        while True:
            above = hooks.select(F.col("u").alias("up"), F.col("up").alias("above"))
            longer = stage(hooks.join(above, "up", "left").select("u", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "hooks")
            drop_staged(hooks)
            hooks = longer
            if not hooks.filter("moved").limit(1).count():
                break
        of_u, of_v = hooks.select("u", F.col("up").alias("a")), hooks.select(F.col("u").alias("v"), F.col("up").alias("b"))
        ends = left.join(of_u, "u").join(of_v, "v", "left").select(F.col("a").alias("u"), F.coalesce("b", "v").alias("v")).filter("u <> v")
        new = stage(ends.select(high, low).distinct(), "edges")
        named = stage(labels.join(hooks.select(F.col("u").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        drop_staged(left, labels, hooks)
        left, labels = new, named
    drop_staged(left)
    return labels.select("node", F.col("label").alias("component"))
