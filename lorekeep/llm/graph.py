"""Connected components by union-find inside tasks and one shuffle a round.

A round joins what it can inside each task into stars, deals the stars' edges by their outer node
and keeps for each node its least centre; other centres of the node become edges to that one. A node
that is no centre anywhere has met all it is linked to and leaves the graph; only centres go on, and
each then skips to its parent's parent, so chains halve. No step gathers what hangs on a centre: a
node meets at most one row for each task of the round, and hot centres are only looked up, by joins
that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lorekeep.llm.common import cut

#: Rows that a task of these light steps takes: small graphs get few tasks, large ones many.
TASK_ROWS = 20_000


class Sets:
    """Union-find over longs; the least member leads."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def sized(df: DataFrame, rows: int) -> DataFrame:
    """No more partitions than `rows` rows need: each map task of a shuffle leaves files of its own."""
    return df.coalesce(rows // TASK_ROWS + 1)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint, in no more partitions than its rows need, and its number of rows."""
    seen = Observation()
    d = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return sized(d, seen.get["n"]), seen.get["n"]


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int]]]:
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist()


def _out(*columns: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=["node", "up", "edge"][: len(columns)])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars (node, centre); each centre has a row of its own."""
    sets, nodes = Sets(), set()
    for a, b in _longs(batches):
        nodes.update(a, b)
        for x, y in zip(a, b):
            sets.join(x, y)
    node = list(nodes)
    yield _out(node, [sets.find(x) for x in node])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a node meet here. edge 0: where to look the node's root up (itself, if it is a
    centre); edge 1: an edge that is left."""
    ups: dict[int, list[int]] = {}
    for a, b in _longs(batches):
        for x, y in zip(a, b):
            ups.setdefault(x, []).append(y)
    sets, left, node, up = Sets(), set(), [], []
    for x, ys in ups.items():
        least = min(ys)
        centre = x in ys
        node.append(x)
        up.append(x if centre else least)
        for y in (ys if centre else ys[1:] + ys[:1]):
            if y != least:
                sets.join(y, least)
                left.update((y, least))
    rest = [(x, r) for x in left if (r := sets.find(x)) != x]
    yield _out(node + [x for x, _ in rest], up + [r for _, r in rest], [0] * len(node) + [1] * len(rest))


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node in `edges` (a, b: longs); root is the least node reachable. None
    without edges."""
    edges, n = counted(edges.select("a", "b").where("a <> b"))
    levels: list[tuple[DataFrame, int]] = []
    while n:
        seen = Observation()
        stars = edges.mapInArrow(_stars, "node bigint, up bigint").repartition(n // TASK_ROWS + 1, "node")
        settled = cut(stars.mapInArrow(_settle, "node bigint, up bigint, edge bigint").observe(seen, F.count_if(F.col("edge") == 0).alias("nodes"), F.count_if(F.col("edge") == 1).alias("edges")))
        levels.append((settled.where("edge = 0").select("node", "up"), seen.get["nodes"]))
        edges, n = settled.where("edge = 1").select(F.col("node").alias("a"), F.col("up").alias("b")), seen.get["edges"]
        if n and levels[1:]:
            above = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("c"))
            edges, n = counted(edges.join(above.hint("merge"), "b", "left").select("a", F.coalesce("c", "b").alias("b")).distinct())
        edges = sized(edges, n)
    if not levels:
        return None
    roots, k = levels.pop()
    roots = sized(roots.withColumnRenamed("up", "root"), k)
    for looked, k in reversed(levels):
        above = roots.select(F.col("node").alias("up"), "root").hint("merge")
        roots = sized(cut(sized(looked.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root")), k)), k)
    return roots


def lifted(roots: DataFrame, tops: DataFrame | None) -> DataFrame:
    """`roots` (with a column root) after components were joined: `tops` has (node, root) of old roots."""
    if tops is None:
        return roots
    above = tops.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge")
    return roots.join(above, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
