"""Approximate nearest neighbours: one navigable small-world graph per shard.

Equal vectors are one node, which keeps the least `k + 1` of their ids: no other can be among the k
nearest. Nodes are dealt to shards by a hash of the vector: one shard for each shuffle partition,
but none of fewer than about `LEAST_SHARD` nodes, and more where they would pass `MOST_SHARD` nodes
or `SHARD_BYTES`, so that searches visit few shards. Each shard builds its graph in one task and
stores it as one row of flat arrays: vectors, level of each node, neighbours of level 0, neighbours
of the upper levels. Queries travel in blocks to every shard, where they stream past its graph; each
shard's k nearest are merged by exact distance.

Nodes are put in by batches that are no more than a quarter of the graph: a batch searches side by
side in numpy, and its members see each other by plain distances.

Defined results: vectors that are null, empty, all zero or hold a null, NaN or infinite component
take no part, nor do rows without an id; equal rows count once and rows with a query's own id are
no candidates for it; vectors meet those of their own length only; ties go to the smaller id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, table

LEAST_SHARD, MOST_SHARD, SHARD_BYTES = 4096, 1 << 17, 1 << 26
LINKS, BASE_LINKS = 12, 24
BUILD_WIDTH, SEARCH_WIDTH = 64, 128
#: Queries that travel and are searched together, nodes that are put in together.
BLOCK, BATCH = 256, 256
TOP = 10


class Graph:
    """Flat neighbour arrays: `base` (n, BASE_LINKS) and `upper` (rows, LINKS), -1 where empty. A
    node of level L has rows first[node] .. first[node] + L - 1 of `upper`."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, base: np.ndarray | None = None, upper: np.ndarray | None = None) -> None:
        self.x, self.levels = x, levels
        self.first = np.concatenate([[0], np.cumsum(levels)])[:-1].astype(np.int64)
        self.entry = int(np.argmax(levels)) if len(levels) else 0
        built = base is not None
        self.base = base if built else np.full((len(x), BASE_LINKS), -1, np.int32)
        self.upper = upper if built else np.full((int(levels.sum()), LINKS), -1, np.int32)
        if not built:
            self._build()

    def _rows(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The array that holds the level and the nodes' rows in it."""
        return (self.base, nodes) if level == 0 else (self.upper, self.first[nodes] + level - 1)

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each row of q to its row of nodes; infinite where there is none."""
        d = self.x[nodes] - q[:, None]
        return np.where(nodes >= 0, np.einsum("ijk,ijk->ij", d, d), np.inf)

    def _walk(self, q: np.ndarray, entry: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes), nearest first, -1 where there are fewer: the `width` nearest that a
        best-first walk from `entry` finds, for all rows of q side by side."""
        n = len(q)
        far, node, fresh = np.full((n, width), np.inf), np.full((n, width), -1, np.int64), np.zeros((n, width), bool)
        far[:, 0], node[:, 0], fresh[:, 0] = self._far(q, entry[:, None])[:, 0], entry, True
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), entry] = True
        rows = np.arange(n)
        while True:
            open_ = np.where(fresh[rows], far[rows], np.inf)
            at = open_.argmin(1)
            go = np.isfinite(open_[np.arange(len(rows)), at])
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            fresh[rows, at] = False
            links, of = self._rows(node[rows, at], level)
            near = links[of].astype(np.int64)
            r, c = np.nonzero(near >= 0)
            old = seen[rows[r], near[r, c]]
            near[r[old], c[old]] = -1
            r, c = r[~old], c[~old]
            seen[rows[r], near[r, c]] = True
            all_far = np.concatenate([far[rows], self._far(q[rows], near)], 1)
            all_node = np.concatenate([node[rows], near], 1)
            all_fresh = np.concatenate([fresh[rows], near >= 0], 1)
            best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            far[rows], node[rows], fresh[rows] = (np.take_along_axis(v, best, 1) for v in (all_far, all_node, all_fresh))
        order = np.lexsort((node, far), axis=1)
        return np.take_along_axis(far, order, 1), np.take_along_axis(node, order, 1)

    def _down(self, q: np.ndarray, entry: int, top: int, to: np.ndarray | int) -> np.ndarray:
        """Where each row of q stands after greedy walks from level `top` to above its level `to`."""
        at, to = np.full(len(q), entry, np.int64), np.broadcast_to(to, len(q))
        for level in range(top, 0, -1):
            rows = np.nonzero(to < level)[0]
            if len(rows):
                at[rows] = self._walk(q[rows], at[rows], 1, level)[1][:, 0]
        return at

    def _choose(self, far: np.ndarray, nodes: np.ndarray, count: int) -> np.ndarray:
        """Of each row's candidates, nearest first, `count`: those in different directions before
        the nearest others."""
        xs = self.x[nodes]
        sq = np.einsum("ijk,ijk->ij", xs, xs)
        between = sq[:, :, None] + sq[:, None] - 2 * xs @ xs.transpose(0, 2, 1)
        kept, least, taken = np.zeros(nodes.shape, bool), np.full(nodes.shape, np.inf), np.zeros(len(nodes), int)
        for i in range(nodes.shape[1]):
            ok = (far[:, i] < least[:, i]) & (taken < count)
            kept[:, i] = ok
            taken += ok
            least = np.where(ok[:, None], np.minimum(least, between[:, i]), least)
        order = np.argsort(np.where(np.isfinite(far), ~kept, 2), axis=1, kind="stable")[:, :count]
        return np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(nodes, order, 1), -1)

    def _link_back(self, nodes: np.ndarray, near: np.ndarray, level: int) -> None:
        """Each node becomes a neighbour of those it chose; full rows choose anew."""
        r, c = np.nonzero(near >= 0)
        to, new = near[r, c], nodes[r]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        targets, begin, count = np.unique(to, return_index=True, return_counts=True)
        if not len(targets):
            return
        links, of = self._rows(targets, level)
        most = links.shape[1]
        every = np.full((len(targets), most + int(count.max())), -1, np.int64)
        every[:, :most] = links[of]
        every[np.repeat(np.arange(len(targets)), count), most + np.arange(len(to)) - np.repeat(begin, count)] = new
        order = np.argsort(every, axis=1)
        every = np.take_along_axis(every, order, 1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1  # two of a batch may have chosen each other
        far = self._far(self.x[targets], every)
        order = np.argsort(far, axis=1, kind="stable")[:, : 2 * most]
        far, every = np.take_along_axis(far, order, 1), np.take_along_axis(every, order, 1)
        links[of] = np.where(np.isfinite(far[:, :most]), every[:, :most], -1)
        full = np.nonzero(np.isfinite(far).sum(1) > most)[0]
        if len(full):
            links[of[full]] = self._choose(far[full], every[full], most)

    def _build(self) -> None:
        n, done = len(self.x), 1
        if n == 0:
            return
        entry, top = 0, int(self.levels[0])
        while done < n:
            batch = np.arange(done, min(n, done + max(1, min(BATCH, done // 4))))
            q, level = self.x[batch], self.levels[batch]
            at = self._down(q, entry, top, level)
            sq = np.einsum("ij,ij->i", q, q)
            among = np.maximum(sq[:, None] + sq[None] - 2 * q @ q.T, 0.0)
            np.fill_diagonal(among, np.inf)
            for lv in range(max(int(level.max()), 0), -1, -1):
                rows = np.nonzero(level >= lv)[0]
                far, near = np.full((len(rows), 0), np.inf), np.zeros((len(rows), 0), np.int64)
                if lv <= top:
                    far, near = self._walk(q[rows], at[rows], BUILD_WIDTH, lv)
                    at[rows] = near[:, 0]
                far = np.concatenate([far, among[np.ix_(rows, rows)]], 1)
                near = np.concatenate([near, np.broadcast_to(batch[rows], (len(rows), len(rows)))], 1)
                order = np.argsort(far, axis=1, kind="stable")[:, :BUILD_WIDTH]
                chosen = self._choose(np.take_along_axis(far, order, 1), np.take_along_axis(near, order, 1), LINKS)
                links, of = self._rows(batch[rows], lv)
                links[of, : chosen.shape[1]] = chosen
                self._link_back(batch[rows], chosen, lv)
            done += len(batch)
            if level.max() > top:
                entry, top = int(batch[level.argmax()]), int(level.max())
        self.entry = entry

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """The k nearest nodes found for each row of q, nearest first, -1 where there are fewer."""
        if not len(self.x):
            return np.zeros((len(q), 0), np.int64)
        at = self._down(q, self.entry, int(self.levels[self.entry]), 0)
        return self._walk(q, at, max(width, k), 0)[1][:, :k]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles), h1, h2: rows that take part, equal ones once."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad & F.exists("v", lambda x: x != 0))
    return d.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))


def build_index(vectors: DataFrame, k: int = TOP, shard_size: int | None = None) -> tuple[DataFrame, int]:
    """One row per shard, and the number of shards of each vector length."""
    d = usable(vectors)
    least = Window.partitionBy("h1", "h2").orderBy("vec_id")
    d = d.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("rn", F.row_number().over(least)).where(F.col("rn") <= k + 1)
    nodes = cut(d.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    most = shard_size or max(1, min(MOST_SHARD, SHARD_BYTES // (8 * (size["dim"] or 1))))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-size["n"] // most), 0 if shard_size else min(parts, size["n"] // LEAST_SHARD))
    nodes = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), "h1", "v", "ids")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h1", kind="stable")
        x = np.array(rows["v"].tolist(), np.float64)
        u = ((rows["h1"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 1
        levels = np.floor(-np.log(u / (2.0**53 + 1)) / np.log(LINKS)).astype(np.int32)
        g = Graph(x, levels)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "entry": [g.entry], "x": [x.tobytes()], "levels": [levels.tobytes()], "base": [g.base.tobytes()], "upper": [g.upper.tobytes()], "ids": [rows["ids"].tolist()]})

    # an own number of partitions keeps small shards from being put together
    dealt = nodes.repartition(2 * shards, "dim", "shard")
    made = dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, entry int, x binary, levels binary, base binary, upper binary, ids array<array<bigint>>")
    return cut(made), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = TOP, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `queries` (vec_id, embedding)."""
    q = usable(queries).dropDuplicates(["vec_id", "h1", "h2"]).select("vec_id", F.size("v").alias("dim"), "v")
    blocks = max(1, -(-q.count() // BLOCK))
    q = q.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    q = q.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "queries")
    both = index.withColumn("kind", F.lit(0)).unionByName(q, allowMissingColumns=True)
    both = both.repartition(2 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")  # a graph, then its queries

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, g, ids = None, None, None
        for batch in batches:
            names = batch.schema.names
            for row in range(batch.num_rows):
                r = {c: batch.column(i)[row] for i, c in enumerate(names)}
                here = (r["dim"].as_py(), r["shard"].as_py())
                if r["kind"].as_py() == 0:
                    flat = lambda c, w: np.frombuffer(r[c].as_py(), np.int32).reshape(-1, w)  # noqa: E731, B023
                    g = Graph(np.frombuffer(r["x"].as_py(), np.float64).reshape(-1, here[0]), np.frombuffer(r["levels"].as_py(), np.int32), flat("base", BASE_LINKS), flat("upper", LINKS))
                    g.entry, ids, at = r["entry"].as_py(), r["ids"].as_py(), here
                elif at == here:
                    own = r["queries"].as_py()
                    v = np.array([x["v"] for x in own], np.float64)
                    out: list[tuple[int, int, float]] = []
                    for one, q, nodes in zip(own, v, g.search(v, k + 1, width).tolist()):
                        near = [(float(np.sqrt(((g.x[node] - q) ** 2).sum())), i) for node in nodes if node >= 0 for i in ids[node] if i != one["vec_id"]]
                        out += [(one["vec_id"], i, d) for d, i in sorted(near)[:k]]
                    if out:
                        a, b, c = zip(*out)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    found = both.select("dim", "shard", "kind", "levels", "base", "upper", "x", "entry", "ids", "queries").mapInArrow(walk, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hnsw(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index, shards = build_index(vectors)
    return search(index, shards, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))
