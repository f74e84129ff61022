"""Hard negatives by inner product, with coordinate pruning in length buckets.

Vectors stand in order of label and falling length; runs of up to `SHARD` of them are one row of flat
arrays, cut into buckets of one label and up to `BUCKET` vectors. A bucket keeps, for each coordinate,
its vectors in order of that coordinate after scaling to length one. Anchors travel in blocks to
the shards, where they stream past the buckets, longest first. To reach a score t, a vector of a bucket
must make a cosine of at least t / (anchor's length x longest of the bucket) with the anchor: above one,
the bucket is passed over. Else each focus coordinate of the anchor (its `FOCUS` largest) leaves a
feasible range of values: the angles whose sines are the two coordinates may differ by no more than
that cosine's angle. The shortest range is read off its sorted list and intersected with the others;
what is left is scored exactly. Where ranges leave more than `DENSE` of a bucket, the bucket is scored by
one product for all such anchors. t is what the anchor's list so far asks for.

Two passes: first each anchor's best rows of its own label (its positives; blocks go only to
shards that hold the label), then, for each positive, the best rows of other labels whose score
lies between shares of the positive's. Each shard returns its best rows for an anchor, and a window merges them.

Equal vectors of one label are one entry, which keeps the least ids that any list can ask for: no
other of them can be among the first. The cost is that of the anchors times the shards that may hold their
negatives; nothing is collected, and a task holds one shard and one block.

Scores are exact integers: components are whole numbers, and where products could pass 2^53 Python's
own integers are used. Defined results: rows with a null id, label or vector, or a null, NaN or infinite
component take no part; vectors meet those of their own length only; equal rows count once; rows with
an anchor's own id are no candidates for it; an id with several different rows is several anchors;
ties go to the smaller id; scores beyond 64 bits stop at their ends; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, positions, table

#: Vectors of a shard (and bytes), of a bucket, anchors of a block.
LEAST_SHARD, SHARD, SHARD_BYTES, BUCKET, BLOCK = 4096, 1 << 15, 1 << 26, 1024, 256
#: Focus coordinates of an anchor; share of a bucket from which it is scored as a whole.
FOCUS, DENSE = 4, 0.25
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
SCALE = 256
_EXACT = float(1 << 53)
_FOUND = "anchor_id bigint, label bigint, h1 bigint, h2 bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, label: Column | str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers as doubles), h1, h2: rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    d = vectors.select("vec_id", (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), x.alias("x"))
    d = d.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").where(~bad)
    # floor() of a double is a long and would overflow; the same by remainders stays a double
    whole = lambda c: F.when(F.abs(c * scale) >= _EXACT, F.greatest(F.least(c * scale, F.lit(1.7e308)), F.lit(-1.7e308))).otherwise(F.floor(c * scale).cast("double"))
    d = d.select("vec_id", "label", F.transform("x", whole).alias("v"))
    return d.select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c))


def build_index(rows: DataFrame, ids: int = NEGATIVES + 1, shard_size: int | None = None, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """One row per shard (dim, shard, flat arrays), and the number of shards. rows: `usable`."""
    least = Window.partitionBy("label", "h1", "h2").orderBy("vec_id")
    d = rows.dropDuplicates(["vec_id", "label", "h1", "h2"]).withColumn("rn", F.row_number().over(least)).where(F.col("rn") <= ids)
    d = d.groupBy("label", "h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(d.select(F.size("v").alias("dim"), "label", "h1", "v", "ids", (-length(F.col("v"))).alias("far")))
    size = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = shard_size or max(1, min(max(LEAST_SHARD, -(-size["n"] // parts)), SHARD, SHARD_BYTES // (12 * (size["dim"] or 1))))
    placed = positions(nodes, ["dim"], ["label", "far", "h1"]).withColumn("shard", F.floor(F.col("pos") / most).cast("int"))
    shards = max(1, -(-size["n"] // most))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x = np.array(rows["v"].tolist(), np.float64)
        labels, lengths = rows["label"].to_numpy(np.int64), -rows["far"].to_numpy(np.float64)
        ends = [0]
        while ends[-1] < len(x):
            change = np.nonzero(labels[ends[-1] : ends[-1] + bucket] != labels[ends[-1]])[0]
            ends.append(min(len(x), ends[-1] + (int(change[0]) if len(change) else bucket)))
        unit = _unit(x, lengths)
        lists = np.concatenate([np.argsort(unit[a:b], axis=0, kind="stable").T.ravel() for a, b in zip(ends, ends[1:])]).astype(np.int32)
        raw = lambda a: [np.ascontiguousarray(a).tobytes()]
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "x": raw(x), "lengths": raw(lengths), "labels": raw(labels), "ends": raw(np.array(ends, np.int64)), "lists": raw(lists), "ids": [rows["ids"].tolist()]})

    schema = "dim int, shard int, x binary, lengths binary, labels binary, ends binary, lists binary, ids array<array<bigint>>"
    made = placed.select("dim", "shard", "pos", "label", "far", "v", "ids").repartition(2 * shards, "dim", "shard")
    return cut(made.groupBy("dim", "shard").applyInPandas(build, schema)), shards


def spans(index: DataFrame) -> DataFrame:
    """(dim, label, first, last): the shards that hold a label; they stand side by side."""

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                own = np.unique(np.frombuffer(r.labels, np.int64))
                yield pd.DataFrame({"dim": r.dim, "label": own, "shard": r.shard})

    each = index.select("dim", "shard", "labels").mapInPandas(labels, "dim int, label bigint, shard int")
    return each.groupBy("dim", "label").agg(F.min("shard").alias("first"), F.max("shard").alias("last"))


def _unit(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    scale = np.where((lengths > 0) & np.isfinite(lengths), lengths, 1.0)
    return np.clip(x / scale[:, None], -1.0, 1.0)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of q and rows of x."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(c) for c in row] for row in a.tolist()], object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Shard:
    """A shard's buckets; `passed`, `whole` and `pruned` count what became of (anchor, bucket) pairs."""

    def __init__(self, dim: int, x: bytes, lengths: bytes, labels: bytes, ends: bytes, lists: bytes, ids: list[list[int]]) -> None:
        self.x = np.frombuffer(x, np.float64).reshape(-1, dim)
        self.lengths, self.labels, self.ends = np.frombuffer(lengths, np.float64), np.frombuffer(labels, np.int64), np.frombuffer(ends, np.int64)
        self.lists, self.ids, self.dim = np.frombuffer(lists, np.int32), ids, dim
        self.passed = self.whole = self.pruned = 0

    def buckets(self) -> list[int]:
        return sorted(range(len(self.ends) - 1), key=lambda b: -self.lengths[self.ends[b]])

    def label(self, b: int) -> int:
        return int(self.labels[self.ends[b]])

    def reached(self, b: int, q: np.ndarray, far: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores): for each row of q the rows of bucket b that may reach `least`, and
        perhaps others. far: lengths of q."""
        a, e = int(self.ends[b]), int(self.ends[b + 1])
        n, longest = e - a, self.lengths[a]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            need = least / (far * longest)
        open_ = (least <= 0) | ~np.isfinite(far * longest)  # no bound, or none that can be told
        go = open_ | (need <= 1 + 1e-9)
        self.passed += int((~go).sum())
        rows = np.nonzero(go)[0]
        dense = rows[open_[rows]].tolist()
        sharp = rows[~open_[rows]]
        if len(sharp):
            unit = _unit(q[sharp], far[sharp])
            focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
            at, wide = np.arcsin(np.take_along_axis(unit, focus, 1)), np.arccos(np.minimum(need[sharp], 1.0))[:, None] + 1e-6
            low, high = np.sin(np.maximum(at - wide, -np.pi / 2)) - 1e-6, np.sin(np.minimum(at + wide, np.pi / 2)) + 1e-6
            own = _unit(self.x[a:e], self.lengths[a:e])
            lists = self.lists[a * self.dim : e * self.dim].reshape(self.dim, n)
            begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
            for c in np.unique(focus):
                hit = focus == c
                values = own[lists[c], c]
                begin[hit], end[hit] = np.searchsorted(values, low[hit], "left"), np.searchsorted(values, high[hit], "right")
            best = (end - begin).argmin(1)
            for k, i in enumerate(sharp.tolist()):
                f = best[k]
                lo, hi = begin[k, f], end[k, f]
                if hi - lo > DENSE * n:
                    dense.append(i)
                    continue
                self.pruned += 1
                some = lists[focus[k, f], lo:hi]
                for g in range(focus.shape[1]):  # the other coordinates' feasible ranges
                    if g != f and len(some):
                        v = own[some, focus[k, g]]
                        some = some[(v >= low[k, g]) & (v <= high[k, g])]
                if len(some):
                    some = np.sort(some) + a
                    yield i, some, scores(q[i : i + 1], self.x[some])[0]
        if dense:
            self.whole += len(dense)
            every, all_rows = scores(q[dense], self.x[a:e]), np.arange(a, e)
            for i, s in zip(dense, every):
                yield i, all_rows, s

    def best(self, rows: np.ndarray, s: np.ndarray, k: int, low: int, high: int, own: int) -> list[tuple[int, int]]:
        """The first k (-score, id) of these rows with a score in [low, high], but for the id `own`."""
        ok = (s >= low) & (s <= high)
        rows, s = rows[ok], s[ok]
        if len(s) > k + 1:
            ok = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]  # one more: the own row may be there
            rows, s = rows[ok], s[ok]
        found = [(-v, i) for r, v in zip(rows.tolist(), s.tolist()) for i in self.ids[r] if i != own]
        return sorted(found)[:k]


def _merged(old: list[tuple[int, int]], new: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted({*old, *new})[:k] if new else old


_NEVER = np.inf


def _bound(score: int) -> float:
    """A score as a lower bound; a little less where a double can't hold it."""
    return float(score) - (0.0 if abs(score) < _EXACT else abs(score) * 1e-12)


def positives_in(shard: Shard, anchors: list[dict], k: int) -> list[tuple]:
    q = np.array([a["v"] for a in anchors], np.float64)
    labels, far = np.array([a["label"] for a in anchors], np.int64), np.sqrt((q * q).sum(1))
    found: list[list[tuple[int, int]]] = [[] for _ in anchors]
    least = np.full(len(anchors), -np.inf)
    for b in shard.buckets():
        own = np.nonzero(labels == shard.label(b))[0]
        for i, rows, s in shard.reached(b, q[own], far[own], least[own]) if len(own) else ():
            i = int(own[i])
            found[i] = _merged(found[i], shard.best(rows, s, k, -(1 << 63), (1 << 63) - 1, anchors[i]["vec_id"]), k)
            least[i] = _bound(-found[i][-1][0]) if len(found[i]) == k else -np.inf
    return [(a["vec_id"], a["label"], a["h1"], a["h2"], None, None, i, -s) for a, top in zip(anchors, found) for s, i in top]


def negatives_in(shard: Shard, anchors: list[dict], k: int, least_share: int, most_share: int) -> list[tuple]:
    q = np.array([a["v"] for a in anchors], np.float64)
    labels, far = np.array([a["label"] for a in anchors], np.int64), np.sqrt((q * q).sum(1))
    # least_share * p <= 100 * s <= most_share * p, in whole numbers
    bands = [[(p["vec_id"], p["score"], -(-least_share * p["score"] // 100), most_share * p["score"] // 100) for p in a["positives"]] for a in anchors]
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in b] for b in bands]
    asked = lambda i: min((_bound(-f[-1][0] if len(f) == k else b[2]) for f, b in zip(found[i], bands[i]) if b[2] <= b[3]), default=_NEVER)
    least = np.array([asked(i) for i in range(len(anchors))], np.float64)
    for b in shard.buckets():
        other = np.nonzero((labels != shard.label(b)) & (least < _NEVER))[0]
        for i, rows, s in shard.reached(b, q[other], far[other], least[other]) if len(other) else ():
            i = int(other[i])
            top = s >= least[i]
            rows, s = rows[top], s[top]
            if not len(s):
                continue
            for j, (_, _, low, high) in enumerate(bands[i]):
                if low <= high:
                    found[i][j] = _merged(found[i][j], shard.best(rows, s, k, max(low, -(1 << 63)), high, anchors[i]["vec_id"]), k)
            least[i] = asked(i)
    return [(a["vec_id"], a["label"], a["h1"], a["h2"], p, ps, i, -s) for a, own, tops in zip(anchors, bands, found) for (p, ps, _, _), top in zip(own, tops) for s, i in top]


def _walk(index: DataFrame, blocks: DataFrame, shards: int, work) -> DataFrame:
    """`work` on each block (dim, shard, anchors) in the task that holds its shard."""
    both = index.withColumn("kind", F.lit(0)).unionByName(blocks.select("dim", "shard", F.lit(1).alias("kind"), "anchors"), allowMissingColumns=True)
    both = both.repartition(2 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")  # a shard, then its blocks
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(i)[n] for i, c in enumerate(batch.schema.names)}
                here = (r["dim"].as_py(), r["shard"].as_py())
                if r["kind"].as_py() == 0:
                    at, shard = here, Shard(here[0], *[r[c].as_py() for c in ("x", "lengths", "labels", "ends", "lists", "ids")])
                elif at == here and (out := work(shard, r["anchors"].as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return both.select("dim", "shard", "kind", "x", "lengths", "labels", "ends", "lists", "ids", "anchors").mapInArrow(walk, _FOUND)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, most_share: int = MOST_SHARE, shard_size: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both frames: `usable`."""
    index, shards = build_index(rows, max(positives, negatives) + 1, shard_size, bucket)
    key = ["vec_id", "label", "h1", "h2"]
    own = cut(anchors.dropDuplicates(key).select(F.size("v").alias("dim"), *key, "v"))
    count = max(1, -(-own.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id", "h1"), F.lit(count)).alias("block")
    at = spans(index)
    ranks = lambda by, k: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")) <= k

    near = own.groupBy("dim", "label", block).agg(F.collect_list(F.struct(*key, "v")).alias("anchors")).join(at, ["dim", "label"])
    near = near.select("dim", F.explode(F.sequence("first", "last")).alias("shard"), "anchors")
    found = _walk(index, near, shards, lambda shard, block: positives_in(shard, block, positives))
    top = cut(found.withColumn("ok", ranks(["anchor_id", "label", "h1", "h2"], positives)).where("ok").select("anchor_id", "label", "h1", "h2", "vec_id", "score"))

    wanted = top.groupBy("anchor_id", "label", "h1", "h2").agg(F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives")).withColumnRenamed("anchor_id", "vec_id")
    asked = own.join(wanted, key).groupBy("dim", "label", block).agg(F.collect_list(F.struct(*key, "v", "positives")).alias("anchors")).join(at, ["dim", "label"], "left")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("first IS NULL OR NOT (shard > first AND shard < last)")
    found = _walk(index, asked, shards, lambda shard, block: negatives_in(shard, block, negatives, least_share, most_share))
    by = ["anchor_id", "label", "h1", "h2", "positive_id"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_coordinate_pruning(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, sf_dir, "embeddings"), label)
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


#: Integer products of all anchors and all rows, by brute force.
ORACLE = """
WITH rows AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM pairs WHERE same) WHERE k <= 5),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""
