"""Exact nearest vectors with pruning by pivots.

`PIVOTS` rows chosen by hash are the centres of cells; each row goes to the cell of its nearest pivot
and knows its distance to it, each cell its row count and radius. A query first looks into its
`FIRST` nearest cells; the distance of its k-th row there bounds the answer. Then it looks into those other cells
that its ball of that radius reaches (its distance to the pivot less the cell's radius), and in a cell
only at rows whose distance to the pivot differs from its own by no more than the bound: by the
triangle inequality no other row can be nearer. Distances to pivots are computed from one small table;
everything else is a meeting of the queries and rows of a cell, in groups of at most about `SLICE` rows
and `SLICE` queries: one matrix product finds which rows can be among a query's k, and only for those the
measure is computed as it is defined, component by component. A group gives out k rows a query (more where
measures lie within rounding), so vectors are dealt, never pairs.

Cosines are taken on vectors scaled to length one, where they fall as distances grow. Permissions are
part of the meeting, so a hidden row is neither counted nor bounds anything: the condition is evaluated once
for each two different values of the columns it can read, of which there should be few.

In many dimensions pivots rule out little: queries then meet most rows, which costs a few operations a
component in a matrix product and grows with queries times rows.

Defined results: null vectors take no part, nor do zero ones for cosines; vectors of another length
than the pivots' are an error of the caller; ties within 1e-6 (the measure is rounded to six digits) go to the
smaller id; a query with fewer than k rows gets all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.operators.ranks import checkpointed

PIVOTS, FIRST = 64, 2
#: Beyond what rounding to six digits and floating point can move a distance's square.
SLACK = 4e-6
#: Rows of a cell, and queries, that meet in one group; queries of one matrix product.
SLICE, PRODUCT = 16384, 512


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column | str, b: Column | str) -> Column:
    step = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, step), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class Nearest:
    """found (qid, id, rk, m), compared (qid, n: rows whose distance was computed)."""

    found: DataFrame
    compared: DataFrame


def _pointed(df: DataFrame, vector: str, cosine: bool) -> DataFrame:
    d = df.where(F.col(vector).isNotNull())
    if not cosine:
        return d.withColumn("__p", F.col(vector))
    norm = F.sqrt(dot(vector, vector))
    return d.withColumn("__norm", norm).where("__norm > 0").withColumn("__p", F.transform(vector, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _dots(a: np.ndarray, b: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += step(a[:, j], b[:, j])
    return out


def _met(schema: T.StructType, k: int, cosine: bool, own: bool, guarded: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A group's queries and rows: the rows that can be among a query's k, and one row with how many were compared."""
    arrow = to_arrow_schema(schema)
    times, apart = (lambda x, y: x * y), (lambda x, y: (x - y) * (x - y))

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return arrow.empty_table()
        qv, rv = _matrix(queries["embedding"]), _matrix(rows["vector"])
        q2, r2 = _dots(qv, qv, times), _dots(rv, rv, times)
        qp, rp = (qv / np.sqrt(q2)[:, None], rv / np.sqrt(r2)[:, None]) if cosine else (qv, rv)
        qs, rs = (np.ones(len(qp)), np.ones(len(rp))) if cosine else (q2, r2)
        num = lambda t, c: t[c].to_numpy()
        qd, bound, rd = num(queries, "__qd"), num(queries, "__bound"), num(rows, "__d")
        qid, ids = queries["qid"].combine_chunks(), rows["id"].combine_chunks()
        qkey, rkey = np.asarray(qid.to_pylist(), object), np.asarray(ids.to_pylist(), object)
        place = np.empty(len(rkey), np.int64)
        place[np.asarray(sorted(range(len(rkey)), key=rkey.__getitem__))] = np.arange(len(rkey))
        mine: dict[object, list[int]] = {}
        for j, x in enumerate(rkey):
            mine.setdefault(x, []).append(j)
        classes, sees = None, None
        if guarded:
            coded = rows["__class"].combine_chunks().dictionary_encode()
            names = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
            classes = coded.indices.to_numpy()
            sees = np.zeros((len(qkey), len(names)), bool)
            for i, listed in enumerate(queries["__sees"].to_pylist()):
                for x in listed or ():
                    if x in names:
                        sees[i, names[x]] = True
        found: list[tuple[np.ndarray, ...]] = []
        compared = np.zeros(len(qkey), np.int64)
        for lo in range(0, len(qkey), PRODUCT):
            at = slice(lo, min(lo + PRODUCT, len(qkey)))
            ok = np.abs(qd[at, None] - rd[None, :]) <= bound[at, None]
            if guarded:
                ok &= sees[at][:, classes]
            if not own:
                for i in range(at.start, at.stop):
                    ok[i - lo, mine.get(qkey[i], [])] = False
            compared[at] = ok.sum(1)
            near = qs[at, None] + rs[None, :] - 2 * (qp[at] @ rp.T)
            # what the product can err by, and what rounding the measure to six digits can hide
            slip = 4e-6 + 1e-11 * (qs[at] + (rs.max() if len(rs) else 0))
            near[~(ok & (near <= (bound[at] ** 2 + slip)[:, None]))] = np.inf
            if near.shape[1] > k:
                edge = np.partition(near, k - 1, axis=1)[:, k - 1]
                near[near > (edge + slip)[:, None]] = np.inf
            i, j = np.nonzero(near < np.inf)
            if not len(i):
                continue
            s = _dots(qp[i + lo], rp[j], apart)
            m = _dots(qv[i + lo], rv[j], times) / (np.sqrt(q2[i + lo]) * np.sqrt(r2[j])) if cosine else s
            # of rows with the very same measure, copies for one, only the first k can count
            order = np.lexsort((place[j], m, i))
            i, j, s, m = i[order], j[order], s[order], m[order]
            first = np.r_[True, (i[1:] != i[:-1]) | (m[1:] != m[:-1])]
            since = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            kept = since < k
            found.append((i[kept] + lo, j[kept], m[kept], s[kept]))
        i, j, m, s = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64 if c < 2 else float) for c in range(4))
        hits = pa.Table.from_arrays([qid.take(pa.array(i)), ids.take(pa.array(j)), pa.array(m), pa.array(s), pa.array(np.zeros(len(i), np.int64))], schema=arrow)
        counts = pa.Table.from_arrays([qid, pa.nulls(len(qid), ids.type), pa.nulls(len(qid), pa.float64()), pa.nulls(len(qid), pa.float64()), pa.array(compared)], schema=arrow)
        return pa.concat_tables([hits, counts.filter(pa.array(compared > 0))])

    return meet


def nearest(queries: DataFrame, rows: DataFrame, k: int, cosine: bool = False, allowed: Column | None = None, own: bool = False, pivots: int = PIVOTS, first: int = FIRST) -> Nearest:
    """queries: qid, embedding, ...; rows: id, vector, ... `allowed` is a condition over the other columns of
    both, `own` keeps rows whose id is the query's."""
    points = _pointed(rows, "vector", cosine)
    centre = F.broadcast(points.select(F.xxhash64("__p").alias("h"), "__p").distinct().orderBy("h").limit(pivots).agg(F.collect_list("__p").alias("__centres")))  # at most `pivots` vectors
    centre = checkpointed(centre)
    far = F.transform("__centres", lambda c, i: F.struct(F.sqrt(squared("__p", c)).alias("d"), i.alias("cell")))
    placed = points.crossJoin(F.broadcast(centre)).withColumn("__at", F.array_min(far)).drop("__centres")  # one row of centres
    placed = checkpointed(placed.select(*rows.columns, F.col("__at.cell").alias("cell"), F.col("__at.d").alias("__d")))
    cells = F.broadcast(placed.groupBy("cell").agg(F.max("__d").alias("radius"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices")))  # at most `pivots` rows

    asked = _pointed(queries, "embedding", cosine)
    about = [c for c in queries.columns if c not in ("qid", "embedding")]
    theirs = [c for c in rows.columns if c not in ("id", "vector")]
    if allowed is not None:
        asked = asked.withColumn("__me", F.to_json(F.struct(*about)))
        placed = placed.withColumn("__class", F.to_json(F.struct(*theirs)))
        # one row for each two different values of the columns that the condition reads
        pairs = asked.select("__me", *about).dropDuplicates(["__me"]).crossJoin(placed.select("__class", *theirs).dropDuplicates(["__class"])).where(allowed)
        asked = asked.join(pairs.groupBy("__me").agg(F.collect_list("__class").alias("__sees")), "__me", "left")
    asked = checkpointed(asked.crossJoin(F.broadcast(centre)).withColumn("__far", far).drop("__centres"))
    blocks = -(-asked.count() // SLICE) or 1  # one number
    seen = ["__sees"] if allowed is not None else []
    q = asked.select("qid", F.explode("__far").alias("__f")).select("qid", F.col("__f.cell").alias("cell"), F.col("__f.d").alias("__qd"))
    q = checkpointed(q.join(cells, "cell").withColumn("__order", F.row_number().over(Window.partitionBy("qid").orderBy("__qd", "cell"))))
    order = [F.desc("m") if cosine else F.col("m"), F.col("id")]
    best = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("m", T.DoubleType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = max(pivots, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = ["cell", "slice", "block"]
    meet = _met(schema, k, cosine, own, allowed is not None)

    def looked(some: DataFrame) -> DataFrame:
        """some: qid, cell, slices, __qd, __bound."""
        met = some.join(asked.select("qid", "embedding", *seen), "qid").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        met = met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*group, "qid", "embedding", "__qd", "__bound", *seen)
        dealt = placed.join(cells, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt = dealt.select(*group, "id", "vector", "__d", *(["__class"] if seen else []))
        both = met.repartition(parts, *group).groupBy(*group).cogroup(dealt.repartition(parts, *group).groupBy(*group))
        return checkpointed(both.applyInArrow(meet, schema).withColumn("m", F.round("m", 6)))

    near = looked(q.where(F.col("__order") <= first).withColumn("__bound", F.lit(float("inf"))))
    top = near.where("id IS NOT NULL").withColumn("rk", best).where(F.col("rk") <= k)
    bound = top.groupBy("qid").agg(F.when(F.count("*") == k, F.sqrt(F.max("s") + SLACK)).otherwise(F.lit(float("inf"))).alias("__bound"))
    more = q.where(F.col("__order") > first).join(bound, "qid", "left").withColumn("__bound", F.coalesce("__bound", F.lit(float("inf"))))
    late = looked(more.where(F.col("__qd") - F.col("radius") <= F.col("__bound")))
    both = top.select("qid", "id", "m").unionByName(late.where("id IS NOT NULL").select("qid", "id", "m"))
    found = both.withColumn("rk", best).where(F.col("rk") <= k)
    return Nearest(found.select("qid", "id", "rk", "m"), near.unionByName(late).groupBy("qid").agg(F.sum("n").alias("n")))
