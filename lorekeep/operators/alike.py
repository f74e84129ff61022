"""A text's earlier texts that are most like it by pairs of characters.

Of natural texts most share common pairs with most others, so at a low threshold no filter on elements
leaves out much, and pairs of texts as rows would fill the disk. Here texts are dealt in blocks: each two
blocks of a part meet in one group of at most about twice `BLOCK` texts. There each text is a row of zeros
and ones over the group's character pairs, one matrix product counts what two texts share, and a group
gives out at most k earlier texts for each text. The work grows with the square of a part's texts, at two
operations a pair of texts and character pair; what is dealt grows with texts times blocks, and what a
group gives out doesn't grow with copies.

Defined results: texts shorter than two characters are like nothing; ids (two longs) must be unique within
a part, texts meet those of their own part only; similarities are compared as rounded to six digits,
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts of one block (so a group has about twice as many); texts of one matrix product.
BLOCK, PRODUCT = 8192, 512
_SCHEMA = T.StructType([T.StructField(x, T.LongType()) for x in ("q1", "q2", "h1", "h2", "common", "whole")])


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, pair) of the different character pairs of each text."""
    length = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), length)
    inside = owner[1:] == owner[:-1]
    both = ((code[:-1] << 21) | code[1:])[inside]
    pairs, number = np.unique(both, return_inverse=True)
    key = np.unique(owner[1:][inside] * len(pairs) + number)
    return key // max(1, len(pairs)), key % max(1, len(pairs))


def _met(threshold: float, k: int) -> Callable[[pa.Table], pa.Table]:
    arrow = to_arrow_schema(_SCHEMA)

    def meet(table: pa.Table) -> pa.Table:
        one, two = table["id1"].to_numpy(), table["id2"].to_numpy()
        order = np.lexsort((two, one))  # from here on rows stand by id, and earlier means a smaller row
        one, two, side = one[order], two[order], table["own"].to_numpy()[order]
        texts = table["q"].take(pa.array(order)).to_pylist()
        row, pair = _sets(texts)
        x = np.zeros((len(texts), int(pair.max(initial=0)) + 1), np.float32)
        x[row, pair] = 1
        n = x.sum(1)
        found = []

        def ranked(asked: np.ndarray, given: np.ndarray) -> None:
            """The best of `given` before each of `asked`, both rising rows."""
            xg, ng = x[given], n[given]
            for lo in range(0, len(asked), PRODUCT):
                q = asked[lo : lo + PRODUCT]
                last = np.searchsorted(given, q[-1])
                if not last:
                    continue
                c = x[q] @ xg[:last].T
                s = c / (n[q, None] + ng[None, :last] - c)
                s[given[None, :last] >= q[:, None]] = -1
                edge = np.full(len(q), threshold) if last <= k else np.maximum(np.partition(s, last - k, axis=1)[:, last - k], threshold)
                i, j = np.nonzero(s >= (edge - 3e-6)[:, None])  # single precision and rounding can hide less
                share = c[i, j].astype(np.int64)
                whole = (n[q[i]] + ng[j]).astype(np.int64) - share
                fits = share / whole >= threshold
                i, j, share, whole = i[fits], j[fits], share[fits], whole[fits]
                key = (2_000_000 * share + whole) // (2 * whole)  # rounded half up at six digits
                best = np.lexsort((j, -key, i))
                i, j, share, whole = i[best], j[best], share[best], whole[best]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                kept = place < k
                found.append((q[i[kept]], given[j[kept]], share[kept], whole[kept]))

        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        if table["a"][0] == table["b"][0]:
            ranked(left, left)
        else:
            ranked(left, right)
            ranked(right, left)
        q, h, share, whole = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4))
        return pa.Table.from_arrays([pa.array(v.astype(np.int64)) for v in (one[q], two[q], one[h], two[h], share, whole)], schema=arrow)

    return meet


def earlier(texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(q1, q2, h1, h2, s, rk): the k texts of the same part before each text that are most like it, with Jaccard
    similarity s >= threshold > 0. texts: part, id1, id2 (longs that order a part's texts), q."""
    d = texts.where(F.length("q") > 1).select("part", F.col("id1").cast("long").alias("id1"), F.col("id2").cast("long").alias("id2"), "q")
    sizes = d.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    d = d.join(sizes, "part").withColumn("own_block", F.pmod(F.xxhash64("id1", "id2"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("own_block", "other"), F.greatest("own_block", "other")
    d = d.select("part", a.alias("a"), b.alias("b"), F.when(F.col("own_block") == a, 0).otherwise(1).alias("own"), "id1", "id2", "q")
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups are few and heavy
    found = d.repartition(parts, "part", "a", "b").groupBy("part", "a", "b").applyInArrow(_met(threshold, k), _SCHEMA)
    found = found.withColumn("s", F.round(F.col("common") / F.col("whole"), 6))
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("s"), "h1", "h2"))
    return found.withColumn("rk", best).where(F.col("rk") <= k).select("q1", "q2", "h1", "h2", "s", "rk")
