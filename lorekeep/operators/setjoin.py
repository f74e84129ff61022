"""Pairs of similar sets by prefix filter.

Elements are put in one global order, rarest first. Two sets of Jaccard similarity t or more share an
element among the first n - ceil(t n) + 1 of each, so only these prefixes are joined: the elements that most
sets have stand last and are joined on by none but the smallest sets. A pair must also fit in length
(t n <= m) and in place (what can still follow after the shared element must suffice). Candidates are
verified on whole sets.

Defined results: null and empty sets are similar to nothing; repeated elements count once; ids must be
unique within a part, sets meet those of their own part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.ranks import checkpointed


def ordered(sets: DataFrame) -> DataFrame:
    """(part, id, n, items): each set's elements, rarest in all of `sets` (part, id, items) first."""
    one = sets.select("part", "id", F.explode(F.array_distinct("items")).alias("e"))
    often = one.groupBy("e").agg(F.count("*").alias("f"))
    d = one.join(often, "e").groupBy("part", "id").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("x"))
    return checkpointed(d.select("part", "id", F.size("x").alias("n"), F.col("x.e").alias("items")))


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(part, a, b) with a < b: pairs that share a prefix element and fit in length and place. sets: `ordered`."""
    t = F.lit(threshold)
    keep = F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1
    p = sets.select("part", "id", "n", F.posexplode(F.slice("items", F.lit(1), keep.cast("int"))).alias("pos", "e"))
    a, b = p.alias("a"), p.alias("b")
    on = (F.col("a.part") == F.col("b.part")) & (F.col("a.e") == F.col("b.e")) & (F.col("a.id") < F.col("b.id"))
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    need = F.ceil(t / (1 + t) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    rest = 1 + F.least(F.col("a.n") - F.col("a.pos") - 1, F.col("b.n") - F.col("b.pos") - 1)
    # before the first shared element nothing is shared, so for that element the rest must suffice
    fits = (least >= t * most - 1e-9) & (rest >= need)
    return a.join(b, on).where(fits).select(F.col("a.part").alias("part"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def similar(sets: DataFrame, threshold: float) -> DataFrame:
    """(part, a, b, common, whole) of all pairs with common / whole >= threshold. sets: part, id, items."""
    d = ordered(sets)
    side = lambda x: d.select("part", F.col("id").alias(x), F.col("items").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = candidates(d, threshold).join(side("a"), ["part", "a"]).join(side("b"), ["part", "b"])
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    both = both.withColumn("whole", F.col("na") + F.col("nb") - F.col("common"))
    return both.where(F.col("common") / F.col("whole") >= threshold).select("part", "a", "b", "common", "whole")
