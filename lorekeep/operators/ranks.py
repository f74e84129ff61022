"""Exact values at ranks of many groups at once, found by counting in ever narrower ranges.

The first scan gives each group's count, mean, least and greatest value; the next counts values by
group, range and one of `RANGES` cells of that range, for all wanted ranks together; the last orders
what the cells with wanted ranks hold. More rounds of counting come between only while such a cell
holds more than `LEAF` different values. No group is sorted or gathered, and only one number a
round (how full the fullest wanted cell is) goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.sources.files import scratch

RANGES = 1024
#: Values of a cell that are put in order.
LEAF = 4096
#: Rows of groups and ranks that the driver hands to all tasks.
FEW = 2000

Rank = Callable[[Column], Column]
#: The ranks, from 1, of the lower and upper median and of the element at min(floor(0.95 n), n - 1).
LOW: Rank = lambda n: F.floor((n + 1) / 2)
HIGH: Rank = lambda n: F.floor(n / 2) + 1
P95: Rank = lambda n: F.least(F.floor(n * F.lit(0.95)), n - 1) + 1


def summaries(values: DataFrame, group: list[str], ranks: dict[str, Rank]) -> DataFrame:
    """One row for each group of `values` (group ..., v: finite doubles or null): n, mean and the value
    at each named rank. Null groups are groups; groups without values have nulls.

    The groups' rows are joined to the values: by broadcast while they are few, else by hash."""
    g = [f"g{i}" for i in range(len(group))]
    d = values.select(*[F.col(c).alias(x) for c, x in zip(group, g)], F.col("v").cast("double").alias("v"))
    on = lambda a, b: _all([F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in g])
    totals, _ = _kept(d.groupBy(*g).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r(F.col("n")).cast("bigint").alias("rank")) for k, r in ranks.items()]))
    targets = totals.where("n > 0").select(*g, "lo", "hi", F.col("n").alias("inside"), wanted.alias("t")).select(*g, "lo", "hi", "inside", "t.name", "t.rank")
    while True:
        spans = targets.select(*g, "lo", "hi", "inside").distinct()
        width = (F.col("s.hi") - F.col("s.lo")) / RANGES
        held = d.alias("d").join(spans.alias("s"), on("d", "s") & (F.col("d.v") >= F.col("s.lo")) & (F.col("d.v") <= F.col("s.hi")))
        # a cell is a value where a range is a leaf, or too narrow for cells; "-0" and "0" are one
        one = (F.col("s.inside") <= LEAF) | (F.col("s.lo") + width == F.col("s.lo"))
        cell = F.when(one, F.col("d.v")).otherwise(F.least(F.floor((F.col("d.v") - F.col("s.lo")) / width), F.lit(RANGES - 1)).cast("double"))
        cells = held.select(*[F.col(f"d.{x}").alias(x) for x in g], "s.lo", "s.hi", cell.alias("cell"), "d.v")
        cells = cells.groupBy(*g, "lo", "hi", "cell").agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy(*g, "lo", "hi").orderBy("cell")
        cells = cells.withColumn("upto", F.sum("m").over(order)).alias("c")
        both = on("t", "c") & (F.col("t.lo") == F.col("c.lo")) & (F.col("t.hi") == F.col("c.hi")) & (F.col("t.rank") > F.col("c.upto") - F.col("c.m")) & (F.col("t.rank") <= F.col("c.upto"))
        found = targets.alias("t").join(cells, both)
        targets, more = _kept(found.select(*[F.col(f"t.{x}").alias(x) for x in g], F.col("c.least").alias("lo"), F.col("c.most").alias("hi"), F.col("c.m").alias("inside"), "t.name", (F.col("t.rank") - F.col("c.upto") + F.col("c.m")).alias("rank")), "lo < hi")
        if not more:
            break
    at = [F.max(F.when(F.col("name") == k, F.col("lo"))).alias(k) for k in ranks]
    out = totals.alias("a").join(targets.groupBy(*g).agg(*at).alias("b"), on("a", "b"), "left")
    return out.select(*[F.col(f"a.{x}").alias(c) for c, x in zip(group, g)], "a.n", "a.mean", *[f"b.{k}" for k in ranks])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _kept(df: DataFrame, open_: str = "false") -> tuple[DataFrame, bool]:
    """Computed once, and whether any row is `open_`. A few rows for each group: up to FEW they come
    back as a literal table that joins broadcast, beyond that they are checkpointed in the shared
    folder and joined by hash."""
    spark = df.sparkSession
    rows = df.withColumn("__open", F.expr(open_)).limit(FEW + 1).collect()
    if len(rows) <= FEW:
        literal = pa.Table.from_pylist([{c: r[c] for c in df.columns} for r in rows], to_arrow_schema(df.schema))
        return F.broadcast(spark.createDataFrame(literal, df.schema)), any(r["__open"] for r in rows)
    df = checkpointed(df)
    return df, df.where(open_).limit(1).count() > 0


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: computed once, and lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def at_ranks(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values of a column `v` of finite doubles at ranks counted from 1 in ascending order."""
    names = {f"r{i}": (lambda n, k=k: F.lit(k)) for i, k in enumerate(ranks)}
    row = summaries(values, [], names).first()
    return [row[k] for k in names]


def distribution(values: DataFrame, group: list[str]) -> DataFrame:
    """n, mean, median and p95 of each group."""
    d = summaries(values, group, {"low": LOW, "high": HIGH, "p95": P95})
    return d.select(*group, "n", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95")
