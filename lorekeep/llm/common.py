"""Helpers shared by the training-data operators: shared folder, Arrow slices, row keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Gives freed memory of the C library back to the system; not every C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)

#: Texts are handed to the per-task helpers in slices of about this many characters.
SLICE_CHARS = 2_000_000
#: Runs of a group in a range (`positions`) that are broadcast; more are joined by shuffle.
RUNS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir. A local one is
    made only where none is named and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorekeep-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; Spark removes the files with the frame."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def bounded(df: DataFrame, most: int) -> DataFrame:
    """A frame marked for broadcast if it has been counted and holds no more than `most` rows, else
    as it is, so that joins shuffle it. Hand over what is written or checkpointed: it is read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def positions(rows: DataFrame, group: list[str], order: list[str | Column], pos: str = "pos", size: str = "size") -> DataFrame:
    """`rows` with their place from 0 in their group, and the group's size (`group` holds no nulls).

    Rows are dealt to tasks by ranges of group and order, and by a row's own number where those are
    equal, so that no group and no run of ties lies in one task. Only the counts of a group in each
    range are summed up; they tell where each range begins. Hand over written rows: they are sampled
    for the ranges and then read again."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__lk_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "__lk_tie"]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__lk_tie")
    dealt = cut(dealt.withColumn("__lk_no", F.monotonically_increasing_id()))
    part = F.shiftright("__lk_no", 33).alias("__lk_part")
    runs = dealt.groupBy(*group, part).agg(F.min("__lk_no").alias("__lk_first"), F.count("*").alias("__lk_n"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__lk_n").over(own.orderBy("__lk_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select(*group, "__lk_part", (before - F.col("__lk_first")).alias("__lk_shift"), F.sum("__lk_n").over(own).alias(size)))
    dealt = dealt.select("*", part).join(bounded(runs, RUNS), [*group, "__lk_part"])
    return dealt.withColumn(pos, F.col("__lk_no") + F.col("__lk_shift")).drop("__lk_no", "__lk_part", "__lk_shift")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What names a row: its id and its text. Equal rows have equal keys and equal fates."""
    return [F.col(doc_id).alias("__lk_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__lk_th")]


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Lists of whole texts (null: empty), each list about `limit` bytes long."""
    n = len(texts)
    if n == 0:
        return
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in texts), np.int64, n)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < n:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield [x or "" for x in texts.slice(begin, end - begin).to_pylist()]
        begin = end
    pa.default_memory_pool().release_unused()
    _trim(0)  # a worker that waits for its next task keeps little


class Hashes:
    """Hashes of words, with a bounded memory of them."""

    def __init__(self, limit: int = 200_000) -> None:
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
