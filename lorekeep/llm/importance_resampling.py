"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (one and two words), one of target text and one of all
raw text, give each document the logarithm of their ratio, brought to `LENGTH` n-grams (the mean over
its n-grams times LENGTH), so that length decides nothing. Standard Gumbel noise is added and the
rows with the greatest keys stay: a sample without replacement in proportion to that ratio.

The counts cover whole texts of all rows: tasks sum their texts into `BUCKETS` counters and only
those meet. The k-th greatest key is found exactly by counting keys in ever narrower ranges, never
by sorting or gathering them.

Defined results: a null or empty text has no n-grams and ratio 0; the noise comes from a hash of
the row's id, text and the seed, so a repeated row meets the same fate; ties at the threshold stay
together, also where they exceed the share; an empty table gives an empty result; without target
rows all ratios are 0; whole texts of any length are read, one at a time. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lorekeep.llm.common import Hashes, cut, slices, table

BUCKETS = 1 << 14
SEED = 11
#: Target rows that the target model is fitted on, about; the raw model counts every row.
TARGET_ROWS = 20_000
#: N-grams that every text's ratio is brought to.
LENGTH = 50
#: Ranges in a round of the threshold search, and the most keys that are fetched at its end.
RANGES, FEW = 4096, 4096


def ngram_buckets(text: str, hashes: Hashes) -> np.ndarray:
    h = hashes(text.lower().encode().split())
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    mixed = np.concatenate([h, pairs]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(50)).astype(np.int64)


def _marked(docs: DataFrame, target: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """(text, whether the row is a target). About `most` target rows, chosen by the hash of their
    id, teach the target model, so their ids can be broadcast and no text is shuffled."""
    ids = target.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    share = int(min(1.0, most / max(1, ids.count())) * (1 << 30))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).withColumn("__lk_target", F.lit(True))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("__lk_target", F.lit(False)).alias("target"))


def bucket_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all buckets over target rows and over all rows, from (text, target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, all_, good = Hashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags = iter(batch.column(1).to_pylist())
            for part in slices(batch.column(0)):
                for text in part:
                    c = np.bincount(ngram_buckets(text, hashes), minlength=BUCKETS)
                    all_ += c
                    if next(flags):
                        good += c
        at = np.nonzero(all_)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(good[at]), pa.array(all_[at])], names=["bucket", "good", "raw"])

    found = rows.mapInArrow(count, "bucket bigint, good bigint, raw bigint").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).collect()  # at most BUCKETS rows
    good, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found:
        good[r["bucket"]], raw[r["bucket"]] = r["good"], r["raw"]
    return good, raw


def log_ratios(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if good.sum() == 0:
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def kth_greatest(keys: DataFrame, k: int) -> float | None:
    """The k-th greatest value of a column `key` of finite doubles; None if there are fewer."""
    span = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("n")).first()
    if k < 1 or span["n"] < k:
        return None
    lo, hi, above = span["lo"], span["hi"], 0
    while True:
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / RANGES
        if width <= 0 or lo + width == lo:
            return lo
        cell = F.least(F.lit(RANGES - 1), F.floor((F.col("key") - lo) / width)).cast("int")
        counts = {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}  # at most RANGES rows
        for c in sorted(counts, reverse=True):
            n, a, b = counts[c]
            if above + n >= k:
                break
            above += n
        if a == b:
            return a
        if n <= FEW:
            few = [r["key"] for r in keys.where((F.col("key") >= a) & (F.col("key") <= b)).select("key").collect()]
            return sorted(few, reverse=True)[k - above - 1]
        lo, hi = a, b


def resample(docs: DataFrame, target: DataFrame, share: float, length: float = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, log_ratio (of `length` n-grams like the text's), gumbel_key, kept. `target` lists the ids
    of target rows, `share` is the part of the rows that stays."""
    ratios = log_ratios(*bucket_counts(_marked(docs, target)))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for texts in batches:
            out = []
            for part in slices(texts):
                for text in part:
                    b = ngram_buckets(text, hashes)
                    out.append(length * float(ratios[b].mean()) if len(b) else 0.0)
            yield pa.array(out, pa.float64())

    even = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    gumbel = -F.log(-F.log(even))
    scored = cut(docs.select("doc_id", arrow_udf(score, "double")("text").alias("log_ratio"), gumbel.alias("g")).select("doc_id", "log_ratio", (F.col("log_ratio") + F.col("g")).alias("gumbel_key")))
    k = int(round(share * scored.count()))
    least = kth_greatest(scored.select(F.col("gumbel_key").alias("key")), k)
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))


def op3_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Target: rows labelled as good and not toxic. The share that stays is that of good quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return resample(docs, labels.where(good).select("doc_id"), 0.5 if share is None else float(share))
