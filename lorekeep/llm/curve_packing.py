"""Packing along a space-filling curve.

Each document's hashed token vector is projected to three dimensions, the dimensions are brought to
even marginals by corpus means and deviations, and a Hilbert key orders the documents. Documents
stand one after the other along the curve and the row of ids is cut every `SEQUENCE` tokens; what
remains at the very end is cut at powers of two, so no sequence needs padding.

The order is made in two steps that never gather rows: a sample of sort keys, weighed by their ids,
gives bucket bounds, bucket totals (one row per bucket) give each bucket's place in the whole row of
ids, then the buckets are dealt out, sorted, and cut task by task. The number of buckets grows with
the ids. The sort key ends in a salt of each row, so a large group of copies, which share a Hilbert
key, spreads over buckets, whatever their doc_id. A bucket's work streams.

Defined results: a null or empty text is the end id alone; the literal of the file's special token
in a text is that one id, as the tokenizers library reads it by default; repeated rows are packed
one by one; an empty table gives no pieces; ties along the curve are ordered by a salt; texts of any
length are packed whole, a task holding the ids of one; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from lorekeep.llm.common import slices, table, written
from lorekeep.llm.segments import Joined

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 2048
END_ID = 1
DIMS, BITS, HASHES = 3, 10, 4096
SALT_BITS = 22
#: The file's special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Ids of a bucket, about, where there are more than 8 buckets a shuffle partition; sampled keys of a bucket.
BUCKET_IDS, BUCKET_KEYS = 1 << 25, 64


def byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a tokenizers byte-level BPE file as bytes and ranks (ids in merge order)."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token)}


@lru_cache(maxsize=2)
def _joined(path: str) -> Joined:
    """The ids that tokenizers gives for the file. tiktoken finds the same ids from the same
    vocabulary in a quarter of the time; the tests hold them against tokenizers."""
    ranks = byte_ranks(path)
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    ranks = {t: i for t, i in ranks.items() if t != SPECIAL.encode()}
    return Joined(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each whole text, little-endian unsigned 16-bit. Special tokens part a text."""
    special = np.array([SPECIAL_ID], "<u2").tobytes()
    parted = [t.split(SPECIAL) for t in texts]
    got = iter(_joined(path)([part for parts in parted for part in parts]))
    return [special.join([next(got) for _ in parts]) for parts in parted]


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((HASHES, DIMS)).astype(np.float32)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, unsigned 16-bit, with the end id), n, and the projections x0, x1, x2."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        directions, end = _directions(), np.array([END_ID], "<u2").tobytes()
        for texts in batches:
            blobs, points = [], []
            for part in slices(texts):
                for ids in encode_texts(part, path):
                    v = np.frombuffer(ids, "<u2").astype(np.uint32)
                    counts = np.bincount(((v * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), minlength=HASHES).astype(np.float32)
                    points.append(counts @ directions / max(1.0, float(np.sqrt(counts @ counts))))
                    blobs.append(ids + end)
            p = np.array(points, np.float64).reshape(-1, DIMS)
            yield pa.StructArray.from_arrays([pa.array(blobs, pa.binary()), pa.array([len(b) // 2 for b in blobs], pa.int64()), *(pa.array(p[:, k]) for k in range(DIMS))], names=["ids", "n", *(f"x{k}" for k in range(DIMS))])

    kind = "struct<ids:binary,n:bigint," + ",".join(f"x{k}:double" for k in range(DIMS)) + ">"
    return docs.select("doc_id", arrow_udf(encode, kind)("text").alias("t")).select("doc_id", "t.*")


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points with integer coordinates along the Hilbert curve (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_key(points: list[str], stats: list[tuple[float, float]]) -> Column:
    """Hilbert key of standardised coordinates, brought to even cells by the logistic curve."""

    def key(xs: pd.DataFrame) -> pd.Series:
        z = np.stack([(xs.iloc[:, k].to_numpy() - m) / (s or 1.0) for k, (m, s) in enumerate(stats)], 1)
        cells = np.clip((1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return pd.Series(hilbert_index(cells))

    return pandas_udf(key, "bigint")(F.struct(*points))


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the ids themselves if wanted."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << SALT_BITS))
    rows = written(tokenized(docs.select("doc_id", "text"), path).withColumn("salt", salt), "packing")
    points = [f"x{k}" for k in range(DIMS)]
    s = rows.agg(*[f(c) for c in points for f in (F.avg, F.stddev_pop)], F.count("*"), F.sum("n")).first()
    stats = [(s[2 * k] or 0.0, s[2 * k + 1] or 0.0) for k in range(DIMS)]
    n_rows, n_ids = s[2 * DIMS], s[2 * DIMS + 1] or 0
    keyed = rows.withColumn("key", F.shiftleft(curve_key(points, stats), SALT_BITS).bitwiseOR(F.col("salt"))).drop("salt", *points)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(8 * parts, n_ids // BUCKET_IDS)
    share = min(1.0, BUCKET_KEYS * n_buckets / max(1, n_rows))
    some = keyed.select("key", "n").sample(share, seed=3).toArrow()  # about BUCKET_KEYS keys a bucket, only to set bounds
    keys, weights = some.column("key").to_numpy(), some.column("n").to_numpy()
    order = np.argsort(keys, kind="stable")
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n_buckets) / n_buckets) if len(upto) else np.zeros(0, np.int64)
    bounds = np.unique(keys[order][at])

    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    keyed = keyed.withColumn("bucket", pandas_udf(place, "int")("key"))
    totals = {r["bucket"]: r["n"] for r in keyed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row a bucket
    begins, whole = {}, 0
    for b in sorted(totals):
        begins[b] = whole
        whole += totals[b]
    full = whole // sequence
    tail, at = [], full * sequence  # begins of the last sequences, each a power of two long
    for b in range(sequence.bit_length() - 1, -1, -1):
        if (whole % sequence) >> b & 1:
            tail.append(at)
            at += 1 << b

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at, ends = None, 0, np.array(tail[1:] + [whole], np.int64) if tail else np.zeros(0, np.int64)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            if not with_ids:
                del out["ids"]
            buckets, docs_, ns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "doc_id", "n"))
            for b, doc, n, blob in zip(buckets, docs_, ns, batch.column(batch.schema.get_field_index("ids"))):
                if b != bucket:
                    bucket, at = b, begins[b]
                wide = np.frombuffer(blob.as_buffer(), "<u2").astype("<u4")  # one document's ids, not the batch's
                start = 0
                while start < n:
                    if at < full * sequence:
                        seq, offset = divmod(at, sequence)
                        room = sequence - offset
                    else:
                        k = int(np.searchsorted(ends, at, side="right"))
                        seq, offset, room = full + k, at - tail[k], int(ends[k]) - at
                    length = min(room, n - start)
                    piece = wide[start : start + length].tobytes()
                    for name, value in zip(out, (doc, start, length, zlib.crc32(piece), n, seq, offset, piece)):
                        out[name].append(value)
                    start += length
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    dealt = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "doc_id").select("bucket", "doc_id", "n", "ids")
    kind = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.mapInArrow(cut, kind + (", ids binary" if with_ids else ""))


def op1_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)
