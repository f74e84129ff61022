"""Hard negatives against all products, on odd rows and small buckets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, shard string, v string, ids string"


def plain(rows, positives=5, negatives=10, low=30, high=90, scale=256):
    ok = {(i, l, tuple(min(max(math.floor(scale * x) if abs(scale * x) < 2**53 else int(scale * x), int(-1.7e308)), int(1.7e308)) for x in v)) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a[2], b[2]))))
    out = []
    for a in (x for x in ok if x[0] % 100 == 0):
        rest = [(-score(a, b), b[0], b[1] == a[1]) for b in ok if b[0] != a[0] and len(b[2]) == len(a[2])]
        for p, i in sorted({x[:2] for x in rest if x[2]})[:positives]:
            band = sorted({x[:2] for x in rest if not x[2] and low * -p <= 100 * -x[0] <= high * -p})[:negatives]
            out += [(a[0], i, k + 1, j, -p, -n) for k, (n, j) in enumerate(band)]
    return sorted(out)


def mined(spark, rows, **sizes):
    d = H.usable(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA))
    return sorted(map(tuple, H.mine(d, d.where(F.col("vec_id") % 100 == 0), **sizes).collect()))


def clustered(n, dim, seed, labels=4):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, 0.6) for c in centers[i % labels]] if i % 3 else [x * 0.8 + rng.gauss(0, 0.3) for x in centers[(i + 1) % labels]], i % labels) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard_size": 150, "bucket": 40}, {"shard_size": 7, "bucket": 3}])
def test_clusters(spark, sizes):
    rows = clustered(600, 12, 5)
    assert mined(spark, rows, **sizes) == plain(rows) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(120, 3, 1, 2) + [(i, [0.5, 0.25, 0.1], 1) for i in range(200, 240)] * 2 + [(i, [0.5, 0.25, 0.1], 0) for i in range(300, 340)]
    rows += [(400, None, 1), (401, [nan, 1.0, 1.0], 1), (500, [inf, 1.0, 1.0], 1), (600, [1.0, None, 2.0], 0), (700, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 0), (800, [], 1), (900, [0.0, 0.0, 0.0], 0), (901, [0.0, 0.0, 0.0], 1)]
    rows += [(1000, [1.0, 2.0], 0), (1001, [1.0, 2.0], 0), (1002, [0.5, 1.0], 1), (1100, [-1.0, -1.0, -2.0], 1), (200, [0.1, 0.9, 0.3], 0)]
    assert mined(spark, rows, shard_size=50, bucket=16) == plain(rows)


def test_large_components(spark):
    rows = [(i, [3e7 * (1 + i % 5), 1e6 * (i % 7), 2.0 * i], i % 3) for i in range(0, 301, 4)] + [(2000, [1e300, 1.0, 1.0], 0), (2001, [1e300, 2.0, 1.0], 0), (2002, [1e299, 0.0, 0.0], 1)]
    assert mined(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert mined(spark, clustered(3, 3, 1)[:0]) == []


def test_buckets_are_pruned():
    """Far fewer rows than all are scored where anchors ask for large cosines."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True)) * np.exp(0.02 * rng.normal(size=(2000, 1)))
    x = np.floor(256 * x)
    far = np.sqrt((x * x).sum(1))
    order = np.argsort(-far)
    x, far = x[order], far[order]
    unit, ends = H._unit(x, far), list(range(0, 2001, 250))
    lists = np.concatenate([np.argsort(unit[a:b], axis=0, kind="stable").T.ravel() for a, b in zip(ends, ends[1:])]).astype(np.int32)
    shard = H.Shard(8, x.tobytes(), far.tobytes(), np.zeros(2000, np.int64).tobytes(), np.array(ends, np.int64).tobytes(), lists.tobytes(), [[i] for i in range(2000)])
    q = x[::40]
    least = 0.95 * np.sqrt((q * q).sum(1)) * far[::40]
    seen, right = 0, q @ x.T >= least[:, None]
    got = np.zeros(right.shape, bool)
    for b in shard.buckets():
        for i, rows, s in shard.reached(b, q, np.sqrt((q * q).sum(1)), least):
            seen += len(rows)
            got[i, rows] = s >= least[i]
    assert (got == right).all() and right.any() and shard.passed > 0 and shard.pruned > 200 and seen < 0.5 * right.size
