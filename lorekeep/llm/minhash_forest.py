"""MinHash near-dedup with an LSH forest.

A document's set is its distinct five-word shingles. Documents with equal sets form one class, and
classes go into a forest: `TREES` sorted orders of the signatures, each by its own row of `DEPTH`
min-hashes. A tree's region is a run of classes that share their first `LEAST_DEPTH` hashes. In
small regions all pairs are candidates; in large ones each class meets the next few in order, which
are those it shares the longest prefixes with, so depth adapts to how dense a region is.

Candidates are confirmed on full sets, first each class's most agreed-on partner, then every other
candidate that these links don't join already. Connected components of confirmed links follow.
What the neighbours may have missed is found exactly: in each large region (or one that lies across
two tasks) whose classes are not one component, the classes outside its largest component are
strays of that component. They are held against all of it and against each other, block by block:
by signature agreement, then on full sets. A block keeps its own union-find, so it tests no pair
that its links join already and returns no more links than it has components.

Defined results: null, empty and blank texts have no shingles, link with nothing and stay; texts
with fewer than five words have one shingle; the component is the least doc_id in it (nulls count
only where there is nothing else); an empty table gives an empty result; extra columns are ignored.
keep_first decides by rows, not by ids: of the rows of one component the one of the least doc_id
stays, and only rows equal in doc_id and text count as one. Repeated rows have equal results. Texts
of any length are read whole: a task holds the shingles of one text at a time, a block those of
BLOCK_BYTES or of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lorekeep.llm.common import Hashes, cut, slices, table
from lorekeep.llm.graph import Sets, components, counted, lifted

WORDS = 5
SIMILARITY = 75  # per cent
HASHES, TREES, DEPTH, LEAST_DEPTH = 64, 16, 8, 3
#: Next classes in order that are candidates in any region, and in regions of up to WIDE + 1.
NARROW, WIDE = 2, 8
#: Rows and bytes of sets of one block when strays are compared exactly.
BLOCK, BLOCK_BYTES = 2048, 16_000_000
#: Share of equal min-hashes from which a pair is held against full sets: for a pair at the
#: threshold it lies 4.6 standard deviations below.
AGREEMENT = 32 / HASHES

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: The hashes of each tree: the first LEAST_DEPTH belong to it alone, the others are shared.
_ROWS = np.array([[*range(t * LEAST_DEPTH, (t + 1) * LEAST_DEPTH), *_rng.permutation([h for h in range(HASHES) if h // LEAST_DEPTH != t])[: DEPTH - LEAST_DEPTH]] for t in range(TREES)])


def shingles(text: str, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    k = min(WORDS, len(h))
    v = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        v = v * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        v ^= v >> np.uint64(29)
    v = (v ^ v >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(v ^ v >> np.uint64(32))


def signature(v: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(v), 1024):
        out = np.minimum(out, ((v[k : k + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = Hashes()
    for texts in batches:
        n, keys, sigs = [], [], []
        for part in slices(texts):
            for text in part:
                v = shingles(text, hashes)
                n.append(len(v))
                keys.append(xxhash.xxh3_128_digest(v.tobytes()) if len(v) else None)
                sigs.append(signature(v).astype(">u4").tobytes() if len(v) else None)
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["n", "set_key", "sig"])


def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = Hashes()
    for texts in batches:
        sets = [shingles(t, hashes).tobytes() for part in slices(texts) for t in part]
        yield pa.StructArray.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "shingles"])


def _linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        out = []
        for a, b in zip(left, right):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                out.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= SIMILARITY * (len(x) + len(y) - common))
        yield pa.array(out, pa.bool_())


def forest(classes: DataFrame, *more: str) -> DataFrame:
    """(tree, label, nid, more ...): the min-hashes of each tree in order, as bytes that sort alike;
    `more` are long columns of the class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(n, HASHES)
                labels = np.ascontiguousarray(sig[:, _ROWS]).reshape(n * TREES, DEPTH)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), n * TREES, [None, pa.py_buffer(labels)]).cast(pa.binary())
                longs = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), TREES)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), raw, *longs], names=["tree", "label", "nid", *more])

    return classes.select("sig", "nid", *more).mapInArrow(rows, "tree int, label binary, nid bigint" + "".join(f", {m} bigint" for m in more))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among rows in order; the last rows of a batch are looked at again with the next.
    The first and the last row of a task come as pairs with themselves, with their region: it may
    go on in another task."""
    region, nid = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    fresh = 0  # rows before this have met all that follow in earlier batches
    first = last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, DEPTH)
        new = np.concatenate([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[:, None], labels[:, :LEAST_DEPTH].astype(np.int64)], 1)
        place = lambda k: (batch.column(2)[k].as_py(), batch.column(0)[k].as_py(), batch.column(1)[k].as_py()[: 4 * LEAST_DEPTH])  # noqa: B023, E731
        first, last = first or place(0), place(n - 1)
        old = len(nid)
        region, nid = np.concatenate([region, new]), np.concatenate([nid, batch.column(2).to_numpy(zero_copy_only=False)])
        total = len(nid)
        same = lambda i, j: (region[i] == region[j]).all(1)  # noqa: B023, E731
        a, b = [], []
        for j in range(1, WIDE + 1):
            i = np.arange(max(0, old - j, fresh), total - j)
            i = i[same(i, i + j)] if len(i) else i
            if j > NARROW and len(i):
                end, begin = i + WIDE + 1, i + j - WIDE - 1
                large = np.zeros(len(i), bool)
                ok = end < total
                large[ok] = same(i[ok], end[ok])
                ok = begin >= 0
                large[ok] |= same(begin[ok], i[ok])
                i = i[~large]
            a.append(nid[i])
            b.append(nid[i + j] if len(i) else nid[:0])
        a, b = np.concatenate(a), np.concatenate(b)
        yield _candidates(np.minimum(a, b), np.maximum(a, b), [None] * len(a), [None] * len(a))
        keep = 2 * WIDE + 2
        region, nid = region[-keep:], nid[-keep:]
    if first:
        ids, trees, prefixes = zip(*{first, last})
        yield _candidates(np.array(ids), np.array(ids), trees, prefixes)


def _candidates(a: np.ndarray, b: np.ndarray, tree, prefix) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(tree, pa.int32()), pa.array(prefix, pa.binary())], names=["a", "b", "tree", "prefix"])


def _links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links of strays (left) to members (right) of other components, as pairs of roots: no more
    than are needed to join what the block's links join."""
    out, sets = [], Sets()
    if len(left) and len(right):
        sig = np.frombuffer(b"".join(right["sig"]), np.uint32).reshape(-1, HASHES)
        own = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
        sizes, roots = np.fromiter(map(len, own), np.int64, len(own)), right["root"].to_numpy()
        for root, s, shingle in zip(left["root"].tolist(), left["sig"], left["shingles"]):
            mine = np.frombuffer(shingle, np.uint64)
            n, top = len(mine), sets.find(root)
            fits = (100 * np.minimum(sizes, n) >= SIMILARITY * np.maximum(sizes, n)) & (roots != root)
            at = np.nonzero(fits)[0]
            agreed = (sig[at] == np.frombuffer(s, np.uint32)).sum(1)
            order = np.argsort(-agreed, kind="stable")
            at = at[order[agreed[order] >= AGREEMENT * HASHES]]
            for k in range(0, len(at), 64):
                part = [i for i in at[k : k + 64].tolist() if sets.find(int(roots[i])) != top]
                if not part:
                    continue
                every = np.concatenate([own[i] for i in part])
                found = mine[np.minimum(np.searchsorted(mine, every), n - 1)] == every
                common = np.add.reduceat(found, np.cumsum([0, *sizes[part[:-1]]]))
                for i, c in zip(part, common.tolist()):
                    if 100 * c >= SIMILARITY * (n + int(sizes[i]) - c) and sets.join(root, int(roots[i])):
                        out.append((root, int(roots[i])))
                        top = sets.find(root)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def rest_of_regions(rooted: DataFrame, sets: DataFrame, bounds: DataFrame) -> DataFrame | None:
    """Links (a, b: roots) that candidates have missed. rooted: (nid, sig, root) of all classes that
    have candidates; sets: (nid, shingles); bounds: (tree, prefix) of regions that lie across tasks."""
    region = [F.col("tree"), F.substring("label", 1, 4 * LEAST_DEPTH).alias("prefix")]
    places = forest(rooted, "root").select(*region, "nid", "root")
    by_root = places.groupBy("tree", "prefix", "root").agg(F.count("*").alias("n"))
    regions = by_root.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    across = F.broadcast(bounds.distinct().withColumn("across", F.lit(True)))  # two rows a task at most
    regions = regions.join(across, ["tree", "prefix"], "left").where((F.col("n") > WIDE + 1) | F.col("across")).select("tree", "prefix", F.col("top.root").alias("main"))
    strays, n = counted(places.join(regions.hint("merge"), ["tree", "prefix"]).where("root <> main").select("main", "nid").distinct())
    if not n:
        return None
    full = rooted.join(sets.hint("merge"), "nid")
    strays = strays.join(full.hint("merge"), "nid").select("main", "nid", "root", "sig", "shingles")
    strays = cut(strays)
    blocks = lambda size: F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1))).cast("int").alias(size)
    weight = [F.lit(1).alias("n"), F.length("shingles").alias("bytes")]
    few = strays.select("main", *weight).groupBy("main").agg(blocks("sb_n"))
    inside = full.join(few.select(F.col("main").alias("root")).hint("merge"), "root", "left_semi").select(F.col("root").alias("main"), "nid", "root", "sig", "shingles")
    members = cut(inside.unionByName(strays))
    many = members.select("main", *weight).groupBy("main").agg(blocks("mb_n"))
    size = cut(few.join(many.hint("merge"), "main"))
    at = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ["main", "root", "sig", "shingles"]
    left = strays.join(size.hint("merge"), "main").select(*row, at("sb_n").alias("sb"), spread("mb_n").alias("mb"))
    right = members.join(size.hint("merge"), "main").select(*row, at("mb_n").alias("mb"), spread("sb_n").alias("sb"))
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own, so the two sides are told apart
    cell = ["main", "mb", "sb"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_links, "a bigint, b bigint")


def _row() -> Column:
    """Names a row by its id and text, so null ids and shared ids don't meet."""
    return F.xxhash64("doc_id", "text")


def _first(doc_id: str) -> Column:
    """The least (id, row) of a group; null ids come last."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "row"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n, key) and classes (key, nid, rep, row: of its first row, root): the root
    names the component. Rows without shingles have a key of their own and no class."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text", _row().alias("row"))
    f = arrow_udf(_features, "struct<n:bigint,set_key:binary,sig:binary>")("text")
    rows = cut(docs.select("doc_id", "row", f.alias("f")).select("doc_id", "row", "f.n", F.coalesce("f.set_key", F.encode(F.col("row").cast("string"), "utf-8")).alias("key"), "f.sig"))
    by_set = rows.where("sig IS NOT NULL").groupBy("key").agg(_first("doc_id").alias("first"), F.first("sig").alias("sig"))
    classes = cut(by_set.select("key", F.col("first.id").alias("rep"), "first.row", "sig", F.monotonically_increasing_id().alias("nid")))
    order = forest(classes).repartitionByRange(parts, "tree", "label", "nid").sortWithinPartitions("tree", "label", "nid")
    found, _ = counted(order.mapInArrow(_neighbours, "a bigint, b bigint, tree int, prefix binary").groupBy("a", "b", "tree", "prefix").agg(F.count("*").alias("votes")))
    bounds, pairs = found.where("a = b").select("tree", "prefix"), found.where("a <> b").select("a", "b", "votes")

    ends = found.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    wanted = cut(classes.join(ends.hint("merge"), "nid").select("nid", "key", "row", "sig"))
    # not deterministic for the optimiser: else it moves the sets and their keys below the join, to all documents
    set_of = arrow_udf(_sets, "struct<set_key:binary,shingles:binary>").asNondeterministic()
    text = docs.select("row", "text").join(wanted.select("row", "nid", "key").hint("merge"), "row").select("nid", "key", set_of("text").alias("s"))
    sets = cut(text.where("key = s.set_key").select("nid", "s.shingles").dropDuplicates(["nid"]))

    def confirmed(some: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("nid").alias(x), F.col("shingles").alias(f"s{x}")).hint("merge")
        both = some.join(side("a"), "a").join(side("b"), "b")
        return both.where(arrow_udf(_linked, "boolean")("sa", "sb")).drop("sa", "sb")

    facing = pairs.select("a", "b", "votes").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes"))
    # of the most agreed-on partners the least: they gather around few classes, so chains are short
    best = facing.groupBy("a").agg(F.max(F.struct("votes", (-F.col("b")).alias("to"))).alias("m")).select(F.least("a", -F.col("m.to")).alias("a"), F.greatest("a", -F.col("m.to")).alias("b")).distinct()
    roots = components(confirmed(best))
    node = F.col("nid")
    rooted = wanted.select("nid", "sig")
    rooted = rooted.withColumn("root", node) if roots is None else rooted.join(roots.withColumnRenamed("node", "nid").hint("merge"), "nid", "left").withColumn("root", F.coalesce("root", node))
    rooted = cut(rooted)
    named = lambda x: rooted.select(node.alias(x), F.col("root").alias(f"root_{x}")).hint("merge")
    apart = pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b").where("root_a <> root_b")
    more = components(confirmed(apart).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    rooted = rooted if more is None else cut(lifted(rooted, more))
    rest = rest_of_regions(rooted, sets, bounds)
    rooted = rooted if rest is None else lifted(rooted, components(rest))
    group = classes.drop("sig").join(rooted.select("nid", "root").hint("merge"), "nid", "left").withColumn("root", F.coalesce("root", node))
    return rows.drop("sig"), cut(group)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows, classes = _grouped(docs)
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = cut(classes.select("key", "root").join(least.hint("merge"), "root").select("key", "component_id"))
    d = rows.join(known.hint("merge"), "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return d.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with the columns it came with; of rows equal in doc_id and text one."""
    rows, classes = _grouped(docs)
    firsts = classes.groupBy("root").agg(_first("rep").alias("first")).select(F.col("first.row").alias("__lk_kept"))
    kept = firsts.unionByName(rows.where("n = 0").select(F.col("row").alias("__lk_kept")))
    # the first of equal rows is found before rows are dealt, so any number of them makes no large task
    d = docs.withColumn("__lk_row", _row())
    d = d.withColumn("__lk_rn", F.row_number().over(Window.partitionBy("__lk_row").orderBy("doc_id"))).where("__lk_rn = 1")
    return d.join(kept.hint("merge"), d["__lk_row"] == kept["__lk_kept"], "left_semi").drop("__lk_rn", "__lk_row")


def op9_lsh_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
