"""Merkle manifest of a dataset: a tree of hashes for each group of rows, a tree of the groups above.

A row's leaf is the hash of its fields; leaves of a group stand in order, every `FANOUT` nodes in a
row have a parent. A level is made by a slot pivot: conditional aggregates spread each parent's
children over the columns c0, c1, ...; all columns in a row hash to the parent, all but the own one
are a child's siblings. Each level is an eighth of the one below it and is written before the next.
Paths are built downwards: a parent's path, with a child's siblings before it, is the child's path.

Rows get their places by ranges (`common.positions`), so a group of any size is spread over all
tasks, and no level keeps more than the children of one parent together. The driver learns the size
of the largest group, which tells the number of levels, and the root.

Defined results: null fields are written as `-`; a null group is a group of its own and comes first;
null ids come first in their group; ties in the id go by leaf; rows equal in all fields stand side by
side as so many leaves; an empty table gives an empty result; texts of any length are hashed whole;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, positions, table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOTS = [f"c{k}" for k in range(FANOUT)]


def digest(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of the parts one after another; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row, with other values for some of its fields."""
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.octet_length(text) == F.length(text)  # lower() then changes A-Z alone
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


@dataclass
class Tree:
    """Levels from the leaves upwards (group, idx: the parent's place, c0 ...) and the top nodes
    (group, depth, digest) of all groups."""

    levels: list[DataFrame]
    tops: DataFrame
    nodes: DataFrame


def climb(nodes: DataFrame) -> Tree:
    """nodes: group, pos, size (of the group), node (a struct with a field `digest`)."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels: list[DataFrame] = []
    now, tops = nodes, nodes.where("size = 1").select("group", F.lit(0).alias("depth"), "node.digest")
    while most > 1:
        slot = F.col("pos") % FANOUT
        spread = [F.max(F.when(slot == k, F.col("node"))).alias(c) for k, c in enumerate(_SLOTS)]
        level = now.where("size > 1").groupBy("group", F.floor(F.col("pos") / FANOUT).alias("pos"), F.ceil(F.col("size") / FANOUT).alias("size")).agg(*spread)
        levels.append(cut(level))
        parent = F.struct(digest(*[f"{c}.digest" for c in _SLOTS]).alias("digest"))
        now = levels[-1].select("group", "pos", "size", parent.alias("node"))
        tops = tops.unionByName(now.where("size = 1").select("group", F.lit(len(levels)).alias("depth"), "node.digest"))
        most = -(-most // FANOUT)
    return Tree(levels, cut(tops), nodes)


def descend(tree: Tree, above: DataFrame) -> DataFrame:
    """(group, pos, node, subroot, path) of all leaves. above: (group, path) of the groups' top nodes.
    A path holds (left, right): the siblings on both sides, from the leaf's level upwards."""
    starts = cut(tree.tops.join(above, "group").select("group", F.lit(0).cast("long").alias("pos"), "depth", F.col("digest").alias("subroot"), "path"))
    at = starts.where(F.col("depth") == len(tree.levels)).drop("depth")
    for depth in reversed(range(len(tree.levels))):
        side = lambda cs: F.concat_ws("", *[f"{c}.digest" for c in cs])
        children = [F.struct(F.lit(k).alias("slot"), F.col(c).alias("node"), F.struct(side(_SLOTS[:k]).alias("left"), side(_SLOTS[k + 1 :]).alias("right")).alias("step")) for k, c in enumerate(_SLOTS)]
        both = tree.levels[depth].drop("size").join(at, ["group", "pos"])
        each = both.select("group", "pos", "subroot", "path", F.explode(F.array(*children)).alias("x")).where("x.node IS NOT NULL")
        at = each.select("group", (F.col("pos") * FANOUT + F.col("x.slot")).alias("pos"), *(["x.node"] if depth == 0 else []), "subroot", F.concat(F.array("x.step"), F.col("path")).alias("path"))
        if depth:
            at = at.unionByName(starts.where(F.col("depth") == depth).drop("depth"))
    lone = tree.nodes.where("size = 1").select("group", "pos", "node").join(starts.where("depth = 0").select("group", "subroot", "path"), "group")
    return at.unionByName(lone) if tree.levels else lone


def manifest(leaves: DataFrame, order: list[str | Column]) -> tuple[DataFrame, str | None]:
    """Rows (node, subroot, path) and the root. leaves: group (no nulls, its order is that of the
    subroots) and node, a struct with a field `digest`."""
    tree = climb(cut(positions(cut(leaves), ["group"], order)))
    tops = tree.tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    crown = climb(cut(positions(tops, ["group"], ["name"]).select("group", "pos", "size", F.struct("digest", "name").alias("node"))))
    root = crown.tops.first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    names = descend(crown, crown.tops.select("group", none.alias("path"))).select(F.col("node.name").alias("group"), "path")
    return descend(tree, cut(names)).select("node", "subroot", "path"), root and root["digest"]


def proof(path: Column) -> Column:
    """Hash of all siblings from the leaf's level to the root's, left to right."""
    return digest(F.flatten(F.transform(path, lambda x: F.array(x["left"], x["right"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def verified(docs: DataFrame, tampered: Column, tampering: Column) -> DataFrame:
    """The manifest of `docs` and each row's check: rows where `tampered` holds are hashed again
    with the text `tampering`, all others with their own leaf."""
    again = F.when(tampered & F.col("text").isNotNull(), leaf_of(text=tampering))
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    leaves = docs.select(group.alias("group"), F.struct(leaf_of().alias("digest"), "doc_id", again.alias("again")).alias("node"))
    rows, root = manifest(leaves, [F.col("node.doc_id"), F.col("node.digest")])
    back = folded(F.coalesce("node.again", "node.digest"), F.col("path"))
    rows = rows.select("node.doc_id", F.col("node.digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_slot_pivot_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return verified(docs, hit, lowered(F.col("text")))


def oracle(levels: int = 12, crown: int = 6) -> str:
    """DuckDB text: trees of up to 8^levels leaves a language and 8^crown languages, level by level."""
    f = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(f(x) for x in FIELDS[:-1])
    parts = [f"src AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({head} || {f('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {f(low)}) END AS again FROM documents)"]
    parts.append("n0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS d FROM src)")

    def tree(n: str, p: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{p}{k} AS (SELECT g, i // {FANOUT} AS i, (n + {FANOUT - 1}) // {FANOUT} AS n, list(d ORDER BY i) AS kids FROM {n}{k} WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{n}{k + 1} AS (SELECT g, i, n, sha256(array_to_string(kids, '')) AS d FROM {p}{k} UNION ALL SELECT g, i, n, d FROM {n}{k} WHERE n = 1)")

    tree("n", "p", levels)
    parts.append(f"m0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d, g AS name FROM n{levels})")
    tree("m", "q", crown)
    parts.append(f"f0 AS (SELECT s.*, i AS j, coalesce(again, leaf) AS h, '' AS proof FROM n0 s)")
    steps = [("p", k, "g") for k in range(levels)] + [("q", k, "''") for k in range(crown)]
    for at, (p, k, g) in enumerate(steps):
        if at == levels:
            parts.append(f"g{at} AS (SELECT f.* EXCLUDE (j), m.i AS j, m.d AS subroot FROM f{at} f JOIN m0 m ON m.name = f.g)")
        parts.append(
            f"f{at + 1} AS (SELECT f.* EXCLUDE (j, h, proof), f.j // {FANOUT} AS j, CASE WHEN p.kids IS NULL THEN h ELSE sha256(array_to_string(list_concat(p.kids[:f.j % {FANOUT}], [h], p.kids[f.j % {FANOUT} + 2:]), '')) END AS h, "
            f"proof || coalesce(array_to_string(list_concat(p.kids[:f.j % {FANOUT}], p.kids[f.j % {FANOUT} + 2:]), ''), '') AS proof FROM {'g' if at == levels else 'f'}{at} f LEFT JOIN {p}{k} p ON p.g = {'f.' + g if g == 'g' else g} AND p.i = f.j // {FANOUT})"
        )
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in parts) + f"\nSELECT doc_id, leaf, subroot, r.root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.root AS verified FROM f{levels + crown} CROSS JOIN (SELECT d AS root FROM m{crown}) r"
