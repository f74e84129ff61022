"""Signatures of a corpus that tell what changed.

Each row is hashed over its whole content and its permission fields (128 bits). Rows fall into
buckets by their key; a bucket's checksum is its count and the sums and exclusive-ors of its rows'
hashes, so order doesn't matter and equal rows don't cancel out. The row hashes are kept in the same
buckets. Two signatures are compared bucket by bucket, and only the rows of buckets that differ are
read and compared by key: the work of finding changes follows the changes, not the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.plans.operator import operator
from lorekeep.sources.files import scratch
from lorekeep.sources.store import VersionedTable

#: Fields of a row that its hash covers.
FIELDS = ("kb_group", "visibility", "text")
BUCKETS = 64


def row_hash(*fields: str) -> Column:
    """128 bits in hex: nulls and field ends are told apart by each field's length."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(*[part(c) for c in fields]))


@dataclass(frozen=True)
class Signature:
    """buckets (bucket, n, s1..s4, x1..x4) and the stored row hashes (key, n, h) behind them."""

    buckets: DataFrame
    rows: VersionedTable
    key: str


def checksums() -> list[Column]:
    word = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("bigint")
    return [F.sum("n").alias("n"), *[F.sum(word(k) * F.col("n")).alias(f"s{k + 1}") for k in range(4)], *[F.bit_xor(word(k)).alias(f"x{k + 1}") for k in range(4)]]


def sign(docs: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = FIELDS, buckets: int = BUCKETS) -> Signature:
    """The signature of `docs`, written to the shared folder. Rows equal in all count by number."""
    table = VersionedTable(docs.sparkSession, scratch(docs.sparkSession, "signature"), key, buckets)
    table.write(docs.select(key, row_hash(key, *fields).alias("h")).groupBy(key, "h").agg(F.count("*").alias("n")))
    rows = table.read()
    return Signature(rows.groupBy(table.bucket_of(key).alias("bucket")).agg(*checksums()), table, key)


def differing(old: Signature, new: Signature) -> set[int]:
    """The buckets that are not equal; no more than there are buckets."""
    sums = [c for c in old.buckets.columns if c != "bucket"]
    both = old.buckets.select("bucket", F.struct(*sums).alias("a")).join(new.buckets.select("bucket", F.struct(*sums).alias("b")), "bucket", "full")
    return {r["bucket"] for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect()}


def changed_documents(old: Signature, new: Signature) -> DataFrame:
    """(key, state): 'added', 'removed' or 'changed' (content or permissions)."""
    if old.rows.buckets != new.rows.buckets or old.key != new.key:
        raise ValueError("signatures of different buckets or keys")
    where, key = differing(old, new), old.key
    read = lambda s, name: s.rows.read(buckets=where).groupBy(key).agg(F.struct(*checksums()).alias(name))
    a, b = read(old, "was"), read(new, "now").withColumnRenamed(key, "__key")
    both = a.join(b, F.col(key).eqNullSafe(F.col("__key")), "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select(F.coalesce(key, "__key").alias(key), F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("state"))


_ROWS = "SELECT md5(concat(CAST(length(CAST(doc_id AS STRING)) AS STRING), ':', CAST(doc_id AS STRING), {parts})) AS h FROM {src}"


def _hashes(src: str) -> str:
    part = lambda c: f"coalesce(concat(CAST(length({c}) AS STRING), ':', {c}), '-')"
    return _ROWS.format(parts=", ".join(map(part, FIELDS)), src=src)


signature = operator("agg_signature", "Signature of a corpus: count, and order-free sums and exclusive-ors over the 128-bit hashes of whole rows.", lambda d: f"""
SELECT count(*) AS n, {', '.join(f"CAST(sum({d.hex32('h', 8 * k + 1)}) AS BIGINT) AS s{k + 1}, bit_xor({d.hex32('h', 8 * k + 1)}) AS x{k + 1}" for k in range(4))} FROM ({_hashes('kb_docs')}) x""")


def mnt_changed_documents(spark, sf_dir: str) -> DataFrame:
    """What changed between two states of the base: edits, permission edits, removals, additions."""
    from lorekeep.plans.operator import view

    return changed_documents(sign(view(spark, sf_dir, "kb_docs")), sign(view(spark, sf_dir, "kb_docs_later")))


QUERIES = {"mnt_changed_documents": mnt_changed_documents}
CHANGED = """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM kb_docs o FULL OUTER JOIN kb_docs_later n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text OR o.kb_group IS DISTINCT FROM n.kb_group OR o.visibility IS DISTINCT FROM n.visibility"""
