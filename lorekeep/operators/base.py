"""Maintaining a knowledge base on the versioned store: each call is one version, or none if it fails.

A catalog is a table keyed by file_path with file_hash, kb_group and visibility; other columns pass
through. Incoming rows of one path count by the greatest hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.plans.operator import view
from lorekeep.sources.files import scratch
from lorekeep.sources.store import VersionedTable

PERMISSIONS = ("kb_group", "visibility")


def catalog(spark: SparkSession, path: str, buckets: int = 32) -> VersionedTable:
    return VersionedTable(spark, path, "file_path", buckets)


def actions(table: VersionedTable, incoming: DataFrame, version: int | None = None) -> DataFrame:
    """`incoming` with what becomes of each row: insert, update, or skip where path and hash are known.
    The rows that are there already come along as `was`."""
    best = Window.partitionBy("file_path").orderBy(F.desc("file_hash"))
    new = incoming.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    old = table.read(version)
    was = old.select(F.col("file_path").alias("__path"), F.struct(*old.columns).alias("was"))
    kind = F.when(F.col("__path").isNull(), "insert").when(F.col("was.file_hash").eqNullSafe(F.col("file_hash")), "skip").otherwise("update")
    return new.join(was, F.col("file_path").eqNullSafe(F.col("__path")), "left").select(*new.columns, "was", kind.alias("action"))


def _fields(table: VersionedTable) -> list[str]:
    return table.version().schema.names


def add(table: VersionedTable, incoming: DataFrame) -> int:
    """New and changed files come in as they are given; known ones are skipped."""
    base = table.version().number
    found = actions(table, incoming, base).where("action <> 'skip'")
    return table.upsert(found.select(*_fields(table)), base)


def update(table: VersionedTable, incoming: DataFrame) -> int:
    """The same, but a changed file keeps the permissions that it has."""
    base = table.version().number
    found = actions(table, incoming, base).where("action <> 'skip'")
    kept = {c: F.coalesce(F.col(f"was.{c}"), F.col(c)).alias(c) for c in PERMISSIONS}
    return table.upsert(found.select(*[kept.get(c, F.col(c)) for c in _fields(table)]), base)


def remove(table: VersionedTable, backup: VersionedTable, paths: DataFrame) -> int:
    """Files go; their rows are in `backup` (a version of its own) before they do."""
    base = table.version().number
    backup.write(table.read(base).join(paths.select("file_path").distinct(), "file_path", "left_semi").select(*_fields(table)))
    return table.delete(paths, base)


def permit(table: VersionedTable, changes: DataFrame) -> int:
    """Permissions of listed files (file_path, kb_group, visibility; null: as it is) changed."""
    base = table.version().number
    new = changes.select(F.col("file_path").alias("__path"), *[F.col(c).alias(f"__{c}") for c in PERMISSIONS]).dropDuplicates(["__path"])
    rows = table.read(base).join(new, F.col("file_path") == F.col("__path"))
    given = {c: F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in PERMISSIONS}
    return table.upsert(rows.select(*[given.get(c, F.col(c)) for c in _fields(table)]), base)


_COLUMNS = ["file_path", "file_hash", "kb_group", "visibility"]


def _started(spark: SparkSession, sf_dir: str, name: str) -> tuple[VersionedTable, DataFrame]:
    table = catalog(spark, scratch(spark, name))
    table.write(view(spark, sf_dir, "kb_docs").select(*_COLUMNS))
    return table, view(spark, sf_dir, "kb_docs_new")


def mnt_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after a batch: what each row is and where it comes from."""
    table, batch = _started(spark, sf_dir, "add")
    add(table, batch)
    now, before = table.read(), table.read(1).select(F.col("file_path").alias("p"), F.col("file_hash").alias("was"))
    state = F.when(F.col("p").isNull(), "insert").when(F.col("was") == F.col("file_hash"), "same").otherwise("update")
    return now.join(before, now["file_path"] == before["p"], "left").select(*_COLUMNS, state.alias("state"))


def mnt_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows, old rows that the batch doesn't replace, permissions carried over."""
    table, batch = _started(spark, sf_dir, "update")
    update(table, batch)
    return table.read()


def mnt_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays and what is backed up when files go."""
    table, batch = _started(spark, sf_dir, "remove")
    backup = catalog(spark, scratch(spark, "backup"))
    remove(table, backup, batch.where("doc_id % 2 = 0"))
    part = lambda t, name: t.read().select("file_path", F.lit(name).alias("part"))
    return part(table, "kept").unionByName(part(backup, "backup"))


def mnt_update_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions of listed documents changed, others kept."""
    table, batch = _started(spark, sf_dir, "permit")
    permit(table, batch.where("doc_id % 5 = 0").select("file_path", F.lit("src0").alias("kb_group"), F.lit(None).cast("string").alias("visibility")))
    return table.read().select("file_path", "kb_group", "visibility")


QUERIES = {f.__name__: f for f in (mnt_add, mnt_update, mnt_remove, mnt_update_perm)}
ORACLE = {
    "mnt_add": """SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.file_hash, o.file_hash) AS file_hash, CASE WHEN n.file_hash <> o.file_hash OR o.file_path IS NULL THEN n.kb_group ELSE o.kb_group END AS kb_group,
        CASE WHEN n.file_hash <> o.file_hash OR o.file_path IS NULL THEN n.visibility ELSE o.visibility END AS visibility, CASE WHEN o.file_path IS NULL THEN 'insert' WHEN n.file_hash <> o.file_hash THEN 'update' ELSE 'same' END AS state
        FROM kb_docs o FULL OUTER JOIN kb_docs_new n ON o.file_path = n.file_path""",
    "mnt_update": """SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.file_hash, o.file_hash) AS file_hash, coalesce(o.kb_group, n.kb_group) AS kb_group, coalesce(o.visibility, n.visibility) AS visibility
        FROM kb_docs o FULL OUTER JOIN kb_docs_new n ON o.file_path = n.file_path""",
    "mnt_remove": "SELECT file_path, CASE WHEN file_path IN (SELECT file_path FROM kb_docs_new WHERE doc_id % 2 = 0) THEN 'backup' ELSE 'kept' END AS part FROM kb_docs",
    "mnt_update_perm": "SELECT file_path, CASE WHEN file_path IN (SELECT file_path FROM kb_docs_new WHERE doc_id % 5 = 0) THEN 'src0' ELSE kb_group END AS kb_group, visibility FROM kb_docs",
}
