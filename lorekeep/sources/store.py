"""Keyed tables on Parquet that are safe while they are written.

A table's rows lie in buckets by a hash of their key. A version is a manifest: one small JSON file
that names, for each bucket, the folders that hold its rows. Writers put new folders beside the old ones,
touch only the buckets whose keys they change, and then commit by one rename that fails if another writer
has taken the version number. So a reader sees a whole version or the one before it, a failed write
leaves nothing but folders that no manifest names, and rolling back or clearing copies no rows.

The driver holds one manifest: `buckets` names and folders, whatever the table's size. Equal keys
share a bucket; its rows are spread over `SPREAD` tasks, so a hot key is not one task's work.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tasks that write the rows of one bucket.
SPREAD = 4


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Manifests:
    """Numbered JSON documents in a folder; each number can be taken once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at())]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))

    def read(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/v={version:08d}.json", wholetext=True).first()
        return json.loads(text["value"])

    def commit(self, version: int, content: dict) -> None:
        """Take a number: the content is written aside in full and moved to its name at once."""
        fs, aside = self._fs(), self._at(f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        to = self._at(f"v={version:08d}.json")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf)
        try:
            files.rename(aside, to, self.spark._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(to):
                raise Conflict(f"{to} is there already") from e
            raise

    def drop(self, version: int) -> None:
        self._fs().delete(self._at(f"v={version:08d}.json"), False)


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    folders: dict[int, list[str]]

    def paths(self, buckets: set[int] | None = None) -> list[str]:
        return [p for b, ps in self.folders.items() if buckets is None or b in buckets for p in ps]


class VersionedTable:
    """A keyed table in versions. `key` names the column that upserts and deletes go by; without one,
    rows are dealt by all their columns and only whole versions can be written.

    Defined results: null keys share a bucket and are a key like any other; of an upsert's rows all
    with the same key replace all rows of that key; an empty version reads as no rows."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, buckets: int = 32) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.manifests = Manifests(spark, f"{self.path}/manifests")

    def versions(self) -> list[int]:
        return self.manifests.versions()

    def version(self, number: int | None = None) -> Version:
        found = number or max(self.versions())
        m = self.manifests.read(found)
        return Version(found, T.StructType.fromJson(m["schema"]), {int(b): ps for b, ps in m["folders"].items()})

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        v = self.version(version)
        return self._rows(v, buckets)

    def _rows(self, v: Version, buckets: set[int] | None = None) -> DataFrame:
        paths = v.paths(buckets)
        if not paths:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).parquet(*paths)

    def bucket_of(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _keys(self, df: DataFrame) -> list[str]:
        return [self.key] if self.key else df.columns

    def _put(self, df: DataFrame) -> dict[int, list[str]]:
        """Rows written to new folders, one for each bucket that has any."""
        base = f"{self.path}/data/{uuid.uuid4().hex}"
        spread = F.pmod(F.xxhash64(*df.columns, F.lit(1)), F.lit(SPREAD))
        rows = df.withColumn("__bucket", self.bucket_of(*self._keys(df)))
        rows.repartition(SPREAD * self.buckets, "__bucket", spread).write.partitionBy("__bucket").parquet(base)
        fs = self._jvm_path(base).getFileSystem(self.manifests._conf)
        names = [s.getPath().getName() for s in fs.listStatus(self._jvm_path(base))]
        return {int(n.split("=")[1]): [f"{base}/{n}"] for n in names if n.startswith("__bucket=")}

    def _jvm_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self, number: int, schema: T.StructType, folders: dict[int, list[str]], operation: str) -> int:
        self.manifests.commit(number, {"operation": operation, "schema": json.loads(schema.json()), "folders": {str(b): ps for b, ps in sorted(folders.items())}})
        return number

    def write(self, df: DataFrame) -> int:
        """A new version that holds these rows and no others."""
        number = max(self.versions(), default=0) + 1
        return self._commit(number, df.schema, self._put(df), "write")

    def change(self, rows: DataFrame | None = None, keys: DataFrame | None = None, base: int | None = None) -> int:
        """A new version: rows with the keys of `rows` or `keys` go, `rows` come in. Only buckets of
        those keys are read and written. base: the version that was read for this change; if it is
        no longer the newest, the change is refused (`Conflict`)."""
        if self.key is None:
            raise ValueError("changes need a key")
        now = self.version(base)
        gone = [d.select(self.key) for d in (rows, keys) if d is not None]
        gone = gone[0].distinct() if len(gone) == 1 else gone[0].unionByName(gone[1]).distinct()
        touched = {r[0] for r in gone.select(self.bucket_of(self.key).alias("b")).distinct().collect()}  # no more than `buckets`
        kept = self._rows(now, touched).alias("o").join(gone.alias("g"), F.col(f"o.{self.key}").eqNullSafe(F.col(f"g.{self.key}")), "left_anti")
        new = kept if rows is None else kept.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in now.schema.fields]))
        written = self._put(new.select(*now.schema.names)) if touched else {}
        folders = {b: ps for b, ps in now.folders.items() if b not in touched} | written
        return self._commit(now.number + 1, now.schema, folders, "change")

    def upsert(self, rows: DataFrame, base: int | None = None) -> int:
        return self.change(rows=rows, base=base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        return self.change(keys=keys, base=base)

    def rollback(self, version: int) -> int:
        """An earlier version's manifest becomes the newest; no rows are copied."""
        v = self.version(version)
        return self._commit(max(self.versions()) + 1, v.schema, v.folders, f"rollback to {version}")

    def clear(self) -> int:
        """An empty version; what was there stays as a version."""
        v = self.version()
        return self._commit(v.number + 1, v.schema, {}, "clear")

    def differing(self, old: int, new: int) -> set[int]:
        """Buckets whose folders are not the same in two versions; all others hold equal rows."""
        a, b = self.version(old), self.version(new)
        return {k for k in a.folders.keys() | b.folders.keys() if a.folders.get(k) != b.folders.get(k)}

    def expire(self, keep: int = 10) -> list[int]:
        """Remove all versions but the newest `keep`, and the folders that only they name."""
        every = self.versions()
        old, kept = every[:-keep], every[-keep:]
        used = {p for v in kept for p in self.version(v).paths()}
        fs = self._jvm_path(self.path).getFileSystem(self.manifests._conf)
        for v in old:
            for p in self.version(v).paths():
                if p not in used:
                    fs.delete(self._jvm_path(p), True)
            self.manifests.drop(v)
        return old
