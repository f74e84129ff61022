"""File sources and sinks: directories of text, JSON lines and arrays, versioned Parquet tables.

Queries here derive their files from the given tables, through Spark, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.plans.operator import view
from lorekeep.sources.store import VersionedTable

#: Bytes of a file of texts, about: one that is read whole is a row of a task.
FILE = 4 << 20
AUDIT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType()), T.StructField("tool_name", T.StringType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("success", T.BooleanType())])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names. A
    local one is made only where none is named and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lorekeep-{name}-{uuid.uuid4().hex}"


def scan_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md"), recursive: bool = True) -> DataFrame:
    """path, length and content of each file with one of the extensions."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its text and path."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON lines file; lines that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """How many lines can't be read."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).select(row["_corrupt"].isNotNull().alias("bad")).groupBy("bad").count()


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def check_model(catalog: DataFrame, model: str, dim: int) -> None:
    """Appending vectors of another model or length is an error."""
    other = catalog.where((F.col("embedding_model") != model) | (F.col("embedding_dim") != dim)).limit(1).collect()
    if other:
        raise ValueError(f"the base holds vectors of {other[0]['embedding_model']} ({other[0]['embedding_dim']}), not of {model} ({dim})")


def _audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tool_audit").where("tool_name IS NOT NULL").select("event_id", F.col("ts").cast("string").alias("ts"), "tool_name", "latency_ms", "success")


def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows written as JSON lines with bad lines among them, then read by schema."""
    path = scratch(spark, "jsonl")
    rows = _audit_rows(spark, sf_dir)
    rows.select(F.when(F.col("event_id") % 100 == 1, F.lit("{broken")).otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    return json_lines(spark, path, AUDIT).select("event_id", "tool_name", "success")


def snk_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one log, read back."""
    path = scratch(spark, "sink")
    rows = _audit_rows(spark, sf_dir)
    append_json(rows.where("event_id % 2 = 0"), path)
    append_json(rows.where("event_id % 2 = 1"), path)
    return json_lines(spark, path, AUDIT).groupBy("tool_name").agg(F.count("*").alias("n"))


def src_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON arrays over many lines, about 500 in a file, read by the multi-line source: one row
    for each turn."""
    path = scratch(spark, "array")
    turns = view(spark, sf_dir, "conversations")
    files = max(1, turns.count() // 500)  # an array is one row of a task: their number grows with the table
    rows = turns.select(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(files)).alias("part"), F.to_json(F.struct("turn", "role", "text")).alias("j"))
    spread = rows.groupBy("part").agg(F.array_join(F.collect_list("j"), ",\n").alias("j"))
    spread.select(F.concat(F.lit("[\n"), "j", F.lit("\n]")).alias("value"), "part").write.partitionBy("part").text(path)
    item = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    rows = json_array(spark, path, item)
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """Documents as lines of files of about `FILE` bytes in a folder for each source, whatever a source has."""
    path = scratch(spark, "files")
    docs = view(spark, sf_dir, "documents")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    docs.groupBy("source").agg(size.alias("size"), F.ceil(size / FILE).alias("files")).write.parquet(f"{path}-sizes")
    sizes = spark.read.parquet(f"{path}-sizes").alias("s")
    tasks = max(8, (sizes.agg(F.sum("size")).first()[0] or 0) // FILE)  # one number
    spread = docs.alias("d").join(sizes, F.col("d.source").eqNullSafe(F.col("s.source")))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.col("files")).alias("part")
    lines = spread.select("d.source", F.regexp_replace("text", "\n", " ").alias("value"), part)
    lines.repartition(tasks, "source", "part").write.partitionBy("source", "part").text(path)
    return path


def _folder(path: str, escaped: int) -> Column:
    """The source whose folder a file is in; its name is escaped so many times in the path."""
    name = F.regexp_extract(path, "source=([^/]+)/", 1)
    for _ in range(escaped):
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.nullif(name, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("source")


def src_dir_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a directory tree, by folder: how many and whether they have content."""
    found = scan_directory(spark, _text_files(spark, sf_dir))
    return found.groupBy(_folder("path", 1)).agg((F.sum("length") > 0).alias("filled"))


def src_wholetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as texts, characters by folder."""
    texts = whole_text(spark, _text_files(spark, sf_dir))
    return texts.groupBy(_folder("path", 2)).agg(F.sum(F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("chars"))


def _base(spark: SparkSession, sf_dir: str, name: str, key: str = "chunk_id") -> tuple[VersionedTable, DataFrame]:
    chunks = view(spark, sf_dir, "chunk_vectors").select("chunk_id", "file_path", "kb_group", "visibility")
    return VersionedTable(spark, scratch(spark, name), key), chunks


def kb_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks written as a new version and read from it."""
    t, chunks = _base(spark, sf_dir, "rebuild")
    t.write(chunks)
    return t.read()


def kb_meta_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written, changed in two versions (counts put right, files taken out), and read."""
    t, chunks = _base(spark, sf_dir, "meta", "file_path")
    counts = chunks.groupBy("file_path").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first"))
    t.write(counts.withColumn("chunks", F.col("chunks") * F.when(F.col("first") % 4 == 0, 7).otherwise(1)))
    t.upsert(counts.where("first % 4 = 0"))
    t.delete(counts.where("first % 10 = 3"))
    return t.read().select("file_path", "chunks")


def mnt_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with their rows; three are written and two kept."""
    t, chunks = _base(spark, sf_dir, "snapshot")
    for k in (2, 3, 5):
        t.write(chunks.where(F.col("chunk_id") % k == 0))
    t.expire(2)
    return t.read(2).select(F.lit(2).alias("version"), "chunk_id").unionByName(t.read(3).select(F.lit(3).alias("version"), "chunk_id")).groupBy("version").agg(F.count("*").alias("chunks"))


def mnt_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version is the newest again after a bad one."""
    t, chunks = _base(spark, sf_dir, "rollback")
    t.write(chunks)
    t.delete(chunks.where("chunk_id % 10 <> 0"))
    t.rollback(1)
    return t.read().select("chunk_id", "file_path")


def mnt_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty base whose earlier version is still there: the earlier version's rows."""
    t, chunks = _base(spark, sf_dir, "clear")
    t.write(chunks)
    t.clear()
    return t.read(1).select("chunk_id").join(t.read().select("chunk_id"), "chunk_id", "left_anti")


def refused(catalog: DataFrame, batches: DataFrame) -> DataFrame:
    """Which batches (batch, embedding_model, embedding_dim) a base with this catalog takes in."""
    held = catalog.select(F.col("embedding_model").alias("m"), F.col("embedding_dim").alias("d")).distinct()
    same = (F.col("embedding_model") == F.col("m")) & (F.col("embedding_dim") == F.col("d"))
    known = batches.join(held, F.lit(True), "left").groupBy("batch", "embedding_model", "embedding_dim")  # a base holds vectors of one model
    return known.agg(F.coalesce(F.every(F.coalesce(same, F.col("m").isNull())), F.lit(True)).alias("taken"))


def mnt_model_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of vectors, one for each label and model, against what the base holds."""
    vectors = view(spark, sf_dir, "embeddings")
    catalog = vectors.select(F.lit("hashing").alias("embedding_model"), F.size("embedding").alias("embedding_dim"))
    batch = vectors.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    given = batch.select(F.col("label").alias("batch"), F.when(F.col("label") % 3 == 0, "other").otherwise("hashing").alias("embedding_model"), F.when(F.col("label") % 4 == 1, F.col("dim") * 2).otherwise(F.col("dim")).alias("embedding_dim"))
    return refused(catalog, given)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (src_jsonl, snk_jsonl, src_json_array, src_dir_scan, src_wholetext, kb_rebuild, kb_meta_io, mnt_snapshot, mnt_rollback, mnt_clear, mnt_model_check)}

_CHUNKS = "SELECT d.doc_id AS chunk_id, concat('kb/', d.source, '/', CAST(d.doc_id AS VARCHAR), '.txt') AS file_path, d.source AS kb_group, CASE WHEN d.doc_id % 5 = 0 THEN 'public' ELSE 'internal' END AS visibility FROM documents d"
ORACLE: dict[str, str] = {
    "src_jsonl": "SELECT event_id, event_type AS tool_name, event_type <> 'error' AS success FROM events WHERE event_id % 9 <> 0 AND event_id % 100 <> 1",
    "snk_jsonl": "SELECT event_type AS tool_name, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY event_type",
    "src_json_array": "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role",
    "src_dir_scan": "SELECT source, sum(length(text)) > 0 AS filled FROM documents GROUP BY source",
    "src_wholetext": "SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source",
    "kb_rebuild": _CHUNKS,
    "kb_meta_io": f"SELECT file_path, count(*) AS chunks FROM ({_CHUNKS}) WHERE chunk_id % 10 <> 3 GROUP BY file_path",
    "mnt_snapshot": f"SELECT CAST(v AS INT) AS version, count(*) AS chunks FROM (SELECT CASE k WHEN 3 THEN 2 ELSE 3 END AS v FROM ({_CHUNKS}), (SELECT unnest([3, 5]) AS k) WHERE chunk_id % k = 0) GROUP BY v",
    "mnt_rollback": f"SELECT chunk_id, file_path FROM ({_CHUNKS})",
    "mnt_clear": f"SELECT chunk_id FROM ({_CHUNKS})",
    "mnt_model_check": "SELECT DISTINCT label AS batch, CASE WHEN label % 3 = 0 THEN 'other' ELSE 'hashing' END AS embedding_model, CAST(len(embedding) * CASE WHEN label % 4 = 1 THEN 2 ELSE 1 END AS INT) AS embedding_dim, label % 3 <> 0 AND label % 4 <> 1 AS taken FROM embeddings",
}
