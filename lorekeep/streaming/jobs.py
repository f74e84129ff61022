"""Structured Streaming forms of the keyed rules: live metrics, sessions, buckets, breakers, caches.

Each job is a function of a streaming DataFrame. The queries replay the given tables as a stream
with availableNow and return what the sink holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.functions.hooks import split
from lorekeep.plans.operator import view
from lorekeep.sources.files import AUDIT, append_json, scratch

#: Bucket capacity and refill a second, failures that open, cooldown seconds, cache seconds, entries kept.
CAPACITY, REFILL, FAILURES, COOLDOWN, TTL, KEEP, USES = 3.0, 1.0 / 3600, 5, 30, 600, 50, 3
#: A row this late closes every window before it.
LATE = "2100-01-01 00:00:00"


def replay(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A stream over rows that are written to the shared folder first."""
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def finish(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end of what is there and read the sink."""
    spark = stream.sparkSession
    out = scratch(spark, f"{name}-out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tool_metrics(calls: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Calls, successes and mean latency by tool and window; late rows beyond the delay drop out."""
    return calls.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "tool_name").agg(F.count("*").alias("calls"), F.count(F.when(F.col("success"), 1)).alias("successes"), F.avg("latency_ms").alias("latency")).select(F.col("w.start").alias("start"), "tool_name", "calls", "successes", "latency")


def trace_sessions(calls: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a trace's rows with no gap of half an hour."""
    return calls.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "trace_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("trace_id", F.col("w.start").alias("start"), "last", "n")


def _keyed(stream: DataFrame, key: str, step: Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]], out: str, state: str) -> DataFrame:
    """A state machine per key; rows of a batch come to it in order of time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        new, result = step(held.get if held.exists else None, rows)
        held.update(new)
        yield result

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def token_bucket(stream: DataFrame, key: str = "user_id", capacity: float = CAPACITY, refill: float = REFILL) -> DataFrame:
    """Each event takes a token if there is one; tokens come back with time."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        tokens, last = state or (capacity, None)
        out = []
        for e, t in zip(rows["event_id"], rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype.kind != "M" else rows["ts"].astype("datetime64[us]").astype("int64") / 1e6):
            tokens = capacity if last is None else min(capacity, tokens + max(0.0, t - last) * refill)
            ok = tokens >= 1
            tokens, last = tokens - ok, t
            out.append((e, bool(ok)))
        return (float(tokens), float(last)), pd.DataFrame(out, columns=["event_id", "allowed"])

    return _keyed(stream, key, step, "event_id bigint, allowed boolean", "tokens double, last double")


def circuit_breaker(stream: DataFrame, key: str = "dest", failures: int = FAILURES, cooldown: float = COOLDOWN) -> DataFrame:
    """CLOSED until failures in a row, OPEN for the cooldown, then one probe. Columns ts, ok."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        mode, run, since = state or ("CLOSED", 0, 0.0)
        out = []
        for e, t, ok in zip(rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["ok"]):
            if mode == "OPEN" and t - since < cooldown:
                out.append((e, "rejected", mode))
                continue
            if mode == "OPEN":
                mode = "HALF_OPEN"
            if ok:
                mode, run = "CLOSED", 0
            else:
                run += 1
                if mode == "HALF_OPEN" or run >= failures:
                    mode, since = "OPEN", t
            out.append((e, "called", mode))
        return (mode, int(run), float(since)), pd.DataFrame(out, columns=["event_id", "verdict", "mode"])

    return _keyed(stream, key, step, "event_id bigint, verdict string, mode string", "mode string, run int, since double")


def ttl_cache(stream: DataFrame, key: str = "k", ttl: float = TTL) -> DataFrame:
    """Hit if the key was filled less than ttl seconds ago, else a miss that fills it."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        filled = state[0] if state else None
        out = []
        for e, t in zip(rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64") / 1e6):
            hit = filled is not None and t - filled < ttl
            filled = filled if hit else t
            out.append((e, bool(hit)))
        return (float(filled),), pd.DataFrame(out, columns=["event_id", "hit"])

    return _keyed(stream, key, step, "event_id bigint, hit boolean", "filled double")


def fifo_state(stream: DataFrame, key: str = "user_id", keep: int = KEEP) -> DataFrame:
    """Number of entries held after each row, at most `keep`, and the one that left (-1: none)."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        held = list(state[0]) if state else []
        out = []
        for e in rows["event_id"]:
            held.append(int(e))
            out.append((e, min(len(held), keep), held.pop(0) if len(held) > keep else -1))
        return (held,), pd.DataFrame(out, columns=["event_id", "held", "gone"])

    return _keyed(stream, key, step, "event_id bigint, held bigint, gone bigint", "held array<bigint>")


def tool_preference(stream: DataFrame, key: str = "k", uses: int = USES) -> DataFrame:
    """The event at which a key's count of successes comes to `uses`, once."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        n = state[0] if state else 0
        out = []
        for e, k, ok in zip(rows["event_id"], rows["k"], rows["ok"]):
            n += bool(ok)
            if ok and n == uses:
                out.append((e, k))
        return (int(n),), pd.DataFrame(out, columns=["event_id", "k"])

    return _keyed(stream, key, step, "event_id bigint, k string", "n bigint")


def token_totals(stream: DataFrame) -> DataFrame:
    """Running totals by session and model."""
    return stream.groupBy("session_id", "model").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count("*").alias("calls"))


#: What ingest keeps: the chunks of a file, and one row without a chunk that names the file and its hash.
CHUNKS = "path string, file_hash string, start_index int, chunk string, batch bigint"


def ingested(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """Each path's rows of its newest batch (of those before `before`)."""
    rows = spark.read.schema(CHUNKS).parquet(base)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.where("chunk IS NULL").groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"], "left_semi").select("path", "file_hash", "start_index", "chunk")


def ingest(files: DataFrame, base: str, state: str, least: int = 10) -> None:
    """Files (path, text) become chunks under `base`, a folder per batch.

    A file whose text is known is skipped; a changed one takes the place of its earlier chunks. Only
    new rows are written, and a batch that runs again overwrites its own folder alone. Of several
    texts of a path in one batch the greatest counts; a null text is empty; rows without a path go."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], CHUNKS).drop("batch").write.mode("ignore").parquet(f"{base}/batch=-1")
        found = batch.where("path IS NOT NULL").groupBy("path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).withColumn("file_hash", F.md5("text"))
        known = ingested(spark, base, number).where("chunk IS NULL").select("path", "file_hash")
        new = found.join(known, ["path", "file_hash"], "left_anti")
        named = new.select("path", "file_hash", F.lit(None).cast("int").alias("start_index"), F.lit(None).cast("string").alias("chunk"))
        chunks = split(new).where(F.length("chunk") >= least)
        named.unionByName(chunks).write.mode("overwrite").parquet(f"{base}/batch={number}")

    files.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows and one late row that closes the windows."""
    rows = view(spark, sf_dir, "tool_audit").select("ts", "trace_id", "tool_name", "latency_ms", "success")
    return rows.unionByName(spark.sql(f"SELECT timestamp '{LATE}' AS ts, 'end' AS trace_id, 'end' AS tool_name, CAST(NULL AS DOUBLE) AS latency_ms, true AS success"))


def str_audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "audit")
    rows = view(spark, sf_dir, "tool_audit").where("tool_name IS NOT NULL")
    append_json(rows.select("event_id", F.col("ts").cast("string").alias("ts"), "tool_name", "latency_ms", "success"), path)
    return finish(spark.readStream.schema(AUDIT).json(path).select("event_id", "tool_name", "success"), "audit")


def str_tool_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = finish(tool_metrics(replay(spark, _calls(spark, sf_dir).where("tool_name IS NOT NULL"), "calls")), "metrics").where("tool_name <> 'end'")
    return done.select(F.col("start").cast("date").cast("string").alias("day"), "tool_name", "calls", "successes", F.round("latency", 6).alias("latency"))


def str_trace_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = finish(trace_sessions(replay(spark, _calls(spark, sf_dir).where("trace_id IS NOT NULL"), "traces")), "sessions").where("trace_id <> 'end'")
    return done.select("trace_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n")


def str_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(token_bucket(replay(spark, _events(spark, sf_dir).select("user_id", "event_id", "ts"), "bucket")), "bucket")


def str_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 50).alias("dest"), "event_id", "ts", (~F.col("event_type").isin("error", "click")).alias("ok"))
    return finish(circuit_breaker(replay(spark, rows, "breaker"), cooldown=6 * 3600), "breaker")


def str_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("k"), "event_id", "ts")
    return finish(ttl_cache(replay(spark, rows, "cache"), ttl=24 * 3600), "cache")


def str_fifo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(fifo_state(replay(spark, _events(spark, sf_dir).select("user_id", "event_id", "ts"), "fifo")), "fifo")


def str_tool_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("k"), "event_id", "ts", (F.col("event_id") % 5 != 0).alias("ok"))
    return finish(tool_preference(replay(spark, rows, "pref")), "pref")


def str_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: each batch appends the totals that changed; the last of a key counts."""
    out = scratch(spark, "totals-out")
    stream = token_totals(replay(spark, view(spark, sf_dir, "token_log").select("session_id", "model", "prompt_tokens", "completion_tokens"), "totals"))
    stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", scratch(spark, "totals-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("session_id", "model").agg(F.max_by("tokens", "batch").alias("tokens"), F.max_by("calls", "batch").alias("calls"))


def str_kb_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "ingest")
    files = replay(spark, view(spark, sf_dir, "kb_docs").select(F.col("file_path").alias("path"), "text"), "files")
    ingest(files, base, scratch(spark, "ingest-state"))
    return ingested(spark, base).groupBy("path").agg(F.count("chunk").alias("chunks"))


QUERIES = {f.__name__: f for f in (str_audit_source, str_tool_metrics, str_trace_session, str_token_bucket, str_circuit_breaker, str_ttl_cache, str_fifo_state, str_tool_pref, str_token_totals, str_kb_ingest)}
ORACLE: dict[str, str] = {
    "str_audit_source": "SELECT event_id, event_type AS tool_name, event_type <> 'error' AS success FROM events WHERE event_id % 9 <> 0",
    "str_tool_metrics": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS tool_name, count(*) AS calls, count(CASE WHEN event_type <> 'error' THEN 1 END) AS successes, round(avg(CASE WHEN event_id % 31 <> 0 THEN value END), 6) AS latency FROM events WHERE event_id % 9 <> 0 GROUP BY ALL",
    "str_trace_session": """WITH t AS (SELECT CAST(ts AS TIMESTAMP) AS ts, concat('t', CAST(user_id AS VARCHAR), '-', CAST(event_id % 7 AS VARCHAR)) AS trace_id FROM events WHERE event_id % 50 <> 0),
  s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY trace_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM t), g AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT trace_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n FROM g GROUP BY trace_id, run""",
    "str_fifo_state": "SELECT event_id, least(row_number() OVER w, 50) AS held, coalesce(lag(event_id, 50) OVER w, -1) AS gone FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "str_tool_pref": "SELECT event_id, k FROM (SELECT event_id, concat(CAST(user_id AS VARCHAR), '/', event_type) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_id % 5 <> 0) WHERE n = 3",
    "str_token_totals": "SELECT concat('s', CAST(user_id % 20 AS VARCHAR)) AS session_id, CASE event_id % 4 WHEN 0 THEN 'deepseek-chat' WHEN 1 THEN 'deepseek-v4-flash' WHEN 2 THEN 'deepseek-reasoner' ELSE 'unlisted' END AS model, CAST(sum(CAST(floor(value * 10) AS BIGINT) + CAST(floor(value * 3) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY 1, 2",
}
