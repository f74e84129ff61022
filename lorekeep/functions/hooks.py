"""Pluggable embedder, pair scorer and text generator, and the recursive splitter.

Hooks are Python callables that get whole lists of one Arrow batch; models load once per task. The
defaults need no model and are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lorekeep.plans.operator import view

#: Chunk size, overlap, separators from the coarsest, score of a failed pair.
SIZE, OVERLAP = 500, 50
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""]
FAILED = -999.0
DIM = 64


def hashing_embedder(dim: int = DIM) -> Callable[[list[str]], list[list[float]]]:
    """Signed hashing of words, unit length."""
    from zlib import crc32

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embed(df: DataFrame, text: str, out: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]] = hashing_embedder) -> DataFrame:
    """`df` and a column of vectors; `factory` runs once per task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield pd.Series(model(s.fillna("").tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, pandas_udf(run, "array<float>")(text))


def overlap_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """Share of the query's words that the text has."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            words = set(q.lower().split())
            out.append(len(words & set(t.lower().split())) / len(words) if words else 0.0)
        return out

    return score


def pair_score(df: DataFrame, query: str, text: str, out: str, factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]] = overlap_scorer) -> DataFrame:
    """`df` and a score per pair: by batch, one by one where a batch fails, FAILED for a pair that fails alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = factory()
        for b in batches:
            pairs = list(zip(b.iloc[:, 0].fillna("").tolist(), b.iloc[:, 1].fillna("").tolist()))
            try:
                yield pd.Series(model(pairs), dtype="float64")
            except Exception:  # a hook may fail in any way; its rows are marked, not lost
                alone = []
                for p in pairs:
                    try:
                        alone.append(model([p])[0])
                    except Exception:
                        alone.append(FAILED)
                yield pd.Series(alone, dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn(out, pandas_udf(run, "double")(F.struct(query, text)))


def generate(df: DataFrame, prompt: str, out: str, factory: Callable[[], Callable[[list[str]], list[str]]] | None = None) -> DataFrame:
    """`df` and a generated text; the prompt itself where the generator gives nothing."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory() if factory else list
        for s in batches:
            yield pd.Series(model(s.fillna("").tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    made = pandas_udf(run, "string")(prompt)
    return df.withColumn(out, F.coalesce(F.nullif(F.trim(made), F.lit("")), F.col(prompt)))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[tuple[int, str]]:
    """(start, chunk) of chunks of at most `size` characters, without white space around them.

    A stretch is cut before each place of the first separator that it holds. Runs of pieces shorter
    than `size` fill chunks; where a chunk is full, the next one starts with the last of its pieces
    that make no more than `overlap`. A longer piece ends the run and is cut by the separators that
    follow. The empty separator cuts anywhere."""
    out: list[tuple[int, str]] = []

    def emit(a: int, b: int) -> None:
        chunk = text[a:b].strip()
        if chunk:
            out.append((text.index(chunk, a), chunk))

    def fill(run: list[int]) -> None:  # where the pieces of a run begin, and its end
        first = 0
        for k in range(len(run) - 1):
            if run[k + 1] - run[first] > size:
                emit(run[first], run[k])
                while first < k and (run[k] - run[first] > overlap or run[k + 1] - run[first] > size):
                    first += 1
        if len(run) > 1:
            emit(run[first], run[-1])

    def cut(a: int, b: int, seps: list[str]) -> None:
        at = next((i for i, s in enumerate(seps) if not s or text.find(s, a, b) >= 0), None)
        if at is None:
            emit(a, b)
        elif not seps[at]:
            while b - a > size:
                emit(a, a + size)
                a += size - overlap
            emit(a, b)
        else:
            sep, run, begin = seps[at], [a], a
            while begin < b:
                end = text.find(sep, begin + len(sep) if text.startswith(sep, begin) else begin, b)
                end = b if end < 0 else end
                if end - begin < size:
                    run.append(end)
                else:
                    fill(run)
                    cut(begin, end, seps[at + 1 :])
                    run = [end]
                begin = end
            fill(run)

    cut(0, len(text), separators)
    return out


def split(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """`df` without the text and with start_index and chunk, one row per chunk."""

    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: [{"start_index": a, "chunk": c} for a, c in split_text(t, size, overlap)])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    parts = pandas_udf(run, "array<struct<start_index:int,chunk:string>>")(text)
    return df.select(*[c for c in df.columns if c != text], F.explode(parts).alias("p")).select("*", "p.start_index", "p.chunk").drop("p")


def udf_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = embed(view(spark, sf_dir, "documents").select("doc_id", "text"), "text", "v")
    return d.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 3).alias("norm"))


def udf_pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against a whole question."""
    d = view(spark, sf_dir, "query_texts").select("doc_id", "text", "query")
    return pair_score(d, "query", "text", "score").select("doc_id", F.round("score", 6).alias("score"))


def _silent_on_long(limit: int = 200) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A generator that gives nothing for long prompts, and prompts without spare white space else."""
    return lambda: lambda prompts: ["" if len(p) > limit else " ".join(p.split()) for p in prompts]


def udf_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions rewritten, or left as they are where the generator gives nothing."""
    return generate(view(spark, sf_dir, "questions").select("qid", "query"), "query", "rewritten", _silent_on_long()).select("qid", "rewritten")


def chk_recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(view(spark, sf_dir, "documents").select("doc_id", "text"))


def udtf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splitter as a table function, joined laterally; nothing is left in the session."""
    from pyspark.sql.functions import udtf

    class Split:
        def eval(self, text: str):
            for a, c in split_text(text or ""):
                yield a, len(c)

    pieces = udtf(Split, returnType="start_index int, n int")
    d = view(spark, sf_dir, "documents").select("doc_id", "text")
    return d.lateralJoin(pieces(F.col("text").outer())).select("doc_id", "start_index", "n")


QUERIES = {f.__name__: f for f in (udf_embed, udf_pair_score, udf_generate, chk_recursive_split, udtf_split)}
ORACLE: dict[str, str] = {
    "udf_generate": "SELECT item_id AS qid, CASE WHEN length(text) > 200 THEN text ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS rewritten FROM benchmark",
    "udf_pair_score": """SELECT d.doc_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE CAST(len(list_intersect(q, t)) AS DOUBLE) / len(q) END, 6) AS score FROM (
        SELECT d.doc_id, list_filter(list_distinct(string_split_regex(lower(coalesce(b.text, '')), '\\s+')), lambda w: w <> '') AS q, string_split_regex(lower(coalesce(d.text, '')), '\\s+') AS t FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id) d""",
}
