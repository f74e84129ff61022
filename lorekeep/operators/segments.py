"""An index of segments: refreshing writes what changed, merging keeps segments few.

A segment is written once and never changed: postings sorted by term, terms, document vectors and
document lengths of some documents. A refresh writes one new segment of the changed documents' texts, and
tombstones: which documents of which older segment count no more, and how many postings of each
term went with them. What a search reads is the union of the segments without their dead documents,
with document frequencies summed over segments less those of the dead, so scores equal those of an
index built anew. Segments of like size (`FACTOR` of one tier) are merged into one; their dead
documents go then. The list of segments is a manifest that is committed by one rename
(`lorekeep.sources.store`), so readers see the index before or after a refresh.

Finding out which terms the dead documents had reads the postings of their segments (three columns);
nothing of them is written again.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.search import Config, Index, _by_term, _postings, small, vectors
from lorekeep.sources.store import Manifests

#: Segments of one tier that are merged; a tier holds segments of up to FACTOR times as many documents.
FACTOR = 4
POSTINGS, TERMS, VECTORS, DOCS = "term string, doc_id bigint, dl int, tf bigint", "term string, df double", "doc_id bigint, v array<double>", "doc_id bigint, dl bigint"
DEAD, GONE = "doc_id bigint, dl bigint", "term string, df double"


@dataclass(frozen=True)
class Segment:
    path: str
    documents: int
    words: int  # documents without words count as one word
    dead: tuple[str, ...] = field(default=())  # folders of tombstones
    dead_documents: int = 0
    dead_words: int = 0

    @property
    def tier(self) -> int:
        return int(math.log(max(1, self.documents - self.dead_documents), FACTOR))


class SegmentedIndex:
    """The index in the folder `path`; `state` is the list of its segments in its newest version."""

    def __init__(self, spark: SparkSession, path: str, cfg: Config = Config()) -> None:
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg
        self.manifests = Manifests(spark, f"{self.path}/manifests")

    def _state(self) -> tuple[int, list[Segment]]:
        number = max(self.manifests.versions(), default=0)
        return number, [Segment(**{**s, "dead": tuple(s["dead"])}) for s in self.manifests.read(number)["segments"]] if number else []

    @property
    def state(self) -> list[Segment]:
        return self._state()[1]

    def _commit(self, number: int, segments: list[Segment]) -> None:
        self.manifests.commit(number, {"segments": [vars(s) for s in segments]})

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _part(self, s: Segment, name: str, schema: str) -> DataFrame:
        """A part of a segment without its dead documents."""
        rows = self._read([f"{s.path}/{name}"], schema)
        if not s.dead:
            return rows
        dead = self._read([f"{d}/docs" for d in s.dead], DEAD).select("doc_id")
        return rows.join(small(dead, s.dead_documents), "doc_id", "left_anti").select(*rows.columns)

    def _all(self, segments: list[Segment], name: str, schema: str) -> DataFrame:
        parts = [self._part(s, name, schema) for s in segments] or [self.spark.createDataFrame([], schema)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _terms(self, segments: list[Segment]) -> DataFrame:
        have = self._read([f"{s.path}/terms" for s in segments], TERMS)
        gone = self._read([f"{d}/terms" for s in segments for d in s.dead], GONE).select("term", (-F.col("df")).alias("df"))
        return have.unionByName(gone).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _write(self, docs: DataFrame) -> Segment:
        """A segment of the documents (doc_id, text)."""
        base = f"{self.path}/{uuid.uuid4().hex}"
        _by_term(_postings(docs, self.cfg)).write.parquet(f"{base}/postings")
        vectors(docs, "doc_id", "text", self.cfg).write.parquet(f"{base}/vectors")
        lengths = self._read([f"{base}/postings"], POSTINGS).groupBy("doc_id").agg(F.max("dl").cast("bigint").alias("dl"))
        docs.select("doc_id").join(lengths, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(1)).cast("bigint").alias("dl")).write.parquet(f"{base}/docs")
        return self._closed(base)

    def _closed(self, base: str) -> Segment:
        self._read([f"{base}/postings"], POSTINGS).groupBy("term").agg(F.count("*").cast("double").alias("df")).write.parquet(f"{base}/terms")
        n = self._read([f"{base}/docs"], DOCS).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        return Segment(base, n["n"], n["words"])

    def _buried(self, s: Segment, changed: DataFrame, count: int) -> Segment:
        """The segment with tombstones for those of `changed` (doc_id) that it holds."""
        ids = self._part(s, "docs", DOCS).join(small(changed, count), "doc_id", "left_semi")
        base = f"{self.path}/{uuid.uuid4().hex}"
        ids.write.parquet(f"{base}/docs")
        dead = self._read([f"{base}/docs"], DEAD)
        n = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        if not n["n"]:
            return s
        lost = self._read([f"{s.path}/postings"], POSTINGS).select("term", "doc_id").join(small(dead.select("doc_id"), n["n"]), "doc_id", "left_semi")
        lost.groupBy("term").agg(F.count("*").cast("double").alias("df")).write.parquet(f"{base}/terms")
        return Segment(s.path, s.documents, s.words, (*s.dead, base), s.dead_documents + n["n"], s.dead_words + n["words"])

    def build(self, docs: DataFrame) -> SegmentedIndex:
        """One segment of all documents, whatever there was."""
        number, _ = self._state()
        self._commit(number + 1, [self._write(docs)])
        return self

    def refresh(self, docs: DataFrame, changed: DataFrame, merge: bool = True) -> SegmentedIndex:
        """After `changed` (doc_id) documents were added, changed or removed; `docs` are all documents
        as they are now. Reads the texts of changed documents only, and writes no others."""
        number, segments = self._state()
        base = f"{self.path}/{uuid.uuid4().hex}"
        changed.select("doc_id").distinct().write.parquet(base)
        ids = self.spark.read.schema("doc_id bigint").parquet(base)
        count = ids.count()
        old = [self._buried(s, ids, count) for s in segments]
        new = self._write(docs.select("doc_id", "text").join(small(ids, count), "doc_id", "left_semi"))
        segments = [s for s in [*old, new] if s.documents > s.dead_documents]
        if merge:
            segments = self._merged(segments)
        self._commit(number + 1, segments)
        return self

    def _merged(self, segments: list[Segment]) -> list[Segment]:
        """Segments with no tier of FACTOR or more; one merge can fill the tier above."""
        while True:
            tiers: dict[int, list[Segment]] = {}
            for s in segments:
                tiers.setdefault(s.tier, []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= FACTOR), None)
            if full is None:
                return segments
            segments = [s for s in segments if s not in full] + [self._join(full)]

    def _join(self, segments: list[Segment]) -> Segment:
        base = f"{self.path}/{uuid.uuid4().hex}"
        _by_term(self._all(segments, "postings", POSTINGS)).write.parquet(f"{base}/postings")
        self._all(segments, "vectors", VECTORS).write.parquet(f"{base}/vectors")
        self._all(segments, "docs", DOCS).write.parquet(f"{base}/docs")
        return self._closed(base)

    def merge(self) -> SegmentedIndex:
        """All segments into one."""
        number, segments = self._state()
        if len(segments) > 1 or any(s.dead for s in segments):
            self._commit(number + 1, [self._join(segments)])
        return self

    def live(self) -> Index:
        """What `Search` and `retrieve` read."""
        segments = self.state
        n = sum(s.documents - s.dead_documents for s in segments)
        words = sum(s.words - s.dead_words for s in segments)
        return Index(self._all(segments, "postings", POSTINGS), self._terms(segments), self._all(segments, "vectors", VECTORS), n, words / max(1, n))


def mnt_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after what the corpus signatures tell has changed: terms and their documents."""
    from lorekeep.operators.signature import changed_documents, sign
    from lorekeep.plans.operator import view
    from lorekeep.sources.files import scratch

    old, new = view(spark, sf_dir, "kb_docs"), view(spark, sf_dir, "kb_docs_later")
    index = SegmentedIndex(spark, scratch(spark, "segments")).build(old.select("doc_id", "text"))
    index.refresh(new, changed_documents(sign(old), sign(new)))
    return index.live().terms.select("term", F.col("df").cast("bigint").alias("df"))


QUERIES = {"mnt_index_refresh": mnt_index_refresh}
REFRESHED = r"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0))) AS term FROM kb_docs_later) x GROUP BY term"
