"""Search of a table of questions over a table of documents, with an index that is built once.

`build_index` writes postings (sorted by term), terms, document vectors and totals as Parquet;
`refresh_index` rebuilds only what changed documents touch. `Search` holds the ranked lists of a table
of questions as lazily planned DataFrames, and `retrieve` gives ranked contexts and prompts. Without a given
index nothing is built: one pass over the texts counts terms and writes of each document its vector and how often
the questions' words stand in it (`_Reader`); both channels are scored from that (`_Scorer`), and each task gives out
only the best of each question, so no text and no pair of question and document is dealt or written. Lists that are bounded by the questions are kept and broadcast.
Permissions are applied below both rankings, before any cut, so no list holds a hidden document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators.patterns import hits
from lorekeep.operators.ranks import checkpointed
from lorekeep.sources.files import scratch

#: A run of letters, digits and low lines; each CJK character is a word, and so is each pair of them.
WORDS = r"[\x{4E00}-\x{9FFF}]|[\p{L}\p{N}_&&[^\x{4E00}-\x{9FFF}]]+"
PAIRS = r"(?=([\x{4E00}-\x{9FFF}]{2}))"
CHINESE = r"[\x{4E00}-\x{9FFF}]"
#: What stands between the words of a text without CJK characters.
BETWEEN = r"[^\p{L}\p{N}_]+"
CELLS = 32
#: Questions whose vectors go to all tasks at once; more of them go in blocks of this size.
QUESTION_BLOCK = 4096
#: Places that the postings of one term are dealt to at most.
SPREAD = 16


@dataclass(frozen=True)
class Config:
    """Fixed values of the search: BM25, list sizes, rank fusion, rerank, token budget, switches."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    channel: int = 10
    rrf: int = 60
    candidates: int = 16
    reranked: int = 5
    budget: int = 2000
    sure: int = 2  # documents that are kept whatever the budget
    hybrid: bool = True
    rerank: bool = True
    permissions: bool = True
    stop_words: tuple[str, ...] = field(default=())


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of a text in order, lower case, then its CJK pairs, without stop words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    chinese = F.concat(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), F.regexp_extract_all(low, F.lit(PAIRS), F.lit(1)))
    # without CJK characters the words are what the text is cut into; cutting takes less time than finding each word and pair
    found = F.when(low.rlike(CHINESE), chinese).otherwise(F.array_remove(F.split(low, BETWEEN), ""))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf, dl), terms (term, df), vectors (doc_id, v) and the totals."""

    postings: DataFrame
    terms: DataFrame
    vectors: DataFrame
    documents: int
    length: float

    def idf(self, cfg: Config) -> DataFrame:
        """(term, df, idf); terms in more than half of the documents get a share of the mean."""
        n = F.lit(float(self.documents))
        raw = self.terms.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw").alias("mean"))  # one row
        return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, cfg.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _postings(docs: DataFrame, cfg: Config) -> DataFrame:
    """Texts are dealt by document, so its words are counted where they are; one more shuffle deals
    postings by term, those of a very common term to SPREAD places."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", tokens(F.col("text"), cfg.stop_words).alias("t"))
    d = d.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return d.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "dl", "tf")


def _by_term(postings: DataFrame) -> DataFrame:
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(parts, "term", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("term", "doc_id")


def vectors(rows: DataFrame, key: str, text: str, cfg: Config) -> DataFrame:
    """(key, v): a hashed bag of words in CELLS signed cells; stands for an embedding."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word = rows.select(key, text).repartition(parts, key).select(key, F.explode(tokens(F.col(text), cfg.stop_words)).alias("t"))
    cell = (F.ascii("t") * 7 + F.length("t") * 13 + F.ascii(F.substring("t", 2, 1))) % CELLS
    word = word.select(key, cell.alias("cell"), F.when(F.length("t") % 2 == 0, 1.0).otherwise(-1.0).alias("w"))
    sums = word.groupBy(key).agg(*[F.sum(F.when(F.col("cell") == i, F.col("w")).otherwise(0.0)).alias(f"c{i}") for i in range(CELLS)])
    return sums.select(key, F.array(*[f"c{i}" for i in range(CELLS)]).alias("v"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(docs: DataFrame, cfg: Config = Config(), with_vectors: bool = True) -> Index:
    """The index of documents (doc_id, text), written to the shared folder."""
    spark, base = docs.sparkSession, scratch(docs.sparkSession, "index")
    postings = _kept(_by_term(_postings(docs, cfg)), f"{base}/postings")
    empty = spark.createDataFrame([], "doc_id bigint, v array<double>")
    vecs = _kept(vectors(docs, "doc_id", "text", cfg), f"{base}/vectors") if with_vectors else empty
    return _totalled(docs, postings, vecs, base)


def _totalled(docs: DataFrame, postings: DataFrame, vecs: DataFrame, base: str) -> Index:
    n = docs.count()
    terms = _kept(postings.groupBy("term").agg(F.count("*").cast("double").alias("df")), f"{base}/terms")
    own = postings.select("doc_id", "dl").distinct()  # one row for each document that has words
    some = own.agg(F.sum("dl").alias("words"), F.count("*").alias("docs")).first()
    # a document without words counts as one of a single word
    return Index(postings, terms, vecs, n, ((some["words"] or 0) + n - some["docs"]) / max(1, n))


def refresh_index(index: Index, docs: DataFrame, changed: DataFrame, cfg: Config = Config()) -> Index:
    """The index after `changed` (doc_id) documents were added, changed or removed; `docs` are all
    documents as they are now. Only texts of changed documents are read into words."""
    base, ids = scratch(docs.sparkSession, "index"), changed.select("doc_id").distinct()
    fresh = docs.join(ids, "doc_id", "left_semi")
    old = lambda df: df.join(ids, "doc_id", "left_anti").select(*df.columns)
    postings = _by_term(old(index.postings).unionByName(_postings(fresh, cfg)))
    vecs = old(index.vectors).unionByName(vectors(fresh, "doc_id", "text", cfg))
    return _totalled(docs, _kept(postings, f"{base}/postings"), _kept(vecs, f"{base}/vectors"), base)


def term_statistics(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(term, df, idf) of all terms: a document's different words are found where its text is, so one
    shuffle of partial counts is all."""
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col("text"), cfg.stop_words))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").cast("double").alias("n")))  # one row
    raw = terms.crossJoin(n).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n")
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))  # one row
    idf = F.when(F.col("raw") < 0, cfg.epsilon * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(mean).select("term", "df", F.round(idf, 6).alias("idf"))


def small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """Broadcast only up to a number of rows; joined by shuffle beyond it."""
    return F.broadcast(df) if rows <= most else df


class Search:
    """Ranked lists of `questions` (qid, query, perm_mode, perm_group) over `documents` (doc_id, text)
    with catalog rows `kb_docs` (doc_id, kb_group, visibility)."""

    def __init__(self, documents: DataFrame, questions: DataFrame, kb_docs: DataFrame, cfg: Config = Config(), index: Index | None = None, catalogued: DataFrame | None = None) -> None:
        """catalogued: the very rows of `documents` with their catalog columns, if the caller has them in one table; the
        texts are then not joined with the catalog."""
        self.documents, self.questions, self.cfg, self.catalogued = documents, questions, cfg, catalogued
        self.meta = kb_docs.select("doc_id", "kb_group", "visibility")
        self.given = index
        self.spark: SparkSession = documents.sparkSession

    @cached_property
    def index(self) -> Index:
        return self.given or build_index(self.documents, self.cfg)

    @cached_property
    def words(self) -> Index:
        """An index that needs no vectors."""
        return self.__dict__.get("index") or self.given or build_index(self.documents, self.cfg, with_vectors=False)

    @cached_property
    def asked(self) -> int:
        return self.questions.count()

    @cached_property
    def qtf(self) -> DataFrame:
        return self.questions.select("qid", F.explode(tokens(F.col("query"), self.cfg.stop_words)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))

    @cached_property
    def scored(self) -> DataFrame:
        """Every question's documents that share a word with it, before permissions."""
        c, i = self.cfg, self.words
        wanted = self.qtf.join(i.idf(c), "term")
        hits = i.postings.join(small(wanted, 100 * self.asked), "term")
        part = F.col("qn") * F.col("idf") * F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("dl") / i.length))
        return hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))

    def _top(self, scored: DataFrame) -> DataFrame:
        best = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "doc_id")
        return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= self.cfg.channel).select("qid", "doc_id", "score", "rk")

    def _allowed(self, scored: DataFrame) -> DataFrame:
        if not self.cfg.permissions:
            return scored
        q = self.questions.select("qid", "perm_mode", "perm_group")
        d = scored.join(small(q, self.asked), "qid").join(self.meta, "doc_id")
        return d.where(visible_of("perm_mode", "perm_group", "visibility", "kb_group")).select("qid", "doc_id", "score")

    def _few(self, ranked: DataFrame, most: int) -> DataFrame:
        """A list of at most `most` rows a question: computed once, broadcast while it is small."""
        return small(checkpointed(ranked), most * self.asked)

    @cached_property
    def read(self) -> list[tuple[int, list[str], DataFrame]]:
        """For each block of questions that has words: its number, its words in order and what a pass over the texts
        found (`_Reader`), written once. The first also has the counts of all words. The catalog is joined afterwards,
        to rows without texts."""
        t, none, path = tokens(F.col("text"), self.cfg.stop_words), F.lit(None).cast("string"), scratch(self.spark, "read")
        source, own = (self.documents, (none.alias("visibility"), none.alias("kb_group"))) if self.catalogued is None else (self.catalogued, ("visibility", "kb_group"))
        d, out = source.select("doc_id", t.alias("t"), *own), []
        for i in range(self.blocks):
            some = self.qtf.where(self._block(i)).select("term").distinct().collect()  # the words of about QUESTION_BLOCK questions
            if some:
                terms = sorted(r["term"] for r in some)
                out.append((i, terms, _kept(d.mapInArrow(_Reader(terms, counts=not out), READ), f"{path}/{i}")))
        return out

    @property
    def blocks(self) -> int:
        return -(-self.asked // QUESTION_BLOCK) or 1

    def _block(self, i: int) -> Column:
        return F.pmod(F.xxhash64("qid"), F.lit(self.blocks)) == i

    @cached_property
    def counted(self) -> DataFrame:
        """(term, df, words): one row for each word, and one without a word that has the number of documents and of
        their words; a document without words counts as one of a single word."""
        counts = self.read[0][2].where("df IS NOT NULL")
        return checkpointed(counts.groupBy("term").agg(F.sum("df").cast("double").alias("df"), F.sum("words").alias("words")))

    @cached_property
    def best(self) -> list[DataFrame]:
        """The best documents of each question in each channel (`_Scorer`), for each block of questions."""
        cfg, spark, found = self.cfg, self.spark, None
        if self.read:
            row = self.counted.where("term IS NULL").first()
            n, length = (int(row["df"]), row["words"] / row["df"]) if row else (0, 1.0)
            none = spark.createDataFrame([], "doc_id bigint, v array<double>")
            index = Index(none, self.counted.where("term IS NOT NULL"), none, n, length)
            weights = self.qtf.join(index.idf(cfg), "term").groupBy("qid").agg(F.collect_list(F.struct("term", (F.col("qn") * F.col("idf")).alias("w"))).alias("ws"))
            asked = self.questions.select("qid", "perm_mode", "perm_group").join(vectors(self.questions, "qid", "query", cfg), "qid", "left").join(weights, "qid", "left")
            asked = checkpointed(asked)
        for i, terms, kept in self.read:
            rows = asked.where(self._block(i)).collect()  # about QUESTION_BLOCK rows of CELLS doubles and a question's words
            d = kept.where("df IS NULL").drop("term", "df", "words")
            if self.catalogued is None and cfg.permissions:
                d = d.drop("visibility", "kb_group").join(self.meta.withColumn("listed", F.lit(True)), "doc_id", "left")
            else:
                d = d.withColumn("listed", F.lit(True))
            one = d.select("doc_id", "dl", "v", "at", "tf", "visibility", "kb_group", "listed").mapInArrow(_Scorer(rows, terms, cfg, length), "channel int, qid bigint, doc_id bigint, score double")
            found = one if found is None else found.unionByName(one)
        found = spark.createDataFrame([], "channel int, qid bigint, doc_id bigint, score double") if found is None else checkpointed(found)
        return [found.where(F.col("channel") == i).drop("channel") for i in range(3)]

    @cached_property
    def kw(self) -> DataFrame:
        if not self.given:
            return self._few(self._top(self.best[1]), self.cfg.channel)
        return self._few(self._top(self._allowed(self.scored.where("score > 0"))), self.cfg.channel)

    @cached_property
    def kw_raw(self) -> DataFrame:
        if not self.given:
            return self._few(self._top(self.best[2]), self.cfg.channel)
        return self._few(self._top(self.scored.where("score > 0")), self.cfg.channel)

    @cached_property
    def vec(self) -> DataFrame:
        """The nearest documents by cosine: each task scores its documents against a block of
        questions as one product and gives out the best of each question."""
        if not self.given:
            return self._few(self._top(self.best[0]), self.cfg.channel)
        blocks = -(-self.asked // QUESTION_BLOCK) or 1
        q = vectors(self.questions, "qid", "query", self.cfg).join(self.questions.select("qid", "perm_mode", "perm_group"), "qid")
        found = [self._nearest(q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)) for i in range(blocks)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return self._few(self._top(out), self.cfg.channel)

    def _nearest(self, block: DataFrame) -> DataFrame:
        rows, k, guarded = block.collect(), self.cfg.channel, self.cfg.permissions  # about QUESTION_BLOCK rows of CELLS doubles
        qid = np.array([r["qid"] for r in rows], np.int64)
        qv = np.array([r["v"] for r in rows], np.float64).reshape(-1, CELLS)
        qn = np.sqrt((qv * qv).sum(1))
        every, groups = np.array([r["perm_mode"] == "all" or not guarded for r in rows], bool), [r["perm_group"] if r["perm_mode"] == "groups" else None for r in rows]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, CELLS)
                norm = np.sqrt((v * v).sum(1))
                ids, public, group = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist(), np.array(batch.column(3).to_pylist(), object)
                public, out = np.array([p == "public" for p in public], bool), []
                dots = qv @ v.T
                for i in range(len(qid)):
                    ok = (norm > 0) & (qn[i] > 0)
                    if not every[i]:
                        ok &= public | (group == groups[i] if groups[i] is not None else False)
                    at = np.nonzero(ok)[0]
                    s = dots[i, at] / (norm[at] * qn[i])
                    best = np.lexsort((ids[at], -np.round(s, 6)))[:k]
                    out.append((np.full(len(best), qid[i]), ids[at][best], s[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["qid", "doc_id", "score"])

        d = self.index.vectors.join(self.meta, "doc_id", "left" if not guarded else "inner")
        return d.select("doc_id", "v", "visibility", "kb_group").mapInArrow(score, "qid bigint, doc_id bigint, score double")

    @cached_property
    def hyb(self) -> DataFrame:
        """Reciprocal ranks, counted from 0; ties keep the order of first sight, vectors first."""
        vec = self.vec.withColumn("ch", F.lit(0))
        both = vec.unionByName(self.kw.withColumn("ch", F.lit(1))) if self.cfg.hybrid else vec
        merged = both.groupBy("qid", "doc_id").agg(F.sum(F.lit(1.0) / (self.cfg.rrf - 1 + F.col("rk"))).alias("rrf"), F.min("ch").alias("ch"), F.min(F.col("ch") * 1000 + F.col("rk")).alias("first_rk"))
        best = Window.partitionBy("qid").orderBy(F.round("rrf", 9).desc(), "ch", "first_rk")
        return self._few(merged.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= self.cfg.candidates).select("qid", "doc_id", "rrf", "rk"), self.cfg.candidates)

    @cached_property
    def rer(self) -> DataFrame:
        """Candidates by the share of the question's words that the text has; the input order on
        ties. Only candidates' texts are read into words."""
        q = self.questions.select("qid", F.array_distinct(tokens(F.col("query"), self.cfg.stop_words)).alias("qt"))
        texts = self.hyb.join(self.documents.select("doc_id", "text"), "doc_id").join(small(q, self.asked), "qid").where(F.size("qt") > 0)
        share = F.size(F.array_intersect("qt", tokens(F.col("text"), self.cfg.stop_words))) / F.size("qt")
        score = F.round(share, 4) if self.cfg.rerank else -F.col("rk").cast("double")
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "before_rk")
        return self._few(texts.select("qid", "doc_id", F.col("rk").alias("before_rk"), score.alias("score")).withColumn("rk", F.row_number().over(best)), self.cfg.candidates)

    @cached_property
    def planted(self) -> DataFrame:
        """(qid, doc_id): documents that hold a question's whole text. A document that does has the
        question's rarest inner word, so only those are read."""
        inner = self.questions.select("qid", "query", tokens(F.col("query")).alias("t")).where(F.size("t") > 2).select("qid", "query", F.explode(F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(1)))).alias("term"))
        rare = inner.join(self.words.terms, "term").groupBy("qid", "query").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
        places = self.words.postings.join(small(rare, self.asked), "term").select("qid", "query", "doc_id")
        long = places.join(self.documents.select("doc_id", "text"), "doc_id").where(F.contains("text", "query")).select("qid", "doc_id")
        # questions of one or two words have no inner word: all of them are looked for in one pass
        short = self.questions.where(F.coalesce(F.size(tokens(F.col("query"))), F.lit(0)) <= 2).where("query IS NOT NULL").select("qid", F.col("query").alias("word"))
        if short.limit(1).count() == 0:
            return long
        return long.unionByName(hits(self.documents, ["doc_id"], "text", short).join(short, "word").select("qid", "doc_id"))


def _ascii(t: str) -> int:
    return ord(t[0]) if t else 0


#: What a pass over the texts gives out: rows of counts (df; of all documents where there is no term), and one row for
#: each document: its number of words, its vector, the places of the questions' words that it has and how often it has each.
READ = "term string, df bigint, words bigint, doc_id bigint, visibility string, kb_group string, dl int, v array<int>, at array<int>, tf array<int>"
_READ = [("term", pa.string()), ("df", pa.int64()), ("words", pa.int64()), ("doc_id", pa.int64()), ("visibility", pa.string()), ("kb_group", pa.string()), ("dl", pa.int32()), *[(x, pa.list_(pa.int32())) for x in ("v", "at", "tf")]]


def _read_rows(n: int, **given: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[name].cast(kind) if name in given else pa.nulls(n, kind) for name, kind in _READ], names=[name for name, _ in _READ])


def _cells(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of each word, as in `vectors`; words of ASCII characters all at once."""
    octets, length = pc.binary_length(words).to_numpy().astype(np.int64), pc.utf8_length(words).to_numpy().astype(np.int64)
    raw = np.frombuffer(b"".join([*words.cast(pa.binary()).to_pylist(), b"\0\0"]), np.uint8)
    start = np.cumsum(octets) - octets
    first, second = np.where(octets > 0, raw[start], 0).astype(np.int64), np.where(octets > 1, raw[start + 1], 0).astype(np.int64)
    for i in np.nonzero(octets != length)[0]:
        word = words[i].as_py()
        first[i], second[i] = _ascii(word), _ascii(word[1:2])
    return (first * 7 + length * 13 + second) % CELLS, np.where(length % 2 == 0, 1, -1)


class _Reader:
    """Reads a task's documents (doc_id, words, visibility, kb_group) once: what it gives out is all that scoring them
    for the given words needs. Words are coded, so what follows is done once for each different word of a slice."""

    DOCUMENTS = 2048

    def __init__(self, terms: list[str], counts: bool) -> None:
        self.terms, self.counts = terms, counts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, self.DOCUMENTS):
                yield from self._read(batch.slice(lo, self.DOCUMENTS))

    def _read(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, n = batch.column(1), batch.num_rows
        size, coded = np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
        words, code, row = coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(n), size)
        different = max(1, len(words))
        cell, sign = _cells(words)
        v = np.bincount(row * CELLS + cell[code], weights=sign[code], minlength=n * CELLS).astype(np.int32)
        term = pc.index_in(words, value_set=pa.array(self.terms, words.type)).fill_null(-1).to_numpy().astype(np.int64)
        pair = row * different + code
        pair, tf = np.unique(pair if self.counts else pair[term[code] >= 0], return_counts=True)
        d, w = pair // different, pair % different
        if self.counts:
            yield _read_rows(1, df=pa.array([n]), words=pa.array([int(np.maximum(size, 1).sum())]))
            yield _read_rows(len(words), term=words, df=pa.array(np.bincount(w, minlength=len(words))))
        here = term[w] >= 0
        ends = np.cumsum(np.bincount(d[here], minlength=n))
        listed = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values.astype(np.int32)))
        yield _read_rows(n, doc_id=batch.column(0), visibility=batch.column(2), kb_group=batch.column(3), dl=pa.array(size), v=listed(v, np.arange(1, n + 1) * CELLS), at=listed(term[w][here], ends), tf=listed(tf[here], ends))


class _Scorer:
    """Scores a task's documents (doc_id, dl, v, at, tf, visibility, kb_group, listed; `_Reader`) for a block of questions
    and gives out each question's best in each channel: 0 vectors and 1 words under permissions, 2 words without.
    `terms` are the words that `at` tells; scores are products of small matrices."""

    #: Documents scored at once, questions of one product, found rows after which only the best are held.
    DOCUMENTS, QUESTIONS, HELD = 2048, 128, 500_000

    def __init__(self, rows: list, terms: list[str], cfg: Config, length: float) -> None:
        self.cfg, self.length, self.terms = cfg, length, len(terms)
        self.qid = np.array([r["qid"] for r in rows], np.int64)
        self.qv = np.array([r["v"] or [0.0] * CELLS for r in rows], np.float64).reshape(-1, CELLS)
        self.every = np.array([r["perm_mode"] == "all" or not cfg.permissions for r in rows], bool)
        self.groups = [r["perm_group"] if r["perm_mode"] == "groups" else None for r in rows]
        at = {t: i for i, t in enumerate(terms)}
        self.parts = []  # first question, its block's terms and their weights
        for lo in range(0, len(rows), self.QUESTIONS):
            some = [[(at[w["term"]], w["w"]) for w in r["ws"] or ()] for r in rows[lo : lo + self.QUESTIONS]]
            used = np.array(sorted({t for ws in some for t, _ in ws}), np.int64)
            weights = np.zeros((len(used), len(some)))
            for q, ws in enumerate(some):
                for t, w in ws:
                    weights[np.searchsorted(used, t), q] = w
            self.parts.append((lo, used, weights))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, self.DOCUMENTS):
                held += self._score(batch.slice(lo, self.DOCUMENTS))
                n += sum(len(h[0]) for h in held[-3 * len(self.qid) :])
                if n > self.HELD:
                    held = [self._best(held)]
                    n = len(held[0][0])
        if held:
            key, doc, score = self._best(held)
            q = len(self.qid)
            yield pa.RecordBatch.from_arrays([pa.array((key // q).astype(np.int32)), pa.array(self.qid[key % q]), pa.array(doc), pa.array(score)], names=["channel", "qid", "doc_id", "score"])

    def _best(self, found: list) -> tuple:
        key, doc, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((doc, -np.round(score, 6), key))
        key, doc, score = key[order], doc[order], score[order]
        kept = np.arange(len(key)) - np.searchsorted(key, key) < self.cfg.channel
        return key[kept], doc[kept], score[kept]

    def _score(self, batch: pa.RecordBatch) -> list[tuple]:
        c, n, ids, size = self.cfg, batch.num_rows, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        v = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(n, CELLS)
        norm, qn = np.sqrt((v * v).sum(1)), np.sqrt((self.qv * self.qv).sum(1))
        # how often each word of a question stands in each document
        d, t, tf = np.repeat(np.arange(n), np.diff(batch.column(3).offsets.to_numpy())), batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy()
        part = tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * size[d] / self.length))
        listed = batch.column(7).fill_null(False).to_numpy(zero_copy_only=False)
        public = np.array([p == "public" for p in batch.column(5).to_pylist()], bool)
        group = np.array([*batch.column(6).to_pylist(), None], object)[:-1]
        theirs = {g: public | (group == g) for g in {g for g in self.groups if g is not None}}
        out = []
        for lo, used, weights in self.parts:
            matrix, local = np.zeros((n, len(used))), np.full(self.terms, -1)
            local[used] = np.arange(len(used))
            here = local[t] >= 0
            matrix[d[here], local[t[here]]] = part[here]
            keyword = matrix @ weights
            at = slice(lo, lo + weights.shape[1])
            with np.errstate(all="ignore"):
                cosine = (v @ self.qv[at].T) / (norm[:, None] * qn[None, at])
            for i in range(weights.shape[1]):
                q = lo + i
                sees = listed if self.every[q] else listed & (public if self.groups[q] is None else theirs[self.groups[q]])
                matched = keyword[:, i] > 0
                for channel, score, ok in ((0, cosine[:, i], sees & (norm > 0) & (qn[q] > 0)), (1, keyword[:, i], sees & matched), (2, keyword[:, i], matched)):
                    at_all = np.nonzero(ok)[0]
                    if len(at_all) > c.channel:
                        some = score[at_all]
                        at_all = at_all[some >= np.partition(some, len(some) - c.channel)[len(some) - c.channel] - 2e-6]
                    best = at_all[np.lexsort((ids[at_all], -np.round(score[at_all], 6)))][: c.channel]
                    out.append((np.full(len(best), channel * len(self.qid) + q), ids[best], score[best]))
        return out


def visible_of(mode: str, group: str, visibility: str, kb_group: str) -> Column:
    """Three states: no list of groups (no filter), an empty list (public only), groups (theirs or public)."""
    return (F.col(mode) == "all") | (F.col(visibility) == "public") | ((F.col(mode) == "groups") & (F.col(kb_group) == F.col(group)))


def retrieve(questions: DataFrame, chunks: DataFrame, cfg: Config = Config(), index: Index | None = None) -> DataFrame:
    """Ranked contexts within the token budget for each question: qid, rk, doc_id, file_path, score
    and the numbered context text.

    questions: qid, query, perm_mode ('all', 'public_only', 'groups'), perm_group; chunks: doc_id,
    text, file_path, kb_group, visibility. Null texts have no words; equal scores keep the order of
    the fused list; questions without any visible hit have no rows."""
    s = Search(chunks.select("doc_id", "text"), questions, chunks, cfg, index, chunks)
    d = s.rer.where(F.col("rk") <= cfg.reranked).join(chunks.select("doc_id", "file_path", "text"), "doc_id")
    run = Window.partitionBy("qid").orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("used", F.sum(F.floor(F.length("text") / 2)).over(run)).where((F.col("rk") <= cfg.sure) | (F.col("used") <= cfg.budget))
    return d.select("qid", "rk", "doc_id", "file_path", "score", F.concat(F.lit("["), F.col("rk").cast("string"), F.lit("] ("), F.col("file_path"), F.lit(") "), F.col("text")).alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """One prompt for each question that has contexts: numbered fragments, then the question."""
    parts = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "context"))).alias("c"))
    return parts.join(questions.select("qid", "query"), "qid").select("qid", F.concat(F.array_join("c.context", "\n"), F.lit("\nQuestion: "), "query").alias("prompt"))
