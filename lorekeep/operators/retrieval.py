"""Search over many questions at once: BM25 and vectors, fused, merged, reranked, cut to a budget.

Spark's lists come from `lorekeep.operators.search` (a stored index, permissions below both rankings);
the SQL of the lists here is DuckDB's, written apart from it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.access import VISIBLE
from lorekeep.operators.knn import nearest
from lorekeep.operators.ranks import checkpointed
from lorekeep.operators.search import Config, Search, small
from lorekeep.plans.operator import OPERATORS, Operator, coded, operator, run_sql, uses, view, with_views
from lorekeep.plans.dialect import DUCK, SPARK

#: Fixed values of BM25Okapi: k1, b, epsilon.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Results per channel, constant of rank fusion, rerank candidates and results, token budget.
CHANNEL, RRF, CANDIDATES, RERANKED, BUDGET = 10, 60, 16, 5, 2000
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(d, src: str, key: str, text: str) -> str:
    """One row per word of a text, in order."""
    return d.explode(f"{src}", key, d.rall(f"lower({text})", TOKEN), "pos", "term")


def stats(d) -> str:
    """CTEs tf (doc_id, term, tf), lens, corpus (n, avgdl), idf with the floor for common terms."""
    return f"""tok AS MATERIALIZED ({tokens(d, 'documents', 'doc_id', 'text')}),
  tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
  lens AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
  corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(coalesce(l.dl, 1)) AS DOUBLE) / count(*) AS avgdl FROM documents d LEFT JOIN lens l ON d.doc_id = l.doc_id),
  raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term) x CROSS JOIN corpus),
  idf AS (SELECT term, df, CASE WHEN idf < 0 THEN {EPSILON} * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)"""


def bm25(d) -> str:
    """CTE scored: every question's matching documents with their score."""
    return f"""{stats(d)},
  qtok AS ({tokens(d, 'questions', 'qid', 'query')}),
  qtf AS (SELECT qid, term, count(*) AS qn FROM qtok GROUP BY qid, term),
  scored AS (SELECT q.qid, t.doc_id, sum(q.qn * i.idf * t.tf * ({K1} + 1) / (t.tf + {K1} * (1 - {B} + {B} * l.dl / c.avgdl))) AS score
    FROM qtf q JOIN idf i ON q.term = i.term JOIN tf t ON q.term = t.term JOIN lens l ON t.doc_id = l.doc_id CROSS JOIN corpus c GROUP BY q.qid, t.doc_id)"""


def keyword_channel(d, k: int = CHANNEL, permitted: bool = False) -> str:
    join = f"JOIN questions q ON s.qid = q.qid JOIN kb_docs c ON s.doc_id = c.doc_id WHERE {VISIBLE} AND" if permitted else "WHERE"
    return f"""SELECT qid, doc_id, score, rk FROM (SELECT s.qid, s.doc_id, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY round(s.score, 6) DESC, s.doc_id) AS rk FROM scored s {join} s.score > 0) r WHERE rk <= {k}"""


#: Questions have no vectors in the driver tables: a hashed bag of words stands for one, in 32 cells.
def hashed(d, src: str, key: str, text: str) -> str:
    return f"SELECT {key}, CAST(CASE WHEN length(term) % 2 = 0 THEN 1 ELSE -1 END * count(*) AS DOUBLE) AS w, (ascii(term) * 7 + length(term) * 13 + ascii(substring(term, 2, 1))) % 32 AS cell FROM ({tokens(d, src, key, text)}) t GROUP BY {key}, length(term) % 2, (ascii(term) * 7 + length(term) * 13 + ascii(substring(term, 2, 1))) % 32"


def vector_channel(d, k: int = CHANNEL) -> str:
    """CTEs qv, dv and vec: the k documents with the greatest cosine for each question."""
    return f"""qv AS (SELECT qid, cell, sum(w) AS w FROM ({hashed(d, 'questions', 'qid', 'query')}) a GROUP BY qid, cell),
  dv AS (SELECT doc_id, cell, sum(w) AS w FROM ({hashed(d, 'documents', 'doc_id', 'text')}) a GROUP BY doc_id, cell),
  dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dv GROUP BY doc_id), qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qv GROUP BY qid),
  dots AS (SELECT qv.qid, dv.doc_id, sum(qv.w * dv.w) AS dot FROM qv JOIN dv ON qv.cell = dv.cell GROUP BY qv.qid, dv.doc_id),
  vec AS (SELECT qid, doc_id, score, rk FROM (SELECT x.qid, x.doc_id, x.dot / (dn.norm * qn.norm) AS score, row_number() OVER (PARTITION BY x.qid ORDER BY round(x.dot / (dn.norm * qn.norm), 6) DESC, x.doc_id) AS rk
    FROM dots x JOIN dn ON x.doc_id = dn.doc_id JOIN qn ON x.qid = qn.qid JOIN questions q ON x.qid = q.qid JOIN kb_docs c ON x.doc_id = c.doc_id WHERE {VISIBLE} AND dn.norm > 0 AND qn.norm > 0) r WHERE rk <= {k})"""


def fused(k: int) -> str:
    """Weighted reciprocal ranks, counted from 0; ties keep the order of first sight, vectors first."""
    return f"""SELECT qid, doc_id, rrf, rk FROM (SELECT qid, doc_id, rrf, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, ch, first_rk) AS rk
  FROM (SELECT qid, doc_id, sum(1.0E0 / ({RRF} + rk - 1)) AS rrf, min(ch) AS ch, min(ch * 1000 + rk) AS first_rk FROM (SELECT qid, doc_id, rk, 0 AS ch FROM vec UNION ALL SELECT qid, doc_id, rk, 1 FROM kw) u GROUP BY qid, doc_id) f) g WHERE rk <= {k}"""


#: The scorer of pairs that needs no model: share of the question's words that the text has.
_LEX = """lex AS (SELECT h.qid, h.doc_id, h.rk, CAST(count(t.term) AS DOUBLE) / count(*) AS score FROM hyb h JOIN (SELECT DISTINCT qid, term FROM qtok) q ON h.qid = q.qid LEFT JOIN tf t ON t.doc_id = h.doc_id AND t.term = q.term GROUP BY h.qid, h.doc_id, h.rk),
  rer AS (SELECT qid, doc_id, rk AS before_rk, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, rk) AS rk FROM lex)"""


def _lists(d, sql: str) -> str:
    """DuckDB's CTEs of the lists that a text reads."""
    parts = [bm25(d)]
    reads = lambda *names: any(f" {n} " in f"{sql} ".replace("\n", " ").replace(")", " ) ") for n in names)
    if reads("kw_raw"):
        parts.append(f"kw_raw AS ({keyword_channel(d)})")
    if reads("kw", "hyb", "rer"):
        parts.append(f"kw AS ({keyword_channel(d, permitted=True)})")
    if reads("vec", "hyb", "rer"):
        parts.append(vector_channel(d))
    if reads("hyb", "rer"):
        parts.append(f"hyb AS ({fused(CANDIDATES)})")
    if reads("rer"):
        parts.append(_LEX)
    if reads("planted"):
        parts.append(f"planted AS (SELECT b.qid, d.doc_id FROM questions b JOIN documents d ON {d.find('d.text', 'b.query')} > 0)")
    return ", ".join(parts)


#: Lists of variants become one, first of each 120-character prefix.
MERGED = "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY v, rk) AS pos FROM (SELECT l.qid, l.doc_id, l.v, l.rk, row_number() OVER (PARTITION BY l.qid, substring(d.text, 1, 120) ORDER BY l.v, l.rk) AS seen FROM lists l JOIN documents d ON l.doc_id = d.doc_id) x WHERE seen = 1"


class Searched(Operator):
    """An operator over ranked lists: scored, kw (permitted), kw_raw, vec, hyb, rer, planted."""

    LISTS = ("scored", "qtf", "kw", "kw_raw", "vec", "hyb", "rer", "planted")

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(["documents", "questions", "kb_docs", *uses(self.text)]))

    @property
    def text(self) -> str:
        return self.body if isinstance(self.body, str) else self.body(SPARK)

    def __call__(self, cfg: Config = Config(), **frames: DataFrame) -> DataFrame:
        return self._run(cfg, frames, None)

    def _run(self, cfg: Config, frames: dict[str, DataFrame], catalogued: DataFrame | None) -> DataFrame:
        missing = [x for x in self.inputs if x not in frames]
        if missing:
            raise TypeError(f"{self.key} needs {', '.join(missing)}")
        search = Search(frames["documents"], frames["questions"], frames["kb_docs"], cfg, catalogued=catalogued)
        return self.listed(search, frames)

    def listed(self, search: Search, frames: dict[str, DataFrame]) -> DataFrame:
        needed = {n for n in self.LISTS if f" {n} " in f"{self.text} ".replace("\n", " ").replace(")", " ) ")}
        return run_sql(self.text, frames | {n: getattr(search, n) for n in self.LISTS if n in needed}, search.spark)

    def over(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        found: dict[str, DataFrame] = {}
        frames = {x: view(spark, sf_dir, x, found) for x in self.inputs}
        return self._run(Config(), frames, frames["kb_docs"])  # that view has a row for each document, with its text

    def oracle(self) -> str:
        sql = self.body if isinstance(self.body, str) else self.body(DUCK)
        inner = sql.removeprefix("WITH ")
        return with_views(f"WITH {_lists(DUCK, sql)}{', ' if inner != sql else ' '}{inner}")


def searched(key: str, doc: str, body, kind: type[Searched] = Searched) -> Searched:
    OPERATORS[key] = made = kind(key, doc, body)
    return made


class Variants(Searched):
    """Each variant of a question is a question of its own under the permissions of the question."""

    def listed(self, search: Search, frames: dict[str, DataFrame]) -> DataFrame:
        q = frames["questions"]
        lists = frames["variants"].join(q.select(F.col("qid").alias("vid"), "query"), "vid").join(q.select(F.col("qid").alias("base"), "perm_mode", "perm_group"), "base")
        lists = checkpointed(lists.withColumn("qid", F.monotonically_increasing_id()))
        own = Search(search.documents, lists.select("qid", "query", "perm_mode", "perm_group"), frames["kb_docs"], replace(search.cfg, channel=CHANNEL, permissions=True), catalogued=search.catalogued)
        ranked = own.kw.join(lists.select("qid", "base", "v"), "qid").select(F.col("base").alias("qid"), "v", "doc_id", "rk")
        return run_sql(MERGED, {"lists": small(ranked, CHANNEL * own.asked), "documents": search.documents}, search.spark)


class Merged(Searched):
    """The union of two lists loses their hints, so texts are cut down to those of listed documents before they are dealt."""

    def listed(self, search: Search, frames: dict[str, DataFrame]) -> DataFrame:
        ids = search.vec.select("doc_id").unionByName(search.kw.select("doc_id")).distinct()
        few = search.documents.join(small(ids, 2 * search.cfg.channel * search.asked), "doc_id", "left_semi")
        return super().listed(search, frames | {"documents": few})


bm25_search = searched("bm25_search", "BM25 top 10 of every question through the postings join, whatever its permissions.", "SELECT qid, doc_id, rk, round(score, 4) AS score FROM kw_raw ")
topk_bm25 = searched("topk_bm25", "The same under each question's permissions, filtered before the cut.", "SELECT qid, doc_id, rk FROM kw ")
flt_permission_bm25 = searched("flt_permission_bm25", "Matches that permissions take away from the keyword channel.", f"SELECT s.qid, count(*) AS matches, CAST(count_if({VISIBLE}) AS BIGINT) AS visible FROM scored s JOIN questions q ON s.qid = q.qid JOIN kb_docs c ON s.doc_id = c.doc_id GROUP BY s.qid")


class Stats(Operator):
    """Counted from the words of the texts: no index is written."""

    def __call__(self, **frames: DataFrame) -> DataFrame:
        from lorekeep.operators.search import term_statistics

        return term_statistics(frames["documents"])

    def over(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self(documents=view(spark, sf_dir, "documents"))


OPERATORS["agg_bm25_stats"] = bm25_stats = Stats("agg_bm25_stats", "Document frequency and idf of every term.", lambda d: f"WITH {stats(d)} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")

_KNN = lambda d, measure, k, order: f"""SELECT qid, vec_id, rk FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(m, 6) {order}, vec_id) AS rk FROM (
  SELECT q.qid, e.vec_id, {measure} AS m FROM query_vectors q CROSS JOIN embeddings e WHERE q.qid <> e.vec_id) x) r WHERE rk <= {k}"""  # noqa: E731
_COS = lambda d, a, b: f"{d.dot(a, b)} / nullif(sqrt({d.dot(a, a)}) * sqrt({d.dot(b, b)}), 0)"


@coded("join_knn_l2", "Exact nearest vectors by squared distance, cells of pivots pruned by the triangle inequality.", ["query_vectors", "embeddings"], lambda d: _KNN(d, d.l2sq("q.embedding", "e.embedding"), 10, "ASC"))
def knn_l2(query_vectors: DataFrame, embeddings: DataFrame) -> DataFrame:
    return nearest(query_vectors, embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10).found.select("qid", F.col("id").alias("vec_id"), "rk")


@coded("join_knn_cosine", "Exact nearest vectors by cosine, zero norms left out; the same pruning on unit vectors.", ["query_vectors", "embeddings"], lambda d: _KNN(d, _COS(d, "q.embedding", "e.embedding"), 10, "DESC"))
def knn_cosine(query_vectors: DataFrame, embeddings: DataFrame) -> DataFrame:
    return nearest(query_vectors, embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, cosine=True).found.select("qid", F.col("id").alias("vec_id"), "rk")


@coded("topk_vector", "Nearest visible chunks: permissions are applied below the ranking.", ["query_vectors", "chunk_vectors"], lambda d: f"""
SELECT qid, chunk_id, rk FROM (SELECT q.qid, c.chunk_id, row_number() OVER (PARTITION BY q.qid ORDER BY round({d.l2sq('q.embedding', 'c.embedding')}, 6), c.chunk_id) AS rk
  FROM query_vectors q CROSS JOIN chunk_vectors c WHERE c.embedding IS NOT NULL AND (c.visibility = 'public' OR c.kb_group = q.perm_group)) r WHERE rk <= 8""")
def topk_vector(query_vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    rows = chunk_vectors.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"), "visibility", "kb_group")
    visible = (F.col("visibility") == "public") | (F.col("kb_group") == F.col("perm_group"))
    return nearest(query_vectors, rows, 8, allowed=visible, own=True).found.select("qid", F.col("id").alias("chunk_id"), "rk")


@coded("topk_tools", "The five tools nearest to each query by cosine; a tool's vector is the centroid of its label.", ["query_vectors", "tool_vectors"], lambda d: f"""
SELECT qid, label, rk FROM (SELECT q.qid, t.label, row_number() OVER (PARTITION BY q.qid ORDER BY round({_COS(d, 'q.embedding', 't.embedding')}, 6) DESC, t.label) AS rk
  FROM query_vectors q CROSS JOIN tool_vectors t) r WHERE rk <= 5""")
def topk_tools(query_vectors: DataFrame, tool_vectors: DataFrame) -> DataFrame:
    rows = tool_vectors.select(F.col("label").alias("id"), F.col("embedding").alias("vector"))
    return nearest(query_vectors, rows, 5, cosine=True, own=True).found.select("qid", F.col("id").alias("label"), "rk")


rrf_fuse = searched("rrf_fuse", "Weighted reciprocal-rank fusion of two channels.", f"SELECT qid, doc_id, rk, round(rrf, 8) AS rrf FROM hyb WHERE rk <= {CHANNEL}")
hybrid_search = searched("hybrid_search", "Both channels under permissions, fused; the flagship query.", f"SELECT h.qid, h.doc_id, h.rk, round(h.rrf, 8) AS rrf, substring(c.text, 1, 80) AS preview FROM hyb h JOIN kb_docs c ON h.doc_id = c.doc_id WHERE h.rk <= {CHANNEL}")
multi_variant = searched("multi_variant_search", "A question and its variant searched apart under the question's permissions, then merged by first sight.", f"""
WITH lists AS (SELECT base AS qid, v, doc_id, rk FROM (SELECT v.base, v.v, s.doc_id, row_number() OVER (PARTITION BY v.base, v.v ORDER BY round(s.score, 6) DESC, s.doc_id) AS rk
    FROM variants v JOIN scored s ON v.vid = s.qid JOIN questions q ON v.base = q.qid JOIN kb_docs c ON s.doc_id = c.doc_id WHERE s.score > 0 AND {VISIBLE}) r WHERE rk <= {CHANNEL})
{MERGED}""".strip(), Variants)
merge_dedupe = searched("merge_dedupe", "Two lists become one, first of each 120-character prefix.", """
WITH lists AS (SELECT qid, doc_id, rk, 0 AS src FROM vec UNION ALL SELECT qid, doc_id, rk, 1 FROM kw )
SELECT qid, doc_id, src, rk FROM (SELECT l.*, row_number() OVER (PARTITION BY l.qid, substring(d.text, 1, 120) ORDER BY l.src, l.rk) AS rn FROM lists l JOIN documents d ON l.doc_id = d.doc_id) x WHERE rn = 1""".strip(), Merged)
doc_key = operator("fn_doc_key", "Key of a result: its id, else its first 120 characters.", "SELECT doc_id, CASE WHEN chunk_id IS NULL THEN concat('txt::', substring(text, 1, 120)) ELSE concat('id::', CAST(chunk_id AS STRING)) END AS k FROM results")
no_context = searched("flt_no_context", "Questions that neither channel answers.", "SELECT q.qid FROM questions q LEFT JOIN (SELECT qid FROM kw UNION SELECT qid FROM vec ) h ON q.qid = h.qid WHERE h.qid IS NULL")

topk_rerank = searched("topk_rerank", "16 candidates scored, five kept.", f"SELECT qid, doc_id, rk FROM rer WHERE rk <= {RERANKED}")
rerank_rank = searched("win_rerank_rank", "Score and rank written back to candidates.", "SELECT qid, doc_id, rk, score FROM rer ")
rank_change = searched("join_rank_change", "How reranking moved each candidate.", "SELECT qid, doc_id, before_rk, rk, CASE WHEN rk < before_rk THEN 'up' WHEN rk > before_rk THEN 'down' ELSE 'same' END AS moved FROM rer ")
rerank_pipeline = searched("rerank_pipeline", "Scores with fallback to the input order where the scorer failed.", "SELECT r.qid, r.doc_id, row_number() OVER (PARTITION BY r.qid ORDER BY CASE WHEN f.doc_id IS NOT NULL THEN NULL ELSE -r.score END NULLS LAST, r.before_rk) AS rk FROM rer r LEFT JOIN score_failures f ON r.doc_id = f.doc_id")
min_score = searched("flt_min_score_keep_best", "Candidates over a score; the best one where none passes.",
    "SELECT qid, doc_id, rk FROM (SELECT *, max(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS any_pass FROM rer ) r WHERE score >= 0.5 OR (any_pass = 0 AND rk = 1)")
token_budget = searched("win_token_budget", "Kept while among the first two or within 2000 tokens, five at most.", f"""
WITH run AS (SELECT r.qid, r.doc_id, r.rk, sum(CAST(floor(length(d.text) / 2) AS BIGINT)) OVER (PARTITION BY r.qid ORDER BY r.rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM rer r JOIN documents d ON r.doc_id = d.doc_id)
SELECT qid, doc_id, rk, CAST(used AS BIGINT) AS used FROM run WHERE rk <= 5 AND (rk <= 2 OR used <= {BUDGET})""".strip())
calibrate = searched("agg_lang_calibrate", "The language group with the lower mean is scaled up, by 1.2 at most, capped at the best score.", """
WITH m AS (SELECT r.*, d.lang = 'en' AS en, avg(CASE WHEN d.lang = 'en' THEN score END) OVER (PARTITION BY r.qid) AS me, avg(CASE WHEN d.lang <> 'en' THEN score END) OVER (PARTITION BY r.qid) AS mo, max(score) OVER (PARTITION BY r.qid) AS top FROM rer r JOIN documents d ON r.doc_id = d.doc_id)
SELECT qid, doc_id, round(CASE WHEN me > 0 AND mo > 0 AND en AND me < mo THEN least(score * least(mo / me, 1.2), top) WHEN me > 0 AND mo > 0 AND NOT en AND mo < me THEN least(score * least(me / mo, 1.2), top) ELSE score END, 6) AS score FROM m""".strip())
funnel = searched("agg_funnel", "Sizes of the lists of each question, stage by stage.", """
SELECT q.qid, coalesce(v.n, 0) AS vector, coalesce(k.n, 0) AS keyword, coalesce(f.n, 0) AS fused, coalesce(r.n, 0) AS reranked, round(CAST(coalesce(r.n, 0) AS DOUBLE) / nullif(coalesce(f.n, 0), 0), 6) AS ratio FROM questions q
LEFT JOIN (SELECT qid, count(*) AS n FROM vec GROUP BY qid) v ON q.qid = v.qid LEFT JOIN (SELECT qid, count(*) AS n FROM kw GROUP BY qid) k ON q.qid = k.qid
LEFT JOIN (SELECT qid, count(*) AS n FROM hyb GROUP BY qid) f ON q.qid = f.qid LEFT JOIN (SELECT qid, count(*) AS n FROM rer WHERE rk <= 5 GROUP BY qid) r ON q.qid = r.qid""".strip())
explicit_order = searched("win_explicit_order", "Candidates in an order given by index; indices out of range drop out.", lambda d: f"""
WITH asked AS ({d.explode("orders_given", 'qid', d.split('o', chr(39) + ',' + chr(39)), 'pos', 'idx')})
SELECT h.qid, h.doc_id, min(a.pos) AS pos, 16 - min(a.pos) AS score FROM hyb h JOIN asked a ON h.qid = a.qid AND h.rk - 1 = CAST(a.idx AS INT) GROUP BY h.qid, h.doc_id""".strip())
build_prompt = searched("fn_build_prompt", "Numbered fragments with their sources, then the question.", lambda d: f"""
SELECT q.qid, concat({d.agg_join("concat('[', CAST(h.rk AS STRING), '] (', c.file_path, ') ', c.text)", 'chr(10)', 'h.rk')}, chr(10), 'Question: ', max(q.query)) AS prompt
FROM hyb h JOIN kb_docs c ON h.doc_id = c.doc_id JOIN questions q ON h.qid = q.qid WHERE h.rk <= 5 GROUP BY q.qid""".strip())
snippet = operator("fn_snippet", "Numbered results with source and first 300 characters; 80-character previews on one line.", lambda d: f"""
SELECT doc_id, concat(file_path, ': ', substring(text, 1, 300)) AS snippet, {d.rrep(d.rrep('substring(text, 1, 80)', '\\n', ' '), '\\|', '/')} AS preview FROM kb_docs""")
ablation = searched("ablation_grid", "Named configurations over the same questions: keyword, vector, hybrid.",
    "SELECT 'keyword' AS config, qid, doc_id, rk FROM kw WHERE rk <= 5 UNION ALL SELECT 'vector', qid, doc_id, rk FROM vec WHERE rk <= 5 UNION ALL SELECT 'hybrid', qid, doc_id, rk FROM hyb WHERE rk <= 5")
recall = searched("eval_recall_at_k", "Share of planted passages whose document is among the first ten.", "SELECT count(*) AS planted, count(k.doc_id) AS found FROM planted r LEFT JOIN kw_raw k ON r.qid = k.qid AND r.doc_id = k.doc_id")
rerank_key = searched("fn_rerank_key", "Key of a rerank call: the question and its candidates' prefixes in order.", lambda d: f"""
SELECT q.qid, md5(concat(max(q.query), '|', {d.agg_join('substring(t.text, 1, 80)', chr(39) + '|' + chr(39), 'h.rk')})) AS k FROM hyb h JOIN documents t ON h.doc_id = t.doc_id JOIN questions q ON h.qid = q.qid GROUP BY q.qid""".strip())
