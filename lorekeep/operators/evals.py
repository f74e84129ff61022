"""Evaluation of retrieval: means, deltas, bad cases, diagnosis, suggestions, metrics from verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.knn import dot
from lorekeep.plans.operator import coded, operator

METRICS = ["context_recall", "context_precision", "faithfulness", "answer_relevancy"]
_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)
#: Order of metrics where scores tie.
_ORDER = "CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(METRICS)) + " END"

eval_overall = operator("agg_eval_overall", "Metric means per configuration; missing scores don't count.", f"SELECT config, {_AVG} FROM eval_scores GROUP BY config")
eval_category = operator("agg_eval_category", "Metric means per category and overall in one pass.", f"SELECT config, category, {_AVG} FROM eval_scores GROUP BY GROUPING SETS ((config, category), (config))")
ab_pair = operator("join_ab_pair", "Baseline and optimised score of each question and metric.", "SELECT b.qid, b.metric, b.score AS baseline, o.score AS optimized FROM eval_long b JOIN eval_long o ON b.qid = o.qid AND b.metric = o.metric WHERE b.config = 'baseline' AND o.config = 'optimized'")
eval_ab = operator("agg_eval_ab", "Hallucination rates, deltas and directions with a dead band of 0.001.", """
SELECT metric, round(b, 6) AS baseline, round(o, 6) AS optimized, round(o - b, 6) AS delta, CASE WHEN o - b > 0.001 THEN 'up' WHEN o - b < -0.001 THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN metric = 'faithfulness' THEN round(1 - o, 6) END AS hallucination
FROM (SELECT metric, avg(CASE WHEN config = 'baseline' THEN score END) AS b, avg(CASE WHEN config = 'optimized' THEN score END) AS o FROM eval_long GROUP BY metric) m""")
eval_meta = operator("join_eval_meta", "Scores matched to the question's document.", "SELECT e.qid, e.config, d.source, d.lang FROM eval_scores e JOIN documents d ON e.qid = d.doc_id")
worst_metric = operator("agg_worst_metric", "The lowest metric of each question and what it points to.", f"""
SELECT qid, metric, CASE metric WHEN 'context_recall' THEN 'retrieval misses what the answer needs' WHEN 'context_precision' THEN 'relevant text ranks low' WHEN 'faithfulness' THEN 'claims without support' ELSE 'off the question' END AS diagnosis
FROM (SELECT qid, metric, row_number() OVER (PARTITION BY qid ORDER BY score, {_ORDER}) AS rn FROM eval_long WHERE config = 'optimized' AND score IS NOT NULL) r WHERE rn = 1""")
bad_cases = operator("topk_bad_cases", "The three worst questions with any metric below 0.5.", """
SELECT qid, round(worst, 6) AS worst FROM (SELECT qid, least(coalesce(context_recall, 1.0), context_precision, faithfulness, answer_relevancy) AS worst FROM eval_scores WHERE config = 'optimized') w WHERE worst < 0.5 ORDER BY worst, qid LIMIT 3""")
suggestions = operator("agg_suggestions", "Advice where a category's mean is below 0.7 or recall gained more than 0.05.", """
SELECT category, metric, round(m, 6) AS mean, CASE metric WHEN 'context_recall' THEN 'raise top_k or cut chunks finer' WHEN 'context_precision' THEN 'adjust rerank weights' ELSE 'answer from the context only' END AS advice
FROM (SELECT category, metric, avg(score) AS m FROM eval_long WHERE config = 'optimized' GROUP BY category, metric) c WHERE m < 0.7 AND metric <> 'answer_relevancy'
UNION ALL SELECT 'all', 'context_recall', round(g, 6), 'keep the optimised configuration'
FROM (SELECT avg(CASE WHEN config = 'optimized' THEN context_recall END) - avg(CASE WHEN config = 'baseline' THEN context_recall END) AS g FROM eval_scores) x WHERE g > 0.05""")
stratified = operator("win_stratified", "Round-robin sample of 40 questions over categories in order of first appearance.", """
SELECT qid, category FROM (SELECT qid, category, row_number() OVER (PARTITION BY category ORDER BY qid) AS rn, min(qid) OVER (PARTITION BY category) AS first_seen FROM eval_scores WHERE config = 'baseline') s
ORDER BY rn, first_seen LIMIT 40""")
ctx_precision = operator("eval_ctx_precision", "Mean precision at the ranks of relevant contexts.", """
SELECT qid, round(coalesce(sum(CASE WHEN relevant = 1 THEN hits / ctx_rank END) / nullif(sum(relevant), 0), 0), 6) AS context_precision
FROM (SELECT qid, ctx_rank, relevant, CAST(sum(relevant) OVER (PARTITION BY qid ORDER BY ctx_rank) AS DOUBLE) AS hits FROM verdicts) v GROUP BY qid""")
ctx_recall = operator("eval_ctx_recall", "Share of claims of the reference answer that contexts support.", "SELECT qid, round(CAST(sum(relevant) AS DOUBLE) / count(*), 6) AS context_recall FROM verdicts GROUP BY qid")
faithfulness = operator("eval_faithfulness", "Share of an answer's claims that contexts support.", "SELECT qid, round(avg(CAST(supported AS DOUBLE)), 6) AS faithfulness FROM claims GROUP BY qid", apart="SELECT qid, round(CAST(sum(supported) AS DOUBLE) / count(*), 6) AS faithfulness FROM claims GROUP BY qid")


@coded("eval_relevancy", "Mean cosine of generated questions to the question.", ["query_vectors", "chunk_vectors"], lambda d: f"""
SELECT q.qid, round(avg({d.dot('q.embedding', 'c.embedding')} / (sqrt({d.dot('q.embedding', 'q.embedding')}) * sqrt({d.dot('c.embedding', 'c.embedding')}))), 6) AS answer_relevancy
FROM query_vectors q JOIN chunk_vectors c ON c.label = q.qid % 10 AND c.chunk_id <> q.qid GROUP BY q.qid""")
def relevancy(query_vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """A mean of cosines is the product with the sum of vectors of length one: each label's vectors are summed once, and
    a question takes its own chunk out of the sum. Cosines that are null (a zero vector) don't count."""
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))
    whole = lambda v: ~F.exists(v, lambda x: x.isNull()) & (dot(v, v) > 0)
    c = chunk_vectors.select("chunk_id", F.col("label").cast("long").alias("label"), "embedding").where("label IS NOT NULL AND chunk_id IS NOT NULL")
    c = c.select("chunk_id", "label", F.when(whole("embedding"), unit("embedding")).alias("u"))
    sums = c.select("label", F.size("u").alias("dim"), F.posexplode("u").alias("pos", "x")).groupBy("label", "dim", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"), F.max("n").alias("n"))
    labels = c.groupBy("label").agg(F.count("*").alias("rows"))
    q = query_vectors.where("qid IS NOT NULL").select("qid", (F.col("qid") % 10).alias("label"), F.when(whole("embedding"), unit("embedding")).alias("v"))
    own = q.join(c.withColumnRenamed("chunk_id", "qid"), ["qid", "label"]).groupBy("qid").agg(F.count("*").alias("own_rows"), F.sum(F.when(F.size("u") == F.size("v"), 1).otherwise(0)).alias("own_n"), F.sum(F.when(F.size("u") == F.size("v"), dot("v", "u"))).alias("own_sum"))
    d = q.join(labels, "label").join(sums, (q["label"] == sums["label"]) & (F.size("v") == F.col("dim")), "left").drop(sums["label"]).join(own, "qid", "left")
    d = d.where(F.col("rows") > F.coalesce("own_rows", F.lit(0)))  # else the question has no other chunk
    n = F.col("n") - F.coalesce("own_n", F.lit(0))
    mean = F.when(n > 0, (dot("v", "total") - F.coalesce("own_sum", F.lit(0.0))) / n)
    return d.select("qid", F.round(mean, 6).alias("answer_relevancy"))


_PCT = lambda d, x: f"coalesce({d.fmt('%.1f%%', f'({x}) * 100')}, 'N/A')" if d.name == "spark" else f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE printf('%.1f%%', ({x}) * 100) END"
report_eval = operator("rpt_eval", "The evaluation as Markdown: means of both configurations with their change, means by category, the worst questions.", lambda d: f"""
WITH m AS (SELECT metric, avg(CASE WHEN config = 'baseline' THEN score END) AS b, avg(CASE WHEN config = 'optimized' THEN score END) AS o FROM eval_long GROUP BY metric),
  c AS (SELECT category, {', '.join(f'avg({x}) AS {x}' for x in METRICS)} FROM eval_scores WHERE config = 'optimized' GROUP BY category),
  w AS (SELECT qid, worst, row_number() OVER (ORDER BY worst, qid) AS n FROM (SELECT qid, least(coalesce(context_recall, 1.0), context_precision, faithfulness, answer_relevancy) AS worst FROM eval_scores WHERE config = 'optimized') x WHERE worst < 0.5 ORDER BY worst, qid LIMIT 3),
  lines AS (SELECT 0 AS part, '' AS k, '# Evaluation' AS line UNION ALL SELECT 1, '', concat('| metric | baseline | optimized | change |', chr(10), '| --- | --- | --- | --- |')
    UNION ALL SELECT 2, metric, concat('| ', metric, ' | ', {_PCT(d, 'b')}, ' | ', {_PCT(d, 'o')}, ' | ', CASE WHEN o - b > 0.001 THEN 'up' WHEN o - b < -0.001 THEN 'down' ELSE 'flat' END, ' |') FROM m
    UNION ALL SELECT 3, '', concat(chr(10), '| category |', {" ".join(f"' {x} |'," for x in METRICS)} chr(10), '| --- | --- | --- | --- | --- |')
    UNION ALL SELECT 4, category, concat('| ', category, ' | ', {", ' | ', ".join(_PCT(d, x) for x in METRICS)}, ' |') FROM c
    UNION ALL SELECT 5, '', concat(chr(10), 'Worst questions') UNION ALL SELECT 6, CAST(n AS STRING), concat('- ', CAST(qid AS STRING), ': ', {_PCT(d, 'worst')}) FROM w)
SELECT {d.agg_join('line', 'chr(10)', 'part, k')} AS report FROM lines""")
#: Fixed values in the patterns below: how a list of sources, a note of a source and a disclaimer begin. An answer is read line by line. A line that opens a list of sources starts a block that goes on over lines of
#: quotes and dashes; lines of a block and disclaimers go, then notes of sources inside lines, then spare blanks.
_LINES = """SELECT doc_id, text, answer, no, line, line RLIKE r'^[>]?[ \\t]*📚[ \\t]*参考来源[：:]' AS opens, line RLIKE r'^[ \\t]*[>-]' AS goes_on, line RLIKE r'^[>]?[ \\t]*⚠️' AS disclaimer FROM answers LATERAL VIEW posexplode(split(answer, chr(10))) l AS no, line"""
clean_answer = operator("fn_clean_answer", "Answers without source lists, disclaimers and inline source notes; the original where nothing stays.", f"""
SELECT doc_id, coalesce(nullif(trim(BOTH chr(10) FROM trim(regexp_replace(regexp_replace(listagg(regexp_replace(line, r'[（(]\\s*来源[：:][^）)]*[）)]', ''), chr(10)) WITHIN GROUP (ORDER BY no), r'[ \\t]+(?=\\n)', ''), r'\\n{{3,}}', concat(chr(10), chr(10))))), ''), max(answer)) AS answer FROM (
  SELECT *, last(CASE WHEN opens THEN true WHEN NOT goes_on THEN false END, true) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_block FROM ({_LINES}) a) b
WHERE NOT disclaimer AND NOT (opens OR (coalesce(in_block, false) AND goes_on)) GROUP BY doc_id""",
    apart="""SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN answer ELSE trim(regexp_replace(regexp_replace(CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), 'end') WHEN 1 THEN concat('begin', chr(10), chr(10), chr(10), text) ELSE text END, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', concat(chr(10), chr(10)), 'g'), concat(' ', chr(10))) END AS answer FROM answers""")
