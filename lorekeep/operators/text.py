"""Text functions: words, n-grams, similarity, masks, keys, parsers, templates."""

from __future__ import annotations

from lorekeep.plans.dialect import DUCK, SPARK
from lorekeep.plans.operator import operator

#: Math symbols; share of them from which a line is a formula.
MATH = "+-=×÷±·∑∫∏∂∞√∝αβγδεθλμπσφω≤≥≠≈≡∈⊂⊆→←⇒⇔∀∃∧∨¬¹²³₀₁₂₃⟨⟩⌊⌋⌈⌉"
STRONG = "∑∫∂∏∞√"
CODE = "{}[]();<>=+-*/|&^%$#@!~`"
FORMULA_SHARE, FORMULA_LEAST = 0.15, 3
GARBAGE, REPEATED_GARBAGE, LEAST_SENTENCE, MOST_NEWLINES = 0.02, 0.05, 5, 0.4


def any_of(characters: str) -> str:
    """Characters as the inside of a pattern's class."""
    return "".join(f"\\{c}" if c in "[]-^" else c for c in characters)


def grams(d, x: str) -> str:
    return d.distinct(d.transform(d.seq("1", f"length({x}) - 1"), "i", f"substring({x}, CAST(i AS INT), 2)"))


tokenize = operator("fn_tokenize", "Words of a text in order, lower case, then its CJK pairs, without stop words.", """
SELECT doc_id, CAST(size(t) AS BIGINT) AS n, array_join(t, ' ') AS tokens FROM (SELECT doc_id, filter(concat(regexp_extract_all(low, r'[\\x{4E00}-\\x{9FFF}]|[\\p{L}\\p{N}_&&[^\\x{4E00}-\\x{9FFF}]]+', 0), regexp_extract_all(low, r'(?=([\\x{4E00}-\\x{9FFF}]{2}))', 1)), w -> NOT array_contains(s.words, w)) AS t
  FROM (SELECT doc_id, lower(text) AS low FROM mixed_texts) x CROSS JOIN (SELECT collect_list(word) AS words FROM stop_words) s) y""",
    apart=r"""WITH low AS (SELECT doc_id, lower(text) AS t FROM mixed_texts), words AS (SELECT doc_id, regexp_extract_all(regexp_replace(t, '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}_]+') AS w, string_split(t, '') AS c FROM low),
  every AS (SELECT doc_id, list_concat(w, list_filter(list_transform(generate_series(1, len(c) - 1), lambda i: CASE WHEN regexp_matches(concat(c[i], c[i + 1]), '^[\x{4E00}-\x{9FFF}]{2}$') THEN concat(c[i], c[i + 1]) END), lambda x: x IS NOT NULL)) AS t FROM words),
  kept AS (SELECT doc_id, list_filter(t, lambda x: NOT list_contains((SELECT list(word) FROM stop_words), x)) AS t FROM every)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ' ') AS tokens FROM kept""".replace("list_contains((SELECT list(word) FROM stop_words), x)", "list_contains(s.words, x)").replace("AS t FROM every)", "AS t FROM every CROSS JOIN (SELECT list(word) AS words FROM stop_words) s)"))
bigrams = operator("fn_bigrams", "Distinct character pairs of trimmed lower-case text.", lambda d: f"SELECT conv_id, turn, {d.size('g')} AS n, {d.join(d.sort('g'), chr(39) + '|' + chr(39))} AS grams FROM (SELECT conv_id, turn, {grams(d, 'q')} AS g FROM (SELECT conv_id, turn, lower(trim(query)) AS q FROM reflection) r WHERE length(q) > 1) x")
_PAIR = lambda d: f"(SELECT a.conv_id, a.turn, {grams(d, 'lower(a.query)')} AS ga, {grams(d, 'lower(b.query)')} AS gb FROM reflection a JOIN reflection b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 WHERE length(a.query) > 1 AND length(b.query) > 1)"
ngram_sets = operator("set_ngram", "Sizes of intersection and union of two texts' pairs.", lambda d: f"SELECT conv_id, turn, {d.size(d.intersect('ga', 'gb'))} AS common, {d.size(d.union('ga', 'gb'))} AS whole FROM {_PAIR(d)} p")
jaccard = operator("fn_jaccard", "Jaccard similarity of neighbouring questions.", lambda d: f"SELECT conv_id, turn, round(CAST({d.size(d.intersect('ga', 'gb'))} AS DOUBLE) / {d.size(d.union('ga', 'gb'))}, 6) AS similarity FROM {_PAIR(d)} p")
cosine = operator("fn_cosine", "Cosine of each vector with its label's centroid, null for zero norms.", lambda d: f"SELECT e.vec_id, round({d.dot('e.embedding', 't.embedding')} / nullif(sqrt({d.dot('e.embedding', 'e.embedding')}) * sqrt({d.dot('t.embedding', 't.embedding')}), 0), 6) AS cosine FROM embeddings e JOIN tool_vectors t ON e.label = t.label")
relevance = operator("fn_relevance", "Distance to relevance.", "SELECT event_id, round(1.0E0 / (1 + greatest(value - 5, 0)), 6) AS relevance FROM events")
is_chinese = operator("fn_is_chinese", "Whether a text is Chinese: by its share of CJK characters, code aside.", lambda d: f"""
SELECT doc_id, CASE WHEN cn > 0.3 THEN true WHEN words > 5 AND code > 0.1 AND cn < 0.1 THEN false ELSE cn > 0.1 END AS chinese FROM (
  SELECT doc_id, CAST(length({d.rrep('t', '[^一-鿿]', '')}) AS DOUBLE) / greatest(length(t), 1) AS cn, {d.size(d.rall('t', '[a-zA-Z]{3,}'))} AS words, CAST(length({d.rrep('t', f'[^{any_of(CODE)}]', '')}) AS DOUBLE) / greatest(length(t), 1) AS code
  FROM (SELECT doc_id, text AS t FROM mixed_texts) x) y""")
rerank_text = operator("fn_rerank_text", "Title path in front of the body.", "SELECT doc_id, CASE WHEN h1 IS NULL AND h2 IS NULL THEN text ELSE concat('【', concat_ws(' > ', h1, h2), '】', text) END AS t FROM titled_texts",
    apart="SELECT doc_id, concat(CASE WHEN coalesce(h1, h2) IS NOT NULL THEN '【' || coalesce(h1, '') || CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN ' > ' ELSE '' END || coalesce(h2, '') || '】' END, text) AS t FROM titled_texts")
smart_truncate = operator("fn_smart_truncate", "Texts of up to 512 characters whole; of others 512 around the first pair of the query that they have, else title path and beginning.", lambda d: f"""
WITH pairs AS ({d.explode("(SELECT doc_id, text, CASE WHEN length(query) > 1 THEN query END AS q FROM query_texts) x", 'doc_id, text, q', d.seq('1', 'CASE WHEN length(text) > 512 AND q IS NOT NULL THEN length(q) - 1 ELSE 1 END'), 'pos', 'i')}),
  hits AS (SELECT doc_id, text, min(CASE WHEN {d.find('text', 'substring(q, CAST(i AS INT), 2)')} > 0 THEN pos END) AS first_pair, min_by({d.find('text', 'substring(q, CAST(i AS INT), 2)')}, CASE WHEN {d.find('text', 'substring(q, CAST(i AS INT), 2)')} > 0 THEN pos ELSE 1000000 + pos END) AS place FROM pairs GROUP BY doc_id, text)
SELECT doc_id, CASE WHEN length(text) <= 512 THEN text WHEN first_pair IS NOT NULL THEN substring(text, CAST(greatest(place - 256, 1) AS INT), 512)
  WHEN text LIKE '【%' AND {d.find('substring(text, 1, 200)', "'】'")} > 0 THEN substring(text, 1, CAST(512 - {d.find('substring(text, 1, 200)', "'】'")} AS INT)) ELSE substring(text, 1, 512) END AS t FROM hits""")
truncate = operator("fn_truncate", "Previews of 200 and thoughts of 300 characters.", "SELECT doc_id, substring(text, 1, 200) AS preview, substring(text, 1, 300) AS thought FROM documents")
sanitize_map = operator("fn_sanitize_map", "Masked arguments, long ones cut with their rest's length.", lambda d: f"""
SELECT doc_id, k, CASE WHEN {d.rlike('lower(k)', 'api_key|secret|token|password')} THEN '***' WHEN length(v) > 500 THEN concat(substring(v, 1, 500), '...(+', CAST(length(v) - 500 AS STRING), ')') ELSE v END AS v
FROM call_arguments a""")
cache_key = operator("fn_cache_key", "Key of a search: question and sorted groups.", lambda d: f"SELECT qid, md5(concat(query, '|', {d.join(d.sort(d.array('perm_group', chr(39) + 'public' + chr(39))), chr(39) + ',' + chr(39))})) AS k FROM questions")
docs_json = operator("fn_docs_json", "Documents to JSON and back: text and metadata as they were.", """
SELECT doc_id, d.page_content AS content, d.metadata['source'] AS source, d.metadata['lang'] AS lang FROM (
  SELECT doc_id, from_json(to_json(named_struct('page_content', text, 'metadata', map('source', source, 'lang', lang))), 'page_content STRING, metadata MAP<STRING, STRING>') AS d FROM documents) j""", apart="SELECT doc_id, text AS content, source, lang FROM documents")
norm_path = operator("fn_norm_path", "Forward slashes only.", lambda d: f"SELECT doc_id, {d.rrep('p', '[\\\\]+' if d.name == 'duck' else '[\\\\]+', '/')} AS p FROM raw_paths x")
file_hash = operator("fn_file_hash", "MD5 of content.", "SELECT doc_id, md5(text) AS h FROM documents")
basename = operator("fn_basename", "Last part of a path, unknown where there is none.", lambda d: f"SELECT doc_id, coalesce(nullif({d.rext('file_path', '[^/]+$')}, ''), 'unknown') AS name FROM kb_docs")
region_key = operator("fn_region_key", "Cache key of a region: source, page, rounded box.", "SELECT doc_id, line_no, substring(md5(concat_ws('|', CAST(doc_id AS STRING), CAST(page AS STRING), CAST(CAST(x AS INT) AS STRING), CAST(CAST(y AS INT) AS STRING))), 1, 16) AS k FROM layout_lines")
decay = operator("fn_decay", "1 until 90 days, then down to 0.3.", "SELECT mem_id, round(CASE WHEN age_days <= 90 THEN 1.0E0 ELSE greatest(0.3E0, 1 - (age_days - 90) / 180.0E0) END, 6) AS decay FROM memory")
json_format = operator("fn_json_format", "A record as text by a table of fields: label, path, default for what is missing.", lambda d: f"""
SELECT r.event_id, {d.agg_join("concat(f.label, coalesce(" + ("get_json_object(r.record, concat('$.', f.path))" if d.name == "spark" else "json_extract_string(r.record, concat('$.', f.path))") + ", f.missing))", "'，'", "f.pos")} AS t FROM weather_records r CROSS JOIN record_fields f GROUP BY r.event_id""")
template_fill = operator("fn_template_fill", "Names in braces are filled in from a map of slots; unknown ones stay.",
    "SELECT doc_id, aggregate(map_entries(map('source', source, 'lang', lang)), template, (t, e) -> replace(t, concat('{', e.key, '}'), e.value)) AS t FROM templates",
    apart="SELECT doc_id, replace(replace(template, '{source}', source), '{lang}', lang) AS t FROM templates")
format_registry = operator("fn_format_registry", "Tools of the registry as lines of a prompt: name, description and what they ask for.", lambda d: f"SELECT tool_id, concat('- ', tool_name, ': ', description, CASE WHEN required = '[]' THEN '' ELSE concat(' (', {d.join(d.json_list('required'), chr(39) + ', ' + chr(39))}, ')') END) AS line FROM tool_registry",
    apart="""SELECT tool_id, concat('- ', tool_name, ': ', description, CASE required WHEN '[]' THEN '' WHEN '["*"]' THEN ' (*)' WHEN '["upload"]' THEN ' (upload)' ELSE ' (search_group, view_audit)' END) AS line FROM tool_registry""")
dictionary = operator("join_dictionary", "Translation by dictionary, the original where there is none.", "SELECT n.n_nationkey AS id, coalesce(t.zh, n.n_name) AS name FROM nation n LEFT JOIN (VALUES ('NATION_1', '中国'), ('NATION_2', '法国'), ('NATION_3', '德国'), ('ATLANTIS', '无')) AS t(en, zh) ON n.n_name = t.en",
    apart="SELECT n_nationkey AS id, CASE n_name WHEN 'NATION_1' THEN '中国' WHEN 'NATION_2' THEN '法国' WHEN 'NATION_3' THEN '德国' ELSE n_name END AS name FROM nation")
clean = operator("txt_clean", "Spaces collapsed, line ends unified, ends trimmed.", lambda d: f"SELECT doc_id, trim({d.rrep(d.rrep('text', '\\r\\n?', ' '), '[ \\t]+', ' ')}) AS t FROM documents")
is_formula = operator("txt_is_formula", "Lines of three characters and more with more than 15 % math symbols or a strong one.", lambda d: f"SELECT doc_id, line_no, length(line) >= {FORMULA_LEAST} AND (CAST(length({d.rrep('line', f'[^{any_of(MATH)}]', '')}) AS DOUBLE) / greatest(length(line), 1) > {FORMULA_SHARE} OR {d.rlike('line', f'[{any_of(STRONG)}]')}) AS formula FROM doc_lines")
#: Brackets are folded over a stack of the closing ones that are due; '!' stands for a fault.
latex_ok = operator("txt_latex_ok", "Two characters or more, an even number of dollars, brackets that close in order.", """
SELECT doc_id, length(t) >= 2 AND length(regexp_replace(t, r'[^$]', '')) % 2 = 0 AND aggregate(regexp_extract_all(t, r'[{}\\[\\]()]', 0), '',
  (due, c) -> CASE WHEN due = '!' THEN '!' WHEN c IN ('{', '[', '(') THEN concat(due, translate(c, '{[(', '}])')) WHEN right(due, 1) = c THEN left(due, length(due) - 1) ELSE '!' END) = '' AS ok FROM latex_texts""",
    apart=r"""WITH RECURSIVE strip AS (SELECT doc_id, t, regexp_replace(t, '[^{}\[\]()]', '', 'g') AS s, 0 AS k FROM latex_texts
  UNION ALL SELECT doc_id, t, regexp_replace(s, '\{\}|\[\]|\(\)', '', 'g'), k + 1 FROM strip WHERE regexp_matches(s, '\{\}|\[\]|\(\)'))
SELECT doc_id, length(t) >= 2 AND len(string_split(t, '$')) % 2 = 1 AND s = '' AS ok FROM strip QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1""")
#: The characters of ordinary text (CJK, letters, digits, quotes, marks of both scripts, white space), as the inside of a class.
NORMAL = r"一-龥a-zA-Z0-9‘’“”，。！？；：、（）《》「」…—–.,!?;:\"'()\[\]<>\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ODD_RUNS = r"[\x{3000}\x{FFFD}]{3,}|[\x{00}-\x{08}]{3,}"
_GATE = f"CASE WHEN n = 0 THEN 'empty' WHEN CAST(odd AS DOUBLE) / n > {GARBAGE} THEN 'garbage' WHEN CAST(runs AS DOUBLE) / n > {REPEATED_GARBAGE} THEN 'repeated' WHEN sentence < {LEAST_SENTENCE} THEN 'short' WHEN CAST(newlines AS DOUBLE) / n > {MOST_NEWLINES} THEN 'sparse' ELSE 'ok' END"
quality_gate = operator("txt_quality_gate", "First failing test of a text layer: characters that ordinary text doesn't have, runs of three and more of them, mean length of sentences, newlines.", f"""
SELECT doc_id, {_GATE} AS verdict FROM (SELECT doc_id, length(coalesce(text, '')) AS n, length(regexp_replace(text, {SPARK.quoted('[' + NORMAL + ']')}, '')) AS odd, size(regexp_extract_all(text, {SPARK.quoted(ODD_RUNS)}, 0)) AS runs, length(text) - length(replace(text, chr(10), '')) AS newlines,
    aggregate(filter(transform(split(text, r'[。！？!?\\n]+'), s -> length(regexp_replace(s, r'(?U)^\\s+|\\s+$', ''))), k -> k > 0), named_struct('s', 0L, 'n', 0L), (a, k) -> named_struct('s', a.s + k, 'n', a.n + 1), a -> CAST(a.s AS DOUBLE) / nullif(a.n, 0)) AS sentence FROM page_texts) q""",
    apart=f"""SELECT doc_id, {_GATE} AS verdict FROM (SELECT doc_id, length(coalesce(text, '')) AS n, len(list_filter(string_split(text, ''), lambda c: NOT regexp_matches(c, {DUCK.quoted('^[' + NORMAL + ']$')}))) AS odd, len(regexp_extract_all(text, {DUCK.quoted(ODD_RUNS)})) AS runs, len(string_split(text, chr(10))) - 1 AS newlines,
    list_avg(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?\\n]+'), lambda s: length(regexp_replace(s, '^[\\s\\x{{A0}}\\x{{3000}}]+|[\\s\\x{{A0}}\\x{{3000}}]+$', '', 'g'))), lambda k: k > 0)) AS sentence FROM page_texts) q""")
html_table = operator("txt_html_table_md", "Tables in HTML as pipe tables; a single row that packs whole columns is taken apart.", """
SELECT tbl, array_join(transform(rows, (r, i) -> concat('| ', array_join(r, ' | '), ' |', CASE WHEN i = 0 THEN concat(chr(10), '|', repeat(' --- |', size(r))) ELSE '' END)), chr(10)) AS md FROM (
  SELECT tbl, CASE WHEN size(cells) > 1 AND size(full) = 1 THEN transform(sequence(0, array_max(transform(packed, c -> size(c))) - 1), i -> transform(packed, c -> coalesce(try_element_at(c, i + 1), ''))) ELSE cells END AS rows FROM (
    SELECT tbl, cells, full, transform(element_at(full, 1), c -> filter(split(c, r'\\s+'), x -> x <> '')) AS packed FROM (
      SELECT tbl, cells, filter(cells, r -> exists(r, c -> c <> '')) AS full FROM (
        SELECT tbl, filter(transform(regexp_extract_all(html, r'(?s)<tr>(.*?)</tr>', 1), r -> transform(regexp_extract_all(r, r'(?s)<t[dh]>(.*?)</t[dh]>', 1), c -> trim(regexp_replace(c, r'<[^>]+>', '')))), r -> size(r) > 0) AS cells FROM table_html) a) b WHERE size(full) > 0) c) d""",
    apart="""SELECT o_custkey AS tbl, CASE WHEN o_custkey % 3 = 0 THEN concat(string_agg(concat('| ', o_orderkey, ' | ', o_orderstatus, ' |', CASE WHEN rn = 1 THEN concat(chr(10), '| --- | --- |') ELSE '' END), chr(10) ORDER BY o_orderkey))
  ELSE concat('| order | status |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', o_orderkey, ' | ', o_orderstatus, ' |'), chr(10) ORDER BY o_orderkey)) END AS md
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) o GROUP BY o_custkey""")
cells_md = operator("txt_cells_to_md", "Cells by row and column as a pipe table.", lambda d: f"""
SELECT o_custkey AS tbl, {d.agg_join("concat('| ', CAST(o_orderkey AS STRING), ' | ', o_orderstatus, ' |')", 'chr(10)', 'o_orderkey')} AS md FROM orders GROUP BY o_custkey""")
#: The fields of a timetable's entry are rows of `timetable_fields`; of a field's patterns the first that finds something counts.
schedule_rows = operator("txt_schedule_rows", "A timetable in HTML as rows: day, period and the entry's fields; of one cell's entries the longest.", """
WITH rows AS (SELECT person, regexp_extract(r, r'(?s)<th[^>]*>(.*?)</th>', 1) AS period, regexp_extract_all(r, r'(?s)<td[^>]*>(.*?)</td>', 1) AS cells FROM (SELECT person, explode(regexp_extract_all(html, r'(?s)<tr>(.*?)</tr>', 1)) AS r FROM timetable_html) x WHERE r RLIKE '<th'),
  cells AS (SELECT person, period, col, cell FROM rows LATERAL VIEW posexplode(cells) c AS col, cell),
  entries AS (SELECT person, period, col, no, trim(regexp_replace(div, r'(\\s|<[^>]+>)+', ' ')) AS raw FROM cells LATERAL VIEW posexplode(regexp_extract_all(cell, r'(?s)<div class="[^"]*kbcontent[^"]*">(.*?)</div>', 1)) d AS no, div),
  found AS (SELECT e.person, e.period, e.col, e.no, f.pos, min_by(concat(regexp_extract(e.raw, f.pattern, 1), f.unit), f.trial) AS piece FROM entries e JOIN timetable_fields f ON length(e.raw) >= 5 AND regexp_extract(e.raw, f.pattern, 1) <> '' GROUP BY e.person, e.period, e.col, e.no, f.pos),
  infos AS (SELECT person, period, col, no, array_join(transform(array_sort(collect_list(struct(pos, piece))), p -> p.piece), ' | ') AS info FROM found GROUP BY person, period, col, no)
SELECT person, concat(coalesce(get(array('周一', '周二', '周三', '周四', '周五', '周六', '周日'), col), concat('列', col + 1)), ' ', period) AS place, info FROM (SELECT *, row_number() OVER (PARTITION BY person, period, col ORDER BY length(info) DESC, info) AS rn FROM infos) z WHERE rn = 1""",
    apart="""SELECT person, concat(coalesce(['周一', '周二', '周三', '周四', '周五', '周六', '周日'][day + 1], concat('列', day + 1)), ' 第', slot, '节') AS place, concat(course, ' | 张伟 | ', week, '-16周 | 1-2节 | A', week, '楼') AS info FROM timetable_slots""")
keep_longest = operator("win_keep_longest", "The longest text of each slot.", "SELECT conv_id, role, turn FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS rn FROM conversations) r WHERE rn = 1")
skill_check = operator("udf_skill_check", "Registered skills whose definition is complete: a name, a description, an owner and a list of permissions.", lambda d: f"SELECT tool_id, length(trim(tool_name)) > 0 AND length(trim(description)) > 0 AND length(trim(owner)) > 0 AND {d.size(d.json_list('required'))} > 0 AS complete FROM tool_registry",
    apart="SELECT tool_id, required <> '[]' AND tool_name <> '' AND trim(description) <> '' AND trim(owner) <> '' AS complete FROM tool_registry")
