"""Driver tables in the shapes of the library's own tables (catalog, chunks, logs, memory, access)."""

from __future__ import annotations

from lorekeep.plans.operator import VIEWS

#: Markers of exam papers as data: level, pattern, label (none: what the pattern found); the first that fits holds.
_PART = r"Part\s+I{1,3}V?\b"
MARKERS = [
    (1, _PART + r"(?i:[a-z ]*writing)", "'Part I Writing'"), (1, _PART + r"(?i:[a-z ]*listen)", "'Part II Listening'"), (1, _PART + r"(?i:[a-z ]*read)", "'Part III Reading'"),
    (1, _PART + r"(?i:[a-z ]*translat)", "'Part IV Translation'"), (1, _PART, "NULL"), (2, r"Section\s+[A-C]\b", "NULL"), (3, r"Passage\s+(One|Two|Three)\b", "NULL"),
]

#: The fields of a timetable's entry: course (else the beginning), teacher before weeks, weeks, slot, room.
FIELDS = [(0, 0, r"^([^ 0-9]{3,})", ""), (0, 1, r"^(.{1,30})", ""), (1, 0, r"([一-鿿]{2,4})[0-9]+-[0-9]+", ""), (2, 0, r"[一-鿿]{2,4}([0-9]+-[0-9]+)", "周"), (3, 0, r"\[([0-9]+-[0-9]+节)\]", ""), (4, 0, r"【(.+?)】", "")]

VIEWS.update({
    "kb_docs": """SELECT doc_id, concat('kb/', source, '/', CAST(doc_id AS STRING), '.txt') AS file_path, source AS kb_group,
       CASE WHEN doc_id % 5 = 0 THEN 'public' ELSE 'internal' END AS visibility, md5(text) AS file_hash, lang, text FROM documents""",
    "kb_docs_new": """SELECT doc_id, file_path, kb_group, visibility, CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, 'v2')) ELSE file_hash END AS file_hash
       FROM kb_docs WHERE doc_id % 3 = 0
       UNION ALL SELECT doc_id + 1000000, concat('new/', CAST(doc_id AS STRING), '.txt'), kb_group, visibility, md5(concat(text, 'new')) FROM kb_docs WHERE doc_id % 50 = 1""",
    # chunks and documents of an older base, with fields missing
    "unstamped_chunks": "SELECT chunk_id, file_path, CASE WHEN chunk_id % 3 = 0 THEN NULL ELSE kb_group END AS kb_group, CASE WHEN chunk_id % 4 = 0 THEN NULL ELSE visibility END AS visibility FROM chunk_vectors",
    "old_docs": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE file_path END AS file_path, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE file_hash END AS file_hash, text FROM kb_docs",
    "incoming_paths": "SELECT concat(substring(file_path, 1, length(file_path) - 3), CASE doc_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' WHEN 2 THEN 'exe' WHEN 3 THEN 'md' ELSE 'txt' END) AS file_path FROM kb_docs",
    "raw_paths": "SELECT doc_id, concat('kb', chr(92), source, chr(92), CAST(doc_id AS STRING), '.txt') AS p FROM documents",
    "raw_times": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'not a time' ELSE concat('2024-01-', CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, CAST(event_id % 28 + 1 AS STRING), ' 10:00:00') END AS t FROM events""",
    # texts with Chinese in them, texts with titles, texts to be cut for a question, arguments of calls
    "mixed_texts": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(text, repeat('知识库检索问答系统与文档切片', CAST(floor(length(text) / 20) AS INT))) WHEN 1 THEN concat(text, repeat('中文', CAST(floor(length(text) / 20) AS INT))) ELSE text END AS text FROM documents""",
    "stop_words": "SELECT * FROM (VALUES ('the'), ('of'), ('and'), ('de'), ('的'), ('与')) AS t(word)",
    "titled_texts": "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS h1, CASE WHEN doc_id % 8 <> 0 AND doc_id % 3 <> 0 THEN lang END AS h2, text FROM documents",
    "query_texts": "SELECT d.doc_id, d.text, b.text AS query FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id",
    "call_arguments": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'API_Key' WHEN 1 THEN 'query' WHEN 2 THEN 'userPassword' ELSE 'text' END AS k, text AS v FROM documents",
    # text layers of pages, some of them broken
    "page_texts": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('He said "yes" (twice), [1] ', lang, '; 他说：“可以”，《书》。', source) WHEN 1 THEN concat(text, repeat('\uFFFD', CAST(floor(length(text) / 30) AS INT))) WHEN 2 THEN repeat(concat(lang, chr(10)), 20) WHEN 3 THEN '' ELSE text END AS text FROM documents""",
    # records of a service and what of them is shown
    "weather_records": """SELECT event_id, concat('{"city":"', event_type, '","now":{"temp":', CAST(event_id % 40 AS STRING), CASE event_id % 3 WHEN 0 THEN ',"wind":"N"' WHEN 1 THEN ',"wind":null' ELSE '' END, '}', CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"humidity":"60"' END, '}') AS record FROM events""",
    "record_fields": "SELECT * FROM (VALUES (0, '城市：', 'city', '未知'), (1, '温度：', 'now.temp', '--'), (2, '风向：', 'now.wind', '--'), (3, '湿度：', 'humidity', '--')) AS t(pos, label, path, missing)",
    # paragraphs of a word processor: style, list level; regions of a page
    "paragraphs": """SELECT doc_id, line_no AS para_no, line AS text, CASE WHEN line_no % 12 = 0 THEN 'Heading 1' WHEN line_no % 12 = 5 THEN 'Heading 2' WHEN line_no % 12 = 7 THEN 'Chapter' ELSE 'Normal' END AS style, CASE WHEN line_no % 4 > 0 THEN CAST(line_no % 4 - 1 AS INT) END AS list_level FROM doc_lines""",
    "style_levels": "SELECT * FROM (VALUES ('Heading 1', 1), ('Heading 2', 2), ('Heading 3', 3), ('Chapter', 1)) AS t(style, lv)",
    "regions": """SELECT doc_id, line_no, text, CASE line_no % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'caption' WHEN 3 THEN 'formula' ELSE 'figure' END AS type, CASE WHEN line_no % 11 = 10 THEN NULL ELSE x END AS x1, CASE WHEN line_no % 11 = 10 THEN NULL ELSE y + line_no % 7 END AS y1, h FROM layout_lines""",
    # calls to destinations, timings of stages, failures of a scorer, claims of answers
    "destination_calls": "SELECT event_id AS call_id, user_id % 50 AS dest, ts, event_type IN ('error', 'click') AS failed FROM events",
    "stage_timings": "SELECT event_id, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'cold' ELSE 'hot' END AS variant, value AS ms FROM events",
    "score_failures": "SELECT doc_id FROM documents WHERE doc_id % 10 = 0",
    "claims": "SELECT doc_id % 50 AS qid, doc_id AS claim_id, CASE WHEN (doc_id * 11) % 4 < 3 THEN 1 ELSE 0 END AS supported FROM documents",
    # batches of changes to the access tables
    "membership_changes": "SELECT c_nationkey AS group_id, c_custkey AS user_id, 'add' AS change FROM customer WHERE c_custkey % 8 = 3 UNION ALL SELECT c_nationkey, c_custkey, 'remove' FROM customer WHERE c_custkey % 10 = 1",
    "new_memberships": "SELECT CAST((c_nationkey + 1) % 25 AS INT) AS group_id, c_custkey AS user_id FROM customer WHERE c_custkey % 9 = 0",
    "protected_users": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey < 10",
    "user_changes": """SELECT c_custkey AS user_id, CAST(NULL AS STRING) AS username, 'delete' AS change FROM customer WHERE c_custkey % 15 = 4 UNION ALL SELECT c_custkey, concat(c_name, '-renamed'), 'rename' FROM customer WHERE c_custkey % 20 = 3
       UNION ALL SELECT c_custkey, 'one name for all', 'rename' FROM customer WHERE c_custkey % 20 = 5 UNION ALL SELECT c_custkey + 1000000, CASE WHEN c_custkey % 50 = 7 THEN c_name WHEN c_custkey % 3 = 0 THEN 'twice' ELSE concat('new ', c_name) END, 'insert' FROM customer WHERE c_custkey % 25 = 7""",
    # a later state of the base: texts and permissions edited, documents taken out and put in
    "kb_docs_later": """SELECT doc_id, file_path, CASE WHEN doc_id % 13 = 1 THEN 'moved' ELSE kb_group END AS kb_group, visibility, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' Refreshed it_1') ELSE text END AS text FROM kb_docs WHERE doc_id % 11 <> 3
       UNION ALL SELECT doc_id + 2000000, concat('later/', CAST(doc_id AS STRING), '.txt'), kb_group, visibility, concat('New words. ', text) FROM kb_docs WHERE doc_id % 50 = 1""",
    "kb_store_counts": """SELECT file_path, CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 2 END AS n_chunks FROM kb_docs WHERE doc_id % 13 <> 0
       UNION ALL SELECT concat('orphan/', CAST(doc_id AS STRING), '.txt'), 1 FROM kb_docs WHERE doc_id % 101 = 0""",
    "chunk_vectors": """SELECT d.doc_id AS chunk_id, d.file_path, d.kb_group, d.visibility, d.text AS content, e.embedding, e.label
       FROM kb_docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "query_vectors": "SELECT vec_id AS qid, embedding, concat('src', CAST(vec_id % 20 AS STRING)) AS perm_group FROM embeddings WHERE vec_id % 50 = 0",
    # a tool for each label, with the mean of its vectors
    "tool_vectors": lambda d: f"SELECT label, {d.collect_in_order('x', 'pos')} AS embedding FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM ({d.explode('embeddings', 'label', 'embedding', 'pos', 'x')}) e GROUP BY label, pos) m GROUP BY label",
    "questions": """SELECT item_id AS qid, text AS query, CASE item_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'public_only' ELSE 'groups' END AS perm_mode,
       concat('src', CAST(item_id % 20 AS STRING)) AS perm_group FROM benchmark""",
    "variants": "SELECT item_id AS base, item_id AS vid, 0 AS v FROM benchmark UNION ALL SELECT item_id, (item_id + 1) % 40, 1 FROM benchmark",
    "orders_given": "SELECT item_id AS qid, concat(CAST(item_id % 7 AS STRING), ',0,', CAST(item_id % 5 + 3 AS STRING), ',99') AS o FROM benchmark",
    "results": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS chunk_id, text FROM documents",
    # texts of LaTeX, some of them with brackets that don't match
    "latex_texts": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '$x^{2}$' WHEN 1 THEN '$x^{2' WHEN 2 THEN '}{' WHEN 3 THEN concat('[', lang, '(', source, ')]{}') WHEN 4 THEN concat('(', lang, '[', source, ')]') ELSE text END AS t FROM documents""",
    # tables as HTML, made of a customer's orders: row by row, or packed into one row of columns
    "table_html": lambda d: f"""SELECT o_custkey AS tbl, CASE WHEN o_custkey % 3 = 0
        THEN concat('<table><tr><td>', {d.agg_join("CAST(o_orderkey AS STRING)", "' '", 'o_orderkey')}, '</td><td><b>', {d.agg_join('o_orderstatus', "' '", 'o_orderkey')}, '</b></td></tr><tr><td></td><td> </td></tr></table>')
        ELSE concat('<table><tr><th>order</th><th>status</th></tr>', {d.agg_join("concat('<tr><td>', CAST(o_orderkey AS STRING), '</td><td><i>', o_orderstatus, '</i> </td></tr>')", "''", 'o_orderkey')}, '</table>') END AS html FROM orders GROUP BY o_custkey""",
    # timetables as HTML: a row for each order, in the column of a weekday, a short form beside the long one
    "timetable_slots": """SELECT o_custkey AS person, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slot, CAST(o_orderkey % 9 AS INT) AS day, concat('课程名', o_orderstatus) AS course, CAST(o_orderkey % 9 + 1 AS STRING) AS week FROM orders""",
    # the fields of an entry: order, order of trial, pattern, what follows the value
    "timetable_fields": lambda d: "SELECT * FROM (VALUES " + ", ".join(f"({pos}, {trial}, {d.quoted(p)}, '{unit}')" for pos, trial, p, unit in FIELDS) + ") AS t(pos, trial, pattern, unit)",
    "timetable_html": lambda d: f"""SELECT person, concat('<table id="timetable"><tr><td>x</td></tr>', {d.agg_join("concat('<tr><th>第', CAST(slot AS STRING), '节</th>', repeat('<td>&nbsp;</td>', day), '<td><div class=\"kbcontent1\">', course, ' 张伟</div><div class=\"kbcontent\">', course, '<br/>张伟', week, '-16周<br/>[1-2节]<br/>【A', week, '楼】</div></td></tr>')", "''", 'slot')}, '</table>') AS html FROM timetable_slots GROUP BY person""",
    # answers with source lists, notes and a disclaimer around a document's text
    "answers": """SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN concat(text, ' (来源：a.pdf，第3页)', chr(10), '> 📚 参考来源：', chr(10), '> - b.pdf', chr(10), '- c.pdf', chr(10), 'end')
       WHEN 1 THEN concat('begin', chr(10), '> ⚠️ 由大模型直接生成。', chr(10), chr(10), chr(10), text) WHEN 2 THEN '（来源：x）' ELSE text END AS answer FROM documents""",
    # exam papers: some lines are markers of parts, sections and passages
    "exam_lines": """SELECT doc_id, line_no, CASE WHEN line_no % 15 = 0 THEN concat('Part ', CASE line_no % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' ELSE 'IIIV' END, CASE line_no % 5 WHEN 0 THEN ' Writing' WHEN 1 THEN ' Listening' WHEN 2 THEN ' Reading' WHEN 3 THEN ' Translation' ELSE ' Other' END)
       WHEN line_no % 6 = 1 THEN concat('Section ', CASE line_no % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END) WHEN line_no % 6 = 4 THEN concat('Passage ', CASE line_no % 2 WHEN 0 THEN 'One' ELSE 'Two' END) ELSE line END AS line FROM doc_lines""",
    # markers as data: level, order of trial, pattern, and the label (none: what the pattern found)
    "marker_rules": lambda d: "SELECT * FROM (VALUES " + ", ".join(f"({k}, {i}, {d.raw(p)}, {label})" for i, (k, p, label) in enumerate(MARKERS)) + ") AS t(kind, trial, pattern, label)",
    # attempts of calls: up to three in a row belong to one call
    "attempts": "SELECT CAST(floor(event_id / 3) AS BIGINT) AS call_id, event_id % 3 AS attempt, user_id, event_type AS tool, value, event_type <> 'error' AS success FROM events",
    # a registry of tools, one for each part
    "tool_registry": """SELECT p_partkey AS tool_id, concat('tool_', CAST(p_partkey AS STRING)) AS tool_name, p_name AS description, p_brand AS owner,
       CASE p_size % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["*"]' WHEN 2 THEN '["upload"]' ELSE '["search_group","view_audit"]' END AS required FROM part""",
    "templates": "SELECT doc_id, source, lang, CASE doc_id % 3 WHEN 0 THEN 'search {source} in {lang} for {what}' WHEN 1 THEN '{lang}{lang} {' ELSE text END AS template FROM documents",
    # replies of a model: fenced and bare JSON, nested and escaped, broken, skills, thoughts, memories
    "replies": """SELECT doc_id, CASE doc_id % 14
       WHEN 0 THEN concat('Sure {x}.', chr(10), '```json', chr(10), '{"action":"call_tools","execution_mode":"parallel","tools":[{"tool_name":"', source, '","arguments":{"q":"a } b","deep":{"n":[1,{"k":2}]}},"reason":"r"},{"no_name":1}]}', chr(10), '``` done }')
       WHEN 1 THEN concat('text {"action":"direct_answer","response":"say ', chr(92), '"', lang, chr(92), '" {ok}"} tail') WHEN 2 THEN 'no json here' WHEN 3 THEN concat('SKILL: ', source, chr(10), 'CONFIDENCE: 0.9', chr(10), 'ARGS: {"city": "', lang, '"}')
       WHEN 4 THEN 'SKILL: none' WHEN 5 THEN concat('Thought: look it up', chr(10), 'Action: ', source) WHEN 6 THEN concat('{"action":"call_tools","execution_mode":"odd","tools":[{"tool_name":"a"},{"tool_name":"', lang, '","arguments":{"x":[]}}]}')
       WHEN 7 THEN concat('{"action":"answer","response":"', source, '"}') WHEN 8 THEN '{"action":"direct_answer"} and more }' WHEN 9 THEN '' WHEN 10 THEN '{"action":"call_tools","tools":"none"}'
       WHEN 11 THEN concat('Here: [{"content":"', source, '","mem_type":"profile","about":{"tags":["x]","y"]}},{"mem_type":"entity"},{"content":"', lang, '","confidence":0.5},7] done') WHEN 12 THEN concat('[{"content":"', source, '"}') ELSE text END AS raw FROM documents""",
    # calls of tools with arguments as JSON, and the slots of each tool
    "calls": """SELECT event_id AS call_id, event_type AS tool, concat('{"user_id":', CASE event_id % 13 WHEN 0 THEN '"x"' WHEN 1 THEN 'null' WHEN 2 THEN '1.5' ELSE CAST(user_id AS STRING) END, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ',"kind":"other"' WHEN 2 THEN ',"kind":5' ELSE ',"kind":"a"' END,
       CASE event_id % 5 WHEN 0 THEN ',"note":""' WHEN 1 THEN ',"note":[1]' WHEN 2 THEN ',"more":{"k":1},"extra":2' ELSE '' END, '}') AS args FROM events""",
    "slots": """SELECT * FROM (VALUES ('click', 'user_id', 0, 'number', true, CAST(NULL AS STRING)), ('click', 'kind', 1, 'string', true, '["a","b"]'), ('click', 'note', 2, 'string', false, CAST(NULL AS STRING)),
       ('view', 'kind', 0, 'string', false, '["a","other"]'), ('view', 'user_id', 1, 'number', true, CAST(NULL AS STRING)), ('purchase', 'note', 0, 'string', true, CAST(NULL AS STRING)), ('purchase', 'kind', 1, 'any', false, '["a",5]')) AS t(tool, slot, pos, type, required, allowed)""",
    "doc_lines": lambda d: d.explode("documents", "doc_id", d.split("text", "chr(10)"), "line_no", "line"),
    "md_lines": """SELECT doc_id, line_no, CASE WHEN line_no % 12 = 1 THEN concat('# ', line) WHEN line_no % 6 = 3 THEN concat('## ', line)
       WHEN line_no % 5 = 4 THEN concat('### ', line) ELSE line END AS line FROM doc_lines""",
    # pages of 40 lines: two columns, one, three in turn; sizes that merge and sizes that don't; formulas
    "layout_lines": """SELECT doc_id, page, line_no, CASE WHEN line_no % 23 = 5 THEN '∑ x = y + 1' WHEN line_no % 29 = 3 THEN ' ' ELSE line END AS text,
       CAST(40 + CASE page % 3 WHEN 0 THEN (line_no % 2) * 300 WHEN 1 THEN (line_no % 4) * 5 ELSE (line_no % 3) * 190 END AS DOUBLE) AS x,
       CAST((line_no % 40) * 20 AS DOUBLE) AS y, CAST(CASE page % 3 WHEN 0 THEN 200 WHEN 1 THEN 500 ELSE 150 END AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h,
       CAST(CASE WHEN line_no % 40 = 0 THEN 20 WHEN line_no % 40 = 20 THEN 19.5 WHEN line_no % 40 = 30 THEN 18.9 WHEN line_no % 10 = 0 THEN 16 ELSE 12 END AS DOUBLE) AS size,
       line_no % 20 = 0 AS is_bold, line_no % 9 >= 7 AS is_monospace FROM (SELECT doc_id, line_no, line, CAST(floor(line_no / 40) AS INT) AS page FROM doc_lines) l""",
    "page_sizes": "SELECT doc_id, page, CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height FROM layout_lines GROUP BY doc_id, page",
    "tool_audit": """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('t', CAST(user_id AS STRING), '-', CAST(event_id % 7 AS STRING)) END AS trace_id,
       CASE WHEN event_id % 9 = 0 THEN 'decision' END AS type, CASE WHEN event_id % 9 <> 0 THEN event_type END AS tool_name,
       CASE WHEN event_id % 9 <> 0 AND event_id % 31 <> 0 THEN value END AS latency_ms, CASE WHEN event_id % 9 <> 0 THEN event_type <> 'error' END AS success,
       CASE WHEN event_id % 9 <> 0 THEN greatest(event_id % 5 - 2, 0) END AS retry_count FROM events""",
    "token_log": """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('s', CAST(user_id % 20 AS STRING)) AS session_id,
       CASE event_id % 4 WHEN 0 THEN 'deepseek-chat' WHEN 1 THEN 'deepseek-v4-flash' WHEN 2 THEN 'deepseek-reasoner' ELSE 'unlisted' END AS model,
       event_type AS call_site, CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value * 3) AS BIGINT) AS completion_tokens FROM events""",
    "qa_log": """SELECT conv_id, turn, text AS user_input, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'chat' ELSE 'knowledge' END AS intent,
       (conv_id * 7 + turn) % 9 AS retrieved_docs_count, CAST((conv_id * 131 + turn * 17) % 3000 AS DOUBLE) AS latency_ms,
       length(text) AS prompt_tokens, length(text) % 97 AS completion_tokens FROM conversations WHERE role = 'user'""",
    "memory": """SELECT vec_id AS mem_id, concat('u', CAST(vec_id % 10 AS STRING)) AS user_id, CASE vec_id % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'entity' ELSE 'conclusion' END AS mem_type,
       concat('fact ', CAST(vec_id AS STRING)) AS content, CAST(5 + vec_id % 6 AS DOUBLE) / 10 AS confidence, vec_id % 400 AS age_days, embedding FROM memory_vectors""",
    # a user's vectors lie 1.2 and more apart in the driver tables: brought nearer, some memories are near-duplicates
    "memory_vectors": lambda d: f"SELECT vec_id, {d.transform('embedding', 'x', 'CAST(x AS DOUBLE) / 8')} AS embedding FROM embeddings",
    "memory_queries": "SELECT vec_id AS qid, concat('u', CAST(CAST(floor(vec_id / 50) AS BIGINT) % 10 AS STRING)) AS user_id, embedding FROM memory_vectors WHERE vec_id % 50 = 0",
    "reflection": """SELECT conv_id, turn, concat('u', CAST(conv_id % 10 AS STRING)) AS user_id, text AS query,
       CASE (conv_id + turn) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'ask' ELSE 'weather' END AS selected_tool, (conv_id + turn) % 5 <> 0 AS success
       FROM conversations WHERE role = 'user'""",
    "skills": """SELECT * FROM (VALUES ('search', 'find the text in the documents and show where it is', 0.1E0), ('compare', 'compare this with that and say what differs', 0.2E0), ('weather', 'weather of the day for a place', 0.2E0)) AS t(skill, description, least)""",
    "skill_words": """SELECT * FROM (VALUES ('search', 'trigger', 'The'), ('search', 'trigger', 'tha'), ('search', 'exclude', 'zzzz'), ('compare', 'trigger', 'and'), ('compare', 'trigger', 'with'), ('compare', 'exclude', 'ering'),
       ('compare', 'exclude', 'whon'), ('weather', 'trigger', 'of'), ('weather', 'trigger', 'on'), ('weather', 'trigger', 'day'), ('weather', 'exclude', 'for')) AS t(skill, kind, word)""",
    "eval_scores": """SELECT doc_id AS qid, lang AS category, 'baseline' AS config, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 37) % 101 AS DOUBLE) / 100 END AS context_recall,
       CAST((doc_id * 53) % 101 AS DOUBLE) / 100 AS context_precision, CAST((doc_id * 71) % 101 AS DOUBLE) / 100 AS faithfulness, CAST((doc_id * 89) % 101 AS DOUBLE) / 100 AS answer_relevancy FROM documents
       UNION ALL SELECT doc_id, lang, 'optimized', CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(50 + (doc_id * 37) % 51 AS DOUBLE) / 100 END,
       CAST(40 + (doc_id * 53) % 61 AS DOUBLE) / 100, CAST(60 + (doc_id * 71) % 41 AS DOUBLE) / 100, CAST(30 + (doc_id * 89) % 71 AS DOUBLE) / 100 FROM documents""",
    "eval_long": """SELECT qid, category, config, 'context_recall' AS metric, context_recall AS score FROM eval_scores UNION ALL
       SELECT qid, category, config, 'context_precision', context_precision FROM eval_scores UNION ALL
       SELECT qid, category, config, 'faithfulness', faithfulness FROM eval_scores UNION ALL
       SELECT qid, category, config, 'answer_relevancy', answer_relevancy FROM eval_scores""",
    "verdicts": """SELECT doc_id % 50 AS qid, doc_id AS ctx_id, CAST(floor(doc_id / 50) AS BIGINT) + 1 AS ctx_rank, CASE WHEN (doc_id * 7) % 3 = 0 THEN 1 ELSE 0 END AS relevant FROM documents""",
    "users": "SELECT c_custkey AS user_id, c_name AS username, c_custkey % 10 <> 9 AS is_active FROM customer",
    "user_roles": "SELECT c_custkey AS user_id, c_mktsegment AS role_name FROM customer WHERE c_custkey % 6 <> 5",
    "kb_group_members": "SELECT c_nationkey AS group_id, c_custkey AS user_id FROM customer WHERE c_custkey % 4 <> 3",
    "kb_groups": "SELECT n_nationkey AS group_id, concat('src', CAST(n_nationkey AS STRING)) AS name FROM nation",
    "roles": """SELECT * FROM (VALUES ('AUTOMOBILE', '["upload","delete_doc","search_all","manage_users"]'), ('BUILDING', '["upload","search_group"]'),
       ('FURNITURE', '["search_group"]'), ('HOUSEHOLD', '["search_group","view_audit"]'), ('MACHINERY', '[]')) AS t(role_name, permissions)""",
})
