"""Replies of a model as tables: JSON in prose, calls of tools, memories; calls checked against slots.

A reply's JSON is what a ```json fence holds, else what stands from the first opening to the last
closing mark. Whether that is one value is told by a fold over its marks (escapes, quotes, brackets) that
carries depth and whether a string is open: brackets in strings don't count, and the value must close
with the last mark and not before. Only then it is parsed.

Defined results: null and empty replies are direct answers with a fixed text; replies whose JSON is
broken, or names no known action, are direct answers with the reply itself; tools without a name and memories
without content drop out; a memory is an `entity` with confidence 0.8 where it doesn't say."""

from __future__ import annotations

from lorekeep.plans.operator import operator

#: Fixed value: the answer to an empty reply.
NOTHING = "（LLM 未返回内容）"


def closed(j: str) -> str:
    """Whether a text is one JSON object or array whose brackets close with its last mark."""
    return f"""(substring({j}, 1, 1) IN ('{{', '[') AND right({j}, 1) IN ('}}', ']') AND aggregate(regexp_extract_all({j}, r'(?s)\\\\.|["{{}}\\[\\]]', 0), named_struct('due', '', 'quoted', false, 'fault', false),
    (s, c) -> CASE WHEN s.quoted THEN named_struct('due', s.due, 'quoted', c <> '"', 'fault', s.fault) WHEN c = '"' THEN named_struct('due', s.due, 'quoted', true, 'fault', s.fault OR s.due = '')
      WHEN c IN ('{{', '[') THEN named_struct('due', concat(translate(c, '{{[', '}}]'), s.due), 'quoted', false, 'fault', s.fault OR s.due = '!')
      WHEN left(s.due, 1) = c THEN named_struct('due', CASE WHEN length(s.due) = 1 THEN '!' ELSE substring(s.due, 2) END, 'quoted', false, 'fault', s.fault OR s.due = '!') ELSE named_struct('due', s.due, 'quoted', false, 'fault', true) END,
    s -> s.due = '!' AND NOT s.quoted AND NOT s.fault))"""


_OBJECT = """SELECT doc_id, raw, CASE WHEN raw RLIKE r'(?s)```json\\s*(.*?)\\s*```' THEN trim(regexp_extract(raw, r'(?s)```json\\s*(.*?)\\s*```', 1)) ELSE regexp_extract(raw, r'(?s)[{].*[}]', 0) END AS j FROM replies"""
_DECISIONS = f"""SELECT doc_id, raw, ok, CASE WHEN ok THEN from_json(j, 'action STRING, response STRING, execution_mode STRING, tools ARRAY<STRING>') END AS d FROM (SELECT doc_id, raw, j, coalesce(left(j, 1) = '{{' AND {closed('j')} AND try_parse_json(j) IS NOT NULL, false) AS ok FROM ({_OBJECT}) o) p"""
_KNOWN = """SELECT doc_id, raw, d, CASE WHEN d.action = 'call_tools' THEN 'call_tools' ELSE 'direct_answer' END AS action, coalesce(d.action, '') IN ('call_tools', 'direct_answer') AS known,
  filter(coalesce(d.tools, CAST(array() AS ARRAY<STRING>)), t -> get_json_object(t, '$.tool_name') IS NOT NULL) AS tools FROM ({decisions}) x""".replace("{decisions}", _DECISIONS)

_DUCK = """found AS MATERIALIZED (SELECT doc_id, raw, CASE WHEN regexp_matches(raw, '```json', 's') AND regexp_matches(raw, '```json\\s*.*?\\s*```', 's') THEN trim(regexp_extract(raw, '```json\\s*(.*?)\\s*```', 1, 's'), E' \\n\\t\\r') ELSE nullif(regexp_extract(raw, '\\{.*\\}', 0, 's'), '') END AS j FROM replies),
  valid AS MATERIALIZED (SELECT doc_id, raw, CASE WHEN coalesce(json_valid(j), false) AND left(j, 1) = '{' THEN j::JSON END AS j FROM found),
  known AS MATERIALIZED (SELECT doc_id, raw, j, json_extract_string(j, '$.action') AS action FROM valid),
  tools AS MATERIALIZED (SELECT doc_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS t FROM (SELECT doc_id, list_filter(CASE WHEN json_type(j, '$.tools') = 'ARRAY' THEN CAST(json_extract(j, '$.tools') AS JSON[]) ELSE [] END, lambda t: json_extract_string(t, '$.tool_name') IS NOT NULL) AS ts FROM known WHERE action = 'call_tools') x)"""

parse_decision = operator("fn_parse_decision", "A reply as a decision: fenced JSON first, else from the first to the last brace; broken ones answer with the reply.", f"""
SELECT doc_id, action, CASE WHEN action = 'call_tools' THEN NULL WHEN coalesce(raw, '') = '' THEN '{NOTHING}' WHEN known THEN coalesce(d.response, trim(raw)) ELSE trim(raw) END AS response,
  CASE WHEN action = 'call_tools' AND d.execution_mode = 'parallel' THEN 'parallel' ELSE 'serial' END AS mode, CASE WHEN action = 'call_tools' THEN array_join(transform(tools, t -> get_json_object(t, '$.tool_name')), ',') ELSE '' END AS tools FROM ({_KNOWN}) k""",
    apart=f"""WITH {_DUCK}
SELECT k.doc_id, CASE WHEN action = 'call_tools' THEN 'call_tools' ELSE 'direct_answer' END AS action, CASE WHEN action = 'call_tools' THEN NULL WHEN coalesce(raw, '') = '' THEN '{NOTHING}' WHEN action = 'direct_answer' THEN coalesce(json_extract_string(j, '$.response'), trim(raw)) ELSE trim(raw) END AS response,
  CASE WHEN action = 'call_tools' AND json_extract_string(j, '$.execution_mode') = 'parallel' THEN 'parallel' ELSE 'serial' END AS mode, coalesce((SELECT string_agg(json_extract_string(t, '$.tool_name'), ',' ORDER BY pos) FROM tools x WHERE x.doc_id = k.doc_id), '') AS tools FROM known k""")
decision_tools = operator("fn_decision_tools", "The tool calls of all replies, one row each, with nested arguments as JSON.", f"""
SELECT doc_id, pos, get_json_object(t, '$.tool_name') AS tool, coalesce(get_json_object(t, '$.arguments'), '{{}}') AS arguments, coalesce(get_json_object(t, '$.reason'), '') AS reason
FROM (SELECT doc_id, posexplode(tools) AS (pos, t) FROM ({_KNOWN}) k WHERE action = 'call_tools') x""",
    apart=f"WITH {_DUCK} SELECT doc_id, pos::INTEGER AS pos, json_extract_string(t, '$.tool_name') AS tool, coalesce(CAST(json_extract(t, '$.arguments') AS VARCHAR), '{{}}') AS arguments, coalesce(json_extract_string(t, '$.reason'), '') AS reason FROM tools")

parse_memory = operator("fn_parse_memory", "Items of a JSON array in prose, nested values and all; those without content go.", f"""
SELECT doc_id, pos, get_json_object(item, '$.content') AS content, coalesce(get_json_object(item, '$.mem_type'), 'entity') AS mem_type, CAST(coalesce(get_json_object(item, '$.confidence'), '0.8') AS DOUBLE) AS confidence
FROM (SELECT doc_id, posexplode(from_json(j, 'array<string>')) AS (pos, item) FROM (SELECT doc_id, regexp_extract(raw, r'(?s)\\[.*\\]', 0) AS j FROM replies) a WHERE {closed('j')} AND try_parse_json(j) IS NOT NULL) b WHERE left(item, 1) = '{{' AND coalesce(get_json_object(item, '$.content'), '') <> ''""",
    apart="""WITH lists AS MATERIALIZED (SELECT doc_id, nullif(regexp_extract(raw, '\\[.*\\]', 0, 's'), '') AS j FROM replies),
  items AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS item FROM (SELECT doc_id, CAST(CASE WHEN json_valid(j) THEN j ELSE '[]' END AS JSON[]) AS l FROM lists WHERE j IS NOT NULL) x)
SELECT doc_id, pos::INTEGER AS pos, json_extract_string(item, '$.content') AS content, coalesce(json_extract_string(item, '$.mem_type'), 'entity') AS mem_type, CAST(coalesce(json_extract_string(item, '$.confidence'), '0.8') AS DOUBLE) AS confidence
FROM items WHERE json_type(item) = 'OBJECT' AND coalesce(json_extract_string(item, '$.content'), '') <> ''""")
parse_skill = operator("fn_parse_skill", "Skill name, confidence (0.7 where none is given) and arguments of a reply.", lambda d: f"SELECT doc_id, CASE WHEN {d.rext('raw', 'SKILL: (\\w+)', 1)} IN ('', 'none') THEN NULL ELSE {d.rext('raw', 'SKILL: (\\w+)', 1)} END AS skill, coalesce(CAST(nullif({d.rext('raw', 'CONFIDENCE: ([0-9.]+)', 1)}, '') AS DOUBLE), 0.7E0) AS confidence, nullif({d.rext('raw', 'ARGS: ([{].*[}])', 1)}, '') AS args FROM replies WHERE raw IS NOT NULL")
parse_react = operator("fn_parse_react", "Thought and action, or a final answer.", lambda d: f"SELECT doc_id, CASE WHEN {d.rlike('raw', 'Action: ')} THEN 'act' WHEN {d.rlike('raw', 'Thought: ')} THEN 'think' ELSE 'answer' END AS kind, {d.rext('raw', 'Action: (\\w+)', 1)} AS action FROM replies WHERE raw IS NOT NULL")

#: A call's value is missing (or null, or empty text), of a wrong type, or none of those allowed; the first slot by position counts.
validate_args = operator("fn_validate_args", "Calls against the slots of their tools, as data: the first violation by position, and arguments that no slot names.", """
WITH given AS (SELECT c.call_id, v.key, to_json(v.value) AS j, schema_of_variant(v.value) AS t FROM (SELECT call_id, try_parse_json(args) AS a FROM calls) c, LATERAL variant_explode(c.a) v),
  tried AS (SELECT c.call_id, s.pos, s.slot, CASE WHEN g.j IS NULL OR g.j IN ('null', '""') THEN CASE WHEN s.required THEN concat('missing ', s.slot) END
      WHEN s.type = 'string' AND g.t <> 'STRING' THEN concat(s.slot, ' is no string') WHEN s.type = 'number' AND NOT (g.t IN ('BIGINT', 'DOUBLE', 'BOOLEAN') OR g.t LIKE 'DECIMAL%') THEN concat(s.slot, ' is no number')
      WHEN s.allowed IS NOT NULL AND NOT array_contains(transform(variant_get(parse_json(s.allowed), '$', 'array<variant>'), x -> to_json(x)), g.j) THEN concat(s.slot, ' is not allowed') END AS fault
    FROM calls c JOIN slots s ON c.tool = s.tool LEFT JOIN given g ON g.call_id = c.call_id AND g.key = s.slot),
  first AS (SELECT call_id, min_by(fault, pos) AS fault FROM tried WHERE fault IS NOT NULL GROUP BY call_id),
  odd AS (SELECT g.call_id, count(*) AS n FROM given g JOIN calls c ON g.call_id = c.call_id LEFT ANTI JOIN slots s ON c.tool = s.tool AND g.key = s.slot GROUP BY g.call_id)
SELECT c.call_id, coalesce(f.fault, 'ok') AS verdict, coalesce(o.n, 0) AS unknown FROM calls c LEFT JOIN first f ON c.call_id = f.call_id LEFT JOIN odd o ON c.call_id = o.call_id""",
    apart="""WITH tried AS (SELECT c.call_id, s.pos, s.slot, s.type, s.required, s.allowed, json_extract(c.args, concat('$."', s.slot, '"')) AS v FROM calls c JOIN slots s ON c.tool = s.tool),
  faults AS (SELECT call_id, pos, CASE WHEN v IS NULL OR json_type(v) = 'NULL' OR v::VARCHAR = '""' THEN CASE WHEN required THEN 'missing ' || slot END WHEN type = 'string' AND json_type(v) <> 'VARCHAR' THEN slot || ' is no string'
      WHEN type = 'number' AND json_type(v) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN slot || ' is no number' WHEN allowed IS NOT NULL AND NOT list_contains(CAST(CAST(allowed AS JSON) AS JSON[]), v) THEN slot || ' is not allowed' END AS fault FROM tried),
  keys AS (SELECT call_id, unnest(json_keys(args)) AS key FROM calls)
SELECT c.call_id, coalesce((SELECT arg_min(fault, pos) FROM faults f WHERE f.call_id = c.call_id AND fault IS NOT NULL), 'ok') AS verdict,
  (SELECT count(*) FROM keys k WHERE k.call_id = c.call_id AND NOT EXISTS (SELECT 1 FROM slots s WHERE s.tool = c.tool AND s.slot = k.key)) AS unknown FROM calls c""")
