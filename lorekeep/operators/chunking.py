"""Markdown structure and chunks: headers, sections, windows, markers, ids, stamps."""

from __future__ import annotations

from lorekeep.plans.operator import operator

#: Chunk size and overlap, least chunk, share of the size under which sections merge, default title.
SIZE, OVERLAP, LEAST, PREFACE = 500, 50, 10, "文档前言"

_BY = "PARTITION BY doc_id ORDER BY line_no"


def sections(d) -> str:
    """CTE sec: one row per section (doc_id, sid, h1, h2, h3, content). A header resets the levels below it."""
    return f"""hl AS (SELECT doc_id, line_no, line, CASE WHEN {d.rlike('line', '^### ')} THEN 3 WHEN {d.rlike('line', '^## ')} THEN 2 WHEN {d.rlike('line', '^# ')} THEN 1 ELSE 0 END AS lv FROM md_lines),
  ids AS (SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER ({_BY}) AS sid, sum(CASE WHEN lv = 1 THEN 1 ELSE 0 END) OVER ({_BY}) AS n1, sum(CASE WHEN lv IN (1, 2) THEN 1 ELSE 0 END) OVER ({_BY}) AS n2 FROM hl),
  heads AS (SELECT doc_id, line_no, line, lv, sid, max(CASE WHEN lv = 1 THEN substring(line, 3) END) OVER (PARTITION BY doc_id, n1) AS h1,
    max(CASE WHEN lv = 2 THEN substring(line, 4) END) OVER (PARTITION BY doc_id, n2) AS h2, max(CASE WHEN lv = 3 THEN substring(line, 5) END) OVER (PARTITION BY doc_id, sid) AS h3 FROM ids),
  sec AS (SELECT doc_id, CAST(sid AS BIGINT) AS sid, max(h1) AS h1, max(CASE WHEN lv = 1 THEN NULL ELSE h2 END) AS h2, max(h3) AS h3, {d.agg_join("CASE WHEN lv = 0 THEN line END", 'chr(10)', 'line_no')} AS content FROM heads GROUP BY doc_id, sid)"""


_FILLED = lambda d: f"""{sections(d)}, filled AS (SELECT doc_id, sid, content, h3, coalesce(h1, {d.last('h1', 'PARTITION BY doc_id ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}, '{PREFACE}') AS h1, h2 FROM sec)"""
_PATH = "CASE WHEN h1 IS NULL AND h2 IS NULL AND h3 IS NULL THEN '' ELSE concat('【章节：', concat_ws(' > ', h1, h2, h3), '】') END"

header_split = operator("chk_header_split", "Sections at levels 1 to 3, each with its headers; header lines go.", lambda d: f"WITH {sections(d)} SELECT doc_id, sid, h1, h2, h3, coalesce(content, '') AS content FROM sec")
orphan_header = operator("chk_orphan_header", "Sections before any header get the preface title.", lambda d: f"WITH {sections(d)} SELECT doc_id, sid, CASE WHEN h1 IS NULL AND h2 IS NULL AND h3 IS NULL THEN '{PREFACE}' ELSE h1 END AS h1 FROM sec")
header_fill = operator("chk_header_fill", "Gaps in the header path filled from above; a new first level resets the second.", lambda d: f"WITH {_FILLED(d)} SELECT doc_id, sid, h1, h2, h3 FROM filled")
header_path = operator("chk_header_path", "Path text in front of the content.", lambda d: f"WITH {_FILLED(d)} SELECT doc_id, sid, concat({_PATH}, coalesce(content, '')) AS chunk FROM filled")
merge_tiny = operator("chk_merge_tiny", "Runs of neighbouring sections with one path, all short, become one section.", lambda d: f"""
WITH {_FILLED(d)}, small AS (SELECT *, concat_ws('|', h1, h2, h3) AS p, length(coalesce(content, '')) < {SIZE // 3} AS tiny FROM filled),
  steps AS (SELECT *, CASE WHEN tiny AND lag(tiny) OVER (PARTITION BY doc_id ORDER BY sid) AND lag(p) OVER (PARTITION BY doc_id ORDER BY sid) = p THEN 0 ELSE 1 END AS step FROM small),
  runs AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY sid) AS run FROM steps)
SELECT doc_id, min(sid) AS sid, count(*) AS merged, max(h1) AS h1, max(h2) AS h2, {d.agg_join("coalesce(content, '')", 'chr(10)', 'sid')} AS content FROM runs GROUP BY doc_id, run""")
#: The step count belongs to the result's rows, so each window is a row of its own: cost follows the text.
_WINDOWS = lambda d: d.explode("documents", "doc_id, text", d.seq("0", f"CAST(floor((greatest(length(text), 1) - 1) / {SIZE - OVERLAP}) AS INT)"), "pos", "k")
fixed_window = operator("chk_fixed_window", "Windows of 500 characters that overlap by 50.", lambda d: f"SELECT doc_id, k * {SIZE - OVERLAP} AS start_index, substring(text, CAST(k * {SIZE - OVERLAP} + 1 AS INT), {SIZE}) AS chunk FROM ({_WINDOWS(d)}) w")
min_len = operator("chk_min_len", "Short sections are one chunk; chunks of fewer than 10 characters go.", lambda d: f"WITH {sections(d)} SELECT doc_id, sid, length(trim(content)) AS n FROM sec WHERE length(trim(content)) >= {LEAST}")
stable_id = operator("chk_stable_id", "Ids from the file's hash and the chunk's number.", lambda d: f"""
SELECT concat(file_hash, '_', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS STRING), 4, '0')) AS chunk_id, doc_id FROM ({d.explode('kb_docs', 'doc_id, file_hash', d.seq('0', 'CAST(floor(length(text) / 500) AS INT)'), 'pos', 'k')}) w""")
stamp = operator("chk_stamp", "Path, hash, group and visibility on each chunk.", "SELECT chunk_id, file_path, md5(content) AS file_hash, coalesce(kb_group, 'default') AS kb_group, coalesce(visibility, 'internal') AS visibility FROM chunk_vectors")
metadata = operator("chk_metadata", "Metadata passes through; the chunk's number counts up in its document.", lambda d: f"WITH {sections(d)} SELECT doc_id, sid, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS chunk_index, coalesce(h1, '') AS h1, length(coalesce(content, '')) AS n FROM sec")

#: Markers are data: the first rule of a level that a line fits gives its label. The rules are a few rows, so the join is a broadcast.
_MARKERS = lambda d: f"""SELECT doc_id, line_no, kind, coalesce(label, {d.found('line', 'pattern')}) AS label FROM (SELECT e.doc_id, e.line_no, e.line, r.kind, r.label, r.pattern, row_number() OVER (PARTITION BY e.doc_id, e.line_no ORDER BY r.kind, r.trial) AS rn
  FROM exam_lines e JOIN marker_rules r ON {d.fits('e.line', 'r.pattern')}) m WHERE rn = 1"""  # noqa: E731
struct_markers = operator("chk_struct_markers", "Part, section and passage markers with their places.", lambda d: f"SELECT doc_id, line_no, kind, label FROM ({_MARKERS(d)}) m")
asof_struct = operator("join_asof_struct", "The latest marker of each kind at or before a place, joined to a path.", lambda d: f"""
SELECT doc_id, line_no, concat_ws(' > ', p, s, q) AS path FROM (SELECT doc_id, line_no, {', '.join(d.last(f"CASE WHEN kind = {k} THEN label END", 'PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW') + f' AS {c}' for k, c in ((1, 'p'), (2, 's'), (3, 'q')))}
  FROM (SELECT e.doc_id, e.line_no, m.kind, m.label FROM exam_lines e LEFT JOIN ({_MARKERS(d)}) m ON e.doc_id = m.doc_id AND e.line_no = m.line_no) l) x""")
route_by_ext = operator("src_route_by_ext", "Loader by extension; others are rejected.", lambda d: f"""
SELECT file_path, CASE WHEN {d.rlike('lower(file_path)', '[.](txt|md)$')} THEN 'text' WHEN {d.rlike('lower(file_path)', '[.]pdf$')} THEN 'pdf' WHEN {d.rlike('lower(file_path)', '[.]docx$')} THEN 'docx' ELSE 'rejected' END AS route
FROM incoming_paths f""")
