"""Layout rows and regions: lines, headers and footers, styles, lists. Pages as a whole are in `pages`."""

from __future__ import annotations

from lorekeep.plans.operator import operator

#: Band for headers and footers, repeats that make one, chars per page of a scan.
BAND, REPEATS, SCAN = 0.05, 3, 50

_CLEANED = lambda d: f"SELECT doc_id, page, line_no, y, text, trim({d.rrep('text', '(第\\s*[0-9]+\\s*页|[0-9]+)', '')}) AS cleaned, y < 800 * {BAND} OR y > 800 * (1 - {BAND}) AS in_band FROM layout_lines"
_REPEATED = lambda d: f"SELECT r.doc_id, r.cleaned, r.n FROM (SELECT doc_id, cleaned, count(*) AS n FROM ({_CLEANED(d)}) c WHERE in_band AND cleaned <> '' GROUP BY doc_id, cleaned) r JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM layout_lines GROUP BY doc_id) p ON r.doc_id = p.doc_id WHERE p.pages >= {REPEATS} AND r.n >= least({REPEATS}, p.pages)"

spans_to_lines = operator("lay_spans_to_lines", "Spans of a line joined in order; bold and mono when any span is.", lambda d: f"""
SELECT doc_id, page, CAST(floor(line_no / 2) AS BIGINT) AS line, {d.agg_join('text', chr(39) + ' ' + chr(39), 'line_no')} AS text, max(CASE WHEN is_bold THEN 1 ELSE 0 END) AS bold, max(CASE WHEN is_monospace THEN 1 ELSE 0 END) AS mono
FROM layout_lines GROUP BY doc_id, page, CAST(floor(line_no / 2) AS BIGINT)""")
scan_route = operator("lay_scan_route", "Documents with fewer than 50 characters a page are scans.", f"SELECT doc_id, avg(n) < {SCAN} AS scanned FROM (SELECT doc_id, page, CAST(sum(length(text)) AS DOUBLE) AS n FROM layout_lines GROUP BY doc_id, page) p GROUP BY doc_id")
header_footer = operator("lay_header_footer", "Lines in the bands that repeat three times, in documents of three pages and more.", lambda d: f"SELECT doc_id, cleaned, n FROM ({_REPEATED(d)}) r")
drop_header_footer = operator("lay_drop_header_footer", "Lines without repeated headers, footers and bare page numbers.", lambda d: f"""
SELECT c.doc_id, c.line_no FROM ({_CLEANED(d)}) c LEFT JOIN ({_REPEATED(d)}) r ON c.doc_id = r.doc_id AND c.cleaned = r.cleaned AND c.in_band WHERE r.n IS NULL AND NOT {d.rlike('trim(c.text)', '^[0-9]+$')}""")
para_headings = operator("lay_para_headings", "Style names to levels by a table of styles; first-level headings after the first go down to the second.", """
SELECT doc_id, para_no, CAST(CASE WHEN lv = 1 AND n > 1 THEN 2 ELSE lv END AS INT) AS lv FROM (SELECT p.doc_id, p.para_no, s.lv, row_number() OVER (PARTITION BY p.doc_id, s.lv ORDER BY p.para_no) AS n FROM paragraphs p JOIN style_levels s ON p.style = s.style) x""",
    apart="SELECT p.doc_id, p.para_no, CAST(CASE WHEN s.lv = 1 AND EXISTS (SELECT 1 FROM paragraphs o JOIN style_levels t ON o.style = t.style WHERE t.lv = 1 AND o.doc_id = p.doc_id AND o.para_no < p.para_no) THEN 2 ELSE s.lv END AS INT) AS lv FROM paragraphs p JOIN style_levels s ON p.style = s.style")
lists = operator("lay_lists", "Numbered paragraphs under 120 characters as list items, nested by four spaces a level.", "SELECT doc_id, para_no, CASE WHEN length(text) < 120 AND list_level IS NOT NULL THEN concat(repeat('    ', list_level), '- ', text) ELSE text END AS line FROM paragraphs",
    apart="SELECT doc_id, para_no, CASE WHEN list_level IS NULL OR length(text) > 119 THEN text ELSE lpad('', 4 * list_level, ' ') || '- ' || text END AS line FROM paragraphs")
region_order = operator("lay_region_order", "Regions by rows of 20 points, then from the left; those without a box last.", lambda d: f"SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN y1 IS NULL THEN 1 ELSE 0 END, {d.half_even('y1 / 20')} * 20, x1, line_no) AS pos FROM regions r")
regions_to_md = operator("lay_regions_to_md", "Fragments by type, in order.", lambda d: f"SELECT doc_id, {d.agg_join("CASE type WHEN 'title' THEN concat('## ', text) WHEN 'caption' THEN concat('*', text, '*') WHEN 'formula' THEN concat('$$', text, '$$') WHEN 'figure' THEN '[figure]' ELSE text END", 'chr(10)', 'line_no')} AS md FROM regions r GROUP BY doc_id")
line_height = operator("lay_line_height", "Mean height of text lines between 10 and 50, 14 where there are none.", "SELECT doc_id, round(coalesce(avg(CASE WHEN h > 10 AND h < 50 THEN h END), 14), 6) AS height, count(CASE WHEN h / 12 < 1.5 THEN 1 END) AS inline_formulas FROM layout_lines GROUP BY doc_id")
image_triage = operator("lay_image_triage", "Images that look like formulas: low and wide.", "SELECT p_partkey AS image_id, p_size * 10 < 200 AND CAST(p_retailprice AS DOUBLE) / (p_size * 10) > 1.5 AND CAST(p_retailprice AS DOUBLE) / (p_size * 10) < 15 AS formula FROM part")
