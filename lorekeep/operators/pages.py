"""Pages of positioned lines to Markdown: columns, reading order, headings.

Lines (`layout_lines`: doc_id, page, line_no, text, x, y, w, h, size, is_bold, is_monospace) and page sizes
(`page_sizes`: doc_id, page, width) are tables; every rule works page by page in arrays or windows of one page.

Columns: a page is cut into strips, a line's characters count for the strip of its middle; strips are
smoothed over their neighbours. A fold along the strips opens a column where a strip holds a share of
the fullest strip (`OPEN`) and closes it where one falls under another (`SHUT`). Shares are of the fullest
strip: of the page's total no page could have two columns that pass. Between two columns the emptiest
strip is their boundary. Defined results: a page without characters has one column and no boundary.

Headings: a page's sizes from the largest, each kept if it lies a point or more under the last kept
one, which a fold carries along. The last kept size is body text; of those before it up to three are
headings, each with a range from half a point over the next kept size to two points over its own."""

from __future__ import annotations

from lorekeep.operators.text import FORMULA_LEAST, FORMULA_SHARE, MATH, STRONG, any_of
from lorekeep.plans.dialect import DUCK, SPARK
from lorekeep.plans.operator import operator

#: Strips of a page, shares that open and shut a column, points that merge sizes, heading levels.
STRIPS, OPEN, SHUT, MERGE, LEVELS = 20, 0.3, 0.05, 1.0, 3

_STRIP = f"CAST(greatest(least(floor((l.x + l.w / 2) / (p.width / {STRIPS})), {STRIPS - 1}), 0) AS INT)"
_COUNTED = f"SELECT l.doc_id, l.page, max(p.width) AS width, {_STRIP} AS strip, CAST(sum(length(l.text)) AS DOUBLE) AS n FROM layout_lines l JOIN page_sizes p ON l.doc_id = p.doc_id AND l.page = p.page GROUP BY l.doc_id, l.page, {_STRIP}"

COLUMNS = f"""SELECT doc_id, page, CAST(greatest(size(found), 1) AS BIGINT) AS n_columns,
  transform(CASE WHEN size(found) > 1 THEN sequence(1, size(found) - 1) ELSE CAST(array() AS ARRAY<INT>) END,
    k -> (array_min(transform(sequence(found[k - 1].b, found[k].a - 1), i -> named_struct('s', s[i], 'i', i))).i + 0.5E0) * width / {STRIPS}) AS boundaries
FROM (SELECT doc_id, page, width, s, aggregate(sequence(0, {STRIPS}), named_struct('since', CAST(NULL AS INT), 'found', CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>)),
    (c, i) -> CASE WHEN c.since IS NULL AND s[i] > 0 AND s[i] >= {OPEN} * array_max(s) THEN named_struct('since', i, 'found', c.found)
      WHEN c.since IS NOT NULL AND s[i] < {SHUT} * array_max(s) THEN named_struct('since', CAST(NULL AS INT), 'found', concat(c.found, array(named_struct('a', c.since, 'b', i - 1)))) ELSE c END).found AS found
  FROM (SELECT doc_id, page, width, concat(transform(v, (x, i) -> (x + coalesce(get(v, i - 1), 0) + coalesce(get(v, i + 1), 0)) / (3 - CASE WHEN i IN (0, {STRIPS - 1}) THEN 1 ELSE 0 END)), array(-1.0E0)) AS s
    FROM (SELECT doc_id, page, width, transform(sequence(0, {STRIPS - 1}), i -> coalesce(m[i], 0.0E0)) AS v
      FROM (SELECT doc_id, page, max(width) AS width, map_from_entries(collect_list(struct(strip, n))) AS m FROM ({_COUNTED}) c GROUP BY doc_id, page) a) b) e) f"""
#: The same by windows: a strip is in a column if the last strip that opened or shut one opened it.
_BY_RUNS = f"""WITH counted AS MATERIALIZED ({_COUNTED}), pages AS (SELECT doc_id, page, max(width) AS width FROM counted GROUP BY ALL),
  dense AS (SELECT p.doc_id, p.page, p.width, i AS strip, coalesce(c.n, 0) AS n FROM pages p CROSS JOIN generate_series(0, {STRIPS - 1}) g(i) LEFT JOIN counted c ON c.doc_id = p.doc_id AND c.page = p.page AND c.strip = i),
  smooth AS (SELECT *, avg(n) OVER (PARTITION BY doc_id, page ORDER BY strip ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM dense),
  topped AS (SELECT *, max(s) OVER (PARTITION BY doc_id, page) AS top FROM smooth),
  state AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN s > 0 AND s >= {OPEN} * top THEN 1 WHEN s < {SHUT} * top THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY strip), 0) AS open FROM topped),
  runs AS MATERIALIZED (SELECT doc_id, page, min(strip) AS a, max(strip) AS b, row_number() OVER (PARTITION BY doc_id, page ORDER BY min(strip)) AS k FROM (SELECT *, strip - row_number() OVER (PARTITION BY doc_id, page, open ORDER BY strip) AS run FROM state) r WHERE open = 1 GROUP BY doc_id, page, run),
  valleys AS (SELECT x.doc_id, x.page, x.k, (arg_min(s.strip, (s.s, s.strip)) + 0.5) * max(s.width) / {STRIPS} AS boundary FROM runs x JOIN runs y ON x.doc_id = y.doc_id AND x.page = y.page AND y.k = x.k + 1 JOIN state s ON s.doc_id = x.doc_id AND s.page = x.page AND s.strip >= x.b AND s.strip < y.a GROUP BY ALL),
  page_columns AS (SELECT p.doc_id, p.page, greatest((SELECT count(*) FROM runs r WHERE r.doc_id = p.doc_id AND r.page = p.page), 1)::BIGINT AS n_columns, coalesce((SELECT list(boundary ORDER BY k) FROM valleys v WHERE v.doc_id = p.doc_id AND v.page = p.page), []) AS boundaries FROM pages p)"""

columns = operator("lay_columns", "Columns of each page and the boundaries between them, at the emptiest strip.",
    f"SELECT doc_id, page, n_columns, array_join(transform(boundaries, b -> format_number(b, '0.00')), ' ') AS boundaries FROM ({COLUMNS}) c",
    apart=f"{_BY_RUNS} SELECT doc_id, page, n_columns, array_to_string(list_transform(boundaries, lambda b: printf('%.2f', b)), ' ') AS boundaries FROM page_columns")

#: Lines with their column; one column is read by (y, x), several each by y.
_PLACED = f"""SELECT l.*, c.n_columns, size(filter(c.boundaries, b -> l.x >= b)) AS col FROM layout_lines l JOIN ({COLUMNS}) c ON l.doc_id = c.doc_id AND l.page = c.page"""
_PLACED_APART = "SELECT l.*, c.n_columns, len(list_filter(c.boundaries, lambda b: l.x >= b)) AS col FROM layout_lines l JOIN page_columns c ON l.doc_id = c.doc_id AND l.page = c.page"
_ORDER = "page, col, y, CASE WHEN n_columns > 1 THEN 0 ELSE x END, line_no"
reading_order = operator("lay_reading_order", "Columns from the left, each from the top.", f"SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) AS pos FROM ({_PLACED}) p",
    apart=f"{_BY_RUNS} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) AS pos FROM ({_PLACED_APART}) p")

_KEPT = f"""SELECT doc_id, page, aggregate(array_sort(collect_set(-size)), CAST(array() AS ARRAY<DOUBLE>), (k, s) -> CASE WHEN size(k) = 0 OR element_at(k, -1) + s >= {MERGE} THEN concat(k, array(-s)) ELSE k END) AS kept
  FROM layout_lines WHERE trim(text) <> '' AND size > 0 GROUP BY doc_id, page"""
BINS = f"""SELECT doc_id, page, kept[i] AS size, i + 1 AS lv, kept[i + 1] + {MERGE / 2} AS low, kept[i] + 2 AS high
  FROM (SELECT doc_id, page, kept, explode(CASE WHEN size(kept) > 1 THEN sequence(0, least({LEVELS}, size(kept) - 1) - 1) ELSE CAST(array() AS ARRAY<INT>) END) AS i FROM ({_KEPT}) k) b"""
#: The same by recursion: the next kept size is the largest that lies a point or more under this one.
_BINS_APART = f"""sizes AS MATERIALIZED (SELECT DISTINCT doc_id, page, size FROM layout_lines WHERE trim(text) <> '' AND size > 0),
  chain AS (SELECT doc_id, page, max(size) AS size, 1 AS lv FROM sizes GROUP BY doc_id, page
    UNION ALL SELECT * FROM (SELECT c.doc_id, c.page, (SELECT max(s.size) FROM sizes s WHERE s.doc_id = c.doc_id AND s.page = c.page AND s.size <= c.size - {MERGE}) AS size, c.lv + 1 FROM chain c WHERE c.lv <= {LEVELS}) n WHERE size IS NOT NULL),
  bins AS (SELECT a.doc_id, a.page, a.size, a.lv, b.size + {MERGE / 2} AS low, a.size + 2 AS high FROM chain a JOIN chain b ON a.doc_id = b.doc_id AND a.page = b.page AND b.lv = a.lv + 1 WHERE a.lv <= {LEVELS})"""
heading_bins = operator("lay_heading_bins", "Heading sizes of each page with the range of each; body text is no heading.", f"SELECT doc_id, page, size, CAST(lv AS INT) AS lv, low, high FROM ({BINS}) b", apart=f"WITH RECURSIVE {_BINS_APART} SELECT doc_id, page, size, CAST(lv AS INT) AS lv, low, high FROM bins")

_LEVEL = "min(b.lv) AS lv FROM layout_lines l JOIN {bins} b ON l.doc_id = b.doc_id AND l.page = b.page AND l.size >= b.low AND l.size <= b.high"
_HEADED = lambda bins: f"SELECT doc_id, page, line_no, CAST(greatest(lv - CASE WHEN is_bold THEN 1 ELSE 0 END, 1) AS INT) AS lv FROM (SELECT l.doc_id, l.page, l.line_no, l.is_bold, {_LEVEL.format(bins=bins)} GROUP BY l.doc_id, l.page, l.line_no, l.is_bold) r"
range_heading = operator("join_range_heading", "Level of a line by the first range that its size lies in; bold goes one level up.", f"SELECT doc_id, line_no, lv FROM ({_HEADED(f'({BINS})')}) h", apart=f"WITH RECURSIVE {_BINS_APART} SELECT doc_id, line_no, lv FROM ({_HEADED('bins')}) h")


def _markdown(d, placed: str, headed: str) -> str:
    """Each line writes what stands before it and itself, from its own state and that of the line before;
    a blank line, and the end of a page, close what is open. A blank line parts two columns."""
    formula = f"length(text) >= {FORMULA_LEAST} AND (CAST(length({d.rrep('text', f'[^{any_of(MATH)}]', '')}) AS DOUBLE) / greatest(length(text), 1) > {FORMULA_SHARE} OR {d.rlike('text', f'[{any_of(STRONG)}]')})"
    nl = "chr(10)"
    return f"""placed AS ({placed}), headed AS ({headed}),
  every AS (SELECT doc_id, page, line_no, col, 0 AS part, trim(text) AS t, {formula} AS formula, is_monospace AS mono, x, y, h, size, n_columns FROM placed
    UNION ALL SELECT doc_id, page, NULL, col, 1, '', false, false, 0, 0, 0, 0, n_columns FROM (SELECT DISTINCT p.doc_id, p.page, p.col, p.n_columns FROM placed p JOIN (SELECT doc_id, page, max(col) AS last FROM placed GROUP BY doc_id, page) m ON p.doc_id = m.doc_id AND p.page = m.page AND p.col < m.last) s),
  ordered AS (SELECT e.*, h.lv, row_number() OVER (PARTITION BY e.doc_id, e.page ORDER BY e.col, e.part, e.y, CASE WHEN e.n_columns > 1 THEN 0 ELSE e.x END, e.line_no) AS pos FROM every e LEFT JOIN headed h ON e.doc_id = h.doc_id AND e.page = h.page AND e.line_no = h.line_no),
  looked AS (SELECT o.*, t <> '' AND formula AS f, t <> '' AND mono AS m, coalesce(lag(t <> '' AND formula) OVER (PARTITION BY doc_id, page ORDER BY pos), false) AS f0, coalesce(lag(t <> '' AND mono) OVER (PARTITION BY doc_id, page ORDER BY pos), false) AS m0,
    CASE WHEN lag(t) OVER (PARTITION BY doc_id, page ORDER BY pos) <> '' THEN y - lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY pos) END AS gap, lead(pos) OVER (PARTITION BY doc_id, page ORDER BY pos) IS NULL AS ends FROM ordered o),
  written AS (SELECT doc_id, page, pos, CASE WHEN t = '' THEN concat(CASE WHEN m0 THEN concat('```', {nl}) ELSE '' END, CASE WHEN f0 THEN concat('$$', {nl}, {nl}) ELSE '' END)
    ELSE concat(CASE WHEN f AND NOT f0 THEN concat({nl}, '$$', {nl}) WHEN f0 AND NOT f THEN concat('$$', {nl}, {nl}) ELSE '' END,
      CASE WHEN gap IS NULL THEN '' WHEN lv IS NOT NULL THEN {nl} WHEN gap > greatest(1.5 * size, 20) AND NOT f THEN {nl} ELSE '' END, CASE WHEN m AND NOT m0 OR m0 AND NOT m THEN concat('```', {nl}) ELSE '' END,
      CASE WHEN lv IS NOT NULL THEN concat(repeat('#', lv), ' ') ELSE '' END, t, CASE WHEN ends AND f THEN concat({nl}, '$$') ELSE '' END, CASE WHEN ends AND m THEN concat({nl}, '```') ELSE '' END) END AS piece FROM looked)
SELECT doc_id, page, {d.agg_join('piece', nl, 'pos')} AS md FROM written GROUP BY doc_id, page"""


lines_to_md = operator("lay_lines_to_md", "Each page as Markdown in reading order: headings by the bins, paragraphs at wide gaps, fences around runs of fixed width and of formulas.",
    f"WITH {_markdown(SPARK, _PLACED, _HEADED(f'({BINS})'))}", apart=f"WITH RECURSIVE {_BINS_APART},\n{_BY_RUNS.removeprefix('WITH ')},\n{_markdown(DUCK, _PLACED_APART, _HEADED('bins'))}")
