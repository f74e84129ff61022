"""A knowledge base on plain Parquet: catalog and chunks in, catalog and chunks out, as versions."""

from __future__ import annotations

from lorekeep.plans.operator import operator

#: Default group and visibility, snapshots kept.
GROUP, VISIBILITY, SNAPSHOTS = "default", "internal", 10

_REPAIR = """SELECT coalesce(s.file_path, k.file_path) AS file_path, coalesce(s.n, 0) AS store_chunks, coalesce(k.n, 0) AS catalog_chunks,
  CASE WHEN k.file_path IS NULL THEN 'added' WHEN s.file_path IS NULL THEN 'removed' WHEN s.n <> k.n THEN 'fixed' ELSE 'same' END AS state
FROM (SELECT file_path, CAST(sum(n_chunks) AS BIGINT) AS n FROM kb_store_counts GROUP BY file_path) s FULL OUTER JOIN (SELECT file_path, CAST(2 AS BIGINT) AS n FROM kb_docs) k ON s.file_path = k.file_path"""

scan = operator("kb_scan", "All chunks with their metadata.", "SELECT chunk_id, file_path, kb_group, visibility, length(content) AS n FROM chunk_vectors")
lookup = operator("kb_lookup", "Chunks of a file by its path.", "SELECT chunk_id, file_path, kb_group FROM chunk_vectors WHERE kb_group = 'src5' AND visibility = 'public'")
listing = operator("kb_list", "One row per document with its shown hash and defaults.", f"SELECT file_path, substring(file_hash, 1, 12) AS hash, coalesce(kb_group, '{GROUP}') AS kb_group, coalesce(visibility, '{VISIBILITY}') AS visibility, CAST(floor(length(text) / 500) + 1 AS BIGINT) AS chunks FROM kb_docs")
chunks_by_source = operator("agg_chunks_by_source", "Chunks per file; the catalog rebuilt.", "SELECT coalesce(file_path, 'unknown') AS file_path, count(*) AS chunks FROM chunk_vectors GROUP BY coalesce(file_path, 'unknown')")
status = operator("agg_kb_status", "Whether there is a base, its documents and chunks.", lambda d: f"SELECT count(*) > 0 AS ready, count(*) AS documents, CAST(sum(floor(length(content) / 500) + 1) AS BIGINT) AS chunks, max({d.size('embedding')}) AS dim FROM chunk_vectors WHERE content IS NOT NULL")
distinct_files = operator("agg_distinct_files", "Distinct files and texts.", "SELECT count(DISTINCT file_path) AS files, count(DISTINCT md5(text)) AS texts FROM kb_docs")
missing_perm = operator("agg_missing_perm", "Chunks without group or visibility, per file.", "SELECT file_path, CAST(count_if(kb_group IS NULL) AS BIGINT) AS no_group, CAST(count_if(visibility IS NULL) AS BIGINT) AS no_visibility FROM unstamped_chunks GROUP BY file_path HAVING count_if(kb_group IS NULL OR visibility IS NULL) > 0",
    apart="SELECT file_path, count(*) - count(kb_group) AS no_group, count(*) - count(visibility) AS no_visibility FROM unstamped_chunks GROUP BY file_path HAVING count(*) > least(count(kb_group), count(visibility))")
lookup_fallback = operator("flt_lookup_fallback", "By path, by base name only where no path matches.", lambda d: f"""
WITH asked AS (SELECT doc_id AS rid, CASE WHEN doc_id % 2 = 0 THEN file_path ELSE concat('moved/', CAST(doc_id AS STRING), '.txt') END AS p FROM kb_docs),
  named AS (SELECT file_path, {d.rext('file_path', '[^/]+$')} AS name FROM kb_docs), exact AS (SELECT a.rid, n.file_path FROM asked a JOIN named n ON a.p = n.file_path)
SELECT a.rid, n.file_path, 'name' AS how FROM asked a JOIN named n ON {d.rext('a.p', '[^/]+$')} = n.name LEFT JOIN exact e ON a.rid = e.rid WHERE e.rid IS NULL UNION ALL SELECT rid, file_path, 'path' FROM exact""")
repair_join = operator("join_repair", "Store against catalog: added, removed, fixed, same.", _REPAIR)
anti_stale = operator("join_anti_stale", "Catalog paths that the store doesn't have.", "SELECT k.file_path FROM kb_docs k LEFT ANTI JOIN kb_store_counts s ON k.file_path = s.file_path")
anti_stale.body = lambda d: "SELECT k.file_path FROM kb_docs k LEFT ANTI JOIN kb_store_counts s ON k.file_path = s.file_path" if d.name == "spark" else "SELECT k.file_path FROM kb_docs k ANTI JOIN kb_store_counts s ON k.file_path = s.file_path"
semi_names = operator("join_semi_names", "Rows picked by a list of names, in the list's order.", "SELECT l.pos, n.n_nationkey, n.n_name FROM nation n JOIN (VALUES (0, 'NATION_7'), (1, 'NATION_3'), (2, 'NOWHERE'), (3, 'NATION_12')) AS l(pos, name) ON n.n_name = l.name")
set_except = operator("set_except", "Paths of the catalog that an incoming batch doesn't have.", "SELECT file_path FROM kb_docs EXCEPT SELECT file_path FROM kb_docs_new")
set_union_all = operator("set_union_all", "Two lists of files, one after the other.", "SELECT file_path, 0 AS src FROM kb_docs UNION ALL SELECT file_path, 1 FROM kb_docs_new")
repair = operator("mnt_repair", "The catalog after repair: the store's counts.", f"SELECT file_path, store_chunks AS chunks FROM ({_REPAIR}) r WHERE state <> 'removed'")
migrate = operator("mnt_migrate", "Missing path, hash and time filled in; how many were.", "SELECT doc_id, coalesce(file_path, concat('unknown/', CAST(doc_id AS STRING))) AS file_path, coalesce(file_hash, md5(text)) AS file_hash, file_path IS NULL OR file_hash IS NULL AS changed FROM old_docs")
fill_perm = operator("mnt_fill_perm", "Missing permissions get the defaults.", f"SELECT chunk_id, coalesce(kb_group, '{GROUP}') AS kb_group, coalesce(visibility, '{VISIBILITY}') AS visibility FROM unstamped_chunks")
retention = operator("win_retention", "Snapshots beyond the newest ten expire.", f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) r WHERE rn > {SNAPSHOTS}")
asof_backup = operator("win_asof_backup", "The backup at a time: the latest not after it, else the newest.", """

WITH points AS (SELECT user_id AS k, event_id AS t, event_id AS backup, CAST(NULL AS BIGINT) AS request FROM events UNION ALL SELECT o_custkey, o_orderkey, NULL, o_orderkey FROM orders),
  placed AS (SELECT request, max(backup) OVER (PARTITION BY k ORDER BY t, coalesce(request, -1) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, max(backup) OVER (PARTITION BY k) AS newest FROM points)
SELECT request, coalesce(upto, newest) AS backup FROM placed WHERE request IS NOT NULL AND newest IS NOT NULL""")
stop_on_error = operator("win_stop_on_error", "Files before the first failure of each group, and the counts.", """
SELECT k.kb_group, CAST(count_if(f.first IS NULL OR k.file_path < f.first) AS BIGINT) AS done, count(*) AS files
FROM kb_docs k LEFT JOIN (SELECT kb_group, min(file_path) AS first FROM kb_docs WHERE doc_id % 37 = 5 GROUP BY kb_group) f ON k.kb_group = f.kb_group GROUP BY k.kb_group""", apart="""
SELECT kb_group, CAST(count_if(broken = 0) AS BIGINT) AS done, count(*) AS files FROM (SELECT kb_group, max(CASE WHEN doc_id % 37 = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY kb_group ORDER BY file_path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM kb_docs) r GROUP BY kb_group""")
