"""Users, roles and groups; which rows a user may see, before anything is ranked."""

from __future__ import annotations

from lorekeep.plans.operator import operator

#: Three states: no list of groups (no filter), an empty list (public only), groups (theirs or public).
VISIBLE = "(q.perm_mode = 'all' OR c.visibility = 'public' OR (q.perm_mode = 'groups' AND c.kb_group = q.perm_group))"

permission = operator("flt_permission", "Chunks that each question may be answered from: how many.", f"SELECT q.qid, CAST(sum(c.n) AS BIGINT) AS visible FROM questions q JOIN (SELECT kb_group, visibility, count(*) AS n FROM kb_docs GROUP BY kb_group, visibility) c ON {VISIBLE} GROUP BY q.qid",
    apart=f"SELECT q.qid, count(*) AS visible FROM questions q JOIN kb_docs c ON {VISIBLE} GROUP BY q.qid")
permission_public = operator("flt_permission_groups", "Documents of a group list or public, and those of an empty list.", """
SELECT doc_id, kb_group IN ('src1', 'src2') OR visibility = 'public' AS for_groups, visibility = 'public' AS for_empty FROM kb_docs""")
role_perm = operator("flt_role_perm", "Users whose role has a permission.", lambda d: f"SELECT r.user_id FROM user_roles r JOIN roles p ON r.role_name = p.role_name WHERE {d.contains(d.json_list('p.permissions'), chr(39) + 'upload' + chr(39))}")
active_users = operator("flt_active_users", "Active users.", "SELECT user_id, username FROM users WHERE is_active")
user_roles = operator("join_user_roles", "Users with their roles and permissions.", "SELECT u.user_id, u.username, r.role_name, p.permissions FROM users u JOIN user_roles r ON u.user_id = r.user_id JOIN roles p ON r.role_name = p.role_name")
group_members = operator("join_group_members", "Groups of users and members of groups.", "SELECT g.group_id, g.name, m.user_id, u.username FROM kb_groups g JOIN kb_group_members m ON g.group_id = m.group_id JOIN users u ON m.user_id = u.user_id")
effective_access = operator("join_effective_access", "Union of permissions, and the groups to search: all (null), own, or public only.", lambda d: f"""
WITH perms AS (SELECT user_id, role_name, perm FROM ({d.explode('(SELECT r.user_id, r.role_name, p.permissions FROM user_roles r JOIN roles p ON r.role_name = p.role_name) rp', 'user_id, role_name', d.json_list('permissions'), 'pos', 'perm')}) e),
  mine AS (SELECT user_id, {d.agg_join('perm', "','", 'perm')} AS permissions, max(CASE WHEN perm = 'search_all' THEN 1 ELSE 0 END) AS search_all FROM (SELECT DISTINCT user_id, perm FROM perms) x GROUP BY user_id),
  theirs AS (SELECT m.user_id, {d.agg_join('g.name', "','", 'g.name')} AS names FROM kb_group_members m JOIN kb_groups g ON m.group_id = g.group_id GROUP BY m.user_id)
SELECT u.user_id, coalesce(p.permissions, 'search_group') AS permissions, CASE WHEN coalesce(p.search_all, 0) = 1 THEN NULL ELSE coalesce(t.names, 'public') END AS search_groups
FROM users u LEFT JOIN mine p ON u.user_id = p.user_id LEFT JOIN theirs t ON u.user_id = t.user_id""")
group_docs = operator("flt_group_docs", "Documents in a group and the complement, null-safe.", "SELECT doc_id, coalesce(kb_group = 'src3', false) AS in_group FROM kb_docs")
group_overview = operator("agg_group_overview", "Members and documents of each group; the store's count where the catalog has none.", """
SELECT g.group_id, g.name, coalesce(m.n, 0) AS members, CASE WHEN coalesce(c.n, 0) > 0 THEN c.n ELSE coalesce(s.n, 0) END AS documents FROM kb_groups g
LEFT JOIN (SELECT group_id, count(*) AS n FROM kb_group_members GROUP BY group_id) m ON g.group_id = m.group_id
LEFT JOIN (SELECT kb_group, count(*) AS n FROM kb_docs GROUP BY kb_group) c ON g.name = c.kb_group
LEFT JOIN (SELECT kb_group, count(DISTINCT coalesce(file_path, '')) AS n FROM chunk_vectors GROUP BY kb_group) s ON g.name = s.kb_group""")
doc_perm = operator("join_doc_perm", "Documents with the permissions of one sample chunk.", """
SELECT k.file_path, s.kb_group, s.visibility FROM kb_docs k LEFT JOIN (SELECT file_path, kb_group, visibility FROM (SELECT file_path, kb_group, visibility, row_number() OVER (PARTITION BY file_path ORDER BY chunk_id) AS rn FROM chunk_vectors) r WHERE rn = 1) s ON k.file_path = s.file_path""")
tool_perm = operator("flt_tool_perm", "Whether a role may call a tool: unregistered no, public yes, else the first missing permission.", lambda d: f"""
WITH tools AS (SELECT * FROM (VALUES ('click', '["*"]'), ('view', '["search_group"]'), ('purchase', '["upload","manage_users"]'), ('login', '[]')) AS t(tool_name, required)),
  asked AS (SELECT DISTINCT r.role_name, r.permissions, e.event_type AS tool_name FROM roles r CROSS JOIN (SELECT DISTINCT event_type FROM events) e),
  needs AS (SELECT a.role_name, a.tool_name, t.tool_name IS NOT NULL AS known, coalesce(t.required, '[]') AS required, a.permissions FROM asked a LEFT JOIN tools t ON a.tool_name = t.tool_name),
  gaps AS (SELECT role_name, tool_name, known, required, {d.join(d.filter(d.json_list('required'), 'p', f"NOT {d.contains(d.json_list('permissions'), 'p')}"), "','")} AS missing FROM needs)
SELECT role_name, tool_name, CASE WHEN NOT known THEN 'unregistered' WHEN required = '["*"]' OR missing = '' THEN 'allowed' ELSE concat('missing ', {d.rrep('missing', ',.*', '')}) END AS verdict FROM gaps""")
tool_undeclared = operator("flt_tool_undeclared", "Registered tools that declare no permissions, and those that declare all.", lambda d: f"SELECT tool_id, {d.size(d.json_list('required'))} = 0 AS undeclared, {d.contains(d.json_list('required'), chr(39) + '*' + chr(39))} AS open_to_all FROM tool_registry",
    apart="""SELECT tool_id, required = '[]' AS undeclared, required = '["*"]' AS open_to_all FROM tool_registry""")
perm_union = operator("set_perm_union", "Union of the permission sets of a nation's users.", lambda d: f"""
SELECT nation, {d.agg_join('perm', "','", 'perm')} AS permissions FROM (SELECT DISTINCT nation, perm FROM ({d.explode('(SELECT c.c_nationkey AS nation, p.permissions FROM customer c JOIN roles p ON c.c_mktsegment = p.role_name) x', 'nation', d.json_list('permissions'), 'pos', 'perm')}) e) u GROUP BY nation""")
members_change = operator("set_members", "A batch of changes to memberships: insert or ignore, then remove.", """
SELECT c.group_id, c.user_id FROM (SELECT group_id, user_id FROM kb_group_members UNION SELECT group_id, user_id FROM membership_changes WHERE change = 'add') c
LEFT JOIN (SELECT DISTINCT group_id AS g, user_id AS u FROM membership_changes WHERE change = 'remove') r ON c.group_id = r.g AND c.user_id = r.u WHERE r.u IS NULL""",
    apart="(SELECT group_id, user_id FROM kb_group_members UNION SELECT group_id, user_id FROM membership_changes WHERE change = 'add') EXCEPT SELECT group_id, user_id FROM membership_changes WHERE change = 'remove'")
replace_groups = operator("set_replace_groups", "All memberships of the listed users are replaced.", """
SELECT m.group_id, m.user_id FROM kb_group_members m LEFT JOIN (SELECT DISTINCT user_id AS u FROM new_memberships) l ON m.user_id = l.u WHERE l.u IS NULL
UNION ALL SELECT DISTINCT group_id, user_id FROM new_memberships""",
    apart="SELECT group_id, user_id FROM kb_group_members WHERE user_id NOT IN (SELECT user_id FROM new_memberships) UNION ALL SELECT DISTINCT group_id, user_id FROM new_memberships")
#: Users named in `protected_users` can't be deleted or renamed; a new name that another user has is refused, as is a new user of a name that is taken.
access_crud = operator("mnt_access_crud", "Users after a batch of changes: partial updates, unique names on insert and rename, deletes that cascade to roles, protected rows.", """
WITH taken AS (SELECT username FROM users), deletes AS (SELECT c.user_id FROM user_changes c LEFT ANTI JOIN protected_users p ON c.user_id = p.user_id WHERE c.change = 'delete'),
  renames AS (SELECT user_id, min(username) AS username FROM (SELECT c.user_id, c.username, count(*) OVER (PARTITION BY c.username) AS n FROM user_changes c LEFT ANTI JOIN protected_users p ON c.user_id = p.user_id WHERE c.change = 'rename') x WHERE n = 1 AND username NOT IN (SELECT username FROM taken) GROUP BY user_id),
  inserts AS (SELECT user_id, username FROM (SELECT user_id, username, row_number() OVER (PARTITION BY username ORDER BY user_id) AS n FROM user_changes WHERE change = 'insert') x WHERE n = 1 AND username NOT IN (SELECT username FROM taken))
SELECT u.user_id, coalesce(n.username, u.username) AS username, coalesce(r.role_name, 'none') AS role_name FROM users u LEFT ANTI JOIN deletes d ON u.user_id = d.user_id LEFT JOIN renames n ON u.user_id = n.user_id LEFT JOIN user_roles r ON u.user_id = r.user_id
UNION ALL SELECT user_id, username, 'none' FROM inserts""",
    apart="""WITH open AS (SELECT * FROM user_changes WHERE user_id NOT IN (SELECT user_id FROM protected_users)),
  renames AS (SELECT user_id, min(username) AS username FROM open o WHERE change = 'rename' AND NOT EXISTS (SELECT 1 FROM users u WHERE u.username = o.username) AND (SELECT count(*) FROM open x WHERE x.change = 'rename' AND x.username = o.username) = 1 GROUP BY user_id)
SELECT u.user_id, coalesce(n.username, u.username) AS username, coalesce(r.role_name, 'none') AS role_name FROM users u LEFT JOIN renames n USING (user_id) LEFT JOIN user_roles r ON u.user_id = r.user_id WHERE u.user_id NOT IN (SELECT user_id FROM open WHERE change = 'delete')
UNION ALL SELECT min(user_id), username, 'none' FROM user_changes c WHERE change = 'insert' AND username NOT IN (SELECT username FROM users) GROUP BY username""")
