"""The registered graph queries stated in SQL, over the same tables."""

from __future__ import annotations

_WORDS = "close|closes|closed|fix|fixes|fixed|resolve|resolves|resolved"
_NUMBER = rf"(?i)\b(?:{_WORDS})\b\s*:?\s+#(\d+)"
_URL = rf"(?i)\b(?:{_WORDS})\b\s*:?\s+https?://(?:www\.)?github\.com/([\w.-]+/[\w.-]+)/issues/(\d+)\b"

BASE = rf"""
WITH RECURSIVE ord AS (
  SELECT o_orderkey AS k, n_regionkey::BIGINT AS g, o_custkey AS c, o_orderstatus AS st, o_orderdate AS d,
         o_orderpriority || ' order ' || o_orderkey AS title, o_orderkey % 4 = 0 AS is_issue
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
), art AS (
  SELECT *, CASE WHEN is_issue THEN 'issue:' ELSE 'pull_request:' END || k AS node,
    CASE WHEN NOT is_issue AND st = 'F' THEN d + INTERVAL 1 DAY END AS merged_at,
    CASE WHEN NOT is_issue THEN CASE st WHEN 'F' THEN d + INTERVAL 1 DAY WHEN 'P' THEN d + INTERVAL 2 DAY END END AS closed_at,
    CASE k % 4
      WHEN 0 THEN 'Order report'
      WHEN 1 THEN 'Fixes #' || (k - 1) || CASE WHEN k % 8 = 1 AND k > 8 THEN '. Closes: #' || (k - 5) ELSE '' END
      WHEN 2 THEN 'See #' || (k - 1) || '. fixes https://github.com/org/region' || g || '/issues/' || (k - 2)
      ELSE 'Context in #' || (k - 3) || '; fixes https://github.com/org/region' || ((g + 1) % 5) || '/issues/' || (k - 3)
    END AS body
  FROM ord
), urls AS (
  SELECT k, g, unnest(regexp_extract_all(body, '{_URL}', 1)) AS slug, unnest(regexp_extract_all(body, '{_URL}', 2))::BIGINT AS n FROM art
), closing AS (
  SELECT DISTINCT k, g, n FROM (
    SELECT k, g, unnest(regexp_extract_all(body, '{_NUMBER}', 1))::BIGINT AS n FROM art
    UNION ALL SELECT k, g, n FROM urls WHERE lower(slug) = 'org/region' || g)
), mention AS (
  SELECT DISTINCT k, g, n FROM (SELECT k, g, unnest(regexp_extract_all(body, '(?:^|[^\w/])#(\d+)\b', 1))::BIGINT AS n FROM art)
  EXCEPT SELECT k, g, n FROM closing
), refs AS (
  SELECT k, g, n, 'closes' AS t, 'pr_body_closing_keyword' AS x FROM closing
  UNION ALL SELECT k, g, n, 'references', 'pr_body_issue_mention' FROM mention
), res AS (
  SELECT r.k, r.g, r.n, r.t, r.x, a.d, a.node AS src, b.node AS dst, b.is_issue AS dst_issue
  FROM refs r JOIN art a ON a.k = r.k JOIN art b ON b.k = r.n AND b.g = r.g WHERE r.k <> r.n
), pend AS (
  SELECT r.* FROM refs r WHERE NOT EXISTS (SELECT 1 FROM art b WHERE b.k = r.n AND b.g = r.g)
), comm AS (
  SELECT DISTINCT k, g, l_linenumber AS ln FROM lineitem JOIN art ON k = l_orderkey WHERE NOT is_issue
), rev AS (
  SELECT k, l_suppkey AS s, max(l_shipdate) AS seen FROM lineitem JOIN art ON k = l_orderkey WHERE l_returnflag = 'R' AND NOT is_issue GROUP BY ALL
), dep AS (
  SELECT DISTINCT k, g, node, strftime(l_shipdate, '%Y-%m') AS tag FROM lineitem JOIN art ON k = l_orderkey WHERE l_linenumber = 7
), own AS (
  SELECT n_regionkey AS g, '/' || n_name || '/' AS pattern, n_nationkey AS nk, min(s_suppkey) AS s,
         'CODEOWNERS:' || (1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY '/' || n_name || '/ @org/nation' || n_nationkey)) AS ref
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_name, n_nationkey
), lnk AS (
  SELECT k AS a, n AS b FROM res WHERE t = 'closes' UNION SELECT n, k FROM res WHERE t = 'closes'
), reach(k, m) AS (
  SELECT k, k FROM art UNION SELECT reach.k, lnk.b FROM reach JOIN lnk ON lnk.a = reach.m
), thr AS (
  SELECT reach.k, 'thread:' || min(art.g) || ':' || arg_min(CASE WHEN art.is_issue THEN 'issue-' ELSE 'pr-' END || art.k, art.is_issue::INT * 1000000000000 + art.k) AS th
  FROM reach JOIN art ON art.k = reach.m GROUP BY reach.k
), cand AS (
  SELECT s.g, s.th, s.node AS implementer, i.node AS motivator, i.title, coalesce(s.merged_at, s.closed_at) AS decided_at, s.merged_at, s.k AS ik, i.k AS mk
  FROM (SELECT art.*, th FROM art JOIN thr USING (k)) s JOIN res ON res.k = s.k AND res.t = 'closes' AND res.dst_issue JOIN art i ON i.k = res.n
  QUALIFY row_number() OVER (PARTITION BY s.th ORDER BY s.merged_at IS NULL, i.k, s.k) = 1
), land AS (
  SELECT th FROM art JOIN thr USING (k) WHERE merged_at IS NOT NULL GROUP BY th
), decn AS (
  SELECT cand.*, rel.tag FROM cand JOIN land USING (th) LEFT JOIN (SELECT th, min(tag) AS tag FROM dep JOIN thr USING (k) GROUP BY th) rel USING (th)
), sig AS (
  SELECT th, coalesce(bool_or(k IN (SELECT k FROM res WHERE t = 'closes' AND dst_issue)), false) AS declared, coalesce(bool_or(k IN (SELECT k FROM comm)), false) AS structural,
         coalesce(bool_or(k IN (SELECT k FROM rev)), false) AS attested, coalesce(bool_or(k IN (SELECT k FROM dep)), false) AS published
  FROM thr GROUP BY th
), sigs AS (
  SELECT *, declared::INT + structural::INT + attested::INT + published::INT AS category_count FROM sig
), lift AS (
  SELECT th FROM sigs WHERE category_count >= 3
), edg AS (
  SELECT src, dst, t AS type, CASE WHEN t = 'closes' AND th IN (FROM lift) THEN 1 ELSE 0 END AS tier, d AS vf, x FROM res JOIN thr USING (k)
  UNION ALL SELECT 'pull_request:' || k, 'commit:c-' || k || '-' || ln, 'implements', CASE WHEN th IN (FROM lift) THEN 1 ELSE 0 END, TIMESTAMP '1995-01-01', 'pr_commit_list' FROM comm JOIN thr USING (k)
  UNION ALL SELECT node, 'release:' || g || '/' || tag, 'deployed_by', 0, strptime(tag || '-01', '%Y-%m-%d'), 'release_notes_reference' FROM dep
  UNION ALL SELECT 'decision:' || th, motivator, 'motivated_by', CASE WHEN th IN (FROM lift) THEN 1 ELSE 0 END, coalesce(decided_at, TIMESTAMP '1995-01-01'), 'synthesis_closes_cluster' FROM decn
  UNION ALL SELECT 'decision:' || th, implementer, 'implemented_by', CASE WHEN th IN (FROM lift) THEN 1 ELSE 0 END, coalesce(decided_at, TIMESTAMP '1995-01-01'), 'synthesis_closes_cluster' FROM decn
  UNION ALL SELECT 'decision:' || th, 'release:' || g || '/' || tag, 'deployed_by', 0, TIMESTAMP '1995-01-01', 'synthesis_release_note' FROM decn WHERE tag IS NOT NULL
), mem AS (
  SELECT th, count(*) + coalesce(sum(c.n), 0) AS members, bool_or(is_issue) AS has_issue, count_if(NOT is_issue)::BIGINT AS prs, coalesce(sum(c.n), 0)::BIGINT AS commits, min(g) AS g, count_if(is_issue)::BIGINT AS issues
  FROM art JOIN thr USING (k) LEFT JOIN (SELECT k, count(*) AS n FROM comm GROUP BY k) c USING (k) GROUP BY th
), fact AS (
  SELECT mem.*, th IN (SELECT th FROM decn) AS has_decision, th IN (SELECT th FROM res JOIN thr USING (k) WHERE t = 'closes') AS closes_in_thread, th IN (FROM land) AS landed FROM mem
), buck AS (
  SELECT *, CASE WHEN NOT has_issue THEN 'A  no issue in thread' WHEN members = 1 THEN 'D  singleton issue' WHEN NOT closes_in_thread THEN 'C  issue, no in-thread closes'
            WHEN NOT landed THEN 'B  closes, nothing merged' ELSE 'F  residual' END AS bucket FROM fact WHERE NOT has_decision
)
"""


def _walk(types: str, begin: str, ends: str, depth: int, as_of: str) -> str:
    return (
        BASE
        + rf"""
, near AS (
  SELECT src AS here, dst AS nxt, tier FROM edg WHERE type IN ({types}) AND vf <= TIMESTAMP '{as_of}'
  UNION ALL SELECT dst, src, tier FROM edg WHERE type IN ({types}) AND vf <= TIMESTAMP '{as_of}'
), walk(here, depth, path, tier) AS (
  SELECT s, 0, [s], 0 FROM ({begin}) b(s)
  UNION ALL
  SELECT nxt, depth + 1, list_append(path, nxt), greatest(walk.tier, near.tier) FROM walk JOIN near USING (here) WHERE depth < {depth} AND NOT list_contains(path, nxt)
)
SELECT depth, ['explicit', 'corroborated', 'inferred'][tier + 1] AS tier, array_to_string(list_transform(path, lambda x: regexp_replace(x, '^release:\d+/', 'release:')), ' > ') AS path
FROM walk WHERE depth > 0 AND {ends}
"""
    )


def _walk_instants(types: str, instants: tuple[str, ...]) -> str:
    return (
        BASE
        + rf"""
, windows AS (
  SELECT *, vf + to_days((CASE WHEN type = 'closes' AND num % 3 = 0 THEN num % 200 + 1 WHEN type = 'implements' AND num % 4 = 1 THEN num % 1500 END)::INT) AS vt
  FROM (SELECT *, CASE WHEN src LIKE 'pull_request:%' THEN split_part(src, ':', 2)::BIGINT END AS num FROM edg WHERE type IN ({types}))
), near AS (
  SELECT src AS here, dst AS nxt, tier, vf, vt FROM windows UNION ALL SELECT dst, src, tier, vf, vt FROM windows
), walk(as_of, here, depth, path, tier) AS (
  SELECT a, node, 0, [node], 0 FROM art, unnest({list(instants)}) i(a) WHERE is_issue
  UNION ALL
  SELECT as_of, nxt, depth + 1, list_append(path, nxt), greatest(walk.tier, near.tier) FROM walk JOIN near USING (here)
  WHERE depth < 2 AND NOT list_contains(path, nxt) AND vf <= as_of::TIMESTAMP AND (vt IS NULL OR vt > as_of::TIMESTAMP)
)
SELECT as_of, depth, ['explicit', 'corroborated', 'inferred'][tier + 1] AS tier, array_to_string(list_transform(path, lambda x: regexp_replace(x, '^release:\d+/', 'release:')), ' > ') AS path
FROM walk WHERE depth > 0
"""
    )


_COMMITS = "SELECT 'commit:c-' || k || '-' || ln FROM comm"
_ISSUES = "SELECT node FROM art WHERE is_issue"
_WHY = "'motivated_by', 'implemented_by', 'implements', 'references'"
_IMPACT = "'depends_on', 'implements', 'closes', 'deployed_by', 'implemented_by'"
_WHY_WALK = _walk(_WHY, _COMMITS, "here LIKE 'decision:%'", 3, "2100-01-01")

_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_ASKED = (
    BASE
    + """
, asked AS (
  SELECT unnest(['title', 'number', 'start', 'swapped']) || ':' || k AS question_id,
         unnest([title, '#' || k, trim(substr(title, 1, 12)), k || ' order ' || split_part(title, ' ', 1)]) AS question
  FROM (SELECT arg_min(title, k) AS title, min(k) AS k FROM art GROUP BY g, split_part(title, ' order ', 1))
), q AS (SELECT *, """
    + _GRAMS.format("question")
    + """ AS qg FROM asked), n AS (SELECT k, title, """
    + _GRAMS.format("title")
    + """ AS ng FROM art
), hit AS (
  SELECT question_id, k, 0 AS tier, 'exact' AS match, 1.0::DOUBLE AS score FROM q JOIN n ON lower(title) = lower(question)
  UNION ALL SELECT question_id, k, 1, 'identifier', 0.95::DOUBLE FROM q JOIN n ON k::VARCHAR = ltrim(question, '#')
  UNION ALL SELECT question_id, k, 2, 'prefix', 0.75::DOUBLE FROM q JOIN n ON title ILIKE question || '%'
  UNION ALL SELECT question_id, k, 3, 'fuzzy', s::DOUBLE FROM (
    SELECT question_id, k, (i / (len(qg) + len(ng) - i))::FLOAT AS s FROM (SELECT question_id, k, qg, ng, len(list_intersect(qg, ng)) AS i FROM q, n)) WHERE s >= 0.25::FLOAT
), one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY question_id, k ORDER BY score DESC, tier) = 1
), top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, tier, k) AS rank FROM one)
"""
)

_GATED = (
    BASE
    + """
, prop AS (
  SELECT event_id AS pos, event_id % n AS s, (event_id * 7 + 3) % n AS d, event_id * 37 % 1000 AS rel FROM events, (SELECT count(*) AS n FROM orders)
), linked AS (
  SELECT prop.* FROM prop JOIN ord a ON a.k = prop.s JOIN ord b ON b.k = prop.d
), opn AS (
  SELECT *, row_number() OVER (ORDER BY pos) AS i FROM linked WHERE rel >= 750 AND s <> d
), row_by_row(i, ends, pairs, outcome) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], ''
  UNION ALL
  SELECT i, CASE WHEN o = 'accepted' THEN list_concat(ends, [s, d]) ELSE ends END, CASE WHEN o = 'accepted' THEN list_append(pairs, s || '-' || d) ELSE pairs END, o FROM (
    SELECT opn.i, ends, pairs, s::BIGINT AS s, d::BIGINT AS d, CASE WHEN list_contains(pairs, s || '-' || d) THEN 'invalid'
      WHEN len(list_filter(ends, lambda x: x = s)) >= 4 OR len(list_filter(ends, lambda x: x = d)) >= 4 THEN 'rejected_cap' ELSE 'accepted' END AS o
    FROM row_by_row JOIN opn ON opn.i = row_by_row.i + 1)
), gated AS (
  SELECT b.pos, b.s, b.d, CASE WHEN b.s = b.d THEN 'invalid' WHEN b.rel < 750 THEN 'rejected_threshold' ELSE r.outcome END AS outcome
  FROM linked b LEFT JOIN opn USING (pos) LEFT JOIN row_by_row r ON r.i = opn.i
)"""
)
#: Faults planted by the numbers of orders: how many each rule must find.
_FAULTS = """
SELECT unnest(['a repository belongs to none', 'node identity is unique', 'node ids are unique', 'team names are unique', 'no edge to itself', 'one current edge a pair and type', 'tag and tier agree', 'edges end after they begin',
  'edges have both ends', 'edge types, tags and tiers are known', 'relevance is a share', 'inferred edges have a relevance', 'resolution has its time and its edge', 'one open reference a source, number and type',
  'artifacts have their node', 'logins are unique', 'repository names are unique', 'explicit decisions have an artifact']) AS rule,
  unnest([(SELECT count(*) FROM region), n(100), n(100), (SELECT count(*) FROM own), n(200), n(50), n(50), n(70), n(90), n(90), n(110), n(130), (SELECT count(*) FROM pend WHERE n % 7 = 0), (SELECT count(*) FROM pend WHERE n % 7 = 1),
  n(300), (SELECT count(*) FROM who WHERE login LIKE '%7'), (SELECT count(*) FROM region WHERE r_regionkey < 2), (SELECT count(*) FROM decn WHERE tag IS NOT NULL)]) AS violations
UNION ALL SELECT unnest(['a decision''s key names its repository', 'node types are known', 'reconstructed decisions pass the rubric', 'decision statuses are known', 'one decision a thread', 'decisions'' artifacts exist',
  'references have a source', 'decisions are decision nodes']), 0"""
for _n in (50, 70, 90, 100, 110, 130, 200, 300):
    _FAULTS = _FAULTS.replace(f"n({_n})", f"(SELECT count(*) FROM art WHERE k % {_n} = 0)")

ORACLE_SQL = {
    "inferred_gate": _GATED + "SELECT pos, s AS src_key, d AS dst_key, outcome FROM gated",
    "answers_with_fallback": _GATED + f"""
, direct AS (
  SELECT node, count(*) AS paths FROM (SELECT src AS node FROM edg WHERE type IN ({_IMPACT}) UNION ALL SELECT dst FROM edg WHERE type IN ({_IMPACT})) GROUP BY node
), bridge AS (
  SELECT k, count(*) AS paths FROM (SELECT s AS k FROM gated WHERE outcome = 'accepted' UNION ALL SELECT d FROM gated WHERE outcome = 'accepted') GROUP BY k
), found AS (
  SELECT art.node AS start, direct.paths AS explicit_paths, CASE WHEN direct.paths IS NULL THEN bridge.paths END AS wider FROM art LEFT JOIN direct USING (node) LEFT JOIN bridge USING (k) WHERE is_issue
)
SELECT start, coalesce(explicit_paths, wider) IS NOT NULL AS answered, explicit_paths IS NULL AS used_inferred_fallback, coalesce(explicit_paths, wider, 0) AS paths,
  CASE WHEN explicit_paths IS NOT NULL THEN explicit_paths || ' explicit path(s) found; inferred edges not consulted'
       WHEN wider IS NOT NULL THEN 'no explicit path existed; ' || wider || ' path(s) found only by admitting inferred edges' ELSE 'no path found, explicit or inferred' END AS explanation FROM found""",
    "planted_violations": BASE + """
, who AS (
  SELECT DISTINCT 'cust' || c AS login FROM art UNION SELECT DISTINCT 'supp' || s FROM rev UNION SELECT 'supp' || s FROM own WHERE s IS NOT NULL
)""" + _FAULTS,
    "nodes_by_type": BASE + """
SELECT node_type, count(*) AS n FROM (
  SELECT CASE WHEN is_issue THEN 'issue' ELSE 'pull_request' END AS node_type FROM art UNION ALL SELECT 'commit' FROM comm
  UNION ALL SELECT 'repository' FROM region UNION ALL SELECT 'release' FROM (SELECT DISTINCT g, tag FROM dep) UNION ALL SELECT 'decision' FROM decn
  UNION ALL SELECT 'codeowners_scope' FROM own UNION ALL SELECT 'team' FROM own
  UNION ALL SELECT 'person' FROM (SELECT DISTINCT 'cust' || c FROM art UNION SELECT DISTINCT 'supp' || s FROM rev UNION SELECT 'supp' || s FROM own WHERE s IS NOT NULL)
) GROUP BY node_type""",
    "status_by_repo": BASE + """
SELECT 'org/region' || r_regionkey AS repo,
  (SELECT count(*) FROM art WHERE g = r_regionkey AND is_issue) AS issues, (SELECT count(*) FROM art WHERE g = r_regionkey AND NOT is_issue) AS pull_requests,
  (SELECT count(*) FROM comm WHERE g = r_regionkey) AS commits, (SELECT count(DISTINCT tag) FROM dep WHERE g = r_regionkey) AS releases,
  (SELECT count(*) FROM decn WHERE g = r_regionkey) AS decisions, 0::BIGINT AS people FROM region
UNION ALL SELECT '(people)', 0, 0, 0, 0, 0, count(*) FROM (SELECT DISTINCT 'cust' || c FROM art UNION SELECT DISTINCT 'supp' || s FROM rev UNION SELECT 'supp' || s FROM own WHERE s IS NOT NULL)""",
    "edges_by_type": BASE + """
SELECT edge_type, extractor, count(*) AS n, min(vf) AS first, max(vf) AS last FROM (
  SELECT t AS edge_type, x AS extractor, d AS vf FROM res UNION ALL SELECT 'created', 'issue_author', d FROM art UNION ALL SELECT 'implements', 'pr_commit_list', TIMESTAMP '1995-01-01' FROM comm
  UNION ALL SELECT 'reviewed', 'pr_review', seen FROM rev UNION ALL SELECT 'deployed_by', 'release_notes_reference', strptime(tag || '-01', '%Y-%m-%d') FROM dep
  UNION ALL SELECT 'owns', 'codeowners_parse', TIMESTAMP '1995-01-01' FROM own UNION ALL SELECT 'owns', 'codeowners_parse', TIMESTAMP '1995-01-01' FROM own WHERE s IS NOT NULL
) GROUP BY ALL""",
    "closing_refs": BASE + "SELECT k, n AS ref_number FROM closing",
    "mentioned_refs": BASE + "SELECT k, n AS ref_number FROM mention",
    "foreign_url_refs": BASE + "SELECT DISTINCT k, slug || '#' || n AS ref FROM urls WHERE lower(slug) <> 'org/region' || g",
    "commit_mentions": r"SELECT doc_id, sha FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\b([0-9a-f]{40})\b', 1)) AS sha FROM documents)",
    "owner_edges": BASE + "SELECT 'team:org/nation' || nk AS owner, pattern AS path_pattern, ref AS source_ref FROM own UNION ALL SELECT 'person:supp' || s, pattern, ref FROM own WHERE s IS NOT NULL",
    "resolved_edges": BASE + "SELECT src, dst, t AS edge_type, x AS extractor, d AS valid_from FROM res",
    "pending_refs": BASE + "SELECT pend.g AS repo_id, node AS src, n AS ref_number, t AS edge_type FROM pend JOIN art USING (k)",
    "pending_status": BASE + "SELECT g AS repo_id, t AS edge_type, count(*) AS open_refs, 0::BIGINT AS resolvable_now, count(*) AS target_outside_window, 0::INT AS max_attempts FROM pend GROUP BY ALL",
    "threads": BASE + "SELECT node, th AS thread_key FROM art JOIN thr USING (k) UNION ALL SELECT 'commit:c-' || k || '-' || ln, th FROM comm JOIN thr USING (k)",
    "decision_candidates": BASE + "SELECT g AS repo_id, th AS thread_key, implementer, motivator, title, decided_at FROM cand",
    "synthesis_outcomes": BASE + """
SELECT th AS thread_key, CASE WHEN th IN (FROM land) THEN 'created' ELSE 'refused' END AS outcome,
       CASE WHEN th IN (FROM land) THEN '' ELSE 'clause 2: nothing in thread ' || th || ' was ever merged' END AS reason FROM cand""",
    "rubric_audit": BASE + """
SELECT th AS cluster_thread_key, title, CASE WHEN tag IS NULL THEN 'reconstructed' ELSE 'explicit' END AS status,
       true AS has_motivation, true AS has_implementation, true AS has_validation, true AS passes FROM decn""",
    "decisions_explicit": BASE + "SELECT th AS thread_key, CASE WHEN tag IS NULL THEN 'reconstructed' ELSE 'explicit' END AS status, coalesce('release:' || tag, '') AS artifact FROM decn",
    "thread_categories": BASE + "SELECT th AS thread_key, declared, structural, attested, published, category_count, category_count >= 3 AS corroborates FROM sigs",
    "edge_tiers": BASE + """
SELECT edge_type, tier, count(*) AS edges FROM (
  SELECT type AS edge_type, ['explicit', 'corroborated'][tier + 1] AS tier FROM edg WHERE type NOT IN ('motivated_by', 'implemented_by') AND src NOT LIKE 'decision:%'
  UNION ALL SELECT 'reviewed', CASE WHEN th IN (FROM lift) THEN 'corroborated' ELSE 'explicit' END FROM rev JOIN thr USING (k)
  UNION ALL SELECT 'created', 'explicit' FROM art UNION ALL SELECT 'owns', 'explicit' FROM own UNION ALL SELECT 'owns', 'explicit' FROM own WHERE s IS NOT NULL
) GROUP BY ALL""",
    "walk_why": _WHY_WALK,
    "walk_impact": _walk(_IMPACT, _ISSUES, "true", 2, "2100-01-01"),
    "walk_as_of": _walk(_IMPACT, _ISSUES, "true", 2, "1997-01-01"),
    "walk_instants": _walk_instants(_IMPACT, ("1994-06-01", "1996-06-01", "2100-01-01")),
    "retrieve_candidates": _ASKED + "SELECT question_id, rank::INT AS rank, k::VARCHAR AS external_id, match, round(score, 5) AS score FROM top WHERE rank <= 10",
    "contract_checks": _ASKED + """
SELECT split_part(question_id, ':', 1) AS kind,
       CASE split_part(question_id, ':', 1) WHEN 'number' THEN CASE WHEN n = 0 THEN 'HELD' ELSE 'VIOLATED: candidates were returned' END
         WHEN 'start' THEN CASE WHEN NOT sure THEN 'HELD' ELSE 'VIOLATED: an answer was returned' END WHEN 'swapped' THEN 'COMPARE' ELSE '' END AS contract_check, count(*) AS n
FROM (SELECT q.question_id, count(rank) AS n, coalesce(bool_or(score >= 0.95), false) AS sure FROM q LEFT JOIN top ON top.question_id = q.question_id AND rank <= 3 GROUP BY ALL) GROUP BY ALL""",
    "decision_credit": BASE + "SELECT th AS thread_key, 'implemented by PR ' || ik || CASE WHEN merged_at IS NULL THEN ', NOT MERGED' ELSE ', merged ' || strftime(merged_at, '%Y-%m-%d') END AS note FROM decn",
    "recall_buckets": BASE + "SELECT bucket, count(*) AS threads FROM buck GROUP BY bucket",
    "corpus_counts": BASE + """
SELECT g AS repo_id, count(*) AS threads, count_if(has_decision)::BIGINT AS decision_threads, count_if(NOT has_decision)::BIGINT AS non_decision_threads,
       sum(prs)::BIGINT AS pull_requests, sum(issues)::BIGINT AS issues, sum(commits)::BIGINT AS commits FROM fact GROUP BY g""",
    "cross_thread_closes": BASE + "SELECT count(*) AS cross_thread_closes FROM res JOIN thr a ON a.k = res.k JOIN thr b ON b.k = res.n WHERE t = 'closes' AND a.th IS DISTINCT FROM b.th",
    "unmerged_detail": BASE + """
SELECT th AS thread_key, (SELECT string_agg(art.k::VARCHAR, ',' ORDER BY art.k::VARCHAR) FROM art JOIN thr USING (k) WHERE thr.th = buck.th AND is_issue) AS issues, prs, commits
FROM buck WHERE bucket LIKE 'B%'""",
    "issueless_detail": BASE + r"""
SELECT (SELECT coalesce(sum(prs), 0)::BIGINT FROM buck WHERE NOT has_issue) AS prs, (SELECT coalesce(sum(commits), 0)::BIGINT FROM buck WHERE NOT has_issue) AS commits,
       count_if(regexp_matches(body, '(?i)(clos|fix|resolv)e[sd]?\s+#[0-9]+'))::BIGINT AS prs_with_closing_word, count_if(regexp_matches(body, '#[0-9]+'))::BIGINT AS prs_with_any_ref
FROM art JOIN thr USING (k) JOIN buck USING (th) WHERE NOT has_issue AND NOT is_issue""",
    "tier_tally": f"SELECT tier, count(*) AS paths FROM ({_WHY_WALK}) GROUP BY tier",
    "graph_totals": BASE + """
SELECT (SELECT count(*) FROM art) + (SELECT count(*) FROM comm) + (SELECT count(*) FROM region) + (SELECT count(*) FROM (SELECT DISTINCT g, tag FROM dep)) + (SELECT count(*) FROM decn) + 2 * (SELECT count(*) FROM own)
       + (SELECT count(*) FROM (SELECT DISTINCT 'cust' || c FROM art UNION SELECT DISTINCT 'supp' || s FROM rev UNION SELECT 'supp' || s FROM own WHERE s IS NOT NULL)) AS nodes,
       (SELECT count(*) FROM edg) + (SELECT count(*) FROM art) + (SELECT count(*) FROM rev) + (SELECT count(*) + count(s) FROM own) AS current_edges,
       (SELECT count(DISTINCT th) FROM thr) AS threads, (SELECT count(*) FROM decn) AS decisions""",
    "cursor_progress": """
SELECT resource, day, oldest, newest, max(newest) OVER (PARTITION BY resource ORDER BY day) AS watermark
FROM (SELECT event_type AS resource, ts::DATE AS day, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY ALL)""",
}
