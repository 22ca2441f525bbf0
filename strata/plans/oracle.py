"""DuckDB oracle SQL for the registered queries (same names, same columns)."""

from __future__ import annotations

from strata.plans import sql_fixtures as X

ORACLE: dict[str, str] = {}

FINDING_OUT = ("repo_id, rule_id, engine_source, file_path, line_number, severity, defect_family, message, "
               "code_snippet, issue_type, end_line, \"column\"")

ORACLE["scan_line_rules"] = X.with_ctes(
    X.files_cte(), X.scan_lines_cte(), X.raw_findings_cte(),
    body=f"SELECT {FINDING_OUT} FROM raw_findings WHERE engine_source = 'regex'")

ORACLE["dedupe_findings"] = X.with_ctes(*X.base_scan_ctes(), body=f"SELECT {FINDING_OUT} FROM findings")

ORACLE["health_score"] = X.with_ctes(*X.base_scan_ctes(), body=f"""
SELECT r.repo_id,
       CAST(greatest(0, least(100, trunc(100.0 - coalesce(p.pen, 0.0)))) AS INTEGER) AS health_score,
       CAST(coalesce(p.n, 0) AS BIGINT) AS total_issues
FROM (SELECT DISTINCT repo_id FROM files) r
LEFT JOIN (SELECT repo_id, sum({X.penalty_sql()}) AS pen, count(*) AS n FROM findings GROUP BY repo_id) p
  ON r.repo_id = p.repo_id""")

# ---------------------------------------------------------------------------
# 2.1 / 2.2  file tree, paths, languages
from strata import schemas as S  # noqa: E402

_F = [X.files_cte()]

ORACLE["scan_file_tree"] = X.with_ctes(*_F, body=f"""
SELECT repo_id, path, language, lines, size FROM files
WHERE NOT {X.skipped_dir_sql('path')} AND NOT {X.skipped_suffix_sql('path')} AND NOT {X.hidden_sql('path')}
  AND size <= {S.TREE_MAX_BYTES}""")
ORACLE["skip_dirs"] = X.with_ctes(*_F, body=f"SELECT repo_id, path FROM files WHERE NOT {X.skipped_dir_sql('path')}")
ORACLE["skip_extensions_hidden"] = X.with_ctes(*_F, body=f"""
SELECT repo_id, path FROM files WHERE NOT {X.skipped_suffix_sql('path')} AND NOT {X.hidden_sql('path')}""")
ORACLE["size_limit"] = X.with_ctes(*_F, body=f"""
SELECT repo_id, path, size FROM files WHERE size >= 1 AND size <= {S.AUTHORED_MAX_BYTES}""")
ORACLE["detect_language"] = X.with_ctes(*_F, body="SELECT repo_id, path, language FROM files")
ORACLE["scannable_filter"] = X.with_ctes(*_F, body=f"""
SELECT repo_id, path, language FROM files WHERE language IN {X.in_list(S.SCANNABLE_LANGUAGES)}""")
ORACLE["detect_binary"] = X.with_ctes(*_F, body="""
SELECT repo_id, path, contains(content, chr(0)) AND strlen(split_part(content, chr(0), 1)) < 512 AS is_binary FROM files""")
ORACLE["read_text_lossy"] = X.with_ctes(*_F, body="""
SELECT repo_id, path, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest
FROM (SELECT repo_id, path, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS t FROM files)""")
ORACLE["explode_lines"] = X.with_ctes(*_F, body=f"""
SELECT repo_id, path, CAST(i AS INTEGER) AS line_number, arr[i] AS line
FROM (SELECT repo_id, path, arr, unnest(generate_series(1, len(arr))) AS i
      FROM (SELECT repo_id, path, {X.split_lines_sql('content')} AS arr FROM files))""")
ORACLE["repo_storage_size"] = X.with_ctes(*_F, body="""
SELECT repo_id, CAST(sum(size) AS BIGINT) AS bytes, floor((sum(size) * 200 + 1048576) / (2 * 1048576)) / 100.0 AS mb
FROM files GROUP BY repo_id""")
ORACLE["language_stats"] = X.with_ctes(*_F, body="""
SELECT repo_id, language, count(*) AS file_count FROM files WHERE language <> 'plaintext' GROUP BY ALL""")
ORACLE["total_lines"] = X.with_ctes(*_F, body="""
SELECT repo_id, CAST(sum(lines) AS BIGINT) AS total_lines, count(*) AS file_count FROM files GROUP BY repo_id""")

_ISSUE_COUNTS = """file_counts AS (
  SELECT f.repo_id, f.path, CAST(coalesce(c.n, 0) AS BIGINT) AS issue_count
  FROM files f LEFT JOIN (SELECT repo_id, file_path, count(*) AS n FROM findings GROUP BY ALL) c
    ON f.repo_id = c.repo_id AND f.path = c.file_path
)"""
ORACLE["attach_issue_counts"] = X.with_ctes(*X.base_scan_ctes(), _ISSUE_COUNTS,
                                            body="SELECT repo_id, path, issue_count FROM file_counts")
ORACLE["directory_rollup"] = X.with_ctes(*X.base_scan_ctes(), _ISSUE_COUNTS, body="""
SELECT repo_id, directory, CAST(sum(issue_count) AS BIGINT) AS issue_count, count(*) AS file_count
FROM (SELECT repo_id, issue_count, array_to_string(parts[1:k], '/') AS directory
      FROM (SELECT repo_id, issue_count, parts, unnest(generate_series(1, len(parts) - 1)) AS k
            FROM (SELECT repo_id, issue_count, string_split(path, '/') AS parts FROM file_counts)))
GROUP BY ALL""")
ORACLE["code_snippet"] = X.with_ctes(*_F, body=f"""
SELECT repo_id, path, s.line AS line, s.stop AS "end",
       md5(array_to_string(arr[greatest(1, s.line - 1):least(len(arr), s.stop + 1)], chr(10))) AS snippet_md5
FROM (SELECT repo_id, path, arr, unnest([{{'line': 1, 'stop': 1}}, {{'line': mid, 'stop': mid}}, {{'line': n, 'stop': n}},
                                         {{'line': mid, 'stop': n}}]) AS s
      FROM (SELECT repo_id, path, arr, CAST(len(arr) AS INTEGER) AS n, CAST(floor((len(arr) + 1) / 2) AS INTEGER) AS mid
            FROM (SELECT repo_id, path, {X.split_lines_sql('content')} AS arr FROM files) WHERE len(arr) > 0))""")
ORACLE["clip_diff"] = """
SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:30], chr(10))) AS clip30,
       md5(substring(text, 1, 500)) AS clip500,
       md5(array_to_string(CASE WHEN len(string_split(text, chr(10))) > 15
                                THEN string_split(text, chr(10))[len(string_split(text, chr(10))) - 14:]
                                ELSE string_split(text, chr(10)) END, chr(10))) AS last15
FROM documents"""
ORACLE["normalize_repo_url"] = """
SELECT page_id, u AS url,
       regexp_matches(u, '^https?://github\\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$') AS is_valid,
       CASE WHEN len(string_split(u, '/')) >= 2
            THEN string_split(u, '/')[-2] || '/' || string_split(u, '/')[-1] ELSE string_split(u, '/')[-1] END AS repo_name
FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', '') AS u FROM pages)"""

# ---------------------------------------------------------------------------
# 2.4 / 2.5 / 2.6  blame and history
_B = [X.files_cte(), X.blame_lines_cte()]
_AT = X.base_scan_ctes() + [X.blame_lines_cte(), X.attributed_cte()]

ORACLE["expand_blame"] = X.with_ctes(*_B, body=f"""
SELECT repo_id, file_path, line_number, author_name, author_email, "commit", {X.iso_sql('ts')} AS date, content
FROM blame_lines""")
ORACLE["attribute_issues"] = X.with_ctes(*_AT, body="""
SELECT repo_id, file_path, line_number, rule_id, severity, origin_author_name, origin_author_email, origin_author,
       origin_commit, origin_date FROM attributed""")
ORACLE["trace_line_origin"] = X.with_ctes(*X.base_scan_ctes(), X.blame_lines_cte(), X.part_commits_cte(), body=f"""
SELECT f.repo_id, f.file_path, f.line_number, f.rule_id, substring(b."commit", 1, 8) AS origin_commit,
       b.author_name || ' <' || b.author_email || '>' AS origin_author, {X.iso_sql('b.ts')} AS origin_date,
       c.author AS commit_author, string_split(trim(c.message), chr(10))[1] AS summary
FROM findings f JOIN blame_lines b ON f.repo_id = b.repo_id AND f.file_path = b.file_path AND f.line_number = b.line_number
JOIN part_commits c ON b."commit" = c."commit\"""")
ORACLE["blame_authors"] = X.with_ctes(*_B, body=f"""
SELECT repo_id, file_path, author, lines, commits,
       {X.pct_1dp_sql('lines', 'greatest(total, 1)')} AS percentage,
       row_number() OVER (PARTITION BY repo_id, file_path ORDER BY lines DESC, first_line) AS rank
FROM (SELECT repo_id, file_path, author, lines, commits, first_line,
             sum(lines) OVER (PARTITION BY repo_id, file_path) AS total
      FROM (SELECT repo_id, file_path, author_name || ' <' || author_email || '>' AS author,
                   count(*) AS lines, count(DISTINCT "commit") AS commits, min(line_number) AS first_line
            FROM blame_lines GROUP BY ALL))""")
ORACLE["contributor_stats"] = X.with_ctes(*_AT, body="""
SELECT repo_id, coalesce(origin_author_email, 'unknown@example.com') AS email,
       arg_min(coalesce(origin_author_name, 'Unknown'), (file_path, line_number, rule_id)) AS name, count(*) AS count
FROM attributed GROUP BY ALL""")
ORACLE["contributor_fallback"] = X.with_ctes(*_AT, body="""
SELECT repo_id, email, name, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY count DESC, first) AS rank FROM (
    SELECT repo_id, coalesce(origin_author, 'Unknown') AS email,
           arg_min(trim(split_part(coalesce(origin_author, 'Unknown'), '<', 1)), (file_path, line_number, rule_id)) AS name,
           count(*) AS count, min((file_path, line_number, rule_id)) AS first
    FROM attributed GROUP BY ALL)) WHERE rank <= 10""")
ORACLE["issues_per_day"] = X.with_ctes(*_AT, body="""
SELECT repo_id, CAST(origin_ts AS DATE) AS day, count(*) AS issues FROM attributed WHERE origin_ts IS NOT NULL GROUP BY ALL""")

_C = [X.commits_cte()]
_NEWEST = """newest AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY ts DESC, "commit" DESC) AS rn FROM commits
)"""
ORACLE["commit_timeline"] = X.with_ctes(*_C, _NEWEST, body=f"""
SELECT repo_id, file_path, CAST(count(*) OVER (PARTITION BY repo_id, file_path) - rn + 1 AS INTEGER) AS position,
       substring("commit", 1, 8) AS commit_hash, author, {X.iso_sql('ts')} AS date,
       string_split(trim(message), chr(10))[1] AS message, insertions, deletions, insertions + deletions AS lines_changed
FROM newest WHERE rn <= 50""")
ORACLE["commit_timeline_meta"] = X.with_ctes(*_C, _NEWEST, body=f"""
SELECT repo_id, file_path, count(*) AS total_commits, count(DISTINCT author) AS total_authors,
       {X.iso_sql('min(ts)')} AS first_commit, {X.iso_sql('max(ts)')} AS last_commit
FROM newest WHERE rn <= 50 GROUP BY ALL""")
ORACLE["evolution_chain"] = X.with_ctes(*_C, _NEWEST, body="""
SELECT repo_id, file_path, CAST(rn AS INTEGER) AS step, substring("commit", 1, 8) AS commit_hash, author,
       string_split(trim(message), chr(10))[1] AS message,
       CASE WHEN rn = max(rn) OVER (PARTITION BY repo_id, file_path) THEN 'introduction'
            WHEN contains(lower(message), 'refactor') OR contains(lower(message), 'rename')
                 OR contains(lower(message), 'move') THEN 'refactor' ELSE 'modification' END AS change_type
FROM newest WHERE rn <= 20""")
ORACLE["line_history"] = X.with_ctes(*_C, _NEWEST, body="""
, blocks AS (
  SELECT *, 1 + (event_id * 7) % 40 AS o1, event_id % 3 AS ol1,
         (event_id // 3) % 3 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS nl1,
         (event_id // 9) % 2 AS ol2, (event_id // 18) % 4 AS nl2
  FROM (SELECT 'src/file_' || json_extract_string(props, '$.k') || '.py' AS file_path, event_id, ts,
               lpad(upper(hex(event_id)), 40, '0') AS "commit", json_extract_string(props, '$.k') AS k FROM events)
  WHERE k NOT LIKE '%7'),
maps AS (
  SELECT file_path, "commit", row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, "commit" DESC) AS seq,
         o1, ol1, nl1, ol2, nl2, o1 + ol1 + 4 + event_id % 11 AS o2, o1 AS n1, o1 + 4 + event_id % 11 + nl1 AS n2
  FROM blocks),
asked AS (
  SELECT DISTINCT 'src/file_' || json_extract_string(props, '$.k') || '.py' AS file_path, event_id % 60 + 1 AS line_number FROM events),
walk AS (
  WITH RECURSIVE w AS (
    SELECT file_path, line_number, line_number AS cur, 0::BIGINT AS seq, 0::BIGINT AS step, false AS hit, false AS made,
           NULL::VARCHAR AS "commit", NULL::BIGINT AS line_at
    FROM asked
    UNION ALL
    SELECT file_path, line_number,
           CASE WHEN hit1 THEN o1 + least(cur - n1, ol1 - 1) WHEN hit2 THEN o2 + least(cur - n2, ol2 - 1)
                WHEN cur < n1 THEN cur WHEN cur < n2 THEN cur + ol1 - nl1 ELSE cur + ol1 - nl1 + ol2 - nl2 END AS cur,
           seq, step + CASE WHEN hit1 OR hit2 THEN 1 ELSE 0 END AS step, hit1 OR hit2 AS hit,
           (hit1 AND ol1 = 0) OR (hit2 AND ol2 = 0) AS made, "commit", cur AS line_at
    FROM (SELECT w.file_path, w.line_number, w.cur, w.step, m.* EXCLUDE (file_path),
                 w.cur >= n1 AND w.cur < n1 + nl1 AS hit1, w.cur >= n2 AND w.cur < n2 + nl2 AS hit2
          FROM w JOIN maps m ON m.file_path = w.file_path AND m.seq = w.seq + 1
          WHERE NOT w.made AND w.step < 20))
  SELECT * FROM w WHERE hit),
by_line AS (
  SELECT c.repo_id, w.file_path, w.line_number, CAST(w.step AS INTEGER) AS step, substring(w."commit", 1, 8) AS commit_hash, c.author,
         string_split(trim(c.message), chr(10))[1] AS message, lower(c.message) AS low,
         w.step = max(w.step) OVER (PARTITION BY w.file_path, w.line_number) AS is_last, w.line_at
  FROM walk w JOIN commits c ON c."commit" = w."commit" AND c.file_path = w.file_path),
chain AS (
  SELECT repo_id, file_path, CAST(rn AS INTEGER) AS step, substring("commit", 1, 8) AS commit_hash, author,
         string_split(trim(message), chr(10))[1] AS message, lower(message) AS low,
         rn = max(rn) OVER (PARTITION BY repo_id, file_path) AS is_last
  FROM newest WHERE rn <= 20),
everything AS (
  SELECT repo_id, file_path, line_number, step, commit_hash, author, message, low, is_last, 'line' AS source, line_at FROM by_line
  UNION ALL
  SELECT c.repo_id, c.file_path, a.line_number, c.step, c.commit_hash, c.author, c.message, c.low, c.is_last, 'file', NULL
  FROM asked a JOIN chain c ON a.file_path = c.file_path
  WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.file_path = a.file_path AND w.line_number = a.line_number))
SELECT repo_id, file_path, line_number, step, commit_hash, author, message,
       CASE WHEN is_last THEN 'introduction'
            WHEN contains(low, 'refactor') OR contains(low, 'rename') OR contains(low, 'move') THEN 'refactor'
            ELSE 'modification' END AS change_type, source, line_at
FROM everything""")
ORACLE["parse_commit_log"] = X.with_ctes(*_C, body="""
SELECT repo_id, file_path, CAST(row_number() OVER (PARTITION BY repo_id, file_path ORDER BY ts DESC, "commit" DESC) - 1 AS INTEGER) AS seq,
       "commit" AS full_hash, substring("commit", 1, 8) AS commit_hash,
       author || '@example.com <' || author || '@example.com>' AS author,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
       trim(CASE WHEN deletions = 0 THEN message || ' | extra' ELSE message END) AS message,
       array_to_string(CASE WHEN len(d) > 15 THEN d[len(d) - 14:] ELSE d END, chr(10)) AS diff
FROM (SELECT *, list_concat([' context'], list_transform(range(1, CAST(abs(insertions) % 20 + 2 AS BIGINT)), lambda i: '+add ' || CAST(i AS VARCHAR))) AS d
      FROM commits)""")

# ---------------------------------------------------------------------------
# findings roll-ups, ranking, ids, grades, external ingest, prompts
from strata import fixtures as FX  # noqa: E402
from strata.operators.ranking import DISPLAY_ORDER  # noqa: E402
from strata.operators.prompts import RESPONSE_DEFAULTS  # noqa: E402

_FD = X.base_scan_ctes()


def _disp(expr, unknown):
    whens = " ".join(f"WHEN {expr} = {X.q(s)} THEN {i}" for i, s in enumerate(DISPLAY_ORDER))
    return f"(CASE {whens} ELSE {unknown} END)"


_SEV_COLS = ", ".join(f"count(*) FILTER (WHERE coalesce(severity, 'medium') = {X.q(s)}) AS {s}"
                      for s in reversed(S.SEVERITY_ORDER))
_SEV_ZERO = ", ".join(f"CAST(coalesce(s.{c}, 0) AS BIGINT) AS {c}" for c in reversed(S.SEVERITY_ORDER))
ORACLE["severity_summary"] = X.with_ctes(*_FD, body=f"""
SELECT r.repo_id, {_SEV_ZERO}
FROM (SELECT DISTINCT repo_id FROM files) r
LEFT JOIN (SELECT repo_id, {_SEV_COLS} FROM findings GROUP BY repo_id) s ON r.repo_id = s.repo_id""")
ORACLE["severity_breakdown_pct"] = X.with_ctes(*_FD, body=f"""
SELECT coalesce(d.repo_id, c.repo_id) AS repo_id, coalesce(d.severity, c.severity) AS severity,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count,
       CAST(floor(coalesce(c.count, 0) / greatest(coalesce(t.total, 0), 1) * 100) AS INTEGER) AS pct
FROM (SELECT repo_id, unnest({X.str_list(list(reversed(S.SEVERITY_ORDER)))}) AS severity
      FROM (SELECT DISTINCT repo_id FROM files)) d
FULL OUTER JOIN (SELECT repo_id, coalesce(severity, 'info') AS severity, count(*) AS count FROM findings GROUP BY ALL) c
  ON d.repo_id = c.repo_id AND d.severity = c.severity
LEFT JOIN (SELECT repo_id, count(*) AS total FROM findings GROUP BY repo_id) t
  ON t.repo_id = coalesce(d.repo_id, c.repo_id)""")
_HOT = f"""hot AS (
  SELECT repo_id, family, count, total,
         row_number() OVER (PARTITION BY repo_id ORDER BY count DESC, first) AS rank
  FROM (SELECT repo_id, family, count, first, sum(count) OVER (PARTITION BY repo_id) AS total
        FROM (SELECT repo_id, CASE WHEN coalesce(defect_family, '') = '' THEN 'unknown' ELSE defect_family END AS family,
                     count(*) AS count,
                     min(({_disp("coalesce(severity, 'info')", 99)}, file_path, line_number, rule_id)) AS first
              FROM findings GROUP BY ALL))
)"""
ORACLE["family_hotspots"] = X.with_ctes(*_FD, _HOT, body=f"""
SELECT repo_id, family, count, CAST(floor(count / greatest(total, 1) * 100) AS INTEGER) AS pct, rank
FROM hot WHERE rank <= 8""")
ORACLE["top_counts"] = """
SELECT user_id, value, count, rank FROM (
  SELECT user_id, value, count, row_number() OVER (PARTITION BY user_id ORDER BY count DESC, first) AS rank
  FROM (SELECT user_id, trim(CAST(event_type AS VARCHAR)) AS value, count(*) AS count, min(event_id) AS first
        FROM events WHERE trim(CAST(event_type AS VARCHAR)) <> '' GROUP BY ALL)) WHERE rank <= 3"""
ORACLE["issues_by_file"] = X.with_ctes(*_FD, body=f"""
SELECT repo_id, file_path, count(*) AS issue_count, max({X.sev_rank_sql('severity', -1)}) AS max_rank,
       string_agg(CAST(line_number AS VARCHAR) || ':' || rule_id, ',' ORDER BY line_number, rule_id) AS issues
FROM findings GROUP BY ALL""")
ORACLE["issues_by_file_parts"] = X.with_ctes(*_FD, body="""
SELECT repo_id, file_path, part, min(n) AS first, string_agg(CAST(line_number AS VARCHAR) || ':' || rule_id, ',' ORDER BY n) AS issues
FROM (SELECT *, (n - 1) // 2 AS part
      FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY line_number, rule_id) AS n FROM findings))
GROUP BY repo_id, file_path, part""")
ORACLE["issue_identity"] = X.with_ctes(*_FD, body=f"""
SELECT repo_id, file_path, line_number, rule_id,
       'issue_' || CAST(row_number() OVER (PARTITION BY repo_id ORDER BY file_path, {X.sev_rank_sql('severity')} DESC,
                        engine_order, rule_id, line_number, end_line) - 1 AS VARCHAR)
       || '_' || substring(md5(file_path || CAST(line_number AS VARCHAR) || rule_id), 1, 8) AS id
FROM findings""")
_HS = f"""hs AS (
  SELECT r.repo_id, CAST(greatest(0, least(100, trunc(100.0 - coalesce(p.pen, 0.0)))) AS INTEGER) AS health_score,
         CAST(coalesce(p.n, 0) AS BIGINT) AS total_issues
  FROM (SELECT DISTINCT repo_id FROM files) r
  LEFT JOIN (SELECT repo_id, sum({X.penalty_sql()}) AS pen, count(*) AS n FROM findings GROUP BY repo_id) p ON r.repo_id = p.repo_id
),
ss AS (SELECT repo_id, {_SEV_COLS} FROM findings GROUP BY repo_id)"""
_GRADE = ("CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 80 THEN 'B' WHEN health_score >= 70 THEN 'C' "
          "WHEN health_score >= 60 THEN 'D' ELSE 'F' END")
_RISK = ("CASE WHEN coalesce(blocker, 0) > 0 THEN 'Blocker risks present' WHEN coalesce(critical, 0) > 0 THEN 'Critical risks present' "
         "WHEN coalesce(high, 0) > 0 THEN 'High-risk issues detected' WHEN coalesce(medium, 0) > 0 THEN 'Moderate-risk issues' "
         "ELSE 'Low overall risk' END")
ORACLE["health_grade_risk"] = X.with_ctes(*_FD, _HS, body=f"""
SELECT hs.repo_id, health_score, {_GRADE} AS grade, {_RISK} AS risk,
       CASE WHEN health_score >= 80 THEN 'green' WHEN health_score >= 60 THEN 'yellow' WHEN health_score >= 40 THEN 'orange' ELSE 'red' END AS report_band,
       CASE WHEN health_score >= 90 THEN 'excellent' WHEN health_score >= 70 THEN 'good' WHEN health_score >= 50 THEN 'fair'
            WHEN health_score >= 30 THEN 'poor' ELSE 'critical' END AS ui_band
FROM hs LEFT JOIN ss ON hs.repo_id = ss.repo_id""")
ORACLE["executive_summary"] = X.with_ctes(*_FD, _HS, _HOT, body=f"""
SELECT hs.repo_id, health_score, {_GRADE} AS grade, total_issues, tl.file_count, tl.total_lines, {_RISK} AS risk,
       coalesce(hot.family, 'none') AS top_family, coalesce(tlang.top_languages, '') AS top_languages
FROM hs LEFT JOIN ss ON hs.repo_id = ss.repo_id
LEFT JOIN hot ON hs.repo_id = hot.repo_id AND hot.rank = 1
LEFT JOIN (SELECT repo_id, string_agg(language, ',' ORDER BY r) AS top_languages FROM (
             SELECT repo_id, language, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) AS r
             FROM (SELECT repo_id, language, count(*) AS n FROM files WHERE language <> 'plaintext' GROUP BY ALL))
           WHERE r <= 3 GROUP BY repo_id) tlang ON hs.repo_id = tlang.repo_id
LEFT JOIN (SELECT repo_id, CAST(sum(lines) AS BIGINT) AS total_lines, count(*) AS file_count FROM files GROUP BY repo_id) tl
  ON hs.repo_id = tl.repo_id""")
ORACLE["search_issues"] = X.with_ctes(*_FD, body=f"""
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY {_disp("coalesce(severity, '')", 4)}, file_path, line_number, rule_id) AS position,
       file_path, line_number, rule_id, severity
FROM findings WHERE contains(lower(file_path), 'token') OR contains(lower(message), 'token')
   OR contains(lower(coalesce(defect_family, '')), 'token') OR contains(lower(coalesce(rule_id, '')), 'token')""")
ORACLE["search_issues_index"] = X.with_ctes(*_FD, body="""
, asked AS (
  SELECT DISTINCT query FROM (
    SELECT unnest([CAST(doc_id AS VARCHAR), '/' || CAST(doc_id AS VARCHAR) || '.P', lang || '/', 'L-' || lang[1:1], source[1:4]]) AS query FROM documents)
  WHERE query IS NOT NULL)
SELECT query, repo_id, file_path, line_number, rule_id FROM asked, findings
WHERE contains(lower(file_path), lower(query)) OR contains(lower(message), lower(query))
   OR contains(lower(defect_family), lower(query)) OR contains(lower(rule_id), lower(query))""")
ORACLE["top_issues"] = X.with_ctes(*_FD, body=f"""
SELECT repo_id, rank, file_path, line_number, rule_id, severity, greatest(n - 2, 0) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_disp("coalesce(severity, 'info')", 99)}, file_path, line_number, rule_id) AS rank,
         count(*) OVER (PARTITION BY repo_id) AS n FROM findings) WHERE rank <= 2""")
ORACLE["representative_issues"] = X.with_ctes(*_FD, body=f"""
SELECT repo_id, position, file, line, severity, shown AS family, rule_id, substring(msg, 1, 180) AS message FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY rk, family, file, line, rule_id, msg) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, family, file, line, msg ORDER BY rk, family, file, line, rule_id, msg) AS k
    FROM (SELECT repo_id, {_disp("coalesce(severity, 'info')", 4)} AS rk, coalesce(defect_family, '') AS family,
                 coalesce(defect_family, 'unknown') AS shown, coalesce(file_path, '') AS file, coalesce(line_number, 0) AS line, coalesce(message, '') AS msg,
                 coalesce(severity, 'low') AS severity, coalesce(rule_id, '') AS rule_id FROM findings))
  WHERE k = 1) WHERE position <= 3""")


def _family_cascade_sql(text):
    out = "CASE"
    for family, any_of, all_of in S.FAMILY_KEYWORDS:
        if any_of:
            cond = " OR ".join(f"contains({text}, {X.q(k)})" for k in any_of)
        else:
            cond = " AND ".join(f"contains({text}, {X.q(k)})" for k in all_of)
        out += f" WHEN {cond} THEN {X.q(family)}"
    return out + f" ELSE {X.q(S.DEFAULT_FAMILY)} END"


_CAT = "CASE " + " ".join(f"WHEN event_type = {X.q(et)} THEN {X.q(c)}" for et, c in FX.EXTERNAL_CATEGORIES) + " ELSE 'none' END"
_SEVW = "CASE " + " ".join(f"WHEN sev_word = {X.q(k)} THEN {X.q(v)}" for k, v in S.EXTERNAL_SEVERITY.items()) + " ELSE 'medium' END"
_EXT = f"""ext AS (
  SELECT repo_id, rule_id, file_path, line_number, has_rule, event_type, k,
         CASE WHEN has_rule THEN 'critical' ELSE {_SEVW} END AS severity,
         CASE WHEN has_rule THEN 'injection' ELSE {_family_cascade_sql("lower(rule_id || ' ' || category)")} END AS defect_family,
         CASE WHEN has_rule THEN 'EXT-ERROR-EVENT matched' ELSE event_type || ' seen' END AS message,
         CAST(NULL AS VARCHAR) AS fix_hint,
         CASE WHEN has_rule THEN NULL ELSE 'CWE-' || k END AS cwe_id, CAST(NULL AS VARCHAR) AS owasp_ref,
         'x = ' || k AS code_snippet,
         replace(string_split(rule_id, '.')[-1], '_', '-') AS issue_type
  FROM (SELECT 'user' || CAST(user_id AS VARCHAR) AS repo_id, event_type, json_extract_string(props, '$.k') AS k,
               event_type = 'error' AS has_rule,
               CASE WHEN event_type = 'error' THEN 'EXT-ERROR-EVENT'
                    ELSE 'lang.security.' || event_type || '.check_' || json_extract_string(props, '$.k') END AS rule_id,
               'src/file_' || json_extract_string(props, '$.k') || '.py' AS file_path,
               CAST(event_id % 50 AS INTEGER) AS line_number,
               ['ERROR', 'WARNING', 'INFO', ''][CAST(event_id % 4 + 1 AS INTEGER)] AS sev_word,
               {_CAT} AS category
        FROM events)
)"""
ORACLE["ingest_external_findings"] = X.with_ctes(_EXT, body="""
SELECT repo_id, rule_id, 'external' AS engine_source, file_path, line_number, severity, defect_family, message, fix_hint,
       cwe_id, owasp_ref, code_snippet, issue_type, line_number AS end_line, 3 AS "column" FROM ext""")
_WORDS = f"""words AS (
  SELECT event_id, {X.str_list(FX.SCANNER_WORDS)}[CAST(event_id % {len(FX.SCANNER_WORDS)} + 1 AS INTEGER)] AS word,
         {X.str_list(FX.SCANNER_CHECKS)}[CAST(event_id % {len(FX.SCANNER_CHECKS)} + 1 AS INTEGER)] AS check_id,
         {X.str_list(FX.SCANNER_CATEGORIES)}[CAST(floor(event_id / 13) % {len(FX.SCANNER_CATEGORIES)} + 1 AS INTEGER)] AS category
  FROM events)"""
ORACLE["map_external_severity"] = X.with_ctes(_WORDS, body="""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'blocker' ELSE
  CASE upper(word) WHEN 'ERROR' THEN 'high' WHEN 'WARNING' THEN 'medium' WHEN 'INFO' THEN 'info' ELSE 'medium' END END AS severity
FROM words""")
ORACLE["classify_defect_family"] = X.with_ctes(_WORDS, body=f"""
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'auth'
  ELSE {_family_cascade_sql("lower(check_id || ' ' || coalesce(category, ''))")} END AS defect_family
FROM words""")
ORACLE["rule_metadata_override"] = X.with_ctes(_EXT, body="""
SELECT repo_id, rule_id, line_number, message, cwe_id, owasp_ref, fix_hint FROM ext""")

_PL = S.FIX_PROMPT_LABELS
_PROMPT = (f"concat_ws(chr(10), {X.q(_PL['family'])} || f.defect_family, {X.q(_PL['language'])} || l.language, "
           f"CASE WHEN coalesce(f.file_path, '') <> '' THEN {X.q(_PL['file'])} || f.file_path END, "
           f"{X.q(_PL['flagged'])} || '```' || l.language || chr(10) || f.code_snippet || chr(10) || '```', "
           f"{X.q(S.FIX_PROMPT_CLOSING)})")
ORACLE["fix_prompts"] = X.with_ctes(*_FD, body=f"""
SELECT f.repo_id, f.file_path, f.line_number, f.rule_id, CASE WHEN why IS NULL THEN 'ok' ELSE 'rejected' END AS status,
       why AS reason, CASE WHEN why IS NULL THEN md5({_PROMPT}) END AS prompt_md5,
       CASE WHEN why IS NULL THEN CAST(length({_PROMPT}) AS INTEGER) END AS prompt_chars
FROM (SELECT *, CASE WHEN trim(coalesce(code_snippet, '')) = '' THEN {X.q(S.FIX_PROMPT_REJECTIONS['empty'])}
                     WHEN length(code_snippet) > 5000 THEN {X.q(S.FIX_PROMPT_REJECTIONS['too_long'])} END AS why
      FROM findings) f
JOIN (SELECT repo_id, path, coalesce(language, 'plaintext') AS language FROM files) l
  ON f.repo_id = l.repo_id AND f.file_path = l.path""")
_REQ = f"""req AS (
  SELECT substring(sha256('fix|' || arr[i] || '|secrets|' || lang), 1, 20) AS request_key, doc_id, i AS line_number
  FROM (SELECT doc_id, lang, arr, unnest(generate_series(1, len(arr))) AS i
        FROM (SELECT doc_id, lang, {X.split_lines_sql('text')} AS arr FROM documents))
)"""
ORACLE["request_dedupe"] = X.with_ctes(_REQ, body="""
SELECT request_key, requests, f[1] AS first_doc, CAST(f[2] AS INTEGER) AS first_line
FROM (SELECT request_key, count(*) AS requests, min([doc_id, line_number]) AS f FROM req GROUP BY request_key)""")
ORACLE["request_hit_rate"] = X.with_ctes(_REQ, body="""
SELECT total, distinct_keys, CASE WHEN total > 0 THEN floor(((total - distinct_keys) * 2000 + total) / (total * 2)) / 1000.0 ELSE 0.0 END AS hit_rate
FROM (SELECT count(*) AS total, count(DISTINCT request_key) AS distinct_keys FROM req)""")
ORACLE["request_cache_hits"] = """
WITH asked AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS t, concat_ws('|', CAST(user_id AS VARCHAR), event_type) AS k FROM events),
uses AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY t) AS p FROM asked),
distances AS (
  SELECT a.t, a.p, count(DISTINCT b.k) AS distance
  FROM uses a LEFT JOIN uses b ON b.t > a.p AND b.t < a.t GROUP BY a.t, a.p)
SELECT CAST(size AS BIGINT) AS size, count(*) AS requests, CAST(count(*) FILTER (WHERE p IS NOT NULL AND (size IS NULL OR distance < size)) AS BIGINT) AS hits,
       floor((count(*) FILTER (WHERE p IS NOT NULL AND (size IS NULL OR distance < size)) * 2000 + count(*)) / (count(*) * 2)) / 1000.0 AS hit_rate
FROM distances, (VALUES (1), (10), (100), (500), (NULL)) AS s(size) GROUP BY size
"""
ORACLE["parse_fix_responses"] = f"""
SELECT event_id,
       CASE WHEN bad THEN NULL ELSE event_type END AS root_cause,
       CASE WHEN bad THEN NULL ELSE {X.q(RESPONSE_DEFAULTS['fix_strategy'])} END AS fix_strategy,
       CASE WHEN bad THEN NULL ELSE 'p' || CAST(event_id AS VARCHAR) END AS code_patch,
       CASE WHEN bad THEN NULL ELSE greatest(0.0, least(1.0, CAST(printf('%.4f', value / 50) AS DOUBLE))) END AS confidence,
       CASE WHEN bad THEN NULL ELSE 2 END AS n_reasons,
       bad AS parse_error,
       NOT bad AND greatest(0.0, least(1.0, CAST(printf('%.4f', value / 50) AS DOUBLE))) > 0 AS reusable
FROM (SELECT *, event_id % 10 = 0 AS bad FROM events)"""

# ---------------------------------------------------------------------------
# 2.9 streaming operators (batch forms)
from strata.plans.queries import RATE_LIMIT_N  # noqa: E402

ORACLE["rate_limit"] = f"""
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
),
r(key, rn, request_id, admitted, state) AS (
  SELECT key, rn, request_id, {RATE_LIMIT_N} > 0, CASE WHEN {RATE_LIMIT_N} > 0 THEN [t] ELSE [] END FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.request_id,
         len(list_filter(r.state, lambda x: e.t - x < 3600000000)) < {RATE_LIMIT_N},
         CASE WHEN len(list_filter(r.state, lambda x: e.t - x < 3600000000)) < {RATE_LIMIT_N}
              THEN list_append(list_filter(r.state, lambda x: e.t - x < 3600000000), e.t)
              ELSE list_filter(r.state, lambda x: e.t - x < 3600000000) END
  FROM r JOIN ev e ON e.key = r.key AND e.rn = r.rn + 1
)
SELECT key, request_id, admitted FROM r"""

_PST = "CASE " + " ".join(f"WHEN event_type = {X.q(et)} THEN {X.q(st)}" for et, st in FX.PROGRESS_STATUS) + " ELSE 'queued' END"
ORACLE["progress_state"] = f"""
SELECT analysis_id, l.status AS status, l.progress AS progress, l.message AS message,
       CASE WHEN coalesce(l.step, '') <> '' THEN l.step ELSE l.status END AS current_step, steps,
       l.status IN ('complete', 'failed') AS is_complete
FROM (SELECT CAST(user_id AS VARCHAR) AS analysis_id,
             arg_max({{'status': {_PST}, 'progress': CAST(floor(greatest(0.0, least(100.0, value))) AS INTEGER),
                      'message': event_type || ' #' || CAST(event_id AS VARCHAR),
                      'step': CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END}}, event_id) AS l,
             count(*) AS steps
      FROM events GROUP BY user_id)"""
ORACLE["progress_steps"] = f"""
SELECT CAST(user_id AS VARCHAR) AS analysis_id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS step,
       event_type || ' #' || CAST(event_id AS VARCHAR) AS message,
       CAST(floor(greatest(0.0, least(100.0, value))) AS INTEGER) AS progress, {X.iso_sql('ts')} AS timestamp
FROM events"""
# The state by event order: what each event sets, the last one that sets something counts.
ORACLE["assemble_chunks"] = """
WITH ev AS (
  SELECT conv_id AS id, turn AS seq, coalesce(text, '') AS t, text, (conv_id * 3 + turn) % 9 = 0 AS bad,
         CASE WHEN role = 'system' THEN 'unavailable' WHEN (conv_id * 3 + turn) % 11 = 5 THEN 'summary'
              WHEN (conv_id * 3 + turn) % 7 = 3 THEN 'complete' WHEN (conv_id * 3 + turn) % 29 = 8 THEN 'failed'
              ELSE 'chunk' END AS kind
  FROM conversations),
seen AS (
  SELECT *, max(CASE WHEN kind = 'summary' AND text IS NOT NULL THEN seq END) OVER w AS base,
         max(CASE WHEN kind IN ('summary', 'chunk') AND t <> '' THEN seq END) OVER w AS told
  FROM ev WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
sets AS (
  SELECT *, CASE WHEN kind = 'chunk' THEN 'streaming' WHEN kind IN ('unavailable', 'failed') THEN kind
                 WHEN kind = 'summary' AND bad THEN 'failed' WHEN kind = 'summary' AND t <> '' THEN 'complete'
                 WHEN kind = 'complete' AND told >= coalesce(base, told) THEN 'complete' END AS status,
         max(CASE WHEN kind = 'summary' AND text IS NOT NULL THEN seq END) OVER (PARTITION BY id) AS last_base
  FROM seen)
SELECT id AS analysis_id, md5(s) AS summary_md5, CAST(length(s) AS INTEGER) AS summary_chars, chunks, status, progress
FROM (SELECT id, coalesce(string_agg(t, '' ORDER BY seq) FILTER (
               WHERE seq = last_base OR kind = 'chunk' AND seq > coalesce(last_base, -1)), '') AS s,
             count(*) FILTER (WHERE kind = 'chunk') AS chunks,
             arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
             CASE WHEN bool_or(kind = 'complete') THEN 100 WHEN bool_or(kind = 'chunk') THEN 75 ELSE 0 END AS progress
      FROM sets GROUP BY id)"""
ORACLE["assemble_segments"] = f"""
SELECT analysis_id, k AS segment, k * 100 AS "offset", CAST(length(substring(s, k * 100 + 1, 100)) AS BIGINT) AS length,
       md5(substring(s, k * 100 + 1, 100)) AS text_md5
FROM ({ORACLE["assemble_chunks"].strip().replace("md5(s) AS summary_md5", "s")}),
     unnest(range(0, (length(s) + 99) // 100)) AS u(k)"""

# ---------------------------------------------------------------------------
# 2.7 rule catalogue


def _cyc(values, idx):
    return f"{X.str_list(values)}[CAST({idx} % {len(values)} + 1 AS INTEGER)]"


_IMP = f"""imp AS (
  SELECT p_partkey AS idx,
         CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'P-' || CAST(p_partkey % 1500 AS VARCHAR) END AS rid,
         trim(p_name) AS name, trim(CASE WHEN p_partkey % 41 = 0 THEN '  ' ELSE p_brand END) AS pattern, trim(p_type) AS message,
         lower(trim({_cyc(FX.IMPORT_SEVERITIES, 'p_size')})) AS sev,
         lower(trim({_cyc(S.DEFECT_FAMILIES + ['perf'], 'p_partkey')})) AS fam,
         lower(trim({_cyc(FX.IMPORT_MATCH_TYPES, 'p_size')})) AS mt
  FROM part
),
known AS (
  SELECT DISTINCT rule_id FROM (
    SELECT 'P-' || CAST(p_partkey % 1500 AS VARCHAR) AS rule_id FROM part WHERE p_partkey % 100 = 3
    UNION ALL SELECT unnest({X.str_list([r[0] for r in FX.FIXTURE_RULES])}))
),
val AS (
  SELECT imp.*, known.rule_id IS NOT NULL AS ex,
         CASE WHEN name = '' OR pattern = '' OR message = '' THEN 'Missing required fields (name, pattern, message)'
              WHEN sev NOT IN {X.in_list(S.SEVERITY_ORDER)} THEN 'Invalid severity: ' || sev
              WHEN fam NOT IN {X.in_list(S.DEFECT_FAMILIES)} THEN 'Invalid defect_family: ' || fam
              WHEN mt NOT IN {X.in_list(S.MATCH_TYPES)} THEN 'Invalid match_type: ' || mt END AS invalid
  FROM imp LEFT JOIN known ON imp.rid = known.rule_id
),
stat AS (
  SELECT *, CASE WHEN rid = '' THEN 'error'
                 WHEN ex OR first_ok < idx THEN 'skipped'
                 WHEN invalid IS NOT NULL THEN 'error' ELSE 'created' END AS status
  FROM (SELECT *, min(CASE WHEN invalid IS NULL THEN idx END) OVER (PARTITION BY rid) AS first_ok FROM val)
)"""
ORACLE["bulk_import_rules"] = X.with_ctes(_IMP, body="""
SELECT idx, rid AS rule_id, status,
       CASE WHEN rid = '' THEN 'Missing rule_id' WHEN status = 'error' THEN invalid END AS error FROM stat""")
_SUMMARY = """SELECT count(*) FILTER (WHERE status = 'created') AS created, count(*) FILTER (WHERE status = 'skipped') AS skipped,
       count(*) FILTER (WHERE status = 'error') AS errors_count, count(*) AS total_processed FROM stat"""
ORACLE["import_rules_csv"] = ORACLE["bulk_import_rules"]
ORACLE["import_rules_json"] = ORACLE["bulk_import_rules"]
ORACLE["list_rules"] = X.with_ctes(_IMP, body="""
SELECT rid AS rule_id, name, 'any' AS language, fam AS defect_family, sev AS severity, mt AS match_type
FROM stat JOIN part ON part.p_partkey = stat.idx
WHERE status = 'created' AND sev = 'high' AND p_size % 2 = 0""")

_NAME = ("array_to_string(list_transform(list_filter(string_split(replace(id, '_', '-'), '-'), lambda p: p <> ''), "
         "lambda p: upper(substring(p, 1, 1)) || lower(substring(p, 2))), ' ')")
_SEED = f"""specs AS (
  SELECT 'part-' || CAST(p_partkey % 400 AS VARCHAR) AS id, p_partkey AS seq,
         {X.str_list(FX.SEED_LANGUAGES)}[1:CAST(p_size % 4 AS INTEGER)] AS languages,
         p_name || CASE WHEN p_partkey % 10 = 0 THEN '\\n' ELSE '' END AS pattern,
         {_cyc(FX.SEED_SEVERITIES, 'p_partkey')} AS severity, p_type AS message
  FROM part
),
fams AS (SELECT DISTINCT 'part-' || CAST(p_partkey % 400 AS VARCHAR) AS id, {_cyc(S.DEFECT_FAMILIES, 'p_partkey % 400')} AS defect_family FROM part),
ovr AS (SELECT DISTINCT 'part-' || CAST(p_partkey % 400 AS VARCHAR) AS id, 'trace' AS severity FROM part WHERE (p_partkey % 400) % 50 = 0),
seeded AS (
  SELECT CASE WHEN language = 'any' THEN 'REGEX-' || s.id ELSE 'REGEX-' || language || '-' || s.id END AS rule_id,
         {_NAME.replace('id,', 's.id,')} AS name, language, fams.defect_family,
         coalesce(ovr.severity, s.severity, 'low') AS severity,
         CASE WHEN contains(pattern, '\\n') THEN 'regex_multiline' ELSE 'regex_line' END AS match_type,
         coalesce(message, '') AS message, true AS is_active, coalesce(message, '') AS description, coalesce(pattern, '') AS pattern
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, language ORDER BY seq) AS k
                       FROM (SELECT *, unnest(CASE WHEN len(languages) > 0 THEN languages ELSE ['any'] END) AS language FROM specs))
        WHERE k = 1) s
  LEFT JOIN fams ON s.id = fams.id LEFT JOIN ovr ON s.id = ovr.id
)"""
ORACLE["seed_rules"] = X.with_ctes(_SEED, body="""
SELECT rule_id, name, language, defect_family, severity, match_type, message, is_active FROM seeded WHERE rule_id NOT IN (
  SELECT DISTINCT 'REGEX-part-' || CAST(p_partkey % 400 AS VARCHAR) FROM part WHERE (p_partkey % 400) % 30 = 0)""")
_RULE_FIELDS = ["name", "description", "language", "defect_family", "severity", "pattern", "match_type", "message", "fix_hint",
                "cwe_id", "owasp_ref"]


def _some(event: str, every: int, at: int, value: str) -> str:
    return f"CASE WHEN event_type = '{event}' AND event_id % {every} = {at} THEN {value} END"


_ID = "CAST(event_id AS VARCHAR)"
ORACLE["apply_rule_changes"] = X.with_ctes(_SEED, f"""changes AS (
  SELECT 'REGEX-part-' || CAST(user_id % 60 AS VARCHAR) AS rule_id, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'toggle' WHEN 'view' THEN 'update' WHEN 'signup' THEN 'update'
              WHEN 'purchase' THEN 'deactivate' ELSE CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'toggle' END END AS action,
         CASE WHEN event_type = 'view' THEN {_cyc(['low', 'medium', 'high'], 'event_id')} END AS severity,
         CASE WHEN event_type = 'signup' THEN 'msg ' || CAST(event_id AS VARCHAR) END AS message,
         {_some('view', 5, 1, f"'name ' || {_ID}")} AS name, {_some('signup', 3, 0, f"'text ' || {_ID}")} AS description,
         {_some('view', 4, 1, _cyc(FX.SEED_LANGUAGES, 'event_id'))} AS language,
         {_some('signup', 6, 1, _cyc(['secrets', 'injection'], 'event_id'))} AS defect_family,
         {_some('view', 7, 2, f"'p' || {_ID}")} AS pattern, {_some('signup', 8, 3, "'regex_multiline'")} AS match_type,
         {_some('view', 3, 2, f"'hint ' || {_ID}")} AS fix_hint,
         {_some('signup', 2, 0, "'CWE-' || CAST(event_id % 900 AS VARCHAR)")} AS cwe_id,
         {_some('view', 11, 4, "'A0' || CAST(event_id % 10 AS VARCHAR)")} AS owasp_ref,
         coalesce({_some('view', 9, 0, 'false')}, {_some('signup', 9, 0, 'true')}) AS active
  FROM events
),
flagged AS (SELECT *, CASE WHEN action = 'deactivate' THEN false WHEN action = 'update' THEN active END AS flag FROM changes),
folded AS (
  SELECT rule_id, {', '.join(f"arg_max({f}, seq) FILTER (WHERE action = 'update' AND {f} IS NOT NULL) AS new_{f}" for f in _RULE_FIELDS)},
         arg_max(flag, seq) FILTER (WHERE flag IS NOT NULL) AS set_to, max(seq) FILTER (WHERE flag IS NOT NULL) AS set_at,
         count(*) FILTER (WHERE action = 'delete') AS del
  FROM flagged GROUP BY rule_id
),
tc AS (
  SELECT c.rule_id, count(*) FILTER (WHERE f.set_at IS NULL OR c.seq > f.set_at) AS t_after
  FROM changes c JOIN folded f ON c.rule_id = f.rule_id WHERE c.action = 'toggle' GROUP BY c.rule_id
),
whole AS (SELECT *, NULL::VARCHAR AS fix_hint, NULL::VARCHAR AS cwe_id, NULL::VARCHAR AS owasp_ref FROM seeded)""", body=f"""
SELECT r.rule_id, {', '.join(f"coalesce(f.new_{f}, r.{f}) AS {f}" for f in _RULE_FIELDS)},
       coalesce(f.set_to, r.is_active) <> (coalesce(tc.t_after, 0) % 2 = 1) AS is_active
FROM whole r LEFT JOIN folded f ON r.rule_id = f.rule_id LEFT JOIN tc ON r.rule_id = tc.rule_id
WHERE coalesce(f.del, 0) = 0""")

# ---------------------------------------------------------------------------
# incremental re-analysis
_AN = """analyses AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS project_id,
         'https://github.com/org' || CAST(o_custkey AS VARCHAR) || '/repo' AS repo_url,
         CASE o_orderstatus WHEN 'P' THEN 'analyzing' WHEN 'O' THEN 'complete' ELSE 'failed' END AS status,
         o_orderdate AS created_at,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE substring(sha256(CAST(o_custkey AS VARCHAR)), 1, 40) END AS commit_sha
  FROM orders
)"""


def _latest(where=""):
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, project_id ORDER BY created_at DESC, id DESC) AS rn
               FROM analyses {where}) WHERE rn = 1)"""


ORACLE["latest_analysis"] = X.with_ctes(_AN, body=f"""
SELECT repo_url, project_id, id, status, {X.iso_sql('created_at')} AS created_at FROM {_latest()}""")
ORACLE["rescan_decision"] = X.with_ctes(_AN, body=f"""
SELECT request_id,
       CASE WHEN r.id IS NOT NULL THEN 'running'
            WHEN NOT user_known AND d.id IS NOT NULL THEN 'reuse'
            WHEN user_known AND d.id IS NOT NULL AND NOT force AND d.commit_sha IS NOT NULL
                 AND (remote_head IS NULL OR remote_head = d.commit_sha) THEN 'reuse'
            ELSE 'rescan' END AS decision,
       CASE WHEN r.id IS NOT NULL THEN r.id
            WHEN NOT user_known AND d.id IS NOT NULL THEN d.id
            WHEN user_known AND d.id IS NOT NULL AND NOT force AND d.commit_sha IS NOT NULL
                 AND (remote_head IS NULL OR remote_head = d.commit_sha) THEN d.id END AS analysis_id
FROM (SELECT c_custkey AS request_id, 'https://github.com/org' || CAST(c_custkey AS VARCHAR) || '/repo' AS repo_url,
             CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS project_id,
             c_custkey % 3 <> 0 AS user_known, c_custkey % 5 = 0 AS force,
             CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '{"f" * 40}'
                  ELSE substring(sha256(CAST(c_custkey AS VARCHAR)), 1, 40) END AS remote_head FROM customer) q
LEFT JOIN {_latest("WHERE status IN ('queued', 'cloning', 'analyzing')")} r
  ON q.repo_url = r.repo_url AND q.project_id IS NOT DISTINCT FROM r.project_id
LEFT JOIN {_latest("WHERE status = 'complete'")} d
  ON q.repo_url = d.repo_url AND q.project_id IS NOT DISTINCT FROM d.project_id""")


def _files_b_cte():
    """Snapshot B expressed over the same files CTE shape."""
    a = X.files_cte()
    b = a.replace("files AS (", "files_b AS (", 1).replace(
        "FROM documents", """FROM (SELECT doc_id, source, lang,
                    CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
              UNION ALL SELECT doc_id, source, lang, text FROM documents WHERE doc_id % 13 = 0 AND false)""")
    extra = a.replace("files AS (", "files_b_extra AS (", 1).replace("FROM documents", "FROM documents WHERE doc_id % 13 = 0")
    return b + ",\n" + extra + """,
snap_b AS (SELECT * FROM files_b UNION ALL SELECT repo_id, path || '.bak' AS path, content, size, language, lines FROM files_b_extra)"""


_CHG = """chg AS (
  SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path,
         CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' END AS change
  FROM (SELECT repo_id, path, sha256(content) AS h FROM files) o
  FULL OUTER JOIN (SELECT repo_id, path, sha256(content) AS h FROM snap_b) n ON o.repo_id = n.repo_id AND o.path = n.path
)"""
ORACLE["changed_files"] = X.with_ctes(X.files_cte(), _files_b_cte(), _CHG,
                                      body="SELECT repo_id, path, change FROM chg WHERE change IS NOT NULL")
ORACLE["snapshot_changes"] = ORACLE["changed_files"]


def _scan_over(src):
    """The base scan CTEs re-pointed at another file table (every CTE name prefixed with b_)."""
    lines = (X.scan_lines_cte().replace("scan_src AS", "b_scan_src AS").replace("FROM scan_src", "FROM b_scan_src")
             .replace("scan_idx AS", "b_scan_idx AS").replace("FROM scan_idx", "FROM b_scan_idx")
             .replace("lines AS (", "b_lines AS (").replace("FROM files WHERE", f"FROM {src} WHERE"))
    raw = X.raw_findings_cte().replace("raw_findings AS (", "b_raw_findings AS (", 1).replace("FROM lines", "FROM b_lines")
    fin = X.findings_cte().replace("findings AS (", "b_findings AS (", 1).replace("FROM raw_findings", "FROM b_raw_findings")
    return [lines, raw, fin]


ORACLE["merge_rescan"] = X.with_ctes(
    *X.base_scan_ctes(), _files_b_cte(), _CHG,
    "to_scan AS (SELECT s.* FROM snap_b s JOIN chg ON s.repo_id = chg.repo_id AND s.path = chg.path WHERE chg.change IN ('added', 'modified'))",
    *_scan_over("to_scan"), body=f"""
SELECT {FINDING_OUT} FROM findings f
WHERE NOT EXISTS (SELECT 1 FROM chg WHERE chg.change IS NOT NULL AND chg.repo_id = f.repo_id AND chg.path = f.file_path)
UNION ALL SELECT {FINDING_OUT} FROM b_findings""")

# ---------------------------------------------------------------------------
# membership and administration
_MEM = """mem AS (
  SELECT l_suppkey AS user_id, o_custkey AS project_id,
         ['owner', 'editor', 'viewer'][CAST((l_suppkey + o_custkey) % 3 + 1 AS INTEGER)] AS role, min(l_shipdate) AS added_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey
),
an AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS project_id,
         CASE o_orderstatus WHEN 'P' THEN 'analyzing' WHEN 'O' THEN 'complete' ELSE 'failed' END AS status,
         o_orderdate AS created_at,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
         CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice % 101) AS INTEGER) END AS health_score,
         CAST(floor(o_totalprice * 100) AS BIGINT) AS storage_bytes,
         CAST(coalesce(n, 0) AS INTEGER) AS total_issues
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) c ON o_orderkey = c.l_orderkey
),
latest_p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rn
                 FROM an WHERE project_id IS NOT NULL) WHERE rn = 1
)"""
ORACLE["project_listing"] = X.with_ctes(_MEM, body="""
SELECT m.user_id, m.project_id, m.role,
       row_number() OVER (PARTITION BY m.user_id ORDER BY m.added_at DESC, m.project_id) AS position,
       c.collaborators, l.id AS latest_analysis_id, l.status AS latest_status
FROM mem m JOIN customer ON customer.c_custkey = m.project_id
JOIN (SELECT project_id, count(*) AS collaborators FROM mem GROUP BY project_id) c ON c.project_id = m.project_id
LEFT JOIN latest_p l ON l.project_id = m.project_id""")
ORACLE["audit_feed"] = f"""
SELECT e.event_id AS id, coalesce(s.s_name, 'system') AS admin, e.event_type AS action,
       json_extract_string(e.props, '$.k') AS target_id, json_extract_string(e.props, '$.k') AS detail_k,
       {X.iso_sql('e.ts')} AS created_at
FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) e
LEFT JOIN supplier s ON s.s_suppkey = CASE WHEN e.event_id % 4 <> 0 THEN e.user_id % 100 END"""
ORACLE["deletion_impact"] = X.with_ctes(_MEM, body="""
SELECT m.user_id, m.project_id, m.role, others AS other_members,
       CASE WHEN others = 0 THEN 'delete_project' ELSE 'unlink' END AS action,
       CASE WHEN others = 0 THEN coalesce(a.n, 0) ELSE 0 END AS analyses_removed
FROM (SELECT *, count(*) OVER (PARTITION BY project_id) - 1 AS others FROM mem) m
LEFT JOIN (SELECT project_id, count(*) AS n FROM an WHERE project_id IS NOT NULL GROUP BY project_id) a ON a.project_id = m.project_id""")
ORACLE["system_stats"] = X.with_ctes(X.files_cte(), _MEM, body="""
SELECT (SELECT count(*) FROM supplier) AS users, (SELECT count(*) FROM customer) AS projects,
       (SELECT count(*) FROM an) AS analyses, (SELECT count(*) FROM an WHERE status = 'complete') AS completed,
       (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM files) AS storage_bytes,
       floor(((SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM files) * 200 + 1048576) / (2 * 1048576)) / 100.0 AS storage_mb""")
ORACLE["user_usage"] = X.with_ctes(_MEM, body=f"""
SELECT s.s_suppkey AS user_id, s.s_name AS username, coalesce(u.projects, 0) AS projects,
       {X.iso_sql("TIMESTAMP '2024-01-01' + to_days(CAST(s.s_suppkey AS INTEGER))")} AS created_at,
       CAST(coalesce(u.analyses, 0) AS BIGINT) AS analyses, CAST(coalesce(u.storage_bytes, 0) AS BIGINT) AS storage_bytes
FROM supplier s LEFT JOIN (
  SELECT m.user_id, count(*) AS projects, coalesce(sum(a.n), 0) AS analyses, coalesce(sum(a.b), 0) AS storage_bytes
  FROM mem m LEFT JOIN (SELECT project_id, count(*) AS n, sum(storage_bytes) AS b FROM an WHERE project_id IS NOT NULL GROUP BY project_id) a
    ON a.project_id = m.project_id GROUP BY m.user_id) u ON u.user_id = s.s_suppkey""")
ORACLE["repo_inventory"] = X.with_ctes(_MEM, body=f"""
SELECT c.c_custkey AS project_id, 'org' || CAST(c.c_custkey AS VARCHAR) || '/repo' AS repo_name,
       coalesce(a.n, 0) AS analysis_count, CAST(coalesce(a.issues, 0) AS BIGINT) AS total_issues,
       coalesce(l.status, 'none') AS status,
       CASE WHEN l.id IS NULL THEN NULL ELSE {X.iso_sql('coalesce(l.completed_at, l.created_at)')} END AS last_analyzed,
       coalesce(mm.members, 0) AS members
FROM customer c
LEFT JOIN (SELECT project_id, count(*) AS n, sum(total_issues) AS issues FROM an WHERE project_id IS NOT NULL GROUP BY project_id) a
  ON a.project_id = c.c_custkey
LEFT JOIN latest_p l ON l.project_id = c.c_custkey
LEFT JOIN (SELECT project_id, count(*) AS members FROM mem GROUP BY project_id) mm ON mm.project_id = c.c_custkey""")
ORACLE["project_tiles"] = X.with_ctes(_MEM, body="""
SELECT m.user_id, count(*) AS total, count(*) FILTER (WHERE role = 'owner') AS owned,
       count(*) FILTER (WHERE role <> 'owner') AS shared,
       count(*) FILTER (WHERE coalesce(l.health_score, 0) >= 80) AS healthy
FROM mem m LEFT JOIN latest_p l ON l.project_id = m.project_id GROUP BY m.user_id""")

# ---------------------------------------------------------------------------
# stack detection and authored files
from strata.operators.stack import _candidate_dirs  # noqa: E402


def _list(vals):
    return X.str_list(vals)


_MF_ROWS = ", ".join(f"({i}, {X.q(n)}, {X.q(l)}, {_list(e)}, {_list(d)})" for i, (n, l, e, d) in enumerate(S.MANIFESTS))
_FIRST_BY_LANG = {}
for _n, _l, _e, _d in S.MANIFESTS:
    _FIRST_BY_LANG.setdefault(_l, (_e, _d))
_BL_ROWS = ", ".join(f"({X.q(k)}, {_list(v[0])}, {_list(v[1])})" for k, v in _FIRST_BY_LANG.items())
_FBMAP = "CASE " + " ".join(f"WHEN ext = {X.q(k)} THEN {X.q(v)}" for k, v in S.FALLBACK_EXT_LANGUAGE.items()) + " ELSE 'unknown' END"
_N_MF = len(S.MANIFESTS)


def _cyc_sql(values, idx):
    return f"{X.str_list(values)}[CAST(({idx}) % {len(values)} + 1 AS INTEGER)]"


_STACK = f"""mfiles AS (
  SELECT repo_id, path, content, CAST(strlen(content) AS BIGINT) AS size FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY doc_id) AS k FROM (
      SELECT source AS repo_id, doc_id,
             {X.str_list([m[0] for m in S.MANIFESTS])}[CAST(floor(doc_id / 97) % {_N_MF} + 1 AS INTEGER)] AS path,
             '{{"dependencies": {{"' || {_cyc_sql(FX.MANIFEST_DEPS, 'doc_id')} || '": "1"}}, "devDependencies": {{"'
             || {_cyc_sql(FX.MANIFEST_DEPS, 'floor(doc_id / 8)')} || '": "2"}}}}' AS content
      FROM documents WHERE doc_id % 97 = 5)) WHERE k = 1
),
allf AS (SELECT repo_id, path, content, size FROM files UNION ALL SELECT * FROM mfiles),
mf AS (SELECT * FROM (VALUES {_MF_ROWS}) AS t(priority, manifest, language, extensions, src_dirs)),
bl AS (SELECT * FROM (VALUES {_BL_ROWS}) AS t(language, m_ext, m_dirs)),
exist_dirs AS (
  SELECT DISTINCT repo_id, dir FROM (
    SELECT repo_id, array_to_string(parts[1:k], '/') AS dir
    FROM (SELECT repo_id, parts, unnest(generate_series(1, len(parts) - 1)) AS k
          FROM (SELECT repo_id, string_split(path, '/') AS parts FROM allf)))
  WHERE dir IN {X.in_list(_candidate_dirs())}
),
ms AS (
  SELECT repo_id, manifest, language, extensions, src_dirs, content FROM (
    SELECT f.repo_id, m.*, f.content, row_number() OVER (PARTITION BY f.repo_id ORDER BY m.priority) AS rn
    FROM allf f JOIN mf m ON f.path = m.manifest) WHERE rn = 1
),
fb_dom AS (
  SELECT repo_id, ext FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, ext) AS r FROM (
      SELECT repo_id, ext, count(*) AS n FROM (
        SELECT repo_id, {X.suffix_sql(X.name_sql('path'))} AS ext FROM allf WHERE len(string_split(path, '/')) <= 3)
      WHERE ext <> '' AND ext NOT IN {X.in_list(S.IGNORE_EXTENSIONS)} GROUP BY ALL)) WHERE r = 1
),
fb AS (
  SELECT x.repo_id, x.language, CAST(NULL AS VARCHAR) AS manifest,
         CASE WHEN bl.m_ext IS NOT NULL THEN bl.m_ext WHEN x.ext IS NULL THEN {_list(S.UNKNOWN_STACK_EXTENSIONS)}
              ELSE [x.ext] END AS extensions,
         coalesce(bl.m_dirs, {_list(S.UNKNOWN_STACK_DIRS)}) AS src_dirs, CAST(NULL AS VARCHAR) AS content
  FROM (SELECT r.repo_id, d.ext, CASE WHEN d.ext IS NULL THEN 'unknown' ELSE {_FBMAP.replace('ext =', 'd.ext =')} END AS language
        FROM (SELECT DISTINCT repo_id FROM allf) r LEFT JOIN fb_dom d ON r.repo_id = d.repo_id) x
  LEFT JOIN bl ON bl.language = x.language
),
both_st AS (SELECT repo_id, manifest, language, extensions, src_dirs, content FROM ms
            UNION ALL SELECT repo_id, manifest, language, extensions, src_dirs, content FROM fb
            WHERE repo_id NOT IN (SELECT repo_id FROM ms)),
ex AS (
  SELECT repo_id, list(d ORDER BY pos) AS existing FROM (
    SELECT s.repo_id, s.pos, s.src_dirs[s.pos] AS d
    FROM (SELECT repo_id, src_dirs, unnest(generate_series(1, len(src_dirs))) AS pos FROM both_st) s
    JOIN exist_dirs e ON e.repo_id = s.repo_id AND e.dir = s.src_dirs[s.pos])
  GROUP BY repo_id
),
stacks AS (
  SELECT s.repo_id, s.language, s.manifest, s.extensions,
         CASE WHEN len(coalesce(ex.existing, [])) > 0 THEN ex.existing ELSE s.src_dirs END AS src_dirs,
         coalesce(ex.existing, []) AS existing_dirs, s.content
  FROM both_st s LEFT JOIN ex ON s.repo_id = ex.repo_id
)"""


def _fw_sql():
    keys = ("list_concat(coalesce(json_keys(content, '$.dependencies'), []), "
            "coalesce(json_keys(content, '$.devDependencies'), []))")
    js = ", ".join(f"CASE WHEN list_contains({keys}, {X.q(dep)}) THEN {X.q(n)} END" for n, dep in S.JS_FRAMEWORKS)
    py = ", ".join(f"CASE WHEN contains(lower(content), {X.q(p)}) THEN {X.q(n)} END" for n, p in S.PY_FRAMEWORKS)
    cg = ", ".join(f"CASE WHEN contains(lower(content), {X.q(p)}) THEN {X.q(n)} END" for p, n in S.CARGO_FRAMEWORKS)
    go = ", ".join(f"CASE WHEN contains(lower(content), {X.q(p)}) THEN {X.q(n)} END" for p, n in S.GO_FRAMEWORKS)

    def compact(items):
        return f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return (f"CASE WHEN manifest IS NULL THEN [] WHEN manifest = 'package.json' THEN {compact(js)} "
            f"WHEN language = 'python' THEN {compact(py)} WHEN manifest = 'Cargo.toml' THEN {compact(cg)} "
            f"WHEN manifest = 'go.mod' THEN {compact(go)} ELSE [] END")


ORACLE["detect_stack"] = X.with_ctes(X.files_cte(), _STACK, body=f"""
SELECT repo_id, language, manifest, array_to_string(extensions, ',') AS extensions, array_to_string(src_dirs, ',') AS src_dirs,
       array_to_string({_fw_sql()}, ',') AS frameworks FROM stacks""")
ORACLE["detect_frameworks"] = X.with_ctes(X.files_cte(), _STACK, body=f"""
SELECT repo_id, manifest, array_to_string({_fw_sql()}, ',') AS frameworks FROM ms""")
ORACLE["fallback_stack"] = X.with_ctes(X.files_cte(), _STACK, body="""
SELECT fb.repo_id, fb.language, array_to_string(fb.extensions, ',') AS extensions,
       array_to_string(CASE WHEN len(coalesce(e.existing, [])) > 0 THEN e.existing ELSE fb.src_dirs END, ',') AS src_dirs
FROM fb LEFT JOIN (
  SELECT repo_id, list(d ORDER BY pos) AS existing FROM (
    SELECT s.repo_id, s.pos, s.src_dirs[s.pos] AS d
    FROM (SELECT repo_id, src_dirs, unnest(generate_series(1, len(src_dirs))) AS pos FROM fb) s
    JOIN exist_dirs x ON x.repo_id = s.repo_id AND x.dir = s.src_dirs[s.pos]) GROUP BY repo_id) e ON fb.repo_id = e.repo_id""")
ORACLE["authored_files"] = X.with_ctes(X.files_cte(), _STACK, body=f"""
SELECT repo_id, path, size, rank FROM (
  SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY size, path) AS rank FROM (
    SELECT f.repo_id, f.path, f.size, f.content, s.extensions, s.existing_dirs, dparts, name,
           len(string_split(f.path, '/')) AS depth, {X.suffix_sql('name')} AS ext
    FROM (SELECT *, string_split(path, '/')[1:len(string_split(path, '/')) - 1] AS dparts,
                 regexp_extract(path, '[^/]*$', 0) AS name FROM allf) f
    JOIN stacks s ON f.repo_id = s.repo_id)
  WHERE (len(list_filter(existing_dirs, lambda d: starts_with(path, d || '/')
                         AND NOT list_has_any(dparts[len(string_split(d, '/')) + 1:], {_list(S.IGNORE_DIRS)}))) > 0
         OR ((CASE WHEN len(existing_dirs) > 0 THEN depth <= 2 ELSE true END)
             AND NOT list_has_any(dparts, {_list(S.IGNORE_DIRS)})))
    AND ext NOT IN {X.in_list(S.IGNORE_EXTENSIONS)}
    AND (len(extensions) = 0 OR list_contains(extensions, ext))
    AND name NOT IN {X.in_list(S.IGNORE_FILENAMES)} AND NOT starts_with(name, '.')
    AND size > 0 AND size <= {S.AUTHORED_MAX_BYTES} AND NOT (instr(substring(content, 1, 512), chr(0)) > 0))
WHERE rank <= 80""")

# ---------------------------------------------------------------------------
# JSON columns, normalisation, incremental stream
ORACLE["decode_analysis_json"] = """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS n_keys,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
FROM events"""
ORACLE["normalize_issue"] = X.with_ctes(*_FD, body="""
SELECT repo_id, file_path AS _path, line_number AS _line, rule_id AS _rule,
       CASE WHEN line_number % 4 IN (0, 1) THEN rule_id ELSE coalesce(nullif(issue_type, ''), 'unknown') END AS rule_id,
       CASE WHEN line_number % 4 IN (0, 1) THEN defect_family ELSE coalesce(nullif(issue_type, ''), 'unknown') END AS defect_family,
       CASE WHEN line_number % 4 IN (0, 1, 3) THEN severity ELSE 'medium' END AS severity,
       CASE WHEN line_number % 4 IN (0, 1) THEN message ELSE 'Issue detected' END AS message,
       CASE WHEN line_number % 4 = 2 THEN 0 ELSE line_number END AS line_number,
       CASE WHEN line_number % 4 = 0 THEN engine_source ELSE 'unknown' END AS engine_source,
       '' AS code_snippet
FROM findings""")
ORACLE["incremental_scan"] = ORACLE["merge_rescan"]

ORACLE["import_first_errors"] = X.with_ctes(_IMP, body=f"""
SELECT idx, rid AS rule_id, CASE WHEN rid = '' THEN {X.q(S.IMPORT_ERRORS['missing_id'])} ELSE invalid END AS error
FROM stat WHERE status = 'error' ORDER BY idx LIMIT 20""")


# ---------------------------------------------------------------------------
# multiline scan, engine registry, payloads
_ML_LIST, = FX.FIXTURE_MULTILINE_RULES
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"
# A match is the first place of its text in what is left of the content: the pattern looks at nothing around it.
_MULTI = f"""found AS (
  SELECT repo_id, path AS file_path, content, {X.split_lines_sql('content')} AS arr,
         regexp_extract_all(content, {X.q(_ML_LIST[4])}) AS ms
  FROM files WHERE language IN {X.in_list(S.SCANNABLE_LANGUAGES)}
),
walk AS (
  SELECT repo_id, file_path, 1 AS k, ms, arr, content AS rest, 1 AS line0 FROM found WHERE len(ms) > 0
  UNION ALL
  SELECT repo_id, file_path, k + 1, ms, arr, substring(rest, instr(rest, ms[k]) + length(ms[k])),
         line0 + {_NL.format("substring(rest, 1, instr(rest, ms[k]) + length(ms[k]) - 1)")}
  FROM walk WHERE k < len(ms)
),
placed AS (
  SELECT repo_id, file_path, arr, line0 + {_NL.format("substring(rest, 1, instr(rest, ms[k]) - 1)")} AS line_number,
         line0 + {_NL.format("substring(rest, 1, instr(rest, ms[k]) + length(ms[k]) - 1)")} AS end_line
  FROM walk
),
multi AS (
  SELECT repo_id, {X.q(_ML_LIST[0])} AS rule_id, 'regex' AS engine_source, file_path,
         CAST(line_number AS INTEGER) AS line_number, {X.q(_ML_LIST[3])} AS severity, {X.q(_ML_LIST[2])} AS defect_family,
         {X.q(_ML_LIST[0] + ' matched')} AS message,
         array_to_string(arr[greatest(1, line_number - 1):least(len(arr), end_line + 1)], chr(10)) AS code_snippet,
         {X.q(_ML_LIST[0])} AS issue_type, CAST(end_line AS INTEGER) AS end_line, 1 AS "column"
  FROM placed
)"""
_OUT = ('repo_id, rule_id, engine_source, file_path, line_number, severity, defect_family, message, code_snippet, '
        'issue_type, end_line, "column"')
ORACLE["scan_multiline_rules"] = X.with_ctes(X.files_cte(), _MULTI, body=f"SELECT {_OUT} FROM multi").replace(
    "WITH ", "WITH RECURSIVE ", 1)
ORACLE["run_engines"] = X.with_ctes(X.files_cte(), X.scan_lines_cte(), X.raw_findings_cte(), _MULTI, body=f"""
SELECT {_OUT}, 0 AS engine_order FROM raw_findings WHERE engine_source = 'regex'
UNION ALL SELECT {_OUT}, 0 AS engine_order FROM multi""").replace("WITH ", "WITH RECURSIVE ", 1)

_TOP = """(SELECT repo_id, string_agg(value || ':' || CAST(n AS VARCHAR), ',' ORDER BY rk) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, first) AS rk
        FROM (SELECT repo_id, trim({0}) AS value, count(*) AS n, min((file_path, line_number, rule_id)) AS first
              FROM findings WHERE trim(coalesce({0}, '')) <> '' GROUP BY ALL)) WHERE rk <= 8 GROUP BY repo_id)"""
_SEV_INFO = ", ".join(f"count(*) FILTER (WHERE lower(coalesce(severity, 'info')) = {X.q(s)}) AS {s}"
                      for s in reversed(S.SEVERITY_ORDER))
_REPS18 = ORACLE["representative_issues"]
_REPS18 = _REPS18[_REPS18.index("SELECT repo_id, position, file"):].replace("position <= 3", "position <= 18")
ORACLE["summary_payload"] = X.with_ctes(*_FD, f"reps AS ({_REPS18})", body=f"""
SELECT r.repo_id, CAST(coalesce(c.n, 0) AS BIGINT) AS total_issues, {_SEV_ZERO.replace("s.", "c.")},
       coalesce(fam.top, '') AS top_defect_families, coalesce(rul.top, '') AS top_rule_ids,
       coalesce(x.reps, '') AS representative_issues
FROM (SELECT DISTINCT repo_id FROM files) r
LEFT JOIN (SELECT repo_id, count(*) AS n, {_SEV_INFO} FROM findings GROUP BY repo_id) c ON r.repo_id = c.repo_id
LEFT JOIN {_TOP.format("defect_family")} fam ON r.repo_id = fam.repo_id
LEFT JOIN {_TOP.format("rule_id")} rul ON r.repo_id = rul.repo_id
LEFT JOIN (SELECT repo_id, string_agg(concat_ws(':', file, CAST(line AS VARCHAR), severity, family, rule_id, message), '|'
                                      ORDER BY position) AS reps FROM reps GROUP BY repo_id) x ON r.repo_id = x.repo_id""")

_REPORT_SEV = ["blocker", "critical", "high", "medium", "low", "info", "trace"]
_SEV_TEXT = " || ',' || ".join(f"{X.q(n + ':')} || CAST(coalesce(s.{n}, 0) AS VARCHAR)" for n in _REPORT_SEV)
_SEV_N = ", ".join(f"count(*) FILTER (WHERE coalesce(severity, 'info') = {X.q(n)}) AS {n}" for n in _REPORT_SEV)
ORACLE["export_report_json"] = X.with_ctes(*_AT, _HS, body=f"""
SELECT 'analysis-' || hs.repo_id AS analysis_id, 'https://github.com/org/' || hs.repo_id AS repository,
       CASE WHEN ends_with(hs.repo_id, '7') THEN '2026-01-01T00:00:00+00:00' ELSE '2026-01-01T01:00:00+00:00' END AS analyzed_at,
       health_score, t.n AS total_files, t.lines AS total_lines, total_issues,
       {_SEV_TEXT} || coalesce(',' || o.names, '') AS severity_summary,
       CAST(coalesce(p.n, 0) AS BIGINT) AS contributors, total_issues AS attributed_issues
FROM hs
LEFT JOIN (SELECT repo_id, {_SEV_N} FROM findings GROUP BY 1) s ON s.repo_id = hs.repo_id
LEFT JOIN (SELECT repo_id, string_agg(severity || ':' || CAST(n AS VARCHAR), ',' ORDER BY severity) AS names
           FROM (SELECT repo_id, severity, count(*) AS n FROM findings WHERE severity NOT IN {X.in_list(_REPORT_SEV)} GROUP BY ALL)
           GROUP BY 1) o ON o.repo_id = hs.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS n, CAST(sum(lines) AS BIGINT) AS lines FROM files GROUP BY 1) t ON t.repo_id = hs.repo_id
LEFT JOIN (SELECT repo_id, count(DISTINCT coalesce(origin_author_email, 'unknown@example.com')) AS n FROM attributed GROUP BY 1) p
  ON p.repo_id = hs.repo_id
WHERE NOT ends_with(hs.repo_id, '5')""")
ORACLE["user_projects"] = X.with_ctes(_MEM, body="""
SELECT user_id, project_id, 'org' || CAST(project_id AS VARCHAR) || '/repo' AS repo_name, role FROM mem""")
ORACLE["project_collaborators"] = X.with_ctes(_MEM, body=f"""
SELECT project_id, user_id, s_name AS username, role, {X.iso_sql('added_at')} AS added_at
FROM mem JOIN supplier ON user_id = s_suppkey""")
