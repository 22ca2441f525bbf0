"""DuckDB SQL for the fixture adapters and shared scan CTEs.

Built from the same constant specs as ``strata.fixtures`` so both sides of
the oracle comparison project the driver tables identically.
"""

from __future__ import annotations

from strata import fixtures as FX
from strata import schemas as S

LINE_BREAK_RE2 = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def q(s: str | None) -> str:
    """SQL string literal."""
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def split_lines_sql(expr: str) -> str:
    arr = f"regexp_split_to_array({expr}, {q(LINE_BREAK_RE2)})"
    return f"(CASE WHEN {arr}[-1] = '' THEN {arr}[1:len({arr}) - 1] ELSE {arr} END)"


def suffix_sql(name_expr: str) -> str:
    return f"lower(regexp_extract({name_expr}, '^.+(\\.[^./]*)$', 1))"


def language_values() -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(S.DEFAULT_LANGUAGE_MAP.items()))
    return f"(VALUES {rows}) AS lm(ext, map_language)"


def files_cte() -> str:
    n_ext, n_dir = len(FX.FIXTURE_EXTS), len(FX.FIXTURE_DIRS)
    return f"""files AS (
  SELECT b.repo_id, b.path, b.content, b.size,
         CASE WHEN lower(regexp_extract(b.path, '[^/]*$', 0)) IN {in_list(S.DOCKERFILE_NAMES)} THEN 'dockerfile'
              ELSE coalesce(lm.map_language, 'plaintext') END AS language,
         CAST(len({split_lines_sql('b.content')}) AS INTEGER) AS lines
  FROM (
    SELECT source AS repo_id,
           CASE WHEN {str_list(FX.FIXTURE_DIRS)}[CAST(floor(doc_id / {n_ext}) % {n_dir} + 1 AS INTEGER)] = ''
                THEN CAST(doc_id AS VARCHAR) || {str_list(FX.FIXTURE_EXTS)}[CAST(doc_id % {n_ext} + 1 AS INTEGER)]
                ELSE {str_list(FX.FIXTURE_DIRS)}[CAST(floor(doc_id / {n_ext}) % {n_dir} + 1 AS INTEGER)] || '/' || lang || '/'
                     || CAST(doc_id AS VARCHAR) || {str_list(FX.FIXTURE_EXTS)}[CAST(doc_id % {n_ext} + 1 AS INTEGER)]
           END AS path,
           text AS content, CAST(strlen(text) AS BIGINT) AS size
    FROM documents
  ) b
  LEFT JOIN {language_values()}
    ON lm.ext = {suffix_sql("regexp_extract(b.path, '[^/]*$', 0)")}
)"""


def scan_lines_cte() -> str:
    return f"""scan_src AS (
  SELECT repo_id, path AS file_path, lower(coalesce(language, '')) AS lang, {split_lines_sql('content')} AS arr
  FROM files WHERE language IN {in_list(S.SCANNABLE_LANGUAGES)}
),
scan_idx AS (
  SELECT repo_id, file_path, lang, arr, unnest(generate_series(1, len(arr))) AS i FROM scan_src
),
lines AS (
  SELECT repo_id, file_path, lang, CAST(i AS INTEGER) AS line_number, arr[i] AS line,
         concat_ws(chr(10), CASE WHEN i > 1 THEN arr[i - 1] END, arr[i],
                   CASE WHEN i < len(arr) THEN arr[i + 1] END) AS code_snippet
  FROM scan_idx
)"""


def _rule_select(spec_row, engine: str, engine_order: int) -> str:
    rid, lang, fam, sev, pat, mt, active = spec_row
    cond = f"regexp_matches(line, {q(pat)})"
    if lang not in ("", "any"):
        cond = f"lang = {q(lang)} AND " + cond
    itype = rid[len("REGEX-"):] if rid.startswith("REGEX-") else rid
    return (f"SELECT repo_id, {q(rid)} AS rule_id, {q(engine)} AS engine_source, file_path, line_number, "
            f"{q(sev)} AS severity, {q(fam)} AS defect_family, {q(rid + ' matched')} AS message, "
            f"CAST(NULL AS VARCHAR) AS fix_hint, CAST(NULL AS VARCHAR) AS cwe_id, CAST(NULL AS VARCHAR) AS owasp_ref, "
            f"code_snippet, {q(itype)} AS issue_type, line_number AS end_line, 1 AS \"column\", "
            f"{engine_order} AS engine_order FROM lines WHERE {cond}")


def raw_findings_cte() -> str:
    parts = [_rule_select(r, "regex", 0) for r in FX.FIXTURE_RULES if r[6] and r[5] == "regex_line"]
    parts += [_rule_select(r, "external", 1) for r in FX.FIXTURE_EXTERNAL_RULES if r[6] and r[5] == "regex_line"]
    return "raw_findings AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


def sev_rank_sql(expr: str, unknown: int = 0) -> str:
    whens = " ".join(f"WHEN {expr} = {q(s)} THEN {i}" for i, s in enumerate(S.SEVERITY_ORDER))
    return f"(CASE {whens} ELSE {unknown} END)"


def penalty_sql(sev: str = "severity", fam: str = "defect_family") -> str:
    s = f"coalesce({sev}, 'medium')"
    whens = " ".join(f"WHEN {s} = {q(k)} THEN {float(v)}" for k, v in S.SEVERITY_WEIGHTS.items())
    w = f"(CASE {whens} ELSE {float(S.UNKNOWN_SEVERITY_WEIGHT)} END)"
    return f"({w} * CASE WHEN {fam} IN {in_list(S.HIGH_IMPACT_FAMILIES)} THEN 1.5 ELSE 1.0 END)"


def findings_cte() -> str:
    return f"""findings AS (
  SELECT * EXCLUDE (rn, engine_order, first_eo), first_eo AS engine_order FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, rule_id, line_number
                                 ORDER BY -{sev_rank_sql('severity')}, engine_order, coalesce(end_line, 0),
                                          coalesce(code_snippet, '')) AS rn,
           min(engine_order) OVER (PARTITION BY repo_id, file_path, rule_id, line_number) AS first_eo
    FROM raw_findings) WHERE rn = 1
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def base_scan_ctes() -> list[str]:
    return [files_cte(), scan_lines_cte(), raw_findings_cte(), findings_cte()]


def commits_cte() -> str:
    verb = "CASE " + " ".join(f"WHEN event_type = {q(et)} THEN {q(v)}" for et, v in FX.COMMIT_VERBS) + " ELSE 'update' END"
    return f"""commits AS (
  SELECT 'events' AS repo_id, 'src/file_' || json_extract_string(props, '$.k') || '.py' AS file_path,
         lpad(upper(hex(event_id)), 40, '0') AS "commit", 'user' || CAST(user_id AS VARCHAR) AS author, ts,
         {verb} || ' ' || event_type || ' #' || CAST(event_id AS VARCHAR) AS message,
         CAST(floor(value) AS INTEGER) AS insertions, CAST(event_id % 7 AS INTEGER) AS deletions
  FROM events
)"""


def dir_parts_sql(path: str) -> str:
    parts = f"string_split({path}, '/')"
    return f"{parts}[1:len({parts}) - 1]"


def name_sql(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$', 0)"


def skipped_dir_sql(path: str, dirs=None) -> str:
    dirs = S.SKIP_DIRS if dirs is None else dirs
    return f"list_has_any({dir_parts_sql(path)}, {str_list(dirs)})"


def skipped_suffix_sql(path: str) -> str:
    name = f"lower({name_sql(path)})"
    multi = [s for s in S.SKIP_EXTENSIONS if s.count('.') > 1]
    cond = f"{suffix_sql(name_sql(path))} IN {in_list(S.SKIP_EXTENSIONS)}"
    for m in multi:
        cond += f" OR ends_with({name}, {q(m)})"
    return f"({cond})"


def hidden_sql(path: str) -> str:
    return (f"(starts_with({name_sql(path)}, '.') AND "
            f"{suffix_sql(name_sql(path))} NOT IN {in_list(S.HIDDEN_EXCEPTIONS)})")


def blame_lines_cte() -> str:
    return """blame_lines AS (
  SELECT coalesce(p.repo_id, 'orders') AS repo_id,
         coalesce(p.path, 'orders/' || CAST(l.l_orderkey AS VARCHAR) || '.sql') AS file_path, l.line_number,
         'Supplier ' || CAST(l.l_suppkey AS VARCHAR) AS author_name,
         's' || CAST(l.l_suppkey AS VARCHAR) || '@example.com' AS author_email,
         lpad(upper(hex(l.l_partkey)), 40, '0') AS "commit", l.l_shipdate AS ts,
         concat_ws(' ', l.l_returnflag, l.l_linestatus) AS content
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS line_number
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
                         l_tax, l_returnflag, l_linestatus, l_shipdate) AS k FROM lineitem) WHERE k = 1) l
  LEFT JOIN (SELECT repo_id, path, CAST(regexp_extract(path, '([0-9]+)[^/]*$', 1) AS BIGINT) AS doc FROM files) p
    ON l.l_orderkey = p.doc
)"""


def part_commits_cte() -> str:
    return """part_commits AS (
  SELECT lpad(upper(hex(p_partkey)), 40, '0') AS "commit", p_brand AS author, concat_ws(chr(10), p_name, p_type) AS message
  FROM part
)"""


def iso_sql(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00')"


def attributed_cte() -> str:
    return f"""attributed AS (
  SELECT f.*, b.author_name AS origin_author_name, b.author_email AS origin_author_email,
         b.author_name || ' <' || b.author_email || '>' AS origin_author, substring(b."commit", 1, 8) AS origin_commit,
         {iso_sql('b.ts')} AS origin_date, b.ts AS origin_ts
  FROM findings f LEFT JOIN blame_lines b
    ON f.repo_id = b.repo_id AND f.file_path = b.file_path
   AND (CASE WHEN f.line_number > 0 THEN f.line_number END) = b.line_number
)"""


def pct_1dp_sql(part: str, whole: str) -> str:
    return f"(floor(({part} * 2000 + {whole}) / ({whole} * 2)) / 10.0)"
