"""Rule scanning: line rules, multiline rules and the engine registry.

The catalogue (authored by hand: a dimension) is compiled on the driver.  Rules with mandatory literals, nearly all in
practice, run in one pass over the texts led by an automaton of all their literals (``python_engine``): its time
grows with the text and the hits, not with the number of rules.  Rules without any literal become *literal* ``rlike``
predicates of a second pass in generated code, grouped by language; patterns that only Python compiles join the
first pass.  Both are narrow: no shuffle, no join back to the content.  Multiline rules run in the first
pass too (Spark has no find-all-with-offsets).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import schemas as S
from strata.functions.regex_literal import required_literals
from strata.functions.text import with_lines, with_neighbours
from strata.operators.python_engine import scan_texts

# Rules per generated expression block, and in one generated pass over the text: more do not fit into a generated
# method, and Spark would interpret the pass.
RULE_BLOCK = 10
RULES_PER_PASS = 40

ANY_LANGUAGE = ("", "any")
LANGUAGE_ALIASES = {"cpp": "c++"}

RULE_META_FIELDS = ["rule_id", "severity", "defect_family", "message", "fix_hint", "cwe_id", "owasp_ref"]


def _norm_lang(lang: str | None, alias: bool = True) -> str:
    x = (lang or "").strip().lower()
    return LANGUAGE_ALIASES.get(x, x) if alias else x


def _java_compiles(spark, pattern: str) -> bool:
    """Driver-side check that the JVM regex engine accepts ``pattern``.

    Without JVM access (e.g. a Connect session) the pattern is assumed to compile.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return True
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def active_rules(rules: DataFrame, match_types=("regex_line",)) -> DataFrame:
    return rules.filter(F.coalesce(F.col("is_active"), F.lit(False)) & F.col("match_type").isin(*match_types))


def collect_rules(rules: DataFrame, match_types=("regex_line",), alias_languages: bool = True,
                  unicode_classes: bool = False) -> list[dict]:
    """Active rules of the given kinds as dicts (the catalogue is authored by hand: a dimension, not data).

    Rules whose pattern Python cannot compile are left out (as in the source
    behaviour); rules Java cannot compile are flagged for the Python scan.
    ``unicode_classes`` makes ``\\w``, ``\\d``, ``\\s`` and ``\\b`` of line rules
    Unicode-aware as in the source (quirk Q12); the default keeps ASCII classes, which
    is what the RE2-based oracle can check.  Multiline rules are Unicode-aware.
    """
    cols = RULE_META_FIELDS + ["pattern", "language", "match_type"]
    rows = sorted(active_rules(rules, match_types).select(*cols).collect(),
                  key=lambda r: (r["rule_id"] or "", r["language"] or ""))
    spark = rules.sparkSession
    out = []
    for r in rows:
        d = r.asDict()
        try:
            re.compile(d["pattern"] or "")
        except re.error:
            continue
        d["language"] = _norm_lang(d["language"], alias_languages)
        d = _prepared(d, unicode_classes)
        if not d["literals"]:  # only such rules are given to Java
            d["java_ok"] = _java_compiles(spark, d["java_pattern"])
        out.append(d)
    return out


def _prepared(rule: dict, unicode_classes: bool = False) -> dict:
    """A rule with what the scans need besides its catalogue fields; what it has already stays."""
    pattern, kind = rule["pattern"] or "", rule.get("match_type", "regex_line")
    flags = 0 if unicode_classes or kind == "regex_multiline" else re.ASCII
    try:
        re.compile(pattern, flags)
    except (re.error, ValueError):  # the pattern asks for other classes itself
        flags = 0
    made = {"match_type": kind, "flags": flags, "java_ok": True, "java_pattern": ("(?U)" if unicode_classes else "") + pattern}
    made |= rule
    return made if "literals" in made else made | {"literals": required_literals(pattern, made["flags"])}


def _meta_table(spark, rules: list[dict]) -> DataFrame:
    """(_slot, _m): what a finding takes from its rule."""
    rows = [(i, (r.get("engine", "regex"), r.get("engine_order", 0), int(r["match_type"] == "regex_multiline"), r["rule_id"],
                 r["severity"] or S.DEFAULT_RULE_SEVERITY, r["defect_family"] or S.DEFAULT_RULE_FAMILY,
                 r["message"] or S.DEFAULT_MESSAGE, r["fix_hint"], r["cwe_id"], r["owasp_ref"]))
            for i, r in enumerate(rules, start=1)]
    return spark.createDataFrame(rows, "_slot int, _m struct<engine: string, engine_order: int, seq: int, rule_id: string, "
                                       "severity: string, defect_family: string, message: string, fix_hint: string, "
                                       "cwe_id: string, owasp_ref: string>")


def _sql_string(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit_list(text: str, lang: str, rules: list[dict]) -> Column:
    """Comma-joined 1-based slots of the rules that fit the language and match.

    ``concat_ws`` skips the NULL slots, so a line without hits gives ``''``;
    everything stays in generated code (no lambda functions).
    """
    by_language: dict[str, list[str]] = {}
    for i, r in enumerate(rules, start=1):
        hit = f"rlike({text}, {_sql_string(r['java_pattern'])})"
        key = "any" if r["language"] in ANY_LANGUAGE else r["language"]
        by_language.setdefault(key, []).append(f"CASE WHEN {hit} THEN '{i}' END")

    def joined(slots: list[str]) -> str:
        while len(slots) > 1:
            slots = [f"nullif(concat_ws(',', {', '.join(slots[k:k + RULE_BLOCK])}), '')"
                     for k in range(0, len(slots), RULE_BLOCK)]
        return slots[0]

    parts = [joined(v) if k == "any" else f"CASE WHEN {lang} = {_sql_string(k)} THEN {joined(v)} END"
             for k, v in by_language.items()]
    return F.expr(f"concat_ws(',', {', '.join(parts)})")


def _finding_projection(engine: str) -> list[Column]:
    return [
        F.col("repo_id"),
        F.col("_m.rule_id").alias("rule_id"),
        (F.lit(engine) if engine else F.col("_m.engine")).alias("engine_source"),
        F.col("file_path"),
        F.col("line_number").cast("int").alias("line_number"),
        F.col("_m.severity").alias("severity"),
        F.col("_m.defect_family").alias("defect_family"),
        F.col("_m.message").alias("message"),
        F.col("_m.fix_hint").alias("fix_hint"),
        F.col("_m.cwe_id").alias("cwe_id"),
        F.col("_m.owasp_ref").alias("owasp_ref"),
        F.col("code_snippet"),
        F.when(F.col("_m.rule_id").startswith("REGEX-"), F.expr("substring(_m.rule_id, 7)"))
         .otherwise(F.col("_m.rule_id")).alias("issue_type"),
        F.col("end_line").cast("int").alias("end_line"),
        F.lit(1).alias("column"),
    ]


def explode_lines(files: DataFrame, content_col: str = "content", keep=("repo_id", "path")) -> DataFrame:
    """(repo_id, path, line_number 1-based, line); empty text gives no rows."""
    return (with_lines(files, content_col, keep=keep)
            .select(*keep, F.posexplode("_lines").alias("_pos", "line"))
            .select(*keep, (F.col("_pos") + 1).cast("int").alias("line_number"), "line"))


def scan_line_rules(files: DataFrame, rules: DataFrame | list[dict], engine: str = "regex",
                    alias_languages: bool = True, unicode_classes: bool = False, large_chars: int | None = None) -> DataFrame:
    """Every active line rule x every line of a file of the rule's language.

    One finding per (rule, line) on the first hit; snippet = lines n-1..n+1.  Files of over ``large_chars`` characters
    are scanned by many tasks each.
    """
    compiled = collect_rules(rules, ("regex_line",), alias_languages, unicode_classes) \
        if isinstance(rules, DataFrame) else rules
    return _scan(files, [dict(r, engine=engine, engine_order=0) for r in compiled], large_chars).drop("engine_order", "seq")


def scan_line_engines(files: DataFrame, engines: dict[str, DataFrame], alias_languages: bool = True) -> DataFrame:
    """Several line-rule engines over the same files in ONE pass.

    Each engine's catalogue joins the same list of rules (tagged with engine name
    and registration order), so the text is read once however many engines run.
    Output carries ``engine_order`` for the de-duplication tie-break.
    """
    compiled = []
    for order, (name, rules) in enumerate(engines.items()):
        compiled += [dict(r, engine=name, engine_order=order)
                     for r in collect_rules(rules, ("regex_line",), alias_languages)]
    return _scan(files, compiled).drop("seq")


def _scan(files: DataFrame, rules: list[dict], large_chars: int | None = None) -> DataFrame:
    """Findings of compiled rules, line and multiline ones: the automaton's pass, and the generated pass for line
    rules without literals."""
    rules = [_prepared(r) for r in rules]
    generated = [r for r in rules if not r["literals"] and r["java_ok"] and r["match_type"] != "regex_multiline"]
    led = [r for r in rules if not any(r is g for g in generated)]
    out = None
    if led:
        out = _with_meta(scan_texts(files, led, large_chars), led)
    # rules of one language come together, so a later pass reads only the files of its languages
    generated.sort(key=lambda r: "" if r["language"] in ANY_LANGUAGE else r["language"])
    for at in range(0, len(generated), RULES_PER_PASS):
        part = _generated_pass(files, generated[at: at + RULES_PER_PASS])
        out = part if out is None else out.unionByName(part)
    return _empty_findings(files).withColumn("engine_order", F.lit(0)).withColumn("seq", F.lit(0)) if out is None else out


def _with_meta(hits: DataFrame, rules: list[dict]) -> DataFrame:
    """Hits with what their rule says; the broadcast side is the catalogue that the driver has just compiled."""
    return (hits.join(F.broadcast(_meta_table(hits.sparkSession, rules)), "_slot")
            .select(*_finding_projection(None), F.col("_m.engine_order").alias("engine_order"), F.col("_m.seq").alias("seq")))


def _generated_pass(files: DataFrame, rules: list[dict]) -> DataFrame:
    base = files.select("repo_id", F.col("path").alias("file_path"),
                        F.lower(F.coalesce(F.col("language"), F.lit(""))).alias("_lang"), "content")
    languages = {r["language"] for r in rules}
    if languages.isdisjoint(ANY_LANGUAGE):
        base = base.filter(F.col("_lang").isin(*sorted(languages)))
    lines = with_lines(base, keep=["repo_id", "file_path", "_lang"]).select(
        "repo_id", "file_path", "_lang", F.posexplode(with_neighbours("_lines")).alias("_pos", "_l")).select(
        "repo_id", "file_path", "_lang", "_pos", "_l", F.col("_l.line").alias("_line"))
    # Hits are a column of their own (its code is split into methods when there are many rules); the filter
    # stands on the generator's output, so the predicates are evaluated once per line.
    hits = (lines.select("repo_id", "file_path", "_pos", "_l", _hit_list("_line", "_lang", rules).alias("_hits"))
            .select("repo_id", "file_path", "_pos", "_l", F.explode(F.split("_hits", ",")).alias("_slot"))
            .filter(F.col("_slot") != "")
            .select("repo_id", "file_path", (F.col("_pos") + 1).alias("line_number"), (F.col("_pos") + 1).alias("end_line"),
                    F.concat_ws("\n", F.col("_l.prev"), F.col("_l.line"), F.col("_l.next")).alias("code_snippet"),
                    F.col("_slot").cast("int").alias("_slot")))
    return _with_meta(hits, rules)


def _empty_findings(files: DataFrame) -> DataFrame:
    return files.sparkSession.createDataFrame([], S.FINDINGS)


# ---------------------------------------------------------------------------
# Multiline rules


def scan_multiline_rules(files: DataFrame, rules: DataFrame | list[dict], engine: str = "regex",
                         alias_languages: bool = True, large_chars: int | None = None) -> DataFrame:
    """Every match of a multiline rule over the whole content.

    line = newlines before the match + 1; end_line = line + newlines inside it.  A rule runs on the files of its
    language that hold one of its literals; files of over ``large_chars`` characters are scanned by many tasks each.
    """
    compiled = collect_rules(rules, ("regex_multiline",), alias_languages) \
        if isinstance(rules, DataFrame) else rules
    return _scan(files, [dict(r, engine=engine) for r in compiled], large_chars).drop("engine_order", "seq")


# ---------------------------------------------------------------------------
# Engine registry

Engine = Callable[[DataFrame, DataFrame], DataFrame]
_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, fn: Engine) -> None:
    """Register ``fn(files, rules) -> findings``; engines run in registration order."""
    _ENGINES[name] = fn


def registered_engines() -> dict[str, Engine]:
    return dict(_ENGINES)


def _regex_engine(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Line rules and multiline rules in one scan; ``seq`` puts line rules first for ties and ids."""
    compiled = collect_rules(rules, ("regex_line", "regex_multiline"))
    return _scan(files, [dict(r, engine="regex") for r in compiled]).drop("engine_order")


register_engine("regex", _regex_engine)


def run_engines(files: DataFrame, rules: DataFrame, engines: dict[str, Engine] | None = None) -> DataFrame:
    """Union of every engine's findings, with ``engine_order`` for tie-breaks.

    An engine that fails while building its plan contributes nothing.  At run time
    the built-in engines cannot fail on a file: patterns are checked beforehand and
    those that Java does not take run in Python.  Own Python code registers through
    ``python_engine``, which drops only the file it fails on.
    """
    engines = registered_engines() if engines is None else engines
    out = None
    for order, (name, fn) in enumerate(engines.items()):
        try:
            df = fn(files, rules)
            seq = F.col("seq").cast("int") if "seq" in df.columns else F.lit(0)
            df = df.select(*S.FINDING_COLUMNS, F.lit(order).alias("engine_order"), seq.alias("seq"))
        except Exception:  # engine errors yield nothing
            continue
        out = df if out is None else out.unionByName(df)
    if out is None:
        return _empty_findings(files).withColumn("engine_order", F.lit(0)).withColumn("seq", F.lit(0))
    return out
