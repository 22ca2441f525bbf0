"""Severity ranks and weights, external-severity mapping, family cascade, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import schemas as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def severity_rank(sev, unknown: int | None = 0) -> Column:
    """trace 0 .. blocker 6; ``unknown`` for anything else (callers differ, quirk Q8)."""
    sev = _c(sev)
    expr = None
    for i, name in enumerate(S.SEVERITY_ORDER):
        expr = F.when(sev == name, F.lit(i)) if expr is None else expr.when(sev == name, F.lit(i))
    return expr.otherwise(F.lit(unknown))


def severity_weight(sev, default_severity: str = "medium") -> Column:
    sev = F.coalesce(_c(sev), F.lit(default_severity))
    expr = None
    for name, w in S.SEVERITY_WEIGHTS.items():
        expr = F.when(sev == name, F.lit(float(w))) if expr is None else expr.when(sev == name, F.lit(float(w)))
    return expr.otherwise(F.lit(float(S.UNKNOWN_SEVERITY_WEIGHT)))


def penalty(sev, family) -> Column:
    """Per-issue health penalty: weight x 1.5 for high-impact families."""
    factor = F.when(_c(family).isin(*S.HIGH_IMPACT_FAMILIES), F.lit(S.HIGH_IMPACT_FACTOR)).otherwise(F.lit(1.0))
    return severity_weight(sev) * factor


def map_external_severity(scanner_sev, rule_sev=None) -> Column:
    """Rule override, else ERROR/WARNING/INFO -> high/medium/info, else medium."""
    s = F.upper(_c(scanner_sev))
    mapped = F.lit("medium")
    for k in reversed(list(S.EXTERNAL_SEVERITY)):
        mapped = F.when(s == k, F.lit(S.EXTERNAL_SEVERITY[k])).otherwise(mapped)
    mapped = F.when(_c(scanner_sev).isNull() | (_c(scanner_sev) == ""), F.lit("medium")).otherwise(mapped)
    if rule_sev is None:
        return mapped
    rs = _c(rule_sev)
    return F.when(rs.isNotNull() & (rs != ""), rs).otherwise(mapped)


def classify_defect_family(rule_id, category, rule_family=None) -> Column:
    """Ordered keyword cascade over ``lower(rule_id || ' ' || category)``."""
    text = F.lower(F.concat_ws(" ", F.coalesce(_c(rule_id), F.lit("")), F.coalesce(_c(category), F.lit(""))))
    out = F.lit(S.DEFAULT_FAMILY)
    for family, any_of, all_of in reversed(S.FAMILY_KEYWORDS):
        if any_of:
            cond = None
            for kw in any_of:
                cond = text.contains(kw) if cond is None else cond | text.contains(kw)
        else:
            cond = None
            for kw in all_of:
                cond = text.contains(kw) if cond is None else cond & text.contains(kw)
        out = F.when(cond, F.lit(family)).otherwise(out)
    if rule_family is None:
        return out
    rf = _c(rule_family)
    return F.when(rf.isNotNull() & (rf != ""), rf).otherwise(out)


def health_grade(score) -> Column:
    s = _c(score)
    return (F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F"))


# FIXED VALUES: risk labels, highest non-zero tier first
RISK_LABELS = [
    ("blocker", "Blocker risks present"),
    ("critical", "Critical risks present"),
    ("high", "High-risk issues detected"),
    ("medium", "Moderate-risk issues"),
]
LOW_RISK_LABEL = "Low overall risk"


def risk_label(n_blocker, n_critical, n_high, n_medium) -> Column:
    """Highest non-zero severity bucket decides the label."""
    counts = [n_blocker, n_critical, n_high, n_medium]
    out = F.lit(LOW_RISK_LABEL)
    for (_, label), n in reversed(list(zip(RISK_LABELS, counts))):
        out = F.when(F.coalesce(_c(n), F.lit(0)) > 0, F.lit(label)).otherwise(out)
    return out


def report_colour_band(score) -> Column:
    s = _c(score)
    return F.when(s >= 80, "green").when(s >= 60, "yellow").when(s >= 40, "orange").otherwise("red")


def ui_colour_band(score) -> Column:
    s = _c(score)
    return (F.when(s >= 90, "excellent").when(s >= 70, "good").when(s >= 50, "fair")
            .when(s >= 30, "poor").otherwise("critical"))
