"""Path and URL expressions: directory pruning, suffix tests, repo names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import schemas as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def path_parts(path) -> Column:
    return F.split(_c(path), "/")


def file_name(path) -> Column:
    return F.element_at(path_parts(path), -1)


def dir_parts(path) -> Column:
    parts = path_parts(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def last_suffix(name) -> Column:
    """Lower-cased last suffix of a file name, ``''`` when none (dot-files have none)."""
    name = _c(name)
    ext = F.regexp_extract(name, r"^.+(\.[^./]*)$", 1)
    return F.lower(ext)


def in_skipped_dir(path, dirs=None) -> Column:
    dirs = S.SKIP_DIRS if dirs is None else dirs
    return F.arrays_overlap(dir_parts(path), F.array(*[F.lit(d) for d in dirs]))


def has_skipped_suffix(path, suffixes=None) -> Column:
    """Suffix test on the whole tail, so ``.min.js`` entries match too (quirk Q2, fixed)."""
    suffixes = S.SKIP_EXTENSIONS if suffixes is None else suffixes
    name = F.lower(file_name(path))
    ext = last_suffix(file_name(path))
    multi = [s for s in suffixes if s.count(".") > 1]
    cond = ext.isin(*suffixes)
    for s in multi:
        cond = cond | name.endswith(s)
    return cond


def is_hidden(path) -> Column:
    """Dot-files, except those whose last suffix is a listed config suffix
    (``.local.env`` is kept; a bare ``.env`` has no suffix, so it is dropped: Q2, kept)."""
    name = file_name(path)
    return name.startswith(".") & ~last_suffix(name).isin(*S.HIDDEN_EXCEPTIONS)


def normalize_repo_url(url) -> Column:
    """trim + strip trailing '/' + strip a literal '.git' suffix (Q7 fixed)."""
    u = F.regexp_replace(F.trim(_c(url)), "/+$", "")
    return F.regexp_replace(u, r"\.git$", "")


def is_valid_repo_url(url) -> Column:
    return normalize_repo_url(url).rlike(r"^https?://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$")


def repo_name_from_url(url) -> Column:
    """``owner/repo`` from the last two path segments."""
    parts = F.split(normalize_repo_url(url), "/")
    return F.when(F.size(parts) >= 2,
                  F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
                  ).otherwise(F.element_at(parts, -1))


def directory_prefixes(path) -> Column:
    """Every directory prefix of a path: ``a/b/c.py`` -> [``a``, ``a/b``]."""
    parts = path_parts(path)
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1),
                                      lambda i: F.array_join(F.slice(parts, 1, i), "/"))
                  ).otherwise(F.array().cast("array<string>"))
