"""Column expressions for text: lossy decode, line splitting, snippets, diff clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line boundaries recognised by Python's str.splitlines (CRLF first so it is one break).
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def read_text_lossy(col) -> Column:
    """UTF-8 decode that drops bad bytes and applies universal newlines.

    Replacement characters that stand in the text itself are escaped (with NUL as the escape
    character) while the bad bytes are marked and dropped, so they stay.
    """
    escaped = F.replace(F.replace(_c(col), F.lit("\u0000"), F.lit("\u0000a")), F.lit("\ufffd"), F.lit("\u0000b"))
    valid = F.replace(F.make_valid_utf8(escaped), F.lit("\ufffd"), F.lit(""))
    text = F.replace(F.replace(valid, F.lit("\u0000b"), F.lit("\ufffd")), F.lit("\u0000a"), F.lit("\u0000"))
    return F.regexp_replace(text, "\r\n?", "\n")


# Characters that end a line for ``splitlines`` besides CRLF (checked on the tail).
BREAK_CHARS = "\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"


def _ends_with_break(text: Column) -> Column:
    cond = text == F.lit("")
    for ch in BREAK_CHARS:
        cond = cond | text.endswith(ch)
    return cond


def split_lines(col) -> Column:
    """Text -> array of lines, with ``splitlines`` semantics.

    One trailing empty element (text ending in a break) is dropped, so empty
    text gives an empty array and ``"a\\n\\n"`` gives ``["a", ""]``.
    In generator arguments prefer ``with_lines`` (binds the split once).
    """
    text = _c(col)
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(_ends_with_break(text), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def with_lines(df, content_col: str = "content", out: str = "_lines", keep=None):
    """``df`` plus an array-of-lines column, the regex split evaluated once per row."""
    keep = list(df.columns) if keep is None else list(keep)
    text = F.col(content_col)
    raw = df.select(*keep, F.split(text, LINE_BREAK, -1).alias("_raw"), _ends_with_break(text).alias("_eb"))
    return raw.select(*keep, F.when(F.col("_eb"), F.slice("_raw", 1, F.size("_raw") - 1))
                      .otherwise(F.col("_raw")).alias(out))


def line_count(col) -> Column:
    text = _c(col)
    parts = F.size(F.split(text, LINE_BREAK, -1))
    return (parts - F.when(_ends_with_break(text), F.lit(1)).otherwise(F.lit(0))).cast("int")


def with_neighbours(lines) -> Column:
    """array<string> -> array<struct<prev, line, next>> for one-pass snippets."""
    lines = _c(lines)
    n = F.size(lines)
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(lines, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    return F.arrays_zip(prev.alias("prev"), lines.alias("line"), nxt.alias("next"))


def snippet_from_lines(lines, start, end=None) -> Column:
    """Lines ``start-1 .. end+1`` (1-based, clipped) joined with newlines."""
    lines = _c(lines)
    start = _c(start)
    end = start if end is None else _c(end)
    lo = F.greatest(F.lit(1), start - 1)
    hi = F.least(F.size(lines), end + 1)
    return F.array_join(F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0))), "\n")


def clip_lines(col, n: int) -> Column:
    """First ``n`` lines of a text."""
    return F.array_join(F.slice(F.split(_c(col), "\n", -1), 1, n), "\n")


def last_lines(arr, n: int) -> Column:
    """Last ``n`` elements of an array (all when shorter)."""
    arr = _c(arr)
    size = F.size(arr)
    return F.when(size > n, F.slice(arr, size - n + 1, n)).otherwise(arr)
