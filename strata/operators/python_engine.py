"""Rules over texts in one pass: an automaton of the rules' literals, then the regexes of the rules it meets.

A rule that cannot match without one of a few literals (``required_literals``) is tried only where one stands: an
Aho-Corasick automaton over the literals of all rules of a language reads the text once, whatever the number of
rules, and a line rule's regex runs on the lines of its hits, a multiline rule's on the texts that have a hit.  Time
grows with the text and the hits.  Rules without literals are tried on every line or text; the scan gives only those
here that the JVM's regex engine does not take.

Patterns are Python's own, with the flags their rule carries; they are compiled when first needed and kept by the worker.

Where the caller says from which size texts are large, such a text whose only line breaks are newlines is cut into chunks
of whole lines, scanned by many tasks.
Chunks carry the number of lines before them, and as many lines after them as a match can reach (``line_reach``).  A chunk
reports, for each multiline rule, the match at every place of its own lines; which of the overlapping ones a scan of
the whole text would find (always the first that begins at or after the end of the last) is decided by one pass over the
matches of a file and rule in order.  Rules without a bound on their reach read the whole text in one task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import schemas as S
from strata.functions.regex_literal import ascii_lower, line_reach
from strata.session import bound_batches

ANY_LANGUAGE = ("", "any")
# Characters of a chunk of a large text.
CHUNK_CHARS = 1 << 20
# Line breaks besides the newline.
OTHER_BREAKS = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
HITS = "repo_id string, file_path string, line_number int, end_line int, code_snippet string, _slot int"


@lru_cache(maxsize=20_000)
def _compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)


class RuleBook:
    """The rules of one language: (slot, pattern, flags, literals, multiline), ready to run over texts."""

    def __init__(self, rules: list[tuple[int, str, int, frozenset[str] | None, bool]]) -> None:
        self.patterns = {slot: (pattern, flags) for slot, pattern, flags, _, _ in rules}
        self.always = [(slot, multiline) for slot, _, _, literals, multiline in rules if not literals]
        self.multiline = {slot for slot, _, _, _, multiline in rules if multiline}
        by_literal = defaultdict(list)
        for slot, _, _, literals, _ in rules:
            for x in literals or ():
                by_literal[x].append(slot)
        self.automaton = None
        if by_literal:
            self.automaton = ahocorasick.Automaton()
            for x, slots in by_literal.items():
                self.automaton.add_word(x, tuple(slots))
            self.automaton.make_automaton()

    def regex(self, slot: int) -> re.Pattern:
        return _compiled(*self.patterns[slot])

    def matches(self, text: str, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(slot, start, end) of the match of every multiline rule at every place from ``begin`` to ``end`` - 1."""
        meant = {slot for slot, multiline in self.always if multiline}
        if self.automaton is not None:
            meant |= {s for _, slots in self.automaton.iter(ascii_lower(text)) for s in slots if s in self.multiline}
        for slot in meant:
            search = self.regex(slot).search
            m = search(text, begin)
            while m and m.start() < end:
                yield slot, m.start(), m.end()
                m = search(text, m.start() + 1)

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(slot, first line, last line) of every finding."""
        lines: list[str] | None = None
        meant: dict[int, set[int]] = {}  # line rules by the lines that hold one of their literals
        whole: set[int] = set()
        if self.automaton is not None:
            ends, line = [], 0
            for at, slots in self.automaton.iter(ascii_lower(text)):
                if lines is None:
                    lines = text.splitlines()
                    end = 0
                    for kept in text.splitlines(keepends=True):
                        end += len(kept)
                        ends.append(end)
                while at >= ends[line]:
                    line += 1
                for slot in slots:
                    if slot in self.multiline:
                        whole.add(slot)
                    else:
                        meant.setdefault(line, set()).add(slot)
        for line, slots in meant.items():
            for slot in slots:
                if self.regex(slot).search(lines[line]):
                    yield slot, line + 1, line + 1
        for slot, multiline in self.always:
            if multiline:
                whole.add(slot)
            else:
                search = self.regex(slot).search
                lines = text.splitlines() if lines is None else lines
                yield from ((slot, n, n) for n, line in enumerate(lines, start=1) if search(line))
        for slot in whole:
            at, line = 0, 1
            for m in self.regex(slot).finditer(text):
                line += text.count("\n", at, m.start())
                at = m.start()
                yield slot, line, line + m.group(0).count("\n")


Specs = list[tuple[str, tuple[int, str, int, frozenset[str] | None, bool]]]


class _Books:
    """The rule book of each language, made when first needed."""

    def __init__(self, specs: Specs) -> None:
        self.specs, self.languages, self.known = specs, {language for language, _ in specs}, {}

    def of(self, language: str) -> RuleBook:
        # languages without rules of their own share the book of those that apply to all
        own = language if language in self.languages else ""
        if own not in self.known:
            self.known[own] = RuleBook([spec for of, spec in self.specs if of in ANY_LANGUAGE or of == own])
        return self.known[own]


# Findings and characters of snippets that a worker holds before it hands them on.
HELD_FINDINGS, HELD_CHARS = 1024, 1 << 20


def _in_parts(found: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Findings (snippet in the fifth place) as frames of bounded size, however many a batch of texts has."""
    out, held = [], 0
    for row in found:
        out.append(row)
        held += len(row[4])
        if len(out) >= HELD_FINDINGS or held >= HELD_CHARS:
            yield pd.DataFrame(out, columns=names)
            out, held = [], 0
    yield pd.DataFrame(out, columns=names)


_NAMES = ["repo_id", "file_path", "line_number", "end_line", "code_snippet", "_slot"]


def _snippet(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[max(0, first - 2):min(len(lines), last + 1)])


def _scan_whole(texts: DataFrame, specs: Specs) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = _Books(specs)

        def found(pdf: pd.DataFrame) -> Iterator[tuple]:
            for repo, path, language, text in zip(pdf["repo_id"], pdf["path"], pdf["language"], pdf["content"]):
                lines = None
                for slot, first, last in books.of(language).hits(text):
                    lines = text.splitlines() if lines is None else lines
                    yield repo, path, first, last, _snippet(lines, first, last), slot

        for pdf in batches:
            yield from _in_parts(found(pdf), _NAMES)

    bound_batches(texts.sparkSession)
    return texts.mapInPandas(run, HITS)


def cut_into_chunks(text: str, size: int, after: int, back: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(chunk's place, lines before the window, where its own lines begin in the window, and end, window): whole lines,
    with a line and ``back`` characters before them, and ``after`` lines after."""
    begin = lines = 0
    while begin < len(text):
        end = text.find("\n", min(begin + size, len(text)) - 1) + 1 or len(text)
        left = text.rfind("\n", 0, max(begin - 1 - back, 0)) + 1
        right = end
        for _ in range(after):
            right = text.find("\n", right) + 1 or len(text)
        yield begin, lines - text.count("\n", left, begin), begin - left, end - left, text[left:right]
        lines += text.count("\n", begin, end)
        begin = end


def _scan_chunks(texts: DataFrame, specs: Specs, after: int, back: int) -> DataFrame:
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for repo, path, language, text in zip(pdf["repo_id"], pdf["path"], pdf["language"], pdf["content"]):
                for at, before, begin, end, window in cut_into_chunks(text, CHUNK_CHARS, after, back):
                    yield pd.DataFrame([(repo, path, language, at, before, begin, end, window)], columns=[c.split()[0] for c in chunk.split(", ")])

    chunk = "repo_id string, path string, language string, at long, lines_before long, own_begin long, own_end long, window string"
    bound_batches(texts.sparkSession)
    dealt = texts.mapInPandas(split, chunk).repartition("repo_id", "path", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = _Books(specs)

        def found(pdf: pd.DataFrame) -> Iterator[tuple]:
            for repo, path, language, at, before, begin, end, window in pdf.itertuples(index=False):
                book, lines = books.of(language), window.splitlines()
                lead = window.count("\n", 0, begin)
                for slot, first, last in book.hits(window[begin:end]):
                    if slot not in book.multiline:
                        yield (repo, path, before + lead + first, before + lead + last, _snippet(lines, lead + first, lead + last),
                               slot, None, None)
                for slot, start, stop in book.matches(window, begin, end):
                    first = window.count("\n", 0, start) + 1
                    last = first + window.count("\n", start, stop)
                    yield repo, path, before + first, before + last, _snippet(lines, first, last), slot, at - begin + start, at - begin + stop

        for pdf in batches:
            yield from _in_parts(found(pdf), [*_NAMES, "_start", "_stop"])

    found = dealt.mapInPandas(run, HITS + ", _start long, _stop long")
    ordered = (found.filter("_start IS NOT NULL").repartition("repo_id", "file_path", "_slot")
               .sortWithinPartitions("repo_id", "file_path", "_slot", "_start"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free = None, 0
        for pdf in batches:
            keep = []
            for repo, path, slot, start, stop in zip(pdf["repo_id"], pdf["file_path"], pdf["_slot"], pdf["_start"], pdf["_stop"]):
                if key != (repo, path, slot):
                    key, free = (repo, path, slot), 0
                keep.append(start >= free)
                free = stop if keep[-1] else free
            yield pdf.loc[keep, _NAMES]

    return found.filter("_start IS NULL").drop("_start", "_stop").union(ordered.mapInPandas(choose, HITS))


def scan_texts(files: DataFrame, rules: list[dict], large_chars: int | None = None) -> DataFrame:
    """One row per hit: repo_id, file_path, line_number, end_line, code_snippet and the rule's 1-based place in
    ``rules`` as ``_slot``; line rules hit a line once, multiline rules at every match.

    Texts of over ``large_chars`` characters are scanned in chunks (a pass of their own); without it every text is
    scanned where it lies.
    """
    specs: Specs = [(r["language"], (i, r["pattern"] or "", r["flags"], r["literals"], r["match_type"] == "regex_multiline"))
                    for i, r in enumerate(rules, start=1)]
    texts = files.select("repo_id", "path", F.lower(F.coalesce("language", F.lit(""))).alias("language"), "content").filter(
        "content IS NOT NULL")

    def of_rules(rows: DataFrame, some: Specs) -> DataFrame:
        languages = {language for language, _ in some}
        return rows if not languages.isdisjoint(ANY_LANGUAGE) else rows.filter(F.col("language").isin(*sorted(languages)))

    if large_chars is None:
        return _scan_whole(of_rules(texts, specs), specs)
    reach = {spec[0]: line_reach(spec[1], spec[2]) if spec[4] else (0, 0) for _, spec in specs}
    near = [s for s in specs if reach[s[1][0]] is not None]
    far = [s for s in specs if reach[s[1][0]] is None]
    large = (F.length("content") > large_chars) & ~F.col("content").rlike(OTHER_BREAKS)
    out = _scan_whole(of_rules(texts.filter(~large), specs), specs)
    if near:
        after = 2 + max(reach[s[1][0]][0] for s in near)
        out = out.union(_scan_chunks(of_rules(texts.filter(large), near), near, after, max(reach[s[1][0]][1] for s in near)))
    if far:
        out = out.union(_scan_whole(of_rules(texts.filter(large), far), far))
    return out


def python_engine(analyze, name: str = "python"):
    """Wrap ``analyze(file_path, language, content) -> iterable of dicts`` as an engine.

    The returned function has the registry signature ``(files, rules) -> findings``
    and runs ``analyze`` inside Spark tasks (``mapInPandas`` over the partitioned
    file rows).  A call that raises yields nothing for that file, so one bad
    file or engine bug never fails the scan.  Missing finding fields take the
    catalogue defaults.
    """
    def engine(files: DataFrame, rules) -> DataFrame:
        def run(batches):
            for pdf in batches:
                out = []
                for repo, path, lang, text in zip(pdf["repo_id"], pdf["path"], pdf["language"], pdf["content"]):
                    try:
                        found = list(analyze(path, lang, text) or [])
                    except Exception:  # engine errors yield nothing
                        continue
                    for f in found:
                        rid = str(f.get("rule_id", "unknown"))
                        line = int(f.get("line_number", 0) or 0)
                        out.append((repo, rid, name, path, line, f.get("severity", S.DEFAULT_RULE_SEVERITY),
                                    f.get("defect_family", S.DEFAULT_RULE_FAMILY), f.get("message", S.DEFAULT_MESSAGE),
                                    f.get("fix_hint"), f.get("cwe_id"), f.get("owasp_ref"), f.get("code_snippet"),
                                    f.get("issue_type", rid), int(f.get("end_line", line) or line),
                                    int(f.get("column", 1) or 1)))
                yield pd.DataFrame(out, columns=S.FINDING_COLUMNS)

        bound_batches(files.sparkSession)
        return files.select("repo_id", "path", "language", "content").mapInPandas(run, S.FINDINGS)

    return engine
