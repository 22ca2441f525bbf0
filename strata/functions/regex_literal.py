"""Literals that a match cannot do without, for one automaton over many rules.

``required_literals(p)`` returns strings of which every match of ``p`` contains at least one, in lower case, or
``None`` where no such set is known.  The search text must be lower-cased likewise (A-Z only), which makes the set
sound for patterns that ignore case too.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

# Literals of a set: a longer set costs more than it saves.
MOST_LITERALS = 64
# Lower-case letters that non-ASCII letters match when case is ignored outside ASCII mode.
_FOLDED = set("iks")

_REPEATS = {K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT}
_ZERO_WIDTH = {K.AT, K.ASSERT, K.ASSERT_NOT}


def ascii_lower(text: str) -> str:
    """A-Z in lower case, every other character as it was (so places stay the same)."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _quality(literals: frozenset[str]) -> tuple[int, int]:
    return min(map(len, literals)), -len(literals)


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    # a single letter, digit or space is everywhere; a single sign is not
    usable = [s for s in sets if s and len(s) <= MOST_LITERALS
              and not any(len(x) < 2 and (x.isalnum() or x.isspace() or x in ("", "_")) for x in s)]
    return max(usable, key=_quality, default=None)


def _of_sequence(items, flags: int) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run: list[str] = []

    def end() -> None:
        if run:
            found.append(frozenset(["".join(run)]))
        run.clear()

    for op, value in items:
        if op is K.LITERAL:
            char = ascii_lower(chr(value))
            if flags & re.IGNORECASE and (not char.isascii() or char in _FOLDED and not flags & re.ASCII):
                end()
            else:
                run.append(char)
        elif op in _ZERO_WIDTH:
            continue
        else:
            end()
            inner = None
            if op is K.SUBPATTERN:
                _, on, off, body = value
                inner = _of_sequence(body, (flags | on) & ~off)
            elif op is K.ATOMIC_GROUP:
                inner = _of_sequence(value, flags)
            elif op is K.BRANCH:
                branches = [_of_sequence(b, flags) for b in value[1]]
                inner = None if None in branches else frozenset().union(*branches)
            elif op in _REPEATS and value[0] > 0:
                inner = _of_sequence(value[2], flags)
            if inner:
                found.append(inner)
    end()
    return _best(found)


def required_literals(pattern: str, flags: int = 0) -> frozenset[str] | None:
    try:
        parsed = _parser.parse(pattern, flags)
    except (re.error, RecursionError, OverflowError):
        return None
    return _of_sequence(parsed, parsed.state.flags)


def _newlines(items, flags: int) -> tuple[float, int] | None:
    """(most newlines that a match of the items, what they look at included, can hold; characters looked back), or None
    where the text's own beginning or end matters."""
    total, back = 0.0, 0
    for op, value in items:
        inner = None
        if op is K.LITERAL:
            total += value == 10
        elif op is K.NOT_LITERAL:
            total += value != 10
        elif op is K.ANY:
            total += bool(flags & re.DOTALL)
        elif op is K.IN:
            total += 1  # as if it took a newline; repeats of classes that cannot are told apart below
        elif op is K.AT:
            if value in (K.AT_BEGINNING, K.AT_END) and not flags & re.MULTILINE or value in (K.AT_BEGINNING_STRING, K.AT_END_STRING):
                return None
            back = max(back, 1)
        elif op is K.SUBPATTERN:
            inner = _newlines(value[3], (flags | value[1]) & ~value[2])
        elif op is K.ATOMIC_GROUP:
            inner = _newlines(value, flags)
        elif op in (K.ASSERT, K.ASSERT_NOT):
            inner = _newlines(value[1], flags)
            if value[0] < 0 and inner is not None:
                back = max(back, value[1].getwidth()[1])
        elif op is K.BRANCH:
            each = [_newlines(b, flags) for b in value[1]]
            inner = None if None in each else (max(e[0] for e in each), max(e[1] for e in each))
        elif op in _REPEATS:
            low, high, body = value
            inner = _newlines(body, flags)
            if inner is not None:
                one = 0.0 if len(body) == 1 and body[0][0] is K.IN and not _takes_newline(body[0][1]) else inner[0]
                inner = (one * (float("inf") if high is K.MAXREPEAT else high) if one else 0.0, inner[1])
        else:  # references to groups and what else there is
            return None
        if op in (K.SUBPATTERN, K.ATOMIC_GROUP, K.ASSERT, K.ASSERT_NOT, K.BRANCH) or op in _REPEATS:
            if inner is None:
                return None
            total, back = total + inner[0], max(back, inner[1])
    return total, back


def _takes_newline(choices) -> bool:
    negated = bool(choices) and choices[0][0] is K.NEGATE
    taken = False
    for op, value in choices:
        if op is K.LITERAL:
            taken |= value == 10
        elif op is K.RANGE:
            taken |= value[0] <= 10 <= value[1]
        elif op is K.CATEGORY:
            taken |= value in (K.CATEGORY_SPACE, K.CATEGORY_NOT_DIGIT, K.CATEGORY_NOT_WORD)
    return taken != negated


def line_reach(pattern: str, flags: int = 0) -> tuple[int, int] | None:
    """(newlines that a match can hold or look ahead at, characters it can look back), or None without such bounds, as
    for patterns that can match nothing or ask where the text begins or ends."""
    try:
        parsed = _parser.parse(pattern, flags)
        found = _newlines(parsed, parsed.state.flags) if parsed.getwidth()[0] > 0 else None
    except (re.error, RecursionError, OverflowError):
        return None
    return None if found is None or found[0] == float("inf") else (int(found[0]), found[1])
