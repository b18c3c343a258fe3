"""What every match of an expression must contain, read off the expression."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

#: Groups of needles that are kept, the most telling ones.
MOST = 4
_REPEATS = {C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT}
#: What makes a match depend on the text around it.
_CONTEXT = {C.AT, C.ASSERT, C.ASSERT_NOT, C.GROUPREF, C.GROUPREF_EXISTS, C.ATOMIC_GROUP, C.POSSESSIVE_REPEAT}


def _parsed(pattern: str):
    """The expression's parts, or none where it is written in a dialect that isn't understood here."""
    try:
        return _parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None


def needles(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Substrings that any match holds once folded to lower case: each group holds at least one.

    Runs of plain characters count, in sequence, in groups, in what repeats at least once, and in
    alternatives if each of them has one. An expression without such runs has no needles.
    """
    parts = _parsed(pattern)
    found = [] if parts is None else _required(parts)
    found.sort(key=lambda group: (-min(map(len, group)), len(group), group))
    return tuple(dict.fromkeys(found[:MOST]))


def _required(parts) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            out.append((run,))
        run = ""

    for kind, value in parts:
        if kind is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        close()
        if kind is C.SUBPATTERN:
            out += _required(value[-1])
        elif kind in _REPEATS and value[0] >= 1:
            out += _required(value[-1])
        elif kind is C.BRANCH:
            best = [max(_required(branch), key=lambda g: min(map(len, g)), default=None) for branch in value[1]]
            if all(best):
                out.append(tuple(dict.fromkeys(needle for group in best for needle in group)))
    close()
    return out


def stands_alone(pattern: str) -> bool:
    """Whether a match in a line is also one in the text around it: nothing in the expression looks beyond."""
    parts = _parsed(pattern)
    return parts is not None and not _looks_around(parts)


def _looks_around(parts) -> bool:
    for kind, value in parts:
        if kind in _CONTEXT:
            return True
        inner = value[1] if kind is C.BRANCH else [value[-1]] if kind is C.SUBPATTERN or kind in _REPEATS else []
        if any(_looks_around(x) for x in inner):
            return True
    return False
