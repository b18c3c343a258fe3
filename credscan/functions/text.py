"""Text primitives shared by every layer.

Patterns here are spelled so that one text means the same thing to
``java.util.regex`` and to RE2: whitespace, word and digit classes are
written out (Unicode-wide) instead of relying on ``\\s``, ``\\w`` and ``\\d``,
whose reach differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.functions.sqltext import contains_any_sql, quote

# Contents of a character class: Unicode whitespace, word characters, digits.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

# The same whitespace as a plain string, for trim().
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

# Letters that fold to an ASCII one in a way lower() does not show: dotted
# capital i, dotless i, long s; and the combining dot that lower() leaves.
CAPITAL_DOTTED_I, DOTLESS_I, LONG_S, DOT_ABOVE = map(chr, (0x130, 0x131, 0x17F, 0x307))
REPLACEMENT = chr(0xFFFD)

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst substitutes aliases when it pushes a filter down or merges
    projections, which would repeat an expensive expression at every use. The value is the start of
    a fold over nothing: an element of a transformed array derives the type of ``body`` anew, down
    to its leaves, in every row and for each binding around it, and copies the result.
    """
    return F.aggregate(F.array(), value, lambda same, _: same, body)


def let_sql(value: str, name: str, body: str) -> str:
    """:func:`let` in SQL, where ``body`` knows the value by ``name``."""
    return f"aggregate(array(), {value}, ({name}, _none) -> {name}, {name} -> {body})"


def either(patterns: tuple[str, ...], lead: str = "^") -> str:
    """An expression for any of ``patterns``, those that begin with ``lead`` behind a common one: what
    is searched is tried for one alternative at most places instead of all. Where the others begin with
    letters, a place is tried only at one of these."""
    led = "|".join(f"(?:{p.removeprefix(lead)})" for p in patterns if p.startswith(lead))
    free = [p for p in patterns if not p.startswith(lead)]
    rest = [f"(?:{p})" for p in free]
    if len(free) > 1 and all(p[0] in ascii_letters for p in free):
        rest = [f"(?=[{''.join(dict.fromkeys(p[0] for p in free))}])(?:{'|'.join(rest)})"]
    return "|".join(rest + ([f"{lead}(?:{led})"] if led else []))


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WS_CHARS))


def strip_value(text: Column) -> Column:
    """:func:`strip` of a column or variable, which is read several times: most texts have a visible
    ASCII character at both ends, and a search of all kinds of whitespace for each is slow."""
    first, last = F.left(text, F.lit(1)), F.substring(text, -1, 1)
    return F.when(first.between("!", "~") & last.between("!", "~"), text).otherwise(strip(text))


def is_blank(text: Column) -> Column:
    return strip(text) == F.lit("")


def split_lines_sql(text: str) -> str:
    """Lines of a text; a final line break does not open another line."""
    return let_sql(
        f"split({text}, {quote(LINE_BREAK)}, -1)", "parts",
        "CASE WHEN element_at(parts, -1) = '' THEN slice(parts, 1, size(parts) - 1) ELSE parts END",
    )


def split_lines(column: str) -> Column:
    return F.expr(split_lines_sql(column))


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.startswith(text, F.lit(prefixes[0]))
    for prefix in prefixes[1:]:
        test = test | F.startswith(text, F.lit(prefix))
    return test


def folded_sql(text: str) -> str:
    """Lower-case a text so that plain substring tests see every letter a
    Unicode case-insensitive pattern would accept for an ASCII one.

    Only dotted/dotless i and long s need more than ``lower``; the slow
    ``translate`` runs on texts that hold one of them.
    """
    odd = contains_any_sql(text, (CAPITAL_DOTTED_I, DOTLESS_I, LONG_S))
    return (
        f"CASE WHEN {odd} THEN translate(lower({text}), "
        f"{quote(DOTLESS_I + LONG_S + DOT_ABOVE)}, 'is') ELSE lower({text}) END"
    )


def utf8_text(content: Column) -> Column:
    """Decode file bytes as UTF-8, dropping undecodable ones."""
    return F.replace(
        F.make_valid_utf8(content.cast("string")), F.lit(REPLACEMENT), F.lit("")
    )
