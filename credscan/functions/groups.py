"""String groups: the literals and URLs of the block around a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.functions.text import WS, let, starts_with_any, strip

# Possessive quantifiers keep the JVM matcher iterative: no stack growth on
# long literals, and a literal never has to be re-scanned. A backslash may not
# escape a line feed, hence the Unix-lines flag.
STRING_LITERAL = (
    r'(?d)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
)
URL = rf"""https?://[^{WS}"'<>]+"""
MIN_LITERAL = 3

# What opens and what ends a block (fixed values): `class` only ends one and
# `protected` only opens one.
BLOCK_OPENERS = ("def ", "async def ", "function ", "public ", "private ", "protected ")
BLOCK_ENDERS = ("def ", "async def ", "class ", "function ", "public ", "private ")


def string_literals(code: Column) -> Column:
    """Contents of quoted strings of three or more characters, in order."""
    return F.filter(
        F.transform(
            F.regexp_extract_all(code, F.lit(STRING_LITERAL), F.lit(0)),
            lambda quoted: F.substring(quoted, F.lit(2), F.length(quoted) - 2),
        ),
        lambda s: F.length(s) >= MIN_LITERAL,
    )


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def string_group(code: Column) -> Column:
    """Literals, then URLs, each once, in first-seen order."""
    return F.array_distinct(F.concat(string_literals(code), urls(code)))


def block_marks(lines: Column) -> Column:
    """Two strings with one character per line: ``above`` marks openers (S) and
    blank lines (B), ``below`` marks enders (E). Finding the nearest mark is
    then a native substring search, not a lambda over all lines."""

    def above(line: Column) -> Column:
        return let(strip(line), lambda s: F.when(s == F.lit(""), "B")
                   .when(starts_with_any(s, BLOCK_OPENERS), "S").otherwise("."))

    def below(line: Column) -> Column:
        return let(strip(line), lambda s: F.when(starts_with_any(s, BLOCK_ENDERS), "E").otherwise("."))

    return F.struct(
        F.array_join(F.transform(lines, above), "").alias("above"),
        F.array_join(F.transform(lines, below), "").alias("below"),
    )


def _last_mark(marks: Column, upto: Column, mark: str) -> Column:
    """Position of the last ``mark`` among the first ``upto`` lines, or 0."""
    head = F.substring(marks, F.lit(1), upto)
    return F.length(head) - F.length(F.substring_index(head, mark, -1))


def block_bounds(marks: Column, line_no: Column) -> Column:
    """Struct ``(first, last)``: 1-based lines of the block around a line.

    Going up, the nearest opener starts the block, or the line below the
    nearest blank line that is at least two lines up; with neither the block
    starts at the line itself. It runs to the line before the next ender, or
    to the end.
    """
    opener = _last_mark(marks["above"], line_no, "S")
    blank = _last_mark(marks["above"], F.greatest(line_no - 2, F.lit(0)), "B")
    first = F.when((opener == 0) & (blank == 0), line_no).otherwise(
        F.greatest(opener, F.when(blank > 0, blank + 1).otherwise(0))
    )
    ender = F.position(F.lit("E"), marks["below"], line_no + 1)
    return F.struct(
        first.cast("int").alias("first"),
        F.when(ender > 0, ender - 1).otherwise(F.length(marks["below"])).cast("int").alias("last"),
    )


def _counts(places: Column, queries: Column) -> Column:
    """For each of ascending ``queries`` how many of ascending ``places`` are not above it: in one
    sorted array of both, all that is before a query but the queries."""
    mixed = F.sort_array(F.concat(
        F.transform(places, lambda x: F.struct(x.alias("at"), F.lit(0).alias("kind"))),
        F.transform(queries, lambda x: F.struct(x.alias("at"), F.lit(1).alias("kind"))),
    ))
    numbered = F.transform(mixed, lambda x, p: F.struct(x["kind"].alias("kind"), p.alias("p")))
    return F.transform(F.filter(numbered, lambda x: x["kind"] == 1), lambda x, j: x["p"] - j)


def blocks_around(lines: Column, line_nos: Column) -> Column:
    """:func:`block_bounds` of ascending line numbers, in time in proportion to the text."""

    def places(test: Callable[[Column], Column]) -> Column:
        marked = F.transform(lines, lambda line, i: F.when(test(line), i + 1))
        return F.filter(marked, lambda at: at.isNotNull())

    def begins(words: tuple[str, ...]) -> Callable[[Column], Column]:
        # of the stripped line: the blank that ends a mark is gone where nothing follows it
        return lambda line: line.rlike(rf"^[{WS}]*+(?:{'|'.join(words)})[{WS}]*+[^{WS}]")

    def bounds(openers: Column, blanks: Column, enders: Column) -> Column:
        above = F.transform(line_nos, lambda n: n - 2)
        counts = F.struct(
            _counts(openers, line_nos).alias("openers"), _counts(blanks, above).alias("blanks"), _counts(enders, line_nos).alias("enders"),
        )

        def of(n: Column, j: Column, c: Column) -> Column:
            opener = F.coalesce(F.get(openers, F.get(c["openers"], j) - 1), F.lit(0))
            blank = F.coalesce(F.get(blanks, F.get(c["blanks"], j) - 1), F.lit(0))
            first = F.when((opener == 0) & (blank == 0), n).otherwise(
                F.greatest(opener, F.when(blank > 0, blank + 1).otherwise(0))
            )
            return F.struct(
                first.cast("int").alias("first"),
                F.coalesce(F.get(enders, F.get(c["enders"], j)) - 1, F.size(lines)).cast("int").alias("last"),
            )

        return let(counts, lambda c: F.transform(line_nos, lambda n, j: of(n, j, c)))

    return let(places(begins(BLOCK_OPENERS)), lambda openers:
               let(places(lambda line: line.rlike(rf"^[{WS}]*+$")), lambda blanks:
                   let(places(begins(BLOCK_ENDERS)), lambda enders: bounds(openers, blanks, enders))))


def block_text(lines: Column, bounds: Column) -> Column:
    return F.array_join(
        F.slice(lines, bounds["first"], bounds["last"] - bounds["first"] + 1), "\n"
    )


def block_context(lines: Column, line_no: Column) -> Column:
    """Text of the block around one line of an array of lines."""
    return let(
        block_bounds(block_marks(lines), line_no), lambda b: block_text(lines, b)
    )
