"""Verdicts on the blocks around many lines of one text, in time in proportion to the text.

Blocks that end at one line are suffixes of each other's lines. Each would be read again for every
hit that opens one, as every hit does in a text without function marks. Here the lines are scanned
once for all blocks of one end: literals get the line they start on, and for a block only what lies
at or below its first line counts. That holds wherever the scan enters the first line outside a
literal; blocks whose first line it enters inside one are scanned again, from the first of them, so
there are as many scans as ways in which quotes can be paired. A group is known by the last line of
each distinct element (its size) and of each signal (its probability).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.functions.groups import MIN_LITERAL, STRING_LITERAL, block_text, string_group, urls
from credscan.functions.signals import NEGATIVE_SIGNALS, POSITIVE_SIGNALS, SIGNAL_MODEL, classify_group, labelled
from credscan.functions.text import let

#: Blocks of one end that are read one by one; scans, beyond which blocks are read so again; and lines
#: that up to four times as many blocks may have together to be read one by one, which is cheaper then.
FEW, SCANS, LINES = 4, 8, 300
# Marks around the line numbers put before each line: code points that texts don't use.
_OPEN, _CLOSE = chr(0xFDD0), chr(0xFDD1)
_MARK = rf"{_OPEN}[0-9]+{_CLOSE}"
# From one mark outside literals to the next, literals first.
_PIECE = rf"""(?d){_MARK}(?:[^"'{_OPEN}]++|{STRING_LITERAL.removeprefix("(?d)")}|["'])*+"""
_VERDICT = "struct<probability:double,classification:string,model_used:string,string_group_size:int>"
_DONE = f"array<struct<ats:array<int>,verdict:{_VERDICT}>>"
_SIGNALS = POSITIVE_SIGNALS + NEGATIVE_SIGNALS


def runs(rows: Column, key: Callable[[Column], Column]) -> Column:
    """A sorted array as arrays of neighbours with equal keys."""
    count = F.size(rows)
    starts = F.filter(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (key(F.get(rows, i)) != key(F.get(rows, i - 1))),
    )
    return let(starts, lambda s: F.transform(s, lambda i, j: F.slice(rows, i + 1, F.coalesce(F.get(s, j + 1), count) - i)))


def _one_by_one(lines: Column, blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(
        b["ats"].alias("ats"), classify_group(string_group(block_text(lines, b))).alias("verdict"),
    ))


def _literals(lines: Column, first: Column, last: Column) -> Column:
    """Pieces ``(line, found)`` of the lines from ``first``: a line that a scan from there enters
    outside a literal, and the literals from it to the next such line."""
    marked = F.transform(
        F.slice(lines, first, last - first + 1),
        lambda line, i: F.concat(F.lit(_OPEN), (first + i).cast("string"), F.lit(_CLOSE), line),
    )
    pieces = F.regexp_extract_all(F.array_join(marked, "\n"), F.lit(_PIECE), F.lit(0))

    def quoted(piece: Column) -> Column:
        return F.filter(
            F.transform(
                F.regexp_extract_all(piece, F.lit(STRING_LITERAL), F.lit(0)),
                lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), _MARK, ""),
            ),
            lambda s: F.length(s) >= MIN_LITERAL,
        )

    return F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, rf"^{_OPEN}([0-9]+)", 1).cast("int").alias("line"), quoted(p).alias("found"),
    ))


def _parted_signals(elements: Column) -> Column:
    """Whether two elements side by side could make a signal that neither holds."""
    test = F.lit(False)
    for signal, _ in _SIGNALS:
        words = signal.split(" ")
        for k in range(1, len(words)):
            left, right = " ".join(words[:k]), " ".join(words[k:])
            test = test | (F.exists(elements, _tested(F.endswith, left)) & F.exists(elements, _tested(F.startswith, right)))
    return test


def _tested(test: Callable[[Column, Column], Column], part: str) -> Callable[[Column], Column]:
    return lambda e: test(F.lower(e["text"]), F.lit(part))


def _last_lines(elements: Column) -> Column:
    """For each signal the last line of an element that holds it, or 0."""
    low = F.transform(elements, lambda e: F.struct(F.lower(e["text"]).alias("text"), e["line"].alias("line")))
    return let(low, lambda es: F.array(*[
        F.coalesce(F.array_max(F.transform(F.filter(es, _holds(signal)), lambda e: e["line"])), F.lit(0))
        for signal, _ in _SIGNALS
    ]))


def _holds(signal: str) -> Callable[[Column], Column]:
    return lambda e: F.contains(e["text"], F.lit(signal))


def _by_position(elements: Column, blocks: Column) -> Column:
    """Verdicts on suffixes: on what of ``elements`` lies at or below the first line of each block."""
    lasts = let(F.sort_array(elements), lambda es: F.transform(
        F.filter(F.transform(es, lambda e, i: F.struct(e.alias("e"), F.get(es, i + 1)["text"].alias("next"))),
                 lambda x: x["next"].isNull() | (x["next"] != x["e"]["text"])),
        lambda x: x["e"]["line"],
    ))
    # block starts among the last lines, downwards: what comes before one is in its block
    none = F.lit(None).cast("int")
    mixed = F.sort_array(F.concat(
        F.transform(lasts, lambda x: F.struct((-x).alias("minus"), F.lit(0).alias("kind"), none.alias("block"))),
        F.transform(blocks, lambda b, j: F.struct((-b["first"]).alias("minus"), F.lit(1).alias("kind"), j.alias("block"))),
    ))
    counted = F.transform(
        F.filter(F.transform(mixed, lambda x, p: F.struct(x.alias("x"), p.alias("p"))), lambda y: y["x"]["kind"] == 1),
        lambda y, j: F.struct(y["x"]["block"].alias("block"), (y["p"] - j).alias("n")),
    )

    def verdict(first: Column, n: Column, tops: Column) -> Column:
        total = F.lit(50)
        for i, (_, weight) in enumerate(_SIGNALS):
            total = total + F.when(F.get(tops, F.lit(i)) >= first, weight).otherwise(0)
        return labelled(n, F.greatest(F.least(total, F.lit(100)), F.lit(0)) / F.lit(100.0), SIGNAL_MODEL)

    return let(_last_lines(elements), lambda tops: F.transform(counted, lambda c: let(
        F.get(blocks, c["block"]),
        lambda b: F.struct(b["ats"].alias("ats"), verdict(b["first"], c["n"], tops).alias("verdict")),
    )))


def _suffixes(lines: Column, blocks: Column) -> Column:
    """Verdicts on blocks of one end, by first line ascending."""
    last = F.get(blocks, F.lit(0))["last"]
    top = F.get(blocks, F.lit(0))["first"]
    found_urls = F.flatten(F.transform(
        F.slice(lines, top, last - top + 1),
        lambda line, i: F.transform(urls(line), lambda u: F.struct(u.alias("text"), (top + i).alias("line"))),
    ))

    def scanned(state: Column, links: Column) -> Column:
        todo = state["todo"]

        def split(pieces: Column) -> Column:
            none = F.lit(None).cast("int")
            marked = F.sort_array(F.concat(
                F.transform(pieces, lambda p: F.struct(p["line"].alias("line"), F.lit(0).alias("kind"), none.alias("block"))),
                F.transform(todo, lambda b, j: F.struct(b["first"].alias("line"), F.lit(1).alias("kind"), j.alias("block"))),
            ))
            entered = let(marked, lambda ms: F.filter(
                F.transform(ms, lambda m, i: F.struct(m["block"].alias("block"), m["kind"].alias("kind"), (
                    (F.get(ms, i - 1)["line"] == m["line"]) & (F.get(ms, i - 1)["kind"] == 0)).alias("here"))),
                lambda m: m["kind"] == 1,
            ))
            literals = F.flatten(F.transform(pieces, lambda p: F.transform(
                p["found"], lambda s: F.struct(s.alias("text"), p["line"].alias("line")))))

            def at(test: Callable[[Column], Column], es: Column) -> Column:
                return F.transform(F.filter(es, test), lambda m: F.get(todo, m["block"]))

            return let(entered, lambda es: let(F.concat(literals, links), lambda elements: F.struct(
                at(lambda m: ~F.coalesce(m["here"], F.lit(False)), es).alias("todo"),
                F.concat(state["done"], let(at(lambda m: F.coalesce(m["here"], F.lit(False)), es), lambda now: F.when(
                    _parted_signals(elements), _one_by_one(lines, now)).otherwise(_by_position(elements, now)))).cast(_DONE).alias("done"),
            )))

        return F.when(F.size(todo) == 0, state).otherwise(
            let(_literals(lines, F.get(todo, F.lit(0))["first"], last), split)
        )

    start = F.struct(blocks.alias("todo"), F.array().cast(_DONE).alias("done"))
    ended = let(found_urls, lambda links: F.aggregate(
        F.sequence(F.lit(1), F.lit(SCANS)), start, lambda state, _: scanned(state, links)))
    return let(ended, lambda s: F.concat(s["done"], _one_by_one(lines, s["todo"]).cast(_DONE)))


def block_verdicts(lines: Column, bounds: Column) -> Column:
    """The signal classifier's verdict on each block of ``bounds`` (first, last), in order."""
    same = F.size(F.array_distinct(bounds)) == 1
    only = classify_group(string_group(block_text(lines, F.get(bounds, F.lit(0)))))
    return F.when(same, F.array_repeat(only, F.size(bounds))).otherwise(_block_verdicts(lines, bounds))


def _block_verdicts(lines: Column, bounds: Column) -> Column:
    keyed = F.sort_array(F.transform(bounds, lambda b, i: F.struct(b["last"].alias("last"), b["first"].alias("first"), i.alias("at"))))
    blocks = let(keyed, lambda ks: F.transform(
        runs(ks, lambda k: F.struct(k["last"], k["first"])),
        lambda run: F.struct(
            F.get(run, F.lit(0))["last"].alias("last"), F.get(run, F.lit(0))["first"].alias("first"),
            F.transform(run, lambda k: k["at"]).alias("ats"),
        ),
    ))
    odd = F.exists(lines, lambda line: F.contains(line, F.lit(_OPEN)) | F.contains(line, F.lit(_CLOSE)))

    def judged(run: Column) -> Column:
        few = _one_by_one(lines, run).cast(_DONE)
        longest = F.get(run, F.lit(0))["last"] - F.get(run, F.lit(0))["first"] + 1
        short = (F.size(run) <= 4 * FEW) & (F.size(run) * longest <= LINES)
        return F.when((F.size(run) <= FEW) | short | odd, few).otherwise(_suffixes(lines, run))

    found = let(blocks, lambda bs: F.flatten(F.transform(runs(bs, lambda b: b["last"]), judged)))
    each = F.flatten(F.transform(found, lambda r: F.transform(r["ats"], lambda at: F.struct(at.alias("at"), r["verdict"].alias("verdict")))))
    return F.transform(F.sort_array(each), lambda x: x["verdict"])
