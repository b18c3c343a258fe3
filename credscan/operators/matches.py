"""Rule matching: which texts can hold a match, and every match of every rule."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credscan.functions.literals import stands_alone
from credscan.functions.sqltext import contains_any_sql, quote
from credscan.functions.text import WS_CHARS, folded_sql, let_sql, split_lines_sql
from credscan.rules import RULES, Rule

MATCH_TYPE = "array<struct<rule_ord:int,match_ord:int,secret:string>>"


def may_match(rule: Rule) -> str:
    """Necessary condition on a folded text ``low``: it holds the rule's needles."""
    return " AND ".join(contains_any_sql("low", group) for group in rule.needles) or "true"


def _matches_whole(rule: Rule, text: str) -> str:
    """Necessary condition on a whole text for a match in one of its lines.

    Catalogue expressions may be lowered and run over the folded text. Others run as they are, and
    not at all if they look at what stands around a match, which differs between line and text.
    """
    if not rule.custom:
        return f"low RLIKE {quote(rule.folded_regex)}"
    return f"{text} RLIKE {quote(rule.regex)}" if stands_alone(rule.pattern) else "true"


@cache
def candidate_sql(text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """Whether a whole text can hold a match on any of its lines.

    A superset test in one pass per needle, without splitting: a rule that
    matches a line also matches the text around it, because expressions that
    allow whitespace only get more room. Almost all texts stop here.
    """
    tests = [f"({may_match(r)} AND {_matches_whole(r, text)})" for r in rules] or ["false"]
    return f"exists(array({folded_sql(text)}), low -> {' OR '.join(tests)})"


@cache
def _matches_of_line(rules: tuple[Rule, ...]) -> str:
    """Array of ``(rule_ord, match_ord, secret)``, for ``line`` and its folded
    form ``low``."""
    each = []
    for ordinal, rule in enumerate(rules):
        found = f"regexp_extract_all(line, {quote(rule.regex)}, 0)"
        if rule.min_length > 1:
            found = f"filter({found}, secret -> length(secret) >= {rule.min_length})"
        each.append(
            f"CASE WHEN {may_match(rule)} THEN transform({found}, (secret, i) -> "
            f"named_struct('rule_ord', {ordinal}, 'match_ord', i, 'secret', secret)) "
            f"ELSE CAST(array() AS {MATCH_TYPE}) END"
        )
    # flatten() and not concat(), which is slow outside generated code; of a name, as it asks for the type each time
    return let_sql(f"array({', '.join(each) or f'CAST(array() AS {MATCH_TYPE})'})", "each", "flatten(each)")


@cache
def hit_lines_sql(lines: str, at: str = "i + 1", rules: tuple[Rule, ...] = RULES) -> str:
    """Array of ``(line_no, at, line, matches)`` for the lines that have a match.

    ``at`` is where the line stands in its source, given its 0-based index
    ``i``; it differs from the line number when lines were cut from a patch.
    Matches stay nested under their line: a long line with many matches is
    held once, and is copied only as rows stream out of the explode.
    """
    matches = let_sql(folded_sql("line"), "low", _matches_of_line(rules))
    return (
        f"filter(transform({lines}, (line, i) -> named_struct('line_no', i + 1, "
        f"'at', CAST({at} AS int), 'line', line, "
        f"'matches', CASE WHEN btrim(line, {quote(WS_CHARS)}) != '' THEN {matches} END)), "
        "hit -> size(hit.matches) > 0)"
    )


@cache
def candidate_lines_sql(text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """Lines of a text that can hold a match, or null without splitting it.

    A conditional rather than a filter: a filter would be pushed below the
    repartitioning of a small input and run on too few cores.
    """
    return f"CASE WHEN {candidate_sql(text, rules)} THEN {split_lines_sql(text)} END"


#: Attributes of a rule that findings carry: their type, and how a rule gives them.
ATTRIBUTES = {
    "rule_id": ("string", lambda r: r.rule_id),
    "description": ("string", lambda r: r.description),
    "rule_severity": ("string", lambda r: r.severity),
    "tier": ("int", lambda r: str(r.tier)),
    "regex_score": ("double", lambda r: r.weight),
}


@cache
def rule_column(field: str, ordinal: str = "rule_ord", rules: tuple[Rule, ...] = RULES) -> Column:
    """A catalogue attribute by rule ordinal: the catalogue is part of the plan,
    so it travels as a literal array instead of a join."""
    kind, value = ATTRIBUTES[field]
    array = f"array({', '.join(quote(value(r)) for r in rules)})"
    return F.expr(f"get(CAST({array} AS array<{kind}>), {ordinal})").alias(field)


def explode_late(df: DataFrame, array: str, alias: str, *keep: str) -> DataFrame:
    """Explode a costly computed array.

    A plain explode makes the optimizer infer a "not empty" filter and push it
    to the scan, computing the array twice, once of it before a small input is
    spread out. The outer form has no such filter; empty rows go afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(alias)).where(F.col(alias).isNotNull())


def matches(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per match: the ``keep`` columns, line number and line, rule and
    matched text."""
    lines = df.select(*keep, F.expr(candidate_lines_sql(text, rules)).alias("lines"))
    hits = lines.select(*keep, F.expr(hit_lines_sql("lines", rules=rules)).alias("hits"))
    return (
        explode_late(hits, "hits", "hit", *keep)
        .select(*keep, "hit.line_no", "hit.line", F.explode("hit.matches").alias("m"))
        .select(
            *keep, "line_no", "line", "m.rule_ord", "m.match_ord",
            rule_column("rule_id", "m.rule_ord", rules), "m.secret",
        )
    )


def matches_per_rule(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per text and rule: its matches ``n`` and the ``lines`` that have one, counted in the text's row."""
    lines = df.select(*keep, F.expr(candidate_lines_sql(text)).alias("lines"))
    hits = lines.select(*keep, F.expr(hit_lines_sql("lines")).alias("hits"))
    found = hits.select(*keep, F.expr("flatten(transform(hits, h -> h.matches))").alias("found"))
    per_rule = found.select(*keep, F.expr("""
        transform(array_distinct(transform(found, m -> m.rule_ord)), r -> struct(
            r AS rule_ord, cast(size(filter(found, m -> m.rule_ord = r)) as bigint) AS n,
            cast(size(filter(found, m -> m.rule_ord = r AND m.match_ord = 0)) as bigint) AS lines))""").alias("rules"))
    rows = explode_late(per_rule, "rules", "r", *keep)
    return rows.select(*keep, rule_column("rule_id", "r.rule_ord"), "r.n", "r.lines")


def tiered(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the confidence tier and its weight to matches."""
    return found.select("*", rule_column("tier", rules=rules), rule_column("regex_score", rules=rules))
