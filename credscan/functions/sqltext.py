"""Helpers for expressions written as Spark SQL text.

Expressions that repeat a step for every rule or signal are generated as SQL
and parsed once by the JVM; building them operator by operator from Python
costs a round trip per operator.
"""

from __future__ import annotations


def quote(text: str) -> str:
    """A Spark SQL string literal. ``${`` would be taken for a variable, so its
    dollar is written as an octal escape."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\044{")
    return f"'{escaped}'"


def contains_any_sql(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(n)})" for n in needles) + ")"
