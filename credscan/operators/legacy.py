"""The single-layer detector: rules with static severity, and generic
high-entropy strings near a credential word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credscan.functions.entropy import (
    HIGH_ENTROPY_MIN_LENGTH,
    HIGH_ENTROPY_THRESHOLD,
    shannon_entropy,
)
from credscan.functions.sqltext import contains_any_sql, quote
from credscan.functions.text import WS_CHARS, let, split_lines_sql, starts_with_any, strip
from credscan.operators.matches import candidate_sql, explode_late, matches, rule_column
from credscan.operators.scan import keep_rows
from credscan.rules import HIGH_ENTROPY_RULE
from credscan.sources.paths import is_binary_file, skipped_by_entropy

# Fixed values.
CONTEXT_WORDS = (
    "key", "secret", "token", "password", "pwd", "api", "auth", "credential",
    "pass", "private", "access", "session", "jwt", "bearer", "client_id",
    "client_secret", "id_token", "refresh_token",
)
NEGATIVE_WORDS = ("test", "fake", "dummy", "example", "sample", "mock", "placeholder")
COMMENT_MARKS = ("#", "//", "/*", "* ", '"""', "'''")
WINDOW = 50
HIGH_SEVERITY_ENTROPY = 4.2
SHOWN = 180
DATA_URI = "data:[^;]+;base64,"
# A greedy run of a class is maximal by itself; no look-around is needed.
RUN = rf"[A-Za-z0-9+/=._-]{{{HIGH_ENTROPY_MIN_LENGTH},}}"


def rule_findings(df: DataFrame, text: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rule matches, except on lines that open with a word for fake data."""
    cols = (*keep, "file_path")
    found = matches(df, text, cols).where(
        ~starts_with_any(F.ltrim(F.lower("line"), F.lit(WS_CHARS)), NEGATIVE_WORDS)
    )
    return found.select(
        *cols, "line_no", "rule_id", rule_column("description"), "match_ord", "secret",
        strip(F.col("line")).alias("line_content"),
        rule_column("rule_severity").alias("severity"),
    )


def _run_lines_sql(lines: str) -> str:
    """Array of ``(line_no, line, runs)`` for the lines with long runs of
    token-like characters, comments and data URIs left out."""
    marks = " OR ".join(f"startswith(s, {quote(m)})" for m in COMMENT_MARKS)
    comment = f"exists(array(btrim(line, {quote(WS_CHARS)})), s -> {marks})"
    runs = (
        f"filter(regexp_extract_all(line, {quote(RUN)}, 0), "
        "run -> size(array_distinct(split(run, ''))) > 4)"
    )
    return (
        f"filter(transform({lines}, (line, i) -> named_struct('line_no', i + 1, 'line', line, 'runs', "
        f"CASE WHEN NOT ({comment}) AND NOT line RLIKE {quote(DATA_URI)} THEN {runs} END)), "
        "hit -> size(hit.runs) > 0)"
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def high_entropy_findings(
    df: DataFrame, text: str = "content", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Long random-looking strings within 50 characters of a credential word,
    none of a fake-data word, that no rule matches."""
    cols = (*keep, "file_path")
    possible = f"{text} RLIKE {quote(RUN)} AND {contains_any_sql(f'lower({text})', CONTEXT_WORDS)}"
    lines = df.select(*cols, F.when(
        ~skipped_by_entropy(F.col("file_path")),
        F.expr(f"CASE WHEN {possible} THEN {split_lines_sql(text)} END"),
    ).alias("lines"))
    hits = lines.select(*cols, F.expr(_run_lines_sql("lines")).alias("hits"))
    runs = (
        explode_late(hits, "hits", "hit", *cols)
        .select(*cols, "hit.line_no", "hit.line", F.posexplode("hit.runs").alias("match_ord", "secret"))
        .where(~F.expr(candidate_sql("secret")))
    )
    at = F.instr(F.col("line"), F.col("secret")) - 1
    first = F.greatest(at - WINDOW, F.lit(0))
    last = F.least(F.length("line"), at + F.length("secret") + WINDOW)
    near = keep_rows(
        runs.select("*", F.substring(F.lower("line"), first + 1, last - first).alias("near")),
        lambda f: let(f["near"], lambda s: _any(s, CONTEXT_WORDS) & ~_any(s, NEGATIVE_WORDS)),
    )
    rated = keep_rows(
        near.select(*cols, "line_no", "line", "match_ord", "secret", shannon_entropy(F.col("secret")).alias("bits")),
        lambda f: f["bits"] >= HIGH_ENTROPY_THRESHOLD,
    )
    return rated.select(
        *cols, "line_no",
        F.lit(HIGH_ENTROPY_RULE).alias("rule_id"),
        F.concat(
            F.lit("High entropy string (score: "),
            F.round("bits", 2).cast("decimal(6,2)").cast("string"),
            F.lit(") — possible secret"),
        ).alias("description"),
        "match_ord", "secret",
        let(strip(F.col("line")), lambda s: F.when(
            F.length(s) > SHOWN, F.concat(F.substring(s, 1, SHOWN), F.lit("..."))
        ).otherwise(s)).alias("line_content"),
        F.when(F.col("bits") < HIGH_SEVERITY_ENTROPY, "medium").otherwise("high").alias("severity"),
    )


def detect(
    df: DataFrame, text: str = "content", path: str = "file_path", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Both detectors over the files that do not look binary."""
    files = df.withColumn("file_path", F.coalesce(F.col(path), F.lit("")))
    files = files.where(~is_binary_file(F.col("file_path")))
    return rule_findings(files, text, keep).unionByName(high_entropy_findings(files, text, keep))
