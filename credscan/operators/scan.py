"""The full scan: texts in, scored findings out.

Everything up to the findings is narrow. A text that cannot match stops at one
boolean; a text that can is split into lines, and from then on only its hit
lines and matches are rows. Nothing is shuffled, and block contexts are
classified inside the row that holds the text, once per distinct block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credscan.functions import score as S
from credscan.functions import suppress as P
from credscan.functions.blocks import block_verdicts, runs
from credscan.functions.entropy import PLACEHOLDER_TRANSITION, evaluate_entropy_of, round3, transition_entropy
from credscan.functions.groups import block_text, blocks_around, string_group
from credscan.functions.signals import graded
from credscan.functions.text import let, strip
from credscan.operators.matches import (
    MATCH_TYPE,
    candidate_lines_sql,
    explode_late,
    hit_lines_sql,
    rule_column,
)
from credscan.rules import DEFAULT_THRESHOLD, GATED_MAX_SCORE, RULES, Rule
from credscan.sources.store import written


@dataclass(frozen=True)
class Classifier:
    """A classifier of string groups: ``add`` puts a column ``probability`` to rows with
    ``group_text``, null where it cannot tell; the keyword signals decide there."""

    name: str
    add: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Layers:
    """What a scan does: which layers beyond rule matching are on (for ablation), the rules, and the
    classifier of the third layer (the keyword signals if none is named)."""

    l2: bool = True
    l3: bool = True
    l4: bool = True
    rules: tuple[Rule, ...] = RULES
    classifier: Classifier | None = None


ALL_LAYERS = Layers()


# What a switched-off layer leaves in place of its result.
OFF_ENTROPY = (
    "named_struct('shannon', 0D, 'transition', 0D, 'is_placeholder', false, "
    f"'entropy_score', {S.NEUTRAL}D)"
)
OFF_CLASSIFIER = (
    f"named_struct('probability', {S.NEUTRAL}D, 'classification', CAST(null AS string), "
    "'model_used', CAST(null AS string), 'string_group_size', CAST(null AS int))"
)
OFF_SUPPRESSION = (
    "named_struct('rules_fired', CAST(array() AS array<string>), "
    "'penalties', CAST(array() AS array<double>), 'total_penalty', CAST(0 AS decimal(3,2)), "
    "'suppressed', false, 'suppressor_score', CAST(1 AS decimal(3,2)))"
)


# --- in-row stages ----------------------------------------------------------

def _vetoed(secret: Column, facts: Column, entropy_on: bool) -> Column:
    """Some rule other than the missing cloud hint fires on the match; each of
    those alone reaches the veto penalty."""

    return let(P.secret_facts(secret, facts), lambda own: _vetoed_by(own, secret, entropy_on))


def _vetoed_by(own: Column, secret: Column, entropy_on: bool) -> Column:
    fired = (
        own["numeric_only"] | own["placeholder"] | own["empty"]
        | own["verdict"].isNotNull() | own["weak_password"]
    )
    if entropy_on:
        te = round3(transition_entropy(secret))  # what `evaluate_entropy` gives for so long a text
        fired = fired | (own["long"] & (te < PLACEHOLDER_TRANSITION))
    return fired


@cache
def _without_vetoed(entropy_on: bool) -> Column:
    """The hit lines that keep at least one match the suppressor lets through."""

    def survivors(hit: Column) -> Column:
        return let(
            P.line_facts(hit["line"]),
            lambda facts: F.struct(
                hit["line_no"].alias("line_no"),
                hit["at"].alias("at"),
                hit["line"].alias("line"),
                F.when(P.line_vetoed(facts), F.array().cast(MATCH_TYPE)).otherwise(
                    F.filter(hit["matches"], lambda m: ~_vetoed(m["secret"], facts, entropy_on))
                ).alias("matches"),
                facts.alias("facts"),
            ),
        )

    return F.when(~P.path_vetoed(F.col("file_path")), F.filter(
        F.transform(F.col("hits"), survivors), lambda hit: F.size(hit["matches"]) > 0
    ))


@cache
def _with_verdicts(with_facts: bool) -> Column:
    """Hit lines with the classifier's verdict ``l3`` on the block around each.

    Lines of one block share its verdict, and blocks of one end are read together.
    """
    lines, hits = F.col("lines"), F.col("hits")

    def attach(verdicts: Column) -> Column:
        facts = ["facts"] if with_facts else []
        return F.transform(
            hits,
            lambda hit, i: F.struct(
                *[hit[c].alias(c) for c in ("line_no", "at", "line", "matches", *facts)],
                F.get(verdicts, i).alias("l3"),
            ),
        )

    return F.when(
        F.size(hits) > 0,
        let(blocks_around(lines, F.transform(hits, lambda hit: hit["line_no"])), lambda bounds:
            let(block_verdicts(lines, bounds), attach)),
    )


# --- rows -------------------------------------------------------------------

def hit_arrays(
    df: DataFrame,
    keep: tuple[str, ...],
    lines: str,
    layers: Layers = ALL_LAYERS,
    drop_vetoed: bool = False,
    at: str = "i + 1",
) -> DataFrame:
    """The ``keep`` columns and ``hits``, the array of hit lines with their
    matches and, if on, the verdict ``l3`` on the block around each.

    ``lines`` is SQL for the lines of a row, null for a text that cannot
    match; ``at`` may refer to a column ``numbers``."""
    numbers = ("numbers",) if "numbers" in df.columns else ()
    staged = df.select(*keep, *numbers, F.expr(lines).alias("lines"))
    staged = staged.select(*keep, "lines", F.expr(hit_lines_sql("lines", at, layers.rules)).alias("hits"))
    if drop_vetoed:
        staged = staged.select(*keep, "lines", _without_vetoed(layers.l2).alias("hits"))
    if layers.l3:
        staged = staged.select(*keep, _with_verdicts(drop_vetoed).alias("hits"))
    return staged


def hit_rows(
    df: DataFrame,
    keep: tuple[str, ...],
    lines: str,
    layers: Layers = ALL_LAYERS,
    drop_vetoed: bool = False,
    at: str = "i + 1",
) -> DataFrame:
    """:func:`hit_arrays` as one row per match with what the scoring layers
    need: ``line_no``, ``at``, ``line``, ``facts`` (tests on the line), ``l3``
    (verdict on the block), ``rule_ord``, ``match_ord``, ``secret``."""
    if layers.l3 and layers.classifier:
        return classified_rows(df, keep, lines, layers, drop_vetoed, at)
    if drop_vetoed:
        lines = f"CASE WHEN NOT coalesce(_off_limits, true) THEN {lines} END"
        df = df.select("*", P.path_vetoed(F.col("file_path")).alias("_off_limits"))
    by_line = explode_late(hit_arrays(df, keep, lines, layers, False, at), "hits", "hit", *keep)
    l3 = F.col("hit.l3") if layers.l3 else F.lit(None)
    by_line = by_line.select(
        *keep, "hit.line_no", "hit.at", "hit.line", l3.alias("l3"), F.col("hit.matches").alias("ms"),
    )
    ms = F.col("ms")
    if layers.l4:
        line = F.col("line")
        by_line = by_line.select("*", P.strip_value(line).alias("_stripped"), P.quoted(line).alias("_quoted"))
        by_line = by_line.select("*", P.line_facts_of(line, F.col("_stripped"), F.col("_quoted")).alias("facts"))
        if drop_vetoed:
            ms = F.when(~P.line_vetoed(F.col("facts")), ms)
    else:
        by_line = by_line.select("*", F.lit(None).alias("facts"))
    cols = (*keep, "line_no", "at", "line", "l3", "facts")
    rows = explode_late(by_line.select(*cols, ms.alias("ms")), "ms", "m", *cols)
    rows = rows.select(*cols, "m.rule_ord", "m.match_ord", "m.secret")
    if not drop_vetoed:
        return rows
    rows = _with_secret_facts(rows)
    through = F.when(~_vetoed_by(F.col("_own"), F.col("secret"), layers.l2), F.array(F.lit(True)))
    return explode_late(rows.select("*", through.alias("_through")), "_through", "_passed", *rows.columns).drop("_passed", "_own")


def _with_secret_facts(rows: DataFrame) -> DataFrame:
    """Adds ``own``, the tests on the match. Each step is a column, so generated code evaluates it
    once; within lambdas the same costs several times as much."""
    secret = F.col("secret")
    staged = rows.select(
        "*", P.unquoted(secret).alias("_bare"), P.quoted(secret).alias("_values"),
        P.quoted(secret, P.QUOTED_NONEMPTY).alias("_nonempty"),
    )
    own = P.secret_facts_of(secret, F.col("facts"), F.col("_bare"), F.col("_values"), F.col("_nonempty"))
    return staged.select(*rows.columns, own.alias("_own"))


def hit_contexts(
    df: DataFrame, keep: tuple[str, ...], lines: str, layers: Layers = ALL_LAYERS, drop_vetoed: bool = False, at: str = "i + 1",
) -> DataFrame:
    """One row per hit line: the struct ``hit``, the ``bounds`` and text (``context``) of the block
    around it, and the block's ``string_group``.

    For classifiers that need the group itself as a column. Blocks are rows before their contexts
    are built, so a context is built once and memory holds one at a time.
    """
    numbers_of = ("numbers",) if "numbers" in df.columns else ()
    staged = df.select(*keep, *numbers_of, F.expr(lines).alias("lines"))
    staged = staged.select(*keep, "lines", F.expr(hit_lines_sql("lines", at, layers.rules)).alias("hits"))
    if drop_vetoed:
        staged = staged.select(*keep, "lines", _without_vetoed(layers.l2).alias("hits"))
    numbers = F.transform("hits", lambda hit: hit["line_no"])
    staged = staged.select(*keep, "lines", "hits", F.when(F.size("hits") > 0, blocks_around(F.col("lines"), numbers)).alias("bounds"))
    keyed = F.sort_array(F.transform("bounds", lambda b, i: F.struct(b.alias("bounds"), i.alias("i"))))
    blocks = F.transform(runs(keyed, lambda k: k["bounds"]), lambda run: F.struct(
        F.get(run, F.lit(0))["bounds"].alias("bounds"), F.transform(run, lambda k: F.get("hits", k["i"])).alias("hits"),
    ))
    by_block = explode_late(staged.select(*keep, "lines", blocks.alias("blocks")), "blocks", "b", *keep, "lines")
    by_block = by_block.select(*keep, "b.bounds", block_text(F.col("lines"), F.col("b.bounds")).alias("context"), "b.hits")
    by_block = by_block.select("*", string_group(F.col("context")).alias("string_group"))
    return by_block.select(*keep, "bounds", "context", "string_group", F.explode("hits").alias("hit"))


def classified_rows(
    df: DataFrame, keep: tuple[str, ...], lines: str, layers: Layers, drop_vetoed: bool = False, at: str = "i + 1",
) -> DataFrame:
    """:func:`hit_rows` with the verdicts of ``layers.classifier``.

    Groups are keyed by their digest and scored once per distinct group. For that the hit lines,
    without their contexts, are written once; a stream, which can't be read twice, scores per line.
    """
    facts = F.lit(None)
    if layers.l4:
        facts = F.col("hit.facts") if drop_vetoed else _hit_line_facts()
    rows = hit_contexts(df, keep, lines, layers, drop_vetoed, at).select(
        *keep, "hit.line_no", "hit.at", "hit.line", facts.alias("facts"), F.col("hit.matches").alias("ms"),
        F.size("string_group").alias("group_size"), F.array_join("string_group", " ").alias("group_text"),
    )
    if rows.isStreaming:
        judged = layers.classifier.add(rows)
    else:
        rows = written(rows.withColumn("group_key", F.sha2("group_text", 256)), "hit-lines")
        groups = rows.where("group_size > 0").groupBy("group_key").agg(F.first("group_text").alias("group_text"))
        scores = layers.classifier.add(groups).select("group_key", "probability")
        judged = rows.join(scores, "group_key", "left")
    l3 = graded(F.col("group_size"), F.col("probability"), F.col("group_text"), layers.classifier.name)
    cols = (*keep, "line_no", "at", "line", "l3", "facts")
    return (
        judged.select(*keep, "line_no", "at", "line", l3.alias("l3"), "facts", "ms")
        .select(*cols, F.explode("ms").alias("m"))
        .select(*cols, "m.rule_ord", "m.match_ord", "m.secret")
    )


# Expressions over fixed column names are built once per process: each operator
# in them costs a round trip to the JVM.

@cache
def _hit_line_facts() -> Column:
    return P.line_facts(F.col("hit.line"))


@cache
def _flags() -> list[P.Flag]:
    path = F.coalesce(F.col("file_path"), F.lit(""))
    return P.flags(
        P.in_test_directory(path), P.in_readme_file(path),
        F.col("facts"), F.col("_own"), F.col("l2.transition"), F.col("entropy_on"),
    )


@cache
def _suppression() -> Column:
    return P.suppression(P.flags_of(F.col("_fired"), _flags()))


def features(df: DataFrame, keep: tuple[str, ...], layers: Layers = ALL_LAYERS) -> DataFrame:
    """Adds tier, regex weight, entropy struct ``l2`` and suppression struct
    ``l4`` to :func:`hit_rows`. A switched-off layer leaves nulls."""
    secret, kept = F.col("secret"), df.columns
    entropy = F.expr(OFF_ENTROPY)
    if layers.l2:
        df = df.select("*", transition_entropy(secret).alias("_te"))
        entropy = evaluate_entropy_of(secret, F.col("_te"))
    base = df.select(
        *kept, rule_column("tier", rules=layers.rules), rule_column("regex_score", rules=layers.rules),
        entropy.alias("l2"), F.lit(layers.l2).alias("entropy_on"),
    )
    if not layers.l4:
        return base.select("*", F.expr(OFF_SUPPRESSION).alias("l4"))
    fired = _with_secret_facts(base).select(*base.columns, P.fired_mask(_flags()).alias("_fired"))
    return fired.select(*base.columns, _suppression().alias("l4"))


def scored(df: DataFrame, keep: tuple[str, ...], layers: Layers = ALL_LAYERS) -> DataFrame:
    """Findings: layer scores, combined score, severity, explanation."""
    verdict = F.col("l3") if layers.l3 else F.expr(OFF_CLASSIFIER)
    flat = df.select(
        *keep, "line_no", "at", strip(F.col("line")).alias("line_content"), "rule_ord", "match_ord",
        rule_column("rule_id", rules=layers.rules), rule_column("description", rules=layers.rules),
        "secret", "tier", "regex_score",
        "l2.*", verdict.alias("l3"), "l4.*",
    )
    return finish(flat.select(
        "*",
        F.col("l3.probability").alias("classifier_score"),
        "l3.classification", "l3.model_used", "l3.string_group_size",
    ).drop("l3"))


@cache
def _combined() -> Column:
    c = F.col
    return S.combined_score(
        c("tier"), c("regex_score"), c("entropy_score"), c("classifier_score"),
        c("suppressor_score"), c("suppressed"))


@cache
def _severity_and_explanation() -> tuple[Column, Column]:
    c = F.col
    return S.severity(c("combined_score")).alias("severity"), S.explanation(
        c("tier"), c("regex_score"), c("entropy_score"), c("is_placeholder"),
        c("classifier_score"), c("suppressor_score"), c("suppressed"), c("rules_fired"),
    ).alias("explanation")


def finish(flat: DataFrame) -> DataFrame:
    """Combined score, severity and explanation from the layer columns."""
    return flat.select("*", _combined().alias("combined_score")).select(
        "*", *_severity_and_explanation()
    ).withColumns({
        "total_penalty": F.col("total_penalty").cast("double"),
        "suppressor_score": F.col("suppressor_score").cast("double"),
    })


def prepared(df: DataFrame, text: str, path: str | None) -> DataFrame:
    """Input with a non-null ``file_path``."""
    located = F.coalesce(F.col(path), F.lit("")) if path else F.lit("<snippet>")
    return df.withColumn("file_path", located)


def scan(
    df: DataFrame,
    text: str = "content",
    path: str | None = "file_path",
    keep: tuple[str, ...] = ("doc_id",),
    layers: Layers = ALL_LAYERS,
) -> DataFrame:
    """Every finding in a table of texts, whatever its score."""
    cols = (*keep, "file_path")
    rows = hit_rows(prepared(df, text, path), cols, candidate_lines_sql(text, layers.rules), layers)
    return scored(features(rows, cols, layers), cols, layers).drop("at")


def report(
    df: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    text: str = "content",
    path: str | None = "file_path",
    keep: tuple[str, ...] = ("doc_id",),
    layers: Layers = ALL_LAYERS,
) -> DataFrame:
    """Findings at or above a threshold.

    A vetoed finding cannot score above 0.17, so for any higher threshold the
    veto is applied before matches are scored, that of paths before matching;
    the result is the same as filtering :func:`scan`.
    """
    cols = (*keep, "file_path")
    drop = layers.l4 and threshold > GATED_MAX_SCORE
    rows = hit_rows(prepared(df, text, path), cols, candidate_lines_sql(text, layers.rules), layers, drop)
    found = scored(features(rows, cols, layers), cols, layers)
    return at_least(found.drop("at"), threshold)


def keep_rows(df: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Rows that pass a test of costly computed columns.

    The test sits in a one-element array instead of a filter: the optimizer
    would push a filter down by substitution and so compute every layer of
    every finding once more for each mention of its result.
    """
    one = F.filter(F.array(F.struct("*")), test)
    kept = df.select(F.explode_outer(one).alias("f")).where(F.col("f").isNotNull())
    return kept.select("f.*")


def at_least(findings: DataFrame, threshold: float) -> DataFrame:
    """Findings with that score or more."""
    return keep_rows(findings, lambda f: f["combined_score"] >= threshold)


ORDER = ("file_path", "line_no", "rule_ord", "match_ord")


def ranked(findings: DataFrame) -> DataFrame:
    """Highest score first; then in reading order, which a stable sort of
    findings collected file by file would give.

    A global sort first samples its input. The findings are exchanged before
    that, so the sample reads shuffled findings and the texts are scanned once.
    """
    return findings.repartition(*[F.col(c) for c in ORDER]).orderBy(F.desc("combined_score"), *ORDER)
