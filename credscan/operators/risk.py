"""Summaries per text, and layer ablation, without a shuffle.

All findings of a text come from one row, so their scores can be worked out
and folded inside that row: counts and maxima per text need neither an explode
nor a join back to the texts that had no finding.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credscan.functions import score as S
from credscan.functions import suppress as P
from credscan.functions.entropy import evaluate_entropy
from credscan.functions.text import let
from credscan.operators.matches import candidate_lines_sql, rule_column
from credscan.operators.scan import (
    ALL_LAYERS,
    Layers,
    features,
    hit_arrays,
    hit_rows,
    prepared,
    scan,
)
from credscan.rules import DEFAULT_THRESHOLD, GATE_PENALTY

# The published ablation, as (name, layers).
CONFIGURATIONS: tuple[tuple[str, Layers], ...] = (
    ("L1", Layers(False, False, False)),
    ("L1+L2", Layers(True, False, False)),
    ("L1+L3", Layers(False, True, False)),
    ("L1+L4", Layers(False, False, True)),
    ("L1+L2+L4", Layers(True, False, True)),
    ("L1+L3+L4", Layers(False, True, True)),
    ("L1+L2+L3+L4", Layers(True, True, True)),
)
FULL = len(CONFIGURATIONS) - 1


def layered_score(
    layers: Layers, tier: Column, regex: Column, entropy: Column, probability: Column,
    penalty: Column, penalty_no_entropy: Column,
) -> Column:
    """Combined score with some layers switched off."""
    zero = S.dec("0.00")
    total = zero if not layers.l4 else penalty if layers.l2 else penalty_no_entropy
    return S.combined_score(
        tier, regex,
        entropy if layers.l2 else F.lit(S.NEUTRAL),
        probability if layers.l3 else F.lit(S.NEUTRAL),
        (S.dec("1.00") - total).cast("decimal(3,2)"),
        total >= S.dec(GATE_PENALTY),
    )


def _scores(
    configurations: tuple[Layers, ...], secret: Column, facts: Column, probability: Column,
    tier: Column, regex: Column, in_tests: Column, in_docs: Column,
) -> Column:
    """Array of scores of one match, one per configuration; every feature is
    computed once."""

    def with_penalties(l2: Column, own: Column) -> Column:
        def total(on: bool) -> Column:
            if not any(c.l4 and c.l2 == on for c in configurations):
                return S.dec("0.00")
            return P.total_penalty(
                P.flags(in_tests, in_docs, facts, own, l2["transition"], F.lit(on))
            )

        return let(F.struct(total(True).alias("on"), total(False).alias("off")), lambda p: F.array(*[
            layered_score(c, tier, regex, l2["entropy_score"], probability, p["on"], p["off"])
            for c in configurations
        ]))

    return let(evaluate_entropy(secret), lambda l2:
               let(P.secret_facts(secret, facts), lambda own: with_penalties(l2, own)))


@cache
def _match_scores(configurations: tuple[Layers, ...]) -> Column:
    """Array over all matches of a text of ``(scores, rule_ord)``."""
    rules = configurations[0].rules
    tiers = F.array(*[F.lit(r.tier) for r in rules]).cast("array<int>")
    weights = F.array(*[F.lit(float(r.weight)) for r in rules]).cast("array<double>")

    def of_line(hit: Column, path: Column) -> Column:
        return let(P.line_facts(hit["line"]), lambda facts: F.transform(
            hit["matches"],
            lambda m: F.struct(
                _scores(
                    configurations, m["secret"], facts, hit["l3"]["probability"],
                    F.get(tiers, m["rule_ord"]), F.get(weights, m["rule_ord"]),
                    path["tests"], path["docs"],
                ).alias("scores"),
                m["rule_ord"].alias("rule_ord"),
            ),
        ))

    path = F.struct(
        P.in_test_directory(F.col("file_path")).alias("tests"),
        P.in_readme_file(F.col("file_path")).alias("docs"),
    )
    found = let(path, lambda p: F.flatten(F.transform(F.col("hits"), lambda hit: of_line(hit, p))))
    empty = F.array().cast("array<struct<scores:array<double>,rule_ord:int>>")
    return F.coalesce(F.when(F.size("hits") > 0, found), empty)


def match_scores(
    df: DataFrame, keep: tuple[str, ...], lines: str,
    configurations: tuple[Layers, ...] = (ALL_LAYERS,),
) -> DataFrame:
    arrays = hit_arrays(df, keep, lines, Layers(rules=configurations[0].rules))
    return arrays.select(*keep, _match_scores(configurations).alias("found"))


def _scores_by_text(
    df: DataFrame, text: str, path: str | None, keep: tuple[str, ...], layers: Layers,
) -> DataFrame:
    """Each text's ``found`` from findings as rows. A text's scores are gathered in one row, as they
    are where they are made in it."""
    cols = [*keep, "file_path"]
    rows = prepared(df, text, path).select(*cols)
    found = scan(df, text, path, keep, layers).groupBy(*cols).agg(
        F.collect_list(F.struct(F.array("combined_score").alias("scores"), "rule_ord")).alias("found")
    )
    found = found.select(*[F.col(c).alias(f"_{c}") for c in cols], "found")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]
    return rows.join(found, same, "left").select(*cols, F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def risk(
    df: DataFrame,
    text: str = "content",
    path: str | None = "file_path",
    keep: tuple[str, ...] = ("doc_id",),
    threshold: float = DEFAULT_THRESHOLD,
    layers: Layers = ALL_LAYERS,
) -> DataFrame:
    """One row per text, including clean ones: matches, findings at or above
    the threshold, highest score, its severity, and the rule that reached it
    (the first in the catalogue on a tie). With a classifier of their own findings are scored as
    rows and joined back to the texts, which ``keep`` and the path then have to tell apart."""
    cols = (*keep, "file_path")
    if layers.l3 and layers.classifier:
        scored = _scores_by_text(df, text, path, keep, layers)
    else:
        scored = match_scores(prepared(df, text, path), cols, candidate_lines_sql(text, layers.rules), (layers,))
    best = F.array_max(F.transform(
        "found", lambda f: F.struct(f["scores"][0].alias("score"), (-f["rule_ord"]).alias("minus_ord"))
    ))
    rows = scored.select(
        *cols,
        F.size("found").cast("bigint").alias("n_matches"),
        F.size(F.filter("found", lambda f: f["scores"][0] >= threshold)).cast("bigint").alias("n_findings"),
        best.alias("best"),
    )
    return rows.select(
        *cols, "n_matches", "n_findings",
        F.coalesce(F.col("best.score"), F.lit(0.0)).alias("max_score"),
        F.when(F.col("best").isNotNull(), S.severity(F.col("best.score"))).otherwise("none")
        .alias("worst_severity"),
        rule_column("rule_id", "-best.minus_ord", layers.rules).alias("top_rule"),
    )


def risk_by_configuration(
    df: DataFrame, text: str = "content", path: str | None = "file_path",
    keep: tuple[str, ...] = ("doc_id",),
    configurations: tuple[tuple[str, Layers], ...] = CONFIGURATIONS,
) -> DataFrame:
    """Highest score of every text under each configuration, the seven published ones by default."""
    layered = tuple(layers for _, layers in configurations)
    scored = match_scores(prepared(df, text, path), (*keep, "file_path"), candidate_lines_sql(text), layered)

    def best(i: int) -> Column:
        return F.coalesce(F.array_max(F.transform("found", lambda f: f["scores"][i])), F.lit(0.0))

    maxima = scored.select(*keep, F.array(*[best(i) for i in range(len(configurations))]).alias("best"))
    return maxima.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(name).alias("config"), F.get("best", F.lit(i)).alias("score"))
        for i, (name, _) in enumerate(configurations)
    ])).alias("c")).select(*keep, "c.config", "c.score")


def ablation(
    df: DataFrame, text: str = "content", path: str | None = "file_path",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Every match with its score under each configuration; one row each."""
    cols = (*keep, "file_path")
    rows = features(hit_rows(prepared(df, text, path), cols, candidate_lines_sql(text)), cols)
    c = F.col
    penalty = c("l4.total_penalty")
    own = P.secret_facts(c("secret"), c("facts"))
    no_entropy = let(own, lambda o: P.total_penalty(P.flags(
        P.in_test_directory(c("file_path")), P.in_readme_file(c("file_path")),
        c("facts"), o, c("l2.transition"), F.lit(False),
    )))
    rows = rows.select("*", no_entropy.alias("penalty_no_entropy"))
    scores = F.array(*[
        F.struct(F.lit(name).alias("config"), layered_score(
            layers, c("tier"), c("regex_score"), c("l2.entropy_score"), c("l3.probability"),
            penalty, c("penalty_no_entropy"),
        ).alias("score"))
        for name, layers in CONFIGURATIONS
    ])
    return rows.select(
        *cols, "line_no", rule_column("rule_id"), "match_ord", F.explode(scores).alias("s")
    ).select(*cols, "line_no", "rule_id", "match_ord", "s.config", "s.score")


def gate(
    df: DataFrame, batch: str = "batch", text: str = "content", path: str | None = "file_path",
    threshold: float = DEFAULT_THRESHOLD, layers: Layers = ALL_LAYERS,
) -> DataFrame:
    """Whether each submitted batch of files is blocked, and by how many
    findings. Batches without findings stay. Counts per file are made in its
    row and summed map-side, so a batch of any size is one small group."""
    per_file = risk(df, text, path, (batch,), threshold, layers)
    return per_file.groupBy(batch).agg(
        F.count("*").alias("n_files"),
        F.sum("n_findings").alias("n_findings"),
        F.max("max_score").alias("max_score"),
        (F.sum("n_findings") > 0).alias("blocked"),
    )
