"""Combining the layers into one score, a severity and an explanation.

Scores are computed in decimals: every input has at most three places and
every weight two, so sums, products and threshold tests are exact and the
final rounding (half up, three places) is the only one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.rules import CLASSIFIER_TIER_FACTOR, LAYER_WEIGHTS, SEVERITY_CUTOFFS

# What a switched-off layer contributes.
NEUTRAL = 0.5


def dec(value: str, kind: str = "decimal(3,2)") -> Column:
    return F.lit(value).cast(kind)


def three_places(value: Column) -> Column:
    """A score already rounded to three places, as an exact decimal."""
    return value.cast("decimal(4,3)")


def adjusted_classifier(tier: Column, probability: Column) -> Column:
    """Tier 1 earns a tenth more (at most 1), tier 3 keeps 70 percent."""
    p = three_places(probability)
    factor = (
        F.when(tier == 1, dec(CLASSIFIER_TIER_FACTOR[1]))
        .when(tier == 3, dec(CLASSIFIER_TIER_FACTOR[3]))
        .otherwise(dec(CLASSIFIER_TIER_FACTOR[2]))
    )
    return F.least((p * factor).cast("decimal(7,5)"), dec("1", "decimal(7,5)"))


def base_score(tier: Column, regex: Column, entropy: Column, probability: Column) -> Column:
    return (
        regex.cast("decimal(3,2)") * dec(LAYER_WEIGHTS["regex"])
        + three_places(entropy) * dec(LAYER_WEIGHTS["entropy"])
        + adjusted_classifier(tier, probability) * dec(LAYER_WEIGHTS["classifier"])
    ).cast("decimal(10,8)")


def combined_score(
    tier: Column,
    regex: Column,
    entropy: Column,
    probability: Column,
    suppressor: Column,
    gated: Column,
) -> Column:
    """A veto multiplies the base by what the suppressor left; otherwise the
    suppressor adds its weighted share."""
    base = base_score(tier, regex, entropy, probability)
    gate = (base * suppressor).cast("decimal(14,10)")
    add = (base + suppressor * dec(LAYER_WEIGHTS["suppressor"])).cast("decimal(14,10)")
    return F.round(F.when(gated, gate).otherwise(add), 3).cast("decimal(6,3)").cast("double")


def severity(score: Column) -> Column:
    (first, cut), *rest = SEVERITY_CUTOFFS
    chain = F.when(score >= cut, first)
    for name, cut in rest:
        chain = chain.when(score >= cut, name)
    return chain.otherwise("low")


def _places(value: Column, n: int) -> Column:
    return F.round(value, n).cast(f"decimal(6,{n})").cast("string")


def _term(label: Column, value: Column, layer: str) -> Column:
    weight = LAYER_WEIGHTS[layer]
    v = value.cast("decimal(4,3)")
    return F.concat(
        label, F.lit(" ("), _places(v, 2), F.lit(f" x {weight} = "),
        _places(v * dec(weight), 3), F.lit(")"),
    )


def explanation(
    tier: Column,
    regex: Column,
    entropy: Column,
    is_placeholder: Column,
    probability: Column,
    suppressor: Column,
    gated: Column,
    rules_fired: Column,
) -> Column:
    """One sentence per layer, as an array."""
    return F.array(
        _term(F.concat(F.lit("Tier "), tier.cast("string"), F.lit(" regex match")), regex, "regex"),
        F.concat(
            _term(F.lit("Entropy score"), entropy, "entropy"),
            F.when(is_placeholder, " [PLACEHOLDER detected]").otherwise(""),
        ),
        _term(F.lit("Classifier probability"), probability, "classifier"),
        F.concat(
            F.lit("Suppressor score ("), _places(suppressor, 2), F.lit(", mode="),
            F.when(gated, "MULTIPLICATIVE GATE").otherwise("additive"), F.lit(")"),
            F.when(
                F.size(rules_fired) > 0,
                F.concat(F.lit(" [Rules: "), F.array_join(rules_fired, ", "), F.lit("]")),
            ).otherwise(""),
        ),
    )
