"""Keyword-signal classifier over a string group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.functions.sqltext import quote
from credscan.functions.text import let

SECRET_PROBABILITY = 0.55
SIGNAL_MODEL = "heuristic_fallback"

# Signals and weights in hundredths (fixed values).
POSITIVE_SIGNALS = (
    ("https://", 10), ("http://", 5), ("api.", 10), ("bearer", 15),
    ("authorization", 12), ("content-type", 5), ("application/json", 5),
    ("charge", 8), ("payment", 8), ("stripe", 10), ("aws", 10), ("s3", 8),
    ("database", 8), ("connection", 5), (".com", 5), ("sk_live", 15),
    ("sk_test", 5), ("pk_live", 12), ("akia", 15), ("private key", 15),
    ("oauth", 10), ("client_secret", 12),
)
NEGATIVE_SIGNALS = (
    ("test", -12), ("mock", -15), ("assert", -12), ("expect", -10),
    ("fixture", -10), ("example", -12), ("sample", -10), ("placeholder", -15),
    ("readme", -10), ("todo", -8), ("template", -8), ("documentation", -10),
    ("your-", -12), ("replace_me", -15), ("debug", -5), ("console.log", -5),
)

_SIGNAL_ARRAY = "array({})".format(", ".join(
    f"named_struct('text', {quote(signal)}, 'weight', {weight})" for signal, weight in POSITIVE_SIGNALS + NEGATIVE_SIGNALS
))


def signal_score(text: Column) -> Column:
    """Half, plus the weight of every signal the text holds, cut to [0, 1]."""

    # a fold over a constant array: each sum in a row of sums asks the one before it for its type, in every row
    return let(F.lower(text), lambda low: F.aggregate(
        F.expr(_SIGNAL_ARRAY), F.lit(50), lambda total, s: F.when(F.contains(low, s["text"]), total + s["weight"]).otherwise(total),
        lambda total: F.greatest(F.least(total, F.lit(100)), F.lit(0)) / F.lit(100.0),
    ))


def classify_group(group: Column) -> Column:
    """Struct ``(probability, classification, model_used, string_group_size)``;
    an empty group is no secret, whatever the model."""
    return let(group, lambda g: labelled(
        group_size=F.size(g),
        probability=signal_score(F.array_join(g, " ")),
        model=SIGNAL_MODEL,
    ))


def graded(group_size: Column, probability: Column, group_text: Column, model: str) -> Column:
    """:func:`labelled` by a model; where it gives no probability (null, or not a number), by the signals."""
    failed = probability.isNull() | F.isnan(probability)
    return let(failed, lambda f: labelled(
        group_size, F.when(f, signal_score(group_text)).otherwise(probability),
        F.when(f, SIGNAL_MODEL).otherwise(model),
    ))


def labelled(group_size: Column, probability: Column, model: str | Column) -> Column:
    def known(p: Column) -> Column:
        return F.struct(
            p.alias("probability"),
            F.when(p >= SECRET_PROBABILITY, "secret").otherwise("not_secret").alias("classification"),
            F.lit(model).alias("model_used"),
            group_size.alias("string_group_size"),
        )

    return F.when(
        group_size == 0,
        F.struct(
            F.lit(0.0).alias("probability"),
            F.lit("not_secret").alias("classification"),
            F.lit("none").alias("model_used"),
            F.lit(0).alias("string_group_size"),
        ),
    ).otherwise(let(probability, known))
