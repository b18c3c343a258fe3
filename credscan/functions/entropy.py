"""Character and bigram entropy, placeholder and charset tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.functions.text import DIGIT, WS, either, let

PLACEHOLDER_TRANSITION = 2.2
HIGH_ENTROPY_MIN_LENGTH = 20
HIGH_ENTROPY_THRESHOLD = 3.9
MIN_SCORED_LENGTH = 8

# Strings that announce themselves as stand-ins (fixed values).
KNOWN_PLACEHOLDERS = (
    rf"your[-_{WS}]*(api[-_{WS}]*)?(key|secret|token|password)[-_{WS}]*here",
    rf"replace[-_{WS}]*me",
    rf"insert[-_{WS}]*(your[-_{WS}]*)?(key|token)",
    r"^xxx+$",
    r"^placeholder",
    r"^example[-_]?(key|token|secret|password)",
    r"^sample[-_]?(key|token|secret|password)",
    r"^todo",
    r"^changeme",
    r"^test[-_]?(key|token|secret|password)$",
    r"^dummy",
    r"^fake[-_]?(key|token|secret|password)",
    r"^mock[-_]?(key|token|secret|password)",
    rf"^password[{DIGIT}]*$",
    rf"^(abc|abcdef|abcdefgh)[{DIGIT}]*$",
    r"^replace[-_]?me[-_]?with[-_]?(key|token|secret)",
)
KNOWN_PLACEHOLDER = "|".join(f"(?:{p})" for p in KNOWN_PLACEHOLDERS)


# The next run of two or more equal symbols in a sorted string of them, by symbol width. Pairs are
# stepped over two characters at a time, so that none is read across two symbols.
_RUN = {1: (r"(?s)(.)\1++", 0), 2: (r"(?s)\G(?:(..)(?!\1))*+((..)\3++)", 2)}


def _entropy(symbols: Column, count: Column, width: int) -> Column:
    """Bits per symbol of an array of ``count`` symbols of ``width`` characters.

    Sorting brings equal symbols together, so a run-length pattern counts
    them natively. A symbol that occurs once adds nothing, so only repeated
    ones reach the lambda.
    """
    pattern, group = _RUN[width]
    runs = F.regexp_extract_all(F.array_join(F.sort_array(symbols), ""), F.lit(pattern), F.lit(group))

    def added(total: Column, run: Column) -> Column:
        n = F.length(run) / F.lit(float(width))
        return total + n * F.log2(n)

    weighted = F.aggregate(runs, F.lit(0.0), added)
    count = count.cast("double")
    return F.greatest(F.log2(count) - weighted / count, F.lit(0.0))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; zero for fewer than two characters."""
    return F.when(
        F.length(text) > 1, _entropy(F.split(text, ""), F.length(text), 1)
    ).otherwise(F.lit(0.0))


def bigrams(text: Column) -> Column:
    """Overlapping character pairs. The expression steps by 16-bit units, so it serves ASCII texts."""
    return F.when(
        F.octet_length(text) == F.length(text), F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))
    ).otherwise(_paired(text))


def _paired(text: Column) -> Column:
    return let(
        F.split(text, ""),
        lambda chars: F.zip_with(
            F.slice(chars, F.lit(1), F.size(chars) - 1),
            F.slice(chars, F.lit(2), F.size(chars) - 1),
            lambda a, b: F.concat(a, b),
        ),
    )


def transition_entropy(text: Column) -> Column:
    """Bits per overlapping character pair; zero for fewer than two characters."""
    return F.when(
        F.length(text) > 1, _entropy(bigrams(text), F.length(text) - 1, 2)
    ).otherwise(F.lit(0.0))


def is_known_placeholder(text: Column) -> Column:
    return text.rlike("(?iud)" + either(KNOWN_PLACEHOLDERS))


def is_high_entropy(
    text: Column,
    min_length: int = HIGH_ENTROPY_MIN_LENGTH,
    threshold: float = HIGH_ENTROPY_THRESHOLD,
) -> Column:
    return F.when(F.length(text) < min_length, F.lit(False)).otherwise(
        shannon_entropy(text) >= threshold
    )


def looks_like_base64(text: Column) -> Column:
    return text.rlike(r"(?d)^[A-Za-z0-9+/=]{20,}$")


def looks_like_hex(text: Column) -> Column:
    return text.rlike(r"(?d)^[0-9a-fA-F]{32,}$")


def round3(value: Column) -> Column:
    """Three places, exact ties to even; the inner rounding removes the noise
    that summation order leaves on values that are exactly representable."""
    return F.bround(F.round(value, 9), 3)


def evaluate_entropy(text: Column) -> Column:
    """Struct ``(shannon, transition, is_placeholder, entropy_score)``.

    The score is bigram entropy over four bits, cut to [0, 1], and a tenth of
    that for placeholders. Strings shorter than eight characters score zero.
    """
    return _evaluated(text, let(transition_entropy(text), lambda te: _scored(text, te)))


def evaluate_entropy_of(text: Column, transition: Column) -> Column:
    """:func:`evaluate_entropy` with the text's :func:`transition_entropy` at hand."""
    return _evaluated(text, _scored(text, transition))


def _scored(text: Column, te: Column) -> Column:
    placeholder = (te < PLACEHOLDER_TRANSITION) | is_known_placeholder(text)
    base = F.least(F.greatest(te / 4.0, F.lit(0.0)), F.lit(1.0))
    return F.struct(
        round3(shannon_entropy(text)).alias("shannon"),
        round3(te).alias("transition"),
        placeholder.alias("is_placeholder"),
        round3(F.when(placeholder, base * 0.1).otherwise(base)).alias("entropy_score"),
    )


def _evaluated(text: Column, scored: Column) -> Column:
    return F.when(F.length(text) >= MIN_SCORED_LENGTH, scored).otherwise(
        F.struct(
            F.lit(0.0).alias("shannon"),
            F.lit(0.0).alias("transition"),
            F.lit(False).alias("is_placeholder"),
            F.lit(0.0).alias("entropy_score"),
        )
    )
