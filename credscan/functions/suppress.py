"""False-positive rules: what each one tests, its penalty, and their sum.

The tests are grouped by what they look at (path, line, matched text), so a
scan evaluates path tests once per file and line tests once per line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.functions.entropy import PLACEHOLDER_TRANSITION, is_known_placeholder
from credscan.functions.text import DIGIT, WORD, WS, either, let, starts_with_any, strip, strip_value
from credscan.rules import GATE_PENALTY

# Rule names and penalties, in the order they are reported (fixed values).
FUNCTION_CALL = ("has_function_call", "0.95")
VARIABLE_ASSIGNMENT = ("is_variable_assignment", "0.90")
TEST_DIRECTORY = ("in_test_directory", "0.85")
README_FILE = ("in_readme_file", "0.85")
NUMERIC_ONLY = ("is_numeric_only", "0.85")
NULL_VALUE = ("has_null_value", "0.95")
CSS_SELECTOR = ("is_css_selector", "0.85")
COMMENTED_OUT = ("is_commented_out", "0.85")
PLACEHOLDER = ("matches_placeholder_pattern", "0.90")
LOW_TRANSITION = ("transition_entropy_below_threshold", "0.80")
EMPTY_STRING = ("is_empty_string", "0.95")
REPEATED_VALUE = ("transition_entropy_below_threshold", "0.85")
PLACEHOLDER_VALUE = ("matches_placeholder_pattern", "0.90")
NO_CLOUD_API = ("no_cloud_api_nearby", "0.30")
WEAK_PASSWORD = ("is_weak_default_password", "0.85")

# Fixed values.
PLACEHOLDER_SHAPES = (
    rf"your[-_{WS}]*(api[-_{WS}]*)?key[-_{WS}]*here",
    rf"your[-_{WS}]*(api[-_{WS}]*)?secret[-_{WS}]*here",
    rf"your[-_{WS}]*(api[-_{WS}]*)?token[-_{WS}]*here",
    rf"your[-_{WS}]*password[-_{WS}]*here",
    rf"replace[-_{WS}]*me",
    rf"insert[-_{WS}]*(your[-_{WS}]*)?key",
    rf"put[-_{WS}]*(your[-_{WS}]*)?key[-_{WS}]*here",
    r"^xxx+$",
    r"^placeholder", r"^example", r"^sample", r"^todo", r"^fixme", r"^changeme",
    r"^test[-_]?key", r"^test[-_]?token", r"^test[-_]?secret",
    r"^dummy", r"^fake", r"^mock",
)

# Fixed values.
WEAK_PASSWORDS = (
    "password", "password1", "password123", "passw0rd", "p@ssword",
    "admin", "admin123", "administrator", "root", "root123", "user", "user123",
    "test", "test123", "testing", "demo", "demo123", "guest", "guest123",
    "dev", "devpassword", "development", "local", "localhost",
    "secret", "secret123", "welcome", "welcome1", "letmein", "letmein1",
    "qwerty", "qwerty123", "abc123", "abcdef",
    "111111", "123456", "1234567", "12345678", "123456789", "1234567890", "000000",
    "pass", "login", "changeme", "change_me", "default", "default123",
    "blank", "empty", "null", "none", "undefined", "placeholder", "todo",
    "django-insecure",
)
WEAK_PREFIXES = ("django-insecure", "django-secret", "dev-secret", "local-secret")

# Fixed values.
CLOUD_WORDS = (
    r"api\.", r"\.amazonaws\.com", "googleapi", r"stripe\.com",
    "azure", "twilio", "heroku", "auth0", "firebase",
)
TEST_PATHS = (
    r"[/\\]tests?[/\\]", r"[/\\]__tests__[/\\]", r"[/\\]test[-_]", r"[/\\]mock[s]?[/\\]",
    r"[/\\]fixture[s]?[/\\]", r"[/\\]example[s]?[/\\]", r"[/\\]spec[s]?[/\\]", r"[/\\]stubs?[/\\]",
)
DOC_PATHS = (
    r"readme", r"\.md$", r"\.rst$", r"\.txt$", r"[/\\]docs?[/\\]",
    r"changelog", r"contributing", r"license",
)
CSS_SHAPES = (
    rf"\{{[{WS}]*[{WORD}-]+[{WS}]*:",
    rf"^[{WS}]*[{WORD}-]+[{WS}]*:[{WS}]*[{WORD}#]+;",
    rf"@media[{WS}]",
    rf"\.[{WORD}-]+[{WS}]*\{{",
    rf"#[{WORD}-]+[{WS}]*\{{",
)
COMMENT_MARKS = ("#", "//", "/*", "* ", "<!--")

ASSIGNED = "password|secret|key|token|pwd|auth"
ASSIGNED_MORE = ASSIGNED + "|pass|credential"

# Runs of one class followed by something outside the class are possessive:
# giving characters back could never help, and would cost quadratic time on
# very long words.
CALL = rf"(?iu)(?:{ASSIGNED})[{WS}]*+=[{WS}]*+[{WORD}][.{WORD}]*+\([^)]*+\)"
# An identifier followed by a member or an index; this covers the narrower
# forms that end after the member or name a configuration object.
REFERENCE = rf"(?iu)(?:{ASSIGNED_MORE})[{WS}]*+=[{WS}]*+[a-z_][{WORD}]*+[.\[]"
LITERAL_RIGHT_SIDE = rf"""^[^=]*+=[{WS}]*+f?["']"""
RIGHT_SIDE = rf"(?iud)(?:{ASSIGNED_MORE})[{WORD}]*+[{WS}]*+=[{WS}]*+(.+)$"
NULL_WORD = rf"""^(?:(?iu:null|none|undefined|nil)|""|'')$"""

QUOTED = """["']([^"']*)["']"""
QUOTED_NONEMPTY = """["']([^"']+)["']"""


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def quoted(text: Column, pattern: str = QUOTED) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def unquoted(text: Column) -> Column:
    """The text without surrounding whitespace, then without quotes."""
    return F.btrim(strip_value(text), F.lit("'\""))


# --- tests on the path ------------------------------------------------------

def in_test_directory(path: Column) -> Column:
    return path.rlike(either(TEST_PATHS, r"[/\\]"))


def in_readme_file(path: Column) -> Column:
    return path.rlike("(?iud)" + any_of(DOC_PATHS))


def path_vetoed(path: Column) -> Column:
    return in_test_directory(path) | in_readme_file(path)


# --- tests on the line ------------------------------------------------------

# Characters that an expression can't do without are looked for first: that is cheap, and mostly ends it.

def _holds(text: Column, *parts: str) -> Column:
    test = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        test = test | F.contains(text, F.lit(part))
    return test


def has_function_call(line: Column) -> Column:
    return _holds(line, "(") & _holds(line, "=") & line.rlike(CALL)


def is_variable_assignment(stripped: Column) -> Column:
    may = _holds(stripped, "=") & _holds(stripped, ".", "[")
    return may & stripped.rlike(REFERENCE) & ~stripped.rlike(LITERAL_RIGHT_SIDE)


def has_null_value(stripped: Column) -> Column:
    """``stripped`` ends with the assigned value, so with the end of a null word or with empty quotes."""
    may = F.lit(False)
    for end in ("l", "L", "e", "E", "d", "D", '""', "''"):
        may = may | F.endswith(stripped, F.lit(end))
    return _holds(stripped, "=") & may & strip(F.regexp_extract(stripped, RIGHT_SIDE, 1)).rlike(NULL_WORD)


def is_css_selector(line: Column) -> Column:
    return _holds(line, "{", ";", "@media") & line.rlike("(?d)" + any_of(CSS_SHAPES))


def is_commented_out(stripped: Column) -> Column:
    return starts_with_any(stripped, COMMENT_MARKS)


def has_cloud_word(line: Column) -> Column:
    return line.rlike("(?iu)" + any_of(CLOUD_WORDS))


# --- tests on quoted values -------------------------------------------------

def is_number(value: Column) -> Column:
    return value.rlike(rf"(?d)^[{WS}]*+[{DIGIT}]++[{WS}]*+$")


def any_numeric(values: Column) -> Column:
    return F.exists(values, is_number)


def is_weak_password(value: Column) -> Column:
    return let(
        F.lower(strip_value(value)),
        lambda v: v.isin(*WEAK_PASSWORDS) | starts_with_any(v, WEAK_PREFIXES),
    )


def any_weak(values: Column) -> Column:
    return F.exists(values, is_weak_password)


REPEATED, STAND_IN = 1, 2


def value_verdict(values: Column) -> Column:
    """What the first telling value is: repeated characters, a placeholder,
    or (null) nothing."""

    def verdict(value: Column) -> Column:
        few = (F.length(value) >= 8) & (F.size(F.array_distinct(F.split(value, ""))) <= 2)
        return F.when(few, REPEATED).when(is_known_placeholder(value), STAND_IN)

    return F.get(F.filter(F.transform(values, verdict), lambda c: c.isNotNull()), F.lit(0))


def line_facts(line: Column) -> Column:
    """Everything the rules need to know about a line, as one struct."""
    return let(strip_value(line), lambda s: let(quoted(line), lambda values: line_facts_of(line, s, values)))


def line_facts_of(line: Column, stripped: Column, values: Column) -> Column:
    """:func:`line_facts` with the stripped line and its quoted values at hand, for rows: generated
    code evaluates columns, lambdas are interpreted."""
    return F.struct(
        has_function_call(line).alias("function_call"),
        is_variable_assignment(stripped).alias("variable_assignment"),
        has_null_value(stripped).alias("null_value"),
        is_css_selector(line).alias("css_selector"),
        is_commented_out(stripped).alias("commented_out"),
        has_cloud_word(line).alias("cloud_word"),
        (F.size(values) > 0).alias("has_quoted"),
        any_numeric(values).alias("numeric"),
        any_weak(values).alias("weak"),
        value_verdict(quoted(line, QUOTED_NONEMPTY)).alias("verdict"),
    )


# --- tests on the match -----------------------------------------------------

def secret_facts(secret: Column, facts: Column) -> Column:
    """Tests on the matched text. Quoted values are those of the match; when it
    has none, those of the line."""

    return let(unquoted(secret), lambda bare:
               let(quoted(secret), lambda values:
                   let(quoted(secret, QUOTED_NONEMPTY), lambda nonempty:
                       secret_facts_of(secret, facts, bare, values, nonempty))))


def secret_facts_of(secret: Column, facts: Column, bare: Column, values: Column, nonempty: Column) -> Column:
    """:func:`secret_facts` with the unquoted match and its quoted values at hand."""
    has_own = F.size(values) > 0
    return F.struct(
        F.when(has_own, any_numeric(values))
        .when(facts["has_quoted"], facts["numeric"])
        .otherwise(is_number(bare)).alias("numeric_only"),
        bare.rlike("(?iud)" + either(PLACEHOLDER_SHAPES)).alias("placeholder"),
        (F.length(bare) >= 12).alias("long"),
        ((F.length(bare) == 0) & strip(secret).isin('""', "''", "")).alias("empty"),
        F.when(F.size(nonempty) > 0, value_verdict(nonempty))
        .otherwise(facts["verdict"]).alias("verdict"),
        ((F.length(secret) < 30) & ~facts["cloud_word"]).alias("no_cloud_api"),
        F.when(has_own, any_weak(values)).otherwise(facts["weak"]).alias("weak_password"),
    )


@dataclass(frozen=True)
class Flag:
    name: str
    penalty: str
    fired: Column


def flags(
    in_tests: Column,
    in_docs: Column,
    facts: Column,
    own: Column,
    transition: Column,
    entropy_on: Column | None = None,
) -> list[Flag]:
    """The rules in report order. ``facts``/``own`` are the line and match
    structs; ``transition`` is the rounded bigram entropy, which only counts
    while the entropy layer is on."""
    low = own["long"] & (transition < PLACEHOLDER_TRANSITION)
    if entropy_on is not None:
        low = low & entropy_on
    return [
        Flag(*FUNCTION_CALL, facts["function_call"]),
        Flag(*VARIABLE_ASSIGNMENT, facts["variable_assignment"]),
        Flag(*TEST_DIRECTORY, in_tests),
        Flag(*README_FILE, in_docs),
        Flag(*NUMERIC_ONLY, own["numeric_only"]),
        Flag(*NULL_VALUE, facts["null_value"]),
        Flag(*CSS_SELECTOR, facts["css_selector"]),
        Flag(*COMMENTED_OUT, facts["commented_out"]),
        Flag(*PLACEHOLDER, own["placeholder"]),
        Flag(*LOW_TRANSITION, low),
        Flag(*EMPTY_STRING, own["empty"]),
        Flag(*REPEATED_VALUE, F.coalesce(own["verdict"] == REPEATED, F.lit(False))),
        Flag(*PLACEHOLDER_VALUE, F.coalesce(own["verdict"] == STAND_IN, F.lit(False))),
        Flag(*NO_CLOUD_API, own["no_cloud_api"]),
        Flag(*WEAK_PASSWORD, own["weak_password"]),
    ]


def fired_mask(fired: list[Flag]) -> Column:
    """One bit for each rule that fired, in report order."""
    mask = F.lit(0)
    for i, f in enumerate(fired):
        mask = mask + F.when(f.fired, 1 << i).otherwise(0)
    return mask


def flags_of(mask: Column, names: list[Flag]) -> list[Flag]:
    """The rules ``names`` with what :func:`fired_mask` says of each."""
    return [Flag(f.name, f.penalty, mask.bitwiseAND(F.lit(1 << i)) != 0) for i, f in enumerate(names)]


#: Why a rule lowers a match's score, by its name and penalty.
REASONS = {
    FUNCTION_CALL: "the value is what a function returns",
    VARIABLE_ASSIGNMENT: "the right side names a variable instead of a literal",
    TEST_DIRECTORY: "the file is in a folder of tests",
    README_FILE: "the file is documentation",
    NUMERIC_ONLY: "a quoted value has digits only",
    NULL_VALUE: "nothing is assigned: a null word or empty quotes",
    CSS_SELECTOR: "the line has the shape of a style rule",
    COMMENTED_OUT: "the line is a comment",
    PLACEHOLDER: "the match, or a quoted value in it, is a known stand-in",
    LOW_TRANSITION: "its pairs of characters repeat too often",
    EMPTY_STRING: "the match is empty",
    REPEATED_VALUE: "a quoted value repeats one or two characters",
    NO_CLOUD_API: "no cloud service is named beside a short match",
    WEAK_PASSWORD: "a quoted value is a common default password",
}


def reasons(rules_fired: Column, penalties: Column, transition: Column) -> Column:
    """A sentence for each rule that fired, in their order, with the rule's penalty and, for bigram entropy, its bits.

    Null where ``rules_fired`` is null, empty where no rule fired.
    """
    entries = [F.lit(x) for (name, penalty), why in REASONS.items() for x in (f"{name} {penalty}", why)]
    bits = F.concat(F.lit(" ("), transition.cast("decimal(6,3)").cast("string"), F.lit(" bits)"))

    def sentence(name: Column, penalty: Column) -> Column:
        amount = penalty.cast("decimal(3,2)").cast("string")
        key = F.concat(name, F.lit(" "), amount)
        more = F.when(key == " ".join(LOW_TRANSITION), F.coalesce(bits, F.lit(""))).otherwise("")
        return F.concat(F.lit("-"), amount, F.lit(": "), F.element_at(F.create_map(*entries), key), more)

    return F.zip_with(rules_fired, penalties, sentence)


def line_vetoed(facts: Column) -> Column:
    """Some rule that looks at the line alone vetoes every match on it."""
    return (
        facts["function_call"] | facts["variable_assignment"] | facts["null_value"]
        | facts["css_selector"] | facts["commented_out"]
    )


def total_penalty(fired: list[Flag]) -> Column:
    """Sum of penalties, at most 1, as an exact decimal; added in hundredths."""
    each = F.array(*[F.when(f.fired, round(float(f.penalty) * 100)).otherwise(0) for f in fired])
    hundredths = F.aggregate(each, F.lit(0), lambda total, one: total + one)
    capped = F.least(hundredths, F.lit(100)).cast("decimal(3,0)")
    return (capped * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(3,2)")


def suppression(fired: list[Flag]) -> Column:
    """Struct ``(rules_fired, penalties, total_penalty, suppressed,
    suppressor_score)`` with decimals, so that penalties add up exactly."""

    def result(total: Column) -> Column:
        return F.struct(
            F.filter(
                F.array(*[F.when(f.fired, F.lit(f.name)) for f in fired]),
                lambda n: n.isNotNull(),
            ).alias("rules_fired"),
            F.filter(
                F.array(*[F.when(f.fired, F.lit(float(f.penalty))) for f in fired]),
                lambda p: p.isNotNull(),
            ).alias("penalties"),
            total.alias("total_penalty"),
            (total >= F.lit(GATE_PENALTY).cast("decimal(3,2)")).alias("suppressed"),
            (F.lit("1.00").cast("decimal(3,2)") - total).cast("decimal(3,2)").alias("suppressor_score"),
        )

    return let(total_penalty(fired), result)
