"""Expressions against small direct definitions, on random inputs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credscan.functions import blocks
from credscan.functions import entropy as E
from credscan.functions import groups as G
from credscan.functions import signals as S
from credscan.functions import suppress as P
from credscan.functions.sqltext import quote
from credscan.functions.text import either, folded_sql, split_lines, strip, strip_value, utf8_text
from credscan.operators import scan

BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
SPACES = " \t\x1f\xa0" + chr(0x3000)


def texts(seed, alphabet, n=150, longest=40):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


def apply(spark, inputs, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    rows = df.select("i", make(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def bits(symbols):
    n = len(symbols)
    return -sum(c / n * math.log2(c / n) for c in Counter(symbols).values()) if n else 0.0


def test_entropy(spark):
    xs = texts(1, "abcXYZ019-_=" + chr(0xE9) + chr(0x1F600)) + ["", "a", "aa", "X" * 12, "0123456789"]
    got = apply(spark, xs, lambda x: F.array(E.shannon_entropy(x), E.transition_entropy(x)))
    for x, (h, t) in zip(xs, got):
        assert h == pytest.approx(bits(x) if len(x) > 1 else 0.0, abs=1e-9)
        assert t == pytest.approx(bits([x[i:i + 2] for i in range(len(x) - 1)]), abs=1e-9)


def test_entropy_goldens(spark):
    xs = ["your-api-key-here", "YOUR_API_KEY", "0123456789", "XXXXXXXXXXXX",
          "-----BEGIN " + "RSA PRIVATE KEY-----"]
    got = apply(spark, xs, E.evaluate_entropy)
    assert [(r["shannon"], r["transition"]) for r in got] == [
        (3.293, 4.0), (3.252, 3.459), (3.322, 3.17), (0.0, 0.0), (3.382, 4.107)]
    assert [r["is_placeholder"] for r in got] == [True, False, False, True, False]
    assert apply(spark, ["abcdefg"], E.evaluate_entropy)[0]["entropy_score"] == 0.0


def test_entropy_of_a_very_long_token(spark):
    x = "".join(random.Random(2).choices("0123456789abcdef", k=200_000))
    assert apply(spark, [x], E.transition_entropy)[0] == pytest.approx(8.0, abs=0.01)


def test_split_lines_and_strip(spark):
    xs = texts(3, "ab" + BREAKS + SPACES) + ["", "\n", "\r\n", "a\n\n", "a\r\nb\r"]
    assert apply(spark, xs, lambda x: split_lines("x")) == [x.splitlines() for x in xs]
    assert apply(spark, xs, strip) == [x.strip() for x in xs]


def test_folded_shows_what_a_case_insensitive_pattern_accepts(spark):
    odd = [chr(c) for c in (0x130, 0x131, 0x17F, 0x212A)]
    xs = [f"A{o}za" for o in odd] + [f"{o}k_l{o}ve" for o in odd]
    low = apply(spark, xs, lambda x: F.expr(folded_sql("x")))
    for x, f in zip(xs, low):
        for needle in ("aiza", "akza", "asza", "sk_live", "kk_lkve", "ik_live", "sk_lsve"):
            if re.search(f"(?i){needle}", x):
                assert needle in f


def test_utf8_text(spark):
    raw = [b"ok", b"\xffa\xc3", "é".encode() + b"\xfe!", b"\xe2\x82", b""]
    assert apply(spark, raw, utf8_text, "binary") == [b.decode("utf-8", "ignore") for b in raw]


def test_string_literals(spark):
    xs = texts(4, "ab\"'\\\n", 400, 30) + ['"' + "\\x" * 30_000 + '"']
    pattern = r"""(?:"([^"\\]*(?:\\.[^"\\]*)*)"|'([^'\\]*(?:\\.[^'\\]*)*)')"""
    want = [[a or b for a, b in re.findall(pattern, x) if len(a or b) >= 3] for x in xs]
    assert apply(spark, xs, G.string_literals) == want


def test_string_group_keeps_first_of_each(spark):
    x = "a('xyz') b(\"https://h/p\") 'xyz' https://h/p"
    assert apply(spark, [x], G.string_group) == [["xyz", "https://h/p"]]


def block(lines, at):
    """First and last index of the block, by walking."""
    first = at
    for i in range(at, -1, -1):
        s = lines[i].strip()
        if s.startswith(G.BLOCK_OPENERS):
            first = i
            break
        if s == "" and i < at - 1:
            first = i + 1
            break
    last = len(lines) - 1
    for i in range(at + 1, len(lines)):
        if lines[i].strip().startswith(G.BLOCK_ENDERS):
            last = i - 1
            break
    return "\n".join(lines[first:last + 1])


def test_block_context(spark):
    r = random.Random(5)
    kinds = ["x = 1", "", "  ", "def f():", "  class A:", "protected int x", "private y", "\tasync def g"]
    docs = [[r.choice(kinds) for _ in range(r.randrange(1, 14))] for _ in range(120)]
    rows = [(d, i + 1, block(d, i)) for d in docs for i in range(len(d))]
    df = spark.createDataFrame(rows, "ls array<string>, n int, want string")
    assert df.where(G.block_context(F.col("ls"), F.col("n")) != F.col("want")).count() == 0


def test_signals(spark):
    xs = ["", "https://api.stripe.com charge", "test mock example", "Bearer aws AKIA s3 oauth client_secret stripe"]
    got = apply(spark, xs, S.signal_score)
    assert got[0] == 0.5 and got[2] == pytest.approx(0.11) and got[3] == 1.0
    assert got[1] == pytest.approx(0.5 + 0.10 + 0.10 + 0.10 + 0.05 + 0.08)


def rules_fired(spark, line, secret, path="src/a.py", te=5.0):
    df = spark.createDataFrame([(line, secret, path, te)], "l string, s string, p string, te double")
    df = df.select("*", P.line_facts(F.col("l")).alias("f"))
    own = P.secret_facts(F.col("s"), F.col("f"))
    df = df.select("*", own.alias("o"))
    flags = P.flags(P.in_test_directory(F.col("p")), P.in_readme_file(F.col("p")), F.col("f"), F.col("o"), F.col("te"))
    return df.select(P.suppression(flags).alias("r")).first()["r"]


@pytest.mark.parametrize("line, secret, path, names, penalty", [
    ("password = getPassword(x)", "password = getPassword", "", ["has_function_call", "no_cloud_api_nearby"], 1.0),
    ("secret = os.environ['S']", "secret = os.environ", "",
     ["is_variable_assignment", "no_cloud_api_nearby"], 1.0),
    ('key = f"a.b" ; api.x', "z" * 30, "", [], 0.0),
    ("t " + "v" * 30, "ab" * 20, "/tests/a.py", ["in_test_directory"], 0.85),
    ("t", "ab" * 20, "tests/a.py", [], 0.0),
    ("t", "ab" * 20, "README.md", ["in_readme_file"], 0.85),
    ('pwd = "123"; api.', 'token = "1234567890123"' + "x" * 9, "", ["is_numeric_only"], 0.85),
    ("token = None api.", "z" * 30, "", [], 0.0),
    ("api. token = none", "z" * 30, "", ["has_null_value"], 0.95),
    (".box { api.", "z" * 30, "", ["is_css_selector"], 0.85),
    ("  <!-- api.", "z" * 30, "", ["is_commented_out"], 0.85),
    ("api.", "changeme" + "y" * 30, "", ["matches_placeholder_pattern"], 0.90),
    ('api. "XXXXXXXX"', "z" * 30, "", ["transition_entropy_below_threshold"], 0.85),
    ('api. "aaaaaaa"', "z" * 30, "", [], 0.0),
    ('api. " Admin "', "z" * 30, "", ["is_weak_default_password"], 0.85),
    ("api.", "''", "", ["is_empty_string"], 0.95),
    ("api.", '""', "", ["is_empty_string"], 0.95),
    ("short", "z" * 29, "", ["no_cloud_api_nearby"], 0.30),
    ("short", "z" * 30, "", [], 0.0),
])
def test_suppression_rules(spark, line, secret, path, names, penalty):
    r = rules_fired(spark, line, secret, path)
    assert r["rules_fired"] == names and float(r["total_penalty"]) == penalty
    assert r["suppressed"] == (penalty >= 0.8)


def test_low_transition_needs_twelve_characters(spark):
    assert rules_fired(spark, "api.", "a" * 12, te=2.199)["rules_fired"] == ["transition_entropy_below_threshold"]
    assert rules_fired(spark, "api.", "a" * 11, te=2.0)["rules_fired"] == []


def test_linear_time_on_very_long_words(spark):
    """Neither the line rules nor the path to them backtrack quadratically."""
    line = "token = " + "a" * 400_000 + " key " + "b" * 400_000
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(P.line_facts(F.col("l")).alias("f")).first()["f"]["function_call"] is False


def test_quote_round_trip(spark):
    for x in ("it's", "a\\n", "${x} $y", "\\", "tab\t"):
        assert spark.range(1).select(F.expr(quote(x))).first()[0] == x


def test_reasons_of_fired_rules(spark):
    rows = [
        (1, ["is_numeric_only", "transition_entropy_below_threshold"], [0.85, 0.80], 1.585),
        (2, ["transition_entropy_below_threshold"], [0.85], 0.0),
        (3, ["transition_entropy_below_threshold"], [0.80], None),
        (4, [], [], 3.0),
        (5, None, None, 3.0),
    ]
    df = spark.createDataFrame(rows, "id int, rules array<string>, penalties array<double>, te double")
    got = {r["id"]: r["why"] for r in df.select("id", P.reasons(F.col("rules"), F.col("penalties"), F.col("te")).alias("why")).collect()}
    low = f"-0.80: {P.REASONS[P.LOW_TRANSITION]}"
    assert got == {
        1: [f"-0.85: {P.REASONS[P.NUMERIC_ONLY]}", f"{low} (1.585 bits)"],
        2: [f"-0.85: {P.REASONS[P.REPEATED_VALUE]}"], 3: [low], 4: [], 5: None,
    }
    assert all("." in penalty and why for (_, penalty), why in P.REASONS.items())


def test_either_is_any_of(spark):
    for patterns, lead, words in (
        (P.PLACEHOLDER_SHAPES, "^", ("your", "-api", "key", "here", "xxx", "todo", "Mock", "put")),
        (E.KNOWN_PLACEHOLDERS, "^", ("insert", "your", "-token", "abc", "password", "1", "Changeme", " ")),
        (P.TEST_PATHS, r"[/\\]", ("/", "\\", "test", "tests", "mock", "spec", "-", "stub")),
    ):
        joined = either(patterns, lead)
        assert joined.count(lead + "(") == 1  # one alternative at most places
        rng = random.Random(3)
        xs = ["".join(rng.choices(words, k=rng.randrange(6))) for _ in range(300)]
        got = apply(spark, xs, lambda x: F.array(*[x.rlike("(?iud)" + p) for p in (joined, P.any_of(patterns))]))
        assert all(a == b for a, b in got) and 0 < sum(a for a, _ in got) < len(xs)


def test_guards_leave_line_tests_as_they_were(spark):
    """What is looked for first never ends a test that the expression alone would pass."""
    words = ("password", "secret", "TOKEN", " = ", "=", ":", "(", ")", "null", "N" + chr(0x131) + "L", "None", "undefined", '""', "''",
             "a", "cfg", ".", "[", "{", "}", ";", "@media ", "#", "def ", "class ", "function ", "\t", "\xa0", chr(0x3000), "12", chr(0x661))
    rng = random.Random(11)
    known = ["password = cfg(a)", "token = cfg.a", ".token {", "token = null", "pwd = ''", "def ", " def x", "\xa0 12 "]
    xs = ["".join(rng.choices(words, k=rng.randrange(8))) for _ in range(600)] + known
    got = apply(spark, xs, lambda x: F.array(
        P.has_function_call(x), x.rlike(P.CALL),
        P.is_variable_assignment(strip(x)), strip(x).rlike(P.REFERENCE) & ~strip(x).rlike(P.LITERAL_RIGHT_SIDE),
        P.has_null_value(strip(x)), strip(F.regexp_extract(strip(x), P.RIGHT_SIDE, 1)).rlike(P.NULL_WORD),
        P.is_css_selector(x), x.rlike("(?d)" + P.any_of(P.CSS_SHAPES)),
        P.is_number(x), strip(x).rlike(r"(?d)^[\p{Nd}]+$"),
        strip_value(x) == strip(x), F.lit(True),
        # a line opens a block if its bounds begin with it though a line above is blank
        G.blocks_around(F.array(F.lit("a"), F.lit(""), F.lit("b"), x, F.lit("c")), F.array(F.lit(5)))[0]["first"] == 4,
        strip(x).rlike("^(?:" + "|".join(G.BLOCK_OPENERS) + ")"),
    ))
    for i in range(0, 14, 2):
        assert all(g[i] == g[i + 1] for g in got) and any(g[i] for g in got), i


def test_tests_on_matches_are_columns(spark):
    """Lambdas are interpreted for each match; columns are evaluated by generated code, each once."""
    texts = spark.createDataFrame([(1, "src/a.py", "x")], "doc_id long, file_path string, content string")
    for found in (scan.report(texts), scan.scan(texts)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert all(f" AS {step}#" in plan for step in ("_bare", "_nonempty", "_te", "_fired"))


def test_one_block_is_read_once_for_all_its_hits(spark):
    """Many hits of one block: the same verdicts as by the way through all blocks."""
    lines = ["def f():", 'a = "https://api.example.org"', 'token = "x1"', "b", 'password = "y22"']
    rows = spark.createDataFrame([(lines,)], "lines array<string>")
    bounds = F.array(*[F.struct(F.lit(1).alias("first"), F.lit(5).alias("last"))] * 3)
    one, all_ = rows.select(blocks.block_verdicts(F.col("lines"), bounds), blocks._block_verdicts(F.col("lines"), bounds)).first()
    assert one == all_ and len(one) == 3 and one[0]["string_group_size"] == 2


def test_bindings_do_not_take_elements_of_transformed_arrays(spark):
    """Taking such an element derives the type of all that is bound, in every row."""
    rows = spark.createDataFrame([("x = 'https://api.example.org'",), (None,)], "x string")
    scores = rows.select(S.signal_score(F.col("x")).alias("p"))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "transform(" not in plan
    assert [r["p"] for r in scores.collect()] == [0.58, 0.5]
