"""Detection rules and scoring constants (fixed values).

Identifiers, descriptions, expressions, tags, severities, minimum lengths,
tiers and weights are fixed by the rule format this engine is compatible
with. ``needles`` is ours: substrings that any match must contain once
lower-cased, as an AND of any-of groups; they let a cheap byte search decide
whether the expression needs to run at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from credscan.functions.literals import needles
from credscan.functions.text import WS

DEFAULT_MIN_LENGTH = 8
DEFAULT_TIER = 3
DEFAULT_SEVERITY = "medium"

# Weight of a match by tier, and of each layer in the combined score.
TIER_WEIGHTS = {1: "1.00", 2: "0.70", 3: "0.40"}
LAYER_WEIGHTS = {"regex": "0.30", "entropy": "0.20", "classifier": "0.35", "suppressor": "0.15"}
# The classifier probability is scaled by tier before it is weighted.
CLASSIFIER_TIER_FACTOR = {1: "1.10", 2: "1.00", 3: "0.70"}

GATE_PENALTY = "0.80"
DEFAULT_THRESHOLD = 0.30
# Highest score a vetoed finding can reach: (0.30+0.20+0.35) x (1-0.80).
GATED_MAX_SCORE = 0.17
SEVERITY_CUTOFFS = (("critical", 0.70), ("high", 0.50), ("medium", 0.30))

HIGH_ENTROPY_RULE = "high-entropy-generic"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str
    pattern: str
    tags: tuple[str, ...]
    severity: str
    tier: int
    needles: tuple[tuple[str, ...], ...]
    min_length: int = DEFAULT_MIN_LENGTH
    custom: bool = False

    @property
    def weight(self) -> str:
        return TIER_WEIGHTS.get(self.tier, TIER_WEIGHTS[DEFAULT_TIER])

    @property
    def regex(self) -> str:
        """For Spark: every rule ignores case, over all of Unicode."""
        return "(?iu)" + self.pattern

    @property
    def folded_regex(self) -> str:
        """For a folded text: no case flag needed, so matching is cheaper."""
        return self.pattern.lower()


#: A catalogue is part of the plan; one with more rules than this is a mistake.
MOST_RULES = 5_000

KEYWORDS = ("key", "secret", "token", "password", "pwd")

RULES: tuple[Rule, ...] = (
    Rule("aws-access-key", "AWS Access Key ID",
         r"AKIA[0-9A-Z]{16}",
         ("aws", "key"), "high", 1, (("akia",),)),
    Rule("aws-secret-key", "AWS Secret Access Key",
         rf"""aws[_\-{WS}]*(secret[_\-{WS}]*access[_\-{WS}]*key|secret[_\-{WS}]*key)"""
         rf"""[{WS}]*[:=][{WS}]*["']?[A-Za-z0-9/+=]{{40}}["']?""",
         ("aws", "secret"), "critical", 1, (("aws",), ("secret",), ("key",), (":", "="))),
    Rule("github-token", "GitHub Personal Access Token (classic or fine-grained)",
         r"gh[pousr]_[0-9a-zA-Z]{36}",
         ("github", "token"), "high", 1, (("_",), ("gh",))),
    Rule("stripe-secret-key", "Stripe Secret Key",
         r"sk_live_[0-9a-zA-Z]{24}",
         ("stripe",), "high", 1, (("sk_live_",),)),
    Rule("private-key-openssh", "OpenSSH Private Key",
         r"-----BEGIN OPENSSH PRIVATE KEY-----",
         ("private-key", "ssh"), "critical", 1, (("-----begin openssh",),)),
    Rule("private-key-rsa", "RSA Private Key",
         r"-----BEGIN RSA PRIVATE KEY-----",
         ("private-key", "rsa"), "critical", 1, (("-----begin rsa",),)),
    Rule("generic-api-key", "Generic API key / token assignment",
         rf"""(api[_-]?key|secret|token|password|pwd|api[_-]?secret|auth[_-]?token)"""
         rf"""[{WS}]*[:=][{WS}]*["']?[a-zA-Z0-9\-_@!#$%^&*.+/=]{{8,100}}["']?""",
         ("generic", "api"), "medium", 2, ((":", "="), KEYWORDS)),
    Rule("slack-token", "Slack Token (bot/user/app)",
         r"xox[baprs]-[0-9]{8,13}-[0-9]{8,13}-[0-9a-zA-Z]{8,}",
         ("slack", "token"), "high", 1, (("xox",),), 30),
    Rule("auth-token-bearer", "Hardcoded Bearer / JWT token in assignment",
         rf"""(auth[_\-]?token|bearer_token|access_token)[{WS}]*[=:][{WS}]*"""
         r"""["']?Bearer [A-Za-z0-9\-_.]+\.[A-Za-z0-9\-_.]+["']?""",
         ("jwt", "bearer", "token"), "high", 1, (("bearer ",), ("token",)), 20),
    Rule("twitter-access-token", "Twitter Access Token",
         r"[1-9][0-9]+-[0-9a-zA-Z]{40}",
         ("twitter", "token"), "high", 3, (("-",),)),
    Rule("facebook-access-token", "Facebook Access Token",
         r"EAACEdEose0cBA[0-9A-Za-z]+",
         ("facebook", "token"), "high", 1, (("eaacedeose0cba",),)),
    Rule("google-api-key", "Google API Key",
         r"AIza[0-9A-Za-z\-_]{35}",
         ("google", "api-key"), "high", 1, (("aiza",),)),
    Rule("google-oauth-id", "Google OAuth Client ID",
         r"[0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com",
         ("google", "oauth"), "high", 2, ((".apps.googleusercontent.com",),)),
    Rule("picatic-api-key", "Picatic API Key",
         r"sk_live_[0-9a-z]{32}",
         ("picatic", "api-key"), "high", 1, (("sk_live_",),)),
    Rule("stripe-restricted-key", "Stripe Restricted API Key",
         r"rk_live_[0-9a-zA-Z]{24}",
         ("stripe", "api-key"), "high", 1, (("rk_live_",),)),
    Rule("square-access-token", "Square Access Token",
         r"sq0atp-[0-9A-Za-z\-_]{10,}",
         ("square", "token"), "high", 1, (("sq0atp-",),), 18),
    Rule("square-oauth-secret", "Square OAuth Secret",
         r"sq0csp-[0-9A-Za-z\-_]{20,}",
         ("square", "oauth"), "high", 1, (("sq0csp-",),), 27),
    Rule("paypal-braintree-token", "PayPal Braintree Access Token",
         r"access_token[$]production[$][0-9a-zA-Z]{10,}[$][0-9a-fA-F]{16,}",
         ("paypal", "braintree", "token"), "critical", 1, (("access_token$production$",),), 40),
    Rule("amazon-mws-auth-token", "Amazon MWS Auth Token",
         r"amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
         ("amazon", "mws", "token"), "high", 1, (("amzn.mws.",),)),
    Rule("twilio-api-key", "Twilio API Key",
         r"SK[0-9a-fA-F]{32}",
         ("twilio", "api-key"), "high", 1, (("sk",),)),
    Rule("mailgun-api-key", "MailGun API Key",
         r"key-[0-9a-zA-Z]{32}",
         ("mailgun", "api-key"), "high", 2, (("key-",),)),
    Rule("mailchimp-api-key", "MailChimp API Key",
         r"[0-9a-f]{32}-us[0-9]{1,2}",
         ("mailchimp", "api-key"), "high", 2, (("-us",),)),
    Rule("private-key-ec", "EC Private Key",
         r"-----BEGIN EC PRIVATE KEY-----",
         ("private-key", "ec"), "critical", 1, (("-----begin ec",),)),
    Rule("private-key-pgp", "PGP Private Key Block",
         r"-----BEGIN PGP PRIVATE KEY BLOCK-----",
         ("private-key", "pgp"), "critical", 1, (("-----begin pgp",),)),
    Rule("private-key-generic", "Generic Private Key (PKCS#8)",
         r"-----BEGIN PRIVATE KEY-----",
         ("private-key",), "critical", 1, (("-----begin private",),)),
    Rule("google-oauth-auth-code", "Google OAuth Authorization Code",
         r"4/[0-9A-Za-z\-_]{20,}",
         ("google", "oauth"), "medium", 2, (("4/",),)),
    Rule("google-oauth-refresh-token", "Google OAuth Refresh Token",
         r"1/[0-9A-Za-z\-_]{43,64}",
         ("google", "oauth", "refresh-token"), "high", 2, (("1/",),)),
    Rule("google-oauth-access-token", "Google OAuth Access Token",
         r"ya29\.[0-9A-Za-z\-_]+",
         ("google", "oauth", "access-token"), "high", 1, (("ya29.",),)),
)

RULE_SCHEMA = T.StructType([
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("regex", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("min_length", T.IntegerType()),
    T.StructField("tier", T.IntegerType()),
    T.StructField("tier_weight", T.DoubleType()),
])


def rules_from(table: DataFrame) -> tuple[Rule, ...]:
    """A catalogue from a table of rules, for ``Layers(rules=...)``.

    Needs ``rule_id`` and ``regex`` (of the JVM's dialect; case is ignored); ``description``,
    ``tags``, ``severity``, ``min_length`` and ``tier`` may be missing or null. A known id without a
    tier keeps its own, any other is of tier 3. Rules keep the order of ``rule_ord``, or of their ids.
    """
    order = "rule_ord" if "rule_ord" in table.columns else "rule_id"
    rows = table.orderBy(order).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    tiers = {r.rule_id: r.tier for r in RULES}
    compiles = table.sparkSession._jvm.java.util.regex.Pattern.compile
    out = []
    for row in rows:
        own = {k: v for k, v in row.asDict().items() if v is not None}
        known = next((r for r in RULES if (r.rule_id, r.pattern) == (own["rule_id"], own["regex"])), None)
        compiles(own["regex"])  # a bad expression is an error now, not in some task
        out.append(Rule(
            own["rule_id"], own.get("description", own["rule_id"]), own["regex"], tuple(own.get("tags", ())),
            own.get("severity", DEFAULT_SEVERITY), own.get("tier", tiers.get(own["rule_id"], DEFAULT_TIER)),
            known.needles if known else needles(own["regex"]), own.get("min_length", DEFAULT_MIN_LENGTH), known is None,
        ))
    return tuple(out)


def rule_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a joinable table, one row per rule."""
    rows = [
        (i, r.rule_id, r.description, r.pattern, list(r.tags), r.severity,
         r.min_length, r.tier, float(r.weight))
        for i, r in enumerate(RULES)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
