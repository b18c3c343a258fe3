"""Planted files: code with credentials and look-alikes, one set per supplier.

The supplied texts hold few hits of one rule, so the scans also run over files
derived from the supplier table. Templates carry marks instead of tokens; the
marks are filled from a digest of the key when a query runs, so that no
token-like literal exists in this repository and both SQL dialects produce the
same bytes.

Marks: ``~`` nothing (keeps prefixes apart), ``{h}`` digest (32 hex digits),
``{H}`` the same in capitals, ``{x}`` its first 24, ``{U}`` its first 16 in
capitals, ``{s}`` its first 8, ``{q}`` 4 and ``{t}`` 12 further ones, ``{d}``
12 decimal digits, ``{n}`` the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credscan.functions.sqltext import quote
from credscan.sources.layout import spread

# (template number, path, content)
FILES: tuple[tuple[int, str, str], ...] = (
    (1, "src/aws/client_{n}.py", """import boto3

def upload(path):
    # region us-east-1
    access = "AK~IA{U}"
    aws_secret_access_key = "{h}{s}"
    aws_secret_key: '{h}{s}'
    aws secret key = {h}{s}
    url = "https://s3.amazonaws.com/bucket-{n}"
    return boto3.client("s3", url)

def short():
    access = "AK~IA{s}"
    aws_secret_access_key = "{h}"
    return None
"""),
    (2, "src/git/hooks_{n}.js", """function push() {
  const a = "gh~p_{h}{q}";
  const b = "gh~s_{h}{q}";
  const c = "gh~o_{h}";
  fetch("https://api.github.com/user", {headers: a});
}

class Client {
  send() { return 'gh~u_{H}{q}'; }
}
"""),
    (3, "src/pay/charge_{n}.py", """def charge(amount):
    stripe.api_key = "sk~_live_{x}"
    picatic = "sk~_live_{h}"
    restricted = "rk~_live_{x}"
    wrong = "sk~_live_{s}"
    braintree = "access~_token$production${U}${h}"
    half = "access~_token$production${s}${h}"
    requests.post("https://api.stripe.com/v1/charges", "Authorization", "Bearer payment charge")

async def refund(amount):
    return "no secret here"
"""),
    (4, "src/keys/pem_{n}.txt.tpl", """-----BEGIN ~RSA PRIVATE KEY-----
{h}{H}
-----BEGIN ~OPENSSH PRIVATE KEY-----
-----BEGIN ~EC PRIVATE KEY-----
-----BEGIN ~PGP PRIVATE KEY BLOCK-----
-----BEGIN ~PRIVATE KEY-----
-----begin ~private key-----
-----BEGIN ~DSA PRIVATE KEY-----
"""),
    (5, "src/google/maps_{n}.java", """public class Maps {
  private String key() {
    return "AI~za{h}abc";
  }
  protected String id() {
    return "{d}-{h}.apps.googleusercontent.com";
  }
  String code = "4~/{h}";
  String refresh = "1~/{h}{U}";
  String refreshShort = "1~/{h}{s}";
  String token() { return "ya~29.{x}-{s}"; }
  String tiny = "ya~29.ab";
  String three = "ya~29.abc";
  String url = "https://www.googleapis.com/oauth2/v4/token?client={n}";
}
"""),
    (6, "src/chat/slack_{n}.rb", """slack = 'xo~xb-{d}-{d}-{x}'
slack = 'xo~xp-{d}-{d}-abc'
facebook = 'EA~ACEdEose0cBA{h}'
twitter = '9{d}-{h}{s}'
twitter_short = '9{d}-{h}'
twilio = 'SK~{h}'
mailgun = 'key~-{h}'
mailchimp = '{h}-us~{q}'
mailchimp = '{h}-us1'
mws = 'amzn~.mws.{s}-{q}-{q}-{q}-{t}'
square = 'sq~0atp-{s}ab'
square = 'sq~0atp-{s}abc'
square_secret = 'sq~0csp-{x}'
"""),
    (7, "src/app/settings_{n}.py", """password = "S3cr{h}"
secret: 'v{x}'
api-key={h}
auth_token = "Bearer {h}.{x}"
access_token: Bearer {h}.{x}
pwd = "{s}"
pwd = "{q}"

token = "{h}"  # rotated {n}
client_secret = "{h}{h}{h}{h}"
"""),
    (8, "src/app/lookups_{n}.py", """password = getPassword{n}()
password = getPassword(x); token = "{h}"
secret = os.environ["SECRET_{n}"]
secret = "{x}" + os.environ["SECRET"]
api_key = self.config.api_key
token = settings.TOKEN_{n}
token = undefined_
secret = 'a.b'; token = "{h}"
key = config.get("x"); password = "{h}"
token = f"{h}-{x}"
"""),
    (9, "/srv/app/tests/test_auth_{n}.py", """def test_login():
    password = "T{h}"
    assert "AK~IA{U}"
"""),
    (10, "tests/login_{n}.py", """def login():
    password = "T{h}"
    url = "https://api.example.com"
"""),
    (11, "README_{n}.md", """Set the key:

    api_key = "{h}"
"""),
    (12, "/srv/docs/setup_{n}.html", """token = "{h}"
"""),
    (13, "src/values/numbers_{n}.py", """password = "{d}"
api_key = {d}
token = "{h}"; port = "8080"
secret = {h}; port = "8080"
token = null
token = None; password = "{h}"
secret = ""; api_key = "{h}"
password = undefined
pass = ''; token = "{h}"
token =   nil
"""),
    (14, "src/web/style_{n}.css", """.token-box { color: red; } api_key = "{h}"
#login {
  password: "{h}";
  secret: {h};
@media print { token = "{h}"
x = { apiKey: "{h}", secret: "{h}" }
const y = {apiKey: "v", token: "{h}"}
"""),
    (15, "src/app/comments_{n}.py", """# password = "{h}"
    // api_key = "{h}"
/* token = "{h}" */
 * secret = "{h}"
<!-- pwd = "{h}" -->
*secret = "{h}"
x = 1 # password = "{h}"
"""),
    (16, "src/app/placeholders_{n}.py", """api_key = "your-api-key-here"
password = "your-password-here"
token = your_token_here_{n}
secret = "REPLACE_ME_{n}"
api_key = "insert-your-key-{n}"
secret = "XXXXXXXXXXXXXXXX"
secret = "aaaaaaa"
secret = "abababababab"
token = "todo: {h}"
password = "changeme"
password = "password123"
token = "example_key_{n}"
token = "dummy{h}"
secret = "test-secret"
secret = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa
api_key = "fake_key_{x}"
"""),
    (17, "src/app/weak_{n}.py", """password = "admin123"
password = "  Letmein1  "
secret = "django-insecure-{h}"
secret = "dev-secret-{s}"
password = "{s}"
password = "{s}{s}{s}{q}"
token = "{s}api."
token = "{s}"; host = "x.azure.net"
token = 12ab34cd; user = "admin"
"""),
    (18, "src/app/blocks_{n}.py", """import os
a = "first literal"
token = "{h}"

b = "after blank"
secret = "{x}"
def first():
    c = "in first"
    password = "p{h}"

    d = "still first"
    api_key = "k{h}"
class Holder:
    e = "class member https://auth.example.com/login"
    token = "{H}"
    protected void f() { return; }
    secret = "{h}-{s}"
"""),
    (19, "src/app/mixed_{n}.py", "api_key = \"{h}\"\r\nkey2 = 'x'\rtoken = \"{x}{s}\"\x0b"
     "pwd = '{h}'\x0c\x1csecret = {h}\x85password: \"{h}\"\n\n\t \ntoken:\xa0\"{h}\"\n"),
    (20, "src/app/quoting_{n}.py", """a = "esc \\" quote" + 'it\\'s' + "" + 'ab' + "abc"
url = "https://db.example.org/connection?x={n}" ; password = "{h}"
text = "open
still open" ; token = '{h}'
"""),
    (21, "src/data/blobs_{n}.dat", """key: QmFzZ{h}Zm9v{H}
session {h}/{H}+AbCdEfGhIjKlMnOpQrStUv
value {h}/{H}+AbCdEfGhIjKlMnOpQrStUv
test key {h}/{H}+AbCdEfGhIjKlMnOpQrStUv
jwt aaaaaaaaaabbbbbbbbbbccccccccccdddddddddd
img data:image/png;base64,{h}{H} secret
# token {h}/{H}+AbCdEfGhIjKlMnOpQrStUv
private AK~IA{U}/{H}+abcdefghijklmnopqrstuvwxyz
auth.{h}{H}.GhIjKlMnOpQrStUvWxYz and auth.{h}{H}.GhIjKlMnOpQrStUvWxYz
fake_token = "{h}"
  Dummy password = "{h}"
"""),
    (22, "img/logo_{n}.PNG", """token = "{h}"
"""),
    (23, "node_modules/pkg_{n}/index.js", """token = "{h}"
"""),
    (24, "docs/empty_{n}", ""),
)

# Labelled scenarios: (number, category, is_secret, path, code).
# Categories and labels follow the published scenario list; the code is ours.
SCENARIOS: tuple[tuple[int, str, bool, str, str], ...] = (
    (1, "A", True, "src/a.py", "AK~IA{U}"),
    (2, "A", True, "src/a.py", "id AK~IA{U}"),
    (3, "A", True, "src/a.py", "sk~_live_{x}"),
    (4, "A", True, "src/a.py", "rk~_live_{x}"),
    (5, "A", True, "src/a.py", "AI~za{h}xyz"),
    (6, "A", True, "src/a.py", "ya~29.{h}"),
    (7, "A", True, "src/a.py", "gh~p_{h}{q}"),
    (8, "A", True, "src/a.py", "gh~s_{h}{q}"),
    (9, "A", True, "src/a.py", "xo~xb-{d}-{d}-{x}"),
    (10, "A", True, "src/a.py", "sq~0atp-{U}"),
    (11, "A", True, "src/a.py", "sq~0csp-{h}"),
    (12, "A", True, "src/a.py", "EA~ACEdEose0cBA{h}"),
    (13, "A", True, "src/a.py", "access~_token$production${U}${h}"),
    (14, "A", True, "src/a.py", "amzn~.mws.{s}-{q}-{q}-{q}-{t}"),
    (15, "A", True, "src/a.pem", "-----BEGIN ~RSA PRIVATE KEY-----"),
    (16, "A", True, "src/a.pem", "-----BEGIN ~OPENSSH PRIVATE KEY-----"),
    (17, "A", True, "src/a.pem", "-----BEGIN ~EC PRIVATE KEY-----"),
    (18, "A", True, "src/a.pem", "-----BEGIN ~PGP PRIVATE KEY BLOCK-----"),
    (19, "B", True, "src/b.py",
     "def pay():\n    api_key = \"k{h}\"\n    post(\"https://api.stripe.com/v1/charges\")"),
    (20, "B", True, "src/b.py", "password = \"Pq9{h}\""),
    (21, "B", True, "src/b.py", "token = \"ey~J{h}.ey~J{x}.{h}\""),
    (22, "B", True, "src/b.py", "aws_secret_access_key = \"{h}{s}\""),
    (23, "B", True, "src/b.py", "db_password = \"w{h}\"\nhost = \"db.internal\""),
    (24, "B", True, "src/b.py", "client_secret = \"c{h}\""),
    (25, "B", True, "src/b.py", "auth_token = \"Bearer {h}.{h}\""),
    (26, "C", True, "src/c.java", "String a = \"{h}\";"),
    (27, "C", True, "src/c.java",
     "x = \"AK~IA{U}\"\ny = \"https://s3.amazonaws.com/private\""),
    (28, "C", True, "src/c.java", "a = \"gh~p\" + \"_{h}{q}\";"),
    (29, "C", True, "src/c.java", "b = \"sk~_live\" + \"_{x}\";"),
    (30, "C", True, "src/c.java", "c = \"postgresql://u:{s}@db/prod\";"),
    (31, "D1", False, "src/d.py", "password = getPassword{n}()"),
    (32, "D1", False, "src/d.py", "secret = config.get(\"name\")"),
    (33, "D1", False, "src/d.py", "token = headers.get(\"Authorization\")"),
    (34, "D1", False, "src/d.py", "secret = vault.read_secret(path_{n})"),
    (35, "D1", False, "src/d.py", "password = bcrypt.hashpw(pw, salt)"),
    (36, "D2", False, "src/d.py", "password = ui.password_{n}"),
    (37, "D2", False, "src/d.py", "api_key = self.config.api_key"),
    (38, "D2", False, "src/d.py", "secret = os.environ[\"S_{n}\"]"),
    (39, "D2", False, "src/d.py", "token = settings.SECRET_KEY"),
    (40, "D3", False, "/srv/tests/test_auth.py", "password = \"t{h}\""),
    (41, "D3", False, "/srv/mocks/user.py", "api_key = \"m{h}\""),
    (42, "D3", False, "/srv/fixtures/user.py", "token = \"f{h}\""),
    (43, "D4", False, "README.md", "api_key = \"your-api-key-here\""),
    (44, "D4", False, "/srv/docs/auth.html", "token = \"d{h}\""),
    (45, "D5", False, "src/d.py", "password = \"{d}\""),
    (46, "D5", False, "src/d.py", "api_key = \"9{d}\""),
    (47, "D5", False, "src/d.py", "password = 12345"),
    (48, "D6", False, "src/d.py", "password = None"),
    (49, "D6", False, "src/d.py", "token = \"\""),
    (50, "D6", False, "src/d.js", "secret = null"),
    (51, "D6", False, "src/d.js", "token = undefined"),
    (52, "D7", False, "src/d.css", ".password-field { color: #fff; }"),
    (53, "D7", False, "src/d.css", "#token {\n  border: 0;\n}"),
    (54, "D8", False, "src/d.py", "# password = \"o{h}\""),
    (55, "D8", False, "src/d.js", "// api_key = \"o{h}\""),
    (56, "D8", False, "src/d.js", "/* token = \"o{h}\" */"),
    (57, "D9", False, "src/d.py", "password = \"your-password-here\""),
    (58, "D9", False, "src/d.py", "api_key = \"REPLACE_ME\""),
    (59, "D9", False, "src/d.py", "secret = \"XXXXXXXXXXXXXXXX\""),
    (60, "D9", False, "src/d.py", "password = \"changeme\""),
    (61, "D9", False, "src/d.py", "token = \"todo-add-token-{n}\""),
    (62, "D9", False, "src/d.py", "password = \"aaaaaaaaaaaa\""),
    (63, "E1", False, "src/e.py", "api_key = os.getenv(\"API_KEY\", \"\")"),
    (64, "E1", False, "src/e.js", "const key = process.env.API_KEY_{n}"),
    (65, "E2", False, "src/e.py", "password = \"devpassword\""),
    (66, "E2", False, "src/e.py", "SECRET_KEY = \"django-insecure-{h}\""),
    (67, "E3", False, "src/e.py", "sha256 = \"{h}{h}\""),
    (68, "E3", False, "src/e.py", "content_hash = \"{h}\""),
    (69, "E4", False, "src/e.py", "greeting = \"SGVsbG8gV29ybGQh\""),
    (70, "E5", False, "src/e.py", "password = \"password\""),
    (71, "E5", False, "src/e.py", "password = \"admin\""),
    (72, "E5", False, "src/e.py", "password = \"root\""),
    (73, "E6", False, "src/e.py", "build = \"20240101-{h}\""),
    (74, "E7", False, "src/e.py", "print(\"token refreshed for {n}\")"),
    (75, "E7", False, "src/e.py", "logger.debug(\"password check {n}\")"),
)

# How marks are filled; the same text is valid in Spark SQL and DuckDB.
_DIGEST = "md5(concat('', {key}))"
_MARKS = (
    ("~", "''"),
    ("{h}", "h"),
    ("{H}", "upper(h)"),
    ("{x}", "substr(h, 1, 24)"),
    ("{U}", "upper(substr(h, 1, 16))"),
    ("{s}", "substr(h, 1, 8)"),
    ("{q}", "substr(h, 9, 4)"),
    ("{t}", "substr(h, 13, 12)"),
    ("{d}", "translate(substr(h, 3, 12), 'abcdef', '123456')"),
    ("{n}", "n"),
)


def filled(column: str) -> str:
    text = column
    for mark, value in _MARKS:
        text = f"replace({text}, '{mark}', {value})"
    return text


def keyed(keys: DataFrame, key: str, templates: str) -> DataFrame:
    """Every row of ``keys`` with every template of a constant array: a fixed
    fan-out inside the row, no join."""
    return spread(keys).select(
        F.col(key).cast("bigint").alias("k"),
        F.expr(f"concat('', {key})").alias("n"),
        F.expr(_DIGEST.format(key=key)).alias("h"),
        F.explode(F.expr(templates)).alias("t"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Planted documents are numbered above the supplied ones.
FIRST_PLANTED = 1_000_000_000_000


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, file_path, content, batch`` from the supplier table."""
    array = ", ".join(
        f"named_struct('no', {no}L, 'path', {quote(path)}, 'body', {quote(body)})"
        for no, path, body in FILES
    )
    rows = keyed(table(spark, sf_dir, "supplier"), "s_suppkey", f"array({array})")
    return rows.select(
        (F.lit(FIRST_PLANTED) + F.col("k") * 1000 + F.col("t.no")).alias("doc_id"),
        F.expr(filled("t.path")).alias("file_path"),
        F.expr(filled("t.body")).alias("content"),
        F.expr("concat('supplier-', n)").alias("batch"),
    )


def as_sources(documents: DataFrame) -> DataFrame:
    """The supplied documents as source files."""
    return documents.select(
        "doc_id",
        F.expr("concat('src/', source, '/', lang, '_', doc_id, '.py')").alias("file_path"),
        F.col("text").alias("content"),
        F.col("source").alias("batch"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied documents as source files, and the planted files."""
    documents = as_sources(spread(table(spark, sf_dir, "documents")))
    return documents.unionByName(planted_files(spark, sf_dir))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenario_id, category, is_secret, file_path, content``:
    every labelled scenario once per supplier."""
    array = ", ".join(
        f"named_struct('no', {no}L, 'category', {quote(cat)}, 'is_secret', {str(secret).lower()}, "
        f"'path', {quote(path)}, 'body', {quote(body)})"
        for no, cat, secret, path, body in SCENARIOS
    )
    rows = keyed(table(spark, sf_dir, "supplier"), "s_suppkey", f"array({array})")
    return rows.select(
        (F.col("k") * 1000 + F.col("t.no")).alias("scenario_id"),
        F.col("t.category").alias("category"),
        F.col("t.is_secret").alias("is_secret"),
        F.col("t.path").alias("file_path"),
        F.expr(filled("t.body")).alias("content"),
    )


# Patches by event type: (parent number, old path, new path, hunks).
PATCHES: dict[str, tuple[tuple[int, str | None, str | None, str], ...]] = {
    "click": ((1, "src/u{n}/config.py", "src/u{n}/config.py", """@@ -1,3 +1,4 @@
 import os
+token = "{h}"
-old = "{h}"
 keep = 1
@@ -10,2 +12,5 @@ def f():
 def f():
+    password = "P{h}"
+    url = "https://api.example.net/v1"
-    password = "old{h}"
+
+    api_key = getKey_{n}()
\\ No newline at end of file
"""),),
    "signup": ((0, None, "src/u{n}/keys.env", """+before = "any hunk"
 context
+AK~IA{U} before
@@ -0,0 +1 @@
+AWS AK~IA{U}
+++x token = "{h}"
++y token = "{x}{s}"
+secret = {h}
"""),),
    "view": ((1, "/srv/tests/u{n}.py", "/srv/tests/u{n}.py", """@@ -5 +5,2 @@
 def test():
+    token = "{h}"
"""), (1, "src/u{n}/view.js", "", """@@ -1,2 +1,3 @@
+gh~p_{h}{q}
 function a() {
+  return "sk~_live_{h}";
"""),),
    "error": ((1, "src/u{n}/merge.py", "src/u{n}/merge.py", """@@ -7,3 +7,4 @@
 a = 1
+token = "{H}"
@@ broken header +9 @@
+pwd = "{h}"
"""), (2, "src/u{n}/merge.py", "src/u{n}/merge.py", """@@ -1 +1,2 @@
+token = "second{h}"
"""),),
    "purchase": ((1, "node_modules/u{n}.js", "node_modules/u{n}.js", """@@ -1 +1 @@
+token = "{h}"
"""), (1, "src/u{n}/logo.PNG", "src/u{n}/logo.PNG", """@@ -1 +1 @@
+token = "{h}"
"""), (1, "src/u{n}/gone.py", "src/u{n}/gone.py", """@@ -1,2 +0,0 @@
-token = "{h}"
-x = 1
"""), (1, "src/u{n}/config.py", "src/u{n}/config.py", """@@ -20,2 +20,3 @@

+token = "{h}"
"""),),
}


#: Parents by event: of eight commits the fourth and fifth are a branch off the third, which the sixth
#: merges; every fifth branch is left unmerged.
PARENT_NUMBERS = (
    ("event_id = 0", ()), ("event_id % 8 = 5 AND event_id // 8 % 5 = 0", (3,)),
    ("event_id % 8 = 5", (3, 1)), ("true", (1,)),
)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event, in event order, at the event's time."""
    sha = "concat(md5(concat('commit-', {0})), substr(md5(concat('', {0})), 1, 8))"
    parents = " ".join(
        f"WHEN {test.replace('//', 'div')} THEN CAST(array({', '.join(sha.format(f'event_id - {back}') for back in backs)}) AS array<string>)"
        for test, backs in PARENT_NUMBERS
    )
    return table(spark, sf_dir, "events").selectExpr(
        "concat(md5(concat('commit-', event_id)), substr(md5(concat('', event_id)), 1, 8)) AS sha",
        "event_id AS seq",
        "concat(event_type, ' change ', event_id, chr(10), chr(10), 'details') AS message",
        "concat('dev', user_id) AS author_name",
        "concat('dev', user_id, '@example.org') AS author_email",
        "CAST(ts AS timestamp) AS committed_at",
        f"CASE {parents} END AS parents",
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sha, parent_no, a_path, b_path, patch`` of those commits."""

    def text(value: str | None) -> str:
        return "CAST(null AS string)" if value is None else quote(value)

    whens = " ".join(
        f"WHEN '{kind}' THEN array({', '.join(rows)})"
        for kind, rows in (
            (kind, [
                f"named_struct('parent_no', {p}, 'a', {text(a)}, 'b', {text(b)}, 'body', {text(body)})"
                for p, a, b, body in items
            ])
            for kind, items in PATCHES.items()
        )
    )
    rows = spread(table(spark, sf_dir, "events")).select(
        F.expr("concat(md5(concat('commit-', event_id)), substr(md5(concat('', event_id)), 1, 8))").alias("sha"),
        F.expr("concat('', user_id)").alias("n"),
        F.expr(_DIGEST.format(key="user_id")).alias("h"),
        F.explode(F.expr(f"CASE event_type {whens} END")).alias("t"),
    )
    return rows.select(
        "sha", F.col("t.parent_no").alias("parent_no"),
        F.expr(filled("t.a")).alias("a_path"),
        F.expr(filled("t.b")).alias("b_path"),
        F.expr(filled("t.body")).alias("patch"),
    )
