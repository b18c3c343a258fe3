"""DuckDB equivalents of the registered queries.

Written against the semantics, not the Spark plans: lines and blocks by window
functions over exploded rows, entropy by DuckDB's aggregate, path and line
rules in their unabridged form, patches by running counters. They share only
the corpus templates and the fixed values.
"""

from __future__ import annotations

from credscan.functions import entropy as E
from credscan.functions import groups as G
from credscan.functions import signals as SG
from credscan.functions import suppress as P
from credscan.functions.text import LINE_BREAK, WORD, WS, WS_CHARS
from credscan.operators import legacy as L
from credscan.operators.evaluate import BASELINES
from credscan.operators.risk import CONFIGURATIONS
from credscan.plans.corpus import FILES, FIRST_PLANTED, PARENT_NUMBERS, PATCHES, SCENARIOS, _DIGEST, filled
from credscan.plans.queries import ADDED_RULES, FLAG_COLUMNS, HISTORY, LEFT_OUT, MATCH
from credscan.rules import RULES, Rule
from credscan.sources import paths


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """RE2 has linear time and no possessive quantifiers."""
    for flags in ("(?iud)", "(?iu)", "(?d)"):
        pattern = pattern.replace(flags, "")
    return pattern.replace("*+", "*").replace("++", "+")


def like(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({column}, {q(('(?i)' if ignore_case else '') + re2(pattern))})"


def strip(column: str) -> str:
    return f"trim({column}, {q(WS_CHARS)})"


def starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {q(p)})" for p in prefixes) + ")"


def has(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(n)})" for n in needles) + ")"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def build(select: str, *needs: str) -> str:
    """A statement with just the common table expressions it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTE[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = ", ".join(f"{n} AS ({CTE[n][1]})" for n in order)
    return f"WITH {parts} {select}" if parts else select


# --- corpus -----------------------------------------------------------------

_keyed = "SELECT s_suppkey AS k, concat('', s_suppkey) AS n, " + _DIGEST.format(key="s_suppkey") + " AS h FROM supplier"
cte("keyed", _keyed)
_files = ", ".join(f"({no}, {q(p)}, {q(b)})" for no, p, b in FILES)
cte("planted", f"""SELECT {FIRST_PLANTED} + k * 1000 + no AS doc_id, {filled('path')} AS file_path,
    {filled('body')} AS content, concat('supplier-', n) AS batch
    FROM keyed CROSS JOIN (VALUES {_files}) AS t(no, path, body)""", "keyed")
cte("files", """SELECT doc_id, concat('src/', source, '/', lang, '_', doc_id, '.py') AS file_path,
    text AS content, source AS batch FROM documents
    UNION ALL SELECT * FROM planted""", "planted")
_scen = ", ".join(f"({a}, {q(b)}, {str(c).lower()}, {q(d)}, {q(e)})" for a, b, c, d, e in SCENARIOS)
cte("scenario", f"""SELECT k * 1000 + no AS doc_id, category, is_secret, path AS file_path,
    {filled('body')} AS content
    FROM keyed CROSS JOIN (VALUES {_scen}) AS t(no, category, is_secret, path, body)""", "keyed")
_patch = ", ".join(f"({q(kind)}, {p}, {q(a)}, {q(b)}, {q(body)})" for kind, rows in PATCHES.items() for p, a, b, body in rows)
_sha = "concat(md5(concat('commit-', event_id)), substr(md5(concat('', event_id)), 1, 8))"
cte("log", f"""SELECT {_sha} AS sha, event_id AS seq, concat(event_type, ' change ', event_id) AS message,
    concat('dev', user_id) AS author_name, concat('dev', user_id, '@example.org') AS author_email,
    ts AS committed_at FROM events""")
cte("patch_keys", f"""SELECT {_sha} AS sha, concat('', user_id) AS n, {_DIGEST.format(key='user_id')} AS h,
    parent_no, a, b, body FROM events JOIN (VALUES {_patch}) AS t(kind, parent_no, a, b, body) ON event_type = kind""")
cte("patch", f"""SELECT sha, parent_no, {filled('a')} AS a_path, {filled('b')} AS b_path,
    {filled('body')} AS patch FROM patch_keys""", "patch_keys")

# --- lines, matches ---------------------------------------------------------

_LINES = """SELECT doc_id, file_path, unnest(l) AS line, generate_subscripts(l, 1)::INTEGER AS line_no FROM (
    SELECT doc_id, file_path, CASE WHEN p[len(p)] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END AS l
    FROM (SELECT doc_id, file_path, regexp_split_to_array(content, {lb}) AS p FROM {source}))"""


def matches_sql(lines: str, rules=RULES) -> str:
    return " UNION ALL ".join(
        f"""SELECT doc_id, file_path, line_no, line, {i} AS rule_ord, {q(r.rule_id)} AS rule_id, {r.tier} AS tier,
        {float({1: 1.0, 2: 0.7, 3: 0.4}[r.tier])}::DOUBLE AS regex_score,
        unnest(f) AS secret, (generate_subscripts(f, 1) - 1)::INTEGER AS match_ord FROM (
        SELECT *, list_filter(regexp_extract_all(line, {q('(?i)' + r.pattern)}), lambda s: length(s) >= {r.min_length}) AS f
        FROM {lines}) WHERE len(f) > 0"""
        for i, r in enumerate(rules)
    )


cte("lines", _LINES.format(lb=q(LINE_BREAK), source="files"), "files")
cte("hits", matches_sql("lines"), "lines")
cte("scenario_lines", _LINES.format(lb=q(LINE_BREAK), source="scenario"), "scenario")
cte("scenario_hits", matches_sql("scenario_lines"), "scenario_lines")


# --- entropy ----------------------------------------------------------------

def bits(s: str) -> str:
    return f"CASE WHEN length({s}) > 1 THEN list_aggregate(string_split({s}, ''), 'entropy') ELSE 0 END"


def pair_bits(s: str) -> str:
    return (
        f"CASE WHEN length({s}) > 1 THEN list_aggregate(list_transform(list_zip(string_split({s}, '')[:-2], "
        f"string_split({s}, '')[2:]), lambda z: concat(z[1], z[2])), 'entropy') ELSE 0 END"
    )


def r3(x: str) -> str:
    return f"CAST(round_even(round({x}, 9), 3) AS DOUBLE)"


_known = like("secret", E.KNOWN_PLACEHOLDER, True)


def entropy_cte(hits: str) -> str:
    return f"""SELECT * EXCLUDE (te, ph), CASE WHEN ok THEN {r3('sh')} ELSE 0 END AS shannon,
    CASE WHEN ok THEN {r3('te')} ELSE 0 END AS transition, ok AND ph AS is_placeholder,
    CASE WHEN NOT ok THEN 0 WHEN ph THEN {r3('least(greatest(te / 4, 0), 1) * 0.1')}
    ELSE {r3('least(greatest(te / 4, 0), 1)')} END AS entropy_score
    FROM (SELECT *, te < 2.2 OR {_known} AS ph FROM (
      SELECT *, length(secret) >= 8 AS ok, {bits('secret')} AS sh, {pair_bits('secret')} AS te FROM {hits}))"""


cte("l2", entropy_cte("hits"), "hits")

# --- blocks and groups ------------------------------------------------------

_trim = strip("line")


def group_cte(lines: str, hits: str) -> str:
    return f"""SELECT doc_id, line_no, first_line, last_line, context, list_filter(both_, lambda x, i: list_position(both_, x) = i) AS grp
    FROM (SELECT *, list_concat(
      list_filter(list_transform(regexp_extract_all(context, {q(re2(G.STRING_LITERAL))}),
        lambda s: substr(s, 2, length(s) - 2)), lambda s: length(s) >= 3),
      regexp_extract_all(context, {q(G.URL)})) AS both_
    FROM (SELECT m.doc_id, m.line_no, first_line, last_line,
      array_to_string(list_slice(a.ls, first_line, last_line), chr(10)) AS context
    FROM (SELECT *, coalesce(greatest(s, b + 1), line_no) AS first_line,
      coalesce(e - 1, n) AS last_line FROM (
      SELECT doc_id, line_no, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS n,
      max(CASE WHEN {starts(_trim, G.BLOCK_OPENERS)} THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s,
      max(CASE WHEN {_trim} = '' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS b,
      min(CASE WHEN {starts(_trim, G.BLOCK_ENDERS)} THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e
      FROM {lines})) m
    JOIN (SELECT DISTINCT doc_id, line_no FROM {hits}) h USING (doc_id, line_no)
    JOIN (SELECT doc_id, list(line ORDER BY line_no) AS ls FROM {lines} GROUP BY doc_id) a ON a.doc_id = m.doc_id))"""


def signals(text: str) -> str:
    terms = " + ".join(
        f"CASE WHEN contains(lower({text}), {q(s)}) THEN {w} ELSE 0 END"
        for s, w in SG.POSITIVE_SIGNALS + SG.NEGATIVE_SIGNALS
    )
    return f"(least(greatest(50 + {terms}, 0), 100) / 100.0)::DOUBLE"


def l3_cte(groups: str) -> str:
    return f"""SELECT doc_id, line_no, len(grp)::INTEGER AS string_group_size,
    CASE WHEN len(grp) = 0 THEN 0 ELSE p END AS probability,
    CASE WHEN len(grp) > 0 AND p >= 0.55 THEN 'secret' ELSE 'not_secret' END AS classification,
    CASE WHEN len(grp) = 0 THEN 'none' ELSE 'heuristic_fallback' END AS model_used
    FROM (SELECT *, {signals("array_to_string(grp, ' ')")} AS p FROM {groups})"""


cte("groups", group_cte("lines", "hits"), "lines", "hits")
cte("l3", l3_cte("groups"), "groups")

# --- false-positive rules, as first stated (fixed values) --------------------

_KW = "password|secret|key|token|pwd|auth|pass|credential"
_S = f"[{WS}]"
_F1 = rf"(password|secret|key|token|pwd|auth){_S}*={_S}*[{WORD}]+[.{WORD}]*\([^)]*\)"
_F2 = (
    rf"({_KW}){_S}*={_S}*([a-zA-Z_][{WORD}]*\.[{WORD}]+){_S}*$",
    rf"({_KW}){_S}*={_S}*([a-zA-Z_][{WORD}]*[\.\[])",
    rf"({_KW}){_S}*={_S}*(os\.|config\.|settings\.|env\.|process\.)",
)
_F6 = rf"([{WORD}]*(?:password|secret|key|token|pwd|auth|pass|credential)[{WORD}]*){_S}*={_S}*(.+)$"
_NULLS = (r"^null$", r"^none$", r"^undefined$", r"^nil$", '^""$', "^''$", "^$")
_Q, _QP = """["']([^"']*)["']""", """["']([^"']+)["']"""


def either(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN {a} ELSE {b} END"


def extract(column: str, pattern: str) -> str:
    return f"regexp_extract_all({column}, {q(pattern)}, 1)"


def bare(column: str) -> str:
    return f"trim({strip(column)}, {q(chr(39) + chr(34))})"


_weak_words = ", ".join(q(w) for w in P.WEAK_PASSWORDS)


def flags_cte(l2: str) -> str:
    ph = like("v", E.KNOWN_PLACEHOLDER, True)
    digits = like(strip("v"), r"^\p{Nd}+$")
    low = f"lower({strip('v')})"
    rhs = f"ltrim(regexp_extract({_trim}, {q(f'={_S}*(.+)$')}, 1), {q(WS_CHARS)})"
    null_rhs = f"trim(regexp_extract({_trim}, {q('(?i)' + _F6)}, 2), {q(WS_CHARS)})"
    verdict = (
        f"list_filter(list_transform({either(extract('secret', _QP), extract('line', _QP))}, lambda v: "
        f"CASE WHEN length(v) >= 8 AND len(list_distinct(string_split(v, ''))) <= 2 THEN 1 WHEN {ph} THEN 2 END), "
        "lambda c: c IS NOT NULL)[1]"
    )
    quoted = either(extract("secret", _Q), extract("line", _Q))
    columns = (
        like("line", _F1, True),
        "(" + " OR ".join(like(_trim, p, True) for p in _F2) + f") AND NOT {starts(rhs, (chr(34), chr(39), 'f' + chr(34), 'f' + chr(39)))}",
        "(" + " OR ".join(like("file_path", p) for p in P.TEST_PATHS) + ")",
        "(" + " OR ".join(like("file_path", p, True) for p in P.DOC_PATHS) + ")",
        f"len(list_filter(CASE WHEN len({quoted}) > 0 THEN {quoted} ELSE [{bare('secret')}] END, lambda v: {digits})) > 0",
        like(_trim, _F6, True) + " AND (" + " OR ".join(like(null_rhs, p, True) for p in _NULLS) + ")",
        "(" + " OR ".join(like("line", p) for p in P.CSS_SHAPES) + ")",
        starts(_trim, P.COMMENT_MARKS),
        "(" + " OR ".join(like(bare("secret"), p, True) for p in P.PLACEHOLDER_SHAPES) + ")",
        f"length({bare('secret')}) >= 12 AND transition < 2.2",
        f"{strip('secret')} IN ('\"\"', '''''', '')",
        f"coalesce({verdict} = 1, false)",
        f"coalesce({verdict} = 2, false)",
        "NOT (" + " OR ".join(like("line", p, True) for p in P.CLOUD_WORDS) + ") AND length(secret) < 30",
        f"len(list_filter({quoted}, lambda v: {low} IN ({_weak_words}) OR {starts(low, P.WEAK_PREFIXES)})) > 0",
    )
    return f"SELECT *, {', '.join(f'({c}) AS {n}' for n, c in zip(FLAG_COLUMNS, columns, strict=True))} FROM {l2}"


_NAMED = (
    P.FUNCTION_CALL, P.VARIABLE_ASSIGNMENT, P.TEST_DIRECTORY, P.README_FILE, P.NUMERIC_ONLY, P.NULL_VALUE,
    P.CSS_SELECTOR, P.COMMENTED_OUT, P.PLACEHOLDER, P.LOW_TRANSITION, P.EMPTY_STRING, P.REPEATED_VALUE,
    P.PLACEHOLDER_VALUE, P.NO_CLOUD_API, P.WEAK_PASSWORD,
)


def penalty(skip: str = "") -> str:
    terms = " + ".join(
        f"CASE WHEN {c} THEN {p} ELSE 0.00 END"
        for c, (_, p) in zip(FLAG_COLUMNS, _NAMED, strict=True) if c != skip
    )
    return f"CAST(least(CAST({terms} AS DECIMAL(6,2)), 1.00) AS DECIMAL(3,2))"


def l4_cte(flags: str) -> str:
    names = ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for c, (n, _) in zip(FLAG_COLUMNS, _NAMED, strict=True))
    return f"""SELECT *, {penalty()} AS penalty, {penalty('low_transition')} AS penalty_off,
    array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS rules_fired FROM {flags}"""


cte("flags", flags_cte("l2"), "l2")
cte("l4", l4_cte("flags"), "flags")


def score(layers) -> str:
    entropy = "CAST(entropy_score AS DECIMAL(4,3))" if layers.l2 else "0.500"
    p = "CAST(probability AS DECIMAL(4,3))" if layers.l3 else "0.500"
    adjusted = f"CASE tier WHEN 1 THEN least({p} * 1.10, 1.00) WHEN 3 THEN {p} * 0.70 ELSE {p} * 1.00 END"
    total = "0.00" if not layers.l4 else "penalty" if layers.l2 else "penalty_off"
    base = (
        f"CAST(CAST(regex_score AS DECIMAL(3,2)) * 0.30 + {entropy} * 0.20 + "
        f"CAST({adjusted} AS DECIMAL(7,5)) * 0.35 AS DECIMAL(10,8))"
    )
    return (
        f"CAST(round(CASE WHEN {total} >= 0.80 THEN CAST({base} * (1.00 - {total}) AS DECIMAL(14,10)) "
        f"ELSE CAST({base} + (1.00 - {total}) * 0.15 AS DECIMAL(14,10)) END, 3) AS DOUBLE)"
    )


_full = CONFIGURATIONS[-1][1]
_severity = "CASE WHEN {0} >= 0.7 THEN 'critical' WHEN {0} >= 0.5 THEN 'high' WHEN {0} >= 0.3 THEN 'medium' ELSE 'low' END"


def findings_cte(l4: str, l3: str) -> str:
    return f"""SELECT *, {_severity.format('combined_score')} AS severity FROM (
    SELECT *, {score(_full)} AS combined_score FROM {l4} JOIN {l3} USING (doc_id, line_no))"""


cte("findings", findings_cte("l4", "l3"), "l4", "l3")

CONTEXT_SIMILARITY = """WITH ctx AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v
    FROM embeddings WHERE label < 9 GROUP BY label),
    sims AS (SELECT vec_id, max(CASE WHEN ctx.label < 6 THEN list_cosine_similarity(embedding::DOUBLE[], v) END) AS p,
    max(CASE WHEN ctx.label >= 6 THEN list_cosine_similarity(embedding::DOUBLE[], v) END) AS n
    FROM embeddings CROSS JOIN ctx GROUP BY vec_id)
    SELECT vec_id, """ + r3("least(greatest(p / (p + n + 1e-8), 0), 1)") + " AS probability FROM sims"

ORACLES: dict[str, str] = {}
M = ", ".join(MATCH)

# --- sources ----------------------------------------------------------------

ORACLES["scan_sources"] = build(
    "SELECT doc_id, file_path, length(content)::BIGINT AS n_chars, md5(content) AS digest FROM files", "files")
_ext = f"lower(regexp_extract(file_path, {q(r'[^/](\.[^./]+)$')}, 1))"
ORACLES["skip_paths"] = build(
    f"""SELECT file_path, {_ext} IN ({', '.join(q(x) for x in paths.FILE_EXTENSIONS)}) AS is_binary,
    {_ext} IN ({', '.join(q(x) for x in paths.HISTORY_EXTENSIONS)}) OR {like('file_path', paths.HISTORY_SKIP, True)} AS skipped_in_history,
    {like('lower(file_path)', paths.ENTROPY_SKIP)} AS skipped_by_entropy
    FROM (SELECT file_path FROM files UNION ALL SELECT url FROM pages)""", "files")
ORACLES["explode_lines"] = build("SELECT doc_id, line_no::BIGINT AS line_no, md5(line) AS digest FROM lines", "lines")
_rules = ", ".join(
    f"({q(r.rule_id)}, {q(r.description)}, {q(r.severity)}, {q(','.join(r.tags))}, {r.tier}::BIGINT, "
    f"{ {1: 1.0, 2: 0.7, 3: 0.4}[r.tier] }::DOUBLE, {r.min_length}::BIGINT)" for r in RULES)
ORACLES["rule_catalogue"] = build(
    f"""SELECT t.*, coalesce(n, 0)::BIGINT AS n_matches
    FROM (VALUES {_rules}) AS t(rule_id, description, severity, tags, tier, tier_weight, min_length)
    LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id) c USING (rule_id)""", "hits")
ORACLES["regex_matches"] = build(f"SELECT {M}, secret FROM hits", "hits")
ORACLES["tiered_matches"] = build(f"SELECT {M}, tier, regex_score FROM hits", "hits")
ORACLES["matches_by_rule"] = build(
    """SELECT rule_id, count(*)::BIGINT AS n_matches, count(DISTINCT (doc_id, line_no))::BIGINT AS n_lines,
    count(DISTINCT doc_id)::BIGINT AS n_docs FROM hits GROUP BY rule_id""", "hits")

# --- legacy detector --------------------------------------------------------

_RUN = L.RUN
_rules_or = " OR ".join(like("secret", r.pattern, True) for r in RULES)
_near = "substr(lower(line), greatest(at_ - 50, 0) + 1, least(length(line), at_ + length(secret) + 50) - greatest(at_ - 50, 0))"
cte("entropy_hits", f"""SELECT doc_id, line_no, rule_id, match_ord, secret, description, severity, shown FROM (
    SELECT *, 'high-entropy-generic' AS rule_id,
    concat('High entropy string (score: ', CAST(CAST(round(b, 2) AS DECIMAL(6,2)) AS VARCHAR), ') ', '— possible secret') AS description,
    CASE WHEN b < 4.2 THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN length({_trim}) > 180 THEN concat(substr({_trim}, 1, 180), '...') ELSE {_trim} END AS shown
    FROM (SELECT *, {bits('secret')} AS b, {_near} AS near_ FROM (
      SELECT *, instr(line, secret) - 1 AS at_ FROM (
        SELECT doc_id, file_path, line_no, line, unnest(f) AS secret, (generate_subscripts(f, 1) - 1)::INTEGER AS match_ord FROM (
          SELECT *, list_filter(regexp_extract_all(line, {q(_RUN)}), lambda r: len(list_distinct(string_split(r, ''))) > 4) AS f
          FROM lines WHERE NOT {starts(_trim, L.COMMENT_MARKS)} AND NOT {like('line', L.DATA_URI)}
          AND NOT {like('lower(file_path)', paths.ENTROPY_SKIP)}) WHERE len(f) > 0)
      WHERE NOT ({_rules_or})))
    WHERE {has('near_', L.CONTEXT_WORDS)} AND NOT {has('near_', L.NEGATIVE_WORDS)} AND b >= 3.9)""", "lines")
_sev = " ".join(f"WHEN {q(r.rule_id)} THEN {q(r.severity)}" for r in RULES)
_desc = " ".join(f"WHEN {q(r.rule_id)} THEN {q(r.description)}" for r in RULES)
_text_file = f"{_ext} NOT IN ({', '.join(q(x) for x in paths.FILE_EXTENSIONS)})"
ORACLES["legacy_scan"] = build(
    f"""SELECT {M}, secret, CASE rule_id {_sev} END AS severity, CASE rule_id {_desc} END AS description,
    md5({_trim}) AS line_digest FROM hits
    WHERE NOT {starts(f"ltrim(lower(line), {q(WS_CHARS)})", L.NEGATIVE_WORDS)} AND {_text_file}
    UNION ALL SELECT {M}, secret, severity, description, md5(shown) FROM entropy_hits
    JOIN (SELECT doc_id, file_path FROM files) USING (doc_id) WHERE {_text_file}""", "hits", "entropy_hits", "files")
ORACLES["high_entropy_strings"] = build(
    "SELECT doc_id, line_no, match_ord, secret, severity, description FROM entropy_hits", "entropy_hits")

# --- entropy ----------------------------------------------------------------

ORACLES["shannon_entropy"] = f"SELECT doc_id, {r3(bits('text'))} AS shannon FROM documents"
ORACLES["transition_entropy"] = f"SELECT doc_id, {r3(pair_bits('text'))} AS transition FROM documents"
_literals = (
    f"list_filter(list_transform(regexp_extract_all(content, {q(re2(G.STRING_LITERAL))}), "
    "lambda s: substr(s, 2, length(s) - 2)), lambda s: length(s) >= 3)"
)
ORACLES["placeholder_strings"] = build(
    f"SELECT doc_id, secret AS s, {_known} AS is_placeholder FROM (SELECT doc_id, unnest({_literals}) AS secret FROM files)", "files")
ORACLES["charset_flags"] = build(
    f"""SELECT doc_id, len(w)::BIGINT AS n_words,
    len(list_filter(w, lambda x: length(x) >= 20 AND list_aggregate(string_split(x, ''), 'entropy') >= 3.9))::BIGINT AS n_high_entropy,
    len(list_filter(w, lambda x: {like('x', '^[A-Za-z0-9+/=]{20,}$')}))::BIGINT AS n_base64,
    len(list_filter(w, lambda x: {like('x', '^[0-9a-fA-F]{32,}$')}))::BIGINT AS n_hex
    FROM (SELECT doc_id, regexp_split_to_array(content, '[ \n]+') AS w FROM files)""", "files")
ORACLES["entropy_scores"] = build(f"SELECT {M}, shannon, transition, is_placeholder, entropy_score FROM l2", "l2")

# --- groups, classifiers ----------------------------------------------------

ORACLES["string_literals"] = build(
    f"SELECT doc_id, len(f)::BIGINT AS n, md5(array_to_string(f, chr(10))) AS digest FROM (SELECT doc_id, {_literals} AS f FROM files)", "files")
ORACLES["urls"] = (
    f"SELECT page_id, len(f)::BIGINT AS n, md5(array_to_string(f, chr(10))) AS digest "
    f"FROM (SELECT page_id, regexp_extract_all(html, {q(G.URL)}) AS f FROM pages)")
ORACLES["block_context"] = build(
    "SELECT doc_id, line_no, first_line, last_line, md5(context) AS digest FROM groups", "groups")
ORACLES["string_groups"] = build(
    "SELECT doc_id, line_no, len(grp)::INTEGER AS n, md5(array_to_string(grp, chr(10))) AS digest FROM groups", "groups")
ORACLES["signal_classifier"] = build(f"SELECT doc_id, {signals('content')} AS probability FROM files", "files")
ORACLES["classified_groups"] = build(
    "SELECT doc_id, line_no, probability, classification, model_used, string_group_size FROM l3", "l3")
ORACLES["context_similarity"] = CONTEXT_SIMILARITY
ORACLES["stratified_folds"] = """SELECT doc_id, quality AS label,
    ((row_number() OVER (PARTITION BY quality ORDER BY md5(concat('', doc_id)), doc_id) - 1) % 5)::INTEGER AS fold FROM labels"""
ORACLES["class_balance"] = "SELECT quality AS label, count(*)::BIGINT AS n FROM labels GROUP BY quality"

# --- suppression, scores ----------------------------------------------------

ORACLES["fp_flags"] = build(f"SELECT {M}, {', '.join(FLAG_COLUMNS)} FROM flags", "flags")
ORACLES["suppressed_findings"] = build(
    f"""SELECT {M}, rules_fired, penalty::DOUBLE AS total_penalty, penalty >= 0.80 AS suppressed,
    (1.00 - penalty)::DOUBLE AS suppressor_score FROM l4 WHERE penalty >= 0.80""", "l4")


def _fired(column: str, rule: tuple[str, str]) -> str:
    name, amount = rule
    bits = " || ' (' || CAST(CAST(transition AS DECIMAL(6,3)) AS VARCHAR) || ' bits)'" if rule == P.LOW_TRANSITION else ""
    reason = q(f"-{amount}: {P.REASONS[rule]}") + bits
    return f"CASE WHEN {column} THEN struct_pack(rule := {q(name)}, penalty := {amount}::DOUBLE, reason := {reason}) END"


_every = ", ".join(_fired(c, r) for c, r in zip(FLAG_COLUMNS, _NAMED, strict=True))
ORACLES["suppression_reasons"] = build(
    f"""SELECT {M}, (i - 1)::INTEGER AS position, fired[i].rule AS rule, fired[i].penalty AS penalty, fired[i].reason AS reason
    FROM (SELECT {M}, fired, unnest(range(1, len(fired) + 1)) AS i
        FROM (SELECT {M}, list_filter([{_every}], lambda x: x IS NOT NULL) AS fired FROM flags))""", "flags")
ORACLES["combined_scores"] = build(
    f"""SELECT {M}, regex_score, entropy_score, probability AS classifier_score,
    (1.00 - penalty)::DOUBLE AS suppressor_score, combined_score FROM findings""", "findings")
ORACLES["severity_counts"] = build("SELECT severity, count(*)::BIGINT AS n FROM findings GROUP BY severity", "findings")


def _txt(x: str, n: int) -> str:
    return f"CAST(CAST(round({x}, {n}) AS DECIMAL(6,{n})) AS VARCHAR)"


def _term(label: str, x: str, w: str) -> str:
    d = f"CAST({x} AS DECIMAL(4,3))"
    return f"concat({label}, ' (', {_txt(d, 2)}, ' x {w} = ', {_txt(f'{d} * {w}', 3)}, ')')"


ORACLES["explanations"] = build(
    f"""SELECT {M}, concat({_term("concat('Tier ', tier, ' regex match')", 'regex_score', '0.30')}, '; ',
    {_term("'Entropy score'", 'entropy_score', '0.20')}, CASE WHEN is_placeholder THEN ' [PLACEHOLDER detected]' ELSE '' END, '; ',
    {_term("'Classifier probability'", 'probability', '0.35')}, '; Suppressor score (', {_txt('1.00 - penalty', 2)}, ', mode=',
    CASE WHEN penalty >= 0.80 THEN 'MULTIPLICATIVE GATE' ELSE 'additive' END, ')',
    CASE WHEN rules_fired != '' THEN concat(' [Rules: ', replace(rules_fired, ',', ', '), ']') ELSE '' END) AS explanation
    FROM findings""", "findings")
ORACLES["reported_findings"] = build(
    f"SELECT file_path, {M}, secret, combined_score, severity FROM findings WHERE combined_score >= 0.3", "findings")
ORACLES["top_findings"] = build(
    f"""SELECT batch, {M}, combined_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY batch
    ORDER BY combined_score DESC, doc_id, line_no, rule_ord, match_ord)::INTEGER AS rank
    FROM findings JOIN (SELECT doc_id, batch FROM files) USING (doc_id)) WHERE rank <= 3""", "findings", "files")
ORACLES["ablation_scores"] = build(" UNION ALL ".join(
    f"SELECT {M}, {q(name)} AS config, {score(layers)} AS score FROM findings" for name, layers in CONFIGURATIONS), "findings")
ORACLES["scan_documents"] = build(
    f"""SELECT file_path, {M}, secret, tier, regex_score, shannon, transition, is_placeholder, entropy_score,
    probability AS classifier_score, classification, string_group_size, rules_fired,
    penalty::DOUBLE AS total_penalty, penalty >= 0.80 AS suppressed, (1.00 - penalty)::DOUBLE AS suppressor_score,
    combined_score, severity, md5({_trim}) AS line_digest FROM findings""", "findings")
_SCANNED = f"""SELECT file_path, {M}, secret, tier, regex_score, probability AS classifier_score, classification, model_used,
    string_group_size, penalty::DOUBLE AS total_penalty, combined_score, severity FROM """
_custom = tuple(r for r in RULES if r.rule_id not in LEFT_OUT) + tuple(
    Rule(name, name, regex, (), severity or "medium", tier or 3, (), least or 8) for name, regex, severity, least, tier in ADDED_RULES)
cte("c_hits", matches_sql("lines", _custom), "lines")
cte("c_l2", entropy_cte("c_hits"), "c_hits")
cte("c_flags", flags_cte("c_l2"), "c_l2")
cte("c_l4", l4_cte("c_flags"), "c_flags")
cte("c_groups", group_cte("lines", "c_hits"), "lines", "c_hits")
cte("c_l3", l3_cte("c_groups"), "c_groups")
cte("c_findings", findings_cte("c_l4", "c_l3"), "c_l4", "c_l3")
ORACLES["custom_rules"] = build(f"{_SCANNED} c_findings", "c_findings")
cte("by_vector", CONTEXT_SIMILARITY)
cte("v_l3", f"""SELECT doc_id, line_no, string_group_size, CASE WHEN n = 0 THEN 0 ELSE p END AS probability,
    CASE WHEN n > 0 AND p >= 0.55 THEN 'secret' ELSE 'not_secret' END AS classification,
    CASE WHEN n = 0 THEN 'none' WHEN s IS NULL THEN 'heuristic_fallback' ELSE 'similarity' END AS model_used
    FROM (SELECT doc_id, line_no, string_group_size, string_group_size AS n, by_vector.probability AS s,
      coalesce(by_vector.probability, l3.probability) AS p
      FROM groups JOIN l3 USING (doc_id, line_no) LEFT JOIN by_vector
      ON vec_id = ('0x' || substr(md5(array_to_string(grp, ' ')), 1, 7))::BIGINT % (2 * (SELECT count(*) FROM embeddings)))""",
    "groups", "l3", "by_vector")
cte("v_findings", findings_cte("l4", "v_l3"), "l4", "v_l3")
ORACLES["similarity_scan"] = build(f"{_SCANNED} v_findings", "v_findings")
ORACLES["similarity_gate"] = build(
    """SELECT batch, count(*)::BIGINT AS n_files, sum(n)::BIGINT AS n_findings, max(top)::DOUBLE AS max_score, sum(n) > 0 AS blocked
    FROM (SELECT batch, files.doc_id, count(CASE WHEN combined_score >= 0.3 THEN 1 END) AS n, coalesce(max(combined_score), 0) AS top
      FROM files LEFT JOIN v_findings USING (doc_id) GROUP BY batch, files.doc_id) GROUP BY batch""", "files", "v_findings")
_words = r"len(regexp_extract_all(array_to_string(grp, ' '), '[^ \t\n\x0B\f\r]+'))"
ORACLES["model_scores"] = build(
    f"""SELECT {M}, string_group_size, CASE WHEN string_group_size = 0 THEN 'none' WHEN {_words} < 2 THEN 'heuristic_fallback'
    ELSE 'trained' END AS model_used, CASE WHEN string_group_size > 0 AND {_words} < 2 THEN probability END AS signal_score, true AS scored
    FROM hits JOIN l3 USING (doc_id, line_no) JOIN groups USING (doc_id, line_no)""", "hits", "l3", "groups")
ORACLES["findings_report"] = build(
    """SELECT severity, rule_id, count(*)::BIGINT AS n, max(combined_score) AS max_score FROM findings
    WHERE combined_score >= 0.3 GROUP BY severity, rule_id""", "findings")
cte("risk", f"""SELECT doc_id, file_path, batch, count(rule_id)::BIGINT AS n_matches,
    count(CASE WHEN combined_score >= 0.3 THEN 1 END)::BIGINT AS n_findings,
    coalesce(max(combined_score), 0)::DOUBLE AS max_score,
    CASE WHEN count(rule_id) = 0 THEN 'none' ELSE {_severity.format('max(combined_score)')} END AS worst_severity,
    arg_max(rule_id, combined_score * 100000 - rule_ord) AS top_rule
    FROM files LEFT JOIN (SELECT doc_id, rule_id, rule_ord, combined_score FROM findings) USING (doc_id)
    GROUP BY doc_id, file_path, batch""", "files", "findings")
ORACLES["document_risk"] = build(
    "SELECT doc_id, file_path, n_matches, n_findings, max_score, worst_severity, top_rule FROM risk", "risk")
ORACLES["change_gate"] = build(
    """SELECT batch, count(*)::BIGINT AS n_files, sum(n_findings)::BIGINT AS n_findings, max(max_score) AS max_score,
    sum(n_findings) > 0 AS blocked FROM risk GROUP BY batch""", "risk")
ORACLES["stream_scan"] = build(
    f"SELECT {M}, secret, combined_score, severity FROM findings", "findings")

# --- history ----------------------------------------------------------------


def added_cte(source: str) -> str:
    head = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"
    return f"""SELECT sha, file_path, row_number() OVER (PARTITION BY sha, file_path ORDER BY pos)::INTEGER AS block_pos,
    n::INTEGER AS new_line_no, substr(raw, 2) AS line FROM (
    SELECT *, coalesce(base, 0) + coalesce(sum(CASE WHEN hunk IS NOT NULL OR starts_with(raw, '-') OR starts_with(raw, '\\') THEN 0 ELSE 1 END)
      OVER (PARTITION BY sha, file_path, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM (
    SELECT *, last_value(hunk IGNORE NULLS) OVER (PARTITION BY sha, file_path ORDER BY pos) AS base,
      count(hunk) OVER (PARTITION BY sha, file_path ORDER BY pos) AS grp FROM (
    SELECT sha, file_path, raw, pos, CASE WHEN {like('raw', head)} THEN regexp_extract(raw, {q(head)}, 1)::BIGINT END AS hunk FROM (
      SELECT sha, file_path, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM (
        SELECT sha, file_path, regexp_split_to_array(patch, {q(LINE_BREAK)}) AS p FROM {source}))
      )))
    WHERE hunk IS NULL AND starts_with(raw, '+') AND NOT starts_with(raw, '+++')"""


cte("all_patches", "SELECT sha, concat(parent_no, ':', coalesce(b_path, a_path)) AS file_path, patch FROM patch", "patch")
ORACLES["patch_added_lines"] = build(added_cte("all_patches"), "all_patches")
_skip = f"{_ext} IN ({', '.join(q(x) for x in paths.HISTORY_EXTENSIONS)}) OR {like('file_path', paths.HISTORY_SKIP, True)}"
cte("scanned", f"""SELECT * FROM (SELECT sha, coalesce(nullif(b_path, ''), a_path, '') AS file_path, patch
    FROM patch WHERE parent_no <= 1) WHERE NOT ({_skip})""", "patch")
cte("added", added_cte("scanned"), "scanned")
cte("h_lines", "SELECT concat(sha, '|', file_path) AS doc_id, file_path, block_pos AS line_no, line FROM added", "added")
cte("h_hits", matches_sql("h_lines"), "h_lines")
cte("h_l2", entropy_cte("h_hits"), "h_hits")
cte("h_flags", flags_cte("h_l2"), "h_l2")
cte("h_l4", l4_cte("h_flags"), "h_flags")
cte("h_groups", group_cte("h_lines", "h_hits"), "h_lines", "h_hits")
cte("h_l3", l3_cte("h_groups"), "h_groups")
cte("h_findings", findings_cte("h_l4", "h_l3"), "h_l4", "h_l3")
cte("history", """SELECT sha, f.file_path, new_line_no AS line_approx, f.line_no, rule_ord, rule_id, match_ord, secret,
    combined_score, severity, seq, substr(sha, 1, 8) AS sha_short, message, author_name, author_email, committed_at
    FROM (SELECT *, split_part(doc_id, '|', 1) AS sha FROM h_findings WHERE combined_score >= 0.3) f
    JOIN (SELECT sha, file_path, block_pos, new_line_no FROM added) a USING (sha, file_path)
    JOIN log USING (sha) WHERE a.block_pos = f.line_no""", "h_findings", "added", "log")
H = ", ".join(HISTORY)
ORACLES["history_findings"] = build(
    f"""SELECT {H}, combined_score, sha_short, message, author_name, author_email,
    strftime(committed_at, '%Y-%m-%d') AS committed_on FROM history""", "history")
ORACLES["recent_commits"] = build(
    f"""SELECT {H}, combined_score, seq FROM history
    WHERE seq IN (SELECT seq FROM log ORDER BY committed_at DESC, seq DESC LIMIT 500)""", "history")
_parents = " UNION ALL ".join(
    f"SELECT event_id AS child, event_id - {back} AS parent FROM events WHERE {test}"
    + "".join(f" AND NOT ({earlier})" for earlier, _ in PARENT_NUMBERS[:i])
    for i, (test, backs) in enumerate(PARENT_NUMBERS) for back in backs
)
cte("parent", _parents)
for _name, _tip in (("before", "SELECT 11"), ("upto", "SELECT max(event_id) FROM events WHERE event_id % 8 < 3")):
    cte(_name, f"""WITH RECURSIVE r(e) AS ({_tip} UNION SELECT parent.parent FROM r JOIN parent ON child = e) SELECT e FROM r""", "parent")
ORACLES["range_findings"] = build(
    f"""SELECT {H}, combined_score, seq FROM history WHERE seq IN (SELECT e FROM upto) AND seq NOT IN (SELECT e FROM before)""",
    "history", "before", "upto")
cte("first_seen", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, secret
    ORDER BY seq, combined_score DESC, line_no, rule_ord, match_ord) AS rn FROM history) WHERE rn = 1""", "history")
ORACLES["first_exposures"] = build(f"SELECT {H}, combined_score, seq FROM first_seen", "first_seen")
ORACLES["findings_by_commit"] = build(
    """SELECT sha_short, strftime(min(committed_at), '%Y-%m-%d') AS committed_on, min(author_name) AS author_name,
    substr(min(message), 1, 60) AS message, count(*)::BIGINT AS n_findings, max(combined_score) AS max_score,
    count(CASE WHEN severity = 'critical' THEN 1 END)::BIGINT AS n_critical,
    count(CASE WHEN severity = 'high' THEN 1 END)::BIGINT AS n_high,
    count(CASE WHEN severity = 'medium' THEN 1 END)::BIGINT AS n_medium
    FROM first_seen GROUP BY sha, sha_short""", "first_seen")
ORACLES["stream_first_exposures"] = ORACLES["first_exposures"]
ORACLES["stream_daily_counts"] = build(
    """SELECT strftime(committed_at, '%Y-%m-%d') AS day, severity, count(*)::BIGINT AS n_findings,
    max(combined_score) AS max_score FROM history GROUP BY 1, 2""", "history")

# --- evaluation -------------------------------------------------------------

cte("s_l2", entropy_cte("scenario_hits"), "scenario_hits")
cte("s_flags", flags_cte("s_l2"), "s_l2")
cte("s_l4", l4_cte("s_flags"), "s_flags")
cte("s_groups", group_cte("scenario_lines", "scenario_hits"), "scenario_lines", "scenario_hits")
cte("s_examples", f"""SELECT DISTINCT md5(array_to_string(grp, ' ')) AS group_key, is_secret::INTEGER AS label, len(grp)::INTEGER AS group_size,
    {_words} AS n_tokens FROM s_groups JOIN scenario USING (doc_id) WHERE len(grp) > 0""", "s_groups", "scenario")
ORACLES["train_group_classifier"] = build(
    """SELECT group_key, label, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label))::DOUBLE AS weight, group_size, n_tokens,
    true AS scored FROM s_examples""", "s_examples")
cte("s_l3", l3_cte("s_groups"), "s_groups")
_each = " UNION ALL ".join(
    f"SELECT doc_id, {q(name)} AS config, {score(layers)} AS score FROM s_l4 JOIN s_l3 USING (doc_id, line_no)"
    for name, layers in CONFIGURATIONS)
_configs = ", ".join(f"({q(name)})" for name, _ in CONFIGURATIONS)
cte("judged", f"""SELECT *, score >= 0.3 AS detected, (score >= 0.3) = is_secret AS correct FROM (
    SELECT doc_id AS scenario_id, category, is_secret, config, coalesce(max(score), 0)::DOUBLE AS score
    FROM (SELECT doc_id, category, is_secret, config FROM scenario
      CROSS JOIN (VALUES {_configs}) AS c(config)) LEFT JOIN ({_each}) USING (doc_id, config)
    GROUP BY ALL)""", "scenario", "s_l4", "s_l3")
_conf = """count(CASE WHEN detected AND is_secret THEN 1 END)::BIGINT AS tp,
    count(CASE WHEN detected AND NOT is_secret THEN 1 END)::BIGINT AS fp,
    count(CASE WHEN NOT detected AND is_secret THEN 1 END)::BIGINT AS fn,
    count(CASE WHEN NOT detected AND NOT is_secret THEN 1 END)::BIGINT AS tn"""
_rates = """round(coalesce(tp / nullif(tp + fp, 0), 0), 3)::DOUBLE AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 3)::DOUBLE AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3)::DOUBLE AS f1,
    round(coalesce(fp / nullif(fp + tn, 0), 0), 3)::DOUBLE AS fpr"""
cte("by_config", f"SELECT config, {_conf} FROM judged GROUP BY config", "judged")
ORACLES["scenario_outcomes"] = build(
    "SELECT scenario_id, category, is_secret, score, detected, correct FROM judged WHERE config = 'L1+L2+L3+L4'", "judged")
ORACLES["confusion_counts"] = build("SELECT * FROM by_config", "by_config")
ORACLES["detector_metrics"] = build(f"SELECT *, {_rates} FROM by_config WHERE config = 'L1+L2+L3+L4'", "by_config")
ORACLES["category_confusion"] = build(
    f"SELECT config, category, {_conf} FROM judged GROUP BY ROLLUP (config, category)", "judged")
ORACLES["ablation_metrics"] = build(f"SELECT *, {_rates} FROM by_config", "by_config")
_base = ", ".join(f"({q(n)}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in BASELINES)
ORACLES["baseline_comparison"] = build(
    f"""SELECT config AS detector, precision, recall, f1 FROM (SELECT *, {_rates} FROM by_config)
    UNION ALL SELECT * FROM (VALUES {_base}) AS b(detector, precision, recall, f1)""", "by_config")

ORACLES["stream_gate"] = ORACLES["change_gate"]
ORACLES["stream_closed_days"] = ORACLES["stream_daily_counts"]
ORACLES["evaluation_report"] = build(
    f"""SELECT 0.3::DOUBLE AS threshold, {len(BASELINES)} AS n_baselines, config, precision, recall, f1, fpr, category, c.tp, c.fp, c.fn, c.tn
    FROM (SELECT *, {_rates} FROM by_config) r JOIN (SELECT config, category, {_conf} FROM judged GROUP BY config, category) c USING (config)""",
    "by_config", "judged")
ORACLES["scan_files"] = build(
    """SELECT concat(source, '-', lang) AS part, rule_id, count(*)::BIGINT AS n_matches
    FROM hits JOIN documents USING (doc_id) GROUP BY 1, 2""", "hits")
ORACLES["gate_file_list"] = build(
    f"""SELECT lang AS batch, true AS has_files, count(score)::BIGINT AS n_findings, count(score) > 0 AS blocked
    FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN combined_score >= 0.3 THEN 1 END AS score FROM findings) USING (doc_id) GROUP BY lang
    UNION ALL SELECT 'none', false, 0, false""", "findings")
