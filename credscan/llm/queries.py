"""One query per operator of this package over its whole table, and SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credscan.llm import (
    chat, contamination, divergence, interpolation, language, line_dedup, mixing, near_dup, packing, pages, prefix_trie,
    ranked_search, token_counts,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", "text")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.remainder(F.col("doc_id"), 3) == 1
    found = language.identify(language.fit(docs.where(~held_out)), F.col("text"), spark)
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer()))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.piece_counts(F.col("text"), tokenizer()).alias("counts")
    return table(spark, sf_dir, "documents").select("doc_id", counts).select("doc_id", "counts.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.repaired(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "place", "turn", "role", "action", "rendered")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "size", F.col("source_size"), "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(conversations), conversations))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_source_mixing": op11_source_mixing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

#: Words as the contracts define them, A-Z lowered.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

ORACLES = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
t AS (SELECT min(doc_id) AS rep, sorted, any_value(len(sorted)) AS n
      FROM (SELECT doc_id, list_sort(s) AS sorted FROM s) GROUP BY sorted HAVING len(sorted) > 0),
e AS (SELECT rep, n, unnest(sorted) AS g FROM t),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep
        AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, root) AS (SELECT rep, rep FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
d AS (SELECT s.doc_id, len(s.s) AS n, coalesce(c.root, s.doc_id) AS root
      FROM s LEFT JOIN t ON t.sorted = list_sort(s.s) LEFT JOIN c ON c.node = t.rep)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM d""",
    "op5_benchmark_decontamination": r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
v AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM w),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM v),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_item_shingles, count(*) AS n_shared, count(*) / n.n AS containment
FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING 5 * count(*) >= 4 * n.n""",
    "op11_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM d GROUP BY source),
o AS (SELECT *, sum(words) OVER () - 3 * coalesce(sum(words) OVER b, 0) AS words_left, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
      FROM s WINDOW b AS (ORDER BY words::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * words * w_left < w * words_left AS is_full FROM o),
r AS (SELECT sum(words) - coalesce(sum(3 * words) FILTER (is_full), 0) AS words_left, sum(w) FILTER (NOT is_full) AS w_left FROM f),
t AS (SELECT source, words, CASE WHEN is_full THEN CAST(3 * words AS DOUBLE)
        ELSE CAST(r.words_left AS DOUBLE) * CAST(w AS DOUBLE) / CAST(r.w_left AS DOUBLE) END AS target FROM f, r),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN words > 0 THEN budget // words ELSE 0 END AS epochs FROM b),
k AS (SELECT source, key, sum(size) AS there FROM d GROUP BY source, key),
p AS (SELECT source, key, there, sum(there) OVER (PARTITION BY source ORDER BY key) - there AS before FROM k)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, e.words AS source_size, e.target,
    CAST(e.epochs * d.size + greatest(0, least(p.there, e.budget - e.epochs * e.words - p.before)) * d.size // greatest(p.there, 1) AS BIGINT) AS taken
FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.key = d.key""",
    "op12_prefix_trie": r"""
WITH n AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
      FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])) AS l
         FROM (SELECT DISTINCT c FROM n)),
hs AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, l::BIGINT[]),
        lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h FROM bits),
own AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY place) AS l FROM n GROUP BY c),
seq AS (SELECT hs.c, list_concat(coalesce(list_slice(b.l, 1, h), []), list_slice(own.l, h + 1, len(own.l))) AS s
        FROM hs JOIN own USING (c) LEFT JOIN own b ON b.c = hs.c - hs.c % 5),
occ AS (SELECT c, len(s) AS length, unnest(range(0, len(s) + 1)) AS depth, s FROM seq),
pre AS (SELECT c, length, depth, list_slice(s, 1, depth) AS p, CASE WHEN depth = 0 THEN '' ELSE s[depth].text END AS last FROM occ),
node AS (SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, any_value(strlen(last)) AS n_bytes,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (length = depth), '')) AS ends_sha256
      FROM pre GROUP BY depth, p),
up AS (SELECT conv_id, depth, p, unnest(range(0, depth + 1)) AS d FROM node),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
val AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p),
sums AS (SELECT list_slice(up.p, 1, d) AS p, sum((val.n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved
         FROM up JOIN val ON val.p = up.p GROUP BY 1)
SELECT val.conv_id, CAST(val.depth AS BIGINT) AS depth, par.conv_id AS parent_conv_id, val.n_convs, val.n_children,
    CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, val.ends_sha256
FROM val JOIN sums ON sums.p = val.p LEFT JOIN node par ON val.depth > 0 AND par.p = list_slice(val.p, 1, val.depth - 1)""",
    "op13_ranked_search": r"""
WITH x AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
           UNION ALL SELECT 'q', item_id, row_number() OVER (), text FROM benchmark),
v AS (SELECT kind, id, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM x),
tf AS (SELECT kind, id, r, term, count(*) AS tf FROM v GROUP BY ALL),
n AS (SELECT r, sum(tf) AS n FROM tf WHERE kind = 'd' GROUP BY r),
g AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
m AS (SELECT r, 75 + (25 * n * docs) // terms AS m FROM n, g),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, g WHERE kind = 'd' GROUP BY term),
s AS (SELECT q.id AS item_id, q.r AS q, d.id AS doc_id, CAST(sum(q.tf * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m.m))) AS BIGINT) AS score
      FROM tf q JOIN tf d ON q.kind = 'q' AND d.kind = 'd' AND q.term = d.term JOIN m ON m.r = d.r JOIN w ON w.term = q.term
      GROUP BY q.id, q.r, d.id, d.r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}
