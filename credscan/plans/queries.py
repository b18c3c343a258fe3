"""The registered queries: one per operator, over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credscan.functions import entropy as E
from credscan.functions import groups as G
from credscan.functions import suppress as P
from credscan.functions.signals import signal_score
from credscan.functions.text import split_lines, utf8_text
from credscan.operators import evaluate, history, legacy, models, risk, scan
from credscan.operators.matches import candidate_lines_sql, explode_late, matches, matches_per_rule, tiered
from credscan.plans.corpus import as_sources, commits, patches, planted_files, scenarios, sources, table
from credscan.rules import rule_table, rules_from
from credscan.sources import paths
from credscan.sources.files import read_files, read_listed, write_findings, write_report
from credscan.sources.layout import spread
from credscan.sources.store import shared_dir
from credscan.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


MATCH = ("doc_id", "line_no", "rule_id", "match_ord")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir)


def _joined(array, separator: str = "\n"):
    """An array of strings as a digest, so results stay comparable and small."""
    return F.md5(F.array_join(array, separator))


# --- sources ----------------------------------------------------------------

@query
def scan_sources(spark, sf_dir):
    """Bytes with undecodable parts, read as text."""
    broken = F.concat(F.unhex(F.lit("FF")), F.col("content").cast("binary"), F.unhex(F.lit("C3FE")))
    return _files(spark, sf_dir).select(
        "doc_id", "file_path", utf8_text(broken).alias("content")
    ).select("doc_id", "file_path", F.length("content").cast("bigint").alias("n_chars"),
             F.md5("content").alias("digest"))


@query
def skip_paths(spark, sf_dir):
    files = sources(spark, sf_dir).select("file_path")
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("file_path"))
    path = F.col("file_path")
    return files.unionByName(urls).select(
        "file_path",
        paths.is_binary_file(path).alias("is_binary"),
        paths.skipped_in_history(path).alias("skipped_in_history"),
        paths.skipped_by_entropy(path).alias("skipped_by_entropy"),
    )


@query
def explode_lines(spark, sf_dir):
    lines = _files(spark, sf_dir).select("doc_id", split_lines("content").alias("lines"))
    return lines.select("doc_id", F.posexplode("lines").alias("i", "line")).select(
        "doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), F.md5("line").alias("digest")
    )


@query
def rule_catalogue(spark, sf_dir):
    found = matches(_files(spark, sf_dir), "content").groupBy("rule_id").agg(F.count("*").alias("n"))
    return rule_table(spark).join(found, "rule_id", "left").select(
        "rule_id", "description", "severity", F.array_join("tags", ",").alias("tags"),
        F.col("tier").cast("bigint").alias("tier"), "tier_weight",
        F.col("min_length").cast("bigint").alias("min_length"),
        F.coalesce("n", F.lit(0)).alias("n_matches"),
    )


# --- rule matching ----------------------------------------------------------

@query
def regex_matches(spark, sf_dir):
    return matches(_files(spark, sf_dir), "content").select(*MATCH, "secret")


@query
def tiered_matches(spark, sf_dir):
    return tiered(matches(_files(spark, sf_dir), "content")).select(*MATCH, "tier", "regex_score")


@query
def matches_by_rule(spark, sf_dir):
    """A line counts once per rule through its first match there."""
    return matches_per_rule(_files(spark, sf_dir), "content").groupBy("rule_id").agg(
        F.sum("n").alias("n_matches"), F.sum("lines").alias("n_lines"), F.count("*").alias("n_docs")
    )


@query
def legacy_scan(spark, sf_dir):
    return legacy.detect(sources(spark, sf_dir)).select(
        *MATCH, "secret", "severity", "description", F.md5("line_content").alias("line_digest")
    )


@query
def high_entropy_strings(spark, sf_dir):
    files = _files(spark, sf_dir)
    return legacy.high_entropy_findings(files).select(
        "doc_id", "line_no", "match_ord", "secret", "severity", "description"
    )


# --- entropy ----------------------------------------------------------------

@query
def shannon_entropy(spark, sf_dir):
    text = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", E.round3(E.shannon_entropy(text)).alias("shannon")
    )


@query
def transition_entropy(spark, sf_dir):
    text = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", E.round3(E.transition_entropy(text)).alias("transition")
    )


def _secrets(spark, sf_dir):
    return matches(_files(spark, sf_dir), "content")


@query
def placeholder_strings(spark, sf_dir):
    literals = _files(spark, sf_dir).select(
        "doc_id", F.explode_outer(G.string_literals(F.col("content"))).alias("s")
    ).where(F.col("s").isNotNull())
    return literals.select("doc_id", "s", E.is_known_placeholder(F.col("s")).alias("is_placeholder"))


@query
def charset_flags(spark, sf_dir):
    """Counts per text of the space-separated words that look random."""
    words = F.split("content", "[ \n]+")
    w = _files(spark, sf_dir).select("doc_id", words.alias("words"))

    def count(test):
        return F.size(F.filter("words", test)).cast("bigint")

    return w.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        count(lambda w: E.is_high_entropy(w)).alias("n_high_entropy"),
        count(E.looks_like_base64).alias("n_base64"),
        count(E.looks_like_hex).alias("n_hex"),
    )


@query
def entropy_scores(spark, sf_dir):
    return _secrets(spark, sf_dir).select(
        *MATCH, E.evaluate_entropy(F.col("secret")).alias("e")
    ).select(*MATCH, "e.*")


# --- string groups and classifiers ------------------------------------------

@query
def string_literals(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", G.string_literals(F.col("content")).alias("found")).select(
        "doc_id", F.size("found").cast("bigint").alias("n"), _joined("found").alias("digest")
    )


@query
def urls(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", G.urls(F.col("html")).alias("found")).select(
        "page_id", F.size("found").cast("bigint").alias("n"), _joined("found").alias("digest")
    )


@query
def block_context(spark, sf_dir):
    return models.hit_contexts(sources(spark, sf_dir)).select(
        "doc_id", "line_no", F.col("bounds.first").alias("first_line"),
        F.col("bounds.last").alias("last_line"), F.md5("context").alias("digest"),
    )


@query
def string_groups(spark, sf_dir):
    return models.hit_contexts(sources(spark, sf_dir)).select(
        "doc_id", "line_no", F.size("string_group").alias("n"), _joined("string_group").alias("digest")
    )


@query
def signal_classifier(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", signal_score(F.col("content")).alias("probability"))


@query
def classified_groups(spark, sf_dir):
    hits = scan.hit_arrays(
        scan.prepared(sources(spark, sf_dir), "content", "file_path"), ("doc_id",),
        candidate_lines_sql("content"),
    )
    return explode_late(hits, "hits", "hit", "doc_id").select("doc_id", "hit.line_no", "hit.l3.*")


N_POSITIVE, N_NEGATIVE = 6, 3


def _contexts(vectors):
    first = {
        r["label"]: r["v"]
        for r in vectors.where(F.col("label") < N_POSITIVE + N_NEGATIVE)
        .groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).collect()
    }
    return [first[i] for i in sorted(first)]


@query
def context_similarity(spark, sf_dir):
    """Reference contexts: the first vector of each of nine labels."""
    vectors = table(spark, sf_dir, "embeddings")
    contexts = _contexts(vectors)
    return spread(vectors).select(
        "vec_id",
        models.context_similarity(
            F.col("embedding"), contexts[:N_POSITIVE], contexts[N_POSITIVE:]
        ).alias("probability"),
    )


def _examples(spark, sf_dir):
    """Labelled texts: the quality flag of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.join(labels, "doc_id")


@query
def train_text_classifier(spark, sf_dir):
    examples = _examples(spark, sf_dir)
    fitted = models.train(examples)
    return models.probability_of(fitted, "text")(examples.withColumn("group_text", F.col("text"))).select(
        "doc_id", "label", "probability"
    )


@query
def model_scores(spark, sf_dir):
    """The scan with a trained classifier, and the keyword signals for groups of one word."""
    fitted = models.train(_examples(spark, sf_dir))
    found = models.scan_with(sources(spark, sf_dir), models.probability_of(fitted, least_words=2), "trained")
    by_signals = F.when(F.col("model_used") == "heuristic_fallback", F.col("classifier_score"))
    return found.select(
        *MATCH, "string_group_size", "model_used", by_signals.alias("signal_score"),
        F.col("classifier_score").between(0, 1).alias("scored"),
    )


@query
def cv_metrics(spark, sf_dir):
    folded = models.stratified_folds(_examples(spark, sf_dir), "doc_id")
    summary = models.cv_summary(models.cross_validate(folded))
    target = shared_dir(spark, "model-metadata")
    write_report(models.metadata(folded, summary), target)
    return spark.read.json(target).drop("labels", "trained_at")


@query
def stratified_folds(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return models.stratified_folds(labels, "doc_id")


@query
def class_balance(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return models.class_balance(labels.select(F.col("quality").alias("label")))


# --- rules and classifiers as arguments -------------------------------------

#: Two rules beside the catalogue's: one known by what it must contain, one by its expression alone.
ADDED_RULES = (
    ("mail-address", r"[a-z0-9._]+@[a-z0-9]+\.(org|com|net)", "low", 6, 2),
    ("long-number", r"[0-9]{9,}", None, None, None),
)
LEFT_OUT = ("twitter-access-token", "generic-api-key")


def _scanned(found):
    return found.select(
        "file_path", *MATCH, "secret", "tier", "regex_score", "classifier_score", "classification", "model_used",
        "string_group_size", "total_penalty", "combined_score", "severity",
    )


@query
def custom_rules(spark, sf_dir):
    """The scan by a catalogue from a table: two rules left out, two added."""
    added = spark.createDataFrame(ADDED_RULES, "rule_id string, regex string, severity string, min_length int, tier int")
    table_ = rule_table(spark).where(~F.col("rule_id").isin(*LEFT_OUT)).unionByName(
        added.withColumn("rule_ord", F.when(F.col("rule_id") == "mail-address", 100).otherwise(101)), allowMissingColumns=True
    )
    return _scanned(scan.scan(sources(spark, sf_dir), layers=scan.Layers(rules=rules_from(table_))))


def _vectors_of(spark, sf_dir):
    """A classifier by vectors: groups are dealt twice as many numbers as there are vectors, so half have none."""
    vectors = table(spark, sf_dir, "embeddings")
    contexts = _contexts(vectors)
    number = F.conv(F.substring(F.md5("group_text"), 1, 7), 16, 10).cast("long")

    def add(groups):
        numbered = groups.withColumn("vec_id", number % (2 * vectors.agg(F.count("*")).scalar()))
        return numbered.join(vectors.select("vec_id", "embedding"), "vec_id").withColumn(
            "probability", models.context_similarity(F.col("embedding"), contexts[:N_POSITIVE], contexts[N_POSITIVE:])
        )

    return scan.Layers(classifier=scan.Classifier("similarity", add))


@query
def similarity_scan(spark, sf_dir):
    """Blocks judged by the vectors of their string groups, by keyword signals where there is none."""
    return _scanned(scan.scan(sources(spark, sf_dir), layers=_vectors_of(spark, sf_dir)))


@query
def similarity_gate(spark, sf_dir):
    return risk.gate(sources(spark, sf_dir), layers=_vectors_of(spark, sf_dir))


@query
def train_group_classifier(spark, sf_dir):
    """String groups of the labelled scenarios as training set; the model is saved, loaded and applied."""
    examples = models.labelled_groups(scenarios(spark, sf_dir), F.col("is_secret").cast("int"))
    weighted, _ = models.balanced(examples)
    fitted = models.saved(models.train(examples, "group_text"), shared_dir(spark, "classifier"))
    return models.probability_of(fitted)(weighted).select(
        "group_key", "label", "weight", "group_size", F.size(F.filter(F.split("group_text", r"\s+"), lambda w: w != "")).cast("bigint").alias("n_tokens"),
        F.col("probability").between(0, 1).alias("scored"),
    )


# --- false-positive rules ---------------------------------------------------

FLAG_COLUMNS = (
    "function_call", "variable_assignment", "test_directory", "readme_file", "numeric_only",
    "null_value", "css_selector", "commented_out", "placeholder", "low_transition",
    "empty_string", "repeated_value", "placeholder_value", "no_cloud_api", "weak_password",
)


def _features(spark, sf_dir):
    keep = ("doc_id", "file_path")
    rows = scan.hit_rows(
        scan.prepared(sources(spark, sf_dir), "content", "file_path"), keep,
        candidate_lines_sql("content"), scan.Layers(l3=False),
    )
    return scan.features(rows, keep)


@query
def fp_flags(spark, sf_dir):
    rows = _features(spark, sf_dir).select(
        "*", scan.rule_column("rule_id"),
        P.secret_facts(F.col("secret"), F.col("facts")).alias("own"),
    )
    path = F.col("file_path")
    flags = P.flags(
        P.in_test_directory(path), P.in_readme_file(path), F.col("facts"), F.col("own"),
        F.col("l2.transition"),
    )
    return rows.select(*MATCH, *[f.fired.alias(n) for n, f in zip(FLAG_COLUMNS, flags, strict=True)])


@query
def suppressed_findings(spark, sf_dir):
    rows = _features(spark, sf_dir).select("*", scan.rule_column("rule_id")).select(
        *MATCH, F.array_join("l4.rules_fired", ",").alias("rules_fired"),
        F.col("l4.total_penalty").cast("double").alias("total_penalty"),
        F.col("l4.suppressed").alias("suppressed"),
        F.col("l4.suppressor_score").cast("double").alias("suppressor_score"),
    )
    return scan.keep_rows(rows, lambda r: r["suppressed"])


@query
def suppression_reasons(spark, sf_dir):
    """One row per rule that fired on a match, in the order of the rules."""
    rows = _features(spark, sf_dir).select("*", scan.rule_column("rule_id"))
    why = P.reasons(F.col("l4.rules_fired"), F.col("l4.penalties"), F.col("l2.transition"))
    fired = F.arrays_zip(F.col("l4.rules_fired").alias("rule"), F.col("l4.penalties").alias("penalty"), why.alias("reason"))
    rows = rows.select(*MATCH, F.posexplode_outer(fired).alias("position", "f")).where(F.col("f").isNotNull())
    return rows.select(*MATCH, F.col("position").cast("int").alias("position"), "f.rule", "f.penalty", "f.reason")


# --- scores -----------------------------------------------------------------

@query
def combined_scores(spark, sf_dir):
    return scan.scan(sources(spark, sf_dir)).select(
        *MATCH, "regex_score", "entropy_score", "classifier_score", "suppressor_score", "combined_score"
    )


@query
def severity_counts(spark, sf_dir):
    return scan.scan(sources(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"))


@query
def explanations(spark, sf_dir):
    return scan.scan(sources(spark, sf_dir)).select(
        *MATCH, F.array_join("explanation", "; ").alias("explanation")
    )


@query
def reported_findings(spark, sf_dir):
    return scan.ranked(scan.report(sources(spark, sf_dir))).select(
        "file_path", *MATCH, "secret", "combined_score", "severity"
    )


@query
def top_findings(spark, sf_dir):
    """The three best findings of every batch."""
    found = scan.scan(sources(spark, sf_dir), keep=("doc_id", "batch"))
    best = Window.partitionBy("batch").orderBy(
        F.desc("combined_score"), "doc_id", "line_no", "rule_ord", "match_ord"
    )
    return found.select("batch", *MATCH, "combined_score", F.row_number().over(best).alias("rank")).where(
        F.col("rank") <= 3
    )


@query
def ablation_scores(spark, sf_dir):
    return risk.ablation(sources(spark, sf_dir)).select(*MATCH, "config", "score")


@query
def scan_documents(spark, sf_dir):
    return scan.scan(sources(spark, sf_dir)).select(
        "file_path", *MATCH, "secret", "tier", "regex_score", "shannon", "transition", "is_placeholder",
        "entropy_score", "classifier_score", "classification", "string_group_size",
        F.array_join("rules_fired", ",").alias("rules_fired"), "total_penalty", "suppressed",
        "suppressor_score", "combined_score", "severity", F.md5("line_content").alias("line_digest"),
    )


@query
def findings_report(spark, sf_dir):
    """Findings through the sink and back: one directory per severity."""
    target = shared_dir(spark, "findings")
    write_findings(scan.report(sources(spark, sf_dir)), target)
    return spark.read.parquet(target).groupBy("severity", "rule_id").agg(
        F.count("*").alias("n"), F.max("combined_score").alias("max_score")
    )


@query
def document_risk(spark, sf_dir):
    return risk.risk(sources(spark, sf_dir))


@query
def change_gate(spark, sf_dir):
    return risk.gate(sources(spark, sf_dir))


# --- history ----------------------------------------------------------------

@query
def patch_added_lines(spark, sf_dir):
    rows = patches(spark, sf_dir).select(
        "sha", F.concat_ws(":", "parent_no", F.coalesce("b_path", "a_path")).alias("file_path"), "patch"
    )
    return history.added_lines(rows).select("sha", "file_path", "block_pos", "new_line_no", "line")


HISTORY = ("sha", "file_path", "line_approx", "rule_id", "match_ord", "secret")


def _history(spark, sf_dir, chosen=None):
    found = history.scan_patches(patches(spark, sf_dir), commits(spark, sf_dir))
    return found if chosen is None else history.only_commits(found, chosen)


def _history_of(spark, sf_dir, few):
    """The findings of a few commits, whose patches alone are scanned."""
    return history.scan_patches(history.only_commits(patches(spark, sf_dir), few), commits(spark, sf_dir))


@query
def history_findings(spark, sf_dir):
    return _history(spark, sf_dir).select(
        *HISTORY, "combined_score", "sha_short", "message", "author_name", "author_email",
        F.date_format("committed_at", "yyyy-MM-dd").alias("committed_on"),
    )


@query
def recent_commits(spark, sf_dir):
    newest = history.recent(commits(spark, sf_dir), 500)
    return _history_of(spark, sf_dir, newest).select(*HISTORY, "combined_score", "seq")


@query
def range_findings(spark, sf_dir):
    """From the twelfth commit, on a branch, to the last commit that is on none."""
    log = commits(spark, sf_dir)
    ends = log.where(F.col("seq") % 8 < 3).agg(F.max_by("sha", "seq").alias("end")).first()
    start = log.where(F.col("seq") == 11).first()
    return _history(spark, sf_dir, history.commit_range(log, start["sha"], ends["end"])).select(
        *HISTORY, "combined_score", "seq"
    )


@query
def first_exposures(spark, sf_dir):
    return history.newest_first(history.first_exposures(_history(spark, sf_dir))).select(
        *HISTORY, "combined_score", "seq"
    )


@query
def findings_by_commit(spark, sf_dir):
    found = history.first_exposures(_history(spark, sf_dir))
    return history.by_commit(found).orderBy(F.desc("committed_at"), "sha").select(
        "sha_short", F.date_format("committed_at", "yyyy-MM-dd").alias("committed_on"),
        "author_name", "message", "n_findings", "max_score", "n_critical", "n_high", "n_medium",
    )


# --- evaluation -------------------------------------------------------------

def _judged(spark, sf_dir, configurations=risk.CONFIGURATIONS):
    best = risk.risk_by_configuration(
        scenarios(spark, sf_dir), keep=("scenario_id", "category", "is_secret"), configurations=configurations
    )
    return evaluate.outcomes(best)


FULL = risk.CONFIGURATIONS[-1:]


@query
def scenario_outcomes(spark, sf_dir):
    return _judged(spark, sf_dir, FULL).drop("config")


@query
def confusion_counts(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), "config")


@query
def detector_metrics(spark, sf_dir):
    return evaluate.rates(evaluate.confusion(_judged(spark, sf_dir, FULL), "config"))


@query
def category_confusion(spark, sf_dir):
    return evaluate.category_confusion(_judged(spark, sf_dir))


@query
def ablation_metrics(spark, sf_dir):
    return evaluate.rates(evaluate.confusion(_judged(spark, sf_dir), "config"))


@query
def baseline_comparison(spark, sf_dir):
    return evaluate.compared(evaluate.rates(evaluate.confusion(_judged(spark, sf_dir), "config")))


@query
def evaluation_report(spark, sf_dir):
    """The nested report through its JSON file and back: a row for each configuration and category."""
    report = evaluate.evaluation_report(_judged(spark, sf_dir))
    target = shared_dir(spark, "evaluation")
    write_report(report, target)
    whole = spark.read.schema(report.schema).json(target)
    each = whole.select("threshold", F.size("baselines").alias("n_baselines"), F.explode("configurations").alias("config", "m"))
    return each.select(
        "threshold", "n_baselines", "config", "m.precision", "m.recall", "m.f1", "m.fpr", F.explode("m.by_category").alias("category", "c"),
    ).select("threshold", "n_baselines", "config", "precision", "recall", "f1", "fpr", "category", "c.*")


# --- files ------------------------------------------------------------------

def _text_files(spark, sf_dir, name):
    """The documents as text files, one folder per source; the folder's path."""
    target = shared_dir(spark, name)
    texts = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), "lang").alias("part"), F.coalesce("text", F.lit("")).alias("value"))
    texts.repartition("part").write.partitionBy("part").text(target)
    return target


def _part():
    return F.regexp_extract("file_path", "part=([^/]*)/", 1)


@query
def scan_files(spark, sf_dir):
    """A directory tree of text files, read whole."""
    files = read_files(spark, _text_files(spark, sf_dir, "tree"), glob="*.txt").withColumn("part", _part())
    return matches(files, "content", ("part",)).groupBy("part", "rule_id").agg(F.count("*").alias("n_matches"))


@query
def gate_file_list(spark, sf_dir):
    """Submitted lists of files, one of which names a file that isn't there; no list is lost."""
    target = _text_files(spark, sf_dir, "submitted")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(target).select(
        F.regexp_replace("path", "^file:/*", "/").alias("file_path")
    )
    listed = there.select(F.substring_index(_part(), "-", -1).alias("batch"), "file_path")
    missing = spark.range(1).select(F.lit("none").alias("batch"), F.concat(F.lit(target), F.lit("/missing.txt")).alias("file_path"))
    texts = read_listed(spark, listed.unionByName(missing), target)
    # where the folder lies must not look like a path that a rule knows
    found = risk.gate(texts.withColumn("file_path", F.concat(F.lit("src/"), _part(), F.lit("/all.py"))))
    return listed.unionByName(missing).select("batch").distinct().join(found, "batch", "left").select(
        "batch", (F.coalesce("n_files", F.lit(0)) > 0).alias("has_files"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )


# --- streaming --------------------------------------------------------------

def _arriving(spark, sf_dir):
    """All source texts as streams: the supplied documents where they lie, the planted ones from files."""
    documents = table(spark, sf_dir, "documents").schema
    supplied = as_sources(jobs.read_stream(spark, f"{sf_dir}/documents.parquet", documents))
    planted = planted_files(spark, sf_dir)
    folder = shared_dir(spark, "planted")
    planted.write.parquet(folder)
    return supplied.unionByName(jobs.read_stream(spark, folder, planted.schema))


@query
def stream_scan(spark, sf_dir):
    found = scan.scan(_arriving(spark, sf_dir)).select(*MATCH, "secret", "combined_score", "severity")
    return jobs.drain(found, shared_dir(spark, "stream-scan"))


@query
def stream_gate(spark, sf_dir):
    """Decisions on batches as their files arrive, clean batches included."""
    return jobs.drain_latest(risk.gate(_arriving(spark, sf_dir)), shared_dir(spark, "stream-gate"), ("batch",))


def _arriving_history(spark, sf_dir):
    """The findings of the history, arriving as files."""
    columns = ("committed_at", "seq", "line_no", "rule_ord", *HISTORY, "combined_score", "severity")
    found = _history(spark, sf_dir).select(*columns)
    target = shared_dir(spark, "history-findings")
    found.write.parquet(target)
    return jobs.read_stream(spark, target, found.schema)


@query
def stream_first_exposures(spark, sf_dir):
    stream = jobs.first_exposures(_arriving_history(spark, sf_dir))
    found = jobs.drain_latest(stream, shared_dir(spark, "stream-first"), ("file_path", "secret"))
    return found.select(*HISTORY, "combined_score", "seq")


@query
def stream_daily_counts(spark, sf_dir):
    stream = jobs.daily_counts(_arriving_history(spark, sf_dir))
    found = jobs.drain_latest(stream, shared_dir(spark, "stream-daily"), ("day", "severity"))
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "severity", "n_findings", "max_score")


@query
def stream_closed_days(spark, sf_dir):
    """Counts with bounded state: what came on time and what came late are all findings together."""
    on_time, late = jobs.drain_days(_arriving_history(spark, sf_dir), shared_dir(spark, "stream-days"))
    return on_time.unionByName(late).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "severity").agg(
        F.sum("n_findings").alias("n_findings"), F.max("max_score").alias("max_score")
    )
