"""Quality rules by distribution divergence (operator 9), in DataFrame functions only.

A document's histograms of character classes and of common words are compared with those of its
language by Jensen-Shannon distance. References are counted over all documents of a language:
shares of character classes, and shares of the words that make up ``COMMON`` or more of its words
(at most 1 / COMMON words). Languages with fewer than ``RARE`` of all documents, and null, are
compared with all documents together. Each test has a guard: texts shorter than ``LEAST_CHARS`` or
``LEAST_WORDS`` pass it untested.

Results in edge cases: null texts have no words and fail the base rule. Null doc_ids and repeated
rows are kept as they are. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credscan.llm.cluster import cut

COMMON, RARE = 0.005, 0.001
#: Greatest distances, and the sizes from which they are tested.
MOST_CLASS, MOST_WORD = 0.25, 0.5
LEAST_CHARS, LEAST_WORDS = 200, 50
ALL = "*"
_SPACE = r"[\x20\x09-\x0D]+"
#: Counted by what is left when all else is removed, after a-z (the class ``lower``) has been;
#: the rest is what no class counts.
CLASSES = {
    "upper": r"[^A-Z]+", "digit": r"[^0-9]+", "space": r"[^\x20\x09-\x0D]+", "mark": r"""[^.,;:!?'"()\-]+""", "wide": r"[\x00-\x7F]+",
}
KINDS = ["lower", *CLASSES]


def _classed(texts: DataFrame, *keep: str) -> DataFrame:
    """n_chars, n_symbols and the count of each class; the patterns run over what a-z leaves of a text."""
    left = texts.select(*keep, F.length("text").alias("n_chars"), F.regexp_replace("text", "[a-z]+", "").alias("left"))
    return left.select(
        *keep, "n_chars", (F.col("n_chars") - F.length("left")).alias("lower"),
        F.length(F.regexp_replace("left", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        *[F.length(F.regexp_replace("left", pattern, "")).alias(name) for name, pattern in CLASSES.items()],
    )


def _repeated(words: str, windows: str, bits: str) -> Column:
    """First words (from 0) of all three-word windows that occur twice or more, ascending.

    ``windows`` is sorted and holds hash and place of each window in one number; neighbours of
    equal hash are compared in full.
    """
    place = f"shiftleft(1L, {bits}) - 1"
    equal = " AND ".join(f"get({words}, p.a + {k}) = get({words}, p.b + {k})" for k in range(3))
    return F.expr(f"""
        sort_array(array_distinct(flatten(transform(filter(transform(
            filter(sequence(1, greatest(size({windows}) - 1, 1)),
                   i -> shiftright(get({windows}, i) ^ get({windows}, i - 1), {bits}) = 0),
            i -> struct(cast(get({windows}, i) & ({place}) as int) AS a, cast(get({windows}, i - 1) & ({place}) as int) AS b)),
            p -> {equal}), p -> array(p.a, p.b)))))""")


def features(docs: DataFrame) -> DataFrame:
    """Base columns, character-class counts and lower-case words of ``docs`` (doc_id, text, lang)."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit(ALL)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = texts.select(
        "doc_id", "lang", "text", F.array_remove(F.split("text", _SPACE), "").alias("words"), lines.alias("lines")
    )
    split = _classed(split, "doc_id", "lang", "words", "lines")
    counts = ["n_symbols", "n_chars", *KINDS]
    sized = split.select(
        "doc_id", "lang", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("words").cast("long"))).alias("bits"), *counts,
    )
    windows = F.expr("""
        sort_array(transform(sequence(0, greatest(size(words) - 3, 0)), i ->
            coalesce(shiftleft(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), bits) | i, 0L)))""")
    sorted_ = sized.withColumn("windows", windows).withColumn("low", F.transform("words", F.lower))
    found = sorted_.withColumn("starts", F.when(F.col("n_words") > 3, _repeated("words", "windows", "bits")).otherwise(F.array().cast("array<int>")))
    covered = F.expr("""
        aggregate(sequence(0, greatest(size(starts) - 1, 0)), 0L, (n, i) ->
            n + least(3, coalesce(get(starts, i + 1) - get(starts, i), 3)))""")
    return found.select(
        "doc_id", "lang", "n_words", "word_chars", "n_dup_lines", F.col("low").alias("words"), *counts,
        F.when(F.size("starts") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _part(p: Column, q: Column) -> Column:
    """One entry's part of the Jensen-Shannon divergence in bits."""
    middle = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)) / 2


def references(docs: DataFrame) -> DataFrame:
    """Per language: share of each character class, and a map of its common words' shares."""
    texts = docs.select(F.coalesce("lang", F.lit(ALL)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = _classed(texts, "lang")
    # written, as filters on the language would be pushed below both counts and have texts counted once more
    classes = cut(sizes.groupBy("lang").agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ["n_chars", *KINDS]]))
    words = texts.select("lang", F.explode(F.split(F.lower("text"), _SPACE)).alias("word")).where("word <> ''")
    counted = cut(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    total = classes.select(F.sum("docs").alias("all_docs"))
    # a language's frequent words, and those frequent over all
    every = counted.groupBy("word").agg(F.sum("n").alias("n"))
    shared = every.join(F.broadcast(totals.select(F.sum("total").alias("total")))).withColumn("lang", F.lit(ALL))
    own = counted.where(F.col("lang") != ALL).join(F.broadcast(totals), "lang")
    shares = own.select("lang", "word", "n", "total").unionByName(shared.select("lang", "word", "n", "total"))
    common = shares.where(F.col("n") >= COMMON * F.col("total")).groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.col("n") / F.col("total")))).alias("common")
    )
    fields = ["docs", "n_chars", *KINDS]
    together = classes.agg(*[F.sum(c).alias(c) for c in fields]).withColumn("lang", F.lit(ALL))
    per = classes.where(F.col("lang") != ALL).join(F.broadcast(total)).where(F.col("docs") >= RARE * F.col("all_docs"))
    both = per.select("lang", *fields).unionByName(together.select("lang", *fields))
    size = F.greatest("n_chars", F.lit(1))
    return both.join(common, "lang", "left").select(
        "lang", F.array(*[F.col(c) / size for c in KINDS]).alias("shares"),
        F.coalesce("common", F.create_map().cast("map<string,double>")).alias("common"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """Base columns, class_distance, word_distance, base_failed and kept of ``docs`` (doc_id, text, lang)."""
    known = references(docs).collect()  # at most 1 / RARE languages of at most 1 / COMMON words
    spark = docs.sparkSession
    ref = spark.createDataFrame(
        [(r["lang"], list(r["shares"]), dict(r["common"])) for r in known], "lang string, shares array<double>, common map<string,double>"
    )
    names = [r["lang"] for r in known]
    vocabulary = sorted({w for r in known for w in r["common"]}) or [""]
    rows = features(docs)
    rows = rows.withColumn("ref", F.when(F.col("lang").isin(names), F.col("lang")).otherwise(F.lit(ALL)))
    rows = rows.withColumn("used", F.sort_array(F.filter("words", lambda w: w.isin(vocabulary)))).drop("words")
    joined = rows.join(F.broadcast(ref).withColumnRenamed("lang", "ref"), "ref")
    # of the sorted words each distinct one starts a run; its count is the distance to the next
    runs = joined.withColumn("own", F.array_distinct("used")).withColumn(
        "begin", F.expr("transform(own, w -> cast(array_position(used, w) as int))")
    )
    entries = F.expr("""
        filter(transform(own, (w, i) -> struct(
            element_at(common, w) AS p, (coalesce(get(begin, i + 1), size(used) + 1) - get(begin, i)) / n_words AS q)), e -> e.p IS NOT NULL)""")
    found = runs.withColumn("entries", entries)
    sums = "aggregate({0}, 0D, (s, e) -> s + {1})"
    part = "(e.p * log2(2 * e.p / (e.p + e.q)) + e.q * log2(2 * e.q / (e.p + e.q))) / 2"
    found = found.withColumns({
        "present": F.expr(sums.format("entries", part)), "p": F.expr(sums.format("entries", "e.p")),
        "q": F.expr(sums.format("entries", "e.q")), "common_share": F.expr(sums.format("map_values(common)", "e")),
    })
    absent = (F.col("common_share") - F.col("p")) / 2
    words = F.col("present") + absent + _part(F.greatest(F.lit(0.0), 1 - F.col("common_share")), F.greatest(F.lit(0.0), 1 - F.col("q")))
    size = F.greatest("n_chars", F.lit(1))
    pairs = [(F.get("shares", F.lit(i)), F.col(c) / size) for i, c in enumerate(KINDS)]
    rest = [F.greatest(F.lit(0.0), 1 - reduce(Column.__add__, side)) for side in zip(*pairs, strict=True)]
    classes = reduce(Column.__add__, [_part(p, q) for p, q in [*pairs, tuple(rest)]])
    distances = found.withColumns({
        "class_distance": F.sqrt(F.greatest(F.lit(0.0), classes)), "word_distance": F.sqrt(F.greatest(F.lit(0.0), words)),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    far = ((F.col("n_chars") >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASS)) | (
        (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > MOST_WORD)
    )
    return distances.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance",
    )
