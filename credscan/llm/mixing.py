"""Mixing sources to target weights (operator 11), in DataFrame functions only.

Every document gets a hash-random key. Keys are range-sorted within each source: equal ranges of
the key are buckets, as many as a source's share of the rows asks for, and rows are sorted within
their bucket. Prefix sums of the sizes, within buckets and over bucket totals, tell where a source's
budget ends. A source repeats whole epochs while its budget holds more than all of it; the last
epoch takes documents in key order up to the cut, where one document is taken in part, so that a
source gives its budget to the word. Only the cut points, one row per source, come back to the
documents, so texts are never shuffled.

Targets: sources in code-point order, null last, have the weights ``weights`` in turn, and share
the words of all documents by weight. A target stops at ``most`` times the size of its source, and
the excess is shared anew among the others, by rounds of sums over the sources, until none is above.

Results in edge cases: null and empty texts have size 0 and take nothing; they stay in the result.
Null is a source of its own, and so is the empty name. Null and repeated doc_ids are kept. Rows that
are equal in doc_id, text and source have one key; where they lie at the cut they share what is left
by size, rounded down, and a source may then miss its budget by less than a word for each of them.
A very long text is one row like any other, and may be the one that is cut. An empty table gives an
empty result. Other columns are kept in ``row`` and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credscan.llm.cluster import cut, partitions

WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets for each shuffle partition; more make them more even.
BUCKETS = 4
#: Sources up to which their cut points are broadcast.
SMALL = 50_000
_WIDE = "decimal(38,0)"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key(doc_id: Column, text: Column) -> Column:
    """Hash-random key: 16 hexadecimal digits."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(whole.cast("binary")), 1, 16)


def _light(df: DataFrame) -> DataFrame:
    """``df``, which is written already, for broadcasting if it is small; else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on source, null equal to null."""
    right = right.withColumnRenamed("source", "same")
    return left.join(right, F.col("source").eqNullSafe(F.col("same")), how).drop("same")


def weighed(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (distinct) with the weight of their place in code-point order, null last.

    Places are numbers within sorted partitions plus the rows of the partitions before.
    """
    rows = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    before = rows.groupBy(part).agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")  # a row per partition
    )
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    turn = F.pmod(place, F.lit(len(weights))).cast("int")
    return rows.withColumn("part", part).join(F.broadcast(before), "part").select(
        *sources.columns, F.get(F.array(*[F.lit(w) for w in weights]), turn).cast("long").alias("weight")
    )


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source, words, weight) with ``target``, and its whole number ``budget``."""
    rows = cut(sources.withColumn("full", F.lit(False)))
    while True:
        free = rows.agg(
            F.coalesce(F.sum("words"), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("full"), most * F.col("words"))), F.lit(0)),
            F.sum(F.when(~F.col("full"), F.col("weight"))),
        ).first()
        left, weight = int(free[0]), int(free[1] or 0)
        above = (F.col("words").cast(_WIDE) * F.lit(most * weight).cast(_WIDE)) < (F.col("weight").cast(_WIDE) * F.lit(left).cast(_WIDE))
        more = rows.where(~F.col("full") & above)
        if not weight or more.limit(1).count() == 0:
            break
        rows = cut(rows.withColumn("full", F.col("full") | above))
    target = F.when(F.col("full"), (most * F.col("words")).cast("double")).otherwise(
        F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(weight or 1))
    )
    return rows.withColumn("target", target).drop("full").withColumn("budget", F.floor("target").cast("long"))


def cuts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source_size, target, whole ``epochs``, the key ``cut`` at which the last epoch ends,

    the words ``left`` for the rows of that key, and their words ``there``.
    """
    slim = docs.select("source", key(F.col("doc_id"), F.col("text")).alias("key"), size(F.col("text")).alias("size"))
    slim = cut(slim.groupBy("source", "key").agg(F.sum("size").alias("size")))
    sums = slim.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("keys"))
    known = cut(targets(weighed(cut(sums), weights), most))
    known = known.withColumn("epochs", F.when(F.col("words") > 0, F.expr("budget div words")).otherwise(0).cast("long"))
    known = known.withColumn("last", F.col("budget") - F.col("epochs") * F.col("words"))
    rows = slim.agg(F.count("*")).first()[0]
    share = F.ceil(F.col("keys") * BUCKETS * partitions(docs.sparkSession) / max(rows, 1))
    known = cut(known.withColumn("buckets", share.cast("long")))
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    dealt = _by_source(slim, _light(known.select("source", "buckets", "last"))).withColumn("bucket", F.floor(place * F.col("buckets")))
    ends = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    ends = cut(ends.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))))
    start = ends.select(F.col("source").alias("same"), F.col("bucket").alias("at"), (F.col("upto") - F.col("size")).alias("start"))
    order = Window.partitionBy("source", "bucket").orderBy("key")
    sorted_ = dealt.withColumn("upto", F.sum("size").over(order)).join(
        start, F.col("source").eqNullSafe(F.col("same")) & (F.col("bucket") == F.col("at"))
    )
    before = F.col("start") + F.col("upto") - F.col("size")
    found = sorted_.select("source", "key", "size", before.alias("before"), "last").where("before <= last AND last < before + size")
    found = found.select("source", F.col("key").alias("cut"), (F.col("last") - F.col("before")).alias("left"), F.col("size").alias("there"))
    return _by_source(known.select("source", F.col("words").alias("source_size"), "target", "epochs"), found, "left")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Every document's part in the mix of ``docs`` (doc_id, text, source).

    Columns ``row`` (the document), size, source_size, target, epochs (times that it is taken
    whole), extra (the words of its beginning that are taken once more) and taken (words in all).
    """
    ends = _light(cut(cuts(docs, weights, most)))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), "source",
        key(F.col("doc_id"), F.col("text")).alias("key"), size(F.col("text")).alias("size"),
    )
    found = _by_source(rows, ends)
    at_cut = F.expr("cast((cast(left as decimal(19,0)) * size) div greatest(there, 1L) as long)")
    extra = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), at_cut).otherwise(0)
    return found.withColumn("extra", F.coalesce(extra, F.lit(0)).cast("long")).select(
        "row", "size", "source_size", "target", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")
    )


def texts(found: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``mixed`` once for each time that they are taken, as row and text.

    The last may be the first ``extra`` words of a text, with the white space between them.
    """
    begin = F.regexp_extract(F.col("row.text"), r"^[\x20\x09-\x0D]*", 0)
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.when(
        F.col("extra") >= F.col("size"), F.col("row.text")
    ).otherwise(F.concat(begin, F.array_join(F.slice(words, 1, F.col("extra").cast("int")), "")))
    whole = F.array_repeat(F.col("row.text"), F.col("epochs").cast("int"))
    taken = F.concat(whole, F.when(F.col("extra") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    return found.where("size > 0").select("row", F.explode(taken).alias("text"))
