"""Detection quality: outcomes, confusion counts, rates, ablation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credscan.rules import DEFAULT_THRESHOLD

# Published rates of other detectors, measured on other data (fixed values).
BASELINES = (
    ("TruffleHog v3", 0.28, 0.92, 0.43),
    ("Gitleaks v8", 0.35, 0.88, 0.50),
    ("PassFinder", 0.51, 0.74, 0.60),
    ("SpotBugs", 0.67, 0.41, 0.51),
)


def outcomes(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds ``detected`` and ``correct`` to rows with ``score``, ``is_secret``."""
    detected = F.col("score") >= threshold
    return scored.select(
        "*", detected.alias("detected"), (detected == F.col("is_secret")).alias("correct")
    )


def _counts() -> list[Column]:
    hit, real = F.col("detected"), F.col("is_secret")
    return [
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    ]


def confusion(judged: DataFrame, *by: str) -> DataFrame:
    return judged.groupBy(*by).agg(*_counts())


def category_confusion(judged: DataFrame) -> DataFrame:
    """Counts per configuration and category, with totals: a null category is
    all of one configuration, a null configuration everything."""
    return judged.rollup("config", "category").agg(*_counts())


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, F1 and false-positive rate, three places."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "*",
        F.round(precision, 3).alias("precision"),
        F.round(recall, 3).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 3).alias("f1"),
        F.round(ratio(fp, fp + tn), 3).alias("fpr"),
    )


def evaluation_report(judged: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row that is the whole evaluation: configuration -> rates, counts and counts by category,
    and the published baselines. A row for each configuration and category is what is folded."""
    counts = category_confusion(judged).where("config IS NOT NULL")
    cell = F.struct("tp", "fp", "fn", "tn")
    by_category = counts.where("category IS NOT NULL").groupBy("config").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", cell.alias("counts"))))).alias("by_category")
    )
    totals = rates(counts.where("category IS NULL").drop("category")).join(by_category, "config")
    metrics = F.struct("precision", "recall", "f1", "fpr", "tp", "fp", "fn", "tn", "by_category")
    configurations = totals.agg(F.map_from_entries(F.collect_list(F.struct("config", metrics.alias("metrics")))).alias("configurations"))
    published = F.array(*[F.struct(F.lit(n).alias("detector"), *[F.lit(v).alias(k) for k, v in zip(("precision", "recall", "f1"), own, strict=True)]) for n, *own in BASELINES])
    return configurations.select(F.lit(threshold).alias("threshold"), "configurations", published.alias("baselines"))


def baselines(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("detector", T.StringType())] + [
        T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")
    ])
    return spark.createDataFrame(list(BASELINES), schema)


def compared(own: DataFrame) -> DataFrame:
    """Own rates (``config`` and rates) beside the published baselines, best F1
    first. The table has one row per configuration and baseline."""
    rows = own.select(F.col("config").alias("detector"), "precision", "recall", "f1")
    return rows.unionByName(baselines(own.sparkSession)).orderBy(F.desc("f1"), "detector")
