"""Classifiers over string groups: similarity to reference contexts, and a
trained logistic regression with stratified cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credscan.functions.entropy import round3
from credscan.operators.evaluate import confusion, ratio
from credscan.operators.matches import candidate_lines_sql
from credscan.operators.scan import Classifier, Layers, prepared, scan
from credscan.operators.scan import hit_contexts as scan_contexts
from credscan.sources.store import written

# --- string groups as rows --------------------------------------------------

def hit_contexts(
    df: DataFrame, text: str = "content", path: str | None = "file_path",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per hit line of a table of texts, with its block's bounds, text and string group."""
    cols = (*keep, "file_path")
    rows = scan_contexts(prepared(df, text, path), cols, candidate_lines_sql(text))
    return rows.select(*cols, "hit.line_no", "hit.at", "hit.line", "hit.matches", "bounds", "context", "string_group")


def scan_with(
    df: DataFrame, probability: Callable[[DataFrame], DataFrame], model: str,
    text: str = "content", path: str | None = "file_path", keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The full scan with another classifier: ``probability`` adds a column of
    that name to rows with ``group_text``."""
    return scan(df, text, path, keep, Layers(classifier=Classifier(model, probability)))


# --- similarity -------------------------------------------------------------

def context_similarity(
    vector: Column, positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]]
) -> Column:
    """How much closer a vector is to the positive contexts than to the
    negative ones: best positive cosine over the sum of both best cosines, cut
    to [0, 1]. The contexts are arguments, a fixed and small set that travels with the plan."""

    def unit(rows) -> np.ndarray:
        m = np.asarray(rows, dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    pos, neg = unit(positive).T, unit(negative).T

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype="float64")
        v = unit(np.stack(vectors.to_numpy()))
        best_pos, best_neg = (v @ pos).max(axis=1), (v @ neg).max(axis=1)
        return pd.Series(np.clip(best_pos / (best_pos + best_neg + 1e-8), 0.0, 1.0))

    return round3(score(vector))


# --- training ---------------------------------------------------------------

def balanced(examples: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """Examples with a ``weight`` that makes both classes count the same, and
    their number. One aggregate row comes back to the driver."""
    n, ones = examples.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    ones = ones or 0
    if not 0 < ones < n:
        raise ValueError("training needs examples of both classes")
    weight = F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    return examples.select("*", weight.alias("weight")), n


def featurizer(text: str = "text", dims: int = 384) -> list:
    """Stages from text to a unit vector of hashed words. Any other embedding
    works as well: put a vector column ``features`` in its place."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims),
        Normalizer(inputCol="_counts", outputCol="features"),
    ]


def regression(n: int, c: float = 2.0, max_iter: int = 1000) -> LogisticRegression:
    """Logistic regression whose penalty equals an inverse strength ``c`` on
    ``n`` examples of total weight ``n``."""
    return LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight",
        regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=max_iter, tol=1e-4,
        standardization=False,
    )


def train(examples: DataFrame, text: str = "text", c: float = 2.0) -> PipelineModel:
    weighted, n = balanced(examples)
    return Pipeline(stages=[*featurizer(text), regression(n, c)]).fit(weighted)


def probability_of(model: PipelineModel, text: str = "group_text", least_words: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A classifier for :func:`scan_with` from a trained model. Texts of fewer than ``least_words`` words get null."""
    def add(rows: DataFrame) -> DataFrame:
        source = model.stages[0].getInputCol()
        out = model.transform(rows if source == text else rows.withColumn(source, F.col(text)))
        known = F.when(F.size("_words") >= least_words, round3(vector_to_array("probability")[1]))
        return out.withColumn("probability", known).drop(
            *([] if source == text else [source]), "_words", "_counts", "features", "rawPrediction", "prediction"
        )

    return add


def labelled_groups(df: DataFrame, label: Column, text: str = "content", path: str | None = "file_path") -> DataFrame:
    """Training examples from scanned texts: the distinct string groups around their hits, with ``label``.

    Columns group_key, group_text, group_size, label. A group that comes with both labels is an
    example of each; hits without literals or URLs around them teach nothing and are left out.
    Training reads its examples several times, so they are written once and the texts scanned once.
    """
    rows = scan_contexts(prepared(df, text, path).withColumn("label", label), ("label",), candidate_lines_sql(text))
    rows = rows.where(F.size("string_group") > 0).select(
        "label", F.size("string_group").alias("group_size"), F.array_join("string_group", " ").alias("group_text"),
    ).withColumn("group_key", F.md5("group_text"))
    groups = rows.groupBy("group_key", "label").agg(F.first("group_text").alias("group_text"), F.max("group_size").alias("group_size"))
    return written(groups, "labelled-groups")


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """The model as the scans will load it: written to ``path`` and read back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


# --- cross-validation -------------------------------------------------------

BUCKET_DIGITS = 3


def stratified_folds(
    examples: DataFrame, id: str, label: str = "label", k: int = 5
) -> DataFrame:
    """Adds ``fold``: within each label, examples ordered by a digest of their
    id are dealt out in turn, so every fold has each label's share to within
    one example.

    Labels are few and may be huge, so ranks are made in two steps: within
    (label, leading digest digits), a group of bounded share, and by adding how
    many examples the smaller digits hold, a table of at most labels x 4096
    rows.
    """
    digest = F.md5(F.col(id).cast("string"))
    rows = examples.select("*", digest.alias("_d"), F.substring(digest, 1, BUCKET_DIGITS).alias("_b"))
    sizes = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(label), "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(label, "_b").orderBy("_d", id)
    ranked = rows.select("*", F.row_number().over(inside).alias("_r"))
    joined = ranked.join(F.broadcast(offsets), [label, "_b"])
    fold = (F.col("_before") + F.col("_r") - 1) % k
    return joined.select("*", fold.cast("int").alias("fold")).drop("_d", "_b", "_n", "_r", "_before")


def cross_validate(folded: DataFrame, text: str = "text", c: float = 2.0, k: int = 5) -> DataFrame:
    """Held-out confusion counts and rates, one row per fold."""
    vectors = Pipeline(stages=featurizer(text)).fit(folded).transform(folded).select(
        "features", "label", "fold"
    ).persist()
    held_out = None
    for i in range(k):
        weighted, n = balanced(vectors.where(F.col("fold") != i))
        judged = regression(n, c).fit(weighted).transform(vectors.where(F.col("fold") == i)).select(
            "fold",
            (F.col("prediction") == 1.0).alias("detected"),
            (F.col("label") == 1).alias("is_secret"),
        )
        held_out = judged if held_out is None else held_out.unionByName(judged)
    counts = written(confusion(held_out, "fold"), "folds")
    vectors.unpersist()
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the folds, as one row."""
    return folds.agg(
        F.avg("f1").alias("cv_f1_mean"), F.stddev_pop("f1").alias("cv_f1_std"),
        F.avg("accuracy").alias("cv_accuracy"), F.avg("precision").alias("cv_precision"),
        F.avg("recall").alias("cv_recall"),
    )


def metadata(examples: DataFrame, summary: DataFrame) -> DataFrame:
    """Model metadata as one row, for the JSON sink."""
    counts = examples.agg(
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(F.col("label") == 0).alias("n_negative"),
        F.count("*").alias("n_total"),
    )
    one = F.lit(1).alias("_one")
    return (
        counts.select("*", one).join(summary.select("*", one), "_one").drop("_one").select(
            F.lit("hashed words").alias("embedding_model"),
            F.lit("LogisticRegression").alias("classifier"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("trained_at"),
            "*",
            F.create_map(F.lit("0"), F.lit("false_positive"), F.lit("1"), F.lit("real_secret")).alias("labels"),
        )
    )


def class_balance(examples: DataFrame, label: str = "label") -> DataFrame:
    return examples.groupBy(label).agg(F.count("*").alias("n"))


__all__ = [
    "balanced", "class_balance", "context_similarity", "cross_validate", "cv_summary",
    "featurizer", "hit_contexts", "labelled_groups", "metadata", "probability_of", "regression",
    "saved", "scan_with", "stratified_folds", "train",
]
