"""Language identification (operator 6).

Sparse multinomial logistic regression over TF-IDF weighted character 1- to 3-grams of words,
fitted by follow-the-regularised-leader with elastic-net penalties, then calibrated by one
temperature on rows kept from the fit. Document frequencies come from all labelled texts; the
regression is fitted on a sample of them, equally many per language: ``SAMPLE`` rows in all, but ``EACH``
per language where that is more. Every language is learned, so the sample and the weights grow with
their number, not with the rows.

Results in edge cases: a null text, or one without letters, is ``und`` with score 0. Without any
labelled row every text is ``und``. Null doc_ids count as the empty string where rows are
assigned. Repeated rows get equal results; ties go to the language first in the alphabet. Rows
with a null language are never learned from. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features, labelled rows that the regression is fitted on, and rows per language at least.
FEATURES, SAMPLE, EACH = 1 << 15, 1600, 200
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-3, 3
NONE = "und"
AT_ONCE = 1 << 19


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and hashed n-grams of each text that has letters."""
    lengths = np.asarray(pc.fill_null(pc.utf8_length(column), 0), np.int64)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), AT_ONCE, side="right")) + at)
        texts = [t or "" for t in pc.utf8_lower(column.slice(at, upto - at)).to_pylist()]
        codes = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] = True
        bounds = np.concatenate([[0], np.cumsum(keep)[ends - 1]])
        codes, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), letter[keep]
        rows = np.searchsorted(bounds, np.arange(len(codes)), side="right") - 1
        with np.errstate(over="ignore"):
            one = codes * np.uint64(0x9E3779B97F4A7C15)
            two = one[:-1] * np.uint64(0xD1342543DE82EF95) + codes[1:]
            three = two[:-1] * np.uint64(0x2545F4914F6CDD1D) + codes[2:]
            found = [(one, letter, 0), (two, letter[:-1] | letter[1:], 0), (three, letter[1:-1], 1)]
            feats, owners = [], []
            for values, good, middle in found:
                values = values[good]
                values = (values ^ (values >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                feats.append((values >> np.uint64(49)).astype(np.int64))
                place = np.flatnonzero(good) + middle
                if values.size and len(good) == len(letter) - 1:  # of a pair, the letter's row
                    place = np.where(letter[place], place, place + 1)
                owners.append(rows[place])
        starts = [np.searchsorted(o, np.arange(len(texts) + 1)) for o in owners]
        for i in range(len(texts)):
            own = np.concatenate([f[s[i] : s[i + 1]] for f, s in zip(feats, starts, strict=True)])
            if len(own):
                yield at + i, own
        at = upto


def _vector(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams, minlength=FEATURES)
    at = np.flatnonzero(counts)
    weights = (1 + np.log(counts[at])) * idf[at]
    return at, weights / np.sqrt(weights @ weights)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, texts = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        for _, grams in _grams(batch.column("text")):
            seen[:FEATURES] += np.bincount(grams, minlength=FEATURES) > 0
            texts += 1
    seen[FEATURES] = texts
    at = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["feature", "n"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams in _grams(batch.column("text")):
                at, weights = _vector(grams, idf)
                yield pa.record_batch(
                    [batch.column("lang").slice(row, 1), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([weights.astype(np.float32)], pa.list_(pa.float32()))],
                    ["lang", "at", "weights"],
                )

    return run


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int) -> np.ndarray:
    """Weights (features, classes) after EPOCHS passes over sparse rows (indices, values, class)."""
    z, n, weights = (np.zeros((features, classes)) for _ in range(3))
    for _ in range(EPOCHS):
        for at, values, label in rows:
            own_z, own_n = z[at], n[at]
            w = np.where(np.abs(own_z) > L1, (np.sign(own_z) * L1 - own_z) / ((BETA + np.sqrt(own_n)) / ALPHA + L2), 0)
            error = _softmax(values @ w)
            error[label] -= 1
            gradient = np.outer(values, error)
            more = own_n + gradient**2
            z[at] = own_z + gradient - (np.sqrt(more) - np.sqrt(own_n)) / ALPHA * w
            n[at] = more
    np.copyto(weights, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), where=np.abs(z) > L1)
    return weights


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm.

    The targets leave 1 / (rows + 2) to the other classes, so faultless rows don't drive it to zero.
    """
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        logs = np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))
        return -(logs * targets).sum(1).mean()

    rest = 1 / (len(labels) + 2)
    targets = np.full(logits.shape, rest / max(1, logits.shape[1] - 1))
    targets[np.arange(len(labels)), labels] = 1 - rest if logits.shape[1] > 1 else 1

    low, high, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labelled`` (doc_id, text, lang); the fit itself reads about ``sample`` rows, or EACH per language."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    found = labelled.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = np.zeros(FEATURES + 1)
    for r in found.collect():  # at most FEATURES + 1 rows
        seen[r["feature"]] = r["n"]
    idf = np.log((1 + seen[FEATURES]) / (1 + seen[:FEATURES])) + 1
    sizes = labelled.groupBy("lang").count().collect()  # one row per language
    languages = sorted(r["lang"] for r in sizes)
    each = max(EACH, sample // max(1, len(sizes)))
    rows = []
    if sizes:
        spark = labelled.sparkSession
        shares = spark.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in sizes], "lang string, share double")
        # a large group of copies is drawn in its share; the limit holds whatever the rows are
        draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
        picked = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share")).limit(2 * each * len(sizes))
        for r in picked.select("text", "lang").mapInArrow(_vectors(idf), "lang string, at array<int>, weights array<float>").collect():
            rows.append((np.array(r["at"]), np.array(r["weights"], float), languages.index(r["lang"])))
    rows.sort(key=lambda r: (float(r[1][0]), len(r[0]), r[2]))
    np.random.default_rng(7).shuffle(rows)
    held, kept = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    weights = ftrl(kept, FEATURES, len(languages))
    logits = np.array([v @ weights[at] for at, v, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights.astype(np.float32), temperature(logits, np.array([r[2] for r in held], int)))


def identify(model: Model, text: Column, spark) -> Column:
    """struct<lang string, score double> of a text column."""
    shared = spark.sparkContext.broadcast(model)  # its size is set by FEATURES and the languages

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(column: pa.Array) -> pa.Array:
        own = shared.value
        names, scores = [NONE] * len(column), np.zeros(len(column))
        if own.languages:
            for row, grams in _grams(column):
                at, weights = _vector(grams, own.idf)
                p = _softmax(weights @ own.weights[at] / own.temperature)
                names[row], scores[row] = own.languages[int(p.argmax())], min(1.0, float(p.max()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    return run(text)


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
