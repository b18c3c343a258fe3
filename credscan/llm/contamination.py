"""Benchmark decontamination (operator 5).

The ``K`` least hash values of each item are its MinHash sketch, and the greatest of any item's
bounds the values that a document has to offer. Items are not partitioned by size: one bound, one
bitmap and one join on the value serve them all. The share of an item's sketch found in a
document estimates its containment there, however long the document; exact containment of the
item's whole shingle set confirms. Documents test their values on a bitmap of fixed size, so what
tasks receive doesn't grow with the items, and only hits are shuffled.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered; shingles have five. An
item with fewer words is one shingle of them all, which only a text of just these words contains.

Results in edge cases: null, empty or wordless texts match nothing on either side. Null doc_ids
and item_ids are kept and reported as null. Rows repeating both doc_id and text, or both item_id
and text, are reported once. An empty table gives an empty result. Other columns are ignored by
``contained`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credscan.llm.cluster import cut
from credscan.llm.words import shingles, word_hashes

WIDTH = 5
SHARE = (4, 5)
#: Hash values in an item's sketch.
K = 32
#: Bits of the bitmap per sketch value, and its greatest size (32 MB).
SPREAD, MOST_BITS = 4096, 1 << 28


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts with repetitions, and the text of each."""
    values, bounds = shingles(*word_hashes(column, alphanumeric=True), WIDTH)
    return values, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, owner = _sets(batch.column("text"))
        sets = [np.unique(values[owner == i]) for i in range(batch.num_rows)]
        yield pa.record_batch(
            [batch.column("item_id"), batch.column("item"), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "item", "shingles"]
        )


def _hits(words: dict[int, int], bits: int, bounds: list[int]):
    """Values of each document that are within the greatest bound and on the bitmap."""
    top = max(bounds, default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 64, np.uint64)
        bitmap[list(words)] = np.array(list(words.values()), np.int64).view(np.uint64)
        bitmap = bitmap.view(np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values, owner = _sets(part.column("text"))
                low = values & (bits - 1)
                hit = np.flatnonzero((bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool) & (values <= top))
                found = np.unique(np.stack([owner[hit], values[hit]], 1), axis=0)
                own = pa.array(found[:, 0])
                yield pa.record_batch(
                    [part.column("doc_id").take(own), part.column("text_hash").take(own), pa.array(found[:, 1])],
                    ["doc_id", "text_hash", "value"],
                )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of each text and item, exactly."""
    for batch in batches:
        shared = []
        for i in range(batch.num_rows):
            own = np.unique(_sets(batch.column("text").slice(i, 1))[0])
            item = batch.column("shingles").slice(i, 1).flatten().to_numpy()
            shared.append(len(np.intersect1d(own, item, assume_unique=True)))
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "text_hash", "item_id", "n_item_shingles")), pa.array(shared, pa.int64())],
            ["doc_id", "text_hash", "item_id", "n_item_shingles", "n_shared"],
        )


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_item_shingles, n_shared, containment of each item within a document.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    sets = cut(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_id", "text").alias("item"), "text")
        .mapInArrow(_items, "item_id long, item long, shingles array<long>")
        .where("size(shingles) > 0").dropDuplicates(["item"])
        .withColumn("n_item_shingles", F.size("shingles").cast("long"))
        .withColumn("sketch", F.slice("shingles", 1, K))
    )
    by_class = sets.groupBy(F.floor(F.log2("n_item_shingles")).alias("class")).agg(
        F.max(F.element_at("sketch", -1)).alias("bound"), F.sum(F.size("sketch")).alias("n")
    ).collect()  # one row per power of two
    n = sum(r["n"] for r in by_class)
    bits = min(MOST_BITS, 1 << max(16, ceil(log2(SPREAD * max(1, n)))))
    values = sets.select("item", "item_id", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    place = F.col("value").bitwiseAND(F.lit(bits - 1))
    words = values.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(value & 63 as int))")).alias("bits")
    ).collect()  # at most bits / 64 rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    run = _hits({r["word"]: r["bits"] for r in words}, bits, [r["bound"] for r in by_class])
    hits = rows.mapInArrow(run, "doc_id long, text_hash long, value long").distinct()
    expected = F.col("m") * (SHARE[0] / SHARE[1])
    enough = F.greatest(F.lit(1), F.floor(expected - 5 * F.sqrt(F.col("m") * 0.16)))
    found = cut(
        hits.join(values, "value").groupBy("doc_id", "text_hash", "item", "m").agg(F.count("*").alias("n"))
        .where(F.col("n") >= enough).select("doc_id", "text_hash", "item")
    )
    same = (F.col("t.text_hash") == F.col("f.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("f.doc_id"))
    texts = rows.alias("t").join(found.select("doc_id", "text_hash").distinct().alias("f"), same, "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    same = (F.col("t.text_hash") == F.col("f.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("f.doc_id"))
    both = (
        texts.alias("t").join(found.alias("f"), same).select("t.doc_id", "t.text_hash", "t.text", "f.item")
        .join(sets.drop("sketch"), "item")
    )
    counted = both.mapInArrow(
        _verified, "doc_id long, text_hash long, item_id long, n_item_shingles long, n_shared long"
    )
    return counted.where(f"n_shared * {SHARE[1]} >= n_item_shingles * {SHARE[0]}").withColumn(
        "containment", F.col("n_shared") / F.col("n_item_shingles")
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain an item, in all its columns."""
    bad = contained(docs, items).select("doc_id", "text_hash").distinct().alias("b")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = (F.xxhash64("row.text") == F.col("b.text_hash")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("b.doc_id"))
    return rows.join(bad, same, "left_anti").select("row.*")
