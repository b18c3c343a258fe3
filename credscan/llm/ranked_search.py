"""Ranked lexical search (operator 13): accumulator-limited, a level of terms at a time.

An inverted view of the documents holds, per document, the terms that queries ask for. Terms are
taken rarest first, in levels that double the document frequency, and each adds its contributions
to accumulators, one per (query, document). After each level the ``k`` best partial scores of a
query are completed to exact scores; the kth of these is its floor, as the final kth score can't be
lower. Once the bounds of the terms that remain (each term's greatest contribution anywhere) cannot
reach the floor, no accumulators are made for that query any more; those whose partial score and
remaining bounds stay below the floor are dropped, and the survivors are completed exactly. No
document that could be among the best is left out, so the ranking is that of scoring all documents.

Documents pass a bitmap of query terms of fixed size before the exact join on the term, so what is
shipped does not grow with the queries. Terms are compared by 64-bit hashes.

Results in edge cases: null and empty texts have no terms; as documents they don't count, as
queries they find nothing. Rows that repeat a doc_id are documents of their own, rows that repeat
an item_id are queries of their own. Equal scores go by doc_id, nulls last, then by length; fewer
than ``k`` documents with a score above 0 give fewer rows. Very long texts are read whole. Empty
tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credscan.llm.cluster import cut
from credscan.llm.packing import _slices
from credscan.llm.words import word_hashes

K = 20
#: Bits of the bitmap of query terms.
BITS = 1 << 21
#: Document frequency up to which terms are of the first level.
FIRST = 1000
#: Rows up to which a table of queries, terms or candidates is broadcast (at most 40 bytes each).
SMALL = 200_000


def _counted(bitmap: np.ndarray | None) -> Callable:
    """Number of terms of each text, and its distinct terms that the bitmap lets pass, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                hashes, bounds = word_hashes(part.column("text"), alphanumeric=True)
                rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                if bitmap is not None:
                    pass_ = bitmap[hashes & np.uint64(BITS - 1)]
                    hashes, rows = hashes[pass_], rows[pass_]
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                first = np.ones(len(rows), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(first)
                offsets = np.searchsorted(rows[at], np.arange(part.num_rows + 1)).astype(np.int32)
                counts = np.diff(np.append(at, len(rows)))
                yield pa.record_batch(
                    [
                        part.column("id"), pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[at].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int64))),
                    ],
                    ["id", "n", "terms", "counts"],
                )

    return run


def _terms(texts: DataFrame, key: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """id, n, terms, counts and a row number ``row`` of each text that has a term, written once."""
    rows = texts.select(F.col(key).cast("long").alias("id"), "text")
    found = rows.mapInArrow(_counted(bitmap), "id long, n long, terms array<long>, counts array<long>").where("n > 0")
    return cut(found.select("id", F.monotonically_increasing_id().alias("row"), "n", "terms", "counts"))


def _entries(index: DataFrame, *keep: str) -> DataFrame:
    return index.select(*keep, F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(
        *keep, F.col("e.terms").alias("term"), F.col("e.counts").alias("tf")
    )


def _light(df: DataFrame) -> DataFrame:
    """``df``, which is written already, for broadcasting if it is small; else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each of ``queries`` (item_id, text).

    Columns item_id, rank (from 1), doc_id, score.
    """
    asked = _terms(queries, "item_id")
    wanted = _entries(asked, "row").select((F.col("term").bitwiseAND(BITS - 1)).cast("int").alias("bit")).distinct()
    bitmap = np.zeros(BITS, bool)
    bitmap[[r["bit"] for r in wanted.collect()]] = True  # BITS rows at most
    index = _terms(docs, "doc_id", bitmap)
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the size term needs more than 64 bits on the way for very many documents
    sized = f"75L + (cast(n as decimal(19,0)) * {25 * n_docs}BD) div {max(n_terms, 1)}BD"
    index = index.withColumn("m", F.expr(sized).cast("long"))

    def impacts(rows: DataFrame, *keep: str) -> DataFrame:
        """Each document's entries with what one unit of a term's weight gives."""
        return _entries(rows, *keep, "m").withColumn("impact", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")).drop("m", "tf")

    asks = _entries(asked, "row").withColumnsRenamed({"row": "query", "tf": "repeats"})
    vocabulary = _light(cut(asks.select("term").distinct()))
    terms = impacts(index, "row").join(vocabulary, "term").groupBy("term").agg(
        F.count("*").alias("df"), F.max("impact").alias("peak")
    )
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asks.join(terms, "term").withColumn("weight", weight * F.col("repeats")).select(
        "query", "term", "weight", (F.col("weight") * F.col("peak")).alias("bound"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / FIRST))).cast("int").alias("level"),
    )
    weighted = cut(weighted.where("weight > 0"))
    every = _light(weighted.select("query", "term", "weight"))
    best = Window.partitionBy("query").orderBy(F.desc("score"))

    def completed(pairs: DataFrame) -> DataFrame:
        """Exact scores of (query, row) pairs; ``pairs`` is written already."""
        rows = index.join(_light(pairs), "row")
        return impacts(rows, "query", "row", "id", "n").join(every, ["query", "term"]).groupBy("query", "row", "id", "n").agg(
            F.sum(F.col("weight") * F.col("impact")).alias("score")
        )

    levels = sorted(r["level"] for r in weighted.select("level").distinct().collect())  # log2 of the documents at most
    open_ = weighted.select("query").distinct()
    held, done = None, []
    for level in levels:
        now = cut(weighted.where(F.col("level") == level).join(open_, "query", "left_semi").select("query", "term", "weight"))
        more = impacts(index, "row").join(_light(now), "term").groupBy("query", "row").agg(
            F.sum(F.col("weight") * F.col("impact")).alias("score")
        )
        held = cut(more if held is None else held.unionByName(more).groupBy("query", "row").agg(F.sum("score").alias("score")))
        top = cut(held.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "row"))
        floors = completed(top).groupBy("query").agg(
            F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("floor")
        )
        rest = weighted.where(F.col("level") > level).groupBy("query").agg(F.sum("bound").alias("rest"))
        state = open_.join(floors, "query", "left").join(rest, "query", "left").select(
            "query", F.coalesce("floor", F.lit(0)).alias("floor"), F.coalesce("rest", F.lit(0)).alias("rest")
        )
        state = cut(state.withColumn("closed", (F.col("rest") == 0) | (F.col("rest") < F.col("floor"))))
        held = cut(held.join(_light(state), "query").where("score + rest >= floor").select("query", "row", "score", "closed"))
        done.append(held.where("closed").select("query", "row"))
        held = held.where("NOT closed").drop("closed")
        open_ = state.where("NOT closed").select("query")
    if not done:
        return asked.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.union(more)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "n", "row")
    ranked = completed(pairs).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    items = asked.select(F.col("row").alias("query"), F.col("id").alias("item_id"))
    return ranked.join(items, "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
