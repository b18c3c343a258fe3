"""Best-fit packing of token ids into fixed-length sequences (operator 7).

Texts become ids, closed by id 0, and longer ones are cut into pieces. Packing is bulk
synchronous over size classes: a length has at most ``capacity`` values and so has a gap. Each
round takes one length class, largest first, and sweeps it over the gap classes by successor
(smallest gap that fits); all its pieces are matched at once, conflicts are resolved by a piece's
rank in its class, the gaps are updated, and the next round follows. The rounds are those of
best-fit decreasing, and see counts only; pieces get their rank and place in distributed jobs.

Results in edge cases: a null or empty text is the single id 0. Null and repeated doc_ids are
kept, one set of pieces per row. Equal pieces are ranked by doc_id and piece; ties may fall either
way. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credscan.llm.cluster import cut
from credscan.llm.token_counts import byte_letters
from credscan.llm.words import _LOWER, _SPACE, _spans, hash_spans, text_bytes

CAPACITY = 2048
#: Words whose ids a worker remembers, and text bytes it works on at a time.
REMEMBERED, AT_ONCE = 400_000, 1 << 21
#: Pieces of one length that are ranked together.
RANKED = 10_000
_CLOSING = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))
#: What byte-level vocabularies write for each byte.
_LETTERS = {byte: letter for letter, byte in byte_letters().items()}


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _atoms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with closing punctuation after a letter as spans of their own.

    The tokenizer parts letters from punctuation, so the ids of a word are those of its parts.
    """
    stem = ends.copy()
    for _ in range(8):
        more = _CLOSING[data[stem - 1]] & (stem - starts > 1)
        if not more.any():
            break
        stem[more] -= 1
    last, before = data[stem - 1], data[np.maximum(stem - 2, 0)]
    latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    parted = (stem < ends) & (_LETTER[last] | latin)
    stem = np.where(parted, stem, ends)
    return np.sort(np.concatenate([starts, stem[parted]])), np.sort(np.concatenate([stem, ends[parted]]))


class _Ids:
    """Ids of texts through the ids of their words.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its
    words in order. It lowers case, so a slice that spells no special token may be lowered first.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.known: dict[int, bytes] = {}

    def _learn(self, keys: list[int], words: list[str]) -> None:
        """A word of Latin letters in composed form goes straight to the merges; the others the whole way."""
        other, merges = [], self.tokenizer.model.tokenize
        for key, word in zip(keys, words, strict=True):
            if word.isascii() and word.isalpha() and word.islower():
                ids = [t.id for t in merges(word)]
            elif word.isalpha() and max(word) < "\u0250" and word.lower().isalpha() and is_normalized("NFC", word):
                ids = [t.id for t in merges(word.lower().encode().decode("latin-1").translate(_LETTERS))]
            else:
                other.append((key, word))
                continue
            self.known[key] = np.array(ids, np.uint32).tobytes()
        found = self.tokenizer.encode_batch_fast([w for _, w in other], add_special_tokens=False)
        for (key, _), own in zip(other, found, strict=True):
            self.known[key] = np.array(own.ids, np.uint32).tobytes()

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by id 0, and their bounds."""
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        if b"<|" not in raw:
            data = _LOWER[data]
            raw = data.tobytes()
        starts, ends = _atoms(data, *_spans(data, offsets, _SPACE))
        hashes, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        at = first[new].tolist() if new else []
        self._learn([keys[i] for i in new], [raw[starts[k] : ends[k]].decode() for k in at])
        pool = [self.known[h] for h in keys]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        flat = np.frombuffer(b"".join(pool), np.uint32)
        begin = np.cumsum(sizes) - sizes
        taken = sizes[inverse]
        ends_of = np.cumsum(taken)
        ids = flat[np.repeat(begin[inverse] - (ends_of - taken), taken) + np.arange(ends_of[-1] if len(taken) else 0)]
        word_bounds = np.searchsorted(starts, offsets)
        bounds = np.concatenate([[0], ends_of])[word_bounds]
        return np.insert(ids, bounds[1:], 0), bounds + np.arange(len(bounds))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Row ranges of about AT_ONCE text bytes."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def _cut_up(path: str, capacity: int, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Ids(path)
        for batch in batches:
            for part in _slices(batch, "text"):
                ids, bounds = encoder.of(part.column("text"))
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for piece, at in enumerate(range(a, b, capacity)):
                        own = ids[at : min(at + capacity, b)]
                        crc = zlib.crc32(own.astype("<u4").tobytes())
                        rows.append((doc, piece, at - a, len(own), crc, own if keep_ids else None))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns[:5], _TYPES, strict=True)]
                if keep_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                yield pa.record_batch(arrays, _NAMES + ["ids"] * keep_ids)

    return run


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every row of ``docs`` (doc_id, text); ``keep_ids`` adds the ids themselves."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_cut_up(tokenizer, capacity, keep_ids), schema)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go, by rank, as rows of

    length, first rank, pieces per sequence, first sequence, offset within the sequence.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    open_: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    gaps: list[int] = []  # those of open_, ascending
    sequences = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not open_[gap]:
                insort(gaps, gap)
            open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_[gap].pop()
                if not open_[gap]:
                    gaps.pop(at)
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = gap // length
            whole = min(n, left // each)
            for m, some, skip in ((each, whole, 0), (left - whole * each, 1, whole)):
                if some and m and skip < n and left:
                    placed.append((length, rank, m, first + skip, capacity - gap))
                    add(gap - m * length, first + skip, some)
                    rank, left, n_used = rank + m * some, left - m * some, skip + some
            add(gap, first + n_used, n - n_used)
    return np.array(placed, np.int64).reshape(-1, 5)


def _place(rows: np.ndarray) -> Callable:
    """Looks up each piece's sequence and offset; ``rows`` has at most a few entries per size class."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 44) + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = rows[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            sequence, offset = own[:, 3] + nth // own[:, 2], own[:, 4] + nth % own[:, 2] * length
            kept = batch.drop_columns(["rank"])
            yield pa.record_batch([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset; no sequence exceeds ``capacity``."""
    rows = cut(rows)
    spark = rows.sparkSession
    lengths = rows.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in lengths}
    slots = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, slots long")
    spread = rows.join(F.broadcast(slots), "length").withColumn(
        "slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "slots")
    ).drop("slots")
    before = Window.partitionBy("length").orderBy("slot")
    starts = spread.groupBy("length", "slot").agg(F.count("*").alias("n")).select(
        "length", "slot", (F.sum("n").over(before) - F.col("n")).alias("before")
    )
    within = Window.partitionBy("length", "slot").orderBy("doc_id", "piece")
    ranked = (
        spread.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "slot"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    )
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ("ids" in rows.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*fields).schema)
    return ranked.select(*fields, "rank").mapInArrow(
        _place(plan(counts, capacity)), f"{schema}, sequence_id long, offset long"
    )
