"""Language-model scores by deleted interpolation (operator 1).

Maximum-likelihood estimates of bigrams, unigrams and the uniform distribution are mixed with
weights that depend on how often the context was seen (a bucket per power of two). The weights
are learned by expectation-maximisation on training documents that are left out of the counts
meanwhile (``LEFT_OUT`` of ten); the final counts are of all training documents.

Texts are dealt into chunks by hash. A chunk sends its distinct n-grams with their counts to the
buckets of the n-gram hash space, as packed arrays; a bucket adds them up and answers each chunk
with those counts that the chunk can't know by itself. So every count is over the whole corpus, a
frequent n-gram costs one entry a chunk, and no task holds more than a chunk or a bucket; both are
as many as the session's shuffle partitions, times ``CHUNKS`` for chunks.

Words are runs outside ASCII white space, A-Z lowered; a text ends with one end token. Unigrams
are told apart by 64-bit hashes, bigrams by 48 bits within their bucket.

Results in edge cases: null and empty texts are the end token alone. A null doc_id counts as the
empty string where documents are assigned. Repeated rows each count and each get a row. Without
training documents both scores are 0. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credscan.llm.cluster import cut, partitions
from credscan.llm.language import remainder
from credscan.llm.words import mix, word_hashes

CHUNKS = 2
#: Tenths of the training documents that the weights are learned on.
LEFT_OUT = 1
ROUNDS, BUCKETS = 15, 64
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LOW = np.uint64((1 << 48) - 1)
#: What a document is for the counts.
TEST, KEPT, LEFT = 0, 1, 2


def _stream(text: pa.ChunkedArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the tokens and bigrams of all texts, and the first token of each text."""
    hashes, bounds = word_hashes(text)
    tokens = np.insert(hashes, bounds[1:], END)
    bounds = bounds + np.arange(len(bounds))
    before = np.concatenate([[BEGIN], tokens[:-1]]).astype(np.uint64)
    before[bounds[:-1]] = BEGIN
    with np.errstate(over="ignore"):
        pairs = mix(before * np.uint64(0xD1342543DE82EF95) + tokens)
    return tokens, _bucket(pairs, buckets) << np.uint64(48) | pairs & _LOW, bounds


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as the first and the steps between them, in as few bytes each as the largest needs."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros((1 + (len(data) - 9) // width, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8, 1)
    wide[1:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in eight."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


_COUNTED = "level int, bucket int, chunk int, grams binary, kept binary, left_out binary"
_ANSWERED = f"{_COUNTED}, types long, kept_tokens long, left_tokens long"


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in names.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _counts(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        tokens, pairs, bounds = _stream(group.column("text"), buckets)
        part = np.repeat(group.column("part").to_numpy(), np.diff(bounds))
        rows = []
        for level, keys in ((1, tokens), (2, pairs)):
            order = np.argsort(keys)
            own, sorted_part = keys[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            kept, left = (np.add.reduceat(sorted_part == p, first, dtype=np.uint32) for p in (KEPT, LEFT))
            own = own[first]
            of = (_bucket(own, buckets) if level == 1 else own >> np.uint64(48)).astype(np.int64)
            ends = np.searchsorted(of, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                part_ = slice(ends[b], ends[b + 1])
                rows.append((level, int(b), chunk, _packed(own[part_]), _small(kept[part_]), _small(left[part_])))
        return _table(rows, _COUNTED)

    return run


def _answers(group: pa.Table) -> pa.Table:
    """Totals for the chunks that can't know them, and for each chunk's left-out n-grams."""
    level, bucket = group.column("level")[0].as_py(), group.column("bucket")[0].as_py()
    keys = [_unpacked(g) for g in group.column("grams").to_pylist()]
    sizes = [len(k) for k in keys]
    chunk, keys = np.repeat(group.column("chunk").to_numpy(), sizes), np.concatenate(keys)
    kept, left = (
        np.concatenate([_large(x, n) for x, n in zip(group.column(c).to_pylist(), sizes, strict=True)])
        for c in ("kept", "left_out")
    )
    order = np.argsort(keys)
    keys, chunk, kept, left = keys[order], chunk[order], kept[order], left[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    all_kept, all_left = np.add.reduceat(kept, first), np.add.reduceat(left, first)
    rows = []
    if level == 1:
        rows.append((level, bucket, -1, b"", b"", b"", int((all_kept + all_left > 0).sum()), int(all_kept.sum()), int(all_left.sum())))
    all_kept, all_left = np.repeat(all_kept, sizes), np.repeat(all_left, sizes)
    asked = np.flatnonzero((all_kept != kept) | (all_left != left) | ((left > 0) & (all_kept > 0)))
    asked = asked[np.argsort(chunk[asked], kind="stable")]
    ends = np.flatnonzero(np.concatenate([[True], chunk[asked][1:] != chunk[asked][:-1], [True]])) if len(asked) else []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = asked[a:b]
        rows.append((
            level, bucket, int(chunk[own[0]]), _packed(keys[own]), _small(all_kept[own]), _small(all_left[own]), 0, 0, 0,
        ))
    return _table(rows, _ANSWERED)


def _answered(answers: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, kept and left-out counts of a chunk's answers, ascending by key."""
    rows = [r for r in answers.to_pylist() if r["level"] == level]
    keys = [_unpacked(r["grams"]) for r in rows]
    kept, left = (
        np.concatenate([_large(r[c], len(k)) for r, k in zip(rows, keys, strict=True)] or [np.zeros(0, np.int64)])
        for c in ("kept", "left_out")
    )
    keys = np.concatenate(keys or [np.zeros(0, np.uint64)])
    order = np.argsort(keys)
    return keys[order], kept[order], left[order]


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(known, keys).clip(max=len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


def _context(counts: np.ndarray, bounds: np.ndarray, ends: int) -> np.ndarray:
    """How often what stands before each token was a context: as often as the token itself."""
    before = np.concatenate([[0], counts[:-1]])
    before[bounds[:-1]] = ends
    return before


def _seen(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 if unseen, else 1 + its logarithm to the base 2."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1).astype(float))[1], 0)


def _left_out(buckets: int):
    """What the estimates from kept documents give the tokens of left-out ones, with multiplicity."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, ["pair", "context", "token", "n"])
        tokens, pairs, bounds = _stream(group.column("text"), buckets)
        one, two = _answered(answers, 1), _answered(answers, 2)
        count = _looked_up(tokens, *one[:2])
        pair = _looked_up(pairs, *two[:2])
        context = _context(count, bounds, int(_looked_up(np.array([END]), *one[:2])[0]))
        rows, n = np.unique(np.stack([pair, context, count], 1), axis=0, return_counts=True)
        return pa.table([*(pa.array(rows[:, i]) for i in range(3)), pa.array(n)], ["pair", "context", "token", "n"])

    return run


def _mixed(weights: np.ndarray, pair, context, count, total: int, types: int):
    seen = _seen(context)
    two = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    return weights[seen, 0] * two + weights[seen, 1] * (count / max(1, total)) + weights[seen, 2] / (types + 1)


def _scores(buckets: int, weights: np.ndarray, total: int, types: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        tokens, pairs, bounds = _stream(group.column("text"), buckets)
        part = group.column("part").to_numpy()
        train = np.repeat(part != TEST, np.diff(bounds))
        counts = []
        for level, keys in ((1, tokens), (2, pairs)):
            own, inverse = np.unique(keys, return_inverse=True)
            local = np.bincount(inverse, weights=train, minlength=len(own)).astype(np.int64)
            known, kept, left = _answered(answers, level)
            local[np.searchsorted(own, known)] = kept + left
            counts.append(local[inverse])
        count, pair = counts
        # every text ends, so the count of the end token stands at each text's last place
        context = _context(count, bounds, int(count[bounds[1] - 1]))
        own = np.log10(_mixed(weights, pair, context, count, total, types))
        base = np.log10((count + 1) / (total + types + 1))
        sums = [np.add.reduceat(x, bounds[:-1]) for x in ((count > 0).astype(np.int64), base, own)]
        n = len(part)
        return pa.table(
            [group.column("doc_id"), pa.array(part == TEST), pa.array(np.diff(bounds)), pa.array(sums[0]),
             pa.array(np.full(n, total)), pa.array(sums[1]), pa.array(sums[2])], names,
        )

    return run


def learned(tuples: DataFrame, total: int, types: int) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimates per bucket of context counts.

    Every round is one aggregation of all left-out tokens into at most BUCKETS rows. Half a count
    is added to each weight; buckets without left-out tokens take the weights of all together.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0, 0] = 0
    weights /= weights.sum(1, keepdims=True)
    two = F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0)
    seen = F.when(F.col("context") > 0, F.length(F.bin("context"))).otherwise(0)  # as _seen has it
    parts = [two, F.col("token") / max(1, total), F.lit(1 / (types + 1))]
    for _ in range(ROUNDS):
        own = [F.element_at(F.array(*map(F.lit, weights[:, i].tolist())), seen + 1) * p for i, p in enumerate(parts)]
        shares = tuples.select(seen.alias("seen"), "n", *[x.alias(f"c{i}") for i, x in enumerate(own)])
        every = F.col("c0") + F.col("c1") + F.col("c2")
        sums = shares.groupBy("seen").agg(*[F.sum(F.col("n") * F.col(f"c{i}") / every).alias(f"c{i}") for i in range(3)])
        found = np.zeros((BUCKETS, 3))
        for r in sums.collect():
            found[r["seen"]] = r["c0"], r["c1"], r["c2"]
        pooled = found.sum(0)
        found = np.where(found.sum(1, keepdims=True) > 0, found, pooled / max(1.0, pooled.sum())) + 0.5
        found[0, 0] = 0
        before, weights = weights, found / found.sum(1, keepdims=True)
        if np.abs(weights - before).max() < 1e-4:
            break
    return weights


def scores(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of ``docs`` (doc_id, text).

    Documents whose crc32(doc_id as text) mod ``modulus`` is ``held_out`` are not learned from.
    """
    spark = docs.sparkSession
    buckets = min(partitions(spark), 1 << 16)
    left = F.pmod(F.xxhash64("doc_id", F.lit("left out")), F.lit(10)) < LEFT_OUT
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.when(remainder(docs["doc_id"], modulus) == held_out, TEST).when(left, LEFT).otherwise(KEPT).alias("part"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets * CHUNKS)).cast("int").alias("chunk"),
    )
    counted = rows.groupBy("chunk").applyInArrow(_counts(buckets), _COUNTED)
    answers = cut(counted.groupBy("level", "bucket").applyInArrow(_answers, _ANSWERED))
    sums = answers.agg(F.sum("types"), F.sum("kept_tokens"), F.sum("left_tokens")).first()
    types, kept, left_tokens = (int(x or 0) for x in sums)
    answers = answers.where("chunk >= 0").select("chunk", "level", "bucket", "grams", "kept", "left_out").groupBy("chunk")
    tuples = cut(
        rows.where(F.col("part") == LEFT).groupBy("chunk").cogroup(answers)
        .applyInArrow(_left_out(buckets), "pair long, context long, token long, n long")
        .groupBy("pair", "context", "token").agg(F.sum("n").alias("n"))
    )
    weights = learned(tuples, kept, types) if types else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answers).applyInArrow(_scores(buckets, weights, kept + left_tokens, types), schema)
