"""Prefix trie of conversations with subtree sums by centroid decomposition (operator 12).

A node is a distinct sequence of first turns, named by its smallest member and its depth. Turns are
numbered after a range sort, so one conversation may span many tasks, and a sequence is known by
the sum of 120-bit digests of its turns with their places, which blocks of turns add up like any
sum; two sequences meet by chance with odds of about 2 ** -120.

Subtree sums come from centroid decomposition of the parent-edge forest, one level for all
components at a time, by joins while components are large and within tasks from then on. The nodes of a component whose subtrees hold over half of its weight (its
members' turns) form a path from its top; the deepest is the centroid. Its subtree's totals are
one aggregate; they are added to the nodes of that path, centroid included, and the path's weights
shrink by the centroid's. Without the centroid the component falls into the subtrees of its
children and the part above, none with more than half of the weight, and the next level splits
these. There are as many levels as the binary logarithm of the number of turns, however deep or
broad the trie is, and each adds at most a path per component.

Results in edge cases: rows are ordered by turn (null first), equal turns by role and then by a
digest of the text; equal rows are turns of their own. Null role or text is empty. Rows without
conv_id belong to no conversation and are left out. A conversation without turns is a member of the
root alone. Very long texts are read whole, and as digests from then on. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credscan.llm.cluster import cut, partitions

#: Turns of a conversation that are summed together.
BLOCK = 4096
#: Rows up to which a table of centroids is broadcast (at most 40 bytes each).
SMALL = 100_000
#: Nodes up to which a component is finished whole, and the rows of such components that a task takes at a time.
SPLIT, AT_ONCE = 2_000, 100_000
#: Characters of member ids that are handed on in one piece.
PIECE = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def _light(df: DataFrame) -> DataFrame:
    """``df``, which is written already, for broadcasting if it is small; else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and n_bytes of every turn of ``conversations`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "row"]  # row lets equal rows part
    rows = rows.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    rows = cut(rows.select("conv_id", "digest", "n_bytes", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    starts = rows.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part"))  # a row per partition that holds some
    starts = starts.select("conv_id", "part", "first", (upto - F.col("n")).alias("before"))
    return rows.withColumn("part", part).join(starts, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "digest", "n_bytes"
    )


def rebuilt(rows: DataFrame, conversations: DataFrame, shared: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (conv_id, length) of conversations that take their beginning from another.

    The first h turns of conversation c - c % ``shared``, then c's own turns after its first h,
    with h = crc32(c) % ``heads``.
    """
    head = F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {heads} as long)")
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    every = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = every.join(counts, "conv_id").withColumns({"h": head, "base": F.expr(f"conv_id - conv_id % {shared}")})
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    every = cut(
        every.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
        .select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    )
    own = rows.join(every.select("conv_id", "h", "m"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "digest", "n_bytes"
    )
    first = rows.where(F.col("place") < heads).withColumnRenamed("conv_id", "base")
    taken = every.select("conv_id", "base", "h").join(first, "base").where("place < h").select("conv_id", "place", "digest", "n_bytes")
    return own.unionByName(taken), every.select("conv_id", "length")


def _number(digits: Column) -> Column:
    """15 hexadecimal digits as a number."""
    return F.conv(digits, 16, 10).cast("decimal(38,0)")


def occurrences(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each conversation's nodes: conv_id, depth, length, n_bytes and the sequence's sums x and y."""
    rows = rows.withColumn("depth", F.col("place") + 1).withColumn(
        "whole", F.md5(F.concat("digest", F.col("place").cast("string")).cast("binary"))
    )
    rows = rows.select(
        "conv_id", "depth", "n_bytes", F.expr(f"(depth - 1) div {BLOCK}").alias("block"),
        _number(F.substring("whole", 1, 15)).alias("x"), _number(F.substring("whole", 16, 15)).alias("y"),
    )
    sums = rows.groupBy("conv_id", "block").agg(F.sum("x").alias("all_x"), F.sum("y").alias("all_y"))
    before = Window.partitionBy("conv_id").orderBy("block")  # a row per BLOCK turns
    starts = sums.select("conv_id", "block", *[(F.sum(f"all_{c}").over(before) - F.col(f"all_{c}")).alias(f"start_{c}") for c in "xy"])
    within = Window.partitionBy("conv_id", "block").orderBy("depth")
    found = rows.withColumns({c: F.sum(c).over(within) for c in "xy"}).join(starts, ["conv_id", "block"]).join(lengths, "conv_id")
    return found.select(
        "conv_id", "depth", "length", "n_bytes",
        *[(F.col(c) + F.col(f"start_{c}")).cast("decimal(38,0)").alias(c) for c in "xy"],
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted (node, depth, conv_id) rows as pieces of text per node, each with its first id."""
    names, at, held, size = ["node", "depth", "first", "ids"], None, [], 0

    def piece() -> pa.RecordBatch:
        columns = ([at[0]], [at[1]], [held[0]], [",".join(map(str, held))])
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names)

    for batch in batches:
        out = []
        for node, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "conv_id")), strict=True):
            if held and (at != (node, depth) or size > PIECE):
                out.append(piece())
                held, size = [], 0
            at = (node, depth)
            held.append(conv)
            size += 8
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node in turn; only the running digest is held."""
    at, running = None, None
    for batch in batches:
        out = []
        for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
            if at == (node, depth):
                running.update(b"," + ids.encode())
                continue
            if running:
                out.append((*at, running.hexdigest()))
            at, running = (node, depth), hashlib.sha256(ids.encode())
        yield _digests(out)
    if running:
        yield _digests([(*at, running.hexdigest())])


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "depth", "ends_sha256"])


def ends(occurring: DataFrame) -> DataFrame:
    """ends_sha256 of every node at which a conversation ends (node, depth, conv_id).

    Ids are sorted and joined in range partitions, so that the one task that digests a node's ids in
    turn, as SHA-256 asks for, reads long pieces and keeps none.
    """
    n, order = partitions(occurring.sparkSession), ["node", "depth", "conv_id"]
    spread = occurring.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = spread.mapInArrow(_joined, "node long, depth long, first long, ids string")
    sorted_ = pieces.repartition(n, "node", "depth").sortWithinPartitions("node", "depth", "first")
    return sorted_.mapInArrow(_hashed, "node long, depth long, ends_sha256 string")


def _split(top: np.ndarray, depth: np.ndarray, node: np.ndarray, parent: np.ndarray, weight: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums within whole components, all of them at once, each level as in ``subtree_sums``.

    Rows are sorted by component ``top`` (any numbers), depth and node.
    """
    n = len(node)
    names, ids = np.unique(np.concatenate([node, parent]), return_inverse=True)
    depths, level = np.unique(depth, return_inverse=True)
    code = (top * (len(depths) + 1) + level) * len(names) + ids[:n]
    above = (top * (len(depths) + 1) + level - 1) * len(names) + ids[n:]
    at = np.minimum(np.searchsorted(code, above), n - 1)
    follows = np.zeros(n, bool)
    follows[1:] = (top[1:] == top[:-1])  # a component's first row is its top
    up = np.where(follows & (code[at] == above), at, -1)
    steps = np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))[:-1])
    label, alive, weight = _labels(up, steps), np.ones(n, bool), weight.copy()
    sums = [np.zeros(n, np.int64) for _ in values]
    while alive.any():
        path = alive & (2 * weight > weight[label])
        deepest = np.full(n, -1)
        np.maximum.at(deepest, label[path], np.flatnonzero(path))
        centroid = deepest[label]
        centroids = deepest[deepest >= 0]
        up[(up >= 0) & np.isin(up, centroids)] = -1
        before, label = label, _labels(up, steps)
        beneath = alive & ((label != before) | (np.arange(n) == centroid))
        for own, out in zip(values, sums, strict=True):
            totals = np.zeros(n, np.int64)
            np.add.at(totals, before[beneath], own[beneath])
            out[path] += totals[before[path]]
        alive[centroids] = False
        shrunk = path & alive
        weight[shrunk] -= weight[centroid[shrunk]]
    return sums


def _labels(up: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The top of each row's piece: itself without a parent, else the parent's."""
    label = np.arange(len(up))
    for rows in steps:
        rows = rows[up[rows] >= 0]
        label[rows] = label[up[rows]]
    return label


def _finished(values: list[str]) -> Callable:
    """Subtree sums of rows that are sorted by component; a component is never parted."""
    names = ["node", "depth", *values]

    def solved(rows: pa.Table) -> pa.RecordBatch:
        columns = {c: rows.column(c).to_numpy() for c in ("top", "top_depth", "depth", "node", "weight", *values)}
        parent = rows.column("parent").fill_null(0).to_numpy()
        new = np.ones(len(parent), bool)
        new[1:] = (columns["top"][1:] != columns["top"][:-1]) | (columns["top_depth"][1:] != columns["top_depth"][:-1])
        sums = _split(np.cumsum(new) - 1, columns["depth"], columns["node"], parent, columns["weight"], [columns[v] for v in values])
        return pa.record_batch([pa.array(x) for x in (columns["node"], columns["depth"], *sums)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            top, depth = (rows.column(c).to_numpy() for c in ("top", "top_depth"))
            last = np.flatnonzero((top != top[-1]) | (depth != depth[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield solved(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield solved(pa.Table.from_batches(held))

    return run


def subtree_sums(nodes: DataFrame, members: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of each node, by centroid decomposition.

    ``nodes`` (node, depth, parent, weight, values) names a node by ``node`` and ``depth``, its parent
    by ``parent`` and the depth above; weight is a subtree's, which is known beforehand. ``members``
    (conv_id, node, depth, parent) has a row for each node on the path of each name. Components of
    more than ``SPLIT`` nodes are split by joins; the others are finished whole in tasks that take many.
    Returns node, depth and the sums.
    """
    root = nodes.where("depth = 0").select(F.col("node").alias("root"))
    columns = ["top", "top_depth", "depth", "node", "parent", "weight", *values]
    state = nodes.join(F.broadcast(root)).select(F.col("root").alias("top"), F.lit(0).cast("long").alias("top_depth"), *columns[2:])
    component, found, small = ["top", "top_depth"], [], []
    state = cut(state)
    while True:
        sizes = state.groupBy(*component).agg(F.max("weight").alias("total"), F.count("*").alias("n"))
        large = _light(cut(sizes.where(F.col("n") > SPLIT).drop("n")))
        small.append(state.join(large, component, "left_anti"))
        if large.limit(1).count() == 0:
            break
        state = state.join(large, component)
        deepest = state.where("2 * weight > total").groupBy(*component, "total").agg(F.max(F.struct("depth", "node", "weight")).alias("c"))
        centroids = _light(cut(deepest.select(*component, F.col("c.node").alias("centroid"), F.col("c.depth").alias("at"), F.col("c.weight").alias("less"))))
        # for each name, the child of its component's centroid that it passes
        children = centroids.select(*component, F.col("centroid").alias("parent"), (F.col("at") + 1).alias("depth"))
        below = members.join(_light(children), ["parent", "depth"])
        below = below.select(*component, F.col("conv_id").alias("node"), F.col("node").alias("child"))
        state = state.join(centroids, component).join(below, [*component, "node"], "left")
        state = cut(state.withColumns({
            "beneath": F.expr("child IS NOT NULL AND depth > at"), "on_path": F.expr("2 * weight > total"),
            "is_centroid": F.expr("node = centroid AND depth = at"),
        }))
        sums = state.where("beneath OR is_centroid").groupBy(*component).agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
        path = state.where("on_path").select("node", "depth", *component).join(sums, component)
        found.append(path.select("node", "depth", *[F.col(f"sum_{v}").alias(v) for v in values]))
        state = state.where("NOT is_centroid").select(
            F.when(F.col("beneath"), F.col("child")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("beneath"), F.col("at") + 1).otherwise(F.col("top_depth")).alias("top_depth"), "depth", "node", "parent",
            F.when(F.col("on_path"), F.col("weight") - F.col("less")).otherwise(F.col("weight")).alias("weight"), *values,
        )
    rest = small[0].select(*columns)
    for more in small[1:]:
        rest = rest.unionByName(more.select(*columns))
    rest = rest.repartition(partitions(nodes.sparkSession), *component).sortWithinPartitions(*columns[:4])
    every = rest.mapInArrow(_finished(values), "node long, depth long, " + ", ".join(f"{v} long" for v in values))
    for more in found:
        every = every.unionByName(more)
    return every.groupBy("node", "depth").agg(*[F.sum(v).alias(v) for v in values])


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations given by ``rows`` (conv_id, place, digest, n_bytes), whose

    places have no gaps, and ``lengths`` (conv_id, length), which has the conversations without turns too.
    """
    spark = rows.sparkSession
    lengths = cut(lengths)
    least, n_all = lengths.agg(F.min("conv_id"), F.count("*")).first()
    if least is None:
        return spark.createDataFrame([], _SCHEMA)
    seen = cut(occurrences(rows, lengths))
    grouped = seen.groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"),
        F.sum(F.expr("length - depth + 1")).alias("weight"),
    )
    grouped = cut(grouped)
    named = cut(seen.join(grouped.select("depth", "x", "y", "node"), ["depth", "x", "y"]).select("conv_id", "depth", "length", "node"))
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    paths = named.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(least)))
    paths = cut(paths.select("conv_id", "depth", "node", "parent", (F.col("length") == F.col("depth")).alias("last")))
    own = paths.where("conv_id = node").select("node", "depth", "parent")
    nodes = grouped.select("node", "depth", "n_convs", "n_bytes", "weight").join(own, ["node", "depth"])
    total = grouped.where("depth = 1").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    root = spark.createDataFrame([(least, 0, n_all, 0, total + n_all, None)], "node long, depth long, n_convs long, n_bytes long, weight long, parent long")
    nodes = nodes.unionByName(root)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["node", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
        "n_leaves": F.col("n_children").isNull().cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes"),
    })
    nodes = cut(nodes)
    sums = subtree_sums(nodes.drop("n_children", "n_convs", "n_bytes"), paths.drop("last"), ["n_leaves", "saved_tokens"])
    turnless = lengths.where("length = 0").select(F.lit(least).alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id")
    digests = ends(paths.where("last").select("node", "depth", "conv_id").unionByName(turnless))
    found = nodes.drop("n_leaves", "saved_tokens").join(sums, ["node", "depth"]).join(digests, ["node", "depth"], "left")
    return found.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
