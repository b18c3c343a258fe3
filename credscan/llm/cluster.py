"""Shared helpers: cutting lineage, connected components, and links found through lists."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes of a list's commonest component that the members outside it meet first.
SAMPLED = 2
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, without its lineage.

    Spark drops the shuffle files of the job when it ends. The folder is the session's; only a
    local session that names none gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="credscan-")
        context.setCheckpointDir(shared)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, so that the setting holds for it
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node: columns node, root. ``edges`` has columns a, b.

    Alternates large-star and small-star steps until the edges stop changing. Neighbourhoods are
    never gathered: the smallest neighbour is an aggregate, joined back to the edges.
    """
    state = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        state = cut(
            small.select("u", F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def linked(
    index: DataFrame,
    ratio: tuple[int, int],
    screen: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame], DataFrame],
    bound: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of the graph whose links ``confirm`` confirms: columns node, root.

    ``index`` has value, node, size, weight: two nodes are compared if they share a value and the
    smaller size is at least ratio[0]/ratio[1] of the larger. ``screen`` takes distinct pairs
    (x, y) and returns those that may hold with a column ``score``; ``confirm`` returns those that do.
    ``bound``, for links that ask for a share ``ratio`` of the union of two sets of ``size`` elements,
    takes nodes and returns for each the ``most`` elements that it has in common with others of them.

    A list of one value may hold a third of all nodes, so pairs within a list are never all
    emitted. First a member meets the hub of each of its lists, its node of greatest weight (an
    original shares more values with others than its altered copies do), and the pair of best
    score is confirmed; the pairs of less score are kept for the end. So hubs have met all members
    and leave their lists, and lists of two are done with. Then members outside their list's
    commonest component meet ``SAMPLED`` nodes of that component, others in every list, and again
    the best pair is confirmed. At last members outside a list's commonest component meet all
    members that are still in other components, and so do the pairs kept. With a ``bound`` only nodes
    and pairs take part in these meetings that have enough in common with any other node still in them:
    an altered copy whose alterations are its own and too many meets nobody. Pairs left out are in one
    component already or may not hold, so the components are those of all pairs.
    """
    low, high = ratio
    fits = f"x.size * {high} >= y.size * {low} AND y.size * {high} >= x.size * {low}"

    def meet(members: DataFrame, others: DataFrame) -> DataFrame:
        return members.alias("x").join(others.alias("y"), "value").where("x.root <> y.root").where(fits)

    members = index.withColumn("root", F.col("node"))
    hubs = cut(
        members.groupBy("value").agg(F.max(F.struct("weight", "node", "size", "root")).alias("hub"), F.count("*").alias("n"))
        .select("value", "hub.*", "n")
    )
    pairs = meet(members, hubs).select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct()
    able = cut(screen(pairs).select("x", "y", "score"))
    best = cut(able.groupBy("x").agg(F.max_by("y", F.struct("score", "y")).alias("y")))
    edges = cut(confirm(best))
    roots = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    able = able.join(best, ["x", "y"], "left_anti").select("x", "y")
    longer = hubs.where("n > 2").select("value", F.col("node").alias("hub"))
    rest = cut(index.join(longer, "value").where("node <> hub").select("value", "node", "size"))

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        """``rows`` with the root of their column ``node``."""
        known = roots.select(F.col("node").alias(node), F.col("root").alias(root))
        return rows.join(known, node, "left").withColumn(root, F.coalesce(root, node))

    def apart() -> tuple[DataFrame, DataFrame, DataFrame]:
        """All members with their roots and the list's commonest root; those within it, those outside."""
        members = rooted(rest, "node", "root")
        sizes = members.groupBy("value", "root").agg(F.count("*").alias("n"))
        common = sizes.groupBy("value").agg(F.max_by("root", F.struct("n", "root")).alias("common"))
        members = members.join(common, "value")
        return members, members.where("root = common"), members.where("root <> common")

    _, within, outside = apart()
    drawn = within.groupBy("value", F.pmod(F.xxhash64("node", "value"), F.lit(SAMPLED)).alias("slot")).agg(
        F.min(F.struct(F.xxhash64("value", "node").alias("h"), "node", "size", "root")).alias("one")
    )
    pairs = meet(outside, drawn.select("value", "one.node", "one.size", "one.root"))
    pairs = pairs.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct()
    best = screen(pairs).groupBy("x").agg(F.max_by("y", F.struct("score", "y")).alias("y"))
    more = cut(confirm(cut(best)))
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(more.select(F.col("x").alias("a"), F.col("y").alias("b")).union(known))

    members, _, outside = apart()
    if bound:
        in_question = members.join(outside.select("value").distinct(), "value", "left_semi").select("node").distinct()
        rest = cut(rest.join(bound(in_question), "node").where(f"most * {high} >= size * {low}"))
        # the elements that both have are this share of both sizes together
        fits += f" AND least(x.most, y.most) * {low + high} >= (x.size + y.size) * {low}"
        members, _, outside = apart()
    pairs = meet(members, outside).select(F.least("x.node", "y.node").alias("x"), F.greatest("x.node", "y.node").alias("y"))
    pairs = cut(pairs.distinct())  # frees what the lists were shuffled into before the pairs are screened
    able = rooted(rooted(able, "x", "of_x"), "y", "of_y").where("of_x <> of_y")
    able = able.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    more = cut(confirm(cut(screen(pairs).select("x", "y").union(able).distinct())))
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(more.select(F.col("x").alias("a"), F.col("y").alias("b")).union(known))
