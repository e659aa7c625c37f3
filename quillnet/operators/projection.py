"""Projections of contributor-article graphs, whole and sampled."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators.skew import group_pairs, ordered_index, priority_head
from quillnet.session import cut_lineage

SEED = 7
EPSILON = 0.01
# Pairs counted in one task.
PAIRS_PER_TASK = 1 << 21
# Rows of members that meet in one task to make pairs.
ROWS_PER_TASK = 1 << 18
# Pairs that must be saved per row sent to a cell, because a row is wider than a pair.
PAIRS_PER_ROW = 4
# Draws of a block that start in one row.
DRAWS_PER_ROW = 4096
# Blocks up to this size are indexed by one window, larger ones over ranges.
WINDOW_MEMBERS = 65_536
# Terms of the Poisson distribution that are compared one by one before the rest is summed in a loop.
PLAIN_TERMS = 14


def shared_counts(members: DataFrame, group: Sequence[str], member: str, threshold: int = 0) -> DataFrame:
    """Pairs of members with the number of groups they share, above a threshold.

    Pairs are counted in tasks of about PAIRS_PER_TASK, whatever the number of shuffle partitions, so a task's memory does not grow
    with the input. Where the groups are so large that rows sent to every cell of members are far fewer than pairs, rows are shuffled
    and pairs are made and counted inside the cells; else pairs are shuffled.
    """
    rows = cut_lineage(members.select(*group, member).distinct())
    count, total = block_sizes(rows, group).agg(F.sum("k"), F.sum(C.pair_count(F.col("k")))).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // PAIRS_PER_TASK))
    side = math.isqrt(2 * tasks) + 1
    if (count or 0) * side * PAIRS_PER_ROW < (total or 0):
        counts = _counted_in_cells(rows, list(group), member, side)
    else:
        makers = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(count or 0) // ROWS_PER_TASK))
        pairs = group_pairs(rows, group, member, tasks=makers).select("e1", "e2").repartition(tasks, "e1", "e2")
        counts = pairs.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("shared_articles"))
    return counts.filter(F.col("shared_articles") > threshold) if threshold else counts


def _counted_in_cells(rows: DataFrame, group: list[str], member: str, side: int) -> DataFrame:
    """Pairs with the number of groups they share, counted where they are made.

    Members fall into ``side`` hash buckets, and a cell is two buckets, or one with itself: every pair of members belongs to one cell.
    A row goes to the ``side`` cells of its bucket, and no pair is shuffled.
    """
    bucket = F.pmod(F.xxhash64(member), F.lit(side)).cast("int")
    sent = rows.withColumn("_own", bucket).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    sent = sent.withColumn("_low", low).withColumn("_high", high).withColumn("_cell", (high * (high + 1) / 2).cast("int") + low)
    sent = sent.repartitionById(side * (side + 1) // 2, "_cell")
    sides = sent.groupBy("_cell", "_low", "_high", *group).agg(
        F.collect_list(F.when(F.col("_own") == F.col("_low"), F.col(member))).alias("_first"),
        F.collect_list(F.when(F.col("_own") == F.col("_high"), F.col(member))).alias("_second"),
    )
    pairs = sides.withColumn("_a", F.explode("_first")).withColumn("_b", F.explode("_second"))
    pairs = pairs.filter((F.col("_low") < F.col("_high")) | (F.col("_a") < F.col("_b")))
    counted = pairs.groupBy("_cell", F.least("_a", "_b").alias("e1"), F.greatest("_a", "_b").alias("e2"))
    return counted.agg(F.count(F.lit(1)).alias("shared_articles")).select("e1", "e2", "shared_articles")


def user_projection(edges: DataFrame, threshold: int = 0) -> DataFrame:
    """Users sharing more than ``threshold`` articles, each pair once."""
    return shared_counts(edges, ["article_id"], "user_id", threshold)


def symmetrise(edges: DataFrame, *carry: str) -> DataFrame:
    """Both directions of every edge, without duplicates."""
    return (
        edges.select("e1", "e2", *carry)
        .union(edges.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"), *carry))
        .distinct()
    )


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """Both directions of edges already known to be distinct with e1 < e2: no shuffle.

    The two directions come from one explode, so the input is read once.
    """
    ways = F.array(
        F.struct(F.col("e1").alias("e1"), F.col("e2").alias("e2")),
        F.struct(F.col("e2").alias("e1"), F.col("e1").alias("e2")),
    )
    return edges.select(F.explode(ways).alias("_way"), *carry).select("_way.e1", "_way.e2", *carry)


def user_projection_symmetric(edges: DataFrame, threshold: int = 1) -> DataFrame:
    """Both directions and self loops of users sharing more than ``threshold`` articles."""
    pairs = both_ways(user_projection(edges, threshold), "shared_articles")
    loops = (
        edges.select("user_id", "article_id")
        .distinct()
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("shared_articles"))
        .filter(F.col("shared_articles") > threshold)
        .select(F.col("user_id").alias("e1"), F.col("user_id").alias("e2"), "shared_articles")
    )
    return pairs.unionByName(loops)


def daily_block_projection(bipartite: DataFrame) -> DataFrame:
    """Users on the same article on the same day."""
    return shared_counts(bipartite, ["article_id", "edit_date"], "user_id")


def weight_threshold(edges: DataFrame, threshold: int, weight: str = "shared_articles") -> DataFrame:
    return edges.filter(F.col(weight) > threshold)


def threshold_edge_lists(edges: DataFrame, thresholds: Sequence[int], weight: str = "shared_articles") -> DataFrame:
    """One tagged edge list per threshold, from one pass over the edges."""
    limits = F.array(*[F.lit(int(t)) for t in thresholds])
    kept = F.filter(limits, lambda t: t < F.col(weight))
    return edges.select(F.explode(kept).alias("threshold"), "e1", "e2")


def block_sizes(members: DataFrame, group: Sequence[str]) -> DataFrame:
    return members.groupBy(*group).agg(F.count(F.lit(1)).alias("k"))


def block_chunks(
    members: DataFrame, group: Sequence[str], member: str, size_name: str, set_name: str, bits: int = 16
) -> DataFrame:
    """Member sets of blocks as arrays; a block is cut by the high bits of the member.

    Most blocks are one row. A block spread over more than 2**bits ids gives one row per id range,
    so no array holds more than 2**bits members, and every row carries the size of the whole block.
    """
    group = list(group)
    distinct = members.select(*group, member).distinct()
    chunks = distinct.groupBy(*group, F.shiftright(member, bits).alias("chunk")).agg(
        F.array_sort(F.collect_list(member)).alias(set_name)
    )
    sizes = chunks.groupBy(*group).agg(F.sum(F.size(set_name)).alias(size_name))
    return chunks.join(sizes, group)


def _indexed(sized: DataFrame, group: list[str], member: str) -> DataFrame:
    """Position of every member inside its block of ``k``, by value; the same number however a block is cut."""
    few = F.col("k") <= WINDOW_MEMBERS
    order = Window.partitionBy(*group).orderBy(member)
    plain = sized.filter(few).withColumn("i", F.row_number().over(order).cast("bigint") - 1)
    large = sized.filter(~few)
    return plain if large.isEmpty() else plain.unionByName(ordered_index(large, group, member, "i"))


def poisson_darts(rate: Column, uniform: Column) -> Column:
    """The inverse Poisson distribution of ``rate`` at ``uniform``: the number of terms whose running total is at most it."""
    term = total = F.exp(-rate)
    darts = F.when(uniform < total, F.lit(0))
    for k in range(1, PLAIN_TERMS):
        term = term * rate / k
        total = total + term
        darts = darts.when(uniform < total, F.lit(k))
    # The rare rest goes on from there, term by term, until no further term can matter.
    steps = F.sequence(F.lit(PLAIN_TERMS), F.ceil(rate + 8 * F.sqrt(rate) + 30).cast("int") + PLAIN_TERMS)
    start = F.struct(term.alias("term"), total.alias("total"), F.lit(PLAIN_TERMS).alias("darts"))

    def advance(state, step):
        term = state["term"] * rate / step
        total = state["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), (state["darts"] + F.when(total <= uniform, 1).otherwise(0)).alias("darts"))

    return darts.otherwise(F.aggregate(steps, start, advance, lambda state: state["darts"]))


def _coin_pairs(
    sized: DataFrame, group: list[str], member: str, epsilon: float, method: str, seed: int
) -> DataFrame:
    """Independent coin flips for every pair of a block without listing the pairs.

    Throwing Poisson(-m ln(1-p)) darts at the m later members hits each of them with probability
    exactly p, independently. The dart count is the inverse Poisson distribution at a 32-bit
    uniform number, which ends long before the last term tried.
    """
    indexed = _indexed(sized, group, member)
    rate = -(F.col("k") - 1 - F.col("i")) * F.log(F.lit(1.0) - C.keep_probability(F.col("k"), epsilon, method))
    throws = (
        indexed.filter(F.col("i") < F.col("k") - 1)
        .withColumn("rate", rate)
        .withColumn("u", C.uniform_hash(member, *group, seed=seed))
        .withColumn("darts", poisson_darts(F.col("rate"), F.col("u")))
        # An outer explode: a filter on the darts would be pushed down and evaluate them again.
        .withColumn("dart", F.explode_outer(F.when(F.col("darts") > 0, F.sequence(F.lit(1), "darts"))))
        .filter("dart IS NOT NULL")
    )
    aim = F.floor(C.uniform_hash(member, *group, "dart", seed=seed + 1) * (F.col("k") - 1 - F.col("i")))
    # One shuffle serves the distinct and the join.
    hits = throws.select(*group, F.col(member).alias("e1"), (F.col("i") + 1 + aim).alias("j")).repartition(*group, "j").distinct()
    partners = indexed.select(*group, F.col(member).alias("e2"), F.col("i").alias("j"))
    return hits.join(partners, [*group, "j"])


def _counted_pairs(
    sized: DataFrame, group: list[str], member: str, epsilon: float, method: str, seed: int
) -> DataFrame:
    """Exactly the quota of distinct random pairs of a block, by drawing pair numbers.

    More numbers than needed are drawn with repeats, repeats are dropped, and the quota of smallest
    hash is kept. The margin is twelve standard deviations; a block that still falls short is an error,
    never a smaller sample. A number in [0, k(k-1)/2) is turned into a pair (i < j) and the indexes
    are joined back to members.
    """
    indexed = _indexed(sized, group, member)
    p = C.keep_probability(F.col("k"), epsilon, method)
    blocks = (
        sized.select(*group, "k")
        .distinct()
        .withColumn("pairs", C.pair_count(F.col("k")))
        .withColumn("quota", F.ceil(F.col("pairs") * p))
        .withColumn("draws", F.ceil(-F.col("pairs") * F.log(F.lit(1.0) - p) + 12 * F.sqrt("quota") + 64))
    )
    # Draws are started in runs so that one huge block is spread over many rows before it is exploded.
    run = DRAWS_PER_ROW
    last_run = F.floor((F.col("draws") - 1) / run)
    runs = blocks.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), last_run)))
    runs = runs.repartition(*group, "run")
    last = F.least(F.col("draws"), (F.col("run") + 1) * run) - 1
    draws = runs.withColumn("draw", F.explode(F.sequence(F.col("run") * run, last)))
    number = F.floor(
        (C.uniform_hash(*group, "draw", seed=seed) + C.uniform_hash(*group, "draw", seed=seed + 1) / 4294967296.0)
        * F.col("pairs")
    )
    drawn = draws.select(*group, "k", "pairs", "quota", F.least(number, F.col("pairs") - 1).alias("number")).distinct()
    found = drawn.groupBy(*group, "quota").agg(F.count(F.lit(1)).alias("found"))
    short = F.raise_error(F.concat(F.lit("a block was drawn short of its quota of "), F.col("quota").cast("string")))
    found = found.select(*group, F.when(F.col("found") < F.col("quota"), short.cast("bigint")).otherwise(F.col("quota")).alias("sure"))
    drawn = drawn.join(found, group).withColumn("quota", F.col("sure")).drop("sure")
    drawn = drawn.withColumn("priority", C.uniform_hash(*group, "number", seed=seed + 2))
    kept = priority_head(drawn, group, "priority", F.col("quota"), F.col("quota"), ["number"])
    # Row j of the triangle starts at j(j-1)/2; the float root is corrected by one either way.
    guess = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * F.col("number"))) / 2).cast("bigint")
    start = lambda j: F.shiftright(j * (j - 1), 1)
    row = (
        F.when(start(F.col("guess")) > F.col("number"), F.col("guess") - 1)
        .when(start(F.col("guess") + 1) <= F.col("number"), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    cells = kept.withColumn("guess", guess).withColumn("j", row).withColumn("i", F.col("number") - start(F.col("j")))
    first = indexed.select(*group, F.col(member).alias("e1"), "i")
    second = indexed.select(*group, F.col(member).alias("e2"), F.col("i").alias("j"))
    return cells.select(*group, "k", "i", "j").join(first, [*group, "i"]).join(second, [*group, "j"]).select(
        *group, "k", "e1", "e2"
    )


def sampled_pairs(
    members: DataFrame,
    group: Sequence[str],
    member: str,
    epsilon: float = EPSILON,
    method: str = "any",
    seed: int = SEED,
    exact_count_from: int | None = None,
) -> DataFrame:
    """Sampled pairs of every block: each member keeps an edge with probability at least 1 - epsilon.

    Blocks below ``exact_count_from`` members (all, when it is None) flip one coin per pair; larger
    ones keep exactly ceil(k(k-1)/2 * p) pairs. Blocks of every size follow the same rule and produce
    only the pairs they keep, so the work grows with the sample and not with k squared.
    """
    group = list(group)
    rows = members.select(*group, member).distinct()
    sizes = block_sizes(rows, group).filter(F.col("k") > 1)
    sized = cut_lineage(rows.join(sizes, group))  # written once: each rule reads it several times
    args = (group, member, epsilon, method, seed)
    if exact_count_from is None:
        return _coin_pairs(sized, *args).select(*group, "e1", "e2")
    few = F.col("k") < exact_count_from
    coins = _coin_pairs(sized.filter(few), *args).select(*group, "e1", "e2")
    return coins.unionByName(_counted_pairs(sized.filter(~few), *args).select(*group, "e1", "e2"))


def sampled_projection(members: DataFrame, group: Sequence[str], member: str, **options) -> DataFrame:
    """Sampled pairs with the number of blocks that kept them."""
    return sampled_pairs(members, group, member, **options).groupBy("e1", "e2").agg(
        F.count(F.lit(1)).alias("weight")
    )


def user_network(members: DataFrame, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """The sampled user-user network over (article, quarter) blocks."""
    return sampled_projection(members, ["article_id", "year", "quarter"], "user_id", epsilon=epsilon, seed=seed)


def timed_user_network(members: DataFrame, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """The same network with users told apart by quarter."""
    pairs = sampled_pairs(members, ["article_id", "year", "quarter"], "user_id", epsilon=epsilon, seed=seed)
    return pairs.groupBy("year", "quarter", "e1", "e2").agg(F.count(F.lit(1)).alias("weight"))


def article_network(
    members: DataFrame, epsilon: float = EPSILON, seed: int = SEED, exact_count_from: int = 10
) -> DataFrame:
    """The sampled article-article network over (user, quarter) blocks."""
    pairs = sampled_pairs(
        members,
        ["user_id", "year", "quarter"],
        "article_id",
        epsilon=epsilon,
        seed=seed,
        exact_count_from=exact_count_from,
    )
    return pairs.groupBy("year", "quarter", "e1", "e2").agg(F.count(F.lit(1)).alias("weight"))


def relabel(edges: DataFrame, *carry: str) -> tuple[DataFrame, DataFrame]:
    """Dense ids from 1 by node order, and the edges in those ids."""
    nodes = dense_ids(edges)
    first = nodes.select(F.col("node").alias("e1"), F.col("rank").alias("r1"))
    second = nodes.select(F.col("node").alias("e2"), F.col("rank").alias("r2"))
    moved = edges.join(first, "e1").join(second, "e2").select(
        F.col("r1").alias("e1"), F.col("r2").alias("e2"), *carry
    )
    return nodes, moved


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("e1", "e2")).alias("node")).distinct()


def dense_ids(edges: DataFrame) -> DataFrame:
    """Ids from 1 in node order, without a window over all nodes."""
    return ordered_index(node_set(edges), [], "node", "rank", start=1)
