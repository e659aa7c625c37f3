"""Set similarity of contributors: exact, by prefix filter and by min-hash signatures."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillnet.operators.skew import group_pairs
from quillnet.session import cut_lineage

# Fixed value: a prime below 2**31, so that a * (id mod prime) + b stays inside 63 bits.
HASH_PRIME = 2038074743


def set_sizes(members: DataFrame, within: Sequence[str], entity: str) -> DataFrame:
    return members.groupBy(*within, entity).agg(F.count(F.lit(1)).alias("d"))


def with_distance(shared: DataFrame, sizes: DataFrame, within: Sequence[str], entity: str) -> DataFrame:
    """Jaccard distance of pairs from the number of shared items and the two set sizes."""
    first = sizes.select(*within, F.col(entity).alias("e1"), F.col("d").alias("d1"))
    second = sizes.select(*within, F.col(entity).alias("e2"), F.col("d").alias("d2"))
    return shared.join(first, [*within, "e1"]).join(second, [*within, "e2"]).select(*within, "e1", "e2", _distance())


def _distance() -> Column:
    """Jaccard distance of two sets of ``d1`` and ``d2`` items that share ``n``."""
    return (F.lit(1.0) - F.col("n") / (F.col("d1") + F.col("d2") - F.col("n"))).alias("distance")


def overlapping_pairs(members: DataFrame, within: Sequence[str], entity: str, item: str) -> DataFrame:
    """Distances of all pairs sharing at least one item."""
    shared = group_pairs(members, [*within, item], entity).groupBy(*within, "e1", "e2")
    sizes = set_sizes(members, within, entity)
    return with_distance(shared.agg(F.count(F.lit(1)).alias("n")), sizes, within, entity)


def verified_pairs(
    candidates: DataFrame, members: DataFrame, within: Sequence[str], entity: str, item: str, threshold: float
) -> DataFrame:
    """Candidates whose exact distance is below the threshold.

    ``members`` may carry the sizes of their sets as ``_d``, and then need no items that only one set has.
    """
    sized = "_d" in members.columns
    first = members.select(*within, F.col(entity).alias("e1"), item, *([F.col("_d").alias("d1")] if sized else []))
    second = members.select(*within, F.col(entity).alias("e2"), item, *([F.col("_d").alias("d2")] if sized else []))
    shared = (
        candidates.join(first, [*within, "e1"])
        .join(second, [*within, "e2", item])
        .groupBy(*within, "e1", "e2", *(["d1", "d2"] if sized else []))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if sized:
        pairs = shared.select(*within, "e1", "e2", _distance())
    else:
        pairs = with_distance(shared, set_sizes(members, within, entity), within, entity)
    return pairs.filter(F.col("distance") < threshold)


def close_pairs(
    members: DataFrame, within: Sequence[str], entity: str, item: str, threshold: float
) -> DataFrame:
    """All pairs with Jaccard distance below ``threshold``, by prefix filter.

    Two sets that similar share an item among the rarest d - ceil((1 - threshold) d) + 1 items of
    each, so only these are paired: common items, which would pair nearly everyone, drop out
    of the prefixes. The result is exact because every candidate is verified.
    """
    within = list(within)
    rows = members.select(*within, entity, item).distinct()
    frequency = rows.groupBy(*within, item).agg(F.count(F.lit(1)).alias("_f"))
    rows = rows.join(frequency, [*within, item])
    mine = Window.partitionBy(*within, entity)
    placed = rows.withColumn("_place", F.row_number().over(mine.orderBy("_f", item)) - 1).withColumn("_d", F.count(F.lit(1)).over(mine))
    needed = F.ceil(F.lit(1.0 - threshold) * F.col("_d") - 1e-9)
    # An item of one set alone counts for the set's size and is in no pair, so it goes no further.
    shared = placed.filter("_f > 1").select(*within, entity, item, "_d", (F.col("_place") < F.col("_d") - needed + 1).alias("_early"))
    shared = cut_lineage(shared)
    candidates = group_pairs(shared.filter("_early"), [*within, item], entity).select(*within, "e1", "e2").distinct()
    return verified_pairs(candidates, shared, within, entity, item, threshold)


def hash_family(tables: int, seed: int = 7) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, HASH_PRIME), draw.randrange(HASH_PRIME)) for _ in range(tables)]


def minhash_signatures(
    members: DataFrame, within: Sequence[str], entity: str, item: str, tables: int = 5
) -> DataFrame:
    """One minimum per hash function: plain aggregates, so no item set is ever gathered."""
    reduced = F.pmod(F.col(item) + 1, F.lit(HASH_PRIME))
    mins = [
        F.min(F.pmod(reduced * F.lit(a) + F.lit(b), F.lit(HASH_PRIME))).alias(f"h{i}")
        for i, (a, b) in enumerate(hash_family(tables))
    ]
    return members.groupBy(*within, entity).agg(*mins)


def minhash_close_pairs(
    members: DataFrame, within: Sequence[str], entity: str, item: str, threshold: float, tables: int = 5
) -> DataFrame:
    """Pairs agreeing on any of the min-hashes, verified against the threshold."""
    within = list(within)
    rows = members.select(*within, entity, item).distinct()
    signed = minhash_signatures(rows, within, entity, item, tables)
    keys = F.explode(
        F.array(*[F.struct(F.lit(i).alias("table"), F.col(f"h{i}").alias("value")) for i in range(tables)])
    )
    bands = signed.select(*within, entity, keys.alias("_band")).select(
        *within, entity, F.col("_band.table").alias("table"), F.col("_band.value").alias("value")
    )
    candidates = group_pairs(bands, [*within, "table", "value"], entity).select(*within, "e1", "e2").distinct()
    return verified_pairs(candidates, rows, within, entity, item, threshold)


def similarity_sweep(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Nodes and edges below each distance threshold, from one pass over the distances."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])

    def below(distance: str):
        return F.explode(F.filter(limits, lambda t: F.col(distance) < t)).alias("threshold")

    edges = pairs.select(below("distance")).groupBy("threshold").agg(F.count(F.lit(1)).alias("edges"))
    nearest = (
        pairs.select(F.explode(F.array("e1", "e2")).alias("node"), "distance")
        .groupBy("node")
        .agg(F.min("distance").alias("nearest"))
    )
    nodes = nearest.select(below("nearest")).groupBy("threshold").agg(F.count(F.lit(1)).alias("nodes"))
    spark = pairs.sparkSession
    every = spark.range(1).select(F.explode(limits).alias("threshold"))
    return every.join(nodes, "threshold", "left").join(edges, "threshold", "left").na.fill(0, ["nodes", "edges"])
