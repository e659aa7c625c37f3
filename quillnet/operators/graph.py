"""Measures of undirected graphs given as edge lists (e1 < e2, each pair once)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import inside as I
from quillnet.operators.distributions import node_degrees
from quillnet.operators.projection import both_ways, relabel
from quillnet.operators.skew import group_pairs
from quillnet.session import cut_lineage, drop_state, next_state

DAMPING = 0.85
CUT_EVERY = 5


def simple_edges(pairs: DataFrame, first: str = "e1", second: str = "e2") -> DataFrame:
    """Undirected simple edges of any pair list: no loops, no direction, no repeats."""
    return (
        pairs.select(F.least(first, second).alias("e1"), F.greatest(first, second).alias("e2"))
        .filter(F.col("e1") != F.col("e2"))
        .distinct()
    )


def graph_size(edges: DataFrame) -> DataFrame:
    return node_degrees(edges).agg(
        F.count(F.lit(1)).alias("nodes"), F.shiftright(F.sum("degree"), 1).alias("edges")
    )


def build_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with degree and summed weight, and both-way links spread by both of their ends.

    Hashing both ends splits the links of a hub over all partitions. The links are written once
    for the loops that read them.
    """
    links = cut_lineage(both_ways(edges, "weight").repartition("e1", "e2"))
    vertices = links.groupBy(F.col("e2").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight")
    )
    return vertices, links


def written_links(edges: DataFrame) -> DataFrame:
    """Both-way links, written once for loops.

    They are left spread evenly: placing them by node would put a hub's links in one task, where a
    skewed join could no longer split them.
    """
    return cut_lineage(both_ways(edges))


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = DAMPING, tolerance: float | None = 1e-4) -> DataFrame:
    """PageRank of an undirected graph; no node of an edge list is dangling.

    Lineage is cut every few rounds; there the summed change of the last round is held against the
    tolerance. ``rounds`` bounds the work where it is not reached, with a warning.
    """
    links = written_links(edges)
    degrees = cut_lineage(links.groupBy(F.col("e2").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
    n = degrees.count()
    ranks = degrees.select("node", "degree", F.lit(1.0 / n).alias("pagerank"))
    state = None
    for step in range(1, rounds + 1):
        sent = ranks.select(F.col("node").alias("e2"), (F.col("pagerank") / F.col("degree")).alias("share"))
        received = links.join(sent, "e2").groupBy(F.col("e1").alias("node")).agg(F.sum("share").alias("received"))
        previous = ranks
        ranks = degrees.join(received, "node").select(
            "node", "degree", (F.col("received") * damping + (1.0 - damping) / n).alias("pagerank")
        )
        if step % CUT_EVERY == 0 or step == rounds:
            last = previous.select("node", F.col("pagerank").alias("before"))
            moved = ranks.join(last, "node").select("node", "degree", "pagerank", F.abs(F.col("pagerank") - F.col("before")).alias("moved"))
            state = next_state(moved, *([state] if state else []))
            ranks = state.select("node", "degree", "pagerank")
            if tolerance is not None and state.agg(F.sum("moved")).first()[0] < tolerance:
                break
    else:
        if tolerance is not None:
            warnings.warn(f"pagerank did not reach its tolerance in {rounds} rounds", stacklevel=2)
    drop_state(links)
    drop_state(degrees)
    return ranks.select("node", "pagerank")


def hits(edges: DataFrame, tolerance: float = 1e-12, sweeps: int = 100, width: int = 8) -> DataFrame:
    """Hub and authority scores of unit length, by restarted Lanczos steps.

    Hubs are the leading eigenvector of the squared adjacency matrix that a start of ones leads to. A step applies the matrix
    twice and takes out the earlier directions of its sweep, which are columns of one written table; the small matrix of
    their products gives the best vector among them and its residual, held against the tolerance relative to the
    eigenvalue. A sweep of ``width`` steps hands its best vector to the next. ``sweeps`` bounds the work, with a warning.
    A network without links has no rows.
    """
    links = written_links(edges)
    state = cut_lineage(links.groupBy(F.col("e2").alias("node")).agg(F.lit(1.0).alias("x")))
    nodes = state.count()
    if not nodes:
        return state.select("node", F.col("x").alias("hub"), F.col("x").alias("authority"))

    def spread(vector: DataFrame) -> DataFrame:
        sent = vector.select(F.col("node").alias("e2"), "x")
        return links.join(sent, "e2").groupBy(F.col("e1").alias("node")).agg(F.sum("x").alias("x"))

    def combined(weights: Sequence[float]) -> Column:
        return sum((F.col(f"v{i}") * float(w) for i, w in enumerate(weights)), F.lit(0.0))

    def products(rows: DataFrame, vector: Column, count: int) -> np.ndarray:
        """Products of a vector with the sweep's directions, and with itself."""
        each = [F.sum(vector * F.col(f"v{i}")).alias(f"p{i}") for i in range(count)]
        return np.array(rows.agg(*each, F.sum(vector * vector).alias("own")).first(), dtype=float)

    best, settled = F.lit(1.0 / np.sqrt(nodes)), False
    for _ in range(sweeps):
        basis = state.select("node", best.alias("v0"))
        small = np.zeros((width, width))
        for step in range(width):
            pushed = spread(spread(basis.select("node", F.col(f"v{step}").alias("x"))))
            state = next_state(basis.join(pushed, "node"), state)
            first = products(state, F.col("x"), step + 1)
            rest = F.col("x") - combined(first[:-1])
            again = products(state, rest, step + 1)  # a second pass takes out what rounding left
            small[step, : step + 1] = small[: step + 1, step] = first[:-1] + again[:-1]
            left = np.sqrt(max(again[-1] - (again[:-1] ** 2).sum(), 0.0))
            values, vectors = np.linalg.eigh(small[: step + 1, : step + 1])
            lead = vectors[:, -1] * np.sign(vectors[0, -1])
            settled = left * abs(lead[-1]) <= tolerance * values[-1]
            if settled or step + 1 == width:
                break
            known = [f"v{i}" for i in range(step + 1)]
            basis = state.select("node", *known, ((rest - combined(again[:-1])) / float(left)).alias(f"v{step + 1}"))
        best = combined(lead / np.linalg.norm(lead))
        if settled:
            break
    else:
        warnings.warn(f"hits did not reach its tolerance in {sweeps} sweeps", stacklevel=2)
    hubs = state.select("node", best.alias("hub"))
    authorities = spread(hubs.select("node", F.col("hub").alias("x"))).withColumnRenamed("x", "authority")
    result = next_state(hubs.join(authorities, "node"), links, state)
    lengths = result.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in ("hub", "authority")]).first()
    return result.select("node", *[F.abs(F.col(c) / lengths[c]).alias(c) for c in ("hub", "authority")])


def triangles(edges: DataFrame) -> DataFrame:
    """All triangles, each once.

    Every edge points from its end of lower degree to the other, so a node has at most
    sqrt(2m) outgoing edges however large its degree: hubs do not multiply the wedges.
    """
    degrees = node_degrees(edges)
    first = degrees.select(F.col("node").alias("e1"), F.col("degree").alias("d1"))
    second = degrees.select(F.col("node").alias("e2"), F.col("degree").alias("d2"))
    flip = F.struct("d2", "e2") < F.struct("d1", "e1")
    aimed = edges.select("e1", "e2").join(first, "e1").join(second, "e2").select(
        F.when(flip, F.col("e2")).otherwise(F.col("e1")).alias("low"),
        F.when(flip, F.col("e1")).otherwise(F.col("e2")).alias("high"),
    )
    # Even sqrt(2m) out-edges of one node make m wedges: large ones are made in bounded cells.
    wedges = group_pairs(cut_lineage(aimed), ["low"], "high")
    closed = wedges.join(edges.select("e1", "e2"), ["e1", "e2"])
    return closed.select(F.col("low").alias("c"), F.col("e1").alias("a"), F.col("e2").alias("b"))


def triangle_counts(edges: DataFrame) -> DataFrame:
    """Degree and triangles of every node."""
    corners = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node"))
    counts = corners.groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    return node_degrees(edges).join(counts, "node", "left").na.fill(0, ["triangles"])


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """Closed share of each node's neighbour pairs; nodes with fewer than two neighbours have none."""
    pairs = C.pair_count(F.col("degree"))
    return triangle_counts(edges).select(
        "node", "degree", "triangles", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(F.lit(0.0)).alias("clustering")
    )


def average_clustering(edges: DataFrame) -> DataFrame:
    """Mean over all nodes; a node with fewer than two neighbours adds zero."""
    return clustering_coefficients(edges).agg(
        F.avg("clustering").alias("average_clustering"), F.count(F.lit(1)).alias("nodes")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component.

    Every round takes the smallest label among the neighbours and then jumps to the label of
    the label, so long chains shrink by halves. Labels are merged and never broadcast.
    """
    links = written_links(edges)
    labels = cut_lineage(
        links.groupBy(F.col("e2").alias("node")).agg(F.least(F.min("e1"), F.min("e2")).alias("component"))
    )
    while True:
        told = labels.select(F.col("node").alias("e2"), "component").hint("merge")
        near = links.join(told, "e2").groupBy(F.col("e1").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near.hint("merge"), "node").select(
            "node", F.least("component", "near").alias("next"), F.col("component").alias("before")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        labels = next_state(
            hooked.join(jump.hint("merge"), "next").select("node", F.least("next", "further").alias("component"), "before"), labels
        )
        if labels.filter(F.col("component") != F.col("before")).isEmpty():
            break
    drop_state(links)
    return labels.select("node", "component")


def core_numbers(edges: DataFrame) -> DataFrame:
    """Core number of every node: peeled inside tasks where the components fit them (:mod:`inside`), else the limit of h-indexes of the
    neighbours' estimates.

    Rounds go on until no estimate moves; a chain takes as many as half its length.

    Estimates of a node's neighbours are counted per value before they meet, so a hub brings
    one row per distinct value and not one per neighbour. Estimates are merged and never broadcast: a round would send all nodes
    through the driver.
    """
    index = I.numbered(edges, connected_components(edges))
    if I.fits(edges, index):
        return _cores_inside(edges, index)
    drop_state(index)
    # Still spread evenly, but in order inside a file: rows of one end compress well in the shuffle of every round.
    links = cut_lineage(both_ways(edges).sortWithinPartitions("e2", "e1"))
    cores = cut_lineage(links.groupBy(F.col("e2").alias("node")).agg(F.count(F.lit(1)).alias("core")))
    at_least = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("value")))
    while True:
        told = cores.select(F.col("node").alias("e2"), F.col("core").alias("value")).hint("merge")
        counts = links.join(told, "e2").groupBy(F.col("e1").alias("node"), "value").agg(F.count(F.lit(1)).alias("n"))
        index = (
            counts.withColumn("h", F.least("value", at_least))
            .groupBy("node")
            .agg(F.max("h").alias("h"))
        )
        lower = F.col("h") < F.col("core")
        cores = next_state(
            cores.join(index.hint("merge"), "node").select("node", F.least("core", "h").alias("core"), lower.alias("moved")), cores
        )
        if cores.filter("moved").isEmpty():
            break
    drop_state(links)
    return cores.select("node", "core")


def _cores_inside(edges: DataFrame, index: DataFrame) -> DataFrame:
    def peel(a: np.ndarray, b: np.ndarray, _: np.ndarray, own: dict) -> Iterator[pd.DataFrame]:
        core = I.cores_of(I.Links([a], [b], own["place"]))[own["place"]]
        yield pd.DataFrame({"node": own["node"][core > 0], "core": core[core > 0]})

    chunks = cut_lineage(I.packed(both_ways(edges), index))
    nodes = index.filter("node IS NOT NULL").select("bundle", "idx", "place", "node")
    cores = cut_lineage(I.solved(chunks, nodes, index.count(), peel, "node bigint, core bigint"))
    drop_state(chunks)
    drop_state(index)
    return cores


def core_sizes(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """Nodes and edges of the core of each order from 1 to the largest."""
    first = cores.select(F.col("node").alias("e1"), F.col("core").alias("c1")).hint("merge")
    second = cores.select(F.col("node").alias("e2"), F.col("core").alias("c2")).hint("merge")
    in_core = edges.join(first, "e1").join(second, "e2").groupBy(F.least("c1", "c2").alias("core")).agg(
        F.count(F.lit(1)).alias("edges")
    )
    # One row per order up to the largest core: reverse running totals over that small table.
    per_core = cores.groupBy("core").agg(F.count(F.lit(1)).alias("nodes")).join(in_core, "core", "left")
    rows = per_core.na.fill(0, ["edges"]).select("nodes", "edges", F.explode(F.sequence(F.lit(1).cast("bigint"), "core")).alias("k"))
    return rows.groupBy("k").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))


def egonet_features(edges: DataFrame) -> DataFrame:
    """Degree, edges inside the egonet and edges leaving it."""
    counts = cut_lineage(triangle_counts(edges))
    told = counts.select(F.col("node").alias("e2"), F.col("degree").alias("d"))
    around = both_ways(edges).join(told, "e2").groupBy(F.col("e1").alias("node")).agg(F.sum("d").alias("reach"))
    return counts.join(around, "node").select(
        "node",
        "degree",
        (F.col("degree") + F.col("triangles")).alias("inside"),
        (F.col("reach") - F.col("degree") - 2 * F.col("triangles")).alias("leaving"),
    )


def recursive_features(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Egonet features with the mean and sum of the neighbours' features appended each round."""
    base = egonet_features(edges)
    names = ["degree", "inside", "leaving"]
    features = base.select("node", *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    links = both_ways(edges)
    width = len(names)
    for _ in range(rounds):
        columns = [f"f{i}" for i in range(width)]
        told = features.withColumnRenamed("node", "e2")
        means = [F.avg(c).alias(f"f{width + i}") for i, c in enumerate(columns)]
        sums = [F.sum(c).alias(f"f{2 * width + i}") for i, c in enumerate(columns)]
        gathered = links.join(told, "e2").groupBy(F.col("e1").alias("node")).agg(*means, *sums)
        features = cut_lineage(features.join(gathered, "node", "left").na.fill(0.0))
        width *= 3
    return features


def adjacency_matrix(edges: DataFrame) -> DataFrame:
    """Both-way entries of the 0/1 matrix under dense ids from 0."""
    _, moved = relabel(edges)
    rows = moved.select((F.col("e1") - 1).alias("e1"), (F.col("e2") - 1).alias("e2"))
    return both_ways(rows).select(F.col("e1").alias("row"), F.col("e2").alias("col"), F.lit(1.0).alias("value"))
