"""Exact Lloyd clustering of integer vectors with ns-bounds.

Every vector keeps its centroid, an upper bound on the distance to it, a lower bound on the distance to each other centroid,
and for each bound the round in which it was last evaluated. The history of centroids is kept; when a bound is
used it is loosened by the norm of the total displacement of that centroid since then, which is at most, and mostly less than, the
sum of the drifts of the rounds between. A vector whose loosened upper bound stays below all loosened lower bounds keeps its centroid
without a distance being computed. Otherwise the upper bound is evaluated, then exactly the centroids whose bounds still fail, in 64-bit
integers. Bounds have a margin for rounding, so the result is that of the plain algorithm, ties to the smaller number included.

A round is one pass over a written table, which holds vectors and bounds and replaces that of the round before. Sums are made per task,
then added per (cluster, component) as decimals; k times the number of components come to the driver, and the history sent with the
tasks is rounds times that. No row is shuffled or grouped, so a cluster may hold any share of the rows.

Vectors that are null, of another length, or hold null or non-finite components are left out. Repeated rows are vectors of their own.
Starting centroids go by hash of the id, equal hashes by the components; rows without an id come last. With fewer vectors than
clusters there are as many clusters as vectors; an empty table gives no rows. Components of 2**27 and more in magnitude (after scaling) are an error, as
their squared distances would not fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import State, query, table

CLUSTERS = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024
LARGEST = 1 << 27
# Relative margin of bounds; distances below 2**62 are exact and their roots are good to 2**-52.
MARGIN = 1e-9


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances in 64-bit integers."""
    difference = x - centre
    return np.einsum("ij,ij->i", difference, difference)


def unpack(bodies: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), "<i4").reshape(-1, width).astype(np.int64)


class Bounds:
    """Clusters, bounds and the rounds of their evaluation for one batch of vectors."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, seen: np.ndarray):
        self.cluster, self.upper, self.lower, self.seen = cluster, upper, lower, seen

    @classmethod
    def unknown(cls, n: int, k: int) -> Bounds:
        """Nothing evaluated: lower bounds of 0 and no upper bound."""
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k)), np.zeros((n, k), np.int64))


def assign(x: np.ndarray, bounds: Bounds, history: np.ndarray) -> int:
    """Assigns every vector to its nearest last centroid of ``history`` (round, k, width), in place; the number of distances computed."""
    now, k = len(history) - 1, history.shape[1]
    moved = np.sqrt(((history - history[now]).astype(float) ** 2).sum(axis=2)) * (1 + MARGIN)
    every = np.arange(len(x))
    cluster, lower = bounds.cluster, np.empty_like(bounds.lower)
    for j in range(k):
        lower[:, j] = (bounds.lower[:, j] - moved[bounds.seen[:, j], j]) * (1 - np.copysign(MARGIN, bounds.lower[:, j] - moved[bounds.seen[:, j], j]))
    upper = (bounds.upper + moved[bounds.seen[every, cluster], cluster]) * (1 + MARGIN)
    lower[every, cluster] = np.inf
    fails = np.flatnonzero(~(upper < lower.min(axis=1)))
    computed = 0
    if not len(fails):
        return computed

    # Exact distance to the own centroid first; it may settle the vector.
    square = np.empty(len(fails), np.int64)
    for j in range(k):
        own = np.flatnonzero(cluster[fails] == j)
        square[own] = distances(x[fails[own]], history[now, j])
    computed += len(fails)
    own = cluster[fails]
    bounds.upper[fails], bounds.seen[fails, own] = np.sqrt(square.astype(float)), now
    bounds.lower[fails, own] = bounds.upper[fails]
    best, nearest = square.copy(), own.copy()
    reach = np.sqrt(square.astype(float)) * (1 + MARGIN)
    for j in range(k):
        some = np.flatnonzero((own != j) & ~(reach < lower[fails, j]))
        if not len(some):
            continue
        there = distances(x[fails[some]], history[now, j])
        computed += len(some)
        bounds.lower[fails[some], j], bounds.seen[fails[some], j] = np.sqrt(there.astype(float)), now
        closer = (there < best[some]) | ((there == best[some]) & (j < nearest[some]))
        best[some[closer]], nearest[some[closer]] = there[closer], j
    bounds.cluster[fails], bounds.upper[fails] = nearest, np.sqrt(best.astype(float))
    return computed


STATE = "vec_id long, present boolean, x binary, cluster int, upper double, lower binary, seen binary"


def round_pass(history: np.ndarray):
    """Rows of the last state to those of this round."""
    k, width = history.shape[1:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = len(frame)
            if not n:
                continue
            x = unpack(frame["x"], width)
            if "cluster" in frame:
                lower, seen = (np.frombuffer(b"".join(frame[c]), t).reshape(n, k) for c, t in (("lower", "<f8"), ("seen", "<i4")))
                bounds = Bounds(frame["cluster"].to_numpy(np.int64).copy(), frame["upper"].to_numpy().copy(), lower.copy(), seen.astype(np.int64))
            else:
                bounds = Bounds.unknown(n, k)
            assign(x, bounds, history)
            lower, seen = bounds.lower.astype("<f8"), bounds.seen.astype("<i4")
            yield pd.DataFrame({
                "vec_id": frame["vec_id"], "present": frame["present"], "x": frame["x"], "cluster": bounds.cluster.astype(np.int32),
                "upper": bounds.upper, "lower": [r.tobytes() for r in lower], "seen": [r.tobytes() for r in seen],
            })

    return run


def cluster_sums(k: int, width: int):
    """Per task the sums of components and, as component ``width``, the vectors of every cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((k, width + 1), np.int64)
        for frame in frames:
            if len(frame):
                x, cluster = unpack(frame["x"], width), frame["cluster"].to_numpy()
                for j in range(k):
                    sums[j, :width] += x[cluster == j].sum(axis=0)
                sums[:, width] += np.bincount(cluster, minlength=k)
        j, i = np.divmod(np.arange(sums.size), width + 1)
        yield pd.DataFrame({"cluster": j, "component": i, "total": sums.ravel()})

    return run


def last_distances(centres: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                difference = unpack(frame["x"], centres.shape[1]) - centres[frame["cluster"].to_numpy()]
                yield pd.DataFrame({
                    "vec_id": frame["vec_id"], "present": frame["present"], "cluster": frame["cluster"],
                    "distance": np.einsum("ij,ij->i", difference, difference),
                })

    return run


def integer_vectors(vectors: DataFrame, key: str, embedding: str, width: int, scale: int) -> DataFrame:
    """(vec_id, present, vec) of the vectors that take part."""
    vec = F.col(embedding).cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).filter((F.size("vec") == width) & finite)
    whole = F.transform("vec", lambda v: F.floor(v * scale))
    large = F.exists("vec", lambda v: F.abs(v * scale) >= LARGEST)
    error = F.raise_error(F.lit(f"components of {LARGEST} and more (times {scale}) do not fit 64-bit distances"))
    whole = F.when(large, error.cast("array<bigint>")).otherwise(whole).cast("array<int>")
    return rows.select(F.coalesce("id", F.lit(0)).alias("vec_id"), F.col("id").isNotNull().alias("present"), whole.alias("vec"))


def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"vec_id": frame["vec_id"], "present": frame["present"], "x": [np.asarray(v, "<i4").tobytes() for v in frame["vec"]]})


def cluster_vectors(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: str = "3:", key: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part, as a written table."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, key, embedding, width, scale)
    state = State(whole.mapInPandas(pack, "vec_id long, present boolean, x binary"), "vectors")
    name = F.when(F.col("present"), F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    # The k first rows; ties of the hash go by the vector itself.
    first = whole.orderBy(name.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        state.drop()
        return spark.createDataFrame([], shape)
    history = np.array([[row["vec"] for row in first]], np.int64)
    for _ in range(rounds):
        newer = State(state.df.mapInPandas(round_pass(history), STATE), "bounds")
        state.drop()
        state = newer
        centres = history[-1].copy()
        parts = state.df.select("x", "cluster").mapInPandas(cluster_sums(len(first), width), "cluster int, component int, total long")
        sums = np.zeros((len(first), width + 1), object)
        for j, i, total in parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
            sums[j, i] = int(total)
        for j, row in enumerate(sums):
            if row[width]:
                centres[j] = [total // row[width] for total in row[:width]]
        history = np.concatenate([history, centres[None]])
    last = state.df.mapInPandas(round_pass(history), STATE).select("vec_id", "present", "cluster", "x")
    placed = State(last.mapInPandas(last_distances(history[-1]), "vec_id long, present boolean, cluster int, distance long"), "placed")
    state.drop()
    # One row per cluster.
    inertia = placed.df.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()
    of = {row["cluster"]: row["n"] for row in inertia}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    facts = spark.createDataFrame([(j, n, sum(of.values()), digests[j]) for j, n in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.df.join(facts, "cluster").select(F.when(F.col("present"), F.col("vec_id")).alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> str:
    """The plain algorithm: all distances in every round."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
          WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {width})""",
        "e AS MATERIALIZED (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM v)",
        f"""s0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v
          QUALIFY c < {k})""",
        "c0 AS MATERIALIZED (SELECT c, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM s0)",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""d{t} AS (SELECT r, c, sum((e.x - c{t}.x) * (e.x - c{t}.x))::BIGINT AS d FROM e JOIN c{t} USING (i) GROUP BY r, c),
            a{t} AS MATERIALIZED (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""m{t} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM e JOIN a{t} USING (r) GROUP BY c, i),
                c{t + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE s // n - CAST(s < 0 AND s % n <> 0 AS INT) END::BIGINT AS x
                  FROM c{t} LEFT JOIN m{t} USING (c, i))"""
            )
    return f"""WITH {', '.join(steps)},
    named AS (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN v USING (r) JOIN named USING (c)"""


@query("op13_centroid_clusters", clusters_sql())
def clusters_query(spark, folder):
    return cluster_vectors(table(spark, folder, "embeddings"))
