"""Structural roles: averages over neighbours and communities, factors and their meaning."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators.distributions import bin_index
from quillnet.operators.projection import both_ways
from quillnet.operators.skew import quantiles
from quillnet.session import cut_lineage

WORD_BITS = 64


def neighbour_role_mean(edges: DataFrame, vectors: DataFrame, width: int, weighted: bool = False) -> DataFrame:
    """Mean role vector of each node's neighbours.

    The weighted form averages vectors of unit sum scaled by the edge weight. One average per
    position is combined before the shuffle, so no list of neighbours is ever built. Sums are taken once a vector, before it
    meets its links, and a position is scaled where it is averaged. Null entries count in no mean.
    """
    total = C.vector_sum(F.filter("vec", lambda x: x.isNotNull())).alias("total")
    told = vectors.select(F.col("user_id").alias("e2"), "vec", *([total] if weighted else []))
    rows = both_ways(edges, "weight").join(told, "e2")
    entries = C.positions("vec", width)
    if weighted:
        entries = [F.when(F.col("total") != 0, x / F.col("total")).otherwise(x * 0.0) * F.col("weight") for x in entries]
    return rows.groupBy(F.col("e1").alias("user_id")).agg(F.array(*[F.avg(x) for x in entries]).alias("neighbour_vec"))


def leave_self_out_role_mean(vectors: DataFrame, width: int) -> DataFrame:
    """Mean of all other nodes' vectors, times the node's own share per role."""
    totals = vectors.agg(F.struct(C.sum_vector("vec", width).alias("total"), F.count(F.lit(1)).alias("n"))).scalar()
    others = F.zip_with(F.col("_t.total"), F.col("vec"), lambda t, x: (t - x) / (F.col("_t.n") - 1))
    share = C.unit_sum(F.col("vec"))
    return vectors.withColumn("_t", totals).select(
        "user_id", "vec", F.zip_with(others, share, lambda o, s: o * s).alias("other_vec")
    )


def community_role_mean(vectors: DataFrame, communities: DataFrame, width: int) -> DataFrame:
    """Mean role vector and size per community, scaled to unit sum; null is "no community"."""
    rows = vectors.join(communities, "user_id", "left").groupBy("community_id").agg(
        F.count(F.lit(1)).alias("size"), C.mean_vector("vec", width).alias("mean_vec")
    )
    return rows.withColumn("mean_vec", C.unit_sum(F.col("mean_vec")))


def role_similarity(vectors: DataFrame, reference: int | None = None) -> DataFrame:
    """Cosine of every vector to the one of a reference node (the lowest id by default)."""
    chosen = vectors if reference is None else vectors.filter(F.col("user_id") == reference)
    anchor = chosen.agg(F.min_by("vec", "user_id")).scalar()
    return vectors.withColumn("_anchor", anchor).select(
        "user_id", C.cosine_similarity(F.col("vec"), F.col("_anchor")).alias("similarity")
    )


def similarity_histogram(similarities: DataFrame, bins: int = 50) -> DataFrame:
    """Nodes per similarity bin over [0, 1]."""
    index = bin_index(F.col("similarity"), F.lit(0.0), F.lit(1.0), bins)
    return similarities.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def role_one_hot(users: DataFrame, roles: DataFrame, known: Sequence[int]) -> DataFrame:
    """One 0/1 column per known role and one for users without a role."""
    rows = users.join(roles, "user_id", "left").na.fill({"role_id": -1})
    flags = [(F.col("role_id") == r).cast("int").alias(role_name(r)) for r in (-1, *known)]
    return rows.select("user_id", *flags)


def role_name(role: int) -> str:
    return "role_none" if role < 0 else f"role_{role}"


def article_role_mix(
    bipartite: DataFrame, roles: DataFrame, known: Sequence[int], by_column: bool = False
) -> DataFrame:
    """Role shares of the (article, day) groups a user edited in, summed and normalised.

    Rows are scaled to unit sum; ``by_column`` divides by column sums instead.
    """
    rows = bipartite.join(roles, "user_id", "left").na.fill({"role_id": -1})
    names = {r: role_name(r) for r in (-1, *known)}
    shares = rows.groupBy("article_id", "edit_date").agg(
        *[F.avg((F.col("role_id") == r).cast("double")).alias(n) for r, n in names.items()]
    )
    mixed = (
        bipartite.select("user_id", "article_id", "edit_date")
        .join(shares, ["article_id", "edit_date"])
        .groupBy("user_id")
        .agg(*[F.sum(n).alias(n) for n in names.values()])
    )
    if by_column:
        totals = mixed.agg(F.struct(*[F.sum(n).alias(n) for n in names.values()])).scalar()
        return mixed.withColumn("_t", totals).select(
            "user_id", *[(F.col(n) / F.nullif(F.col(f"_t.{n}"), F.lit(0.0))).alias(n) for n in names.values()]
        )
    total = sum((F.col(n) for n in names.values()), F.lit(0.0))
    return mixed.select("user_id", *[(F.col(n) / total).alias(n) for n in names.values()])


def role_admin_counts(roles: DataFrame, admins: DataFrame) -> DataFrame:
    flags = admins.select("user_id", F.lit(1).alias("is_admin"))
    return roles.join(flags, "user_id", "left").groupBy("role_id").agg(
        F.count(F.lit(1)).alias("n_users"), F.count("is_admin").alias("n_admins")
    )


def role_summary(summary: DataFrame, vectors: DataFrame, admins: DataFrame) -> DataFrame:
    """Per strongest role: users, admins, means and sample deviations of three measures."""
    flags = admins.select("user_id", F.lit(1).alias("is_admin"))
    rows = summary.join(vectors, "user_id").join(flags, "user_id", "left")
    measures = ("n_articles", "n_edits", "edit_count")
    statistics = [f(m).alias(f"{p}_{m}") for m in measures for p, f in (("avg", F.avg), ("sd", F.stddev))]
    return (
        rows.groupBy(C.arg_max(F.col("vec")).alias("label"))
        .agg(F.count(F.lit(1)).alias("n_users"), F.count("is_admin").alias("n_admins"), *statistics)
        .withColumn("pct_admin", F.col("n_admins") / F.col("n_users"))
    )


def log_binned(features: DataFrame, columns: Sequence[str], share: float = 0.5) -> DataFrame:
    """Vertical logarithmic bins: the lowest share of a column becomes 0, the same share of the rest 1, and so on.

    Bins go on until the next one would hold less than one row. Borders are exact quantiles over ranges of
    (column, value), so no column is sorted in one task.
    """
    rows = max(1, features.count())
    levels = max(1, math.ceil(math.log(rows) / -math.log(1.0 - share)))
    fractions = [1.0 - (1.0 - share) ** (i + 1) for i in range(levels)]
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    found = quantiles(features.select(F.explode(cells).alias("_x")).select("_x.c", "_x.v"), ["c"], "v", fractions)
    borders = found.agg(F.struct(*[F.max(F.when(F.col("c") == c, F.col("at"))).alias(c) for c in columns])).scalar()
    rows = features.withColumn("_b", borders)

    def bin_of(column: str):
        return F.size(F.filter(F.col(f"_b.{column}"), lambda x: x < F.col(column))).cast("double").alias(column)

    return rows.select("node", *[bin_of(c) for c in columns])


def uncorrelated_columns(features: DataFrame, columns: Sequence[str], limit: float = 0.999) -> list[str]:
    """Columns left after dropping each one that repeats an earlier kept column."""
    vectors = features.select(array_to_vector(F.array(*columns)).alias("v"))
    matrix = np.nan_to_num(np.abs(Correlation.corr(vectors, "v").first()[0].toArray()), nan=1.0)
    kept: list[int] = []
    for j in range(len(columns)):
        if all(matrix[i, j] < limit for i in kept):
            kept.append(j)
    return [columns[j] for j in kept]


def as_vectors(features: DataFrame, columns: Sequence[str], key: str = "node") -> DataFrame:
    return features.select(F.col(key).alias("user_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))


# Factorisation V ~ G F with the Kullback-Leibler loss. F (parts x width) is small and travels
# with the tasks; G is never stored: for a given F each row of G depends on its own row of V only.

TINY = 1e-12


def _row_factors(v: np.ndarray, f: np.ndarray, inner: int) -> np.ndarray:
    g = np.full((v.shape[0], f.shape[0]), 1.0) * (v.sum(axis=1, keepdims=True) / max(f.sum(), TINY))
    weight = f.sum(axis=1) + TINY
    for _ in range(inner):
        g *= ((v / (g @ f + TINY)) @ f.T) / weight
    return g


def _divergence(v: np.ndarray, product: np.ndarray) -> float:
    logs = np.where(v > 0, v * np.log(np.where(v > 0, v, 1.0) / (product + TINY)), 0.0)
    return float((logs - v + product).sum())


def _entries(width: int) -> list[Column]:
    """The entries of ``vec`` as columns, which reach numpy without lists."""
    return [c.alias(f"_{i}") for i, c in enumerate(C.positions("vec", width))]


def _factor_sums(vectors: DataFrame, factors: Sequence[np.ndarray], inner: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each F, numerator and denominator of its update and its loss: parts x width + parts + 1 sums, all in one pass."""
    factors = list(factors)
    sizes = [f.size + len(f) + 1 for f in factors]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(size) for size in sizes]
        for batch in batches:
            v = batch.to_numpy(dtype=float)
            for f, own in zip(factors, sums):
                g = _row_factors(v, f, inner)
                product = g @ f
                own[: f.size] += (g.T @ (v / (product + TINY))).ravel()
                own[f.size : -1] += g.sum(axis=0)
                own[-1] += _divergence(v, product)
        yield pd.DataFrame({"i": np.arange(sum(sizes)), "x": np.concatenate(sums)})

    width = factors[0].shape[1]
    rows = vectors.select(*_entries(width)).mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(sum(sizes))
    for row in rows:
        flat[row["i"]] = row["x"]
    split = np.split(flat, np.cumsum(sizes)[:-1])
    return [(own[: f.size].reshape(f.shape), own[f.size : -1], float(own[-1])) for f, own in zip(factors, split)]


def _fit_factors(
    vectors: DataFrame, width: int, ranks: Sequence[int], rounds: int, inner: int, tolerance: float, seed: int
) -> list[tuple[np.ndarray, list[float]]]:
    """The role definitions and losses of every number of roles, fitted side by side: a round is one pass for all that still fall."""
    means = np.array(vectors.agg(C.mean_vector("vec", width)).first()[0], dtype=float)
    factors = [(means + TINY) * np.random.default_rng(seed).uniform(0.5, 1.5, size=(parts, width)) for parts in ranks]
    losses: list[list[float]] = [[] for _ in ranks]
    left = list(range(len(factors)))
    for _ in range(rounds):
        falling = []
        for k, (numerator, denominator, loss) in zip(left, _factor_sums(vectors, [factors[k] for k in left], inner)):
            losses[k].append(loss)
            if len(losses[k]) > 1 and losses[k][-2] - loss < tolerance * losses[k][0]:
                continue
            factors[k] = factors[k] * numerator / (denominator[:, None] + TINY)
            falling.append(k)
        left = falling
        if not left:
            break
    return list(zip(factors, losses))


def factor_roles(
    vectors: DataFrame, width: int, parts: int = 16, rounds: int = 1000, inner: int = 30, tolerance: float = 1e-4, seed: int = 7
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Non-negative factors of (user_id, vec): role weights per user, role definitions and the losses.

    A round is one pass over the written vectors; a lost executor only repeats its own rows. Rounds end
    when the loss falls by less than ``tolerance`` of the first one.
    """
    vectors = cut_lineage(vectors)
    f, losses = _fit_factors(vectors, width, [parts], rounds, inner, tolerance, seed)[0]

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = batch.drop(columns="user_id").to_numpy(dtype=float)
            yield pd.DataFrame({"user_id": batch["user_id"], "vec": list(_row_factors(v, f, inner))})

    result = vectors.select("user_id", *_entries(width)).mapInPandas(weights, "user_id long, vec array<double>")
    return result, f, losses


def description_length(rows: DataFrame, width: int) -> DataFrame:
    """Model bits plus divergence of V (``vec``) from its product ``fit``; entries with a zero have no logarithm and are left out."""
    cells = rows.select(F.explode(F.arrays_zip("vec", "fit")).alias("c")).select(
        F.col("c.vec").alias("v"), F.col("c.fit").alias("p")
    )
    error = F.sum(F.when((F.col("v") > 0) & (F.col("p") > 0), F.col("v") * F.log(F.col("v") / F.col("p")) - F.col("v") + F.col("p")))
    sums = cells.agg((F.count(F.lit(1)) / width).alias("n"), error.alias("divergence"))
    # The model term multiplies the width by rows plus columns, as the measure was defined.
    bits = WORD_BITS * width * (F.col("n") + width)
    return sums.select(bits.alias("model_bits"), "divergence", (bits + F.col("divergence")).alias("description_length"))


def rank_one_fit(vectors: DataFrame, width: int) -> DataFrame:
    """The best single-role product: row sums times column shares."""
    columns = vectors.agg(C.sum_vector("vec", width)).scalar()
    share = C.unit_sum(F.col("_c"))
    return vectors.withColumn("_c", columns).select(
        "user_id", "vec", C.vector_scale(share, C.vector_sum(F.col("vec"))).alias("fit")
    )


def rank_search(
    vectors: DataFrame, width: int, candidates: Sequence[int], rounds: int = 1000, inner: int = 30, tolerance: float = 1e-4, seed: int = 7
) -> DataFrame:
    """Final loss and description length for several numbers of roles, fitted side by side."""
    n = vectors.count()
    results = []
    for parts, (_, losses) in zip(candidates, _fit_factors(vectors, width, candidates, rounds, inner, tolerance, seed)):
        bits = WORD_BITS * parts * (n + width)
        results.append((int(parts), float(losses[-1]), float(bits + losses[-1])))
    return vectors.sparkSession.createDataFrame(results, "parts int, loss double, description_length double")


def role_pca(vectors: DataFrame, width: int, keep: float = 0.99) -> tuple[DataFrame, list[float]]:
    """Principal components of centred role vectors covering ``keep`` of the variance."""
    rows = vectors.select("user_id", array_to_vector("vec").alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    full = PCA(k=width, inputCol="c", outputCol="p").fit(centred)
    shares = full.explainedVariance.toArray()
    k = min(int(np.searchsorted(np.cumsum(shares), keep - 1e-12)) + 1, width)
    # A component's sign is free: its largest entry is made positive.
    loadings = full.pc.toArray()
    signs = [float(math.copysign(1.0, loadings[np.argmax(np.abs(loadings[:, j])), j])) for j in range(k)]
    scores = full.transform(centred).select("user_id", vector_to_array("p").alias("p"))
    components = F.array(*[F.element_at("p", j + 1) * signs[j] for j in range(k)])
    return scores.select("user_id", components.alias("components")), [float(s) for s in shares]


def _fixed_factor(xh: np.ndarray, hh: np.ndarray, xx: float, mean: float, rounds: int, tolerance: float) -> np.ndarray:
    """Non-negative W with X ~ W H for a fixed H, from the small products X H', H H' and the sum of squares of X."""
    w = np.full_like(xh, math.sqrt(mean / hh.shape[0]))

    def error() -> float:
        return math.sqrt(max(xx - 2 * float((w * xh).sum()) + float((w * (w @ hh)).sum()), 0.0))

    first = previous = error()
    for step in range(1, rounds + 1):
        w *= xh / np.maximum(w @ hh, TINY)
        if step % 10 == 0:
            now = error()
            if first > 0 and (previous - now) / first < tolerance:
                break
            previous = now
    return w


def role_sense(
    rows: DataFrame, measures: Sequence[str], width: int, rounds: int = 1000, tolerance: float = 1e-5
) -> DataFrame:
    """Weight of each role in each measure, and its ratio to the weight a single role would get.

    ``rows`` has the measures and a role vector. One aggregate pass gives all sums of products the
    fit needs; what is iterated afterwards is (measures x roles), whatever the number of users.
    """
    m = len(measures)
    size = m + width + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((size, size))
        for batch in batches:
            x = np.column_stack([batch.to_numpy(dtype=float), np.ones(len(batch))])
            sums += x.T @ x
        yield pd.DataFrame({"i": np.arange(sums.size), "x": sums.ravel()})

    entries = rows.select(*[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(measures)], *_entries(width))
    cells = entries.mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(size * size)
    for row in cells.collect():  # measures and roles squared, whatever the rows
        flat[row["i"]] = row["x"]
    sums = flat.reshape(size, size)
    xh, hh = sums[:m, m:-1], sums[m:-1, m:-1]
    column, n = sums[:m, -1], sums[-1, -1]
    xx, mean = float(np.trace(sums[:m, :m])), float(column.sum() / (m * n))
    w = _fixed_factor(xh, hh, xx, mean, rounds, tolerance)
    single = _fixed_factor(column.reshape(m, 1), np.array([[float(n)]]), xx, mean, rounds, tolerance)
    result = [
        (measures[i], j, float(w[i, j]), float(w[i, j] / single[i, 0]) if single[i, 0] > 0 else None)
        for i in range(m)
        for j in range(width)
    ]
    return rows.sparkSession.createDataFrame(result, "measure string, role int, weight double, ratio double")


def role_affinity(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """Weight of each own role in each role of the neighbours."""
    around = neighbour_role_mean(edges, vectors, width)
    rows = vectors.join(around, "user_id")
    names = [f"neighbour_role_{i}" for i in range(width)]
    rows = rows.select("vec", *[F.element_at("neighbour_vec", i + 1).alias(n) for i, n in enumerate(names)])
    return role_sense(rows, names, width)
