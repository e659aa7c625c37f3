"""Distributions, percentiles and fits over edit logs and graphs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.operators.skew import quantiles

from quillnet.functions import columns as C


def counts_of(df: DataFrame, key: str, measure: Column, name: str, total: str) -> DataFrame:
    """Two-level count: aggregate per key, then the number of keys per value."""
    return df.groupBy(key).agg(measure.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias(total))


def article_edit_distribution(human: DataFrame) -> DataFrame:
    return counts_of(human, "article_id", F.count(F.lit(1)), "num_edits", "articles")


def user_edit_distribution(human: DataFrame) -> DataFrame:
    return counts_of(human, "user_id", F.count(F.lit(1)), "num_edits", "users")


def edit_word_distribution(human: DataFrame) -> DataFrame:
    return human.groupBy("textdata").agg(F.count(F.lit(1)).alias("edit_count"))


def user_word_distribution(human: DataFrame) -> DataFrame:
    return counts_of(human, "user_id", F.sum("textdata"), "total_words", "num_users")


def account_durations(human: DataFrame) -> DataFrame:
    """Users per rounded number of days between their first and last edit."""
    seconds = F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))
    return counts_of(human, "user_id", F.round(seconds / 3600 / 24), "days", "num_users")


def active_days(edits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Users per whole days between their first and last edit, over all or per period."""
    spans = edits.groupBy(*by, "user_id").agg(F.datediff(F.max("timestamp"), F.min("timestamp")).alias("days"))
    return spans.groupBy(*by, "days").agg(F.count(F.lit(1)).alias("n_users"))


def degree_distribution(edits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Users per number of distinct articles."""
    degrees = edits.groupBy(*by, "user_id").agg(F.countDistinct("article_id").alias("degree"))
    return degrees.groupBy(*by, "degree").agg(F.count(F.lit(1)).alias("n_users"))


def quarter_anonymous_stats(edits: DataFrame) -> DataFrame:
    return (
        edits.groupBy("year", "quarter", C.numeric_id(F.col("user_id")).isNull().alias("anonymous"))
        .agg(
            F.sum("textdata").alias("words"),
            F.sum(F.col("minor").cast("int")).alias("minor_edits"),
            F.countDistinct("user_id").alias("n_users"),
            F.count(F.lit(1)).alias("n_edits"),
        )
    )


def clique_sizes(bipartite: DataFrame) -> DataFrame:
    """Users of each (article, day) and the pairs among them; bipartite rows are already distinct."""
    return bipartite.groupBy("article_id", "edit_date").agg(F.count(F.lit(1)).alias("n_users")).withColumn(
        "clique_edges", C.pair_count(F.col("n_users"))
    )


def clique_size_distribution(cliques: DataFrame) -> DataFrame:
    return cliques.groupBy("n_users").agg(
        F.count(F.lit(1)).alias("n_cliques"), F.sum("clique_edges").alias("clique_edges")
    )


def clique_edge_totals(cliques: DataFrame, small: int = 6) -> DataFrame:
    return cliques.agg(
        F.count(F.lit(1)).alias("cliques"),
        F.sum("n_users").alias("memberships"),
        F.sum("clique_edges").alias("edges"),
        F.sum(F.when(F.col("clique_edges") <= small, F.col("clique_edges")).otherwise(0)).alias("small_edges"),
    )


def percentile_columns(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Minimum, maximum and exact percentiles, one row per (column, fraction)."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(values.alias("r")).select("r.*")
    ends = long.groupBy("measure").agg(F.min("value").alias("smallest"), F.max("value").alias("largest"))
    at = quantiles(long, ["measure"], "value", fractions)
    picks = [F.struct(F.lit(f).alias("fraction"), F.element_at("at", i + 1).alias("value")) for i, f in enumerate(fractions)]
    return ends.join(at, "measure").select("measure", "smallest", "largest", F.explode(F.array(*picks)).alias("r")).select(
        "measure", "smallest", "largest", "r.*"
    )


def counts_above(df: DataFrame, column: str, thresholds: Sequence[int], name: str = "n") -> DataFrame:
    """Rows with a value above each threshold, zero included, from one histogram of the values."""
    limits = F.array(*[F.lit(int(t)) for t in thresholds])
    histogram = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    above = (
        histogram.select(F.explode(F.filter(limits, lambda t: t < F.col(column))).alias("threshold"), "_n")
        .groupBy("threshold")
        .agg(F.sum("_n").alias(name))
    )
    every = df.sparkSession.range(1).select(F.explode(limits).alias("threshold"))
    return every.join(above, "threshold", "left").na.fill(0, [name])


def threshold_sweep(edges: DataFrame, thresholds: Sequence[int], weight: str = "shared_articles") -> DataFrame:
    """Nodes, edges and density of the graph above each weight threshold, in one pass."""
    strongest = (
        edges.select(F.explode(F.array("e1", "e2")).alias("node"), weight).groupBy("node").agg(F.max(weight).alias("w"))
    )
    nodes = counts_above(strongest, "w", thresholds, "nodes")
    links = counts_above(edges, weight, thresholds, "edges")
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    return nodes.join(links, "threshold").withColumn(
        "density", F.when(possible > 0, F.col("edges") / possible).otherwise(F.lit(0.0))
    )


def summary_with_bound(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, median, size and the 1.96 standard-error bound of a value."""
    key = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    stats = rows.groupBy(*key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(F.lit(1)).alias("n_samples")
    )
    medians = quantiles(rows, key, value, [0.5])
    stats = stats.join(medians, key, "left").select(
        *by, "mean", "deviation", F.element_at("at", 1).alias("median"), "n_samples"
    )
    return stats.withColumn("error_bound", F.col("deviation") * 1.96 / F.sqrt("n_samples"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """Neighbours of each node of an edge list without repeated pairs."""
    return (
        edges.select(F.explode(F.array("e1", "e2")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    )


def linear_fits(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Least-squares line and r squared for several (x, y) pairs in one pass."""
    rows = []
    aggregates = []
    for name, (x, y) in pairs.items():
        aggregates += [
            F.regr_slope(y, x).alias(f"{name}_slope"),
            F.regr_intercept(y, x).alias(f"{name}_intercept"),
            F.regr_r2(y, x).alias(f"{name}_r2"),
            F.regr_count(y, x).alias(f"{name}_n"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("pair"),
                F.col(f"{name}_slope").alias("slope"),
                F.col(f"{name}_intercept").alias("intercept"),
                F.col(f"{name}_r2").alias("r2"),
                F.col(f"{name}_n").alias("n"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value; the upper border belongs to the last bin."""
    width = (high - low) / bins
    return F.when(width > 0, F.least(F.floor((value - low) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def histogram(
    df: DataFrame, value: str, bins: int, weight: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Counts, or summed weights, per equal-width bin between the smallest and largest value."""
    bounds = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    binned = df.withColumn("_bounds", bounds).withColumn(
        "bin", bin_index(F.col(value), F.col("_bounds.low"), F.col("_bounds.high"), bins)
    )
    return binned.groupBy(*by, "bin").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("total")
    )


def density_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts per cell of a square grid over two measures."""
    bounds = df.agg(
        F.struct(
            F.min(x).alias("x_low"), F.max(x).alias("x_high"), F.min(y).alias("y_low"), F.max(y).alias("y_high")
        )
    ).scalar()
    cells = df.withColumn("_b", bounds).select(
        bin_index(F.col(x), F.col("_b.x_low"), F.col("_b.x_high"), bins).alias("x_bin"),
        bin_index(F.col(y), F.col("_b.y_low"), F.col("_b.y_high"), bins).alias("y_bin"),
    )
    return cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def kernel_density(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    low: float = 1.0,
    high: float = 10.0,
    points: int = 1000,
    bandwidth: float = 0.5,
) -> DataFrame:
    """Gaussian kernel density on a fixed grid; equal values are counted before they meet the grid."""
    values = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    spread = values.select(*by, value, "_n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = F.lit(low) + F.col("point") * F.lit((high - low) / (points - 1))
    kernel = F.exp(-0.5 * F.pow((at - F.col(value)) / bandwidth, 2)) / (bandwidth * math.sqrt(2 * math.pi))
    return spread.groupBy(*by, "point").agg((F.sum(F.col("_n") * kernel) / F.sum("_n")).alias("density"))


def powerlaw_fit(df: DataFrame, value: str) -> DataFrame:
    """Exponent of a power law on (loc, loc + scale], by closed-form maximum likelihood.

    loc is one below the smallest value and scale reaches the largest, so every logarithm exists.
    """
    values = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    bounds = values.agg(F.struct((F.min(value) - 1).alias("loc"), F.max(value).alias("top"))).scalar()
    placed = values.withColumn("_b", bounds).select(
        "_n", F.col("_b.loc").alias("loc"), (F.col("_b.top") - F.col("_b.loc")).alias("scale"), F.col(value).alias("_x")
    )
    fitted = placed.groupBy("loc", "scale").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.log((F.col("_x") - F.col("loc")) / F.col("scale"))).alias("_logs")
    )
    return fitted.select((-F.col("n") / F.col("_logs")).alias("a"), "loc", "scale", "n")
