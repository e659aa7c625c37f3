"""Who comes back in a later quarter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.operators.skew import quantiles

QUARTILES = (0.25, 0.5, 0.75)


def period_number(year: str = "year", quarter: str = "quarter") -> Column:
    """Consecutive number of a quarter, so that "next quarter" is plus one."""
    return F.col(year) * 4 + F.col(quarter) - 1


def with_base(base: DataFrame) -> DataFrame:
    """Year and quarter back from the period number."""
    return base.select(
        F.floor(F.col("period") / 4).cast("int").alias("year"),
        (F.col("period") % 4 + 1).cast("int").alias("quarter"),
        *[c for c in base.columns if c != "period"],
    )


def overlap(first: DataFrame, later: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group of ``keys``: distinct users of ``first`` and the share also found in ``later``."""
    keys = list(keys)
    users = first.select(*keys, "user_id").distinct()
    back = later.select(*keys, "user_id").distinct().withColumn("_back", F.lit(1))
    return (
        users.join(back, [*keys, "user_id"], "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("users"), F.count("_back").alias("retained"))
        .withColumn("overlap", F.col("retained") / F.col("users"))
    )


def retention_overlap(edges: DataFrame, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """For every quarter, the share of its users seen again one, two and three quarters later."""
    users = edges.select(period_number().alias("period"), "user_id").distinct()
    steps = F.explode(F.array(*[F.lit(int(lag)) for lag in lags])).alias("lag")
    first = users.select("period", "user_id", steps)
    later = users.select("period", "user_id", steps).withColumn("period", F.col("period") - F.col("lag"))
    return with_base(overlap(first, later, ["period", "lag"]))


def _bucketed(rows: DataFrame, cuts: DataFrame, bucket: Column) -> DataFrame:
    placed = rows.join(cuts, "period").withColumn("bucket", bucket)
    return placed.filter(F.col("bucket").isNotNull())


def _by_quartile(rows: DataFrame, value: str, bucket: Column) -> DataFrame:
    cuts = quantiles(rows, ["period"], value, QUARTILES, "cut")
    first = _bucketed(rows, cuts, bucket)
    later = _bucketed(rows.withColumn("period", F.col("period") - 1), cuts, bucket)
    return with_base(overlap(first, later, ["period", "bucket"]))


def retention_by_words(edges: DataFrame) -> DataFrame:
    """Next-quarter overlap inside quartiles of edge word counts; values on a border are left out."""
    rows = edges.select(period_number().alias("period"), "user_id", "word_count")
    w, cut = F.col("word_count"), F.col("cut")
    bucket = (
        F.when(w < cut[0], 1)
        .when((w > cut[0]) & (w < cut[1]), 2)
        .when((w > cut[1]) & (w < cut[2]), 3)
        .when(w > cut[2], 4)
    )
    return _by_quartile(rows, "word_count", bucket)


def retention_by_degree(edges: DataFrame) -> DataFrame:
    """Next-quarter overlap inside quartiles of the degree of users with more than one article."""
    rows = (
        edges.groupBy(period_number().alias("period"), "user_id")
        .agg(F.countDistinct("article_id").alias("degree"))
        .filter(F.col("degree") > 1)
    )
    d, cut = F.col("degree"), F.col("cut")
    bucket = F.when(d <= cut[0], 1).when(d <= cut[1], 2).when(d <= cut[2], 3).otherwise(4)
    return _by_quartile(rows, "degree", bucket)
