"""Contributor-article graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.operators import edits as E


def bipartite_edges(edits: DataFrame, period: str | None = None, by_quarter: bool = False) -> DataFrame:
    """(user, article, day) with the sum of log words and the number of edits.

    The period is filtered before grouping; edits of zero words have no logarithm and add nothing. ``by_quarter`` adds the first day
    of the quarter and deals the edits by (user, quarter), so that what follows per quarter of a user needs no further shuffle.
    """
    rows = E.registered_edits(edits)
    if period:
        rows = E.in_period(rows, period)
    sums = F.sum(F.log("textdata")).alias("word_count"), F.count(F.lit(1)).alias("num_edits")
    day = F.to_date("timestamp").alias("edit_date")
    if by_quarter:
        rows = rows.select("user_id", "article_id", day, "textdata").withColumn("first_day", F.trunc("edit_date", "quarter"))
        return rows.repartition("user_id", "first_day").groupBy("user_id", "article_id", "edit_date", "first_day").agg(*sums)
    return rows.groupBy("user_id", "article_id", day).agg(*sums)


def quarter_edges(edits: DataFrame, period: str) -> DataFrame:
    """(user, article) of one quarter with words and edits."""
    rows = E.in_period(E.registered_edits(edits), period)
    return rows.groupBy("user_id", "article_id").agg(
        F.sum("textdata").alias("word_count"), F.count(F.lit(1)).alias("num_edits")
    )


def day_edges(edits: DataFrame) -> DataFrame:
    """(user, article, day of year) with words and edits."""
    return edits.groupBy("user_id", "article_id", F.dayofyear("timestamp").alias("edit_day")).agg(
        F.sum("textdata").alias("word_count"), F.count(F.lit(1)).alias("num_edits")
    )


def memberships(edits: DataFrame) -> DataFrame:
    """Distinct (article, year, quarter, user) rows of registered users: blocks in long form."""
    return E.registered_edits(edits).select("article_id", "year", "quarter", "user_id").distinct()


def degrees(edges: DataFrame, node: str = "user_id", other: str = "article_id") -> DataFrame:
    return edges.groupBy(node).agg(F.countDistinct(other).alias("degree"))


def degree_filtered_edges(edits: DataFrame, period: str) -> DataFrame:
    """Edges of one quarter whose user touched more than one article."""
    edges = quarter_edges(edits, period)
    busy = edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > 1)
    return edges.join(busy, "user_id")


def snapshot_size(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges, users and articles, and users with a repeated edit, over all or per period."""
    return edges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("edges"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("article_id").alias("articles"),
        F.countDistinct(F.when(F.col("num_edits") > 1, F.col("user_id"))).alias("repeat_users"),
    )


def user_activity(bipartite: DataFrame) -> DataFrame:
    """Distinct articles, distinct days and summed contribution of each user."""
    return bipartite.groupBy("user_id").agg(
        F.countDistinct("article_id").alias("n_articles"),
        F.countDistinct("edit_date").alias("n_edits"),
        F.sum("word_count").alias("contribution"),
    )
