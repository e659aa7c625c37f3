"""Blocks of neighbouring active days of an article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_day_blocks(bipartite: DataFrame) -> DataFrame:
    """(article, day, block): a day with a single user also joins the block of the next active day.

    Days are counted before they are numbered, so a window sees at most the days of one article.
    """
    days = bipartite.groupBy("article_id", "edit_date").agg(F.count(F.lit(1)).alias("n_users"))
    number = F.row_number().over(Window.partitionBy("article_id").orderBy("edit_date")).cast("bigint")
    own = F.array(F.col("number"))
    both = F.array(F.col("number"), F.col("number") + 1)
    return days.withColumn("number", number).select(
        "article_id", "edit_date", F.explode(F.when(F.col("n_users") == 1, both).otherwise(own)).alias("block")
    )
