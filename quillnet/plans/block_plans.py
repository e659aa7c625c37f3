"""Blocks of neighbouring active days."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.operators import blocks as N
from quillnet.plans.registry import query
from quillnet.sources import warehouse as W


@query(
    "nearest_day_blocks",
    uses="monthly",
    more="""days AS (SELECT DISTINCT user_id, article_id, CAST("timestamp" AS DATE) AS edit_date FROM monthly),
    cnt AS (SELECT article_id, edit_date, count(*) AS n_users FROM days GROUP BY 1, 2),
    lab AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY edit_date) AS rownum FROM cnt)""",
    sql="""SELECT article_id, edit_date, CAST(rownum AS BIGINT) AS block FROM lab
    UNION SELECT article_id, edit_date, CAST(rownum + 1 AS BIGINT) FROM lab WHERE n_users = 1""",
)
def nearest_day_blocks(spark, folder):
    rows = W.monthly_edits(spark, folder).select("user_id", "article_id", F.to_date("timestamp").alias("edit_date"))
    return N.nearest_day_blocks(rows.distinct())
