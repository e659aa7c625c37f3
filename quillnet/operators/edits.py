"""Filters and projections of edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import skew
from quillnet.session import cut_lineage

LABEL_FROM_DAYS = 93
LABEL_TO_DAYS = 186


def human_edits(edits: DataFrame) -> DataFrame:
    """Edits by registered users whose name does not mention a bot."""
    return edits.filter(~C.is_anonymous(F.col("user_id")) & ~C.is_bot(F.col("username")))


def registered_edits(edits: DataFrame) -> DataFrame:
    """Edits whose user id is a number, with the id as a number."""
    return edits.withColumn("user_id", C.numeric_id(F.col("user_id"))).filter(F.col("user_id").isNotNull())


def with_period(edits: DataFrame) -> DataFrame:
    return edits.withColumn("period", C.period_label(F.col("year"), F.col("quarter"))).withColumn(
        "t", C.quarter_start(F.col("timestamp"))
    )


def with_day(edits: DataFrame) -> DataFrame:
    return edits.withColumn("edit_date", F.to_date("timestamp")).withColumn("edit_day", F.dayofyear("timestamp"))


def in_period(df: DataFrame, period: str) -> DataFrame:
    """Rows of one quarter, as predicates on the year and quarter columns so partitions are pruned."""
    year, quarter = (int(part) for part in period.split("-"))
    return df.filter((F.col("year") == year) & (F.col("quarter") == quarter))


def time_range_counts(edits: DataFrame, after: str, before: str) -> DataFrame:
    """Distinct users, articles and (user, article) pairs strictly inside a time range."""
    inside = edits.filter(
        (F.col("timestamp") > F.lit(after).cast("timestamp"))
        & (F.col("timestamp") < F.lit(before).cast("timestamp"))
    )
    return inside.select("user_id", "article_id").distinct().agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("article_id").alias("articles"),
        F.count(F.lit(1)).alias("pairs"),
    )


def hashed_sample(df: DataFrame, fraction: float, *keys: str, seed: int = 7) -> DataFrame:
    """Bernoulli sample by a hash of ``keys``: the same rows whatever the partitioning."""
    return df.filter(C.uniform_hash(*keys, seed=seed) < F.lit(fraction))


def anonymous_flag(edits: DataFrame) -> DataFrame:
    return edits.withColumn("anonymous", C.numeric_id(F.col("user_id")).isNull())


def fill_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.na.fill(defaults)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    return F.round(numerator * F.lit(1.0) / denominator, digits)


def edit_ranks(human: DataFrame) -> DataFrame:
    """Rank of each edit by time within its article and within its user; the edits are written once and read from there."""
    human = cut_lineage(human)
    by_article = skew.time_ranks(human, "article_id", "timestamp", "article_rank")
    by_user = skew.time_ranks(human, "user_id", "timestamp", "user_rank")
    return human.join(by_article, ["article_id", "timestamp"]).join(by_user, ["user_id", "timestamp"])


def creation_ranks(human: DataFrame) -> DataFrame:
    """The user's own edit rank for every edit that is the first of its article."""
    human = cut_lineage(human)
    created = human.groupBy("article_id").agg(F.min("timestamp").alias("timestamp"))
    by_user = skew.time_ranks(human, "user_id", "timestamp", "user_rank")
    return human.join(created, ["article_id", "timestamp"]).join(by_user, ["user_id", "timestamp"])


def first_quarters(human: DataFrame) -> DataFrame:
    """Each user's first quarter: one partial aggregate, no window over the edits."""
    return human.groupBy("user_id").agg(C.quarter_start(F.min("timestamp")).alias("first_quarter"))


def first_quarter_edits(human: DataFrame) -> DataFrame:
    """Edits made in the user's own first quarter."""
    firsts = first_quarters(human)
    return (
        human.withColumn("t", C.quarter_start(F.col("timestamp")))
        .join(firsts, "user_id")
        .filter(F.col("t") == F.col("first_quarter"))
        .drop("first_quarter")
    )


def beginnings(human: DataFrame, to_days: int = LABEL_TO_DAYS) -> DataFrame:
    """Each user's edits before the end of the label window: all that first quarters and labels need, a small share of a long log."""
    firsts = first_quarters(human)
    until = F.date_add(F.to_date("first_quarter"), to_days)
    return human.join(firsts, "user_id").filter(F.to_date("timestamp") < until).drop("first_quarter")


def next_period_contribution(
    human: DataFrame, from_days: int = LABEL_FROM_DAYS, to_days: int = LABEL_TO_DAYS
) -> DataFrame:
    """Sum of log(words + 1) strictly between ``from_days`` and ``to_days`` after the first quarter began.

    Edits are summed per (user, day) before anything else. The window borders are midnights, so
    only "exactly midnight" has to be kept apart for the strict lower border.
    """
    days = (
        human.withColumn("day", F.to_date("timestamp"))
        .groupBy("user_id", "day", (F.col("timestamp") == F.col("day").cast("timestamp")).alias("at_midnight"))
        .agg(F.sum(C.log_words(F.col("textdata"))).alias("contrib"))
    )
    first = F.to_date(C.quarter_start(F.min("day").over(Window.partitionBy("user_id"))))
    start = F.date_add(F.col("first_day"), from_days)
    end = F.date_add(F.col("first_day"), to_days)
    return (
        days.withColumn("first_day", first)
        .filter((F.col("day") > start) | ((F.col("day") == start) & ~F.col("at_midnight")))
        .filter(F.col("day") < end)
        .groupBy("user_id")
        .agg(F.sum("contrib").alias("contrib"))
    )
