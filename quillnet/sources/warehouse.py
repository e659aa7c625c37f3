"""Edit-log views over the star-schema tables (the mapping is in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def edits(spark: SparkSession, folder: str, username: bool = True, category: bool = False) -> DataFrame:
    """One row per edit.

    The customer and part joins only bring in ``username`` and ``category``; their keys are
    foreign keys, so a job that does not read those columns does not pay for the join.
    """
    # What a line says is worked out before the join, where it is narrower.
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_shipdate",
        (F.col("l_returnflag") == "R").alias("minor"),
        F.floor(F.col("l_quantity") * F.col("l_quantity") / 2).cast("int").alias("textdata"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    owner = F.col("o_custkey")
    if username:  # names meet the orders, which are fewer and narrower than the lines
        people = table(spark, folder, "customer").select("c_custkey", "c_name")
        orders = orders.join(people, owner == F.col("c_custkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = [
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rev_id"),
        F.col("l_partkey").alias("article_id"),
        F.when(owner % 10 == 0, F.concat(F.lit("ip:"), owner.cast("string")))
        .otherwise(owner.cast("string"))
        .alias("user_id"),
    ]
    if username:
        columns.append(
            F.when(owner % 17 == 0, F.concat("c_name", F.lit("Bot"))).otherwise(F.col("c_name")).alias("username")
        )
    if category:
        parts = table(spark, folder, "part").select("p_partkey", "p_type")
        rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        columns.append(F.col("p_type").alias("category"))
    columns += [
        F.col("l_shipdate").alias("timestamp"),
        "minor",
        "textdata",
        F.year("l_shipdate").alias("year"),
        F.quarter("l_shipdate").alias("quarter"),
    ]
    return rows.select(*columns)


def monthly_edits(spark: SparkSession, folder: str) -> DataFrame:
    """One month of edits with a time of day, from the event table."""
    return table(spark, folder, "events").select(
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        F.col("ts").alias("timestamp"),
        F.floor("value").cast("int").alias("textdata"),
    )


def admins(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer")
    return people.filter(F.col("c_custkey") % 40 == 1).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username")
    )


def role_labels(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer")
    return people.filter(F.col("c_custkey") % 5 != 0).select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 8).cast("int").alias("role_id")
    )


def user_communities(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer")
    return people.select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 37).cast("int").alias("community_id")
    )


def article_communities(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    return parts.select(
        F.col("p_partkey").alias("article_id"), (F.col("p_partkey") % 37).cast("int").alias("community_id")
    )


def role_vectors(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    """Non-negative role vectors, one per node."""
    entries = [F.abs(F.element_at("embedding", i + 1)).cast("double") for i in range(width)]
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("user_id"), F.array(*entries).alias("vec")
    )
