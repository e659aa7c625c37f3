"""Views, edge lists, assignments, names and feature files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_view(spark: SparkSession, path: str, name: str = "edits") -> DataFrame:
    """A Parquet table, also as a temporary view."""
    rows = spark.read.parquet(path)
    rows.createOrReplaceTempView(name)
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema
    except AnalysisException:
        return False
    return True


def write_edge_list(
    edges: DataFrame, path: str, sep: str = "\t", header: bool = False, overwrite: bool = True, one_file: bool = False
) -> bool:
    """A directory of delimited edges; without ``overwrite`` an existing one is kept.

    ``one_file`` is for small graphs handed to other programs: it writes with a single task.
    """
    if not overwrite and _exists(edges.sparkSession, path):
        return False
    rows = edges.coalesce(1) if one_file else edges
    rows.write.csv(path, sep=sep, header=header, mode="overwrite")
    return True


def read_edge_list(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def read_assignments(spark: SparkSession, path: str, schema: str, sep: str = "\t", comment: str = "-") -> DataFrame:
    """Node labels from delimited text, with comment lines and leading blanks."""
    return spark.read.csv(path, schema=schema, sep=sep, comment=comment, ignoreLeadingWhiteSpace=True)


def read_admin_names(spark: SparkSession, path: str) -> DataFrame:
    """Names after the last ``User:`` of each line; lines without a name are dropped."""
    name = F.trim(F.element_at(F.split("value", "User:"), -1))
    return spark.read.text(path).filter(F.col("value").contains("User:")).select(name.alias("username")).filter(
        F.col("username") != ""
    )


def write_feature_csv(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headerless CSV, one column per feature."""
    features.write.csv(path, header=False, mode=mode)


def vector_lines(vectors: DataFrame, key: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """The key and the entries of vector columns as one delimited line each."""
    parts = [F.array_join(F.col(c).cast("array<string>"), sep) for c in columns]
    return vectors.select(F.concat_ws(sep, F.col(key).cast("string"), *parts).alias("value"))
