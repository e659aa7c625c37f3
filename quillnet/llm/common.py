"""Shared pieces of the text operators: states in the shared folder, components, grouped streams, registration."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnet.session import configure, scratch_path

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

# Java and DuckDB spelling of the separators between words (fixed by the definition of a word).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Rows handed to Python at once; texts are long, so the default of 10,000 would be hundreds of megabytes.
ARROW_ROWS = "128"


def query(key: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(builder: Builder) -> Builder:
        @functools.wraps(builder)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return builder(prepare(spark), folder)

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return builder

    return register


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class State:
    """A table in the shared folder that can be dropped when it has been replaced."""

    def __init__(self, df: DataFrame, name: str = "state"):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Alternating large and small stars until the links stop changing: each round is two joins against
    one row per node, so a hub is never gathered. Self loops keep their node. Empty edges give no rows.
    """
    nodes = edges.select("a", "b")
    links = nodes.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    state = State(links, "links")
    seen = None
    while True:
        ways = state.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(state.df.select("lo", "hi"))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            ways.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        )
        large = large.distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("e"))
        small = small.select(F.col("e.lo").alias("hi"), F.col("e.m").alias("lo")).filter("hi <> lo").distinct()
        newer = State(small, "links")
        now = newer.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        state.drop()
        state = newer
        if now == seen:
            break
        seen = now
    every = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(state.df.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def by_group(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of frames that arrive sorted by an integer ``key``; only one group is held at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        starts = [0, *((values[1:] != values[:-1]).nonzero()[0] + 1).tolist(), len(frame)]
        for i, j in zip(starts, starts[1:]):
            piece = frame.iloc[i:j]
            if held and held[0][key].iat[0] != piece[key].iat[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
