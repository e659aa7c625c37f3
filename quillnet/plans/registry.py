"""Registry of named queries and their SQL oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillnet.plans.views import with_views
from quillnet.session import configure

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, uses: str = "", more: str = "") -> Callable[[Builder], Builder]:
    """Register a builder under ``key``; the oracle sees the named views and extra CTEs."""

    def register(builder: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query: {key}")

        @functools.wraps(builder)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return builder(configure(spark), folder)

        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_views(uses, more, sql)
        return builder

    return register
