import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillnet.operators import projection as P
from quillnet.plans.views import coin_pairs


@pytest.fixture(scope="module")
def blocks():
    draw = random.Random(11)
    rows = [(0, m) for m in draw.sample(range(10_000), 300)]
    return rows + [(b, m) for b in range(1, 60) for m in draw.sample(range(500), draw.randint(1, 12))]


def sampled(spark, blocks):
    frame = spark.createDataFrame(blocks, "block long, member long")
    return sorted(tuple(r) for r in P.sampled_pairs(frame, ["block"], "member").select("block", "e1", "e2").collect())


@pytest.mark.parametrize("window", [65_536, 50, 0])
def test_a_block_of_300_members_matches_its_sql(spark, blocks, monkeypatch, window):
    """Also where blocks are indexed over ranges instead of by one window."""
    monkeypatch.setattr(P, "WINDOW_MEMBERS", window)
    con = duckdb.connect()
    con.execute("CREATE TABLE rows (block BIGINT, member BIGINT)")
    con.executemany("INSERT INTO rows VALUES (?, ?)", blocks)
    assert sampled(spark, blocks) == sorted(con.execute(coin_pairs("rows", "block", "member")).fetchall())


def test_darts_follow_the_inverse_poisson_distribution(spark):
    """Plain terms and the loop after them give the place of the uniform number in the running totals."""
    import math

    def darts(rate, u):
        term = total = math.exp(-rate)
        n = 0
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        return n

    cases = [(rate, u / 997) for rate in (0.01, 0.7, 4.6, 12.0, 30.0) for u in range(997)]
    frame = spark.createDataFrame(cases, "rate double, u double")
    got = frame.select("rate", "u", P.poisson_darts(F.col("rate"), F.col("u")).alias("n")).collect()
    assert all(r.n == darts(r.rate, r.u) for r in got)


def test_pairs_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    members = spark.range(60).selectExpr("id % 2 AS article_id", "id AS user_id")  # two groups of 30, 870 pairs
    monkeypatch.setattr(P, "PAIRS_PER_TASK", 100)
    counts = P.user_projection(members)
    assert counts.rdd.getNumPartitions() == 9
    assert counts.count() == 870 and counts.filter("shared_articles != 1 OR e1 >= e2").isEmpty()


def test_pairs_of_large_groups_are_counted_without_a_shuffle_of_pairs(spark):
    """40 groups of 70 to 80 of 80 members: rows go to cells, and the only shuffle after them is that of rows."""
    members = spark.range(40 * 80).selectExpr("id div 80 AS article_id", "id % 80 * 1000003 - 5 AS user_id").filter("pmod(user_id, 79) >= article_id % 11")
    counts = P.shared_counts(members, ["article_id"], "user_id")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "direct_shuffle_partition_id(_cell" in plan
    first, second = members.toDF("article_id", "e1"), members.toDF("article_id", "e2")
    expected = first.join(second, "article_id").filter("e1 < e2").groupBy("e1", "e2").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, expected.collect()))
    strong = P.shared_counts(members, ["article_id"], "user_id", 38)
    assert sorted(map(tuple, strong.collect())) == sorted(map(tuple, expected.filter("n > 38").collect()))
