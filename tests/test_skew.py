import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import projection as P
from quillnet.plans.views import coin_pairs, counted_pairs
from quillnet.operators import skew


def test_ordered_index_spans_buckets(spark):
    ids = [1, 5, 2**18 - 1, 2**18, 2**19 + 7, 2**40, 2**40 + 1]
    df = spark.createDataFrame([(g, i) for g in (1, 2) for i in ids], "g int, id long")
    rows = skew.ordered_index(df, ["g"], "id", "place").collect()
    assert {(r.g, r.id): r.place for r in rows} == {(g, i): p for g in (1, 2) for p, i in enumerate(ids)}


def test_time_ranks_match_plain_rank(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(3), draw.randrange(20) * 43_210) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"), "s")
    ranks = skew.time_ranks(df, "k", "ts", "r").select("k", F.unix_timestamp("ts").alias("s"), "r").collect()
    for r in ranks:
        assert r.r == 1 + sum(1 for k, s in rows if k == r.k and s < r.s)


def test_group_pairs_in_cells_list_every_pair_once(spark):
    members = {1: range(50), 2: [3, 9], 3: [7]}
    df = spark.createDataFrame([(g, m) for g, ms in members.items() for m in ms], "g int, m long")
    for cell in (4, 2048):
        pairs = [tuple(r) for r in skew.group_pairs(df, ["g"], "m", cell_members=cell).collect()]
        expected = [(g, a, b) for g, ms in members.items() for a, b in itertools.combinations(ms, 2)]
        assert sorted(pairs) == sorted(expected)


def test_priority_head_keeps_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(skew, "CELL_MEMBERS", 8)
    draw = random.Random(2)
    rows = [(g, i, draw.random()) for g, n in ((1, 100), (2, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, id long, u double")
    kept = skew.priority_head(df, ["g"], "u", F.lit(100), F.lit(20), ["id"]).collect()
    for g, quota in ((1, 20), (2, 5)):
        best = sorted(u for h, _, u in rows if h == g)[:quota]
        assert sorted(r.u for r in kept if r.g == g) == best


@pytest.mark.parametrize("method", ["any", "all"])
def test_keep_probability_solves_its_equation(spark, method):
    df = spark.range(2, 200).select(F.col("id").alias("k"), C.keep_probability(F.col("id"), 0.01, method).alias("p"))
    for r in df.collect():
        alone = (1 - r.p) ** (r.k - 1)
        missed = alone if method == "any" else 1 - (1 - alone) ** r.k
        assert 0 < r.p < 1
        assert missed == pytest.approx(0.01, rel=1e-6)


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(1, 10 * m) for m in range(600)] + [(2, m) for m in range(12)] + [(3, m) for m in range(3)]
    return spark.createDataFrame(rows, "block int, m long").cache()


@pytest.mark.parametrize("exact", [None, 10])
def test_sampled_pairs_of_large_blocks(spark, blocks, exact):
    pairs = P.sampled_pairs(blocks, ["block"], "m", exact_count_from=exact).collect()
    seen = {(r.block, r.e1, r.e2) for r in pairs}
    assert len(seen) == len(pairs)
    whole = {(b, x, y) for b, ms in ((1, range(0, 6000, 10)), (2, range(12)), (3, range(3)))
             for x, y in itertools.combinations(ms, 2)}
    assert seen <= whole
    p = 1 - 0.01 ** (1 / 599)
    total = 600 * 599 // 2
    large = [t for t in seen if t[0] == 1]
    if exact is None:
        assert abs(len(large) - total * p) < 6 * math.sqrt(total * p * (1 - p))
    else:
        assert len(large) == math.ceil(total * p)
        assert len([t for t in seen if t[0] == 2]) == math.ceil(66 * (1 - 0.01 ** (1 / 11)))
    # Partners are spread over the whole block, early and late members alike.
    ends = [e for _, a, b in large for e in (a, b)]
    assert abs(sum(ends) / len(ends) - 2995) < 250
    touched = {e for _, a, b in large for e in (a, b)}
    assert len(touched) > 0.95 * 600


def test_coins_are_fair_for_every_pair(spark):
    rows = [(b, m) for b in range(300) for m in range(20)]
    df = spark.createDataFrame(rows, "block int, m long")
    p = 1 - 0.01 ** (1 / 19)
    expected, spread = 300 * 190 * p, math.sqrt(300 * 190 * p * (1 - p))
    per_pair = P.sampled_pairs(df, ["block"], "m").groupBy("e1", "e2").count().collect()
    assert abs(sum(r["count"] for r in per_pair) - expected) < 6 * spread
    sd = math.sqrt(300 * p * (1 - p))
    assert all(abs(r["count"] - 300 * p) < 6 * sd for r in per_pair)
    assert len(per_pair) == 190


@pytest.mark.parametrize("exact", [None, 10])
def test_one_rule_for_blocks_of_every_size(spark, exact):
    """The SQL oracle's rule, on blocks on both sides of any size an operator might switch at."""
    rows = [(b, 7 * m + b) for b, k in enumerate((2, 3, 9, 10, 128, 129, 300, 700)) for m in range(k)]
    df = spark.createDataFrame(rows, "block int, m long")
    got = {(r.block, r.e1, r.e2) for r in P.sampled_pairs(df, ["block"], "m", exact_count_from=exact).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE rows (block INT, m BIGINT)")
    con.executemany("INSERT INTO rows VALUES (?, ?)", rows)
    few = "TRUE" if exact is None else f"k < {exact}"
    expected = set(con.execute(coin_pairs("rows", "block", "m", few)).fetchall())
    if exact is not None:
        expected |= set(con.execute(counted_pairs("rows", "block", "m", f"k >= {exact}")).fetchall())
    assert got == expected


def test_dense_ids_and_relabel(spark, edge_frame):
    edges = edge_frame([(10, 40), (40, 2**41), (10, 7)])
    nodes, moved = P.relabel(edges, "weight")
    assert {r.node: r.rank for r in nodes.collect()} == {7: 1, 10: 2, 40: 3, 2**41: 4}
    assert {(r.e1, r.e2) for r in moved.collect()} == {(2, 3), (3, 4), (1, 2)}


def test_pairs_are_made_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Rows that meet to make pairs are dealt to a number of tasks by their count; small bytes made few tasks of many pairs."""
    monkeypatch.setattr(P, "ROWS_PER_TASK", 6)
    members = spark.range(120).selectExpr("id % 40 AS g", "id AS m")
    counts = P.shared_counts(members, ["g"], "m")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [g") == 2 and "_col#" in plan and ", 20" in plan
    assert sorted(map(tuple, counts.collect())) == sorted((a, b, 1) for a in range(120) for b in range(a + 40, 120, 40))
