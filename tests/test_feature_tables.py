"""Steps of the model table that move few bytes, held against the plain ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillnet.operators import bipartite as B
from quillnet.operators import communities as K
from quillnet.operators import features as X
from quillnet.operators import similarity as S
from quillnet.operators import skew

EDITS = "user_id string, username string, article_id long, timestamp timestamp, minor boolean, textdata int"


@pytest.fixture(scope="module")
def log(spark):
    draw = random.Random(3)
    start = dt.datetime(2001, 1, 1)
    rows = [
        (str(u := draw.randrange(30)), f"name{u}" + ("Bot" if u % 7 == 0 else ""), draw.randrange(12), start + dt.timedelta(hours=draw.randrange(9000)), draw.random() < 0.3, draw.randrange(0, 1300))
        for _ in range(600)
    ]
    rows += [("ip:5", "name5", 3, start, False, 10), ("4", "name4", 3, None, True, 70), ("4", "name4", 3, None, True, 70), (None, None, 2, start, None, None)]
    return spark.createDataFrame(rows, EDITS).cache()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_wanted_ranks_are_those_of_all(log):
    wanted = log.filter("textdata % 3 = 0").select("article_id", "timestamp")
    every = skew.time_ranks(log, "article_id", "timestamp", "r").join(wanted.distinct(), ["article_id", "timestamp"])
    some = skew.time_ranks(log, "article_id", "timestamp", "r", wanted=wanted)
    assert sorted(some.collect()) == sorted(every.select("article_id", "timestamp", "r").collect())
    assert some.count() > 100


def test_wanted_article_quarters_are_those_of_all(log):
    wanted = log.filter("textdata % 5 = 0").select("article_id", F.date_trunc("quarter", "timestamp").alias("t")).distinct()
    every = X.article_quarter_features(log)
    some = X.article_quarter_features(log, wanted)
    rows = {(r.article_id, r.t): r for r in every.collect()}
    found = some.select(*every.columns).collect()
    assert found and len(found) == wanted.filter("t IS NOT NULL").count()
    for r in found:
        assert tuple(r)[2:] == pytest.approx(tuple(rows[r.article_id, r.t])[2:])


def test_quarters_of_users_take_one_shuffle(log, monkeypatch):
    plans = []
    monkeypatch.setattr(K, "cut_lineage", lambda df: plans.append(df) or df)
    edges = B.bipartite_edges(log, by_quarter=True)
    touches = K.quarter_touches(edges)
    assert exchanges(plans[0]) == 1
    plain = B.bipartite_edges(log)
    assert sorted(edges.select(*plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)
    given = sorted(K.user_contribution(plain).collect(), key=str)
    held = sorted(K.user_contribution(plain, touches).collect(), key=str)
    assert [r[:3] for r in held] == [r[:3] for r in given]
    assert [r[3] for r in held] == [pytest.approx(r[3]) for r in given]


def test_users_whose_first_articles_have_no_community(spark):
    """A user's first quarter is that of the first article with a community; a community given twice counts twice."""
    day = lambda month: dt.date(2001, month, 1)
    rows = [(1, 10, day(1), 5.0), (1, 11, day(4), 7.0), (2, 11, day(1), 9.0), (2, 12, day(1), 3.0), (2, 12, day(7), 3.0), (3, 10, day(1), 2.0)]
    edges = spark.createDataFrame([(*r, 1) for r in rows], "user_id long, article_id long, edit_date date, word_count double, num_edits long")
    communities = spark.createDataFrame([(11, 0), (12, 1), (12, 1), (13, 2), (10, None)], "article_id long, community_id int")
    found = {r.user_id: r for r in K.article_community_features(edges, communities).collect()}
    values = K.article_community_values(K.article_contribution(edges), communities).collect()
    value = {(v.article_id, v.quarter): v for v in values}
    assert set(found) == {1, 2}
    assert found[1].avg_yval == pytest.approx(value[11, 2].avg_yval)
    assert found[1].avg_csize == value[11, 2].c_size
    mix = [value[11, 1], value[12, 1], value[12, 1]]
    assert found[2].avg_csize == pytest.approx(sum(v.c_size for v in mix) / 3)
    assert found[2].avg_syval == pytest.approx(sum(v.self_yval for v in mix) / 3)


def test_figures_of_a_users_community_are_over_all_rows(spark):
    rows = [(1, 2001, 1, 2.0), (1, 2001, 2, None), (2, 2001, 1, 4.0), (3, 2001, 1, 1.0)]
    given = spark.createDataFrame(rows, "user_id long, year int, quarter int, yval double")
    communities = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 6)], "user_id long, community_id int")
    found = {r.user_id: (r.avg_yval, r.c_size) for r in K.user_community_features(given, communities).collect()}
    assert found == {1: (3.0, 3), 2: (3.0, 3), 3: (1.0, 1)}


def test_items_of_one_set_go_no_further_than_its_size(spark, monkeypatch):
    rows = [(1, 1, a) for a in (1, 2, 3, 90)] + [(1, 2, a) for a in (1, 2, 3, 91)] + [(1, 3, 92), (2, 1, 1), (None, 4, 1), (1, 5, None)]
    members = spark.createDataFrame(rows + rows[:3], "g int, u long, a long")
    moved = []
    monkeypatch.setattr(S, "cut_lineage", lambda df: moved.append(df) or df)
    found = S.close_pairs(members, ["g"], "u", "a", 0.5).collect()
    assert [tuple(r) for r in found] == [(1, 1, 2, pytest.approx(1 - 3 / 5))]
    assert sorted((r.u, r.a, r["_d"]) for r in moved[0].collect()) == [(u, a, 4) for u in (1, 2) for a in (1, 2, 3)]
