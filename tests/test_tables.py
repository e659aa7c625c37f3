import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillnet.operators import communities as K
from quillnet.operators import distributions as D
from quillnet.operators import edits as E
from quillnet.operators import features as X
from quillnet.operators import models as M
from quillnet.operators import roles as R
from quillnet.operators import similarity as S
from quillnet.session import cut_lineage
from quillnet.sources import edit_log as L
from quillnet.sources import tables as T
from quillnet.sources import warehouse as W


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_close_pairs_are_exact(spark, threshold):
    draw = random.Random(4)
    sets = {u: {draw.randrange(12) if draw.random() < 0.5 else draw.randrange(60) for _ in range(draw.randrange(1, 9))}
            for u in range(60)}
    df = spark.createDataFrame([(1, u, a) for u, items in sets.items() for a in items], "g int, u long, a long")
    expected = {
        (x, y): 1 - len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x, y in itertools.combinations(sets, 2)
    }
    expected = {pair: d for pair, d in expected.items() if d < threshold}
    found = {(r.e1, r.e2): r.distance for r in S.close_pairs(df, ["g"], "u", "a", threshold).collect()}
    assert found == pytest.approx(expected)
    near = {(r.e1, r.e2) for r in S.minhash_close_pairs(df, ["g"], "u", "a", threshold).collect()}
    assert near <= set(expected)


def test_label_window_is_strict(spark):
    rows = [("1", "2001-01-01 00:00:00", 9), ("1", "2001-04-04 00:00:00", 1), ("1", "2001-04-04 00:00:01", 2),
            ("1", "2001-07-05 23:59:59", 4), ("1", "2001-07-06 00:00:00", 8)]
    df = spark.createDataFrame(rows, "user_id string, ts string, textdata int")
    df = df.select("user_id", F.col("ts").cast("timestamp").alias("timestamp"), "textdata")
    assert E.next_period_contribution(df).first().contrib == pytest.approx(math.log(3) + math.log(5))


def test_users_without_a_community_are_minus_one(spark):
    summary = spark.createDataFrame([(1, 1.0, 2), (2, 3.0, 4)], "user_id long, edit_count double, n_edits long")
    admins = spark.createDataFrame([(2, "x")], "user_id long, username string")
    communities = spark.createDataFrame([(1, 5)], "user_id long, community_id int")
    rows = {r.community_id: tuple(r)[1:] for r in K.community_admin_summary(summary, admins, communities).collect()}
    assert rows == {5: (1, 0, 1.0, 2), -1: (1, 1, 3.0, 4)}


def test_powerlaw_exponent(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 1, 2, 4)], "x long")
    fit = D.powerlaw_fit(rows, "x").first()
    assert (fit["loc"], fit["scale"], fit["n"]) == (0, 4, 4)
    assert fit["a"] == pytest.approx(-4 / (2 * math.log(1 / 4) + math.log(2 / 4)))


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(1)
    v = draw.gamma(1.0, size=(120, 2)) @ draw.gamma(1.0, size=(2, 6))
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "user_id long, vec array<double>").cache()


def test_factor_losses_fall_and_weights_are_non_negative(vectors):
    weights, definitions, losses = R.factor_roles(vectors, 6, parts=2, rounds=25, inner=60, tolerance=0)
    assert all(b <= a * 1.001 + 1e-9 for a, b in zip(losses, losses[1:]))
    assert losses[-1] < 0.05 * losses[0]
    assert (definitions >= 0).all()
    g = np.array([r.vec for r in weights.orderBy("user_id").collect()])
    v = np.array([r.vec for r in vectors.orderBy("user_id").collect()])
    assert (g >= 0).all() and np.abs(g @ definitions - v).mean() < 0.1 * v.mean()


def test_pca_keeps_two_components_of_a_rank_two_matrix(vectors):
    scores, shares = R.role_pca(vectors, 6, keep=0.999)
    assert len(scores.first().components) == 2
    assert sum(shares[:2]) == pytest.approx(1.0)
    means = scores.select(F.avg(F.col("components")[0])).first()[0]
    assert means == pytest.approx(0.0, abs=1e-9)


def test_role_sense_recovers_weights(spark, vectors):
    rows = vectors.withColumn("m", 2 * F.col("vec")[0] + 3 * F.col("vec")[3])
    found = R.role_sense(rows, ["m"], 6, rounds=20000, tolerance=0).collect()
    v = np.array([r.vec for r in vectors.collect()])
    fitted = v @ np.array([r.weight for r in sorted(found, key=lambda r: r.role)])
    assert np.abs(fitted - (2 * v[:, 0] + 3 * v[:, 3])).max() < 0.2


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 3))
    y = 1.0 + x @ np.array([2.0, -1.0, 0.0]) + draw.normal(scale=0.1, size=400)
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, c double, target double, active int")
    return M.with_split(M.balanced_weights(df)).cache()


def test_moments_give_the_same_ridge_as_the_rows(table):
    moments = M.Moments.of(table, ["a", "b", "c"])
    rows = np.array(table.filter("not is_test").select("a", "b", "c", "target").collect())
    x = np.column_stack([np.ones(len(rows)), rows[:, :3]])
    expected = np.linalg.solve(x.T @ x + np.diag([0, 0.1, 0.1, 0.1]), x.T @ rows[:, 3])
    assert moments.ridge([0, 1, 2], 0.1) == pytest.approx(expected)
    assert [r for _, r, _ in M.ridge_elimination(moments)] == [1, 2, 3]
    curve = dict(M.ridge_curve(moments, ["a", "b", "c"]))
    assert curve[0] < 0.1 < curve[1] < curve[2] and curve[3] > 0.98


def test_classifier_ranks_and_scores(table):
    ranks = dict(M.logistic_elimination(table, ["a", "b", "c"]))
    assert ranks == {"a": 1, "b": 2, "c": 3}
    losses = dict(M.logistic_curve(table, ["a", "b", "c"], [0, 1, 2]))
    assert losses[0] == pytest.approx(math.log(2)) and losses[0] > losses[1] > losses[2]


def test_two_part_model(table):
    regressor = M.PerceptronRegressor(["a", "b", "c"], shapes=[(2,), (6,)], epochs=60, rate=0.05)
    losses = regressor.fit(table)
    assert [shape for shape, _ in regressor.scores] == [(2,), (6,)]
    assert losses[-1] < 0.2 * losses[0]
    rows = M.with_vector(table, ["a", "b", "c"])
    scored = M.probabilities(M.activity_model(rows, layers=[(4,)], steps=30), rows)
    predicted = M.two_part_prediction(regressor.predict(scored))
    assert predicted.filter(F.abs(F.col("prediction") - F.col("p") * F.col("amount")) > 1e-9).count() == 0
    metrics = M.classification_metrics(scored, "active", "p").first()
    assert metrics.accuracy > 0.9 and metrics.log_loss < 0.4
    assert M.r_squared(regressor.predict(table), "target", "amount").first().r2 > 0.8


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, flat double")
    assert [tuple(r) for r in M.scale_features(df, ["x", "flat"], -1, 1, standardise=False).collect()] == [(-1.0, -1.0), (1.0, -1.0)]
    assert [tuple(r) for r in M.scale_features(df, ["x", "flat"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_raw_records_round_trip(spark, folder, tmp_path):
    edits = W.edits(spark, folder, category=True)
    path = str(tmp_path / "log")
    L.write_edit_records(edits, path, "bzip2")
    records = L.read_edit_records(spark, path)
    assert records.count() == edits.count()
    parsed = L.parse_revision(records)
    assert parsed.agg(F.sum("textdata")).first() == edits.agg(F.sum("textdata")).first()
    assert parsed.filter("image is not null").count() == 0
    assert L.simple_edit_rows(records).filter(F.col("user_id").startswith("ip:")).count() == 0


def test_short_records_and_trailing_newlines(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text("REVISION 1 2 T 2001-01-21T02:12:21Z Bob 7\nCATEGORY a b c\nIMAGE\n\nREVISION 3 4 U 2002-05-01T00:00:00Z Al ip:1\n")
    rows = L.read_edit_records(spark, str(path)).orderBy("revision").collect()
    assert [(r.revision, r.category, r.image, r.textdata) for r in rows] == [
        ("1 2 T 2001-01-21T02:12:21Z Bob 7", "a b c", None, None), ("3 4 U 2002-05-01T00:00:00Z Al ip:1", None, None, None)
    ]
    parsed = L.parse_revision(L.read_edit_records(spark, str(path))).orderBy("article_id").collect()
    assert [(r.article_id, r.user_id, r.year, r.quarter) for r in parsed] == [(1, "7", 2001, 1), (3, "ip:1", 2002, 2)]


def test_partitioned_and_compact_files(spark, folder, tmp_path):
    edits = W.edits(spark, folder)
    L.write_partitioned(edits, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("year = 1996 and quarter = 2").count() == edits.filter("year = 1996 and quarter = 2").count()
    L.compact_edits(edits, str(tmp_path / "c"), files=3)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3


def test_edge_lists_names_and_assignments(spark, edge_frame, tmp_path):
    path = str(tmp_path / "edges")
    assert T.write_edge_list(edge_frame([(1, 2)]), path, one_file=True)
    assert not T.write_edge_list(edge_frame([(1, 2), (2, 3)]), path, overwrite=False)
    assert T.read_edge_list(spark, path, "e1 long, e2 long, weight long").count() == 1
    names = tmp_path / "names.txt"
    names.write_text("* User:Ann\nheading\n* User talk of User: Bo \n* User:\n")
    assert sorted(r.username for r in T.read_admin_names(spark, str(names)).collect()) == ["Ann", "Bo"]
    roles = tmp_path / "roles.txt"
    roles.write_text("----\n  1\t3\n  2\t4\n")
    assert sorted(map(tuple, T.read_assignments(spark, str(roles), "user_id INT, role_id INT").collect())) == [(1, 3), (2, 4)]


def test_beginnings_hold_what_first_quarters_and_labels_need(spark, folder):
    human = cut_lineage(E.human_edits(W.edits(spark, folder)))
    begun = cut_lineage(E.beginnings(human))
    assert begun.count() < human.count() / 4
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    assert rows(E.first_quarter_edits(begun).select("user_id", "article_id", "rev_id", "t")) == rows(E.first_quarter_edits(human).select("user_id", "article_id", "rev_id", "t"))
    assert dict(rows(E.next_period_contribution(begun))) == pytest.approx(dict(rows(E.next_period_contribution(human))))


def test_names_meet_the_orders_before_the_lines(spark, folder):
    plan = W.edits(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    depth = {word: next(line.index("Relation") for line in plan.splitlines() if "Relation" in line and word in line) for word in ("l_orderkey", "c_custkey")}
    assert depth["c_custkey"] > depth["l_orderkey"]


def test_features_with_beginnings_at_hand_write_no_log(spark, folder, monkeypatch):
    """Only the beginnings are written by the caller, and no name is carried past the filter of bots."""
    human = E.human_edits(W.edits(spark, folder)).drop("username")
    begun = cut_lineage(E.beginnings(human))
    monkeypatch.setattr(X, "cut_lineage", lambda df: pytest.fail("written again"))
    assert "username" not in begun.columns
    assert X.user_feature_vectors(human, begun).count() == begun.select("user_id").distinct().count()
