import numpy as np
import pytest

from quillnet.operators import roles as R
from quillnet.plans import role_plans


def test_ranks_are_fitted_side_by_side_as_alone(spark):
    draw = np.random.default_rng(1)
    rows = [(k, draw.uniform(0, 1, 6).tolist()) for k in range(40)]
    vectors = spark.createDataFrame(rows, "user_id long, vec array<double>").cache()
    found = {r.parts: r.loss for r in R.rank_search(vectors, 6, [1, 3, 5], rounds=20).collect()}
    for parts, loss in found.items():
        assert loss == pytest.approx(R.factor_roles(vectors, 6, parts=parts, rounds=20)[2][-1])


def test_rank_search_tries_as_many_ranks_as_the_reference(spark, folder, monkeypatch):
    """Eight draws of 1..63."""
    search = R.rank_search
    monkeypatch.setattr(R, "rank_search", lambda *args: search(*args, rounds=1, inner=1))
    ranks = [r.parts for r in role_plans.rank_search(spark, folder).collect()]
    assert len(set(ranks)) == 8 and all(1 <= r < 64 for r in ranks)


def test_log_bins_separate_the_top_rows_of_a_large_column(spark):
    rows = spark.range(2**18).selectExpr("id AS node", "double(id) AS x")
    sizes = {r.x: r["count"] for r in R.log_binned(rows, ["x"]).groupBy("x").count().collect()}
    assert sizes == {float(k): 2 ** (17 - k) for k in range(18)} | {18.0: 1}


def test_weighted_neighbour_means_scale_no_vector_per_link(spark):
    """Vectors meet their links unscaled (one list operation a link took 64 times 64 steps), and null entries count in no mean."""
    edges = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (1, 4, 5)], "e1 long, e2 long, weight long")
    vectors = spark.createDataFrame([(2, [1.0, 3.0]), (3, [2.0, 2.0]), (4, [None, None])], "user_id long, vec array<double>")
    means = R.neighbour_role_mean(edges, vectors, 2, weighted=True)
    assert means.collect()[0].neighbour_vec == [(0.25 * 3 + 0.5) / 2, (0.75 * 3 + 0.5) / 2]
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan[: plan.index("Join")]
