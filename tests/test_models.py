import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillnet.operators import elimination as Z
from quillnet.operators import logistic_search as S
from quillnet.operators import models as M
from quillnet.operators import networks as N
from quillnet.plans import model_plans as P


@pytest.fixture(scope="module")
def table(spark, folder):
    return P.modelled(spark, folder, -1.0, False)


def test_every_entry_of_the_role_vector_reaches_the_models(spark, folder, table, monkeypatch):
    """All 64 entries are in the table, vary, and are among the columns that models are given."""
    given = {}
    monkeypatch.setattr(P, "modelled", lambda *args: table)
    monkeypatch.setattr(M, "block_comparison", lambda rows, blocks: given.update(blocks))
    P.feature_block_compare(spark, folder)
    for block in ("base_roles", "all"):
        roles = [c for c in given[block] if c.startswith("svd")]
        assert len(roles) == 64
        spreads = table.selectExpr(*[f"stddev({c}) AS {c}" for c in roles]).first()
        assert all(x > 0 for x in spreads)
    assert not [c for c in given["base"] if c.startswith("svd")]


def test_elimination_ranks_all_role_entries(spark, folder, table, monkeypatch):
    monkeypatch.setattr(P, "modelled", lambda *args: table)
    names = {r.feature for r in P.feature_elimination(spark, folder).collect()}
    assert len([c for c in names if c.startswith("svd")]) == 64


@pytest.fixture(scope="module")
def small(spark):
    """Rows with two telling columns, three weak ones and a constant."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(240, 5))
    chance = 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1] + 0.2 * x[:, 2])))
    rows = [(*map(float, r), 0.0, int(draw.random() < p), float(1 + k % 3), float(r[0] ** 2 + r[1]), k % 3) for k, (r, p) in enumerate(zip(x, chance))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, active int, weight double, target double, fold int").cache()


def plain_logistic(x, y, w, penalty):
    """Newton's method on one set of columns."""
    z = np.column_stack([np.ones(len(x)), x])
    shrink = np.array([0.0, *[penalty] * x.shape[1]])
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (w * (p - y)) / w.sum() + shrink * beta
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(shrink), slope)
    loss = w @ (np.logaddexp(0, z @ beta) - y * (z @ beta)) / w.sum()
    return beta, loss


@pytest.mark.parametrize("ahead", [1, 3, 12])
def test_elimination_and_curve_match_single_fits(small, ahead):
    columns = list("abcdef")
    order, curve = Z.logistic_path(small, columns, penalty=0.01, ahead=ahead)
    table = small.toPandas()
    y, w, left, gone = table["active"].to_numpy(float), table["weight"].to_numpy(), list(columns), []
    while len(left) > 1:
        beta, _ = plain_logistic(table[left].to_numpy(), y, w, 0.01)
        gone.append(left.pop(int(np.abs(beta[1:]).argmin())))
    assert order == [*left, *gone[::-1]]
    assert [k for k, _ in curve] == list(range(7)) and curve[0][1] == pytest.approx(np.log(2))
    for k, loss in curve[1:]:
        kept = [c for c in columns if c in order[:k]]
        assert loss == pytest.approx(plain_logistic(table[kept].to_numpy(), y, w, 0.01)[1], abs=1e-9)


@pytest.mark.parametrize("kind, target", [(N.SQUARED, "target"), (N.LOGISTIC, "active")])
def test_slopes_of_networks_match_differences(kind, target, small):
    table = small.toPandas()
    x, y, fold = table[list("abcde")].to_numpy(), table[target].to_numpy(float), table["fold"].to_numpy()
    network = N.Network(5, (4, 3), 0.5, kind, fold=1)
    judged = lambda theta: network.judged(theta, network.sums(theta, x, y, fold == 1))
    _, slope, _ = judged(network.theta)
    for i in range(0, len(slope), 3):
        step = np.zeros_like(slope)
        step[i] = 1e-6
        assert slope[i] == pytest.approx((judged(network.theta + step)[0] - judged(network.theta - step)[0]) / 2e-6, abs=1e-5)


def test_a_network_search_fits_and_is_stored(spark, small, monkeypatch):
    make = lambda: N.Perceptron(["a", "b", "c"], N.LOGISTIC, shapes=[(3,), (4, 2)], alphas=(0.1, 1.0))
    model = N.stored(make(), small, "active")
    assert len(model.scores) == 4 and model.network.loss < 0.6
    scored = model.predict(small, "p")
    hits = scored.filter((F.col("p") >= 0.5) == (F.col("active") == 1)).count()
    assert hits > 0.75 * 240
    monkeypatch.setattr(N.Perceptron, "fit", lambda *args: pytest.fail("fitted again"))
    again = N.stored(make(), small, "active")
    assert (again.network.theta == model.network.theta).all() and again.scores == model.scores


def test_a_fit_that_rounds_end_is_reported(small):
    with pytest.warns(UserWarning, match="2 rounds"):
        N.Perceptron(["a", "b"], N.SQUARED, shapes=[(3,)], alphas=(0.1,), rounds=2).fit(small, "target")


def test_r_squared_matches_sql_on_written_predictions(spark, small, tmp_path):
    predicted = small.selectExpr("target", "target + a * 0.3 AS prediction")
    path = str(tmp_path / "predictions")
    predicted.write.parquet(path)
    sql = "SELECT 1 - sum((target - prediction) ** 2) / (count(*) * var_pop(target)) FROM read_parquet('" + path + "/*.parquet')"
    assert M.r_squared(spark.read.parquet(path), "target", "prediction").first()[0] == pytest.approx(duckdb.sql(sql).fetchall()[0][0])


def test_a_search_of_penalties_matches_single_fits(spark, small, monkeypatch):
    """Blocks, folds and penalties share their passes and reach what plain Newton steps reach; a constant column gets no weight."""
    passes, summed = [], S.summed
    monkeypatch.setattr(S, "summed", lambda *args: (passes.append(1), summed(*args))[1])
    penalties = (0.001, 0.01, 0.1)
    fitted, losses = S.searched(small, {"few": list("abc"), "all": list("abcdef")}, penalties)
    assert len(passes) < 20
    table = small.toPandas()
    y, w, fold = table["active"].to_numpy(float), table["weight"].to_numpy(), table["fold"].to_numpy()
    for block, columns in (("few", list("abc")), ("all", list("abcde"))):
        names, model = fitted[block]

        def fit(rows, penalty):
            x, v = table[columns].to_numpy(), w[rows]
            mean = v @ x[rows] / v.sum()
            deviation = np.sqrt(v @ (x[rows] - mean) ** 2 / (v.sum() - v @ v / v.sum()))
            beta, loss = plain_logistic((x[rows] - mean) / deviation, y[rows], v, penalty)
            return beta[0] + (x - mean) / deviation @ beta[1:], loss

        def area(z, rows):
            ones, zeros = rows & (y == 1), rows & (y == 0)
            above = (z[ones][:, None] > z[zeros]) + 0.5 * (z[ones][:, None] == z[zeros])
            return w[ones] @ above @ w[zeros] / (w[ones].sum() * w[zeros].sum())

        scores = [np.mean([area(fit(fold != k, p)[0], fold == k) for k in range(3)]) for p in penalties]
        assert scores[penalties.index(model.penalty)] == pytest.approx(max(scores), abs=1e-9)
        margin, loss = fit(np.full(len(y), True), model.penalty)
        assert losses[block] == pytest.approx(loss, abs=1e-9)
        chances = small.select(model.chance(names).alias("p")).toPandas()["p"].to_numpy()
        assert chances == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-7)
