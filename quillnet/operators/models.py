"""Models of who stays and how much they contribute."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import networks as N
from quillnet.operators.elimination import Logistic, fit_logistics, logistic_path
from quillnet.operators.logistic_search import searched
from quillnet.operators.passes import pack_rows, summed
from quillnet.session import drop_state

SPLIT_SEED = 115
TEST_SHARE = 0.2


def feature_union(users: DataFrame, articles: DataFrame, optional: Sequence[DataFrame]) -> DataFrame:
    """User features with article features, and further tables where they exist; gaps become 0."""
    rows = users.join(articles, "user_id")
    for table in optional:
        rows = rows.join(table, "user_id", "left")
    return rows.na.fill(0)


def assemble_features(joined: DataFrame) -> DataFrame:
    """The joined features with the log of the summed log words."""
    return joined.withColumn("lslt", F.log(F.col("sumlog_textdata") + 1) + 1)


def scale_features(
    df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0, standardise: bool = True
) -> DataFrame:
    """Min-max scaling to [low, high], then centring and unit population deviation.

    All column statistics come from one aggregate pass. A constant column becomes ``low``, or 0.
    """
    statistics = [
        F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c)
        for c in columns
    ]
    rows = df.withColumn("_s", df.agg(F.struct(*statistics)).scalar())

    def scaled(c: str) -> Column:
        s = F.col(f"_s.{c}")
        if standardise:
            # Min-max scaling is undone by the standardisation that follows it.
            return F.when(s["high"] > s["low"], (F.col(c) - s["mean"]) / s["sd"]).otherwise(F.lit(0.0))
        width = s["high"] - s["low"]
        return F.when(width > 0, (F.col(c) - s["low"]) / width * (high - low) + low).otherwise(F.lit(low))

    wanted = set(columns)
    return rows.select(*[scaled(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def balanced_weights(df: DataFrame, label: str = "active") -> DataFrame:
    """Each class weighs the share of the other class."""
    share = df.agg(F.avg(label)).scalar()
    return df.withColumn("_share", share).withColumn(
        "weight", F.when(F.col(label) == 1, 1 - F.col("_share")).otherwise(F.col("_share"))
    ).drop("_share")


def with_split(df: DataFrame, key: str = "user_id", folds: int = 3, seed: int = SPLIT_SEED) -> DataFrame:
    """Test flag and fold number by hash of the key: the same split whatever the partitioning."""
    return df.withColumn("is_test", C.uniform_hash(key, seed=seed) < TEST_SHARE).withColumn(
        "fold", F.floor(C.uniform_hash(key, seed=seed + 1) * folds).cast("int")
    )


def with_vector(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def _searched(estimator, grid, evaluator, rows: DataFrame, folds: int):
    """Cross-validated best model; a single setting is fitted without the search."""
    settings = grid.build()
    if len(settings) == 1:
        return estimator.fit(rows, settings[0])
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=settings, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=2
    )
    return search.fit(rows).bestModel


def logistic_model(rows: DataFrame, columns: Sequence[str], penalties: Sequence[float] = (0.001, 0.01, 0.1), folds: int = 3, name: str = "p") -> DataFrame:
    """The chance of being active by L2 logistic regression on balanced classes, the penalty chosen by cross-validation."""
    fitted, _ = searched(rows, {name: columns}, penalties, folds)
    names, model = fitted[name]
    return rows.withColumn(name, model.chance(names))


def ridge_model(rows: DataFrame, penalties: Sequence[float] = (0.01, 0.1, 1.0), folds: int = 3):
    """Ridge regression of ``target``, the penalty chosen by cross-validation."""
    estimator = LinearRegression(labelCol="target", elasticNetParam=0.0, solver="normal")
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(penalties))
    return _searched(estimator, grid, RegressionEvaluator(labelCol="target", metricName="r2"), rows, folds)


def activity_model(rows: DataFrame, layers: Sequence[Sequence[int]] | None = None, steps: int = 100, folds: int = 3, seed: int = 112358):
    """Multilayer perceptron for activity; hidden layers chosen by cross-validation."""
    width = rows.schema["features"].metadata["ml_attr"]["num_attrs"]
    estimator = MultilayerPerceptronClassifier(labelCol="active", seed=seed, maxIter=steps)
    grid = ParamGridBuilder().addGrid(estimator.layers, [[width, *hidden, 2] for hidden in layers or N.SHAPES])
    return _searched(estimator, grid, MulticlassClassificationEvaluator(labelCol="active", metricName="logLoss"), rows, folds)


def probabilities(model, rows: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1])


def log_loss(label: Column, p: Column, weight: Column | None = None) -> Column:
    """Weighted mean negative log-likelihood of a 0/1 label."""
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    loss = -F.when(label == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    return F.avg(loss) if weight is None else F.sum(loss * weight) / F.sum(weight)


def classification_metrics(df: DataFrame, label: str, p: str) -> DataFrame:
    """Log-loss, accuracy, and precision, recall and F averaged with the class sizes as weights."""
    y, guess = F.col(label), (F.col(p) >= 0.5).cast("int")
    counts = df.agg(
        log_loss(y, F.col(p)).alias("log_loss"),
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (guess == 1)).alias("tp"),
        F.count_if((y == 0) & (guess == 1)).alias("fp"),
        F.count_if((y == 0) & (guess == 0)).alias("tn"),
        F.count_if((y == 1) & (guess == 0)).alias("fn"),
    )
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def f_score(right: Column, wrong: Column, missed: Column) -> Column:
        return share(2 * right, 2 * right + wrong + missed)

    ones, zeros = tp + fn, tn + fp
    return counts.select(
        "log_loss",
        ((tp + tn) / n).alias("accuracy"),
        ((share(tp, tp + fp) * ones + share(tn, tn + fn) * zeros) / n).alias("weighted_precision"),
        ((share(tp, ones) * ones + share(tn, zeros) * zeros) / n).alias("weighted_recall"),
        ((f_score(tp, fp, fn) * ones + f_score(tn, fn, fp) * zeros) / n).alias("weighted_f"),
    )


def block_comparison(
    rows: DataFrame, blocks: dict[str, Sequence[str]], penalties: Sequence[float] = (0.001, 0.01, 0.1)
) -> DataFrame:
    """Weighted log-loss of the logistic model on several groups of columns, each with its own cross-validated penalty; fitted in shared passes."""
    _, losses = searched(rows, blocks, penalties)
    results = [(name, len(columns), losses[name]) for name, columns in blocks.items()]
    return rows.sparkSession.createDataFrame(results, "block string, n_features int, log_loss double")


# Ridge regressions on any subset of the columns follow from the products of the columns, so
# elimination and score curves need one pass over the data whatever the number of fits.


class Moments:
    """Sums of products of (1, columns, target) over training and test rows."""

    def __init__(self, columns: Sequence[str], train: np.ndarray, test: np.ndarray):
        self.columns, self.train, self.test = list(columns), train, test

    @classmethod
    def of(cls, rows: DataFrame, columns: Sequence[str], target: str = "target") -> Moments:
        names = [*columns, target]
        size = len(names) + 1

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((2, size, size))
            for batch in batches:
                x = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(dtype=float)])
                test = batch["is_test"].to_numpy(dtype=bool)
                for side, mask in enumerate((~test, test)):
                    sums[side] += x[mask].T @ x[mask]
            yield pd.DataFrame({"i": np.arange(sums.size), "x": sums.ravel()})

        sums = np.zeros(2 * size * size)
        cells = rows.select(*names, "is_test").mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
        for row in cells.collect():
            sums[row["i"]] = row["x"]
        train, test = sums.reshape(2, size, size)
        return cls(columns, train, test)

    def ridge(self, chosen: Sequence[int], alpha: float) -> np.ndarray:
        """Intercept and coefficients of the chosen columns; the intercept is not penalised."""
        at = [0, *[i + 1 for i in chosen]]
        gram = self.train[np.ix_(at, at)] + np.diag([0.0, *[alpha] * len(chosen)])
        return np.linalg.lstsq(gram, self.train[at, -1], rcond=None)[0]

    def r2(self, chosen: Sequence[int], beta: np.ndarray, test: bool = True) -> float:
        m = self.test if test else self.train
        at = [0, *[i + 1 for i in chosen]]
        rest = m[-1, -1] - 2 * beta @ m[at, -1] + beta @ m[np.ix_(at, at)] @ beta
        total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
        return float(1.0 - rest / total)


def ridge_elimination(moments: Moments, alpha: float = 0.1) -> list[tuple[str, int, float]]:
    """(column, rank, coefficient in the full fit): the smallest coefficient leaves in each round."""
    left = list(range(len(moments.columns)))
    full = moments.ridge(left, alpha)[1:]
    ranks: dict[int, int] = {}
    while left:
        sizes = np.abs(moments.ridge(left, alpha)[1:])
        out = left[int(np.argmin(sizes))]
        ranks[out] = len(left)
        left.remove(out)
    return [(c, ranks[i], float(full[i])) for i, c in enumerate(moments.columns)]


def ridge_curve(moments: Moments, order: Sequence[str], alpha: float = 0.1) -> list[tuple[int, float]]:
    """Test R squared with the first 0, 1, 2, ... columns of ``order``."""
    positions = [moments.columns.index(c) for c in order]
    return [
        (k, moments.r2(positions[:k], moments.ridge(positions[:k], alpha))) for k in range(len(positions) + 1)
    ]


def logistic_elimination(rows: DataFrame, columns: Sequence[str], penalty: float = 0.01) -> list[tuple[str, int]]:
    """(column, rank): the smallest coefficient leaves in each round; rank 1 stays longest."""
    order, _ = logistic_path(rows, columns, penalty)
    return [(c, order.index(c) + 1) for c in columns]


def logistic_curve(rows: DataFrame, order: Sequence[str], sizes: Sequence[int], penalty: float = 0.01) -> list[tuple[int, float]]:
    """Weighted log-loss with the first columns of ``order``, fitted side by side; size 0 predicts one half for everyone."""
    table = pack_rows(rows, order, y="CAST(active AS DOUBLE)", w="CAST(weight AS DOUBLE)")
    weight = float(summed(table, 1, lambda frame: np.array([frame["w"].sum()]))[0])
    models = {k: Logistic(range(k), np.zeros(k + 1)) for k in sizes if k}
    fit_logistics(table, list(models.values()), len(order), weight, penalty, 1e-9, 200)
    drop_state(table)
    # The loss of a fit holds its penalty.
    return [(k, float(models[k].loss - 0.5 * penalty * (models[k].last[1:] ** 2).sum()) if k else float(np.log(2.0))) for k in sizes]


class PerceptronRegressor:
    """:class:`networks.Perceptron` with squared loss and one penalty. ``epochs`` bounds its passes; ``rate`` has no effect, as L-BFGS finds its steps."""

    def __init__(self, columns: Sequence[str], shapes: Sequence[Sequence[int]] = N.SHAPES, alpha: float = 0.1, rate: float = 0.02, epochs: int = 1000, seed: int = 112358):
        self.model = N.Perceptron(columns, N.SQUARED, shapes, [alpha], rounds=epochs, seed=seed)

    @property
    def scores(self) -> list[tuple[tuple[int, ...], float]]:
        return [(shape, score) for shape, _, score in self.model.scores]

    def fit(self, rows: DataFrame, target: str = "target", folds: int = 3) -> list[float]:
        """Returns the loss of the chosen network after each move."""
        return self.model.fit(rows, target, folds).network.losses

    def predict(self, rows: DataFrame, name: str = "amount") -> DataFrame:
        return self.model.predict(rows, name)


def two_part_prediction(rows: DataFrame, p: str = "p", amount: str = "amount") -> DataFrame:
    """Expected contribution: chance of being active times the amount when active."""
    return rows.withColumn("prediction", F.col(p) * F.col(amount))


def r_squared(rows: DataFrame, target: str, prediction: str) -> DataFrame:
    """R squared in one pass from sums of the target and the residual."""
    y, e = F.col(target), F.col(target) - F.col(prediction)
    return rows.agg((1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"))
