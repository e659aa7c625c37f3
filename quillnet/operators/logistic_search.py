"""Logistic regressions whose penalty is chosen by cross-validation, all settings, folds and column sets fitted side by side."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.operators.elimination import Logistic
from quillnet.operators.passes import matrix, pack_rows, summed
from quillnet.session import cut_lineage, drop_state

EVERY = -1


class Standard:
    """The rows outside a fold: their weight, and mean and unbiased deviation of each column."""

    def __init__(self, fold: int, weight: float, mean: np.ndarray, deviation: np.ndarray):
        self.fold, self.weight, self.mean, self.deviation = fold, weight, mean, deviation
        # A constant column gets no coefficient.
        self.varies = deviation > 1e-12 * np.abs(mean)

    def of(self, x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        scale = np.where(self.varies, self.deviation, np.inf)[chosen]
        return np.column_stack([np.ones(len(x)), (x[:, chosen] - self.mean[chosen]) / scale])


class Setting(Logistic):
    """A regression on some columns of standardised rows outside a fold."""

    def __init__(self, chosen: Sequence[int], penalty: float, standard: Standard):
        super().__init__(chosen, np.zeros(len(chosen) + 1))
        self.penalty, self.standard = penalty, standard

    def plain(self) -> tuple[float, np.ndarray]:
        """Intercept and coefficients for columns as they are."""
        s = self.standard
        scale = np.where(s.varies, s.deviation, np.inf)[self.chosen]
        slope = self.beta[1:] / scale
        return float(self.beta[0] - slope @ s.mean[self.chosen]), slope

    def margin(self, x: np.ndarray) -> np.ndarray:
        intercept, slope = self.plain()
        return intercept + x[:, self.chosen] @ slope

    def chance(self, columns: Sequence[str]) -> Column:
        """The chance of a 1 from the named columns."""
        intercept, slope = self.plain()
        terms = [F.col(columns[i]) * float(b) for i, b in zip(self.chosen, slope)]
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms, F.lit(intercept))))


def standards(table: DataFrame, width: int, folds: int) -> dict[int, Standard]:
    """The standard of all rows and of the rows outside each fold, from two passes."""

    def split(frame: pd.DataFrame):
        x, w, fold = matrix(frame, width), frame["w"].to_numpy(float), frame["fold"].to_numpy()
        return [(x[fold == k], w[fold == k]) for k in range(folds)]

    def first(frame: pd.DataFrame) -> np.ndarray:
        return np.concatenate([[w.sum(), (w * w).sum(), *(w @ x)] for x, w in split(frame)])

    sums = summed(table, folds * (width + 2), first).reshape(folds, width + 2)
    center = sums[:, 2:].sum(axis=0) / sums[:, 0].sum()

    def second(frame: pd.DataFrame) -> np.ndarray:
        return np.concatenate([[*(w @ (x - center)), *(w @ (x - center) ** 2)] for x, w in split(frame)])

    turns = summed(table, folds * 2 * width, second).reshape(folds, 2, width)
    found = {}
    for fold in [EVERY, *range(folds)]:
        kept = [k for k in range(folds) if k != fold]
        weight, squares = sums[kept, 0].sum(), sums[kept, 1].sum()
        off, spread = turns[kept].sum(axis=0) / weight
        variance = np.maximum(spread - off**2, 0.0) * weight / (weight - squares / weight)
        found[fold] = Standard(fold, float(weight), center + off, np.sqrt(variance))
    return found


def fit_settings(table: DataFrame, settings: Sequence[Setting], width: int, tolerance: float, steps: int) -> None:
    """Newton steps of all settings together until every slope is within ``tolerance``: one pass a step."""
    for _ in range(steps):
        left = [m for m in settings if not m.done]
        if not left:
            return
        sent = [(np.array(m.chosen, int), m.standard, m.beta) for m in left]

        def add(frame: pd.DataFrame, sent=sent) -> np.ndarray:
            x, y, w, fold = matrix(frame, width), frame["y"].to_numpy(float), frame["w"].to_numpy(float), frame["fold"].to_numpy()
            parts, made = [], {}
            for chosen, standard, beta in sent:
                key = (standard.fold, chosen.tobytes())
                if key not in made:  # settings of one fold and column set differ in their penalty only
                    rows = fold != standard.fold
                    made = {key: (standard.of(x[rows], chosen), y[rows], w[rows])}
                z, target, weight = made[key]
                margin = z @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
                loss = weight @ (np.logaddexp(0.0, margin) - target * margin)
                parts += [[loss], z.T @ (weight * (p - target)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()]
            return np.concatenate(parts)

        sizes = [1 + len(m.beta) + len(m.beta) ** 2 for m in left]
        for m, part in zip(left, np.split(summed(table, sum(sizes), add), np.cumsum(sizes)[:-1])):
            m.take(part, m.standard.weight, m.penalty, tolerance)
    if any(not m.done for m in settings):
        warnings.warn(f"logistic regressions unfinished after {steps} steps", stacklevel=2)


def _areas(table: DataFrame, tried: Sequence[Sequence[Setting]], width: int, folds: int) -> list[float]:
    """Mean weighted area under the ROC curve of each group of settings, each of them on its own fold: one pass makes all scores."""
    names = [f"s{i}" for i in range(len(tried))]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, fold = matrix(frame, width), frame["fold"].to_numpy()
            scores = {name: np.zeros(len(frame)) for name in names}
            for name, group in zip(names, tried):
                for m in group:
                    held = fold == m.standard.fold
                    scores[name][held] = m.margin(x[held])
            yield pd.DataFrame({"y": frame["y"], "w": frame["w"], "fold": frame["fold"], **scores})

    scored = cut_lineage(table.mapInPandas(score, ", ".join(["y double, w double, fold int", *[f"{n} double" for n in names]])))
    areas = []
    for name in names:
        judge = BinaryClassificationEvaluator(labelCol="y", weightCol="w", rawPredictionCol=name)
        areas.append(float(np.mean([judge.evaluate(scored.filter(F.col("fold") == k)) for k in range(folds)])))
    drop_state(scored)
    return areas


def searched(
    rows: DataFrame, blocks: dict[str, Sequence[str]], penalties: Sequence[float], folds: int = 3, tolerance: float = 1e-9, steps: int = 200
) -> tuple[dict[str, tuple[list[str], Setting]], dict[str, float]]:
    """Per block of columns (all names, fitted regression) and its weighted log-loss on all rows.

    ``rows`` has the columns, active (0/1), weight and fold. Columns are standardised, the intercept is not penalised, and the penalty is that of the
    largest mean area under the ROC curve over the folds, the first of equals.
    """
    names = list(dict.fromkeys(c for columns in blocks.values() for c in columns))
    width = len(names)
    table = pack_rows(rows, names, y="CAST(active AS DOUBLE)", w="CAST(weight AS DOUBLE)", fold="CAST(fold AS INT)")
    known = standards(table, width, folds)
    chosen = {block: [names.index(c) for c in columns] for block, columns in blocks.items()}
    single = len(penalties) == 1
    # Settings of one block and fold follow one another, so that their rows are standardised once.
    made = {
        (block, fold, penalty): Setting(chosen[block], penalty, known[fold])
        for block in blocks for fold in ([EVERY] if single else known) for penalty in penalties
    }
    fit_settings(table, list(made.values()), width, tolerance, steps)
    best = {block: made[block, EVERY, penalties[0]] for block in blocks}
    if not single:
        groups = [[made[block, fold, p] for fold in range(folds)] for block in blocks for p in penalties]
        areas = np.array(_areas(table, groups, width, folds)).reshape(len(blocks), len(penalties))
        best = {block: made[block, EVERY, penalties[int(np.argmax(area))]] for block, area in zip(blocks, areas)}

    def losses(frame: pd.DataFrame) -> np.ndarray:
        x, y, w = matrix(frame, width), frame["y"].to_numpy(float), frame["w"].to_numpy(float)
        return np.array([w @ np.minimum(np.logaddexp(0.0, np.where(y == 1, -z, z)), -np.log(1e-15)) for z in (m.margin(x) for m in best.values())])

    scores = summed(table, len(best), losses) / known[EVERY].weight
    drop_state(table)
    return {block: (names, m) for block, m in best.items()}, dict(zip(best, scores.tolist()))
