"""Logistic regressions on many subsets of the columns, fitted side by side by Newton steps."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillnet.operators.passes import matrix, pack_rows, summed
from quillnet.session import drop_state


class Logistic:
    """A weighted logistic regression on some columns: intercept first, an L2 penalty on the rest."""

    def __init__(self, chosen: Sequence[int], beta: np.ndarray):
        self.chosen, self.beta = list(chosen), beta
        self.done, self.loss, self.last = False, np.inf, None

    def take(self, sums: np.ndarray, weight: float, penalty: float, tolerance: float) -> None:
        """A Newton step from the sums at ``beta``; a step that raised the loss is halved instead."""
        k = len(self.beta)
        shrink = np.full(k, penalty)
        shrink[0] = 0.0
        loss = sums[0] / weight + 0.5 * float(shrink @ self.beta**2)
        if self.last is not None and loss > self.loss + 1e-12 * abs(self.loss):
            self.beta = (self.beta + self.last) / 2
            return
        slope = sums[1 : 1 + k] / weight + shrink * self.beta
        hessian = sums[1 + k :].reshape(k, k) / weight + np.diag(shrink)
        self.hessian, self.loss, self.last = hessian, loss, self.beta
        if np.abs(slope).max() <= tolerance:
            self.done = True
        else:
            self.beta = self.beta - np.linalg.lstsq(hessian, slope, rcond=None)[0]

    @property
    def weakest(self) -> int:
        """The column of smallest coefficient, the first of them if there are several."""
        return self.chosen[int(np.abs(self.beta[1:]).argmin())]

    def without_weakest(self) -> Logistic:
        """The next smaller regression as the quadratic at this one predicts it, with the Hessian it predicts."""
        at = 1 + self.chosen.index(self.weakest)
        inverse = np.linalg.pinv(self.hessian)
        rest = [i for i in range(len(self.beta)) if i != at]
        smaller = Logistic([c for c in self.chosen if c != self.weakest], (self.beta - inverse[:, at] * self.beta[at] / inverse[at, at])[rest])
        smaller.hessian = self.hessian[np.ix_(rest, rest)]
        return smaller


def logistic_sums(models: Sequence[Logistic], width: int):
    """Per batch and model: the loss, its slope and its Hessian, one after another."""
    sent = [(np.array(m.chosen, int), m.beta) for m in models]

    def add(frame: pd.DataFrame) -> np.ndarray:
        x, y, w = matrix(frame, width), frame["y"].to_numpy(float), frame["w"].to_numpy(float)
        parts = []
        for chosen, beta in sent:
            z = np.column_stack([np.ones(len(x)), x[:, chosen]])
            margin = z @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
            loss = w @ (np.logaddexp(0.0, margin) - y * margin)
            parts += [[loss], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]
        return np.concatenate(parts)

    return add


def fit_logistics(table: DataFrame, models: Sequence[Logistic], width: int, weight: float, penalty: float, tolerance: float, steps: int) -> None:
    """Newton steps of all models together until every slope is within ``tolerance``: one pass a step."""
    for _ in range(steps):
        left = [m for m in models if not m.done]
        if not left:
            return
        sizes = [1 + len(m.beta) + len(m.beta) ** 2 for m in left]
        sums = summed(table, sum(sizes), logistic_sums(left, width))
        for m, part in zip(left, np.split(sums, np.cumsum(sizes)[:-1])):
            m.take(part, weight, penalty, tolerance)
    if any(not m.done for m in models):
        warnings.warn(f"logistic regressions unfinished after {steps} steps", stacklevel=2)


def logistic_path(
    rows: DataFrame, columns: Sequence[str], penalty: float = 0.01, ahead: int = 12, tolerance: float = 1e-9, steps: int = 200
) -> tuple[list[str], list[tuple[int, float]]]:
    """Columns by recursive elimination, the longest kept first, and the weighted log-loss with the first 0, 1, 2, ... of them.

    The smallest coefficient leaves in each round. The ``ahead`` next rounds are predicted from the Hessian, fitted side by side
    from there, and taken over as far as the fits confirm the predictions; the first always is. The score with no column is that of one half for everyone.
    """
    width = len(columns)
    table = pack_rows(rows, columns, y="CAST(active AS DOUBLE)", w="CAST(weight AS DOUBLE)")
    weight = float(summed(table, 1, lambda frame: np.array([frame["w"].sum()]))[0])
    options = (width, weight, penalty, tolerance, steps)
    path = [Logistic(range(width), np.zeros(width + 1))]
    fit_logistics(table, path, *options)
    while len(path[-1].chosen) > 1:
        chain, model = [], path[-1]
        while len(chain) < ahead and len(model.chosen) > 1:
            model = model.without_weakest()
            chain.append(model)
        fit_logistics(table, chain, *options)
        for model in chain:
            if set(path[-1].chosen) - set(model.chosen) != {path[-1].weakest}:
                break
            path.append(model)
    order = [*path[-1].chosen, *[(set(a.chosen) - set(b.chosen)).pop() for a, b in zip(path[-2::-1], path[:0:-1])]]
    by_size = {len(m.chosen): m for m in path}
    sizes = range(1, width + 1)
    heads = [by_size[k] for k in sizes]

    def losses(frame: pd.DataFrame) -> np.ndarray:
        x, y, w = matrix(frame, width), frame["y"].to_numpy(float), frame["w"].to_numpy(float)
        margins = [m.beta[0] + x[:, m.chosen] @ m.beta[1:] for m in heads]
        return np.array([w @ (np.logaddexp(0.0, z) - y * z) for z in margins])

    scores = summed(table, width, losses) / weight
    drop_state(table)
    return [columns[i] for i in order], [(0, float(np.log(2.0))), *zip(sizes, scores.tolist())]
