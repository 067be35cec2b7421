"""Calibrated probabilities from one raw number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, case: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve of one variable by Newton's steps with a weak ridge."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (case * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (case * (p - y)) + 1e-2 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def pool_adjacent(x: np.ndarray, y: np.ndarray, case: np.ndarray) -> tuple[list[float], list[float]]:
    """Isotonic regression: the ends of each pooled block and its share of ones, with one average case added.

    Cases of equal x are one block from the start, whatever their order.
    """
    values, at = np.unique(x, return_inverse=True)
    ones, cases = np.bincount(at, y * case), np.bincount(at, case)
    blocks: list[list[float]] = []  # ones, cases, first and last x
    for v, t, c in zip(values.tolist(), ones.tolist(), cases.tolist()):
        blocks.append([t, c, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    mean = float((y * case).sum() / case.sum())
    return [x for b in blocks for x in b[2:]], [(b[0] + mean) / (b[1] + 1) for b in blocks for _ in range(2)]


@dataclass(frozen=True)
class Curve:
    """Nearly the isotonic fit; a small logistic part keeps different numbers apart."""

    knots: tuple[float, ...]
    shares: tuple[float, ...]
    slope: float
    middle: float
    logistic_part: float = 0.05

    def __call__(self, x: np.ndarray) -> np.ndarray:
        smooth = 1 / (1 + np.exp(-np.clip(x * self.slope + self.middle, -30, 30)))
        return np.clip((1 - self.logistic_part) * np.interp(x, self.knots, self.shares) + self.logistic_part * smooth, 0, 1)


def fit_curve(x: np.ndarray, y: np.ndarray, of_label: dict[int, float] | None = None) -> Curve:
    """Without cases: 0.5 for all; with cases of one kind: their share, smoothed, for all.

    ``of_label``: for how many cases one case of that label stands, where labels were
    sampled at different rates.
    """
    if not len(y):
        return Curve((0.0,), (0.5,), 0.0, 0.0)
    if y.min() == y.max():
        share = float((y.sum() + 1) / (len(y) + 2))
        return Curve((0.0,), (share,), 0.0, float(np.log(share / (1 - share))))
    case = np.where(y > 0, (of_label or {}).get(1, 1.0), (of_label or {}).get(0, 1.0))
    case = case / case.mean()
    slope, middle = fit_logistic(x, y, case)
    knots, shares = pool_adjacent(x, y, case)
    return Curve(tuple(knots), tuple(np.maximum.accumulate(shares).tolist()), slope, middle)
