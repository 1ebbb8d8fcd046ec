"""Fits of local arrays by plain loops, which the library's aggregates are held to."""

import numpy as np

from tallystone.models.logistic import LinearModel


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 100) -> np.ndarray:
    """Coefficients and, last, the unpenalised constant that minimise weighted log loss plus penalty / 2 times squared coefficients."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.r_[np.full(x.shape[1] - 1, penalty), 1e-12]
    b = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ b**2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12), gradient)
        size, now = 1.0, loss(b)
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return b


def fit(names: list[str], x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, c: float = 1.0) -> LinearModel:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    counts = np.array([(y == 0).sum(), (y == 1).sum()], float)
    balance = np.where(y == 1, len(y) / (2 * max(counts[1], 1)), len(y) / (2 * max(counts[0], 1)))
    b = newton((x - mean) / scale, y, balance * weight, 1 / c)
    return LinearModel(names, mean, scale, b[:-1], float(b[-1]))


def fit_calibrated(names: list[str], x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> LinearModel:
    """The first four fifths in time fit, the rest calibrates; too few rows or one class there leave the raw scores.

    A falling calibration would turn the ranking round; then only the level is moved, so that the mean probability is the share of ones.
    """
    n = len(y)
    k = max(int(0.8 * n), 10)
    if k >= n or len({*y[:k].tolist()}) < 2 or len({*y[k:].tolist()}) < 2:
        return fit(names, x, y, weight)
    model = fit(names, x[:k], y[:k], None if weight is None else weight[:k])
    p = np.clip(model.raw(x[k:]), 1e-9, 1 - 1e-9)
    odds, late = np.log(p / (1 - p)), y[k:]
    a, b = newton(odds[:, None], late, np.ones(len(late)), 1e-6)
    if a <= 0:
        a, low, high = 1.0, -30.0, 30.0
        for _ in range(200):
            b = (low + high) / 2
            low, high = (b, high) if (1 / (1 + np.exp(-(odds + b)))).mean() < late.mean() else (low, b)
    model.a, model.b = float(a), float(b)
    return model
