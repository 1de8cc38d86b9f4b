"""Small ARIMA(p, 1, q) helper used inside the grouped forecast job (one series at a time).

Conditional least squares.  For a given moving-average weight the model is linear in the rest,
so the weight is searched on a refined grid and the other coefficients follow by regression.
Every candidate is scored on the same residuals, which makes their AIC comparable.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Candidate (autoregressive terms, moving-average terms, drift).
CANDIDATES = ((1, 1, True), (1, 0, True), (2, 1, True), (1, 0, False), (1, 1, False))
SKIPPED = 2
Z95 = 1.959963984540054


class Fit(NamedTuple):
    order: tuple[int, int, int]
    constant: float
    ar: np.ndarray
    ma: float
    sigma2: float
    aic: float
    residual: float


def _design(z: np.ndarray, p: int, drift: bool) -> tuple[np.ndarray, np.ndarray]:
    lags = [z[SKIPPED - k : len(z) - k] for k in range(1, p + 1)]
    ones = [np.ones(len(z) - SKIPPED)] if drift else []
    return z[SKIPPED:], np.column_stack(ones + lags)


def _regress(y: np.ndarray, x: np.ndarray, thetas: np.ndarray):
    """Least squares for every moving-average weight at once: (squared error, beta, residuals).

    Dividing out ``1 + theta L`` turns each weight into an ordinary regression.
    """
    both = np.repeat(np.column_stack([y, x])[:, None, :], len(thetas), axis=1)
    for t in range(1, len(both)):
        both[t] -= thetas[:, None] * both[t - 1]
    target, inputs = both[:, :, 0], both[:, :, 1:]
    gram = np.einsum("tgi,tgj->gij", inputs, inputs)
    beta = np.einsum("gij,tgj,tg->gi", np.linalg.pinv(gram, hermitian=True), inputs, target)
    error = target - np.einsum("tgi,gi->tg", inputs, beta)
    return (error**2).sum(axis=0), beta, error


def fit_one(z: np.ndarray, p: int, q: int, drift: bool) -> Fit | None:
    """Fit one candidate to the differenced series; None if it cannot be fitted or is unstable."""
    y, x = _design(z, p, drift)
    n, k = len(y), x.shape[1] + q + 1
    if n < k:
        return None
    theta = 0.0
    if q:
        grid = np.linspace(-0.95, 0.95, 39)
        for width in (0.05, 0.005, 0.0005):
            theta = float(grid[np.argmin(_regress(y, x, grid)[0])])
            grid = np.clip(theta + width * np.linspace(-1, 1, 21), -0.99, 0.99)
    sse, betas, errors = _regress(y, x, np.array([theta]))
    beta = betas[0]
    ar = beta[1:] if drift else beta
    if np.any(np.abs(np.roots(np.r_[1.0, -ar])) >= 0.999):
        return None
    sigma2 = max(float(sse[0]) / n, 1e-12)
    aic = n * (np.log(2 * np.pi * sigma2) + 1.0) + 2 * k
    return Fit((p, 1, q), float(beta[0]) if drift else 0.0, ar, theta, sigma2, aic, float(errors[-1, 0]))


def best_fit(series: np.ndarray) -> Fit | None:
    z = np.diff(series)
    if len(z) <= SKIPPED:
        return None
    fits = [f for f in (fit_one(z, *c) for c in CANDIDATES) if f is not None]
    return min(fits, key=lambda f: f.aic) if fits else None


def forecast(series: np.ndarray, fit: Fit, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard error of the next ``steps`` levels."""
    p = len(fit.ar)
    z = list(np.diff(series)[-p:])
    impulse = np.zeros(steps + p)
    for h in range(steps):
        step = fit.constant + float(np.dot(fit.ar, z[::-1][:p])) + (fit.ma * fit.residual if h == 0 else 0.0)
        z.append(step)
        shock = 1.0 if h == 0 else fit.ma if h == 1 else 0.0
        impulse[h + p] = shock + float(np.dot(fit.ar, impulse[h : h + p][::-1]))
    weights = np.cumsum(impulse[p:])
    mean = series[-1] + np.cumsum(z[p:])
    return mean, np.sqrt(fit.sigma2 * np.cumsum(weights**2))


def backtest(series: np.ndarray, holdout: int, min_train: int = 6) -> tuple[float, float] | None:
    """(MAE, RMSE) of the last ``holdout`` values predicted from the rest."""
    if len(series) < holdout + min_train:
        return None
    train, test = series[:-holdout], series[-holdout:]
    fit = best_fit(train)
    if fit is None:
        return None
    error = forecast(train, fit, holdout)[0] - test
    return round(float(np.mean(np.abs(error))), 3), round(float(np.sqrt(np.mean(error**2))), 3)
