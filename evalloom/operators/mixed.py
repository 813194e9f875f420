"""Bernoulli mixed model with a random intercept for each unit, fitted by mean-field Gaussian variational Bayes.

Spark reduces the grid to success counts for each (unit, design row); the fit itself is small and runs on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def design_counts(df: DataFrame, unit: str, condition: str, task: str, success: str) -> DataFrame:
    return df.groupBy(unit, condition, task).agg(F.sum(F.col(success).cast("int")).alias("k"), F.count("*").alias("n"))


def fit(unit: np.ndarray, x: np.ndarray, k: np.ndarray, n: np.ndarray, prior_sd: float = 2.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Means and deviations of the fixed effects, and the intercepts' deviation.

    Maximises the bound with the quadratic (Jaakkola-Jordan) bound of the logistic likelihood: closed-form updates of
    fixed effects, intercepts and the bound's free parameters; the intercepts' variance by its expected second moment.
    """
    units, at = np.unique(unit, return_inverse=True)
    m, s = np.zeros(x.shape[1]), np.eye(x.shape[1]) * prior_sd**2
    um, uv, var = np.zeros(len(units)), np.ones(len(units)), 1.0
    for _ in range(rounds):
        eta = x @ m + um[at]
        xi = np.sqrt(np.maximum(1e-10, eta**2 + np.einsum("ij,jk,ik->i", x, s, x) + uv[at]))
        lam = n * np.tanh(xi / 2) / (4 * xi)
        s = np.linalg.inv(np.eye(x.shape[1]) / prior_sd**2 + 2 * (x * lam[:, None]).T @ x)
        new = s @ (x.T @ (k - n / 2 - 2 * lam * um[at]))
        uv = 1 / (1 / var + 2 * np.bincount(at, lam, len(units)))
        um = uv * np.bincount(at, k - n / 2 - 2 * lam * (x @ new), len(units))
        var = float(np.mean(um**2 + uv))
        done = np.abs(new - m).max() < 1e-9
        m = new
        if done:
            break
    return m, np.sqrt(np.diag(s)), float(np.sqrt(var))


def interaction(df: DataFrame, unit: str, condition: str, task: str, success: str, conditions: tuple, tasks: tuple) -> dict[str, float]:
    """The (second condition, second task) interaction with its normal 95 % interval."""
    got = design_counts(df.where(F.col(condition).isin(*conditions) & F.col(task).isin(*tasks)), unit, condition, task, success).orderBy(unit, condition, task).toPandas()
    c, t = (got[condition] == conditions[1]).to_numpy(float), (got[task] == tasks[1]).to_numpy(float)
    x = np.stack([np.ones(len(got)), c, t, c * t], 1)
    m, sd, re = fit(got[unit].to_numpy(), x, got["k"].to_numpy(float), got["n"].to_numpy(float))
    return {"coefficient": float(m[3]), "sd": float(sd[3]), "low": float(m[3] - 1.959963984540054 * sd[3]), "high": float(m[3] + 1.959963984540054 * sd[3]), "intercept_sd": re}
