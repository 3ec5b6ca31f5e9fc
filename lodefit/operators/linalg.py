"""Small dense algebra of covariance matrices, on the driver."""

from __future__ import annotations

import numpy as np

from lodefit.operators.parameters import MachinePrecision


def eigenvalues(matrix) -> np.ndarray:
    """Sorted eigenvalues of a symmetric matrix."""
    return np.linalg.eigvalsh(np.asarray(matrix, float))


def correlation_of(matrix) -> np.ndarray:
    m = np.asarray(matrix, float)
    s = np.sqrt(np.clip(np.diag(m), 0, None))
    with np.errstate(all="ignore"):
        c = m / np.outer(s, s)
    np.fill_diagonal(c, 1.0)
    return np.nan_to_num(c)


def global_cc(matrix) -> np.ndarray:
    """Global correlation coefficients: sqrt(1 - 1 / (V_ii inverse(V)_ii)), 0 where that isn't real or the matrix is singular."""
    m = np.asarray(matrix, float)
    try:
        d = np.diag(m) * np.diag(np.linalg.inv(m))
    except np.linalg.LinAlgError:
        return np.zeros(len(m))
    return np.sqrt(1 - 1 / np.where(d > 1, d, 1.0))


def is_posdef_enough(matrix, precision: MachinePrecision = MachinePrecision()) -> bool:
    m = np.asarray(matrix, float)
    return bool(np.isfinite(m).all() and (np.diag(m) > 0).all() and eigenvalues(correlation_of(m))[0] > least_eigenvalue(precision))


def least_eigenvalue(precision: MachinePrecision) -> float:
    """Of the scaled matrix, as a part of its largest one: what is below counts as none."""
    return max(1e-6, precision.eps2)  # a fixed value


def make_posdef(matrix, precision: MachinePrecision = MachinePrecision()) -> tuple[np.ndarray, bool]:
    """A positive definite neighbour of a symmetric matrix and whether it differs.

    The diagonal is raised to be positive; if the scaled matrix still has an
    eigenvalue that is too small, its diagonal grows by the factor that lifts it.
    """
    m = np.array(matrix, float)
    m = np.where(np.isfinite(m), m, 0.0)
    changed = not np.isfinite(np.asarray(matrix, float)).all()
    low = np.diag(m).min()
    if low <= 0:
        m[np.diag_indices_from(m)] += 0.5 + precision.eps2 - low
        changed = True
    s = np.sqrt(np.diag(m))
    values = eigenvalues(m / np.outer(s, s))
    most = max(1.0, abs(values[-1]))
    if values[0] <= least_eigenvalue(precision) * most:
        m[np.diag_indices_from(m)] *= 1 + 0.001 * most - values[0]
        changed = True
    return m, changed


def squeeze_symmetric(matrix, k: int) -> np.ndarray:
    """Without row and column k."""
    return np.delete(np.delete(np.asarray(matrix, float), k, 0), k, 1)


def squeeze_error(covariance, k: int) -> np.ndarray:
    """The covariance with parameter k held fixed."""
    return np.linalg.inv(squeeze_symmetric(np.linalg.inv(np.asarray(covariance, float)), k))
