"""Looking at user functions before they are used in parallel."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np

from lodefit.operators.costs import Cost


class NotDeterministic(RuntimeError):
    """An objective gave different values for the same parameters."""


def argument_names(f: Callable) -> list[str]:
    """The names of a function's positional arguments."""
    return [p.name for p in inspect.signature(f).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]


def is_deterministic(cost: Cost, theta, tolerance: float = 1e-9, partitions: int = 7) -> bool:
    """Whether an objective is the same, but for rounding, however its rows are dealt."""
    a = cost.evaluate(np.atleast_2d(theta))
    rows = cost.rows
    try:
        cost.rows = rows.repartition(partitions)
        b = cost.evaluate(np.atleast_2d(theta))
    finally:
        cost.rows = rows
    return bool(np.allclose(a, b, rtol=tolerance, atol=0, equal_nan=True))


def check_deterministic(cost: Cost, theta, tolerance: float = 1e-9) -> None:
    if not is_deterministic(cost, theta, tolerance):
        raise NotDeterministic("the objective depends on how rows are dealt")


def gradient_agrees(objective: Callable, gradient: Callable, x, tolerance: float = 1e-3) -> bool:
    """Whether a user's gradient agrees with central differences at x."""
    x = np.asarray(x, float)
    h = 1e-5 * np.maximum(np.abs(x), 1e-2)
    want = np.array([(objective(x + d) - objective(x - d)) / (2 * s) for d, s in zip(np.diag(h), h, strict=True)])
    got = np.asarray(gradient(x), float)
    return bool(np.allclose(got, want, rtol=tolerance, atol=tolerance * (1 + np.abs(want).max())))
