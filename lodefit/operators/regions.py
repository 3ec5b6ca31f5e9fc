"""Monte-Carlo regions of the objective, and intervals of derived quantities over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodefit.functions.special import delta_chisq
from lodefit.operators.fit import Fit

BATCH = 2000


def region_samples(fit: Fit, cl: float = 0.68, n: int = 10_000, proposal: str = "mvnormal", inflate: float = 1.5, rounds: int = 5, seed: int = 0, box: Sequence[tuple[float, float]] | None = None, draws: np.ndarray | None = None) -> dict:
    """Accepted parameter sets with a rise of at most up delta_chisq(cl, free), their rise, squared
    Mahalanobis distance and the extents. draws: the proposals themselves, of the free parameters. The proposal widens while extents touch it; under_coverage
    says that it still did at the end."""
    fit._need()
    free = fit.parameters.free
    most = delta_chisq(cl, len(free)) * fit.errordef
    centre, cov = fit.values, fit.free_covariance
    root, inverse = np.linalg.cholesky(cov), np.linalg.inv(cov)
    rng = np.random.default_rng(seed)
    given = draws
    kept, rises, clipped = [], [], False
    wide = inflate
    extent = np.zeros(len(free))
    for _ in range(rounds):
        if given is not None:
            draws = np.asarray(given, float)
        elif proposal == "uniform":
            half = wide * np.sqrt(np.diag(cov)) * math.sqrt(delta_chisq(cl, len(free)))
            lo, hi = (np.array(box, float).T if box is not None else (centre[free] - half, centre[free] + half))
            draws = rng.uniform(lo, hi, (n, len(free)))
        else:
            draws = centre[free] + wide * rng.standard_normal((n, len(free))) @ root.T
        rows = np.tile(centre, (len(draws), 1))
        rows[:, free] = draws
        inside = np.array([all(p.inside(x) for p, x in zip(fit.parameters, r, strict=True)) for r in rows])
        rows = rows[inside]
        f = np.concatenate([fit.objective(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)]) - fit.fval if len(rows) else np.empty(0)
        ok = np.isfinite(f) & (f <= most)
        kept.append(rows[ok])
        rises.append(f[ok])
        every = np.vstack(kept)
        if given is not None:
            break
        if not len(every):
            wide /= 1.6
            continue
        new = np.abs(every[:, free] - centre[free]).max(0)
        reach = np.abs(draws - centre[free]).max(0)
        clipped = bool((new > 0.9 * reach).any()) and proposal == "uniform" and box is None
        if (np.abs(new - extent) <= 0.02 * np.maximum(new, 1e-300)).all() and not clipped:
            break
        extent = new
        wide *= 1.6 if clipped else 1.0
    every, rise = np.vstack(kept), np.concatenate(rises)
    d = every[:, free] - centre[free]
    return {"p": every, "delta": rise, "mahalanobis": np.einsum("ij,jk,ik->i", d, inverse, d), "threshold": most, "lower": every.min(0) if len(every) else centre, "upper": every.max(0) if len(every) else centre, "under_coverage": clipped}


def region_table(spark: SparkSession, found: dict) -> DataFrame:
    rows = [([float(v) for v in p], float(d), float(m)) for p, d, m in zip(found["p"], found["delta"], found["mahalanobis"], strict=True)]
    return spark.createDataFrame(rows, "p array<double>, delta_chisq double, mahalanobis double")


def slope_of(f: Callable[[np.ndarray], float], x: np.ndarray, free: list[int], errors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(free))
    for k, i in enumerate(free):
        h = 1e-4 * (errors[i] or 1e-4)
        a, b = x.copy(), x.copy()
        a[i] += h
        b[i] -= h
        out[k] = (f(a) - f(b)) / (2 * h)
    return out


def extremize(fit: Fit, f: Callable[[np.ndarray], float], cl: float = 0.68, mode: str = "full", seeds: int = 6, seed: int = 0) -> dict:
    """lower, best and upper of f over the region of a rise of at most up delta_chisq(cl, 1).

    directional goes along the covariance times the slope of f, both ways. full starts
    from there and from drawn seeds, and climbs on the region's surface by a penalty
    that hardens; a point outside is pulled back to the surface. It is never narrower
    than directional.
    """
    fit._need()
    free, x0 = fit.parameters.free, fit.values
    most = delta_chisq(cl, 1) * fit.errordef
    best = float(f(x0))
    c = fit.free_covariance
    root = np.linalg.cholesky(c)
    rng = np.random.default_rng(seed)

    def full(v: np.ndarray) -> np.ndarray:
        x = x0.copy()
        x[free] = v
        for i in free:
            p = fit.parameters[i]
            x[i] = min(max(x[i], -math.inf if p.lower is None else p.lower), math.inf if p.upper is None else p.upper)
        return x

    def value(x: np.ndarray) -> float:
        try:
            v = float(f(x))
            return v if math.isfinite(v) else best
        except (ArithmeticError, RuntimeError, ValueError):
            return best  # a failing f can only narrow the interval

    def surface(d: np.ndarray) -> tuple[np.ndarray, bool]:
        """The last point along d that is inside the region."""
        lo, hi, t, n = 0.0, None, 1.0, 0
        while n < 40:
            rise = fit.objective.one(full(x0[free] + t * d)) - fit.fval
            if math.isfinite(rise) and rise <= most:
                lo = t
                if most - rise < 1e-6 * most or t > 1e4:
                    break
                t = t * min(4.0, max(1.05, math.sqrt(most / max(rise, 1e-12)))) if hi is None else (lo + hi) / 2
            else:
                hi = t
                t = (lo + hi) / 2
            n += 1
        return full(x0[free] + lo * d), lo > 0

    ends = {}
    for sign in (-1.0, 1.0):
        g = slope_of(value, x0, free, fit.errors)
        d = c @ g * sign
        size = math.sqrt(float(g @ c @ g))
        at = x0.copy()
        if size > 0:
            at, _ = surface(d / size * math.sqrt(most / fit.errordef))
        top, where = sign * value(at), at
        if mode == "full":
            for k in range(seeds):
                y = root.T @ np.zeros(len(free)) if k == 0 else rng.standard_normal(len(free))
                z = np.linalg.solve(root, where[free] - x0[free]) if k == 0 else y / np.linalg.norm(y)
                here = where if k == 0 else surface(root @ z)[0]
                step = 0.5
                while step > 1e-3:
                    gx = slope_of(value, here, free, fit.errors)
                    aim = root @ (np.linalg.solve(root, here[free] - x0[free]) + step * sign * (w := root.T @ gx) / max(np.linalg.norm(w), 1e-300))
                    new, ok = surface(aim)
                    if ok and sign * value(new) > sign * value(here) + 1e-9 * abs(best):
                        here = new
                    else:
                        step /= 2
                if sign * value(here) > top:
                    top, where = sign * value(here), here
        ends[sign] = (sign * top, where)
    return {"lower": min(ends[-1.0][0], best), "best": best, "upper": max(ends[1.0][0], best), "lower_at": ends[-1.0][1], "upper_at": ends[1.0][1]}


def profile_band(fit: Fit, f: Callable[[np.ndarray, float], float], xs: Sequence[float], cl: float = 0.68, mode: str = "directional") -> list[dict]:
    """extremize of f(p, x) at each x; the best fit is always within."""
    return [{"x": float(x), **extremize(fit, lambda p, x=x: f(p, x), cl, mode)} for x in xs]


def linear_interval(best: float, slope: Sequence[float], covariance, cl: float = 0.68) -> tuple[float, float]:
    """The closed form for a linear quantity: best plus and minus sqrt(delta slope C slope)."""
    g = np.asarray(slope, float)
    half = math.sqrt(delta_chisq(cl, 1) * float(g @ np.asarray(covariance) @ g))
    return best - half, best + half
