"""Minimizers over batches of parameter sets.

An objective takes rows of parameter sets and returns their values, so one Spark
job serves a whole gradient, line search or Hessian. A value that can't be
computed is NaN, loses every comparison and is counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from lodefit.operators.linalg import is_posdef_enough, make_posdef
from lodefit.operators.parameters import MachinePrecision, Strategy

VALID, HESSE_FAILED, MADE_POSDEF, INVERT_FAILED, NOT_POSDEF = "valid", "hesse_failed", "made_pos_def", "invert_failed", "not_pos_def"


class Objective:
    """Counts calls and values that aren't finite. gradient, if given, is that of one parameter set."""

    def __init__(self, batch: Callable[[np.ndarray], np.ndarray], up: float = 1.0, gradient: Callable | None = None):
        self.batch, self.up, self.gradient = batch, up, gradient
        self.nfcn = self.n_nonfinite = 0

    def __call__(self, rows) -> np.ndarray:
        rows = np.atleast_2d(np.asarray(rows, float))
        found = np.asarray(self.batch(rows), float).reshape(len(rows))
        self.nfcn += len(rows)
        self.n_nonfinite += int((~np.isfinite(found)).sum())
        return found

    def one(self, row) -> float:
        return float(self(np.asarray(row, float)[None])[0])

    def reset(self) -> None:
        self.nfcn = self.n_nonfinite = 0


def scalar(f: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], np.ndarray]:
    """A batch objective of a function of one parameter set."""
    return lambda rows: np.array([f(r) for r in rows], float)


@dataclass
class Minimum:
    """The result of a fit in the coordinates of the objective. inverse is the inverse Hessian."""

    x: np.ndarray
    fval: float
    edm: float
    inverse: np.ndarray | None
    up: float
    nfcn: int
    gradient: np.ndarray | None = None
    dcovar: float = 1.0
    status: str = VALID
    reached_call_limit: bool = False
    above_max_edm: bool = False
    nonfinite_fval: bool = False
    n_nonfinite: int = 0
    trace: list = field(default_factory=list)

    @property
    def covariance(self) -> np.ndarray | None:
        return None if self.inverse is None else 2 * self.up * self.inverse

    @property
    def errors(self) -> np.ndarray:
        return np.full(len(self.x), np.nan) if self.inverse is None else np.sqrt(np.clip(np.diag(self.covariance), 0, None))

    def to_dict(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items() if k != "trace"} | {"valid": self.is_valid, "covariance": None if self.covariance is None else self.covariance.tolist()}

    made_pos_def = property(lambda self: self.status == MADE_POSDEF)
    hesse_failed = property(lambda self: self.status == HESSE_FAILED)
    invert_failed = property(lambda self: self.status == INVERT_FAILED)
    is_accurate = property(lambda self: self.status == VALID and self.dcovar < 0.1)

    @property
    def is_valid(self) -> bool:
        return not (self.reached_call_limit or self.above_max_edm or self.nonfinite_fval or self.hesse_failed or self.invert_failed)


@dataclass(frozen=True)
class Step:
    """What a minimizer saw at one place: what it did to get there, and the state after it."""

    event: str
    fval: float
    edm: float
    dcovar: float
    nfcn: int
    x: np.ndarray
    gradient: np.ndarray


#: Batches hold sets that a step-by-step search wouldn't try; they count towards the budget.
SPECULATION = 4


def default_calls(n: int) -> int:
    return SPECULATION * (200 + 100 * n + 5 * n * n)


def initial_gradient(steps: np.ndarray, up: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and step guessed from the parameters' errors."""
    d = np.maximum(np.abs(steps), 1e-12)
    g2 = 2 * up / d**2
    return g2 * d, g2, 0.1 * d


def gradient(f: Objective, x: np.ndarray, fx: float, g2: np.ndarray, strategy: Strategy, precision: MachinePrecision) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Central differences with steps that follow the curvature; all open coordinates of a cycle are one batch."""
    n = len(x)
    noise = 8 * precision.eps * (abs(fx) + f.up)
    least = 8 * precision.eps2 * np.abs(x) + 1e-12

    def ideal(c: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return np.maximum(np.sqrt(noise / np.maximum(np.abs(c), 1e-300)) * 2, floor)

    step = np.minimum(ideal(g2, least) * 30, np.maximum(0.1 * np.sqrt(2 * f.up / np.maximum(np.abs(g2), 1e-300)), least))
    g, g2 = np.zeros(n), np.array(g2, float)
    open_ = np.arange(n)
    if f.gradient is not None:
        g = np.asarray(f.gradient(x), float)
    for _ in range(strategy.gradient_cycles):
        shift = np.zeros((len(open_), n))
        shift[np.arange(len(open_)), open_] = step[open_]
        values = f(np.vstack([x + shift, x - shift]))
        hi, lo = values[: len(open_)], values[len(open_) :]
        new = (hi - lo) / (2 * step[open_])
        new2 = (hi + lo - 2 * fx) / step[open_] ** 2
        moved = np.abs(new - g[open_])
        if f.gradient is None:
            g[open_] = new
        g2[open_] = np.where(np.isfinite(new2) & (new2 != 0), new2, g2[open_])
        wish = np.maximum(np.minimum(ideal(g2[open_], least[open_]) * 30, 10 * step[open_]), step[open_] / 10)
        done = (moved < strategy.gradient_tolerance * (np.abs(new) + noise / step[open_])) | (np.abs(wish - step[open_]) < strategy.step_tolerance * step[open_])
        step[open_] = wish
        open_ = open_[~done]
        if not len(open_):
            break
    return g, g2, step


def repair_curvature(f: Objective, x: np.ndarray, fx: float, g: np.ndarray, g2: np.ndarray, strategy: Strategy, precision: MachinePrecision):
    """Move along coordinates of negative curvature until none is left, 2n times at most."""
    for _ in range(2 * len(x)):
        bad = np.flatnonzero(~(g2 > 0))
        if not len(bad):
            break
        i = bad[0]
        d = np.zeros_like(x)
        d[i] = -1.0 if g[i] > 0 else 1.0
        scale = max(0.01, 0.1 * abs(x[i]))
        found = line_search(f, x, fx, d * scale, -abs(g[i]) * scale)
        if not found[1] < fx:
            g2[i] = max(abs(g2[i]), f.up)
            continue
        x, fx = x + found[0] * d * scale, found[1]
        g, g2, _ = gradient(f, x, fx, g2, strategy, precision)
    return x, fx, g, np.where(g2 > 0, g2, f.up)


def line_search(f: Objective, x: np.ndarray, fx: float, step: np.ndarray, slope: float) -> tuple[float, float]:
    """(factor, value) of the least value found along step: four factors at once, then parabolas."""
    tried = {0.0: fx}
    first = [0.25, 0.5, 1.0, 2.0]
    tried.update(zip(first, f(x + np.outer(first, step)), strict=True))
    for _ in range(4):
        points = sorted((v, s) for s, v in tried.items() if math.isfinite(v))
        if not points:
            break
        s0 = points[0][1]
        ordered = sorted(s for _, s in points)
        k = ordered.index(s0)
        if s0 == ordered[-1]:
            wish = [min(s0 * 2.5, 1000.0), min(s0 * 5, 1000.0)] if s0 else [min(ordered[-1] or 0.25, 0.25) * 0.1]
        elif k == 0:
            wish = [ordered[1] * 0.1, ordered[1] * 0.4] if s0 == 0 else [s0 / 2]
        else:
            a, b, c = ordered[k - 1], s0, ordered[k + 1]
            fa, fb, fc = tried[a], tried[b], tried[c]
            num, den = (b - a) ** 2 * (fb - fc) - (b - c) ** 2 * (fb - fa), (b - a) * (fb - fc) - (b - c) * (fb - fa)
            s = b - num / den / 2 if den else b
            if not a < s < c or abs(s - b) < 0.05 * max(abs(b), 0.05):
                break
            wish = [s]
        wish = [s for s in wish if s not in tried]
        if not wish:
            break
        tried.update(zip(wish, f(x + np.outer(wish, step)), strict=True))
    value, s = min((v, s) for s, v in tried.items() if math.isfinite(v)) if any(map(math.isfinite, tried.values())) else (fx, 0.0)
    return s, value


def hessian_gradient(f: Objective, x: np.ndarray, fx: float, g: np.ndarray, g2: np.ndarray, step: np.ndarray, strategy: Strategy, precision: MachinePrecision = MachinePrecision()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, steps, uncertainty): the gradient by central differences of ever smaller steps, until it settles.

    A coordinate whose change grows again keeps what it had; all open coordinates of a cycle are one batch.
    """
    n = len(x)
    g, step = np.array(g, float), np.array(step, float)
    least = 4 * precision.eps2 * (np.abs(x) + precision.eps2)
    best = np.sqrt(4 * precision.eps2 * (abs(fx) + f.up) / (np.abs(g2) + precision.eps2 * (1 + np.abs(g))))
    d = np.maximum(np.minimum(0.2 * np.abs(step), best), least)
    unsure, last = np.zeros(n), np.full(n, np.inf)
    open_ = np.arange(n)
    for cycle in range(strategy.hessian_gradient_cycles):
        shift = np.zeros((len(open_), n))
        shift[np.arange(len(open_)), open_] = d[open_]
        values = f(np.vstack([x + shift, x - shift]))
        hi, lo = values[: len(open_)], values[len(open_) :]
        new = (hi - lo) / (2 * d[open_])
        noise = precision.eps * (np.abs(hi) + np.abs(lo)) / d[open_]
        moved = np.abs(new - g[open_])
        unsure[open_] = np.maximum(noise, moved)
        with np.errstate(all="ignore"):
            change = moved / np.abs(new)
        worse = ~np.isfinite(new) | (new == 0) | ((change > last[open_]) & (cycle > 1))
        taken = open_[~worse]
        g[taken], step[taken], last[taken] = new[~worse], d[taken], change[~worse]
        done = worse | (change < 0.05) | (moved < noise) | (d[open_] < least[open_])
        open_ = open_[~done]
        if not len(open_):
            break
        d[open_] *= 0.2
    return g, step, unsure


def hesse(f: Objective, x, up: float | None = None, errors=None, strategy: Strategy = Strategy(), precision: MachinePrecision = MachinePrecision(), fx: float | None = None) -> tuple[np.ndarray, str, np.ndarray]:
    """(inverse Hessian, status, gradient) at x. Each diagonal cycle is one batch, and so are all pairs."""
    x, n = np.asarray(x, float), len(x)
    up = f.up if up is None else up
    fx = f.one(x) if fx is None else fx
    step = 0.02 * np.abs(np.asarray(errors, float)) if errors is not None else np.full(n, 0.01)
    least = 8 * precision.eps2 * (np.abs(x) + precision.eps2)
    step = np.maximum(step, least)
    aim = precision.eps2 * (abs(fx) + up)
    g2, g = np.zeros(n), np.zeros(n)
    open_ = np.arange(n)
    for _ in range(strategy.hessian_cycles * 3):
        shift = np.zeros((len(open_), n))
        shift[np.arange(len(open_)), open_] = step[open_]
        values = f(np.vstack([x + shift, x - shift]))
        hi, lo = values[: len(open_)], values[len(open_) :]
        sag = (hi + lo) / 2 - fx
        new2, old2 = 2 * sag / step[open_] ** 2, g2[open_]
        g[open_], g2[open_] = (hi - lo) / (2 * step[open_]), new2
        wish = np.where(np.isfinite(sag) & (sag != 0), step[open_] * np.sqrt(aim / np.maximum(np.abs(sag), 1e-300)), step[open_] * np.where(np.isfinite(sag), 10, 0.1))
        wish = np.clip(wish, np.maximum(step[open_] * 0.1, least[open_]), step[open_] * 10)
        done = (np.abs(new2 - old2) < strategy.curvature_tolerance * np.abs(new2)) | (np.abs(wish - step[open_]) < strategy.hessian_step_tolerance * step[open_] * (sag != 0))
        step[open_[~done]] = wish[~done]
        open_ = open_[~done]
        if not len(open_):
            break
    if not np.isfinite(g2).all() or (g2 == 0).any():
        d = np.where(np.isfinite(g2) & (g2 > 0), g2, 1.0)
        return np.diag(1 / d), HESSE_FAILED, g
    if strategy.level:
        g = hessian_gradient(f, x, fx, g, g2, step, strategy, precision)[0]
    pairs = [(i, j) for i in range(n) for j in range(i)]
    h = np.diag(g2)
    if pairs:
        rows = []
        for i, j in pairs:
            for a, b in ((1, 1), (-1, -1), (1, -1), (-1, 1)) if strategy.level else ((1, 1), (-1, -1)):
                r = x.copy()
                r[i] += a * step[i]
                r[j] += b * step[j]
                rows.append(r)
        v = f(np.array(rows)).reshape(len(pairs), -1)
        for (i, j), w in zip(pairs, v, strict=True):
            mixed = (w[0] + w[1] - w[2] - w[3]) / 4 if len(w) == 4 else (w[0] + w[1] - 2 * fx - g2[i] * step[i] ** 2 - g2[j] * step[j] ** 2) / 2
            h[i, j] = h[j, i] = mixed / (step[i] * step[j]) if np.isfinite(mixed) else 0.0
    fixed, changed = make_posdef(h, precision)
    try:
        inverse = np.linalg.inv(fixed)
    except np.linalg.LinAlgError:
        return np.diag(1 / np.abs(g2)), INVERT_FAILED, g
    return (inverse + inverse.T) / 2, MADE_POSDEF if changed else VALID, g


def migrad(f: Objective, x0, steps, strategy: Strategy = Strategy(), tol: float = 0.1, maxfcn: int | None = None, precision: MachinePrecision = MachinePrecision(), prior_inverse=None) -> Minimum:
    """Variable-metric minimization with the Davidon-Fletcher-Powell update.

    Ends when the estimated distance to the minimum, edm (1 + 3 dcovar), is at most
    0.002 tol up. With a higher strategy the Hessian is computed before that counts.
    """
    x, n = np.array(x0, float), len(x0)
    if maxfcn is not None and maxfcn < 0:
        raise ValueError("maxfcn must not be negative")
    budget = (maxfcn or default_calls(n)) + f.nfcn
    start, start_bad, up = f.nfcn, f.n_nonfinite, f.up
    fx = f.one(x)
    out = Minimum(x, fx, 0.0, None, up, 0)
    if n == 0:
        return replace(out, nfcn=f.nfcn - start, nonfinite_fval=not math.isfinite(fx), dcovar=0.0, inverse=np.zeros((0, 0)))
    if not math.isfinite(fx):
        return replace(out, nfcn=f.nfcn - start, nonfinite_fval=True, n_nonfinite=f.n_nonfinite - start_bad, inverse=np.diag(np.asarray(steps, float) ** 2 / (2 * up)), status=HESSE_FAILED)
    _, g2, _ = initial_gradient(np.asarray(steps, float), up)
    g, g2, _ = gradient(f, x, fx, g2, strategy, precision)
    if (~(g2 > 0)).any():
        x, fx, g, g2 = repair_curvature(f, x, fx, g, g2, strategy, precision)
    v, dcovar, status = (np.diag(1 / g2), 1.0, VALID) if prior_inverse is None else (np.array(prior_inverse, float), 0.5, VALID)
    if strategy.level == 2:
        v, status, _ = hesse(f, x, errors=np.sqrt(2 * up * np.diag(v)), strategy=strategy, precision=precision, fx=fx)
        dcovar = 0.0
    goal = max(0.002 * tol * up, precision.eps2 * up * 0.002)
    edm, stuck, known = 0.5 * float(g @ v @ g), 0, strategy.level == 2

    def note(event: str) -> None:
        out.trace.append(Step(event, fx, edm, dcovar, f.nfcn - start, x.copy(), g.copy()))

    note("seed")
    while f.nfcn < budget:
        if edm * (1 + 3 * dcovar) <= goal and edm >= 0:
            if known or strategy.level == 0 or (strategy.level == 1 and dcovar <= 0.05):
                break
            v, status, g_h = hesse(f, x, errors=np.sqrt(2 * up * np.clip(np.diag(v), 1e-300, None)), strategy=strategy, precision=precision, fx=fx)
            known, dcovar = True, 0.0
            edm = 0.5 * float(g @ v @ g)
            note("hessian")
            if edm <= goal or status == HESSE_FAILED:
                break
        step = -v @ g
        slope = float(step @ g)
        if not slope < 0:
            v, _ = make_posdef(v, precision)
            step = -v @ g
            slope = float(step @ g)
            if not slope < 0:
                v, step = np.diag(1 / np.maximum(g2, 1e-300)), -g / np.maximum(g2, 1e-300)
                slope = float(step @ g)
        s, value = line_search(f, x, fx, step, slope)
        if s == 0.0 or not value < fx - precision.eps * abs(fx):
            stuck += 1
            if stuck > 1 or known:
                break
            v, status, g = hesse(f, x, errors=np.sqrt(2 * up * np.clip(np.diag(v), 1e-300, None)), strategy=strategy, precision=precision, fx=fx)
            g, g2, _ = gradient(f, x, fx, np.maximum(np.diag(np.linalg.pinv(v)), 1e-300), strategy, precision)
            known, dcovar, edm = True, 0.0, 0.5 * float(g @ v @ g)
            note("hessian, no step helped")
            continue
        known, stuck = False, 0
        new = x + s * step
        g_new, g2, _ = gradient(f, new, value, g2, strategy, precision)
        dx, dg = new - x, g_new - g
        delta, vdg = float(dx @ dg), v @ dg
        gamma = float(dg @ vdg)
        if delta > 0 and gamma > 0:
            change = np.outer(dx, dx) / delta - np.outer(vdg, vdg) / gamma
            if delta > gamma:
                w = dx / delta - vdg / gamma
                change += gamma * np.outer(w, w)
            v = v + change
            dcovar = 0.5 * (dcovar + np.abs(change).sum() / max(np.abs(v).sum(), 1e-300))
        x, fx, g = new, value, g_new
        sound = is_posdef_enough(v, precision)
        if not sound:
            v, _ = make_posdef(v, precision)
        edm = 0.5 * float(g @ v @ g)
        note("step" if sound else "step, made positive definite")
    limit = f.nfcn >= budget and edm > goal
    return replace(out, x=x, fval=fx, edm=edm, inverse=v, gradient=g, dcovar=dcovar, status=status, nfcn=f.nfcn - start, reached_call_limit=limit, above_max_edm=bool(edm > 10 * goal), n_nonfinite=f.n_nonfinite - start_bad)


def simplex(f: Objective, x0, steps, tol: float = 0.1, maxfcn: int | None = None) -> Minimum:
    """Nelder-Mead with all candidates of a move in one batch. Errors come from the extent; there is no covariance."""
    x0, n = np.asarray(x0, float), len(x0)
    start, start_bad = f.nfcn, f.n_nonfinite
    budget = f.nfcn + (maxfcn or default_calls(n))
    points = np.vstack([x0, x0 + np.diag(np.asarray(steps, float))])
    values = f(points)
    key = lambda v: np.where(np.isnan(v), np.inf, v)
    while f.nfcn < budget:
        order = np.argsort(key(values), kind="stable")
        points, values = points[order], values[order]
        if key(values)[-1] - key(values)[0] <= 1e-4 * tol * f.up:
            break
        centre, worst = points[:-1].mean(0), points[-1]
        moves = np.array([centre + k * (centre - worst) for k in (1.0, 2.0, 4.0, -0.5, 0.5)])
        tried = key(f(moves))
        best = int(tried.argmin())
        if tried[best] < key(values)[-1]:
            points[-1], values[-1] = moves[best], tried[best]
        else:
            points[1:] = points[0] + (points[1:] - points[0]) / 2
            values[1:] = f(points[1:])
    at = int(key(values).argmin())
    edm = float(key(values).max() - key(values).min())
    extent = points.max(0) - points.min(0)
    inverse = np.diag((extent**2) * (f.up / max(edm, 1e-300)) / (2 * f.up))
    return Minimum(points[at], float(values[at]), edm, inverse, f.up, f.nfcn - start, reached_call_limit=f.nfcn >= budget, nonfinite_fval=not math.isfinite(values[at]), n_nonfinite=f.n_nonfinite - start_bad)


def minimize_with(f: Objective, x0, method: str = "bfgs", steps=None, maxiter: int = 500, tol: float = 1e-10) -> Minimum:
    """Other minimizers: bfgs, lbfgs, cg, gradientdescent, newton and neldermead."""
    name = method.lower().replace("-", "").replace("_", "")
    x, n = np.array(x0, float), len(x0)
    steps = np.full(n, 0.1) if steps is None else np.asarray(steps, float)
    if name in ("neldermead", "simplex"):
        return simplex(f, x, steps, tol=1e-6)
    if name not in ("bfgs", "lbfgs", "cg", "conjugategradient", "gradientdescent", "newton"):
        raise ValueError(f"unknown method {method!r}")
    strategy, precision = Strategy(1), MachinePrecision()
    start, fx = f.nfcn, f.one(x)
    g, g2, _ = gradient(f, x, fx, 2 * f.up / steps**2, strategy, precision)
    h, d, pairs = np.diag(1 / np.maximum(np.abs(g2), 1e-300)), None, []
    for _ in range(maxiter):
        if name == "newton":
            h, _, _ = hesse(f, x, errors=steps, strategy=strategy, precision=precision, fx=fx)
            d = -h @ g
        elif name == "bfgs":
            d = -h @ g
        elif name == "lbfgs":
            q, used = g.copy(), []
            for s, y in reversed(pairs[-8:]):
                a = (s @ q) / (s @ y)
                used.append(a)
                q -= a * y
            q = q * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])) if pairs else q / np.maximum(np.abs(g2), 1e-300)
            for (s, y), a in zip(pairs[-8:], reversed(used), strict=True):
                q += s * (a - (y @ q) / (s @ y))
            d = -q
        elif name == "gradientdescent" or d is None:
            d = -g / np.maximum(np.abs(g2), 1e-300)
        if not d @ g < 0:
            d = -g / np.maximum(np.abs(g2), 1e-300)
        s, value = line_search(f, x, fx, d, float(d @ g))
        if not value < fx - tol * (abs(fx) * 1e-6 + 1e-12):
            break
        new = x + s * d
        g_new, g2, _ = gradient(f, new, value, g2, strategy, precision)
        dx, dg = new - x, g_new - g
        if dx @ dg > 0:
            pairs.append((dx, dg))
            rho = 1 / (dx @ dg)
            left = np.eye(n) - rho * np.outer(dx, dg)
            h = left @ h @ left.T + rho * np.outer(dx, dx)
        if name in ("cg", "conjugategradient"):
            p = np.maximum(np.abs(g2), 1e-300)
            d = -g_new / p + max(0.0, float(g_new @ ((g_new - g) / p)) / float(g @ (g / p))) * d
        x, fx, g = new, value, g_new
    inverse, status, _ = hesse(f, x, errors=steps, strategy=strategy, precision=precision, fx=fx)
    return Minimum(x, fx, 0.5 * float(g @ inverse @ g), inverse, f.up, f.nfcn - start, g, 0.0, status, nonfinite_fval=not math.isfinite(fx))
