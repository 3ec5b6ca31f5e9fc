"""The fit front end: parameters, minimizers, errors, profiles and contours of one objective."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodefit.functions.special import delta_chisq, p_value
from lodefit.operators import linalg, lockstep, minimize
from lodefit.operators.costs import LeastSquares
from lodefit.operators.minimize import Minimum, Objective
from lodefit.operators.parameters import MachinePrecision, Parameter, Parameters, Strategy


@dataclass(frozen=True)
class MinosError:
    """Distances from the minimum to where the profile rises by up; an invalid side has the parabolic error."""

    name: str
    value: float
    lower: float
    upper: float
    lower_valid: bool = True
    upper_valid: bool = True
    lower_limit: bool = False
    upper_limit: bool = False
    lower_new_min: bool = False
    upper_new_min: bool = False
    nfcn: int = 0
    lower_state: tuple[float, ...] | None = None  # all parameters at the crossing
    upper_state: tuple[float, ...] | None = None

    @property
    def is_valid(self) -> bool:
        return self.lower_valid and self.upper_valid

    @property
    def new_min(self) -> bool:
        """Whether the profile went below the minimum on the way: minimize again from Fit.deeper."""
        return self.lower_new_min or self.upper_new_min

    def to_dict(self) -> dict:
        return dict(self.__dict__)


def minos_error_from_dict(d: dict) -> MinosError:
    found = {k: d[k] for k in MinosError.__dataclass_fields__ if k in d}
    return MinosError(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


@dataclass(frozen=True)
class Contour:
    """A contour of two parameters with their profile errors; invalid if fewer than four points were found."""

    a: str
    b: str
    points: tuple[tuple[float, float], ...]
    minos_a: MinosError
    minos_b: MinosError
    nfcn: int = 0

    @property
    def is_valid(self) -> bool:
        return len(self.points) >= 4

    def to_dict(self) -> dict:
        return {"a": self.a, "b": self.b, "points": [list(p) for p in self.points], "minos_a": self.minos_a.to_dict(), "minos_b": self.minos_b.to_dict(), "nfcn": self.nfcn, "valid": self.is_valid}


def contour_from_dict(d: dict) -> Contour:
    return Contour(d["a"], d["b"], tuple(map(tuple, d["points"])), minos_error_from_dict(d["minos_a"]), minos_error_from_dict(d["minos_b"]), d["nfcn"])


def model_fit(points: DataFrame, model: Callable, start, names: Sequence[str] | None = None, mask=None, **options) -> Fit:
    """A least-squares fit of points(x, y, err); start may be a fit, whose parameters it goes on from. goodness needs no row count."""
    pars = start.parameters if isinstance(start, Fit) else start
    known = list(pars.names) if isinstance(pars, Parameters) else list(pars) if isinstance(pars, dict) else list(names or [f"x{i}" for i in range(len(pars))])
    cost = LeastSquares(points, model, known, mask)
    fit = Fit(cost, pars, None if isinstance(pars, (dict, Parameters)) else known, **options)
    fit.ndata = cost.rows.count()
    return fit


class Fit:
    """An objective with parameters. Minimizers replace the result; parameters change by their setters.

    objective is a Cost, which is summed in Spark (or, with local=True, over its
    collected rows), or a function of one parameter set.
    """

    def __init__(self, objective, start: Sequence[float] | dict[str, float] | Parameters, names: Sequence[str] | None = None, errordef: float | None = None, errors=None, limits=None, fixed=(), strategy: int = 1, tol: float = 0.1, local: bool = False, gradient: Callable | None = None, batched: bool = False, check_gradient: bool = True):
        is_cost = hasattr(objective, "evaluate")
        names = names or (objective.names if is_cost else None)
        if isinstance(start, Parameters):
            pars = start
        else:
            if isinstance(start, dict):
                names, start = list(start), list(start.values())
            names = list(names or [f"x{i}" for i in range(len(start))])
            steps = errors if errors is not None else [0.1 * abs(v) or 0.1 for v in start]
            pars = Parameters(tuple(Parameter(n, float(v), float(e)) for n, v, e in zip(names, start, steps, strict=True)))
        for k, (lo, hi) in (limits or {}).items():
            pars = pars.set(k, lower=lo, upper=hi)
        for k in fixed:
            pars = pars.set(k, fixed=True)
        batch = (objective.local() if local else objective.evaluate) if is_cost else objective if batched else minimize.scalar(objective)
        self.cost = objective
        self.errordef = errordef if errordef is not None else getattr(objective, "errordef", 1.0)
        self.objective = Objective(batch, self.errordef)
        self.user_gradient, self.check_gradient = gradient, check_gradient
        self.start, self.parameters = pars, pars
        self.strategy, self.tol, self.precision = Strategy(strategy), tol, MachinePrecision()
        self.minimum: Minimum | None = None
        self._internal: Minimum | None = None
        self.merrors: dict[str, MinosError] = {}
        self.ndata: int | None = None
        self.deeper: np.ndarray | None = None  # parameters below the minimum that a profile came upon
        self._together = is_cost and not local and gradient is None and lockstep.has_derivatives(objective)

    # ---- setters and views
    def _changed(self, parameters: Parameters) -> Fit:
        self.parameters, self.minimum, self._internal = parameters, None, None
        self.merrors, self.deeper = {}, None
        return self

    def fix(self, key) -> Fit:
        return self._changed(self.parameters.set(key, fixed=True))

    def release(self, key) -> Fit:
        return self._changed(self.parameters.set(key, fixed=False))

    def set_value(self, key, value: float) -> Fit:
        return self._changed(self.parameters.set(key, value=float(value)))

    def set_error(self, key, error: float) -> Fit:
        return self._changed(self.parameters.set(key, error=float(error)))

    def set_limits(self, key, lower: float | None, upper: float | None) -> Fit:
        return self._changed(self.parameters.set(key, lower=lower, upper=upper))

    def set_lower_limit(self, key, lower: float) -> Fit:
        return self._changed(self.parameters.set(key, lower=lower))

    def set_upper_limit(self, key, upper: float) -> Fit:
        return self._changed(self.parameters.set(key, upper=upper))

    def remove_limits(self, key) -> Fit:
        return self._changed(self.parameters.set(key, lower=None, upper=None))

    def set_precision(self, eps: float) -> Fit:
        self.precision = MachinePrecision(eps)
        return self

    def reset(self) -> Fit:
        self.objective.reset()
        return self._changed(self.start)

    def _set_all(self, **columns) -> None:
        pars = self.parameters
        for name, column in columns.items():
            column = list(column)
            if len(column) != self.npar:
                raise ValueError(f"{len(column)} values for {self.npar} parameters")
            for k, v in enumerate(column):
                pars = pars.set(k, **{name: v})
        self._changed(pars)

    names = property(lambda self: self.parameters.names)
    # assigning to one of these sets it for all parameters, and the result goes
    values = property(lambda self: self.parameters.values(), lambda self, v: self._set_all(value=map(float, v)))
    errors = property(lambda self: np.array([p.error for p in self.parameters]), lambda self, v: self._set_all(error=map(float, v)))
    limits = property(lambda self: [(p.lower, p.upper) for p in self.parameters], lambda self, v: self._set_all(lower=[lo for lo, _ in v], upper=[hi for _, hi in v]))
    fixed = property(lambda self: [p.fixed for p in self.parameters], lambda self, v: self._set_all(fixed=map(bool, v)))
    npar = property(lambda self: self.parameters.n_pars)
    nfit = property(lambda self: self.parameters.n_free)
    nfcn = property(lambda self: self.objective.nfcn)
    fval = property(lambda self: math.nan if self.minimum is None else self.minimum.fval)
    edm = property(lambda self: math.nan if self.minimum is None else self.minimum.edm)
    valid = property(lambda self: self.minimum is not None and self.minimum.is_valid)
    accurate = property(lambda self: self.minimum is not None and self.minimum.is_accurate)

    def args(self) -> tuple[float, ...]:
        return tuple(self.values)

    @property
    def free_covariance(self) -> np.ndarray | None:
        return None if self.minimum is None else self.minimum.covariance

    @property
    def covariance(self) -> np.ndarray | None:
        """External covariance of all parameters; rows of fixed ones are zero."""
        if self.free_covariance is None:
            return None
        out = np.zeros((self.npar, self.npar))
        out[np.ix_(self.parameters.free, self.parameters.free)] = self.free_covariance
        return out

    def matrix(self, correlation: bool = False) -> np.ndarray | None:
        c = self.free_covariance
        return c if c is None or not correlation else linalg.correlation_of(c)

    def eigenvalues(self) -> np.ndarray:
        return linalg.eigenvalues(self.free_covariance)

    def global_cc(self) -> np.ndarray:
        return linalg.global_cc(self.free_covariance)

    def goodness(self, ndata: int | None = None) -> tuple[float, int, float]:
        """chi-square, degrees of freedom and p-value; for an errordef of 1. ndata: the rows, if the fit doesn't know them."""
        ndata = self.ndata if ndata is None else ndata
        if ndata is None:
            raise ValueError("the number of rows isn't known")
        ndf = ndata - self.nfit
        return self.fval, ndf, p_value(self.fval, ndf)

    # ---- minimizers
    def _inner(self, parameters: Parameters, objective: Objective | None = None) -> Objective:
        base = objective or self.objective

        def batch(rows: np.ndarray) -> np.ndarray:
            return base(parameters.external(rows))

        inner = Objective(batch, self.errordef)
        if self.user_gradient is not None:
            inner.gradient = lambda v: np.asarray(self.user_gradient(parameters.external(v)[0]))[parameters.free] * parameters.slopes(v)
        return inner

    def _accept(self, m: Minimum, parameters: Parameters) -> Minimum:
        external = parameters.external(m.x)[0]
        slopes = parameters.slopes(m.x)
        inverse = None if m.inverse is None else m.inverse * np.outer(slopes, slopes)
        free_errors = [parameters[i].external_error(v, e) for i, v, e in zip(parameters.free, m.x, m.errors, strict=True)]
        for k, x in enumerate(external):
            changes = {"value": float(x)}
            if k in parameters.free and math.isfinite(e := free_errors[parameters.free.index(k)]) and e > 0:
                changes["error"] = float(e)
            parameters = parameters.set(k, **changes)
        self.parameters, self._internal = parameters, m
        self.minimum = minimize.replace(m, x=external, inverse=inverse)
        return self.minimum

    def migrad(self, maxfcn: int | None = None, iterate: int = 5, warm: bool = False, prior_covariance=None, hops: bool = True) -> Fit:
        """Passes until the fit is valid, iterate at most; the deepest one is kept. warm: begin with the last
        inverse Hessian; prior_covariance: with that of a covariance of the free parameters that is known before.
        hops: between passes a simplex looks for a better place to begin; if no pass is valid and a last simplex,
        which needs no gradient, closes in on a place that is no worse, that is the result, with its extent for errors."""
        best = None
        pars = self.parameters
        if self.user_gradient is not None and self.check_gradient:
            self._check_gradient()
        prior = self._internal.inverse if warm and self._internal is not None else None
        if prior_covariance is not None:
            slopes = pars.slopes(pars.initial_internal(self.precision))
            prior = np.asarray(prior_covariance, float) / np.outer(slopes, slopes) / (2 * self.errordef)
        for _ in range(max(1, iterate)):
            inner = self._inner(pars)
            m = minimize.migrad(inner, pars.initial_internal(self.precision), pars.initial_internal_errors(self.precision), self.strategy, self.tol, maxfcn, self.precision, prior)
            prior = None
            if best is None or m.fval < best[0].fval or not math.isfinite(best[0].fval):
                repeated = best is not None and best[0].fval - m.fval < 1e-12 * (1 + abs(m.fval))
                best = (m, pars)
                if repeated:
                    break
            elif best[0].is_valid or m.fval >= best[0].fval:
                break
            if m.is_valid or m.nonfinite_fval:
                break
            for k, x in enumerate(pars.external(m.x)[0]):
                pars = pars.set(k, value=float(x))
            if hops and not m.reached_call_limit:
                hop = minimize.simplex(self._inner(pars), pars.initial_internal(self.precision), pars.initial_internal_errors(self.precision), self.tol, maxfcn)
                if hop.fval < m.fval:
                    for k, x in enumerate(pars.external(hop.x)[0]):
                        pars = pars.set(k, value=float(x))
        if hops and not best[0].is_valid and not best[0].nonfinite_fval and not best[0].reached_call_limit:
            pars = best[1]
            for k, x in enumerate(pars.external(best[0].x)[0]):
                pars = pars.set(k, value=float(x))
            last = minimize.simplex(self._inner(pars), pars.initial_internal(self.precision), pars.initial_internal_errors(self.precision), self.tol, maxfcn)
            if last.is_valid and last.fval <= best[0].fval:
                best = (last, pars)
        self._accept(*best)
        return self

    def _check_gradient(self) -> None:
        """Warn if the user's gradient isn't that of the objective at the start, by central differences of a hundredth of the errors."""
        x, free = self.values, self.parameters.free
        h = np.array([0.01 * self.parameters[i].error for i in free])
        rows = np.repeat(x[None], 2 * len(free), 0)
        rows[np.arange(len(free)), free] += h
        rows[len(free) + np.arange(len(free)), free] -= h
        f = self.objective(np.vstack([rows, x[None]]))
        up, down, here = f[: len(free)], f[len(free) : -1], f[-1]
        want, bend = (up - down) / (2 * h), np.abs(up + down - 2 * here) / h
        got = np.asarray(self.user_gradient(x), float)[free]
        off = np.abs(got - want) > 0.05 * (np.abs(want) + bend)
        if off.any():
            said = ", ".join(f"{self.names[i]}: {g:.4g}, differences {w:.4g}" for i, g, w, o in zip(free, got, want, off, strict=True) if o)
            warnings.warn(f"the gradient given disagrees with the objective at the start ({said})", stacklevel=3)

    def trace(self, level: int = 1) -> pd.DataFrame:
        """The steps of the last minimization as a table. Level 0 has none; 1: step, fval, edm, dcovar, nfcn;
        2: what each step was, too; 3: the inner coordinates and the gradient there, too."""
        if level not in (0, 1, 2, 3):
            raise ValueError("a level is 0, 1, 2 or 3")
        names = ["step", "fval", "edm", "dcovar", "nfcn", *(["event"] if level > 1 else []), *(["x", "gradient"] if level > 2 else [])]
        steps = self._internal.trace if level and self._internal is not None else []
        return pd.DataFrame([[k if n == "step" else getattr(s, n) for n in names] for k, s in enumerate(steps)], columns=names)

    def simplex(self, maxfcn: int | None = None) -> Fit:
        p = self.parameters
        self._accept(minimize.simplex(self._inner(p), p.initial_internal(), p.initial_internal_errors(), self.tol, maxfcn), p)
        return self

    def optim(self, method: str = "lbfgs") -> Fit:
        p = self.parameters
        self._accept(minimize.minimize_with(self._inner(p), p.initial_internal(), method, p.initial_internal_errors()), p)
        return self

    def scan_minimize(self, points: int = 15) -> Fit:
        """The best finite point of a grid over the free parameters' ranges; no covariance is left."""
        p, axes = self.parameters, []
        for i in p.free:
            q = p[i]
            axes.append(np.linspace(q.lower if q.lower is not None else q.value - 2 * q.error, q.upper if q.upper is not None else q.value + 2 * q.error, points))
        best_x, best = p.values(), self.objective.one(p.values())
        grid = np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")], 1) if len(axes) <= 3 else None
        for k, i in enumerate(p.free) if grid is None else [(None, None)]:
            rows = np.tile(best_x, (points if grid is None else len(grid), 1))
            if grid is None:
                rows[:, i] = axes[k]
            else:
                rows[:, p.free] = grid
            values = self.objective(rows)
            at = int(np.where(np.isfinite(values), values, np.inf).argmin())
            if values[at] < best or not math.isfinite(best):
                best_x, best = rows[at], float(values[at])
        for k, x in enumerate(best_x):
            p = p.set(k, value=float(x))
        self.parameters = p
        self.minimum = Minimum(best_x, best, math.nan, None, self.errordef, self.objective.nfcn, nonfinite_fval=not math.isfinite(best))
        return self

    def hesse(self) -> Fit:
        p = self.parameters
        x = p.initial_internal(self.precision)
        inner = self._inner(p)
        fx = inner.one(x)
        inverse, status, g = minimize.hesse(inner, x, errors=p.initial_internal_errors(self.precision), strategy=self.strategy, precision=self.precision, fx=fx)
        keep = self._internal or Minimum(x, fx, 0.0, None, self.errordef, 0)
        self._accept(minimize.replace(keep, x=x, fval=fx, inverse=inverse, status=status, gradient=g, edm=0.5 * float(g @ inverse @ g), dcovar=0.0), p)
        return self

    def find_deeper_minimum(self, jitters: int = 24, rounds: int = 50, gain: float = 1e-3, spread: float = 3.0, seed: int = 0) -> Fit:
        """Jittered restarts, round after round, until none goes deeper. Of a cost in Spark the restarts of a round go in step:
        they take as many jobs as the longest of them."""
        if self.minimum is None:
            self.migrad()
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            before, starts = self.fval, []
            for _ in range(jitters):
                pars = self.parameters
                for i in pars.free:
                    q = pars[i]
                    x = q.value + spread * q.error * rng.standard_normal()
                    x = max(x, q.lower) if q.lower is not None else x
                    pars = pars.set(i, value=float(min(x, q.upper) if q.upper is not None else x))
                starts.append(pars)
            found = [(v, x) for v, x, ok in self._minima(starts) if ok]
            best = min(found, key=lambda t: t[0], default=None)
            if best is None or not best[0] < before - gain:
                return self
            pars, kept = self.parameters, (self.parameters, self.minimum, self._internal)
            for k, x in enumerate(best[1]):
                pars = pars.set(k, value=float(x))
            self._changed(pars).migrad()
            if not self.fval < before:  # never left for something worse
                self.parameters, self.minimum, self._internal = kept
                return self
        return self

    find_global_minimum = find_deeper_minimum  # a former name

    # ---- profiles
    def _need(self) -> None:
        if self.minimum is None or self.minimum.inverse is None:
            raise ValueError("a fit with a covariance comes first")

    def _held(self, fixed: dict[int, float], near=None) -> Parameters:
        """The parameters with some held at values, the others at those of near."""
        p = self.parameters
        for k, x in enumerate(self.values if near is None else near):
            p = p.set(k, value=float(x))
        for i, x in fixed.items():
            p = p.set(i, value=float(x), fixed=True)
        return p

    def _minima(self, starts: Sequence[Parameters]) -> list[tuple[float, np.ndarray, bool]]:
        """(value, all parameters, valid) of the minimum from each start: of a cost in Spark all go in step, else one after another."""
        if self._together and len(starts):
            fits = lockstep.descend(lockstep.plain_evaluate(self.cost), starts, self.errordef)
            self.objective.nfcn += fits.evaluations
            self.objective.n_nonfinite += fits.nonfinite
            return [(float(f), x, bool(ok)) for f, x, ok in zip(fits.fval, fits.x, fits.valid, strict=True)]
        found = []
        for p in starts:
            if not p.n_free:
                v = self.objective.one(p.values())
                found.append((v, p.values(), math.isfinite(v)))
                continue
            m = minimize.migrad(self._inner(p), p.initial_internal(), p.initial_internal_errors(), Strategy(0), self.tol, None, self.precision)
            found.append((m.fval, p.external(m.x)[0], m.is_valid or (m.edm < 0.1 * self.errordef)))
        return found

    def conditional(self, fixed: dict[int, float], near=None) -> tuple[float, np.ndarray, bool]:
        """The minimum over the other free parameters with some held: (value, all parameters, valid)."""
        return self._minima([self._held(fixed, near)])[0]

    def _walk(self, walks: Sequence[Generator]) -> list:
        """The results of walks, each of which asks for the minimum at (held, near) again and again; they go in step."""
        results: list = [None] * len(walks)
        asked = {k: next(w) for k, w in enumerate(walks)}
        while asked:
            found = self._minima([self._held(*a) for a in asked.values()])
            going, asked = list(asked), {}
            for k, answer in zip(going, found, strict=True):
                try:
                    asked[k] = walks[k].send(answer)
                except StopIteration as end:
                    results[k] = end.value
        return results

    def _cross(self, along: dict[int, float], start: dict[int, float], aim: float, guess: float, most: float = math.inf, other=None) -> Generator:
        """A walk to where the profile along start + t along reaches aim: (t, valid, at a limit, parameters, whether it came upon less)."""
        near = self.values if other is None else other
        lo, f_lo, t, below = 0.0, self.fval, min(guess, most), False
        hi = f_hi = None
        for _ in range(40):
            value, near, ok = yield {i: start[i] + t * d for i, d in along.items()}, near
            if value < self.fval - 0.02 * self.errordef:
                below = True
                if self.deeper is None or value < self._deeper_value:
                    self.deeper, self._deeper_value = near.copy(), value
            if not math.isfinite(value):
                hi, f_hi = t, None
            elif abs(value - aim) < 1e-3 * self.errordef:
                return t, ok, False, near, below
            elif value < aim:
                lo, f_lo = t, value
                if t >= most:
                    return t, True, True, near, below
            else:
                hi, f_hi = t, value
            if hi is None:
                rise = max(f_lo - self.fval, 1e-12)
                t = min(most, lo * min(5.0, max(1.2, math.sqrt((aim - self.fval) / rise))))
            elif f_hi is None:
                t = (lo + hi) / 2
            else:  # the root of the rise is near linear
                a, b, c = math.sqrt(max(0.0, f_lo - self.fval)), math.sqrt(max(0.0, f_hi - self.fval)), math.sqrt(aim - self.fval)
                t = lo + (hi - lo) * min(0.95, max(0.05, (c - a) / (b - a) if b > a else 0.5))
            if hi is not None and hi - lo < 1e-9 * max(1.0, abs(hi)):
                break
        return t, False, False, near, below

    def _side(self, i: int, sign: int, sigma: float) -> Generator:
        """The walk along one side of a parameter's error."""
        q, value, cov = self.parameters[i], float(self.values[i]), self.covariance
        limit = q.lower if sign < 0 else q.upper
        most = math.inf if limit is None else abs(limit - value)
        shift = cov[:, i] / cov[i, i] * sign * sigma * math.sqrt(cov[i, i]) if cov[i, i] > 0 else 0
        near = np.array([x if p.inside(x) else v for x, v, p in zip(self.values + shift, self.values, self.parameters, strict=True)])
        return self._cross({i: float(sign)}, {i: value}, self.fval + self.errordef * sigma**2, sigma * q.error, most, near)

    def minos_errors(self, keys: Sequence, sigma: float = 1.0) -> list[MinosError]:
        """The errors of several parameters; all their sides go in step. nfcn counts the calls of all of them."""
        self._need()
        before = self.nfcn
        at = [self.parameters.index(k) for k in keys]
        found = self._walk([self._side(i, sign, sigma) for i in at for sign in (-1, 1)])
        errors = []
        for i, low, high in zip(at, found[::2], found[1::2], strict=True):
            q = self.parameters[i]
            (lo, lo_ok, lo_lim, lo_at, lo_new), (hi, hi_ok, hi_lim, hi_at, hi_new) = low, high
            errors.append(
                MinosError(
                    q.name, float(self.values[i]), -lo if lo_ok else -q.error, hi if hi_ok else q.error, lo_ok, hi_ok, lo_lim, hi_lim, lo_new, hi_new,
                    self.nfcn - before, tuple(map(float, lo_at)) if lo_ok else None, tuple(map(float, hi_at)) if hi_ok else None,
                )
            )
        return errors

    def minos_error(self, key, sigma: float = 1.0) -> MinosError:
        return self.minos_errors([key], sigma)[0]

    def minos(self, *keys, sigma: float = 1.0) -> Fit:
        for e in self.minos_errors(keys or [self.names[i] for i in self.parameters.free], sigma):
            self.merrors[e.name] = e
        return self

    def minos_lower(self, key) -> float:
        return self.minos_error(key).lower

    def minos_upper(self, key) -> float:
        return self.minos_error(key).upper

    def _range(self, key, bound: float | tuple[float, float], bins: int) -> np.ndarray:
        q = self.parameters[key]
        lo, hi = bound if isinstance(bound, tuple) else (q.value - bound * q.error, q.value + bound * q.error)
        lo = lo if q.lower is None else max(lo, q.lower)
        return np.linspace(lo, hi if q.upper is None else min(hi, q.upper), bins)

    def scan(self, key, maxsteps: int = 41, low: float = 0.0, high: float = 0.0) -> list[tuple[float, float]]:
        """The centre and maxsteps points, all in one batch; low above high gives the centre alone."""
        i = self.parameters.index(key)
        xs = np.empty(0) if low > high else self._range(key, 2.0, maxsteps) if low == high == 0 else self._range(key, (low, high), maxsteps)
        rows = np.tile(self.values, (len(xs) + 1, 1))
        rows[1:, i] = xs
        return list(zip(rows[:, i].tolist(), self.objective(rows).tolist(), strict=True))

    def profile(self, key, bins: int = 100, bound=2.0, subtract_min: bool = False) -> tuple[np.ndarray, np.ndarray]:
        i, xs = self.parameters.index(key), self._range(key, bound, bins)
        rows = np.tile(self.values, (bins, 1))
        rows[:, i] = xs
        f = self.objective(rows)
        return xs, f - np.nanmin(f) if subtract_min else f

    def mnprofile(self, key, bins: int = 30, bound=2.0, subtract_min: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The profile: at each point the other parameters are fitted anew."""
        xs, f, ok, _ = self.profile_states(key, bins, bound)
        return xs, f - np.nanmin(f) if subtract_min else f, ok

    def profile_states(self, key, bins: int = 30, bound=2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with all parameters at each point. In step, points begin on the line of the covariance; else each begins at its neighbour."""
        i, xs = self.parameters.index(key), self._range(key, bound, bins)
        if self._together:
            cov = self.covariance
            lean = cov[:, i] / cov[i, i] if cov is not None and cov[i, i] > 0 else np.zeros(self.npar)
            starts = self.values + np.outer(xs - self.values[i], lean)
            inside = np.array([[p.inside(v) for p, v in zip(self.parameters, r, strict=True)] for r in starts]).reshape(starts.shape)
            found = self._minima([self._held({i: float(x)}, near) for x, near in zip(xs, np.where(inside, starts, self.values), strict=True)])
        else:
            near, found = self.values, []
            for x in xs:
                found.append(self.conditional({i: float(x)}, near))
                near = found[-1][1]
        return xs, np.array([v for v, _, _ in found]), np.array([ok for _, _, ok in found]), np.array([x for _, x, _ in found])

    def contour_grid(self, a, b, size: int = 50, bound=2.0, subtract_min: bool = False, bounds: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A slice of the objective, one batch. bounds: a range for each of the two."""
        i, j = self.parameters.index(a), self.parameters.index(b)
        bound_a, bound_b = bounds or (bound, bound)
        xs, ys = self._range(a, bound_a, size), self._range(b, bound_b, size)
        rows = np.tile(self.values, (size * size, 1))
        rows[:, i], rows[:, j] = np.repeat(xs, size), np.tile(ys, size)
        z = self.objective(rows).reshape(size, size)
        return xs, ys, z - np.nanmin(z) if subtract_min else z

    def contour_ellipse(self, a, b, points: int = 20, up: float | None = None) -> np.ndarray:
        """Points of the ellipse of the covariance; with MINOS errors, of the side's error."""
        self._need()
        i, j = self.parameters.index(a), self.parameters.index(b)
        c = self.covariance
        s = math.sqrt(1.0 if up is None else up)
        rho = float(np.clip(c[i, j] / math.sqrt(c[i, i] * c[j, j]), -1, 1))
        t = 2 * math.pi * np.arange(points) / points
        u, v = np.cos(t), rho * np.cos(t) + math.sqrt(1 - rho * rho) * np.sin(t)

        def side(k: int, w: np.ndarray) -> np.ndarray:
            e = self.merrors.get(self.names[k])
            return np.where(w >= 0, e.upper, -e.lower) if e and e.is_valid else math.sqrt(c[k, k])

        return np.stack([self.values[i] + s * side(i, u) * u, self.values[j] + s * side(j, v) * v], 1)

    def contour_exact(self, a, b, points: int = 20, sigma: float = 1.0, full: bool = False) -> np.ndarray:
        """Points where the profile over two parameters rises by up sigma squared, in order around the contour.

        It begins with the profile errors of both; then the longest gap between two
        neighbours, in units of the errors, is halved: from its middle the contour is
        sought outwards, or inwards where the middle lies outside of it, as it does on
        a contour that isn't convex. A gap where neither finds it is left.
        """
        self._need()
        i, j = self.parameters.index(a), self.parameters.index(b)
        c, aim = self.covariance, self.fval + self.errordef * sigma**2
        scale = np.sqrt([c[i, i], c[j, j]])
        ring: list[np.ndarray] = []
        for _, ok, _, state, _ in self._walk([self._side(k, sign, sigma) for k, sign in ((i, 1), (j, 1), (i, -1), (j, -1))]):
            if ok:
                ring.append(state.copy())
        dead: set[tuple[int, int]] = set()
        while 2 <= len(ring) < points:
            at = np.array([x[[i, j]] for x in ring]) / scale
            gaps = np.linalg.norm(np.roll(at, -1, 0) - at, axis=1)
            k = next((int(k) for k in np.argsort(-gaps, kind="stable") if (id(ring[k]), id(ring[(k + 1) % len(ring)])) not in dead), None)
            if k is None:
                break
            m = (k + 1) % len(ring)
            along = at[m] - at[k]
            out = np.array([along[1], -along[0]]) / max(np.linalg.norm(along), 1e-300)  # the ring runs counterclockwise
            found = self._contour_point(i, j, (ring[k] + ring[m]) / 2, out * scale, gaps[k] / 2, aim)
            if found is None:
                dead.add((id(ring[k]), id(ring[m])))
            else:
                ring.insert(k + 1, found)
        return np.array([x if full else x[[i, j]] for x in ring[:points]])

    def _contour_point(self, i: int, j: int, middle: np.ndarray, out: np.ndarray, step: float, aim: float) -> np.ndarray | None:
        """All parameters where the profile along middle + t out reaches aim, t the least that is found; None if none is."""

        def most(sign: float) -> float:
            room = math.inf
            for k, w in ((i, sign * out[0]), (j, sign * out[1])):
                limit = self.parameters[k].upper if w > 0 else self.parameters[k].lower
                if limit is not None and w:
                    room = min(room, max(0.0, (limit - middle[k]) / w))
            return room

        def at(t: float, near: np.ndarray) -> tuple[float, np.ndarray]:
            v, x, _ = self.conditional({i: float(middle[i] + t * out[0]), j: float(middle[j] + t * out[1])}, near)
            return v, x

        near, tolerance = middle, 1e-3 * self.errordef
        value, near = at(0.0, near)
        if abs(value - aim) < tolerance:
            return near
        inside = value < aim
        sign = 1.0 if inside else -1.0
        room, t, lo, f_lo, hi, f_hi = most(sign), min(step, most(sign)), 0.0, value, None, None
        for _ in range(50):
            value, near = at(sign * t, near)
            if abs(value - aim) < tolerance:
                return near
            beyond = not math.isfinite(value) or (value < aim) != inside
            if beyond:
                hi, f_hi = t, value
            else:
                if t >= room:
                    return near if inside else None  # the limit cuts the contour
                lo, f_lo = t, value
            if hi is None:
                t = min(room, 2 * t)
            elif hi - lo < 1e-9 * max(1.0, hi):
                return None
            elif f_hi is not None and math.isfinite(f_hi) and math.isfinite(f_lo):
                t = lo + (hi - lo) * min(0.9, max(0.1, (aim - f_lo) / (f_hi - f_lo)))
            else:
                t = (lo + hi) / 2
        return None

    def cross(self, along: dict[str, float], sigma: float = 1.0) -> tuple[float, bool, bool]:
        """(t, valid, at a limit): how far along a direction in some parameters the profile rises by up sigma squared."""
        self._need()
        d = {self.parameters.index(k): float(v) for k, v in along.items()}
        most = math.inf
        for i, w in d.items():
            limit = self.parameters[i].upper if w > 0 else self.parameters[i].lower
            if limit is not None and w:
                most = min(most, abs((limit - self.values[i]) / w))
        scale = math.sqrt(sum((w / self.parameters[i].error) ** 2 for i, w in d.items()))
        walk = self._cross(d, {i: float(self.values[i]) for i in d}, self.fval + self.errordef * sigma**2, sigma / scale, most)
        return self._walk([walk])[0][:3]

    def mnmatrix(self, bins: int = 20, points: int = 12, cl: float = 0.68) -> dict:
        """What a matrix plot shows: a profile of each free parameter, a contour of each pair."""
        names = [self.names[i] for i in self.parameters.free]
        return {(a, b): self.mnprofile(a, bins)[:2] if a == b else self.mncontour(a, b, cl, points) for k, a in enumerate(names) for b in names[: k + 1]}

    def mncontour(self, a, b, cl: float = 0.68, points: int = 20) -> np.ndarray:
        """The joint confidence contour of two parameters."""
        return self.contour_exact(a, b, points, math.sqrt(delta_chisq(cl, 2)))

    def contour(self, a, b, points: int = 20, sigma: float = 1.0) -> Contour:
        """contour_exact with the profile errors of both parameters."""
        before = self.nfcn
        errors = self.minos_errors([a, b], sigma)
        found = self.contour_exact(a, b, points, sigma)
        return Contour(errors[0].name, errors[1].name, tuple((float(x), float(y)) for x, y in found), *errors, self.nfcn - before)

    # ---- output
    def to_dict(self) -> dict:
        m = self.minimum
        out = {"names": list(self.names), "values": self.values.tolist(), "errors": self.errors.tolist(), "fixed": self.fixed, "lower": [p.lower for p in self.parameters], "upper": [p.upper for p in self.parameters], "up": self.errordef, "nfcn": self.nfcn}
        if m is not None:
            out |= {"fval": m.fval, "edm": m.edm, "valid": m.is_valid, "cov_status": m.status, "made_pos_def": m.made_pos_def, "hesse_failed": m.hesse_failed, "reached_call_limit": m.reached_call_limit, "above_max_edm": m.above_max_edm, "nonfinite_fval": m.nonfinite_fval, "n_nonfinite": m.n_nonfinite, "covariance": None if self.covariance is None else self.covariance.tolist()}
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def result(self, spark: SparkSession) -> DataFrame:
        """One row with the fit's values, errors, covariance and flags."""
        d = self.to_dict()
        form = "values array<double>, errors array<double>, covariance array<array<double>>, fval double, edm double, up double, nfcn long, valid boolean, made_pos_def boolean, hesse_failed boolean, reached_call_limit boolean, above_max_edm boolean, nonfinite_fval boolean, n_nonfinite long, cov_status string"
        return spark.createDataFrame([tuple(d.get(k.split()[0]) for k in form.split(", "))], form)

    def to_latex(self) -> str:
        rows = [rf"{p.name.replace('_', chr(92) + '_')} & ${rounded(p.value, p.error)}$ \\" for p in self.parameters]
        return "\n".join([r"\begin{tabular}{lr}", *rows, r"\end{tabular}"])

    def checks(self) -> dict[str, bool]:
        """What makes a fit good, point by point."""
        m = self.minimum
        if m is None:
            return {"fitted": False}
        return {"fitted": True, "valid": m.is_valid, "finite": not m.nonfinite_fval, "below call limit": not m.reached_call_limit, "edm small": not m.above_max_edm, "covariance accurate": m.is_accurate, "covariance as computed": m.status == minimize.VALID, "away from limits": not any(p.has_limits and not p.fixed and any(b is not None and abs(p.value - b) < 0.5 * p.error for b in (p.lower, p.upper)) for p in self.parameters)}

    def strong_correlations(self, above: float = 0.95) -> list[tuple[str, str, float]]:
        c, names = self.matrix(correlation=True), [self.names[i] for i in self.parameters.free]
        return [] if c is None else [(names[i], names[j], float(c[i, j])) for i in range(len(names)) for j in range(i) if abs(c[i, j]) > above]

    def __repr__(self) -> str:
        head = f"fval = {self.fval:.6g}  edm = {self.edm:.3g}  nfcn = {self.nfcn}  valid = {self.valid}"
        rows = [f"{p.name:>12} = {p.value:.6g} +- {p.error:.3g}" + (" fixed" if p.fixed else "") + (f" in [{p.lower}, {p.upper}]" if p.has_limits else "") for p in self.parameters]
        return "\n".join([head, *rows])

    def _repr_html_(self) -> str:
        rows = "".join(f"<tr><td>{p.name}</td><td>{p.value:.6g}</td><td>{p.error:.3g}</td><td>{'fixed' if p.fixed else ''}</td></tr>" for p in self.parameters)
        parts = [f"<table><tr><th>name</th><th>value</th><th>error</th><th></th></tr>{rows}</table>"]
        if self.minimum is not None:
            parts.append("<ul>" + "".join(f"<li>{'&#10003;' if ok else '&#10007;'} {what}</li>" for what, ok in self.checks().items()) + "</ul>")
        c = self.matrix(correlation=True)
        if c is not None and len(c):
            names = [self.names[i] for i in self.parameters.free]
            head = "<tr><th></th>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
            # red for a positive correlation, blue for a negative one, white for none
            cell = lambda v: f'<td style="background:rgb({round(255 * min(1, 1 + v))},{round(255 * (1 - abs(v)))},{round(255 * min(1, 1 - v))})">{v:.2f}</td>'
            parts.append("<table>" + head + "".join(f"<tr><th>{n}</th>{''.join(cell(float(np.clip(v, -1, 1))) for v in row)}</tr>" for n, row in zip(names, c, strict=True)) + "</table>")
        return "".join(parts)


def rounded(value: float, error: float) -> str:
    """A value and its error to two digits of the error."""
    if not (math.isfinite(error) and error > 0):
        return f"{value:.6g}"
    places = max(0, 1 - math.floor(math.log10(error)))
    return rf"{value:.{places}f} \pm {error:.{places}f}"


def minimum_summary_from_dict(d: dict) -> dict:
    """The parts of a stored fit that stand without its objective."""
    return {k: d.get(k) for k in ("names", "values", "errors", "covariance", "fval", "edm", "up", "nfcn", "valid", "cov_status")}


def minos_to_latex(e: MinosError) -> str:
    """A value with its two errors, to two digits of the smaller one."""
    small = min(abs(e.lower), abs(e.upper)) or 1.0
    places = max(0, 1 - math.floor(math.log10(small)))
    return rf"{e.name} = ${e.value:.{places}f}_{{{e.lower:.{places}f}}}^{{+{e.upper:.{places}f}}}$"


def text_plot(points: Sequence[tuple[float, float]], width: int = 60, height: int = 20) -> str:
    """A scatter of points in letters."""
    pts = np.asarray(points, float)
    lo, hi = pts.min(0), pts.max(0)
    span = np.where(hi > lo, hi - lo, 1.0)
    grid = [[" "] * width for _ in range(height)]
    for x, y in pts:
        grid[height - 1 - int((y - lo[1]) / span[1] * (height - 1))][int((x - lo[0]) / span[0] * (width - 1))] = "*"
    return "\n".join("".join(r) for r in grid)
