"""Objectives: sums over a DataFrame's rows of a term with parameters bound in.

A model is a function of (x, p, m): a column or array, a sequence of parameters
and a math namespace. One objective serves the DataFrame, where many parameter
sets are summed in one job, and rows that are collected for small fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefit.functions.columns import TINY, SparkMath
from lodefit.functions.dual import Dual, DualMath, plain

#: Parameter sets whose sums are fused in one aggregate; more are dealt with by rows of sets.
FUSED = 24
#: Rows that may be collected for a local objective.
LOCAL_ROWS = 1_000_000
#: Sums of one aggregate, at most, where each set has several.
COLUMNS = 96
#: Sets of one job, whose parameters are part of its plan.
MOST_SETS = 4096


def summed(rows: DataFrame, columns: Sequence[str], thetas: np.ndarray, make: Callable, fused: int, vary: dict[str, Callable] | None = None, sets: np.ndarray | None = None, literal: bool = False, memo: dict | None = None) -> np.ndarray:
    """The sums over rows of make(p, own)'s columns at each row of thetas; NaN where a sum is null.

    One job for up to MOST_SETS sets. Up to fused sets are literals of one aggregate,
    if literal; others are dealt out as tiles of fused sets: a row is copied once for
    each tile, not for each set, and tiles are summed by partial aggregates; the last
    one is filled up. A tile's numbers are data, so the steps of a fit share their
    compiled code. vary: columns that differ by set, as functions of the set's number; own has them
    by name, made once for each row and set. sets: the numbers, else from 0. memo
    keeps the columns of tiles, which depend on no number, for the next call.
    """
    sets = np.arange(len(thetas)) if sets is None else np.asarray(sets)
    if len(thetas) > MOST_SETS:
        cuts = range(0, len(thetas), MOST_SETS)
        return np.concatenate([summed(rows, columns, thetas[i : i + MOST_SETS], make, fused, vary, sets[i : i + MOST_SETS], literal, memo) for i in cuts])
    vary = vary or {}
    columns = list(dict.fromkeys(columns))
    own = lambda k: {name: F.col(f"_{name}{k}") for name in vary}

    def made(numbers: list[Column]) -> list[Column]:
        return [f(k).alias(f"_{name}{i}") for name, f in vary.items() for i, k in enumerate(numbers)]

    def slots(params: list) -> list[list[Column]]:
        return [[c if isinstance(c, Column) else F.lit(float(c)) for c in make(p, own(k))] for k, p in enumerate(params)]

    def sums(every: list[list[Column]]) -> list[Column]:
        return [F.sum(c.cast("double")).alias(f"s{k}_{j}") for k, cs in enumerate(every) for j, c in enumerate(cs)]

    def read(r, every: list[list[Column]]) -> list[list[float]]:
        return [[np.nan if r[f"s{k}_{j}"] is None else r[f"s{k}_{j}"] for j in range(len(cs))] for k, cs in enumerate(every)]

    if len(thetas) <= fused and literal and not vary:
        every = slots([[F.lit(float(v)) for v in t] for t in thetas])
        return np.array(read(rows.agg(*sums(every)).collect()[0], every), float)
    while fused // 2 >= len(thetas):  # few sizes, so few kinds of code
        fused //= 2
    last = len(thetas) - 1
    at = [[min(k, last) for k in range(i, i + fused)] for i in range(0, len(thetas), fused)]
    tiles = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.array(*[F.lit(float(v)) for v in thetas[k]]) for k in tile]).alias("p"), F.array(*[F.lit(int(sets[k])) for k in tile]).alias("k")) for i, tile in enumerate(at)])
    long = rows.select(*columns, F.explode(tiles).alias("t"))
    memo, key = {} if memo is None else memo, (fused, thetas.shape[1])
    if key not in memo:
        every = slots([[F.col("t.p")[k][j] for j in range(thetas.shape[1])] for k in range(fused)])
        memo[key] = made([F.col("t.k")[k] for k in range(fused)]), every, sums(every)
    varied, every, summands = memo[key]
    if vary:
        long = long.select(*columns, "t", *varied)
    found = np.full((len(at) * fused, len(every[0])), np.nan)
    for r in long.groupBy(F.col("t.i").alias("i")).agg(*summands).collect():
        found[r["i"] * fused : (r["i"] + 1) * fused] = read(r, every)
    return found[: len(thetas)]


class TooManyRows(ValueError):
    """A cost whose rows don't fit the driver."""


class Cost:
    """rows with named columns; sums gives the columns to sum, combine the value from the sums."""

    errordef = 1.0
    columns: tuple[str, ...] = ()

    def __init__(self, rows: DataFrame, model: Callable, names: Sequence[str], mask: Column | None = None):
        self.rows = rows if mask is None else rows.where(mask)
        self.model, self.names = model, tuple(names)
        if len(set(self.names)) != len(self.names):
            raise ValueError("parameter names must be unique")

    def sums(self, row, p, m) -> list:
        raise NotImplementedError

    def combine(self, thetas: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return sums[:, 0]

    def __call__(self, *p: float) -> float:
        return float(self.evaluate(np.array([p], float))[0])

    def evaluate(self, thetas: np.ndarray) -> np.ndarray:
        """The objective at each row of thetas, in one Spark job; a value that can't be computed is NaN."""
        thetas = np.atleast_2d(np.asarray(thetas, float))
        row = {c: F.col(c) for c in self.columns}
        return self.combine(thetas, summed(self.rows, self.columns, thetas, lambda p, _: self.sums(row, p, SparkMath), FUSED, literal=True))

    # ---- derivatives
    def roots(self, row, p, m) -> list:
        """(weight, u): the curvature is the sum of weight times the products of u's derivatives."""
        raise NotImplementedError

    def whole(self, p, sums):
        """The value from the sums, of duals."""
        return sums[0]

    def bend(self, curvature: np.ndarray, sums: list[Dual]) -> np.ndarray:
        """The curvature of the value from that of the roots."""
        return curvature

    def expanded(self, row, p, m) -> list:
        """Each sum and its derivatives, then the upper triangle of the curvature, in columns or arrays."""
        n, dm = len(p), DualMath(m)
        duals = [Dual(v, {j: 1.0}) for j, v in enumerate(p)]
        row = {c: Dual(v) for c, v in row.items()}
        found = []
        for s in self.sums(row, duals, dm):
            found += [plain(s), *((s.slope(j) if isinstance(s, Dual) else 0.0) for j in range(n))]
        roots = self.roots(row, duals, dm)
        return found + [sum(plain(w) * (u.slope(i) * u.slope(j)) for w, u in roots) for i in range(n) for j in range(i, n)]

    def gathered(self, thetas: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, gradients, curvatures) from the sums of expanded, one row for each of thetas."""
        k, n = thetas.shape
        values, slopes, bends = np.empty(k), np.empty((k, n)), np.empty((k, n, n))
        upper = np.triu_indices(n)
        n_sums = (found.shape[1] - len(upper[0])) // (n + 1)
        with np.errstate(all="ignore"):
            for r, (t, f) in enumerate(zip(thetas, found, strict=True)):
                each = f[: n_sums * (n + 1)].reshape(n_sums, n + 1)
                sums = [Dual(x[0], dict(enumerate(x[1:]))) for x in each]
                whole = self.whole([Dual(v, {j: 1.0}) for j, v in enumerate(t)], sums)
                values[r], slopes[r] = whole.value, [whole.slope(j) for j in range(n)]
                c = np.zeros((n, n))
                c[upper] = f[n_sums * (n + 1) :]
                bends[r] = self.bend(c + np.triu(c, 1).T, sums)
        return values, slopes, bends

    def derivatives(self, thetas: np.ndarray, vary: dict[str, Callable] | None = None, keep: Sequence[str] = (), sets: np.ndarray | None = None, memo: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, gradients, curvatures) at each row of thetas, in one Spark job.

        The model runs on dual numbers, so derivatives are exact; the curvature is
        Gauss and Newton's: positive, made of first derivatives alone, near the
        Hessian where the model fits. vary: columns of a row that differ by set, as
        functions of the set's number that may use the columns keep; "weight" is what a row
        counts. sets numbers the rows of thetas for them, else from 0. memo: a dict to hand to
        the next call with the same vary, which then makes no columns anew.
        """
        thetas = np.atleast_2d(np.asarray(thetas, float))

        def make(p, own):
            found = self.expanded({c: own.get(c, F.col(c)) for c in self.columns}, p, SparkMath)
            return found if "weight" not in own else [F.when(own["weight"] != 0, c * own["weight"]).otherwise(0.0) for c in found]

        width = (thetas.shape[1] + 1) * (thetas.shape[1] + 6) // 2
        return self.gathered(thetas, summed(self.rows, [*self.columns, *keep], thetas, make, max(1, COLUMNS // width), vary, sets, memo=memo))

    def local(self) -> Callable[[np.ndarray], np.ndarray]:
        """The same objective over collected rows, for small data: NumPy, without jobs."""
        rows = self.rows.select(*self.columns).limit(LOCAL_ROWS + 1).collect()
        if len(rows) > LOCAL_ROWS:
            raise TooManyRows(f"more than {LOCAL_ROWS} rows: use evaluate")
        return self.on_arrays({c: np.array([r[c] for r in rows], float) for c in self.columns})

    def on_arrays(self, row: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        """The objective over arrays; it can go to a worker, as it holds no DataFrame."""
        plain = copy(self)
        plain.rows = None
        shape = row[self.columns[0]].shape

        def value(thetas: np.ndarray) -> np.ndarray:
            thetas = np.atleast_2d(np.asarray(thetas, float))
            with np.errstate(all="ignore"):
                sums = np.array([[float(np.sum(np.broadcast_to(c, shape))) for c in plain.sums(row, t, np)] for t in thetas])
                return plain.combine(thetas, sums)

        return value


class LeastSquares(Cost):
    """Sum of ((y - f(x)) / err) squared over points(x, y, err)."""

    columns = ("x", "y", "err")

    def sums(self, row, p, m):
        d = (row["y"] - self.model(row["x"], p, m)) / row["err"]
        return [d * d]

    def roots(self, row, p, m):
        return [(2.0, (row["y"] - self.model(row["x"], p, m)) / row["err"])]


class LinearLeastSquares(LeastSquares):
    """The same of a model that is linear in its parameters: p[0] basis[0](x, m) + p[1] basis[1](x, m) + ...

    Two aggregates give the normal equations and the sum at their solution, from
    which any parameter set is a small quadratic form: profiles, contours and
    extremes then cost no job, however many rows there are.
    """

    def __init__(self, rows, basis: Sequence[Callable], names, mask=None):
        super().__init__(rows, lambda x, p, m: sum(a * b(x, m) for a, b in zip(p, basis, strict=True)), names, mask)
        self.basis = tuple(basis)
        self._form: tuple[np.ndarray, np.ndarray, float, int] | None = None

    def form(self) -> tuple[np.ndarray, np.ndarray, float, int]:
        """(normal matrix, solution, sum at the solution, rows)."""
        if self._form is None:
            n, w = len(self.basis), 1 / (F.col("err") * F.col("err"))
            columns = [F.lit(1.0) * b(F.col("x"), SparkMath) for b in self.basis]
            sums = {f"g{i}_{j}": columns[i] * columns[j] * w for i in range(n) for j in range(i + 1)} | {f"r{i}": columns[i] * F.col("y") * w for i in range(n)}
            r = self.rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]).collect()[0]
            if not r["n"]:
                raise ValueError("no rows")
            normal = np.array([[r[f"g{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])
            best = np.linalg.solve(normal, np.array([r[f"r{i}"] for i in range(n)]))
            # the rest gives what rounding has left, and a sum in which nothing cancels
            d = F.col("y") - self.model(F.col("x"), [F.lit(float(v)) for v in best], SparkMath)
            rest = self.rows.agg(F.sum(d * d * w).alias("f"), *[F.sum(c * d * w).alias(f"r{i}") for i, c in enumerate(columns)]).collect()[0]
            step = np.linalg.solve(normal, np.array([rest[f"r{i}"] for i in range(n)]))
            self._form = normal, best + step, float(rest["f"] - step @ normal @ step), r["n"]
        return self._form

    def evaluate(self, thetas: np.ndarray) -> np.ndarray:
        normal, best, least, _ = self.form()
        d = np.atleast_2d(np.asarray(thetas, float)) - best
        return least + np.einsum("ij,jk,ik->i", d, normal, d)

    def derivatives(self, thetas, vary=None, keep=(), sets=None, memo=None):
        if vary:
            return super().derivatives(thetas, vary, keep, sets, memo)
        thetas = np.atleast_2d(np.asarray(thetas, float))
        normal, best, _, _ = self.form()
        return self.evaluate(thetas), 2 * (thetas - best) @ normal, np.broadcast_to(2 * normal, (len(thetas), *normal.shape)).copy()

    def local(self) -> Callable[[np.ndarray], np.ndarray]:
        self.form()
        plain = copy(self)
        plain.rows = None
        return plain.evaluate


class UnbinnedNLL(Cost):
    """Minus the sum of log pdf(x), floored at the smallest normal number; log: the model is the log density, as it is."""

    errordef = 0.5
    columns = ("x",)

    def __init__(self, rows, model, names, mask=None, log: bool = False):
        super().__init__(rows, model, names, mask)
        self.log = log

    def sums(self, row, p, m):
        f = self.model(row["x"], p, m)
        return [-f if self.log else -m.log(m.maximum(f, TINY))]

    def roots(self, row, p, m):
        f = self.model(row["x"], p, m)
        return [(1.0, f if self.log else m.log(m.maximum(f, TINY)))]


class ExtendedUnbinnedNLL(UnbinnedNLL):
    """The integral of the density less the sum of log density(x)."""

    def __init__(self, rows, model, integral: Callable, names, mask=None, log: bool = False):
        super().__init__(rows, model, names, mask, log)
        self.integral = integral

    def combine(self, thetas, sums):
        return np.array([self.integral(t) for t in thetas]) + sums[:, 0]

    def whole(self, p, sums):
        return self.integral(p) + sums[0]


class BinnedNLL(Cost):
    """Multinomial: sum of n log(n / mu) over hist(lo, hi, n), mu in proportion to cdf(hi) - cdf(lo) of the kept bins."""

    errordef = 0.5
    columns = ("lo", "hi", "n")

    def sums(self, row, p, m):
        q = m.maximum(self.model(row["hi"], p, m) - self.model(row["lo"], p, m), TINY)
        n = row["n"]
        return [m.where(n > 0, n * m.log(m.maximum(n, 1e-300) / q), 0.0), q, n]

    def combine(self, thetas, sums):
        with np.errstate(all="ignore"):
            return sums[:, 0] + np.where(sums[:, 2] > 0, sums[:, 2] * np.log(sums[:, 1] / sums[:, 2]), 0.0)

    def roots(self, row, p, m):
        return [(row["n"], m.log(m.maximum(self.model(row["hi"], p, m) - self.model(row["lo"], p, m), TINY)))]

    def whole(self, p, sums):
        return sums[0] + sums[2] * (sums[1] / sums[2]).log() if sums[2] > 0 else sums[0]

    def bend(self, curvature, sums):
        drift = np.array([sums[0].slope(j) for j in range(len(curvature))])  # the total is free: what all bins share doesn't bend
        return curvature - np.outer(drift, drift) / sums[2].value if sums[2] > 0 else curvature


class ExtendedBinnedNLL(Cost):
    """Poisson: sum of mu - n + n log(n / mu), mu the step of a scaled cdf over each bin."""

    errordef = 0.5
    columns = ("lo", "hi", "n")

    def sums(self, row, p, m):
        mu = m.maximum(self.model(row["hi"], p, m) - self.model(row["lo"], p, m), TINY)
        n = row["n"]
        return [mu - n + m.where(n > 0, n * m.log(m.maximum(n, 1e-300) / mu), 0.0)]

    def roots(self, row, p, m):
        mu = m.maximum(self.model(row["hi"], p, m) - self.model(row["lo"], p, m), TINY)
        return [(plain(mu), m.log(mu))]


class CostSum:
    """Costs that share parameters by name; each counts by its own errordef."""

    errordef = 1.0

    def __init__(self, *costs):
        self.costs = [c for x in costs for c in (x.costs if isinstance(x, CostSum) else [x])]
        self.names = tuple(dict.fromkeys(n for c in self.costs for n in c.names))
        if any(not c.names for c in self.costs):
            raise ValueError("every cost needs parameter names")

    def _at(self, thetas: np.ndarray, values: list[Callable]) -> np.ndarray:
        thetas = np.atleast_2d(np.asarray(thetas, float))
        return sum(v(thetas[:, [self.names.index(n) for n in c.names]]) / c.errordef for c, v in zip(self.costs, values, strict=True))

    def evaluate(self, thetas: np.ndarray) -> np.ndarray:
        return self._at(thetas, [c.evaluate for c in self.costs])

    def derivatives(self, thetas: np.ndarray, memo: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as of a cost; a job for each cost of the sum."""
        memo = {} if memo is None else memo
        thetas = np.atleast_2d(np.asarray(thetas, float))
        k, n = thetas.shape
        values, slopes, bends = np.zeros(k), np.zeros((k, n)), np.zeros((k, n, n))
        for i, c in enumerate(self.costs):
            at = [self.names.index(x) for x in c.names]
            v, g, b = c.derivatives(thetas[:, at], memo=memo.setdefault(i, {}))
            values += v / c.errordef
            slopes[:, at] += g / c.errordef
            bends[np.ix_(range(k), at, at)] += b / c.errordef
        return values, slopes, bends

    def local(self) -> Callable[[np.ndarray], np.ndarray]:
        values = [c.local() for c in self.costs]
        return lambda thetas: self._at(thetas, values)

    def __call__(self, *p: float) -> float:
        return float(self.evaluate(np.array([p], float))[0])


def add(a, b) -> CostSum:
    return CostSum(a, b)


Cost.__add__ = CostSum.__add__ = add


# ---- plain aggregates --------------------------------------------------------------------


def chisq(y: Column, f: Column, err: Column | float = 1.0) -> Column:
    """The aggregate of least squares."""
    d = (y - f) / err
    return F.sum(d * d)


def chi2(y: Column, err: Column, f: Column) -> Column:
    """Pearson chi-square; rows whose error isn't positive are left out."""
    return F.coalesce(F.sum(F.when(err > 0, ((y - f) / err) * ((y - f) / err))), F.lit(0.0))


def _log_ratio(n: Column, mu: Column) -> Column:
    return F.when(mu <= 0, F.raise_error(F.lit("mu must be positive")).cast("double")).when(n > 0, n * F.ln(n / mu)).otherwise(0.0)


def poisson_chi2(n: Column, mu: Column) -> Column:
    return 2 * F.sum(mu - n + _log_ratio(n, mu))


def multinomial_chi2(n: Column, mu: Column) -> Column:
    return 2 * F.sum(_log_ratio(n, mu))
