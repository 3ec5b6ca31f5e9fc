"""Samples of likelihoods and posteriors, and what is read from them.

Chains run side by side, one group each; all that follows is DataFrame aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodefit.functions.shipping import ship
from lodefit.operators import order_stats
from lodefit.operators.costs import TooManyRows
from lodefit.operators.fit import Fit

ENSEMBLE = "chain int, iter long, p array<double>, fval double, logpost double"


# ---- priors ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prior:
    """A log density of one parameter, by name, on a support."""

    name: str
    kind: str
    a: float = 0.0
    b: float = 1.0

    @property
    def support(self) -> tuple[float, float]:
        return {"uniform": (self.a, self.b), "half_normal": (0.0, math.inf)}.get(self.kind, (-math.inf, math.inf))

    def log(self, x: float) -> float:
        lo, hi = self.support
        if not lo <= x <= hi:
            return -math.inf
        if self.kind == "normal":
            return -0.5 * ((x - self.a) / self.b) ** 2 - math.log(self.b) - 0.5 * math.log(2 * math.pi)
        if self.kind == "half_normal":
            return -0.5 * (x / self.b) ** 2 - math.log(self.b) + 0.5 * math.log(2 / math.pi)
        return -math.log(self.b - self.a) if self.kind == "uniform" else 0.0


def flat_prior(name: str) -> Prior:
    return Prior(name, "flat")


def normal_prior(name: str, mean: float, sigma: float) -> Prior:
    if not sigma > 0:
        raise ValueError("sigma must be positive")
    return Prior(name, "normal", mean, sigma)


def uniform_prior(name: str, lower: float, upper: float) -> Prior:
    if not lower < upper:
        raise ValueError("lower must be below upper")
    return Prior(name, "uniform", lower, upper)


def half_normal_prior(name: str, sigma: float) -> Prior:
    if not sigma > 0:
        raise ValueError("sigma must be positive")
    return Prior(name, "half_normal", 0.0, sigma)


def combine_priors(*priors: Prior) -> tuple[Prior, ...]:
    """Priors of different parameters; two that both say something of one parameter are an error."""
    named = [p.name for p in priors if p.kind != "flat"]
    if len(set(named)) != len(named):
        raise ValueError("a parameter has more than one informative prior")
    return tuple(priors)


# ---- chains ------------------------------------------------------------------------------


class Target:
    """logpost of a parameter set: prior first, which costs nothing, then -f (temperature by up)."""

    def __init__(self, batch: Callable[[np.ndarray], np.ndarray], up: float, names: Sequence[str], limits: Sequence[tuple], priors: Sequence[Prior] = ()):
        self.batch, self.up, self.names = batch, up, list(names)
        self.in_spark = False
        self.lo = np.array([-math.inf if a is None else a for a, _ in limits])
        self.hi = np.array([math.inf if b is None else b for _, b in limits])
        self.priors = [(self.names.index(p.name), p) for p in priors]
        for i, p in self.priors:
            self.lo[i], self.hi[i] = max(self.lo[i], p.support[0]), min(self.hi[i], p.support[1])
        if (self.lo >= self.hi).any():
            raise ValueError("limits and priors leave no support")

    def many(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """logpost and f of many parameter sets, whose objective is one batch."""
        lp = np.array([-math.inf if (x < self.lo).any() or (x > self.hi).any() else sum(p.log(float(x[i])) for i, p in self.priors) for x in rows], float)
        f = np.full(len(rows), math.nan)
        ok = np.isfinite(lp)
        if ok.any():
            f[ok] = self.batch(rows[ok])
        return np.where(np.isfinite(f), lp - f / (2 * self.up), -math.inf), f

    def __call__(self, x: np.ndarray) -> tuple[float, float]:
        if (x < self.lo).any() or (x > self.hi).any():
            return -math.inf, math.nan
        prior = sum(p.log(float(x[i])) for i, p in self.priors)
        if prior == -math.inf:
            return prior, math.nan
        f = float(self.batch(x[None])[0])
        return (prior - f / (2 * self.up) if math.isfinite(f) else -math.inf), f


def metropolis(target: Target, x0: np.ndarray, root: np.ndarray, rng: np.random.Generator, steps: int, burn: int, thin: int, scale: float = 0.3) -> list[tuple]:
    """A random walk whose scale adapts, by half or double at most, in the burn-in alone."""
    x, (lp, f) = np.array(x0, float), target(np.asarray(x0, float))
    out, taken = [], 0
    for k in range(steps):
        new = x + scale * root @ rng.standard_normal(len(x))
        nlp, nf = target(new)
        if math.log(1 - rng.random()) < nlp - lp:
            x, lp, f = new, nlp, nf
            taken += 1
        if k < burn and (k + 1) % 100 == 0:
            scale *= min(2.0, max(0.5, taken / 100 / 0.3))
            taken = 0
        if k >= burn and (k - burn) % thin == 0:
            out.append((k, x.tolist(), f, lp))
    return out


def stretch(target: Target, start: np.ndarray, rng: np.random.Generator, steps: int, burn: int, thin: int) -> list[tuple]:
    """The affine-invariant ensemble of walkers in two halves; start: an even number of walkers, more than dimensions."""
    w = np.array(start, float)
    n, d = w.shape
    if n % 2 or n < 4 or n <= d:
        raise ValueError("walkers must be even, at least 4 and more than the parameters")
    state = [target(r) for r in w]
    out = []
    for k in range(steps):
        for half in (0, 1):
            mine, other = np.arange(half, n, 2), np.arange(1 - half, n, 2)
            for i in mine:
                z = (1 + rng.random()) ** 2 / 2
                anchor = w[rng.choice(other)]
                new = anchor + z * (w[i] - anchor)
                s = target(new)
                if math.log(1 - rng.random()) < (d - 1) * math.log(z) + s[0] - state[i][0]:
                    w[i], state[i] = new, s
        if k >= burn and (k - burn) % thin == 0:
            out += [(k * n + i, w[i].tolist(), state[i][1], state[i][0]) for i in range(n)]
    return out


def hamiltonian(target: Target, x0: np.ndarray, root: np.ndarray, rng: np.random.Generator, steps: int, burn: int, thin: int, leaps: int = 8) -> list[tuple]:
    """Hamiltonian moves in coordinates scaled by the covariance, with gradients by central differences."""
    h, d = 1e-5, len(x0)
    to = lambda q: x0 + root @ q
    grad = lambda q: np.array([(target(to(q + h * e))[0] - target(to(q - h * e))[0]) / (2 * h) for e in np.eye(d)])
    q, eps, out = np.zeros(d), 0.5, []
    lp, f = target(to(q))
    for k in range(steps):
        p = rng.standard_normal(d)
        a, m = q.copy(), p.copy()
        g = grad(a)
        for _ in range(leaps):
            m = m + eps / 2 * g
            a = a + eps * m
            g = grad(a)
            m = m + eps / 2 * g
        nlp, nf = target(to(a))
        ok = np.isfinite(g).all() and math.log(1 - rng.random()) < (nlp - m @ m / 2) - (lp - p @ p / 2)
        if ok:
            q, lp, f = a, nlp, nf
        if k < burn:
            eps *= 1.05 if ok else 0.9
        if k >= burn and (k - burn) % thin == 0:
            out.append((k, to(q).tolist(), f, lp))
    return out


def nuts(target: Target, x0: np.ndarray, root: np.ndarray, rng: np.random.Generator, steps: int, burn: int, thin: int, accept: float = 0.8, most_doublings: int = 8) -> list[tuple]:
    """The no-U-turn rule: a path is doubled, backwards or forwards, until its ends draw nearer to each other,
    and the next state is drawn from it by weight. The step size is averaged towards the wanted acceptance
    in the burn-in alone; coordinates are scaled by the covariance, gradients are central differences."""
    h, d = 1e-5, len(x0)
    to = lambda q: x0 + root @ q

    def state(q: np.ndarray) -> tuple:
        lp, f = target(to(q))
        if not math.isfinite(lp):
            return q, lp, f, np.zeros(d)
        ends = np.vstack([q + h * np.eye(d), q - h * np.eye(d)])
        v = target.many(x0 + ends @ root.T)[0]
        g = (v[:d] - v[d:]) / (2 * h)
        return q, lp, f, np.where(np.isfinite(g), g, 0.0)

    def leap(s: tuple, p: np.ndarray, eps: float) -> tuple[tuple, np.ndarray]:
        p = p + eps / 2 * s[3]
        new = state(s[0] + eps * p)
        return new, p + eps / 2 * new[3]

    def turns(a: tuple, b: tuple) -> bool:
        """Whether the ends (state, momentum), earlier and later, draw nearer."""
        span = b[0][0] - a[0][0]
        return span @ a[1] < 0 or span @ b[1] < 0

    def path(s: tuple, p: np.ndarray, way: int, doublings: int, eps: float, level: float) -> tuple:
        """(first end, last end, drawn state, log weight, goes on, acceptance, states) of 2^doublings leaps."""
        if doublings == 0:
            new, q = leap(s, p, way * eps)
            rise = new[1] - q @ q / 2 - level if math.isfinite(new[1]) else -math.inf
            return (new, q), (new, q), new, rise, rise > -1000, math.exp(min(0.0, rise)), 1
        near = path(s, p, way, doublings - 1, eps, level)
        if not near[4]:
            return near
        last = near[1] if way > 0 else near[0]
        far = path(*last, way, doublings - 1, eps, level)
        first, end = (near[0], far[1]) if way > 0 else (far[0], near[1])
        weight = np.logaddexp(near[3], far[3])
        drawn = far[2] if far[4] and math.log(1 - rng.random()) < far[3] - weight else near[2]
        return first, end, drawn, weight, far[4] and not turns(first, end), near[5] + far[5], near[6] + far[6]

    s, out = state(np.zeros(d)), []
    eps, mean, slow, centre = 0.5, 0.0, 0.0, math.log(5.0)
    for k in range(steps):
        p = rng.standard_normal(d)
        level = s[1] - p @ p / 2
        first = end = (s, p)
        weight, took, seen = 0.0, 0.0, 0
        for j in range(most_doublings):
            way = 1 if rng.random() < 0.5 else -1
            a, b, drawn, more, goes_on, acceptance, n = path(*(end if way > 0 else first), way, j, eps, level)
            first, end = (first, b) if way > 0 else (a, end)
            took, seen = took + acceptance, seen + n
            if goes_on and math.log(1 - rng.random()) < more - weight:
                s = drawn
            weight = np.logaddexp(weight, more)
            if not goes_on or turns(first, end):
                break
        if k < burn:  # dual averaging with the usual constants
            mean += (accept - took / seen - mean) / (k + 11)
            log_eps = centre - math.sqrt(k + 1) / 0.05 * mean
            part = (k + 1) ** -0.75
            slow = part * log_eps + (1 - part) * slow
            eps = math.exp(log_eps if k < burn - 1 else slow)
        if k >= burn and (k - burn) % thin == 0:
            out.append((k, to(s[0]).tolist(), s[2], s[1]))
    return out


def lockstep(spark: SparkSession, target: Target, centre: Sequence[float], covariance, chains: int = 4, sampler: str = "metropolis", steps: int = 1000, burn: int = 200, thin: int = 1, seed: int = 0, walkers: int | None = None, scale: float = 0.3) -> DataFrame:
    """The same ensembles of an objective that is summed in Spark: all chains take a step, and it is one batch of parameter sets.

    stretch moves half of every chain's walkers at a time. The other samplers need data that the workers can hold.
    """
    if sampler not in ("metropolis", "stretch"):
        raise ValueError(f"{sampler} needs rows that fit the workers; metropolis and stretch don't")
    centre, root, d = np.asarray(centre, float), np.linalg.cholesky(np.asarray(covariance, float)), len(centre)
    rng = np.random.default_rng(seed)
    per = 1 if sampler == "metropolis" else walkers or max(2 * d + 2, 8)
    if sampler == "stretch" and (per % 2 or per < 4 or per <= d):
        raise ValueError("walkers must be even, at least 4 and more than the parameters")
    x = centre + 2 * rng.standard_normal((chains * per, d)) @ root.T
    lp, f = target.many(x)
    for _ in range(200):
        bad = np.flatnonzero(~np.isfinite(lp))
        if not len(bad):
            break
        x[bad] = centre + 2 * rng.standard_normal((len(bad), d)) @ root.T
        lp[bad], f[bad] = target.many(x[bad])
    bad = ~np.isfinite(lp)
    x[bad] = centre
    lp[bad], f[bad] = target.many(x[bad]) if bad.any() else (lp[bad], f[bad])
    if not np.isfinite(lp).all():
        raise ValueError("the start is outside the support")
    scales, taken, out = np.full(chains, scale), np.zeros(chains), []
    places = np.arange(chains * per)
    halves = [places] if per == 1 else [places[places % per % 2 == h] for h in (0, 1)]
    for k in range(steps):
        for mine in halves:
            if per == 1:
                new, extra = x + scales[:, None] * rng.standard_normal(x.shape) @ root.T, 0.0
            else:
                z = (1 + rng.random(len(mine))) ** 2 / 2
                anchor = x[mine // per * per + 2 * rng.integers(0, per // 2, len(mine)) + 1 - mine % per % 2]
                new, extra = anchor + z[:, None] * (x[mine] - anchor), (d - 1) * np.log(z)
            nlp, nf = target.many(new)
            go = np.log(1 - rng.random(len(mine))) < extra + nlp - lp[mine]
            x[mine[go]], lp[mine[go]], f[mine[go]] = new[go], nlp[go], nf[go]
            if per == 1:
                taken += go
        if per == 1 and k < burn and (k + 1) % 100 == 0:
            scales *= np.clip(taken / 100 / 0.3, 0.5, 2.0)
            taken[:] = 0
        if k >= burn and (k - burn) % thin == 0:
            out += [(i // per, k * per + i % per, x[i].tolist(), float(f[i]), float(lp[i])) for i in map(int, places)]
    return spark.createDataFrame(out, ENSEMBLE)


def sample(spark: SparkSession, target: Target, centre: Sequence[float], covariance, chains: int = 4, sampler: str = "stretch", steps: int | None = None, burn: int | None = None, thin: int | None = None, seed: int = 0, walkers: int | None = None) -> DataFrame:
    """An ensemble of over-dispersed chains, one task each, each with a random stream of its own number."""
    default = {"stretch": (6000, 1000, 10), "metropolis": (52_000, 2_000, 25), "hmc": (3000, 500, 2), "nuts": (2000, 500, 1)}
    if sampler not in default:
        raise ValueError(f"unknown sampler {sampler!r}")
    steps, burn, thin = (a if b is None else b for a, b in zip(default[sampler], (steps, burn, thin), strict=True))
    ship(spark)
    centre, root = np.asarray(centre, float), np.linalg.cholesky(np.asarray(covariance, float))
    if not math.isfinite(target(centre)[0]):
        raise ValueError("the start is outside the support")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        rng = np.random.default_rng([seed, chain])

        def start() -> np.ndarray:
            for _ in range(200):
                x = centre + 2 * root @ rng.standard_normal(len(centre))
                if math.isfinite(target(x)[0]):
                    return x
            return centre

        if sampler == "stretch":
            got = stretch(target, np.array([start() for _ in range(walkers or max(2 * len(centre) + 2, 8))]), rng, steps, burn, thin)
        else:
            got = {"metropolis": metropolis, "hmc": hamiltonian, "nuts": nuts}[sampler](target, start(), root, rng, steps, burn, thin)
        return pd.DataFrame([(chain, *r) for r in got], columns=["chain", "iter", "p", "fval", "logpost"])

    return spark.range(chains).select(F.col("id").cast("int").alias("chain")).repartition(chains, "chain").groupBy("chain").applyInPandas(run, ENSEMBLE)


def target_of(fit: Fit, priors: Sequence[Prior] = ()) -> tuple[Target, list[str]]:
    """A fit's likelihood and limits with priors, over its free parameters, as it is now.

    Rows of a cost are collected, up to its bound, since each chain needs them all;
    beyond it the target's batches are jobs, and in_spark is true of it.
    """
    parameters, free = fit.parameters, fit.parameters.free
    in_spark = False
    try:
        whole = fit.cost.local() if hasattr(fit.cost, "local") else fit.objective.batch
    except TooManyRows:
        whole, in_spark = fit.cost.evaluate, True
    names = [parameters[i].name for i in free]
    if unknown := {p.name for p in priors} - set(names):
        raise ValueError(f"priors of parameters that aren't free: {sorted(unknown)}")
    values = parameters.values()

    def batch(rows: np.ndarray) -> np.ndarray:
        every = np.tile(values, (len(rows), 1))
        every[:, free] = rows
        return whole(every)

    target = Target(batch, fit.errordef, names, [(parameters[i].lower, parameters[i].upper) for i in free], combine_priors(*priors))
    target.in_spark = in_spark
    return target, names


def chains_of(spark: SparkSession, target: Target, fit: Fit, **options) -> DataFrame:
    """Chains about the fit, one task each; in lockstep if the objective is summed in Spark."""
    centre, covariance = fit.values[fit.parameters.free], fit.free_covariance
    return (lockstep if target.in_spark else sample)(spark, target, centre, covariance, **options)


def is_consistent(fit: Fit, target: Target) -> bool:
    """Whether the fit still is what the target was made of: same names, start within the support."""
    free = fit.parameters.free
    return target.names == [fit.parameters[i].name for i in free] and math.isfinite(target(fit.values[free])[0])


def mcmc_sample(spark: SparkSession, fit: Fit, sampler: str = "metropolis", **options) -> DataFrame:
    """An ensemble of the likelihood itself."""
    target, _ = target_of(fit)
    return chains_of(spark, target, fit, sampler=sampler, **options)


def bayesian(spark: SparkSession, fit: Fit, priors: Sequence[Prior] = (), level: float = 0.68, **options) -> tuple[DataFrame, DataFrame]:
    """The posterior's ensemble and its summary."""
    target, names = target_of(fit, priors)
    found = chains_of(spark, target, fit, **options)
    return found, posterior_summary(found, names, level)


# ---- summaries ---------------------------------------------------------------------------


def quantiles(rows: DataFrame, value: Column, p: Sequence[float], key: Sequence[str] = ()) -> DataFrame:
    """The linear quantiles of a value over finite rows, for each key."""
    v = rows.select(*key, value.cast("double").alias("_v")).where(~F.isnan("_v") & (F.abs("_v") != float("inf")))
    return order_stats.quantiles(v, F.col("_v"), p, key)


def quantile_band(ensemble: DataFrame, f: Callable[[Column], Column], xs: Sequence[float], p: Sequence[float] = (0.16, 0.5, 0.84)) -> DataFrame:
    """x, n, q: quantiles of f(x) over the ensemble at each of a few x."""
    each = ensemble.withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in xs])))
    return quantiles(each, f(F.col("x")), p, ["x"])


def credible_interval(rows: DataFrame, value: Column, level: float = 0.68) -> DataFrame:
    """The equal-tailed interval; level is a probability."""
    if not 0 < level < 1:
        raise ValueError("level is a probability")
    q = quantiles(rows, value, [(1 - level) / 2, (1 + level) / 2])
    return q.select(F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "n")


def upper_limit(rows: DataFrame, value: Column, level: float = 0.95) -> DataFrame:
    return quantiles(rows, value, [level]).select(F.col("q")[0].alias("limit"), "n")


def lower_limit(rows: DataFrame, value: Column, level: float = 0.95) -> DataFrame:
    return quantiles(rows, value, [1 - level]).select(F.col("q")[0].alias("limit"), "n")


def posterior_summary(ensemble: DataFrame, names: Sequence[str], level: float = 0.68) -> DataFrame:
    """name, mean, median, std, lower, upper of each parameter."""
    long = ensemble.select(F.posexplode("p").alias("k", "v"))
    q = order_stats.quantiles(long, F.col("v"), [(1 - level) / 2, 0.5, (1 + level) / 2], ["k"]).select("k", "q")
    s = long.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).join(q, "k")
    return s.select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("name"), "mean", F.col("q")[1].alias("median"), "std", F.col("q")[0].alias("lower"), F.col("q")[2].alias("upper"))


def split_rhat(draws: DataFrame, chain: str, order: str, value: str) -> DataFrame:
    """rhat of half chains (whole ones of fewer than 4 draws); NaN for a single chain or no spread."""
    by = Window.partitionBy(chain)
    k = draws.select(F.col(chain).alias("_c"), F.col(value).cast("double").alias("_v"), F.row_number().over(by.orderBy(order)).alias("_k"), F.count("*").over(by).alias("_n"))
    half = F.floor(F.col("_n") / 2)
    halves = k.where((F.col("_n") < 4) | (F.col("_k") <= half) | (F.col("_k") > F.col("_n") - half)).select("_c", "_v", F.when((F.col("_n") >= 4) & (F.col("_k") > half), 1).otherwise(0).alias("_h"))
    m = halves.groupBy("_c", "_h").agg(F.count("*").alias("n"), F.avg("_v").alias("m"), F.var_samp("_v").alias("v"))
    g = m.agg(F.count_distinct("_c").alias("chains"), F.count("*").alias("parts"), F.min("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    n = F.col("n")
    return g.select("chains", F.when((F.col("chains") < 2) | ~(F.col("w") > 0), float("nan")).otherwise(F.sqrt(((n - 1) / n * F.col("w") + F.col("b")) / F.col("w"))).alias("rhat"))


def effective_sample_size(draws: DataFrame, chain: str, order: str, value: str, most_lag: int = 1000) -> DataFrame:
    """chain, n, ess: n / (1 + 2 sum of autocorrelations) up to the first that isn't positive."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("o")["v"].to_numpy(float)
        n, total = len(v), 0.0
        d = v - v.mean()
        c0 = float(d @ d)
        for lag in range(1, min(n - 1, most_lag) + 1):
            rho = float(d[:-lag] @ d[lag:]) / c0 if c0 > 0 else 0.0
            if rho <= 0:
                break
            total += rho
        return pd.DataFrame({"chain": [pdf["chain"].iloc[0]], "n": [n], "ess": [n / (1 + 2 * total)]})

    ship(draws.sparkSession)
    named = draws.select(F.col(chain).cast("string").alias("chain"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return named.groupBy("chain").applyInPandas(run, "chain string, n long, ess double")


def autocorrelation(draws: DataFrame, chain: str, order: str, value: str, lags: Sequence[int]) -> DataFrame:
    """chain, lag, rho at a few lags, by window functions."""
    by = Window.partitionBy("_c")
    d = draws.select(F.col(chain).alias("_c"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")).withColumn("_d", F.col("_v") - F.avg("_v").over(by))
    lagged = d.select("_c", "_d", *[F.lag("_d", k).over(by.orderBy("_o")).alias(f"l{k}") for k in lags])
    g = lagged.groupBy("_c").agg(F.sum(F.col("_d") * F.col("_d")).alias("c0"), *[F.sum(F.col("_d") * F.col(f"l{k}")).alias(f"s{k}") for k in lags])
    return g.select(F.col("_c").alias(chain), "c0", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in lags])).alias("r")).select(chain, "r.lag", (F.col("r.s") / F.col("c0")).alias("rho"))


def boundary_flag(rows: DataFrame, value: Column, lower: float | None, upper: float | None, share: float = 0.12, key: Sequence[str] = ()) -> DataFrame:
    """near: the share of draws within half a deviation of a limit; flagged above the given share. A null key is a key."""
    v = rows.select(*key, value.cast("double").alias("_v"))
    if key:
        spread = v.groupBy(*key).agg(F.stddev_samp("_v").alias("_s"))
        spread = spread.select("_s", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
        m = v.join(spread, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    else:
        m = v.withColumn("_s", F.lit(v.agg(F.stddev_samp("_v")).first()[0]).cast("double"))
    close = F.lit(False)
    if lower is not None:
        close = close | (F.col("_v") - lower < 0.5 * F.col("_s"))
    if upper is not None:
        close = close | (upper - F.col("_v") < 0.5 * F.col("_s"))
    return m.groupBy(*key).agg(F.avg(close.cast("double")).alias("near")).withColumn("flagged", F.col("near") > share)
