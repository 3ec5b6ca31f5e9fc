"""Many fits in step: every step of all of them is one batch over the rows.

A fit is a row of a table of states: its parameters, its damping, its value with
gradient and curvature from dual numbers. Restarts, points of a profile, sides of
an error, replicates and groups differ only in where they begin, in what is held
and in what a row of data counts, so a step of all open fits is one Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefit.functions.columns import SparkMath
from lodefit.functions.dual import Dual
from lodefit.operators.costs import COLUMNS, MOST_SETS, Cost, CostSum
from lodefit.operators.linalg import make_posdef
from lodefit.operators.parameters import Parameter, Parameters

#: evaluate(numbers of fits, their parameters) -> values, gradients, curvatures
Evaluate = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: A fit is valid below this part of up, as a single one is by default.
VALID_EDM = 2e-4
#: A step is tried with the current damping, with so many times that, and without more damping but longer.
HARDER = 30.0
#: Inner coordinates begin at least this far from where a limit makes them flat.
OFF_LIMIT = 1e-3


@dataclass
class Fits:
    """The results, a row for each fit: parameters, values, distances to the minimum, validity; and the jobs they took together."""

    x: np.ndarray
    fval: np.ndarray
    edm: np.ndarray
    valid: np.ndarray
    jobs: int
    steps: np.ndarray
    evaluations: int = 0
    nonfinite: int = 0


def plain_evaluate(cost) -> Evaluate:
    """All fits of one cost over the same rows."""
    memo: dict = {}
    return lambda _, x: cost.derivatives(x, memo=memo)


def replicate_evaluate(cost: Cost, each: DataFrame) -> Evaluate:
    """Fit k is that of the rows of each whose _k is k, of which each counts _w times if there is such a column.

    A row meets all tries of its fit at once, so what makes a replicate's rows is made
    once a step. Parameters are data: the steps share their compiled code. A fit
    none of whose rows counts has sums of 0; without any row there are none.
    """
    n, memo = len(cost.names), {}
    row, counts = {c: F.col(c) for c in cost.columns}, F.col("_w") if "_w" in each.columns else F.lit(1.0)
    width = (n + 1) * (n + 2) // 2

    def sums(tries: int) -> list[Column]:
        if tries not in memo:
            found = [cost.expanded(row, [F.col("_t.p")[i][j] for j in range(n)], SparkMath) for i in range(tries)]
            memo[tries] = [F.sum((counts * c).cast("double")).alias(f"s{i}_{j}") for i, cs in enumerate(found) for j, c in enumerate(cs)]
        return memo[tries]

    def evaluate(k: np.ndarray, x: np.ndarray):
        if len(k) > MOST_SETS:
            parts = [evaluate(k[i : i + MOST_SETS], x[i : i + MOST_SETS]) for i in range(0, len(k), MOST_SETS)]
            return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        places: dict[int, list[int]] = {}
        for i, v in enumerate(k):
            places.setdefault(int(v), []).append(i)
        tries = min(max(1, COLUMNS // width), max(map(len, places.values())))
        # a fit's tries in tiles of so many, the last one filled up
        tiles = {v: [[at[min(j, len(at) - 1)] for j in range(i, i + tries)] for i in range(0, len(at), tries)] for v, at in places.items()}
        tile = lambda i, at: F.struct(F.lit(i).alias("i"), F.array(*[F.array(*[F.lit(float(a)) for a in x[j]]) for j in at]).alias("p"))
        sets = F.array(*[F.array(*[tile(i, at) for i, at in enumerate(tiles[v])]) if v in tiles else F.lit(None) for v in range(max(tiles) + 1)])
        found, seen = np.full((len(k), width), np.nan), set()
        met = each.withColumn("_t", F.explode(F.get(sets, F.col("_k"))))  # fits that are closed meet nothing
        for r in met.groupBy("_k", F.col("_t.i").alias("_i")).agg(*sums(tries)).collect():
            seen.add(r["_k"])
            for i, at in enumerate(tiles[r["_k"]][r["_i"]]):
                found[at] = [np.nan if r[f"s{i}_{j}"] is None else r[f"s{i}_{j}"] for j in range(width)]
        none = [i for v, at in places.items() if v not in seen for i in at]
        if none and (seen or each.limit(1).count()):
            found[none] = 0.0
        return cost.gathered(x, found)

    return evaluate


def keyed_evaluate(cost: Cost, key: str, keys: list) -> Evaluate:
    """Fit k is that of the rows whose key is keys[k]: parameters travel to their rows by key, and one aggregate by key sums all groups."""

    spark, n = cost.rows.sparkSession, len(cost.names)
    every = [c if not isinstance(c, float) else F.lit(c) for c in cost.expanded({c: F.col(c) for c in cost.columns}, [F.col("_p")[j] for j in range(n)], SparkMath)]
    sums = [F.sum(c.cast("double")).alias(f"s{j}") for j, c in enumerate(every)]

    def evaluate(k: np.ndarray, x: np.ndarray):
        # several sets of one key are told apart by their place
        places = [int((k[:i] == v).sum()) for i, v in enumerate(k)]
        form = T.StructType([cost.rows.schema[key], T.StructField("_k", T.IntegerType()), T.StructField("_p", T.ArrayType(T.DoubleType()))])
        sets = spark.createDataFrame([(keys[v], place, [float(a) for a in p]) for v, place, p in zip(k, places, x, strict=True)], form)
        own = cost.rows.select(F.col(key).alias("_key"), *cost.columns)
        rows = own.join(F.broadcast(sets), own["_key"].eqNullSafe(sets[key])).drop("_key")  # sets has a row for each key and try
        found = np.full((len(k), len(every)), np.nan)
        at = {(keys[v], place): i for i, (v, place) in enumerate(zip(k, places, strict=True))}
        for r in rows.groupBy(key, "_k").agg(*sums).collect():
            found[at[r[key], r["_k"]]] = [np.nan if r[f"s{j}"] is None else r[f"s{j}"] for j in range(len(every))]
        return cost.gathered(x, found)

    return evaluate


def descend(evaluate: Evaluate, parameters: Parameters | Sequence[Parameters], up: float, goal: float = 1e-12, most_steps: int = 60) -> Fits:
    """The minima of many fits, by damped Gauss-Newton steps in the parameters' inner coordinates.

    parameters: those of each fit, whose values they begin at; limits and what is
    held may differ. A step tries each open fit's damping, more of it and a longer way at once. A fit
    ends when its edm is at most goal times up, or when no step helps any more; it is valid
    if its edm is then small enough and its value finite. Values that can't be
    computed lose every comparison; a fit that begins at one isn't valid.
    """
    every = list(parameters)
    k, n = len(every), every[0].n_pars if every else 0
    if not k:
        return Fits(np.empty((0, n)), np.empty(0), np.empty(0), np.empty(0, bool), 0, np.empty(0, int))
    free = np.array([[not p.fixed for p in ps] for ps in every])
    given = np.array([[p.value for p in ps] for ps in every], float)
    v = np.array([[_begin(p) for p in ps] for ps in every], float)
    jobs = evaluations = nonfinite = 0

    def outer(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = np.array([[p.to_external(y) for p, y in zip(every[i], r, strict=True)] for i, r in zip(at, rows, strict=True)]).reshape(len(rows), n)
        return np.where(free[at], x, given[at])

    def look(at: np.ndarray, rows: np.ndarray):
        """(values, gradients, curvatures) in inner coordinates; what is held doesn't move."""
        nonlocal jobs, evaluations, nonfinite
        jobs, evaluations = jobs + 1, evaluations + len(at)
        f, g, c = evaluate(at, outer(at, rows))
        s = np.array([[p.slope(y) for p, y in zip(every[i], r, strict=True)] for i, r in zip(at, rows, strict=True)]) * free[at]
        turn = np.array([[_turn(p, y) for p, y in zip(every[i], r, strict=True)] for i, r in zip(at, rows, strict=True)]) * free[at]
        with np.errstate(all="ignore"):
            c = c * s[:, :, None] * s[:, None, :] + np.eye(n) * np.maximum(g * turn, 0)[:, None, :]
        g = np.where(free[at], g * s, 0.0)
        bad = ~(np.isfinite(f) & np.isfinite(g).all(1) & np.isfinite(c).all((1, 2)))
        nonfinite += int(bad.sum())
        f[bad], g[bad], c[bad] = np.nan, 0.0, 0.0
        return f, g, c

    def solved(at: np.ndarray, g: np.ndarray, c: np.ndarray, damping: np.ndarray) -> np.ndarray:
        """The damped Newton step back, in units where the curvature's diagonal is one, so that parameters of any size are alike."""
        scale = np.einsum("kii->ki", c)
        root = np.sqrt(np.where(scale > 0, scale, 1.0))
        unit = c / (root[:, :, None] * root[:, None, :]) + np.eye(n) * (damping[:, None, None] + 1e-14)
        unit = np.where(free[at][:, :, None] & free[at][:, None, :], unit, np.eye(n))
        return np.linalg.solve(unit, (g / root)[..., None])[..., 0] / root

    def distance(at: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        return 0.5 * np.einsum("ki,ki->k", g, solved(at, g, c, np.zeros(len(at))))

    everyone = np.arange(k)
    f, g, c = look(everyone, v)
    edm = np.where(np.isfinite(f), distance(everyone, g, c), np.inf)
    damping, reach, steps = np.full(k, 1e-3), np.full(k, 2.0), np.zeros(k, int)
    open_ = np.isfinite(f) & (edm > goal * up)
    for _ in range(most_steps):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        step, short = (solved(at, g[at], c[at], damping[at] * h) for h in (1.0, HARDER))
        trials = np.stack([v[at] - step, v[at] - short, v[at] - step * reach[at, None]])
        who = np.tile(at, len(trials))
        f2, g2, c2 = look(who, trials.reshape(-1, n))
        edm2 = distance(who, g2, c2)
        f2, g2, c2, edm2 = (a.reshape(len(trials), len(at), *a.shape[1:]) for a in (f2, g2, c2, edm2))
        best = np.argmin(np.where(np.isfinite(f2), f2, np.inf), axis=0)
        pick = (best, np.arange(len(at)))
        noise = 1e-13 * (np.abs(f[at]) + up)
        better = np.isfinite(f2[pick]) & ((f2[pick] < f[at] - noise) | ((f2[pick] <= f[at] + noise) & (edm2[pick] < edm[at])))
        to, took = at[better], tuple(p[better] for p in pick)
        v[to], f[to], g[to], c[to], edm[to] = trials[took], f2[took], g2[took], c2[took], edm2[took]
        damping[to] = np.maximum(damping[to] * np.where(took[0] == 1, HARDER, 1.0) / 10, 1e-12)
        reach[to] = np.where(took[0] == 2, np.minimum(2 * reach[to], 64.0), 1.0 + (reach[to] - 1) / 2)
        damping[at[~better]] *= 10 * HARDER
        steps[at] += 1
        open_[at] = (edm[at] > goal * up) & (damping[at] < 1e10)
    return Fits(outer(everyone, v), f, edm, np.isfinite(f) & (edm <= VALID_EDM * up), jobs, steps, evaluations, nonfinite)


def _begin(p: Parameter) -> float:
    """The inner coordinate that a parameter begins at, off the places where it is flat."""
    v = p.to_internal(p.value)
    if p.bound_kind == "none":
        return v
    if p.bound_kind == "both":
        edge = math.pi / 2 - OFF_LIMIT
        return min(max(v, -edge), edge)
    return v if abs(v) > OFF_LIMIT else OFF_LIMIT


def _turn(p: Parameter, v: float) -> float:
    """The second derivative of a parameter's value by its inner coordinate."""
    if p.bound_kind == "both":
        return -(p.upper - p.lower) * math.sin(v) / 2
    if p.bound_kind == "none":
        return 0.0
    return (1.0 if p.bound_kind == "lower" else -1.0) / (v * v + 1) ** 1.5


def hessians(evaluate: Evaluate, x: np.ndarray, steps: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The Hessian of each fit by the parameters that are free, from central differences of exact gradients: one job for all fits."""
    k, n = x.shape
    at = np.flatnonzero(free)
    shift = np.zeros((2 * len(at), k, n))
    for i, j in enumerate(at):
        shift[2 * i, :, j], shift[2 * i + 1, :, j] = steps[:, j], -steps[:, j]
    g = evaluate(np.tile(np.arange(k), 2 * len(at)), (x + shift).reshape(-1, n))[1].reshape(2 * len(at), k, n)
    h = np.stack([(g[2 * i] - g[2 * i + 1])[:, at] / (2 * steps[:, j, None]) for i, j in enumerate(at)], 1)
    return (h + h.transpose(0, 2, 1)) / 2


def parabolic_errors(evaluate: Evaluate, x: np.ndarray, free: np.ndarray, up: float) -> np.ndarray:
    """The errors of each fit's parameters from its Hessian; 0 for what is held, NaN where the Hessian isn't finite.

    Two jobs: the curvature gives the steps, the Hessian the errors.
    """
    k, n = x.shape
    at = np.flatnonzero(free)
    found = np.zeros((k, n))
    if not len(at) or not k:
        return found
    c = evaluate(np.arange(k), x)[2]
    size = np.sqrt(2 * up / np.maximum(np.einsum("kii->ki", c), 1e-300))
    h = hessians(evaluate, x, 1e-3 * np.where(np.isfinite(size), size, 1.0), free)
    for i in range(k):
        if not np.isfinite(h[i]).all():
            found[i, at] = np.nan
            continue
        found[i, at] = np.sqrt(np.diag(2 * up * np.linalg.inv(make_posdef(h[i])[0])))
    return found


def has_derivatives(cost) -> bool:
    """Whether a cost and its model can be run on dual numbers."""
    costs = cost.costs if isinstance(cost, CostSum) else [cost]
    if not all(isinstance(c, Cost) for c in costs):
        return False
    for c in costs:
        try:
            found = c.expanded({name: np.array([0.5]) for name in c.columns}, [0.5] * len(c.names), np)
            c.whole([Dual(0.5, {j: 1.0}) for j in range(len(c.names))], [Dual(1.0, {0: 1.0})] * 3)
        except (TypeError, AttributeError, ValueError, NotImplementedError):  # a model beyond its math namespace
            return False
        if not found:
            return False
    return True
