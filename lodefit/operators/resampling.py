"""Bootstrap and jackknife errors.

Replicates differ by hashed weights of (seed, replicate, obs_id), so results don't
depend on how rows are dealt. Closed forms are one aggregate for all replicates, fits
of costs go in step over weighted sums; any other refit runs in groups, one replicate each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefit.functions.columns import SparkMath, normal, poisson1, poisson_steps, uniform
from lodefit.functions.shared import written
from lodefit.functions.shipping import ship
from lodefit.operators import lockstep, order_stats
from lodefit.operators.costs import Cost, LeastSquares, UnbinnedNLL
from lodefit.operators.fit import Fit


def weighted(df: DataFrame, obs_id: str, n: int, seed: int = 0) -> DataFrame:
    """df with rep from 0 to n - 1 and the Poisson weight w, 0 included, of each row in it."""
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("w", poisson1(uniform(F.lit(seed), F.col(obs_id), F.col("rep"))))


def replicates(df: DataFrame, obs_id: str, n: int, seed: int = 0) -> DataFrame:
    """The same without the rows of weight 0."""
    return weighted(df, obs_id, n, seed).where("w > 0")


def bootstrap_mean(df: DataFrame, obs_id: str, value: Column, n: int = 200, seed: int = 0) -> DataFrame:
    """rep, value: the mean of each replicate; sums are fused by replicate before any shuffle."""
    r = weighted(df.select(obs_id, value.cast("double").alias("_v")), obs_id, n, seed)
    return r.groupBy("rep").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("value"))


def bootstrap_line(df: DataFrame, obs_id: str, x: Column, y: Column, n: int = 200, seed: int = 0) -> DataFrame:
    """rep, slope, intercept of weighted least squares in each replicate."""
    r = weighted(df.select(obs_id, x.cast("double").alias("_x"), y.cast("double").alias("_y")), obs_id, n, seed)
    w = F.col("w")
    s = r.groupBy("rep").agg(F.sum(w).alias("sw"), F.sum(w * F.col("_x")).alias("sx"), F.sum(w * F.col("_y")).alias("sy"), F.sum(w * F.col("_x") * F.col("_x")).alias("sxx"), F.sum(w * F.col("_x") * F.col("_y")).alias("sxy"))
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select("rep", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"))


def parametric(df: DataFrame, obs_id: str, fitted: Column, err: Column, n: int, seed: int = 0) -> DataFrame:
    """df with rep and y: the fitted value with Gaussian noise of the row's error."""
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("y", fitted + err * normal(F.lit(seed), F.col(obs_id), F.col("rep")))


def bootstrap(df: DataFrame, obs_id: str, refit: Callable[[pd.DataFrame], Sequence[float]], n: int = 1000, seed: int = 0) -> DataFrame:
    """replicates(rep, p, valid) of any fit: refit gets a replicate's rows with their weights w.

    A group holds one data set, as a fit of it does. A failing fit is a row of no values, valid false.
    """

    return _refits(replicates(df, obs_id, n, seed), refit)


def _refits(each: DataFrame, refit: Callable[[pd.DataFrame], Sequence[float]]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            p = [float(v) for v in refit(pdf)]
            ok = bool(np.isfinite(p).all())
        except (ArithmeticError, RuntimeError, ValueError):  # a fit that fails, not a fault in refit's code
            p, ok = [], False
        return pd.DataFrame({"rep": [int(pdf["rep"].iloc[0])], "p": [p], "valid": [ok]})

    ship(each.sparkSession)
    return each.groupBy("rep").applyInPandas(run, "rep int, p array<double>, valid boolean")


def _dealt(cost: Cost, *more: str | Column) -> DataFrame:
    """The cost's columns and more, once each, dealt evenly: rows of one file would be one task of every step."""
    own = [c for c in more if isinstance(c, Column) or c not in cost.columns]
    return cost.rows.select(*cost.columns, *own).repartition(int(cost.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _each(rows: DataFrame, n: int) -> DataFrame:
    """rows with _k from 0 to n - 1."""
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _resampled(cost: Cost, each: DataFrame, start: Sequence[float], n: int, limits: dict | None) -> DataFrame:
    """replicates(rep, p, valid) of fits in step, each of the rows of its _k: no replicate is gathered anywhere."""
    pars = Fit(lambda p: 0.0, dict(zip(cost.names, map(float, start), strict=True)), limits=limits).parameters
    fits = lockstep.descend(lockstep.replicate_evaluate(cost, each), [pars] * n, cost.errordef)
    rows = [(k, x.tolist() if ok else [], bool(ok)) for k, (x, ok) in enumerate(zip(fits.x, fits.valid, strict=True))]
    return cost.rows.sparkSession.createDataFrame(rows, "rep int, p array<double>, valid boolean")


def _points(cost: Cost) -> None:
    if not isinstance(cost, (LeastSquares, UnbinnedNLL)) or not lockstep.has_derivatives(cost):
        raise ValueError("only costs over points whose model stays in its math namespace can be resampled; bootstrap and jackknife take any refit")


def bootstrap_cost(cost: Cost, obs_id: str, start: Sequence[float], n: int = 200, seed: int = 0, limits: dict | None = None, noise: bool = False) -> DataFrame:
    """replicates(rep, p, valid) of a cost over rows that have obs_id. noise: y is drawn anew about the model at start.

    A replicate is a set of parameters and of hashed weights. The weights are written
    once, a row for each row and replicate, and a step of all fits is one
    aggregate of weights times terms over them, combined before any exchange, however
    many rows there are. Only sums over points can be resampled, and only least squares
    has errors to draw by. A fit that ends nowhere has no values, valid false.
    """
    _points(cost)
    if noise and not isinstance(cost, LeastSquares):
        raise ValueError("only least squares can be drawn from its model")
    if n < 1:
        return _resampled(cost, cost.rows, start, 0, limits)
    rows = _dealt(cost, obs_id)
    if noise:
        fitted = cost.model(F.col("x"), [F.lit(float(t)) for t in start], SparkMath)
        drawn = fitted + F.col("err") * normal(F.lit(seed), F.col(obs_id), F.col("_k"))
        return _resampled(cost, _each(written(rows), n).withColumn("y", drawn), start, n, limits)
    # hashes are columns before weights are: compiled code, and a filter beside them would make them twice
    hashed = _each(rows, n).select(*cost.columns, "_k", uniform(F.lit(seed), F.col(obs_id), F.col("_k")).alias("_u"))
    weights = written(hashed.select(*cost.columns, "_k", poisson_steps(F.col("_u")).cast("byte").alias("_w")))
    return _resampled(cost, weights.where("_w > 0"), start, n, limits)


def jackknife_cost(cost: Cost, block: Column, blocks: int, start: Sequence[float], limits: dict | None = None) -> DataFrame:
    """replicates(rep, p, valid) of a cost with each block of rows, numbered from 0, left out in turn; the fits go in step."""
    _points(cost)
    if blocks < 1:
        return _resampled(cost, cost.rows, start, 0, limits)
    rows = written(_dealt(cost, block.cast("int").alias("_block")))
    return _resampled(cost, _each(rows, blocks).where("_block <> _k"), start, blocks, limits)


def jackknife(df: DataFrame, block: Column, blocks: int, refit: Callable[[pd.DataFrame], Sequence[float]]) -> DataFrame:
    """replicates(rep, p, valid) of any fit with each block, numbered from 0, left out in turn."""
    each = df.withColumn("_b", block).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("rep <> _b").drop("_b")
    return _refits(each, refit)


def jackknife_summary(reps: DataFrame, whole: Sequence[float], names: Sequence[str]) -> DataFrame:
    """name, bias and error of each parameter; the scale is the number of valid groups. whole: the fit of all rows."""
    long = reps.where("valid").select(F.posexplode("p").alias("k", "v")).groupBy("k").agg(F.count("*").alias("g"), F.avg("v").alias("m"), F.var_pop("v").alias("v"))
    value = F.element_at(F.array(*[F.lit(float(v)) for v in whole]), F.col("k") + 1)
    return long.select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("name"), ((F.col("g") - 1) * (F.col("m") - value)).alias("bias"), F.sqrt((F.col("g") - 1) * F.col("v")).alias("error"))


def summary(reps: DataFrame, names: Sequence[str], cl: float = 0.68, filter_invalid: bool = True) -> DataFrame:
    """name, mean, std, lower, upper and n of each parameter over replicates(p, valid)."""
    rows = reps.where("valid") if filter_invalid else reps
    long = rows.select(F.posexplode("p").alias("k", "v")).where(~F.isnan("v") & (F.abs("v") != float("inf")))
    q = order_stats.quantiles(long, F.col("v"), [(1 - cl) / 2, (1 + cl) / 2], ["k"]).select("k", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    out = long.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("n")).join(q, "k")
    return out.select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("name"), "mean", "std", "lower", "upper", "n")


def correlation(reps: DataFrame, names: Sequence[str]) -> DataFrame:
    """a, b, corr of all pairs of parameters over valid replicates, in one aggregate."""
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names))]
    one = reps.where("valid").agg(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), (F.lit(1.0) if i == j else F.corr(F.col("p")[i], F.col("p")[j])).alias("corr")) for i, j in pairs]).alias("all"))
    return one.select(F.explode("all").alias("r")).select("r.*")


def jackknife_mean(df: DataFrame, value: Column, key: Sequence[str] = ()) -> DataFrame:
    """Delete-one mean, bias and variance for each key, from moments: leaving row i out gives (S - v_i) / (n - 1)."""
    m = df.select(*key, value.cast("double").alias("_v")).where("_v is not null").groupBy(*key).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.var_samp("_v").alias("v"))
    return m.select(*key, "n", "mean", F.lit(0.0).alias("bias"), (F.col("v") / F.col("n")).alias("variance"))


def jackknife_blocks(df: DataFrame, block: Column, value: Column) -> DataFrame:
    """groups, mean, bias and variance when each block of rows is left out in turn; blocks are summed first."""
    s = df.select(block.alias("_b"), value.cast("double").alias("_v")).groupBy("_b").agg(F.sum("_v").alias("s"), F.count("_v").alias("c"))
    t = s.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).collect()[0]
    left = s.select(((t["s"] - F.col("s")) / (t["c"] - F.col("c"))).alias("t"))
    g = left.agg(F.count("*").alias("groups"), F.lit(t["s"] / t["c"] if t["c"] else float("nan")).alias("mean"), F.avg("t").alias("a"), F.var_pop("t").alias("v"))
    return g.select("groups", "mean", ((F.col("groups") - 1) * (F.col("a") - F.col("mean"))).alias("bias"), ((F.col("groups") - 1) * F.col("v")).alias("variance"))


def jackknife_line(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """slope, bias and variance of a line with each row left out in turn, from total-minus-own sums."""
    rows = df.select(x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    t = rows.agg(F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_x") * F.col("_y")).alias("sxy")).collect()[0].asDict()

    def slope(n, sx, sy, sxx, sxy):
        return (n * sxy - sx * sy) / (n * sxx - sx * sx)

    if t["n"] < 3:
        raise ValueError("a line without one row needs three")
    c, xx, yy = F.col, F.col("_x"), F.col("_y")
    each = rows.select(slope(t["n"] - 1, t["sx"] - xx, t["sy"] - yy, t["sxx"] - xx * xx, t["sxy"] - xx * yy).alias("t"))
    g = each.agg(F.lit(t["n"]).alias("n"), F.lit(slope(**t)).alias("slope"), F.avg("t").alias("a"), F.var_pop("t").alias("v"))
    return g.select("n", "slope", ((c("n") - 1) * (c("a") - c("slope"))).alias("bias"), ((c("n") - 1) * c("v")).alias("variance"))

