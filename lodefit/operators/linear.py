"""Closed-form fits from sufficient statistics: one aggregate, partial on every task, for any number of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_fit(df: DataFrame, x: Column, y: Column, err: float = 1.0, key: Sequence[str] = ()) -> DataFrame:
    """Straight lines y = intercept + slope x of equal errors, for each key.

    The moments are Spark's mergeable central ones, so nothing cancels. The
    covariance is 2 up V of the chi-square. Fewer than two values of x give nulls.
    """
    rows = df.select(*key, x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    m = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_pop("_x").alias("vx"), F.var_pop("_y").alias("vy"), F.covar_pop("_x", "_y").alias("cxy")
    )
    slope = F.when(F.col("vx") > 0, F.col("cxy") / F.col("vx"))
    e2 = err * err
    return m.select(
        *key, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.sqrt(e2 / (F.col("n") * F.col("vx"))).alias("slope_err"),
        F.sqrt(e2 / F.col("n") * (1 + F.col("mx") * F.col("mx") / F.col("vx"))).alias("intercept_err"),
        (-e2 * F.col("mx") / (F.col("n") * F.col("vx"))).alias("cov"),
        (F.col("n") * (F.col("vy") - slope * F.col("cxy")) / e2).alias("chi2"),
        (F.col("n") - 2).alias("ndf"),
    )


def exponential_mle(df: DataFrame, x: Column, key: Sequence[str] = ()) -> DataFrame:
    """Rate, its error and the least NLL of an exponential for each key; values above zero count."""
    m = df.select(*key, x.cast("double").alias("_x")).where("_x > 0").groupBy(*key).agg(F.count("*").alias("n"), F.avg("_x").alias("m"))
    return m.select(*key, "n", (1 / F.col("m")).alias("rate"), (1 / F.col("m") / F.sqrt("n")).alias("rate_err"), (F.col("n") * (1 + F.ln("m"))).alias("nll"))


def gaussian_mle(df: DataFrame, x: Column, key: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation with their errors for each key."""
    m = df.select(*key, x.cast("double").alias("_x")).groupBy(*key).agg(F.count("_x").alias("n"), F.avg("_x").alias("mu"), F.stddev_pop("_x").alias("sigma"))
    return m.select(*key, "n", "mu", "sigma", (F.col("sigma") / F.sqrt("n")).alias("mu_err"), (F.col("sigma") / F.sqrt(2 * F.col("n"))).alias("sigma_err"))


def bernoulli_mle(df: DataFrame, success: Column, key: Sequence[str] = ()) -> DataFrame:
    m = df.select(*key, success.cast("double").alias("_s")).where("_s is not null").groupBy(*key).agg(F.count("*").alias("n"), F.avg("_s").alias("p"))
    return m.select(*key, "n", "p", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")).alias("p_err"))
