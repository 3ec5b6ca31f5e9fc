"""Whole fits in parallel: one group of rows, one fit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefit.functions.shipping import ship
from lodefit.operators import lockstep
from lodefit.operators.costs import LOCAL_ROWS, Cost
from lodefit.operators.fit import Fit
from lodefit.operators.minimize import HESSE_FAILED, VALID

RESULT = "values array<double>, errors array<double>, fval double, edm double, nfcn long, valid boolean, cov_status string"


def fit_groups(df: DataFrame, key: str, make: Callable[[DataFrame], Cost], start: Sequence[float], limits: dict | None = None, strategy: int = 1, most_rows: int = LOCAL_ROWS) -> DataFrame:
    """key and a fit of each group's rows; make builds the cost from rows, whose columns df has.

    Groups of up to most_rows rows are fitted by a worker each. The rows of larger ones
    stay where they are: those fits go in step, and one aggregate by key a step
    sums all of them. A group that can't be fitted is a row that isn't valid.
    """
    cost = make(df)
    # at most one key for each most_rows rows
    large = [r[key] for r in df.groupBy(key).count().where(F.col("count") > most_rows).collect()]
    names, errordef, form = cost.names, cost.errordef, df.schema[key].dataType.simpleString()
    begin = dict(zip(names, map(float, start), strict=True))
    if large and not lockstep.has_derivatives(cost):
        raise ValueError("a group beyond a worker needs a model in its math namespace")
    ship(df.sparkSession)
    terms = copy(cost)
    terms.rows = None  # only the terms go to the workers

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        batch = terms.on_arrays({c: pdf[c].to_numpy(float) for c in terms.columns})
        f = Fit(batch, begin, errordef=errordef, limits=limits, strategy=strategy, batched=True).migrad()
        m = f.minimum
        return pd.DataFrame({key: [pdf[key].iloc[0]], "values": [f.values.tolist()], "errors": [f.errors.tolist()], "fval": [f.fval], "edm": [f.edm], "nfcn": [f.nfcn], "valid": [bool(f.valid)], "cov_status": [m.status]})

    known = [k for k in large if k is not None]
    is_large = F.coalesce(F.col(key).isin(known), F.lit(None in large)) if large else F.lit(False)
    found = df.where(~is_large).select(key, *cost.columns).groupBy(key).applyInPandas(run, f"{key} {form}, {RESULT}")
    if not large:
        return found
    cost = make(df.where(is_large))
    evaluate = lockstep.keyed_evaluate(cost, key, large)
    pars = Fit(lambda p: 0.0, begin, limits=limits).parameters
    fits = lockstep.descend(evaluate, [pars] * len(large), errordef)
    errors = lockstep.parabolic_errors(evaluate, fits.x, np.array([not p.fixed for p in pars]), errordef)
    rows = [
        (k, x.tolist(), e.tolist(), float(f), float(d), int(1 + 3 * n), bool(ok and np.isfinite(e).all()), VALID if np.isfinite(e).all() else HESSE_FAILED)
        for k, x, e, f, d, n, ok in zip(large, fits.x, errors, fits.fval, fits.edm, fits.steps, fits.valid, strict=True)
    ]
    return found.unionByName(df.sparkSession.createDataFrame(rows, found.schema))


def fit_restarts(spark: SparkSession, cost: Cost, starts: Sequence[Sequence[float]], limits: dict | None = None) -> list[tuple[float, np.ndarray, bool]]:
    """(value, parameters, valid) of the fits of one local objective from several starts, a task each, best first."""
    batch, names, errordef = cost.local(), cost.names, cost.errordef
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Fit(batch, dict(zip(names, pdf["p"].iloc[0], strict=True)), errordef=errordef, limits=limits, batched=True).migrad()
        return pd.DataFrame({"f": [f.fval], "p": [f.values.tolist()], "valid": [bool(f.valid)]})

    rows = spark.createDataFrame([(k, [float(v) for v in s]) for k, s in enumerate(starts)], "k int, p array<double>")
    done = rows.groupBy("k").applyInPandas(run, "f double, p array<double>, valid boolean").collect()
    return sorted(((r["f"], np.array(r["p"]), r["valid"]) for r in done), key=lambda t: (not np.isfinite(t[0]), t[0]))
