"""Dual numbers, derivatives of costs, and many fits in step."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefit.functions.columns import SparkMath
from lodefit.functions.dual import Dual, DualMath, plain
from lodefit.operators import lockstep, modes, resampling
from lodefit.operators.costs import BinnedNLL, Cost, ExtendedBinnedNLL, ExtendedUnbinnedNLL, LeastSquares, LinearLeastSquares, UnbinnedNLL
from lodefit.operators.fit import Fit
from lodefit.operators.groups import fit_groups
from lodefit.operators.parameters import Parameter, Parameters

EXP = lambda x, p, m: p[0] * m.exp(-p[0] * x)
CURVE = lambda x, p, m: p[0] * m.exp(-p[1] * x) + p[2]
FUNCTIONS = [
    lambda x, p, m: p[0] * x + p[1],
    lambda x, p, m: m.exp(-p[0] * x) / (1 + p[1] * p[1]),
    lambda x, p, m: m.log(p[0] + x) - 2.0 / p[1],
    lambda x, p, m: m.sqrt(p[0] * x) * m.sin(p[1] * x) + m.cos(p[0]) ** 2,
    lambda x, p, m: m.arctan(p[0] - x) * abs(p[1] - x) - 3,
    lambda x, p, m: m.maximum(p[0] * x, p[1]) + m.minimum(x, p[0]),
    lambda x, p, m: m.where(x > p[0], p[1] * x, 1 - p[0] / x),
    lambda x, p, m: (1 - p[0]) ** 3 * x**2 - x / p[1] + (2 - p[1]) * (x - p[0]),
]


def parameters(*values, **options):
    return Parameters(tuple(Parameter(f"p{i}", v, 0.1, **options) for i, v in enumerate(values)))


@pytest.mark.parametrize("k", range(len(FUNCTIONS)))
def test_duals_agree_with_differences(spark, k):
    f, x, at, h = FUNCTIONS[k], np.array([0.3, 0.9, 1.7, 4.0]), np.array([1.1, 0.7]), 1e-6
    duals = [Dual(v, {j: 1.0}) for j, v in enumerate(at)]
    got = f(Dual(x), duals, DualMath(np))
    assert np.allclose(got.value, f(x, at, np))
    for j in range(2):
        d = np.eye(2)[j] * h
        assert np.allclose(got.slope(j), (f(x, at + d, np) - f(x, at - d, np)) / (2 * h), atol=1e-7)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    columns = f(Dual(F.col("x")), [Dual(F.lit(float(v)), {j: 1.0}) for j, v in enumerate(at)], DualMath(SparkMath))
    found = df.select(columns.value.alias("v"), *[(F.lit(0.0) + columns.slope(j)).alias(f"s{j}") for j in range(2)]).collect()
    assert np.allclose([[r["v"], r["s0"], r["s1"]] for r in found], np.stack([got.value, *(np.broadcast_to(plain(got.slope(j)), x.shape) for j in range(2))], 1))


def test_duals_of_numpy_functions():
    d = Dual(2.0, {0: 1.0})
    assert np.exp(d).slope(0) == pytest.approx(math.exp(2)) and np.log(d).slope(0) == 0.5 and np.sqrt(d).slope(0) == pytest.approx(0.5 / math.sqrt(2))
    assert (np.array([1.0, 2.0]) * d).slope(0).tolist() == [1.0, 2.0] and d > 1 and d <= 2 and not d < 2
    with pytest.raises(TypeError):
        d**d


@pytest.fixture(scope="module")
def costs(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(0.1 * i, 3 * math.exp(-0.03 * i) + 0.5 + 0.1 * rng.normal(), 0.1 + 0.001 * i) for i in range(100)], "x double, y double, err double").withColumn("obs_id", F.monotonically_increasing_id())
    values = spark.createDataFrame([(i, float(v), i % 3) for i, v in enumerate(rng.exponential(2.0, 400))], "obs_id long, x double, k long")
    n = np.histogram(rng.exponential(2.0, 500), np.arange(0, 10, 0.5))[0]
    hist = spark.createDataFrame([(0.5 * i, 0.5 * i + 0.5, float(c)) for i, c in enumerate(n)], "lo double, hi double, n double")
    return {
        "curve": (LeastSquares(points, CURVE, ["a", "b", "c"]), [2.8, 0.25, 0.4]),
        "unbinned": (UnbinnedNLL(values, EXP, ["rate"]), [0.4]),
        "log": (UnbinnedNLL(values, lambda x, p, m: m.log(p[0]) - p[0] * x, ["rate"], log=True), [0.4]),
        "extended": (ExtendedUnbinnedNLL(values, lambda x, p, m: p[1] * EXP(x, p, m), lambda t: t[1] * (1 - np.exp(-20 * t[0])), ["rate", "n"]), [0.4, 390.0]),
        "binned": (BinnedNLL(hist, lambda x, p, m: 1 - m.exp(-p[0] * x), ["rate"]), [0.6]),
        "extended binned": (ExtendedBinnedNLL(hist, lambda x, p, m: p[1] * (1 - m.exp(-p[0] * x)), ["rate", "n"]), [0.6, 450.0]),
    }


@pytest.mark.parametrize("name", ["curve", "unbinned", "log", "extended", "binned", "extended binned"])
def test_gradients_of_costs(costs, name):
    """To 1e-8 of the gradient's scale, and a curvature that is positive and near the Hessian at the minimum."""
    cost, at = costs[name]
    at, h = np.array(at), 1e-5 * np.maximum(np.abs(costs[name][1]), 0.1)
    f, g, c = cost.derivatives(at)
    assert f[0] == pytest.approx(cost(*at), rel=1e-12)
    shifted = np.array([cost.evaluate(np.array([at + d, at - d, at + 2 * d, at - 2 * d])) for d in np.diag(h)])
    want = (8 * (shifted[:, 0] - shifted[:, 1]) - (shifted[:, 2] - shifted[:, 3])) / (12 * h)
    assert np.allclose(g[0], want, rtol=1e-6, atol=1e-8 * abs(f[0]) / h.max())
    fits = lockstep.descend(lockstep.plain_evaluate(cost), [parameters(*at)], cost.errordef)
    assert fits.valid.all()
    _, _, bend = cost.derivatives(fits.x)
    hessian = lockstep.hessians(lockstep.plain_evaluate(cost), fits.x, 1e-3 * np.abs(fits.x), np.ones(len(at), bool))
    assert (np.linalg.eigvalsh(bend[0]) > 0).all() and np.allclose(bend[0], hessian[0], rtol=0.35, atol=0.1 * np.abs(hessian).max())


def test_sum_of_costs(costs):
    total = costs["unbinned"][0] + costs["extended"][0]
    f, g, c = total.derivatives([[0.4, 390.0]])
    h = np.array([1e-5, 1e-2])
    want = [(total(*(np.array([0.4, 390.0]) + d)) - total(*(np.array([0.4, 390.0]) - d))) / (2 * s) for d, s in zip(np.diag(h), h, strict=True)]
    assert f[0] == pytest.approx(total(0.4, 390.0)) and np.allclose(g[0], want, rtol=1e-5) and c.shape == (1, 2, 2)


def test_limits_and_what_is_held(costs):
    cost, _ = costs["unbinned"]
    mean = cost.rows.agg(F.avg("x")).first()[0]
    starts = [parameters(0.01), parameters(20.0), parameters(0.9, lower=0.0), parameters(0.9, lower=0.8, upper=2.0), parameters(0.3, upper=0.4), parameters(0.7, fixed=True), parameters(0.8, lower=0.8)]
    fits = lockstep.descend(lockstep.plain_evaluate(cost), starts, 0.5)
    best = 1 / mean
    want = [best, best, best, max(best, 0.8), min(best, 0.4), 0.7, max(best, 0.8)]
    assert fits.x[:, 0] == pytest.approx(want, rel=1e-5) and fits.valid.all() and fits.steps[5] == 0
    bad = lockstep.descend(lockstep.plain_evaluate(LeastSquares(cost.rows.selectExpr("x", "x AS y", "1D AS err"), lambda x, p, m: m.log(p[0]) * x, ["a"])), [parameters(-1.0), parameters(2.0)], 1.0)
    assert bad.valid.tolist() == [False, True] and bad.x[1, 0] == pytest.approx(math.e, rel=1e-6)
    none = lockstep.descend(lockstep.plain_evaluate(cost), [], 0.5)
    assert none.jobs == 0 and len(none.x) == 0


class Counting(LeastSquares):
    jobs = 0

    def derivatives(self, *a, **b):
        type(self).jobs += 1
        return super().derivatives(*a, **b)


def test_restarts_take_the_jobs_of_the_longest(spark):
    rows = spark.range(60).selectExpr("0.1D * id AS x", "sin(0.3D * id) AS y", "0.1D AS err")
    wave = Counting(rows, lambda x, p, m: m.sin(p[0] * x), ["w"])
    starts = [parameters(float(v)) for v in np.linspace(0.5, 6, 24)]
    alone = []
    for p in starts:
        Counting.jobs = 0
        alone.append(lockstep.descend(lockstep.plain_evaluate(wave), [p], 1.0))
        assert alone[-1].jobs == Counting.jobs
    Counting.jobs = 0
    found = lockstep.descend(lockstep.plain_evaluate(wave), starts, 1.0)
    assert Counting.jobs == found.jobs == max(a.jobs for a in alone)
    assert np.allclose(found.x, [a.x[0] for a in alone], atol=1e-6)
    fit = Fit(wave, {"w": 2.2}, errors=[0.3]).migrad()
    assert fit.find_deeper_minimum(jitters=80, spread=3.0 / fit.errors[0], seed=1).values[0] == pytest.approx(3.0, abs=1e-3)


def test_profiles_in_step(costs):
    """Profiles, errors and contours of a non-linear fit in Spark, against the same over collected rows."""
    cost, start = costs["curve"]
    one, other = (Fit(cost, dict(zip(cost.names, start, strict=True)), local=local).migrad().hesse() for local in (False, True))
    assert one._together and not other._together
    xs, f, ok = one.mnprofile("b", 9)
    _, g, _ = other.mnprofile("b", 9, (float(xs[0]), float(xs[-1])))
    assert ok.all() and np.allclose(f, g, atol=2e-3)
    a, b = (x.minos().merrors for x in (one, other))
    for n in cost.names:
        assert a[n].is_valid and (a[n].lower, a[n].upper) == pytest.approx((b[n].lower, b[n].upper), rel=5e-3) and len(a[n].upper_state) == 3
    rise = [cost.evaluate(np.array([p])) for p in one.contour_exact("a", "b", 6, full=True)]
    assert np.allclose(np.array(rise).ravel() - one.fval, 1, atol=0.02)


def test_linear_costs_take_no_job(spark):
    rows = spark.range(30).selectExpr("0.1D * id AS x", "0.2D * id + 1 + 0.1D * (id % 3 - 1) AS y", "0.1D AS err")
    cost = LinearLeastSquares(rows, [lambda x, m: x, lambda x, m: 1.0], ["a", "b"])
    plain_cost = LeastSquares(rows, lambda x, p, m: p[0] * x + p[1], ["a", "b"])
    for a, b in zip(cost.derivatives([[1.5, 0.5]]), plain_cost.derivatives([[1.5, 0.5]]), strict=True):
        assert np.allclose(a, b, rtol=1e-9)


def test_resampling_in_step(spark, costs):
    cost, _ = costs["unbinned"]
    weights = resampling.weighted(cost.rows, "obs_id", 6, 3).groupBy("rep").agg((F.sum("w") / F.sum(F.col("w") * F.col("x"))).alias("r")).collect()
    got = {r["rep"]: r["p"][0] for r in resampling.bootstrap_cost(cost, "obs_id", [0.3], 6, 3).collect()}
    assert got == pytest.approx({r["rep"]: r["r"] for r in weights}, rel=1e-6)
    x = np.array([(r["x"], r["k"]) for r in cost.rows.collect()])
    left = {r["rep"]: r["p"][0] for r in resampling.jackknife_cost(cost, F.col("k"), 3, [0.3]).collect()}
    assert left == pytest.approx({k: 1 / x[x[:, 1] != k, 0].mean() for k in range(3)}, rel=1e-6)
    curve, start = costs["curve"]
    drawn = resampling.bootstrap_cost(curve, "obs_id", start, 5, 1, noise=True).collect()
    assert all(r["valid"] for r in drawn) and len({tuple(r["p"]) for r in drawn}) == 5
    with pytest.raises(ValueError, match="points"):
        resampling.bootstrap_cost(costs["binned"][0], "obs_id", [0.3])
    with pytest.raises(ValueError, match="points"):
        resampling.jackknife_cost(LeastSquares(curve.rows, lambda x, p, m: F.exp(x) * p[0], ["a"]), F.lit(0), 2, [1.0])


def test_weights_are_made_once_and_steps_are_dealt(spark, costs, tmp_path, monkeypatch):
    # hashes in every try of every step took longer than all else, and rows of one file were one task of a step
    cost, _ = costs["unbinned"]
    cost.rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    one = UnbinnedNLL(spark.read.parquet(str(tmp_path / "t")), cost.model, cost.names)
    seen = []
    make = lockstep.replicate_evaluate
    monkeypatch.setattr(lockstep, "replicate_evaluate", lambda c, each: seen.append(each) or make(c, each))
    want = {r["rep"]: r["p"][0] for r in resampling.bootstrap_cost(cost, "obs_id", [0.3], 6, 3).collect()}
    assert {r["rep"]: r["p"][0] for r in resampling.bootstrap_cost(one, "obs_id", [0.3], 6, 3).collect()} == pytest.approx(want, rel=1e-6)
    resampling.jackknife_cost(one, F.col("obs_id") % 3, 3, [0.3])
    assert len(seen) == 3 and all("md5" not in e._jdf.queryExecution().optimizedPlan().toString() and e.rdd.getNumPartitions() > 1 for e in seen)
    # more tries than are fused, and a fit without a row
    rows = spark.range(40).selectExpr("1.0D * id AS x", "2.0D * id + 1 AS y", "1.0D AS err", "cast(id % 2 AS int) AS _k", "cast(1 + id % 3 AS byte) AS _w")
    line = LeastSquares(rows, lambda x, p, m: p[0] * x + p[1], ["a", "b"])
    k, p = np.array([1, 0, 2, 0, 1, 1]), np.array([[1.0, 0.0], [2.0, 1.0], [1.0, 1.0], [2.0, 0.0], [0.0, 0.0], [2.0, 1.5]])
    fused = lockstep.replicate_evaluate(line, rows)(k, p)
    monkeypatch.setattr(lockstep, "COLUMNS", 1)
    tiled = lockstep.replicate_evaluate(line, rows)(k, p)
    x = np.arange(40)
    sums = [((1 + x % 3) * (x % 2 == i) * (2 * x + 1 - a * x - b) ** 2).sum() for i, (a, b) in zip(k, p, strict=True)]
    assert np.allclose(fused[0], sums) and all(np.allclose(a, b) for a, b in zip(fused, tiled, strict=True))
    assert not fused[1][2].any() and np.isnan(lockstep.replicate_evaluate(line, rows.where("false"))(k, p)[0]).all()


def test_sets_beyond_one_job(costs, monkeypatch):
    cost, _ = costs["unbinned"]
    at = np.linspace(0.1, 1, 50)[:, None]
    want = cost.derivatives(at)
    monkeypatch.setattr("lodefit.operators.costs.MOST_SETS", 16)
    assert all(np.allclose(a, b) for a, b in zip(cost.derivatives(at), want, strict=True))


def test_large_groups_in_step(spark, monkeypatch):
    rows = spark.range(900).selectExpr("CASE WHEN id % 9 < 5 THEN 'a' WHEN id % 9 < 8 THEN 'b' END AS k", "0.05D * (id % 50) + 0.1D AS x")
    calls = []
    keyed = lockstep.keyed_evaluate
    monkeypatch.setattr(lockstep, "keyed_evaluate", lambda *a: (lambda f: lambda k, x: calls.append(len(k)) or f(k, x))(keyed(*a)))
    got = {r["k"]: r for r in fit_groups(rows, "k", lambda d: UnbinnedNLL(d, EXP, ["rate"]), [5.0], most_rows=50).collect()}
    want = {r["k"]: (1 / r["m"], r["n"]) for r in rows.groupBy("k").agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()}
    assert set(got) == {"a", "b", None} and len(calls) < 25 and max(calls) >= 3
    for k, (rate, n) in want.items():
        assert got[k]["values"][0] == pytest.approx(rate, rel=1e-6) and got[k]["errors"][0] == pytest.approx(rate / math.sqrt(n), rel=1e-4) and got[k]["valid"]


def test_models_beyond_their_namespace(spark):
    rows = spark.range(20).selectExpr("0.1D * id AS x", "0.2D * id AS y", "0.1D AS err")
    odd = LeastSquares(rows, lambda x, p, m: F.exp(x) * p[0], ["a"])
    assert not lockstep.has_derivatives(odd) and not lockstep.has_derivatives(object()) and issubclass(Counting, Cost)
    assert Fit(odd, [1.0]).mnprofile("a", 3)[2].all()  # one after another


def test_gradients_are_checked_at_the_start():
    f = lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2
    right, wrong = lambda p: [2 * (p[0] - 1), 6 * (p[1] + 2)], lambda p: [2 * (p[0] - 1), -6 * (p[1] + 2)]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fit = Fit(f, {"a": 0.0, "b": 0.0}, gradient=right).migrad()
        Fit(f, {"a": 0.0, "b": 0.0}, gradient=wrong, check_gradient=False).migrad()
    with pytest.warns(UserWarning, match="b: -12, differences 12"):
        Fit(f, {"a": 0.0, "b": 0.0}, gradient=wrong).migrad()
    table = fit.trace(3)
    assert list(table.columns) == ["step", "fval", "edm", "dcovar", "nfcn", "event", "x", "gradient"] and table["event"][0] == "seed"
    assert table["fval"].is_monotonic_decreasing and table["nfcn"].is_monotonic_increasing and table["fval"].iloc[-1] == pytest.approx(fit.fval)
    assert list(fit.trace().columns) == ["step", "fval", "edm", "dcovar", "nfcn"] and len(fit.trace(0)) == 0


def test_modes_without_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=2) * 0.1 + (5 if i < 40 else 0)]) for i in range(60)]
    found = modes.find_solution_modes(spark.createDataFrame(rows, "id long, p array<double>"), [1.0, 1.0], radius=1.0).collect()
    assert [r["n_points"] for r in found] == [40, 20] and all(r["fval"] is None for r in found)
    for r, own in zip(found, (range(40), range(40, 60)), strict=True):
        z = np.array([rows[i][1] for i in own])
        assert r["representative"] == rows[own[0] + int(np.sqrt(((z[:, None] - z) ** 2).sum(2)).sum(1).argmin())][1]


def test_dbscan_takes_edges_of_cells(spark, monkeypatch):
    """Crowded rows were linked pair by pair; cells are, with the same result."""
    r = np.random.default_rng(3)
    z = np.concatenate([r.normal(0, 0.4, (250, 2)), r.normal((4, 4), 0.4, (120, 2)), r.uniform(-3, 8, (60, 2))])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(z)] + [(900, [None, 0.0]), (901, [float("nan"), 0.0]), (902, None), (903, [1e12, 0.0])]
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) <= 0.5
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(len(z)), len(z))
    while True:
        new = np.where(core, np.where(near & core, label, len(z)).min(1), len(z))
        if (new == label).all():
            break
        label = new
    label = np.where(core, label, np.where(near & core, label, len(z)).min(1))
    sizes = sorted((-int((label == v).sum()), int(v)) for v in set(label.tolist()) - {len(z)} if (label == v).sum() >= 4)
    mode = {v: k + 1 for k, (_, v) in enumerate(sizes)}
    edges, whole = [], modes.connected
    monkeypatch.setattr(modes, "connected", lambda n, e: edges.append(e.count()) or whole(n, e))
    got = {x["id"]: x["mode"] for x in modes.dbscan(spark.createDataFrame(rows, "id long, z array<double>"), 0.5, 4, 4).collect()}
    assert got == {**{i: mode.get(int(v), 0) for i, v in enumerate(label)}, **{i: 0 for i in range(900, 904)}}
    assert edges[0] < 2 * len(rows)
