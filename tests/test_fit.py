import math

import numpy as np
import pytest

from lodefit.functions.special import chisq_cl, delta_chisq, p_value
from lodefit.operators import costs, linalg, minimize, regions
from lodefit.operators.costs import BinnedNLL, CostSum, ExtendedUnbinnedNLL, LeastSquares, UnbinnedNLL
from lodefit.operators.ensembles import Target, combine_priors, half_normal_prior, normal_prior, uniform_prior
from lodefit.operators.fit import Fit, MinosError, contour_from_dict, minos_error_from_dict, model_fit, text_plot
from lodefit.operators.groups import fit_groups, fit_restarts
from lodefit.operators.parameters import Parameter, Parameters, Strategy
from lodefit.operators.regions import extremize, linear_interval, profile_band, region_samples


def rosenbrock(p):
    return (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2


def quadratic(p):
    return (p[0] - 1) ** 2 + (p[1] - 2) ** 2


@pytest.mark.parametrize(("cl", "ndof", "want"), [(0.68, 1, 0.98895), (0.68, 2, 2.27887), (0.95, 2, 5.99146), (0.68, 3, 3.50588), (2, 2, 6.18007), (3, 1, 9.0)])
def test_delta_chisq(cl, ndof, want):
    assert delta_chisq(cl, ndof) == pytest.approx(want, abs=1e-4)
    assert chisq_cl(delta_chisq(0.9, ndof), ndof) == pytest.approx(0.9, abs=1e-12)


def test_p_value():
    assert p_value(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert math.isnan(p_value(1.0, 0))


@pytest.mark.parametrize("level", [0, 1, 2])
def test_migrad_quadratic(level):
    f = Fit(lambda p: float((p**2).sum()), [1.0] * 4, errors=[0.1] * 4, strategy=level).migrad()
    assert f.valid and f.fval < 1e-8
    np.testing.assert_allclose(f.covariance, np.eye(4), atol=1e-4)


@pytest.mark.parametrize("level", [1, 2])
def test_migrad_rosenbrock(level):
    f = Fit(rosenbrock, [-1.2, 1.0], errors=[0.1, 0.1], strategy=level, tol=1e-4).migrad()
    assert f.valid
    np.testing.assert_allclose(f.values, [1, 1], atol=5e-3)
    np.testing.assert_allclose(f.hesse().errors, [1.0, 2.0], rtol=2e-2)


@pytest.mark.parametrize(
    ("centre", "limits", "want"),
    [(-1.0, (None, 5.0), -1.0), (3.0, (1.0, None), 3.0), (0.5, (0.0, 1.0), 0.5), (3.0, (None, 2.0), 2.0)],
)
def test_limits(centre, limits, want):
    f = Fit(lambda p: (p[0] - centre) ** 2 + p[1] ** 2, [0.3 if limits[0] is not None and limits[0] < 0.3 else 1.5, 1.0], limits={0: limits}, tol=1e-3).migrad()
    assert f.values[0] == pytest.approx(want, abs=2e-2)
    assert (limits[0] is None or f.values[0] >= limits[0]) and (limits[1] is None or f.values[0] <= limits[1])


def test_fixed_and_views():
    f = Fit(quadratic, {"x": 0.0, "y": 5.0}, fixed=["y"]).migrad()
    assert f.values == pytest.approx([1, 5], abs=1e-3) and f.covariance[1, 1] == 0 and f.nfit == 1
    assert f.release("y").migrad().values[1] == pytest.approx(2, abs=1e-3)
    assert f.set_limits("x", 0, 0.5).migrad().values[0] == pytest.approx(0.5, abs=1e-2)
    assert f.remove_limits("x").set_value("x", 3).set_error("x", 0.2).migrad().valid
    assert f.reset().values == pytest.approx([0, 5])


def test_nonfinite_is_invalid():
    assert not Fit(lambda p: float("nan"), [1.0]).migrad().valid
    f = Fit(lambda p: float("nan") if p[0] < 0 else (p[0] - 1) ** 2, [2.0]).migrad()
    assert f.valid and f.values[0] == pytest.approx(1, abs=1e-3)


def test_minos_and_contours():
    f = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad().minos()
    for e in f.merrors.values():
        assert e.is_valid and e.upper == pytest.approx(1, abs=2e-3) and e.lower == pytest.approx(-1, abs=2e-3)
        assert minos_error_from_dict(e.to_dict()) == e and isinstance(e, MinosError)
    for points, r in ((f.contour_exact("x", "y", 12), 1.0), (f.mncontour("x", "y", 0.68, 8), math.sqrt(delta_chisq(0.68, 2))), (f.contour_ellipse("x", "y", 10), 1.0)):
        np.testing.assert_allclose(np.hypot(points[:, 0] - f.values[0], points[:, 1] - f.values[1]), r, atol=5e-3)
    assert "*" in text_plot(points)


def test_contour_that_is_not_convex():
    """Points lie on the level set all around, in even gaps, where rays from the middle of a gap lead inwards too."""
    f = Fit(lambda p: (p[0] ** 2 + p[1] ** 2 + (p[0] ** 2 - p[1] ** 2) ** 2), {"x": 0.05, "y": -0.05}, errordef=4.0).migrad().hesse()
    c = f.contour_exact("x", "y", 24)
    assert len(c) == 24
    for x, y in c:
        assert x**2 + y**2 + (x**2 - y**2) ** 2 == pytest.approx(4.0, abs=0.02) and 1.0 < math.hypot(x, y) < 2.5
    turn = np.unwrap(np.arctan2(c[:, 1], c[:, 0]))
    assert (np.diff(turn) > 0).all() and turn[-1] - turn[0] < 2 * math.pi
    banana = Fit(rosenbrock, [-1.2, 1.0], errors=[0.1, 0.1]).migrad().hesse()
    c = banana.contour_exact(0, 1, 20)
    assert len(c) >= 4 and np.allclose([rosenbrock(x) for x in c], banana.fval + 1, atol=0.02)
    full = Fit(lambda p: float((p**2).sum()), [0.1, 0.1, 0.1]).migrad().hesse().contour_exact(0, 1, 8, full=True)
    assert full.shape == (8, 3) and np.allclose((full**2).sum(1), 1, atol=5e-3)


def test_minos_tells_of_a_deeper_minimum():
    f = Fit(lambda p: (p[0] ** 2 - 1) ** 2 + 0.4 * p[0], [0.95], errors=[0.1], errordef=2.0).migrad()
    assert f.values[0] > 0
    f.minos()
    e = f.merrors["x0"]
    assert e.new_min and e.lower_new_min and not e.upper_new_min and f.deeper[0] < 0
    assert minos_error_from_dict(e.to_dict()) == e
    g = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad().minos()
    assert not g.merrors["x"].new_min and g.deeper is None and g.merrors["x"].upper_state[0] == pytest.approx(2, abs=5e-3)


def test_hessian_gradient():
    f = minimize.Objective(minimize.scalar(lambda p: math.exp(p[0]) + (p[1] - 3) ** 4 + 1e3), 1.0)
    x = np.array([0.3, 1.0])
    want = np.array([math.exp(0.3), -32.0])
    for level in (0, 1, 2):
        g, step, unsure = minimize.hessian_gradient(f, x, f.one(x), want * 1.3, np.array([1.3, 48.0]), np.array([0.5, 0.5]), Strategy(level))
        assert (np.abs(g - want) <= np.maximum(unsure, 1e-3 * np.abs(want))).all() and (step > 0).all()


def test_matrices_that_are_singular():
    assert linalg.global_cc([[1.0, 1.0], [1.0, 1.0]]).tolist() == [0.0, 0.0]
    near = [[1.0, 1 - 1e-8], [1 - 1e-8, 1.0]]
    assert linalg.make_posdef(near)[1] and not linalg.is_posdef_enough(near) and not linalg.make_posdef([[1.0, 0.99], [0.99, 1.0]])[1]


def test_linear_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=50)
    rows = [(float(a), float(1e6 + 3 * a + e), 0.1) for a, e in zip(x, rng.normal(size=50) * 0.1)]
    df = spark.createDataFrame(rows, "x double, y double, err double")
    line = costs.LinearLeastSquares(df, [lambda x, m: x, lambda x, m: 1.0, lambda x, m: m.exp(-x)], ["a", "b", "c"])
    plain = costs.LeastSquares(df, line.model, ["a", "b", "c"])
    thetas = line.form()[1] + rng.normal(size=(60, 3)) * 0.1
    np.testing.assert_allclose(line.evaluate(thetas), plain.evaluate(thetas), rtol=1e-7)
    np.testing.assert_allclose(line.local()(thetas), plain.local()(thetas), rtol=1e-7)
    with pytest.raises(ValueError):
        costs.LinearLeastSquares(df.limit(0), [lambda x, m: x], ["a"]).form()


def test_region_of_given_draws():
    f = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad().hesse()
    draws = np.array([[1.0, 2.0], [1.5, 2.5], [9.0, 9.0]])
    assert len(regions.region_samples(f, 0.68, draws=draws)["p"]) == 2


def test_minos_at_a_limit():
    f = Fit(lambda p: (p[0] - 0.1) ** 2, {"x": 0.5}, limits={"x": (0.0, 5.0)}).migrad().minos()
    assert f.merrors["x"].lower_limit and f.merrors["x"].lower_valid and not f.merrors["x"].upper_limit


def test_scan_profile_grid():
    f = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad()
    assert len(f.scan("x")) == 42 and len(f.scan("x", low=1, high=0)) == 1
    xs, v = f.profile("x", 21, subtract_min=True)
    assert v.min() == 0 and len(xs) == 21
    xs, v, ok = f.mnprofile("x", 5)
    np.testing.assert_allclose(v, (xs - 1) ** 2, atol=1e-3)
    assert ok.all() and f.contour_grid("x", "y", 7, subtract_min=True)[2].shape == (7, 7)
    g = Fit(quadratic, {"x": 0.0, "y": 0.0}, limits={"x": (-2.0, 4.0), "y": (-2.0, 4.0)}).scan_minimize(13)
    assert g.values == pytest.approx([1, 2]) and g.covariance is None


@pytest.mark.parametrize("method", ["bfgs", "lbfgs", "cg", "newton", "neldermead"])
def test_other_minimizers(method):
    f = Fit(rosenbrock, [-1.2, 1.0]).optim(method)
    np.testing.assert_allclose(f.values, [1, 1], atol=1e-2)


def test_simplex_and_deeper_minimum():
    assert Fit(quadratic, [0.0, 0.0]).simplex().values == pytest.approx([1, 2], abs=0.05)
    two = Fit(lambda p: (p[0] ** 2 - 1) ** 2 + 0.2 * p[0], [0.9], errors=[0.3]).migrad()
    assert two.values[0] > 0 and two.find_deeper_minimum(jitters=12, spread=6).values[0] < 0


def test_linalg():
    m = np.array([[4.0, 1.0], [1.0, 9.0]])
    assert linalg.global_cc(m) == pytest.approx([1 / 6, 1 / 6])
    assert linalg.squeeze_error(m, 1)[0, 0] == pytest.approx(4 - 1 / 9)
    fixed, changed = linalg.make_posdef([[1.0, 2.0], [2.0, 1.0]])
    assert changed and linalg.is_posdef_enough(fixed)
    assert not linalg.make_posdef(m)[1] and linalg.eigenvalues(m)[0] < linalg.eigenvalues(m)[1]


def test_parameters():
    p = Parameters((Parameter("a", 1.0), Parameter("b", 2.0, fixed=True), Parameter("c", 0.5, lower=0.0, upper=1.0)))
    assert p.free == [0, 2] and p.ext_index(1) == 2 and p.n_pars == 3
    v = p.internal(p.values())
    np.testing.assert_allclose(p.external(v)[0], p.values(), atol=1e-12)
    for q in (Parameter("l", 2.0, lower=1.0), Parameter("u", -2.0, upper=1.0), Parameter("m", 0.3, lower=0.0, upper=1.0)):
        i = q.to_internal(q.value)
        assert q.to_external(i) == pytest.approx(q.value)
        assert q.slope(i) == pytest.approx((q.to_external(i + 1e-6) - q.to_external(i - 1e-6)) / 2e-6, rel=1e-5)
    with pytest.raises(ValueError):
        Parameters((Parameter("a", 1.0), Parameter("a", 2.0)))
    with pytest.raises(ValueError):
        Strategy(3)


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(float(x), y, 0.1) for x, y in zip(range(5), (1.1, 2.9, 5.2, 6.8, 9.1))], "x double, y double, err double")


def test_costs_agree(spark, points):
    line = LeastSquares(points, lambda x, p, m: p[0] * x + p[1], ["a", "b"])
    thetas = np.array([[2.0, 1.0], [1.5, 0.2]] + [[k / 10, 1.0] for k in range(40)])
    want = [sum(((y - a * x - b) / 0.1) ** 2 for x, y in zip(range(5), (1.1, 2.9, 5.2, 6.8, 9.1))) for a, b in thetas]
    np.testing.assert_allclose(line.evaluate(thetas), want)
    np.testing.assert_allclose(line.evaluate(thetas[:2]), want[:2])
    np.testing.assert_allclose(line.local()(thetas), want)
    sample = [0.3, 1.2, 0.7, 2.5, 0.1]
    xs = spark.createDataFrame([(v,) for v in sample], "x double")
    nll = UnbinnedNLL(xs, lambda x, p, m: p[0] * m.exp(-p[0] * x), ["r"])
    f = Fit(nll, {"r": 0.5}, limits={"r": (1e-6, None)}, local=True, strategy=2, tol=1e-4).migrad()
    assert f.values[0] == pytest.approx(len(sample) / sum(sample), rel=1e-3)
    assert f.errors[0] == pytest.approx(f.values[0] / math.sqrt(len(sample)), rel=2e-2)
    ext = ExtendedUnbinnedNLL(xs, lambda x, p, m: p[1] * p[0] * m.exp(-p[0] * x), lambda t: t[1], ["r", "n"])
    g = Fit(ext, {"r": 0.5, "n": 3.0}, limits={"r": (1e-6, None), "n": (1e-6, None)}, local=True, tol=1e-4).migrad()
    assert g.values == pytest.approx([len(sample) / sum(sample), 5], rel=5e-3)
    both = line + nll
    assert isinstance(both, CostSum) and both.names == ("a", "b", "r")
    assert both(2.0, 1.0, 0.8) == pytest.approx(line(2.0, 1.0) + nll(0.8) / 0.5)
    h = spark.createDataFrame([(0.0, 1.0, 3.0), (1.0, 2.0, 0.0), (2.0, 3.0, 2.0)], "lo double, hi double, n double")
    b = BinnedNLL(h, lambda x, p, m: 1 - m.exp(-p[0] * x), ["r"])
    q = np.array([math.exp(-0.5 * lo) - math.exp(-0.5 * (lo + 1)) for lo in range(3)])
    mu = 5 * q / q.sum()
    assert b(0.5) == pytest.approx(sum(n * math.log(n / m) for n, m in zip((3, 0, 2), mu) if n))


def test_spark_fit(points):
    line = LeastSquares(points, lambda x, p, m: p[0] * x + p[1], ["a", "b"])
    f = Fit(line, {"a": 1.0, "b": 0.0}, errors=[0.1, 0.1], strategy=0).migrad()
    assert f.values == pytest.approx([1.99, 1.04], abs=5e-3)
    chi2, ndf, p = f.goodness(5)
    assert ndf == 3 and 0 < p < 1


def test_regions_and_derived():
    f = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad().hesse()
    r = region_samples(f, 0.68, 4000)
    assert (r["delta"] <= r["threshold"]).all() and r["upper"][0] - 1 == pytest.approx(math.sqrt(r["threshold"]), rel=0.1)
    lo, hi = linear_interval(4.0, [2.0, 1.0], f.covariance)
    e = extremize(f, lambda p: 2 * p[0] + p[1], mode="full", seeds=3)
    assert e["lower"] == pytest.approx(lo, abs=2e-2) and e["upper"] == pytest.approx(hi, abs=2e-2)
    band = profile_band(f, lambda p, x: p[0] * x + p[1], [0.0, 1.0])
    assert all(b["lower"] <= b["best"] <= b["upper"] for b in band)


def test_two_corridors():
    f = Fit(lambda p: 200 * (p[0] ** 2 - 1) ** 2 + (p[1] - p[0]) ** 2, {"a": 0.9, "b": 0.9}).migrad().hesse()
    e = extremize(f, lambda p: p[0], cl=1)
    assert e["upper"] == pytest.approx(math.sqrt(1 + 1 / math.sqrt(200)), abs=5e-3)


def test_priors():
    assert normal_prior("a", 0, 1).log(0) == pytest.approx(-0.5 * math.log(2 * math.pi))
    assert uniform_prior("a", 0, 2).log(3) == -math.inf and half_normal_prior("a", 1).log(-1) == -math.inf
    with pytest.raises(ValueError):
        combine_priors(normal_prior("a", 0, 1), uniform_prior("a", 0, 1))
    with pytest.raises(ValueError):
        Target(lambda t: t[:, 0], 1.0, ["a"], [(2.0, None)], [uniform_prior("a", 0, 1)])


def test_hesse_of_a_flat_direction():
    _, status, _ = minimize.hesse(minimize.Objective(minimize.scalar(lambda p: p[0] ** 2)), [0.0, 0.0], errors=[0.1, 0.1])
    assert status != minimize.VALID


def test_views_are_writable():
    f = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad()
    f.values, f.errors = [3.0, 4.0], [0.5, 0.5]
    assert f.minimum is None and f.values.tolist() == [3.0, 4.0] and f.errors.tolist() == [0.5, 0.5]
    f.limits, f.fixed = [(0.0, 5.0), (None, None)], [False, True]
    assert f.migrad().values == pytest.approx([1, 4], abs=1e-2) and f.limits[0] == (0.0, 5.0)
    with pytest.raises(ValueError):
        f.values = [1.0]


def test_prior_covariance_and_contour_record():
    plain = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad()
    prior = Fit(quadratic, {"x": 0.0, "y": 0.0}).migrad(prior_covariance=np.eye(2))
    assert prior.valid and prior.values == pytest.approx([1, 2], abs=1e-3) and prior.nfcn <= plain.nfcn
    c = plain.hesse().contour("x", "y", 8)
    assert c.is_valid and contour_from_dict(c.to_dict()) == c and len(c.points) == 8 and plain.find_global_minimum(jitters=2).valid


def test_model_fit(spark):
    rows = spark.range(30).selectExpr("0.1D * id AS x", "0.2D * id + 1 + 0.1D * (id % 3 - 1) AS y", "0.1D AS err")
    f = model_fit(rows, lambda x, p, m: p[0] * x + p[1], {"a": 1.0, "b": 0.0}, local=True).migrad()
    chi2, ndf, p = f.goodness()
    assert f.values == pytest.approx([2, 1], abs=0.1) and ndf == 28 and 0 < p < 1 and chi2 == pytest.approx(20, abs=1)
    again = model_fit(rows, lambda x, p, m: p[0] * x + p[1], f, local=True).migrad()
    assert again.values == pytest.approx(f.values, abs=1e-3)


def test_groups_too_large_for_a_worker(spark):
    rows = spark.range(600).selectExpr("CASE WHEN id < 500 THEN 'hot' WHEN id < 590 THEN 'b' END AS k", "0.05D * (id % 50) + 0.1D AS x")
    make = lambda d: UnbinnedNLL(d, lambda x, p, m: p[0] * m.exp(-p[0] * x), ["rate"])
    a = {r["k"]: r for r in fit_groups(rows, "k", make, [0.5], {"rate": (1e-6, None)}).collect()}
    b = {r["k"]: r for r in fit_groups(rows, "k", make, [0.5], {"rate": (1e-6, None)}, most_rows=100).collect()}
    assert set(a) == set(b) == {"hot", "b", None}
    assert all(b[k]["values"][0] == pytest.approx(a[k]["values"][0], rel=1e-4) and b[k]["valid"] for k in a)


def test_restarts(spark):
    rows = spark.range(40).selectExpr("0.1D * id AS x", "sin(0.3D * id) AS y", "0.1D AS err")
    wave = LeastSquares(rows, lambda x, p, m: m.sin(p[0] * x), ["w"])
    found = fit_restarts(spark, wave, [[9.0], [2.8], [5.0]])
    assert found[0][1][0] == pytest.approx(3.0, abs=1e-2) and found[0][0] <= found[1][0] <= found[2][0]


@pytest.mark.parametrize("start", [(6, -3), (6, -2.999999999), (5, -2), (4, 4), (-3, -3), (0, 8), (-5, 2)])
def test_simplex_hops_between_passes(start):
    """Where no gradient settles, as at a crease, a simplex closes in on the minimum from wherever it begins."""
    f = lambda p: abs(p[0] - 1) + 3 * abs(p[1] - 2) + abs(p[0] * p[1] - 2)
    plain, hopped = (Fit(f, list(map(float, start)), errors=[0.5, 0.5]).migrad(hops=h) for h in (False, True))
    assert hopped.valid and hopped.fval < 1e-3 and hopped.values == pytest.approx([1, 2], abs=1e-3)
    assert plain.valid or hopped.fval <= plain.fval


def test_html_and_records():
    f = Fit(lambda p: (p[0] - 1) ** 2 + (p[1] - 2) ** 2 + 0.5 * p[0] * p[1], {"x": 0.0, "y": 0.0}).migrad().hesse()
    page = f._repr_html_()
    assert "&#10003; valid" in page and "rgb(" in page and page.count("<table>") == 2
    d = f.minimum.to_dict()
    assert d["valid"] and d["fval"] == f.fval and np.allclose(d["covariance"], f.covariance)
