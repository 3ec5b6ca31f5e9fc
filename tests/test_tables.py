import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefit.functions.probes import argument_names, gradient_agrees, is_deterministic
from lodefit.operators import costs, ensembles, linear, modes, resampling
from lodefit.operators.costs import LeastSquares
from lodefit.operators.fit import Fit, minimum_summary_from_dict, minos_to_latex
from lodefit.sources import tables
from lodefit.streaming.moments import running_lines


def test_points(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1, "a"), (2, 3.0, 0.1, "b")], "q int, r double, s double, t string")
    assert tables.points(df).columns == ["x", "y", "err"] and tables.points(df, "r", "q", "s").first()["x"] == 2.0
    for bad in ((1.0, float("nan"), 0.1), (None, 1.0, 0.1), (1.0, 1.0, 0.0), (1.0, float("inf"), 1.0)):
        with pytest.raises(ValueError):
            tables.points(spark.createDataFrame([bad], "x double, y double, err double"))
    assert tables.concat(df, df).count() == 4
    by_id = df.withColumnRenamed("q", "obs_id")
    assert tables.gather(by_id, spark.createDataFrame([(1,), (1,), (2,)], "obs_id int")).count() == 3
    assert tables.fit_range(by_id, 2, 9).count() == 1
    rows, dropped = tables.finite_only(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"), "v")
    assert rows.count() == 1
    assert tables.model_curve(df, "r", lambda x, p, m: p[0] * x, [2.0], 5).orderBy("i").collect()[-1]["y"] == 6.0


def test_histogram(spark):
    h = tables.histogram(spark.createDataFrame([(0.5,), (0.7,), (3.1,), (None,)], "v double"), "v", 1.0)
    assert [(r["bin"], r["n"]) for r in h.orderBy("bin").collect()] == [(0, 2.0), (1, 0.0), (2, 0.0), (3, 1.0)]
    assert tables.histogram(spark.createDataFrame([], "v double"), "v", 1.0).count() == 0


def test_ensemble_text(spark, tmp_path):
    e = spark.createDataFrame([(1.5, [1.0, 2.0]), (2.5, [3.0, -4e-9])], "fval double, p array<double>")
    tables.save_ensemble(e, str(tmp_path / "e"), ["a", "b"], 0.5)
    back, names, up = tables.load_ensemble(spark, str(tmp_path / "e"))
    assert names == ["a", "b"] and up == 0.5 and sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    assert tables.load_ensemble(spark, str(tmp_path / "e"), ["x", "y"], 1.0)[1:] == (["x", "y"], 1.0)
    with pytest.raises(ValueError):
        tables.save_ensemble(e, str(tmp_path / "f"), ["a b", "c"])
    (tmp_path / "g").write_text("1 2 3\n1 2\n")
    with pytest.raises(ValueError):
        tables.load_ensemble(spark, str(tmp_path / "g"))


def line_rows(spark, n=200):
    rng = np.random.default_rng(0)
    x = np.linspace(0, 5, n)
    z = rng.standard_normal(n)
    z = (z - z.mean()) / z.std()
    return spark.createDataFrame([(i, float(a), float(2 * a + 1 + 0.3 * b)) for i, (a, b) in enumerate(zip(x, z))], "obs_id long, x double, y double")


def test_resampling(spark):
    df = line_rows(spark)
    fitted = linear.line_fit(df, F.col("x"), F.col("y"), 0.3).first()
    assert fitted["slope"] == pytest.approx(2, abs=0.1) and fitted["ndf"] == 198
    closed = resampling.bootstrap_line(df, "obs_id", F.col("x"), F.col("y"), 60, 1)
    spread = closed.agg(F.stddev_samp("slope")).first()[0]
    assert spread == pytest.approx(fitted["slope_err"], rel=0.5)

    def refit(pdf):
        if pdf["rep"].iloc[0] == 3:
            raise RuntimeError
        b, a = np.polyfit(pdf["x"], pdf["y"], 1, w=np.sqrt(pdf["w"]))
        return [b, a]

    reps = resampling.bootstrap(df, "obs_id", refit, 20, 1).cache()
    assert reps.where("not valid").count() == 1
    same = {r["rep"]: r["slope"] for r in closed.collect()}
    for r in reps.where("valid").collect():
        assert r["p"][0] == pytest.approx(same[r["rep"]], rel=1e-6)
    s = {r["name"]: r for r in resampling.summary(reps, ["slope", "intercept"]).collect()}
    assert s["slope"]["n"] == 19 and s["slope"]["lower"] < s["slope"]["mean"] < s["slope"]["upper"]
    c = {(r["a"], r["b"]): r["corr"] for r in resampling.correlation(reps, ["slope", "intercept"]).collect()}
    assert c["slope", "slope"] == 1 and c["slope", "intercept"] < -0.5
    j = resampling.jackknife_line(df, F.col("x"), F.col("y")).first()
    assert j["variance"] ** 0.5 == pytest.approx(fitted["slope_err"], rel=0.3)
    with pytest.raises(ValueError):
        resampling.jackknife_line(df.limit(2), F.col("x"), F.col("y"))


def test_sampling(spark):
    target = ensembles.Target(lambda t: ((t - [1.0, -2.0]) ** 2 / [0.04, 0.09]).sum(1), 1.0, ["a", "b"], [(None, None)] * 2)
    cov = np.diag([0.04, 0.09])
    for sampler, steps in (("stretch", 800), ("metropolis", 6000), ("hmc", 600)):
        e = ensembles.sample(spark, target, [1.0, -2.0], cov, 2, sampler, steps, steps // 4, 2, seed=3).cache()
        s = {r["name"]: r for r in ensembles.posterior_summary(e, ["a", "b"]).collect()}
        assert s["a"]["mean"] == pytest.approx(1, abs=0.06) and s["b"]["std"] == pytest.approx(0.3, rel=0.25)
    low, high, n = ensembles.credible_interval(e, F.col("p")[0]).first()
    assert low < 1 < high and ensembles.upper_limit(e, F.col("p")[0]).first()["limit"] > high > low > ensembles.lower_limit(e, F.col("p")[0]).first()["limit"]
    assert ensembles.split_rhat(e.withColumn("v", F.col("p")[0]), "chain", "iter", "v").first()["rhat"] < 1.3
    with pytest.raises(ValueError):
        ensembles.credible_interval(e, F.col("p")[0], 2)


def test_modes(spark):
    k = np.arange(60)
    angle, r = k * 2.399963, 0.1 * np.sqrt(k / 60)
    rows = [(int(i), [float(c + r[i % 60] * np.cos(angle[i % 60])), float(r[i % 60] * np.sin(angle[i % 60]))], float(c + r[i % 60])) for c in (0, 3) for i in k + 60 * (c > 0)]
    df = spark.createDataFrame([*rows, (999, [50.0, 50.0], 9.0)], "id long, p array<double>, fval double")
    for method in ("linkage", "dbscan"):
        found = modes.find_solution_modes(df, [0.1, 0.1], radius=1.0, min_size=5, how="errors", fmin=0.0, method=method, refit=lambda p: (p, -1.0)).collect()
        assert [r["n_points"] for r in found] == [60, 60] and all(r["new_min"] for r in found)
        assert {round(r["representative"][0]) for r in found} == {0, 3}


def test_probes(spark):
    df = line_rows(spark).withColumn("err", F.lit(0.3))
    cost = LeastSquares(df, lambda x, p, m: p[0] * x + p[1], ["a", "b"])
    assert is_deterministic(cost, [2.0, 1.0]) and argument_names(lambda x, y: 0) == ["x", "y"]
    assert gradient_agrees(lambda p: p[0] ** 2, lambda p: [2 * p[0]], [3.0]) and not gradient_agrees(lambda p: p[0] ** 2, lambda p: [p[0]], [3.0])
    f = Fit(cost, {"a": 1.0, "b": 0.0}, local=True).migrad().minos()
    assert f.migrad(warm=True).valid and f.checks()["valid"] and "pm" in f.to_latex()
    assert f.result(spark).first()["valid"] and minimum_summary_from_dict(f.to_dict())["fval"] == f.fval and "fval" in f.to_json() and "<table>" in f._repr_html_()
    e = f.minos("a").merrors["a"]
    assert "^{+" in minos_to_latex(e) and isinstance(f.strong_correlations(0.1), list)


def test_stream(spark, tmp_path):
    df = line_rows(spark).withColumn("k", F.lit("g")).select("k", "x", "y")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running_lines(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "lines_of_g", str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = linear.line_fit(df, F.col("x"), F.col("y")).first()
    assert spark.table("lines_of_g").first()["slope"] == pytest.approx(want["slope"])


def test_costs_resampled(spark):
    df = line_rows(spark, 60).withColumn("err", F.lit(0.3))
    cost = LeastSquares(df, lambda x, p, m: p[0] * x + p[1], ["a", "b"])
    fit = Fit(cost, {"a": 1.0, "b": 0.0}, local=True).migrad().hesse()
    for noise in (False, True):
        s = {r["name"]: r for r in resampling.summary(resampling.bootstrap_cost(cost, "obs_id", fit.values, 30, 2, noise=noise), ["a", "b"]).collect()}
        assert s["a"]["std"] == pytest.approx(fit.errors[0], rel=0.6)
    with pytest.raises(ValueError):
        resampling.bootstrap_cost(cost + cost, "obs_id", [0, 0])
    reps = resampling.jackknife(df, F.col("obs_id") % 10, 10, lambda pdf: np.polyfit(pdf["x"], pdf["y"], 1))
    j = {r["name"]: r for r in resampling.jackknife_summary(reps, fit.values, ["a", "b"]).collect()}
    assert j["a"]["error"] == pytest.approx(fit.errors[0], rel=0.8)
    e, summary = ensembles.bayesian(spark, fit, [ensembles.normal_prior("a", 2.0, 10.0)], chains=2, steps=400, burn=100, thin=2)
    got = {r["name"]: r for r in summary.collect()}
    assert got["a"]["mean"] == pytest.approx(fit.values[0], abs=4 * fit.errors[0]) and e.select("chain").distinct().count() == 2
    assert ensembles.mcmc_sample(spark, fit, chains=1, steps=300, burn=100, thin=4).count() == 50
    target, _ = ensembles.target_of(fit)
    assert ensembles.is_consistent(fit, target)
    t, ok, _ = fit.cross({"a": 1.0})
    assert ok and t == pytest.approx(fit.minos("a").merrors["a"].upper, rel=1e-2)
    assert len(fit.mnmatrix(4, 4)) == 3


def test_deeper_by_resampling(spark):
    fit = Fit(lambda p: (p[0] ** 2 - 1) ** 2 + 0.2 * p[0], {"x": 0.9}).migrad()
    reps = spark.createDataFrame([(i, [(1.0 if i % 2 else -1.0) + i / 1000], True) for i in range(20)] + [(99, [], False)], "rep int, p array<double>, valid boolean")
    assert modes.find_deeper_by_resampling(fit, reps, radius=1.0).values[0] < 0


@pytest.mark.parametrize("sampler", ["metropolis", "stretch"])
def test_chains_over_rows_that_do_not_fit(spark, monkeypatch, sampler):
    """Beyond the bound on collected rows the chains take their steps together, over sums in Spark; with a closed-form target over seeds."""

    df = spark.range(40).selectExpr("0.1 * id AS x", "0.2 * id + 1 + 0.1 * (id % 3) AS y", "0.1D AS err")
    cost = costs.LinearLeastSquares(df, [lambda x, m: x, lambda x, m: 1.0], ["a", "b"])
    fit = Fit(cost, [1.0, 1.0]).migrad().hesse()
    monkeypatch.setattr(type(cost), "local", lambda self: (_ for _ in ()).throw(costs.TooManyRows("many")))
    target, _ = ensembles.target_of(fit)
    assert target.in_spark
    got = ensembles.mcmc_sample(spark, fit, sampler, chains=6, steps=1500, burn=300, seed=2).toPandas()
    p = np.array(got["p"].tolist())
    sd = np.sqrt(np.diag(fit.covariance))
    assert np.allclose(p.mean(0), fit.values, atol=0.25 * sd.max()) and np.allclose(p.std(0), sd, rtol=0.15)
    np.testing.assert_allclose(cost.evaluate(p[:5]), got["fval"][:5])
    with pytest.raises(ValueError):
        ensembles.mcmc_sample(spark, fit, "hmc")
    plain = costs.LeastSquares(df, cost.model, ["a", "b"])
    monkeypatch.setattr(costs, "LOCAL_ROWS", 10)
    assert ensembles.target_of(Fit(plain, fit.values))[0].in_spark


def test_no_u_turns(spark):
    """Means, deviations and the correlation of a Gaussian, and a bounded one, over seeds."""
    cov = np.array([[0.04, 0.03], [0.03, 0.09]])
    inverse, mean = np.linalg.inv(cov), np.array([1.0, -2.0])
    target = ensembles.Target(lambda t: np.einsum("ij,jk,ik->i", t - mean, inverse, t - mean), 1.0, ["a", "b"], [(None, None)] * 2)
    p = np.array(ensembles.sample(spark, target, mean, np.diag([0.02, 0.2]), 4, "nuts", 1200, 300, 1, 3).toPandas()["p"].tolist())
    assert np.allclose(p.mean(0), mean, atol=0.03) and np.allclose(np.cov(p.T), cov, atol=0.01)
    half = ensembles.Target(lambda t: t[:, 0] ** 2, 1.0, ["a"], [(0.0, None)])
    q = np.array(ensembles.sample(spark, half, [0.5], [[1.0]], 4, "nuts", 1500, 400, 1, 5).toPandas()["p"].tolist())
    assert (q >= 0).all() and q.mean() == pytest.approx(np.sqrt(2 / np.pi), abs=0.06)


def test_numbers_in_order(spark):
    df = spark.range(500).selectExpr("id AS label", "id % 7 AS size").repartition(9)
    got = {r["label"]: r["number"] for r in modes.numbered(df, F.desc("size"), F.col("label")).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)), 1)}
    assert modes.numbered(df.limit(0), F.col("label")).count() == 0


def test_rows_in_order(spark):
    df = spark.range(20).selectExpr("19 - id AS obs_id", "id AS x").repartition(3)
    assert [r["x"] for r in tables.in_order(df)] == list(range(19, -1, -1))
