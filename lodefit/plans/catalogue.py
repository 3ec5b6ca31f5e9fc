"""The registered queries and their DuckDB equivalents.

Results are rounded to significant digits on both sides, since sums over
partitions have no fixed order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefit.functions.columns import normal, poisson1_sql, sig, sig_sql, uniform, uniform_sql
from lodefit.functions.special import delta_chisq
from lodefit.operators import costs, ensembles, linalg, linear, minimize, modes, regions, resampling
from lodefit.operators.fit import Fit
from lodefit.operators.groups import fit_groups
from lodefit.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Parameters of the fixed-theta queries.
A, B, ERR, RATE, N0 = 1500.0, 100.0, 1000.0, 0.02, 9000.0
TINY = "2.2250738585072014e-308::DOUBLE"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _round(df: DataFrame, digits: int = 6, keep=()) -> DataFrame:
    return df.select(*[sig(F.col(c), digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _line(spark, sf):
    return _table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.lit(ERR).alias("err"), "l_returnflag", "l_orderkey")


def _values(spark, sf):
    return _table(spark, sf, "events").where("value > 0").select("event_id", "event_type", F.col("value").alias("x"))


LINE = "(SELECT l_quantity AS x, l_extendedprice AS y, 1000.0::DOUBLE AS err, l_returnflag, l_orderkey FROM lineitem)"
VALUES = "(SELECT event_id, event_type, value AS x FROM events WHERE value > 0)"
MODEL_LINE = lambda x, p, m: p[0] * x + p[1]
MODEL_EXP = lambda x, p, m: p[0] * m.exp(-p[0] * x)
MODEL_DENSITY = lambda x, p, m: p[1] * p[0] * m.exp(-p[0] * x)
CDF_EXP = lambda x, p, m: 1 - m.exp(-p[0] * x)
CDF_SCALED = lambda x, p, m: p[1] * (1 - m.exp(-p[0] * x))


def _value(spark, cost, theta, name: str) -> DataFrame:
    return _round(spark.createDataFrame([(float(cost(*theta)),)], f"{name} double"), 9)


# ---- objectives --------------------------------------------------------------------------

CHISQ = f"SELECT {{}} AS chisq FROM {LINE} WHERE {{}}"
_D2 = f"sum(pow((y - ({A} * x + {B})) / err, 2))"


@query(CHISQ.format(sig_sql(_D2), "true"))
def chisq_line(spark, sf):
    return _value(spark, costs.LeastSquares(_line(spark, sf), MODEL_LINE, ["a", "b"]), (A, B), "chisq")


@query(CHISQ.format(sig_sql(_D2), "l_returnflag = 'R'"))
def chisq_line_masked(spark, sf):
    return _value(spark, costs.LeastSquares(_line(spark, sf), MODEL_LINE, ["a", "b"], F.col("l_returnflag") == "R"), (A, B), "chisq")


@query(CHISQ.format(sig_sql(_D2), "l_orderkey BETWEEN 100 AND 5000"))
def chisq_line_fitrange(spark, sf):
    rows = tables.fit_range(_line(spark, sf).withColumnRenamed("l_orderkey", "obs_id"), 100, 5000)
    return _value(spark, costs.LeastSquares(rows, MODEL_LINE, ["a", "b"]), (A, B), "chisq")


@query(f"SELECT {sig_sql('sum(CASE WHEN l_discount > 0 THEN pow((l_extendedprice - 1500.0 * l_quantity) / (l_discount * 10000.0), 2) END)')} AS chi2 FROM lineitem")
def chi2_skip_nonpositive(spark, sf):
    t = _table(spark, sf, "lineitem")
    return _round(t.agg(costs.chi2(F.col("l_extendedprice"), F.col("l_discount") * 10000.0, 1500.0 * F.col("l_quantity")).alias("chi2")), 9)


HIST = "(SELECT p_size, count(*)::DOUBLE AS n, 40.0::DOUBLE AS mu FROM part GROUP BY p_size)"


@query(f"SELECT {sig_sql('2 * sum(mu - n + n * ln(n / mu))')} AS chi2 FROM {HIST}")
def poisson_chi2_hist(spark, sf):
    h = _table(spark, sf, "part").groupBy("p_size").agg(F.count("*").cast("double").alias("n"))
    return _round(h.agg(costs.poisson_chi2(F.col("n"), F.lit(40.0)).alias("chi2")), 9)


@query(f"SELECT {sig_sql('2 * sum(n * ln(n / mu))')} AS chi2 FROM {HIST}")
def multinomial_chi2_hist(spark, sf):
    h = _table(spark, sf, "part").groupBy("p_size").agg(F.count("*").cast("double").alias("n"))
    return _round(h.agg(costs.multinomial_chi2(F.col("n"), F.lit(40.0)).alias("chi2")), 9)


_NLL = f"-sum(ln(greatest({RATE} * exp(-{RATE} * x), {TINY})))"


@query(f"SELECT {sig_sql(_NLL)} AS nll FROM {VALUES}")
def unbinned_exp_nll(spark, sf):
    return _value(spark, costs.UnbinnedNLL(_values(spark, sf), MODEL_EXP, ["rate"]), (RATE,), "nll")


@query(f"SELECT {sig_sql(f'{N0} - sum(ln(greatest({N0} * {RATE} * exp(-{RATE} * x), {TINY})))')} AS nll FROM {VALUES}")
def extended_exp_nll(spark, sf):
    return _value(spark, costs.ExtendedUnbinnedNLL(_values(spark, sf), MODEL_DENSITY, lambda t: t[1], ["rate", "n"]), (RATE, N0), "nll")


BINS = f"""h AS (SELECT CAST(floor(x / 10.0) AS INT) AS bin, count(*)::DOUBLE AS c FROM {VALUES} GROUP BY 1),
 e AS (SELECT unnest(generate_series((SELECT min(bin) FROM h), (SELECT max(bin) FROM h))) AS bin),
 b AS (SELECT e.bin, e.bin * 10.0::DOUBLE AS lo, (e.bin + 1) * 10.0::DOUBLE AS hi, coalesce(c, 0.0) AS n FROM e LEFT JOIN h USING (bin)),
 q AS (SELECT n, greatest((1 - exp(-{RATE} * hi)) - (1 - exp(-{RATE} * lo)), {TINY}) AS p FROM b)"""


@query(f"WITH {BINS}, t AS (SELECT sum(n) AS tn, sum(p) AS tp FROM q) SELECT {sig_sql('sum(CASE WHEN n > 0 THEN n * ln(n / (tn * p / tp)) ELSE 0 END)')} AS nll FROM q, t")
def binned_exp_nll(spark, sf):
    return _value(spark, costs.BinnedNLL(tables.histogram(_values(spark, sf), "x", 10.0), CDF_EXP, ["rate"]), (RATE,), "nll")


@query(f"WITH {BINS} SELECT {sig_sql(f'sum({N0} * p - n + CASE WHEN n > 0 THEN n * ln(n / ({N0} * p)) ELSE 0 END)')} AS nll FROM q")
def extended_binned_exp_nll(spark, sf):
    return _value(spark, costs.ExtendedBinnedNLL(tables.histogram(_values(spark, sf), "x", 10.0), CDF_SCALED, ["rate", "n"]), (RATE, N0), "nll")


@query(f"SELECT {sig_sql(f'(SELECT {_D2} FROM {LINE}) + (SELECT {_NLL} FROM {VALUES}) / 0.5')} AS cost")
def cost_sum_line_exp(spark, sf):
    total = costs.LeastSquares(_line(spark, sf), MODEL_LINE, ["a", "b"]) + costs.UnbinnedNLL(_values(spark, sf), MODEL_EXP, ["rate"])
    return _value(spark, total, (A, B, RATE), "cost")


@query(f"SELECT CAST(k AS INT) AS theta_id, {sig_sql(f'sum(pow((y - ((1400 + k * 5.0) * x + {B})) / err, 2))')} AS chisq FROM {LINE}, (SELECT unnest(range(0, 40)) AS k) GROUP BY k")
def theta_batch_line(spark, sf):
    """Forty parameter sets in one job."""
    cost = costs.LeastSquares(_line(spark, sf), MODEL_LINE, ["a", "b"])
    found = cost.evaluate(np.array([(1400 + k * 5.0, B) for k in range(40)]))
    return _round(spark.createDataFrame(list(enumerate(map(float, found))), "theta_id int, chisq double"), 9)


# ---- closed-form fits --------------------------------------------------------------------

MOMENTS = "count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS cxy"
FITTED = f"(SELECT n, mx, vx, vy, cxy, cxy / vx AS slope, my - cxy / vx * mx AS intercept FROM (SELECT {MOMENTS} FROM {LINE}))"


@query(f"""SELECT l_returnflag, n, {sig_sql('cxy / vx', 6)} AS slope, {sig_sql('my - cxy / vx * mx', 6)} AS intercept,
 {sig_sql('sqrt(1e6 / (n * vx))', 6)} AS slope_err, {sig_sql('sqrt(1e6 / n * (1 + mx * mx / vx))', 6)} AS intercept_err,
 {sig_sql('-1e6 * mx / (n * vx)', 6)} AS cov, {sig_sql('n * (vy - cxy / vx * cxy) / 1e6', 6)} AS chi2, n - 2 AS ndf
 FROM (SELECT l_returnflag, {MOMENTS} FROM {LINE} GROUP BY l_returnflag)""")
def line_fit_by_flag(spark, sf):
    return _round(linear.line_fit(_line(spark, sf), F.col("x"), F.col("y"), ERR, ["l_returnflag"]))


@query(f"SELECT {sig_sql('n * (vy - slope * cxy) / 1e6 / (n - 2)', 6)} AS reduced_chi2, n - 2 AS ndf FROM {FITTED}")
def line_fit_goodness(spark, sf):
    f = _linear_fit(spark, sf)
    chi2, ndf, _ = f.goodness(f.cost.form()[3])
    return _round(spark.createDataFrame([(float(chi2 / ndf), int(ndf))], "reduced_chi2 double, ndf long"))


SEGMENTS = "(SELECT c_nationkey AS k, count(*)::DOUBLE AS n FROM customer GROUP BY 1)"


@query(f"""WITH s AS (SELECT avg(n) AS mu, count(*) AS bins FROM {SEGMENTS}), c AS (SELECT sum(pow(n - mu, 2) / mu) AS chi2, any_value(bins) - 1 AS ndf FROM {SEGMENTS}, s)
 SELECT {sig_sql('chi2', 6)} AS chi2, ndf, {sig_sql('(SELECT sum(exp(-chi2 / 2 + k * ln(chi2 / 2) - lgamma(k + 1))) FROM (SELECT unnest(range(0, 12)) AS k))', 6)} AS p FROM c""")
def uniform_pvalue(spark, sf):
    """Whether customers are spread evenly over 25 nations: for an even number of degrees of freedom the p-value is a sum of Poisson terms."""
    h = _table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("y"))
    mu = h.agg(F.avg("y")).collect()[0][0]
    cost = costs.LinearLeastSquares(h.select(F.lit(0.0).alias("x"), "y", F.lit(math.sqrt(mu)).alias("err")), [lambda x, m: 1.0], ["mu"])
    chi2, ndf, p = Fit(cost, [mu], errors=[1.0]).migrad().goodness(cost.form()[3])
    return _round(spark.createDataFrame([(float(chi2), int(ndf), float(p))], "chi2 double, ndf long, p double"))


@query(f"SELECT event_type, n, {sig_sql('1 / m', 6)} AS rate, {sig_sql('1 / m / sqrt(n)', 6)} AS rate_err, {sig_sql('n * (1 + ln(m))', 6)} AS nll FROM (SELECT event_type, count(*) AS n, avg(x) AS m FROM {VALUES} GROUP BY 1)")
def exp_mle_by_type(spark, sf):
    return _round(linear.exponential_mle(_values(spark, sf), F.col("x"), ["event_type"]))


@query(f"SELECT event_type, {sig_sql('1 / avg(x)', 3)} AS rate, {sig_sql('1 / avg(x) / sqrt(count(*))', 2)} AS rate_err, true AS valid FROM {VALUES} GROUP BY 1")
def migrad_exp_by_type(spark, sf):
    """The same by a minimizer in each group."""
    found = fit_groups(_values(spark, sf), "event_type", lambda d: costs.UnbinnedNLL(d, MODEL_EXP, ["rate"]), [0.015], {"rate": (1e-6, None)}, strategy=2)
    return found.select("event_type", sig(F.col("values")[0], 3).alias("rate"), sig(F.col("errors")[0], 2).alias("rate_err"), "valid")


@query(f"SELECT c_mktsegment, n, {sig_sql('mu', 6)} AS mu, {sig_sql('sigma', 6)} AS sigma, {sig_sql('sigma / sqrt(n)', 6)} AS mu_err, {sig_sql('sigma / sqrt(2 * n)', 6)} AS sigma_err FROM (SELECT c_mktsegment, count(c_acctbal) AS n, avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sigma FROM customer GROUP BY 1)")
def gauss_mle_by_segment(spark, sf):
    return _round(linear.gaussian_mle(_table(spark, sf, "customer"), F.col("c_acctbal"), ["c_mktsegment"]))


@query(f"SELECT count(*) AS n, {sig_sql('count(*) / sum(o_totalprice)', 6)} AS rate FROM orders WHERE o_totalprice > 0")
def extended_exp_mle(spark, sf):
    return _round(linear.exponential_mle(_table(spark, sf, "orders"), F.col("o_totalprice")).select("n", "rate"))


@query(f"SELECT lang, count(*) AS n, {sig_sql('avg(toxic)', 6)} AS p, {sig_sql('sqrt(avg(toxic) * (1 - avg(toxic)) / count(*))', 6)} AS p_err FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL GROUP BY lang")
def bernoulli_mle(spark, sf):
    d = _table(spark, sf, "labels").join(_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return _round(linear.bernoulli_mle(d, F.col("toxic"), ["lang"]))


# ---- scans, profiles, contours -----------------------------------------------------------

SCAN = f"SELECT CAST(k AS INT) AS k, 0.005 + k * 0.001 AS rate, count(*) * -ln(0.005 + k * 0.001) + (0.005 + k * 0.001) * sum(x) AS nll FROM {VALUES}, (SELECT unnest(range(0, 41)) AS k) GROUP BY k"


def _scan(spark, sf):
    cost = costs.UnbinnedNLL(_values(spark, sf), MODEL_EXP, ["rate"])
    found = Fit(cost, {"rate": RATE}).scan("rate", 41, 0.005, 0.045)[1:]  # the centre comes first
    return spark.createDataFrame([(k, float(r), float(v)) for k, (r, v) in enumerate(found)], "k int, rate double, nll double")


@query(f"SELECT k, {sig_sql('rate', 9)} AS rate, {sig_sql('nll', 9)} AS nll FROM ({SCAN})")
def nll_scan_exp(spark, sf):
    return _round(_scan(spark, sf), 9)


@query(f"SELECT {sig_sql('min_by(rate, nll)', 9)} AS rate, {sig_sql('min(nll)', 9)} AS nll FROM ({SCAN})")
def scan_best(spark, sf):
    return _round(_scan(spark, sf).agg(F.min_by("rate", "nll").alias("rate"), F.min("nll").alias("nll")), 9)


GRID = "(SELECT CAST(unnest(range(0, 21)) AS INT) AS i), (SELECT CAST(unnest(range(0, 21)) AS INT) AS j)"


@query(f"""WITH g AS (SELECT i, j, n * (pow((i - 10) * 20.0 + (j - 10) * 2.0 * mx, 2) + pow((j - 10) * 2.0, 2) * vx) / 1e6 AS f FROM {FITTED}, {GRID})
 SELECT i, j, round(sqrt(f - min(f) OVER ()), 2) AS pull FROM g""")
def contour_grid_line(spark, sf):
    """A slice on a 21 by 21 grid about the minimum."""
    f = _linear_fit(spark, sf)
    a, b = f.values
    z = f.contour_grid("b", "a", 21, subtract_min=True, bounds=((b - 200.0, b + 200.0), (a - 20.0, a + 20.0)))[2]
    return spark.createDataFrame([(i, j, round(math.sqrt(float(z[i, j])), 2)) for i in range(21) for j in range(21)], "i int, j int, pull double")


@query(f"SELECT k, {sig_sql('slope + (k - 15) * 0.5', 5)} AS slope, {sig_sql('intercept - (k - 15) * 0.5 * mx', 5)} AS intercept, {sig_sql('round(n * pow((k - 15) * 0.5, 2) * vx / 1e6, 4)', 4)} AS rise FROM {FITTED}, (SELECT CAST(unnest(range(0, 31)) AS INT) AS k)")
def mnprofile_line(spark, sf):
    """The intercept is fitted anew at each slope."""
    f = _linear_fit(spark, sf)
    xs, v, _, states = f.profile_states("a", 31, (float(f.values[0]) - 7.5, float(f.values[0]) + 7.5))
    rows = [(k, float(x), float(s[1]), float(r)) for k, (x, s, r) in enumerate(zip(xs, states, v - v.min(), strict=True))]
    d = spark.createDataFrame(rows, "k int, slope double, intercept double, rise double")
    return d.select("k", sig(F.col("slope"), 5).alias("slope"), sig(F.col("intercept"), 5).alias("intercept"), sig(F.round("rise", 4), 4).alias("rise"))


_C2 = f"(SELECT slope, intercept, 1e6 / (n * vx) AS c00, -1e6 * mx / (n * vx) AS c01, 1e6 / n * (1 + mx * mx / vx) AS c11 FROM {FITTED})"


def _line_covariance(spark, sf):
    f = linear.line_fit(_line(spark, sf), F.col("x"), F.col("y"), ERR)
    return f.select("slope", "intercept", (F.col("slope_err") ** 2).alias("c00"), F.col("cov").alias("c01"), (F.col("intercept_err") ** 2).alias("c11"))


@query(f"SELECT k, {sig_sql('slope + sqrt(c00) * cos(2 * pi() * k / 20)', 6)} AS x, {sig_sql('intercept + sqrt(c11) * (c01 / sqrt(c00 * c11) * cos(2 * pi() * k / 20) + sqrt(1 - c01 * c01 / (c00 * c11)) * sin(2 * pi() * k / 20))', 6)} AS y FROM {_C2}, (SELECT CAST(unnest(range(0, 20)) AS INT) AS k)")
def contour_ellipse_line(spark, sf):
    points = _linear_fit(spark, sf).contour_ellipse("a", "b", 20)
    return _round(spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "k int, x double, y double"))


def _fit_line(spark, sf, **options) -> Fit:
    """A Spark-side fit of few jobs: the start is the closed form, so what is left is the errors."""
    f = linear.line_fit(_line(spark, sf), F.col("x"), F.col("y"), ERR).collect()[0]
    return Fit(costs.LeastSquares(_line(spark, sf), MODEL_LINE, ["a", "b"]), [f["slope"], f["intercept"]], errors=[f["slope_err"], f["intercept_err"]], **options).set_precision(1e-13)


def _linear_fit(spark, sf) -> Fit:
    """A line whose sums are two aggregates, from a start that is off; every profile after it costs no job."""
    cost = costs.LinearLeastSquares(_line(spark, sf), [lambda x, m: x, lambda x, m: 1.0], ["a", "b"])
    normal, best, _, _ = cost.form()
    errors = np.sqrt(np.diag(np.linalg.inv(normal)))
    return Fit(cost, best + [errors[0], 0.0], errors=errors, strategy=2, tol=1e-6).migrad().hesse()


@query(f"SELECT 'a' AS name, {sig_sql('sqrt(c00)', 3)} AS upper, {sig_sql('-sqrt(c00)', 3)} AS lower FROM {_C2} UNION ALL SELECT 'b', {sig_sql('sqrt(c11)', 3)}, {sig_sql('-sqrt(c11)', 3)} FROM {_C2}")
def minos_line(spark, sf):
    """Profile errors of a quadratic objective are its parabolic ones."""
    f = _linear_fit(spark, sf).minos()
    return spark.createDataFrame([(n, x.upper, x.lower) for n, x in f.merrors.items()], "name string, upper double, lower double").select("name", sig(F.col("upper"), 3).alias("upper"), sig(F.col("lower"), 3).alias("lower"))


@query(f"SELECT 'a' AS name, {sig_sql('slope', 4)} AS value, {sig_sql('sqrt(c00)', 3)} AS error FROM {_C2} UNION ALL SELECT 'b', {sig_sql('round(intercept)', 2)}, {sig_sql('sqrt(c11)', 3)} FROM {_C2}")
def hesse_line(spark, sf):
    """Errors of a least-squares sum that stays in Spark: every batch of parameter sets is one job."""
    f = _fit_line(spark, sf).hesse()
    rows = [(n, float(v if n == "a" else round(v)), float(e), 4 if n == "a" else 2) for n, v, e in zip(f.names, f.values, f.errors, strict=True)]
    d = spark.createDataFrame(rows, "name string, value double, error double, digits int")
    return d.select("name", F.when(F.col("digits") == 4, sig(F.col("value"), 4)).otherwise(sig(F.col("value"), 2)).alias("value"), sig(F.col("error"), 3).alias("error"))


@query("SELECT 'x1' AS name, 1.0::DOUBLE AS value UNION ALL SELECT 'x2', 1.0::DOUBLE")
def migrad_rosenbrock(spark, sf):
    f = Fit(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, {"x1": -1.2, "x2": 1.0}, errors=[0.1, 0.1], strategy=2, tol=1e-9).migrad()
    return spark.createDataFrame([(n, float(round(v, 5))) for n, v in zip(f.names, f.values, strict=True)], "name string, value double")


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)")
def hesse_quad(spark, sf):
    c = Fit(lambda p: float((p**2).sum()), [1.0] * 4, errors=[0.1] * 4).migrad().hesse().covariance
    return spark.createDataFrame([(i, j, abs(float(round(c[i, j], 8)))) for i in range(4) for j in range(4)], "i int, j int, v double")


@query("SELECT 'x' AS name, 1.0::DOUBLE AS value UNION ALL SELECT 'y', 2.0::DOUBLE")
def simplex_quad(spark, sf):
    f = Fit(lambda p: (p[0] - 1) ** 2 + (p[1] - 2) ** 2, {"x": 0.0, "y": 0.0}, tol=1e-8).simplex()
    return spark.createDataFrame([(n, float(round(v, 4))) for n, v in zip(f.names, f.values, strict=True)], "name string, value double")


# ---- matrices ----------------------------------------------------------------------------


@query(f"SELECT {sig_sql('(c00 + c11) / 2 - sqrt(pow((c00 - c11) / 2, 2) + c01 * c01)', 5)} AS low, {sig_sql('(c00 + c11) / 2 + sqrt(pow((c00 - c11) / 2, 2) + c01 * c01)', 6)} AS high FROM {_C2}")
def eigen_2x2(spark, sf):
    low, high = linalg.eigenvalues(_covariance_matrix(spark, sf))
    return spark.createDataFrame([(float(low), float(high))], "low double, high double").select(sig(F.col("low"), 5).alias("low"), sig(F.col("high"), 6).alias("high"))


def _covariance_matrix(spark, sf) -> np.ndarray:
    c = _line_covariance(spark, sf).collect()[0]
    return np.array([[c["c00"], c["c01"]], [c["c01"], c["c11"]]])


@query(f"SELECT {sig_sql('abs(c01) / sqrt(c00 * c11)', 6)} AS rho FROM {_C2}")
def global_cc_2x2(spark, sf):
    """Of two parameters the global correlation is the absolute one."""
    return _round(spark.createDataFrame([(float(linalg.global_cc(_covariance_matrix(spark, sf))[1]),)], "rho double"))


@query(f"SELECT {sig_sql('corr(y, x)', 6)} AS xy, {sig_sql('corr(l_discount, x)', 4)} AS xd FROM (SELECT l_quantity AS x, l_extendedprice AS y, l_discount FROM lineitem)")
def corr_matrix_line(spark, sf):
    reps = _table(spark, sf, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount").alias("p"), F.lit(True).alias("valid"))
    c = resampling.correlation(reps, ["x", "y", "d"]).where("a = 'x'")
    pick = lambda b, digits: sig(F.max(F.when(F.col("b") == b, F.col("corr"))), digits)
    return c.agg(pick("y", 6).alias("xy"), pick("d", 4).alias("xd"))


# ---- resampling --------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT event_type, sum(x) AS s, count(*) AS n, avg(x) AS m FROM {VALUES} GROUP BY 1), l AS (SELECT event_type, n, m, (s - x) / (n - 1) AS t FROM {VALUES} JOIN t USING (event_type))
 SELECT event_type, any_value(n) AS n, {sig_sql('any_value(m)', 6)} AS mean, {sig_sql('(any_value(n) - 1) * var_pop(t)', 5)} AS variance FROM l GROUP BY 1""")
def jackknife_mean(spark, sf):
    return resampling.jackknife_mean(_values(spark, sf), F.col("x"), ["event_type"]).select("event_type", "n", sig(F.col("mean"), 6).alias("mean"), sig(F.col("variance"), 5).alias("variance"))


@query(f"""WITH s AS (SELECT event_id // 50 AS b, sum(x) AS s, count(*) AS c FROM {VALUES} GROUP BY 1), t AS (SELECT sum(s) AS ts, sum(c) AS tc FROM s), l AS (SELECT (ts - s) / (tc - c) AS t, ts / tc AS m FROM s, t)
 SELECT count(*) AS groups, {sig_sql('any_value(m)', 6)} AS mean, {sig_sql('(count(*) - 1) * var_pop(t)', 5)} AS variance FROM l""")
def jackknife_block_mean(spark, sf):
    return resampling.jackknife_blocks(_values(spark, sf), F.floor(F.col("event_id") / 50), F.col("x")).select("groups", sig(F.col("mean"), 6).alias("mean"), sig(F.col("variance"), 5).alias("variance"))


SUP = "(SELECT s_suppkey::DOUBLE AS x, s_acctbal AS y FROM supplier)"


@query(f"""WITH t AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM {SUP}),
 l AS (SELECT n, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, ((n - 1) * (sxy - x * y) - (sx - x) * (sy - y)) / ((n - 1) * (sxx - x * x) - (sx - x) * (sx - x)) AS t FROM {SUP}, t)
 SELECT any_value(n) AS n, {sig_sql('any_value(b)', 6)} AS slope, {sig_sql('(any_value(n) - 1) * var_pop(t)', 5)} AS variance FROM l""")
def jackknife_line(spark, sf):
    return resampling.jackknife_line(_table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_acctbal")).select("n", sig(F.col("slope"), 6).alias("slope"), sig(F.col("variance"), 5).alias("variance"))


REPS = f"(SELECT event_id, x, rep, {uniform_sql('7', 'event_id', 'rep')} AS u FROM {VALUES}, (SELECT unnest(range(0, 20)) AS rep))"


@query(f"WITH w AS (SELECT rep, x, ({poisson1_sql('u')})::DOUBLE AS w FROM {REPS}), m AS (SELECT rep, sum(w * x) / sum(w) AS v FROM w GROUP BY rep) SELECT {sig_sql('avg(v)', 6)} AS mean, {sig_sql('stddev_samp(v)', 5)} AS std, {sig_sql('quantile_cont(v, 0.16)', 6)} AS lower, {sig_sql('quantile_cont(v, 0.84)', 6)} AS upper FROM m")
def bootstrap_mean(spark, sf):
    r = resampling.bootstrap_mean(_values(spark, sf), "event_id", F.col("x"), 20, 7)
    return r.agg(sig(F.avg("value"), 6).alias("mean"), sig(F.stddev_samp("value"), 5).alias("std"), sig(F.percentile("value", F.lit(0.16)), 6).alias("lower"), sig(F.percentile("value", F.lit(0.84)), 6).alias("upper"))


# ---- exact derivatives and fits in step --------------------------------------------------

#: A curve that isn't linear in its parameters: y = a exp(-b x), and where its derivatives are taken.
MODEL_CURVE = lambda x, p, m: p[0] * m.exp(-p[1] * x)
CURVE_A, CURVE_B = 20000.0, -0.02


@query(f"""WITH d AS (SELECT (y - {CURVE_A} * e) / err AS d, -e / err AS da, {CURVE_A} * x * e / err AS db FROM (SELECT *, exp(-({CURVE_B}) * x) AS e FROM {LINE}))
 SELECT {sig_sql('sum(d * d)')} AS chisq, {sig_sql('2 * sum(d * da)')} AS g_a, {sig_sql('2 * sum(d * db)')} AS g_b,
 {sig_sql('2 * sum(da * da)')} AS c_aa, {sig_sql('2 * sum(da * db)')} AS c_ab, {sig_sql('2 * sum(db * db)')} AS c_bb FROM d""")
def gradient_curve(spark, sf):
    """Value, gradient and Gauss-Newton curvature of a non-linear least squares, from dual numbers, in one aggregate."""
    f, g, c = costs.LeastSquares(_line(spark, sf), MODEL_CURVE, ["a", "b"]).derivatives([[CURVE_A, CURVE_B]])
    row = (float(f[0]), float(g[0, 0]), float(g[0, 1]), float(c[0, 0, 0]), float(c[0, 0, 1]), float(c[0, 1, 1]))
    return _round(spark.createDataFrame([row], "chisq double, g_a double, g_b double, c_aa double, c_ab double, c_bb double"), 9)


_BIN_SLOPES = f"""{BINS}, s AS (SELECT n, p, hi * exp(-{RATE} * hi) - lo * exp(-{RATE} * lo) AS dp FROM (SELECT n, lo, hi, greatest((1 - exp(-{RATE} * hi)) - (1 - exp(-{RATE} * lo)), {TINY}) AS p FROM b)),
 u AS (SELECT sum(1 / {RATE} - x) AS score, sum(pow(1 / {RATE} - x, 2)) AS square FROM {VALUES})"""


@query(f"""WITH {_BIN_SLOPES}
 SELECT 'binned' AS cost, {sig_sql('sum(n) * sum(dp) / sum(p) - sum(n * dp / p)', 7)} AS slope, {sig_sql('sum(n * pow(dp / p, 2)) - pow(sum(n * dp / p), 2) / sum(n)', 7)} AS curvature FROM s
 UNION ALL SELECT 'extended binned', {sig_sql(f'sum({N0} * dp - n * dp / p)', 7)}, {sig_sql(f'sum({N0} * dp * dp / p)', 7)} FROM s
 UNION ALL SELECT 'extended unbinned', {sig_sql('-score', 7)}, {sig_sql('square', 7)} FROM u
 UNION ALL SELECT 'unbinned', {sig_sql('-score', 7)}, {sig_sql('square', 7)} FROM u""")
def gradient_likelihoods(spark, sf):
    """The derivative by the rate, and the curvature, of each kind of likelihood."""
    v, h = _values(spark, sf), tables.histogram(_values(spark, sf), "x", 10.0)
    kinds = {
        "binned": (costs.BinnedNLL(h, CDF_EXP, ["rate"]), [RATE]),
        "extended binned": (costs.ExtendedBinnedNLL(h, CDF_SCALED, ["rate", "n"]), [RATE, N0]),
        "extended unbinned": (costs.ExtendedUnbinnedNLL(v, MODEL_DENSITY, lambda t: t[1], ["rate", "n"]), [RATE, N0]),
        "unbinned": (costs.UnbinnedNLL(v, MODEL_EXP, ["rate"]), [RATE]),
    }
    found = {k: cost.derivatives([t]) for k, (cost, t) in kinds.items()}
    rows = [(k, float(g[0, 0]), float(c[0, 0, 0])) for k, (_, g, c) in found.items()]
    return _round(spark.createDataFrame(rows, "cost string, slope double, curvature double"), 7)


@query(f"""WITH k AS (SELECT CAST(unnest(range(0, 9)) AS INT) AS k), e AS (SELECT k, y, err, exp(-(-0.024 + 0.002 * k) * x) AS e FROM {LINE}, k),
 a AS (SELECT k, sum(y * e / err / err) / sum(e * e / err / err) AS a FROM e GROUP BY k)
 SELECT k, {sig_sql('any_value(a)', 6)} AS a, {sig_sql('sum(pow((y - a * e) / err, 2))', 8)} AS chisq, true AS valid FROM e JOIN a USING (k) GROUP BY k""")
def mnprofile_curve(spark, sf):
    """A profile of a model that isn't linear: at nine decay rates the amplitude is fitted anew, all in step."""
    fit = Fit(costs.LeastSquares(_line(spark, sf), MODEL_CURVE, ["a", "b"]), [CURVE_A, CURVE_B])
    _, f, ok, states = fit.profile_states("b", 9, (-0.024, -0.008))
    rows = [(k, float(x[0]), float(v), bool(o)) for k, (x, v, o) in enumerate(zip(states, f, ok, strict=True))]
    d = spark.createDataFrame(rows, "k int, a double, chisq double, valid boolean")
    return d.select("k", sig(F.col("a"), 6).alias("a"), sig(F.col("chisq"), 8).alias("chisq"), "valid")


@query(f"WITH w AS (SELECT rep, x, ({poisson1_sql('u')})::DOUBLE AS w FROM {REPS}) SELECT CAST(rep AS INT) AS rep, {sig_sql('sum(w) / sum(w * x)', 6)} AS rate, true AS valid FROM w GROUP BY rep")
def bootstrap_cost_exp(spark, sf):
    """Twenty replicates of a likelihood, fitted in step over weighted sums."""
    cost = costs.UnbinnedNLL(_values(spark, sf), MODEL_EXP, ["rate"])
    found = resampling.bootstrap_cost(cost, "event_id", [0.015], 20, 7, limits={"rate": (1e-6, None)})
    return found.select("rep", sig(F.col("p")[0], 6).alias("rate"), "valid")


@query(f"""WITH b AS (SELECT CAST(event_id % 10 AS INT) AS rep, count(*) AS n, sum(x) AS s FROM {VALUES} GROUP BY 1)
 SELECT rep, {sig_sql('(sum(n) OVER () - n) / (sum(s) OVER () - s)', 6)} AS rate, true AS valid FROM b""")
def jackknife_cost_exp(spark, sf):
    """The same likelihood with each of ten blocks left out, in step."""
    cost = costs.UnbinnedNLL(_values(spark, sf), MODEL_EXP, ["rate"])
    found = resampling.jackknife_cost(cost, F.col("event_id") % 10, 10, [0.015], {"rate": (1e-6, None)})
    return found.select("rep", sig(F.col("p")[0], 6).alias("rate"), "valid")


@query(f"SELECT event_type, {sig_sql('1 / avg(x)', 6)} AS rate, {sig_sql('1 / avg(x) / sqrt(count(*))', 4)} AS rate_err, true AS valid FROM {VALUES} GROUP BY 1")
def lockstep_exp_by_type(spark, sf):
    """Groups beyond a worker, here all of them: one aggregate by key for each step of all fits."""
    found = fit_groups(_values(spark, sf), "event_type", lambda d: costs.UnbinnedNLL(d, MODEL_EXP, ["rate"]), [0.015], {"rate": (1e-6, None)}, most_rows=0)
    return found.select("event_type", sig(F.col("values")[0], 6).alias("rate"), sig(F.col("errors")[0], 4).alias("rate_err"), "valid")


CUST = "(SELECT c_custkey, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer)"


@query(f"""WITH w AS (SELECT rep, x, y, ({poisson1_sql('u')})::DOUBLE AS w FROM (SELECT *, {uniform_sql('3', 'c_custkey', 'rep')} AS u FROM {CUST}, (SELECT unnest(range(0, 20)) AS rep))),
 s AS (SELECT rep, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY rep)
 SELECT CAST(rep AS INT) AS rep, {sig_sql('(sw * sxy - sx * sy) / (sw * sxx - sx * sx)', 5)} AS slope FROM s""")
def bootstrap_line(spark, sf):
    return resampling.bootstrap_line(_table(spark, sf, "customer"), "c_custkey", F.col("c_nationkey"), F.col("c_acctbal"), 20, 3).select("rep", sig(F.col("slope"), 5).alias("slope"))


@query(f"""WITH n AS (SELECT rep, x, 2 * x + 100 * sqrt(-2 * ln(1 - {uniform_sql('5', 'c_custkey', 'rep', "'a'")})) * cos(2 * pi() * {uniform_sql('5', 'c_custkey', 'rep', "'b'")}) AS y FROM {CUST}, (SELECT unnest(range(0, 10)) AS rep))
 SELECT CAST(rep AS INT) AS rep, {sig_sql('covar_pop(y, x) / var_pop(x)', 5)} AS slope FROM n GROUP BY rep""")
def bootstrap_param_line(spark, sf):
    c = _table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"))
    r = resampling.parametric(c, "c_custkey", 2 * F.col("x"), F.lit(100.0), 10, 5)
    return linear.line_fit(r, F.col("x"), F.col("y"), 100.0, ["rep"]).select("rep", sig(F.col("slope"), 5).alias("slope"))


# ---- regions, ensembles, posteriors ------------------------------------------------------

D2 = delta_chisq(0.68, 2)


@query(f"""WITH d AS (SELECT k, 8 * {uniform_sql('11', 'k', "'x'")} - 4 AS u, 8 * {uniform_sql('11', 'k', "'y'")} - 4 AS v FROM (SELECT unnest(range(0, 5000)) AS k)),
 r AS (SELECT u, v, c01 / sqrt(c00 * c11) AS rho FROM d, {_C2}), a AS (SELECT u, v FROM r WHERE (u * u - 2 * rho * u * v + v * v) / (1 - rho * rho) <= {D2!r}::DOUBLE)
 SELECT count(*) AS accepted, {sig_sql('min(u)', 4)} AS lo_u, {sig_sql('max(u)', 4)} AS hi_u, {sig_sql('min(v)', 4)} AS lo_v, {sig_sql('max(v)', 4)} AS hi_v FROM a""")
def mc_region_line(spark, sf):
    """Hashed uniform proposals in units of the errors, kept where the objective rises by at most the joint quantile."""
    f = _linear_fit(spark, sf)
    e = np.sqrt(np.diag(_covariance_matrix(spark, sf)))
    d = spark.range(5000).select((8 * uniform(F.lit(11), F.col("id"), F.lit("x")) - 4).alias("u"), (8 * uniform(F.lit(11), F.col("id"), F.lit("y")) - 4).alias("v"))
    found = regions.region_samples(f, 0.68, draws=f.values + np.array([tuple(r) for r in d.collect()]) * e)
    lo, hi = (found["lower"] - f.values) / e, (found["upper"] - f.values) / e
    return _round(spark.createDataFrame([(len(found["p"]), *map(float, (lo[0], hi[0], lo[1], hi[1])))], "accepted long, lo_u double, hi_u double, lo_v double, hi_v double"), 4)


@query(f"SELECT event_type, count(*) AS n, {sig_sql('quantile_cont(x, 0.16)', 6)} AS q16, {sig_sql('quantile_cont(x, 0.5)', 6)} AS q50, {sig_sql('quantile_cont(x, 0.84)', 6)} AS q84 FROM {VALUES} GROUP BY 1")
def ensemble_quantiles(spark, sf):
    q = ensembles.quantiles(_values(spark, sf), F.col("x"), [0.16, 0.5, 0.84], ["event_type"])
    return q.select("event_type", "n", *[sig(F.col("q")[i], 6).alias(f"q{p}") for i, p in enumerate((16, 50, 84))])


@query(f"SELECT t AS x, {sig_sql('quantile_cont(1000 * exp(-t / x), 0.16)', 5)} AS lower, {sig_sql('quantile_cont(1000 * exp(-t / x), 0.84)', 5)} AS upper FROM {VALUES}, (SELECT unnest([1.0::DOUBLE, 2.0, 5.0]) AS t) GROUP BY t")
def quantile_band_line(spark, sf):
    b = ensembles.quantile_band(_values(spark, sf).withColumnRenamed("x", "tau"), lambda x: 1000 * F.exp(-x / F.col("tau")), [1.0, 2.0, 5.0], [0.16, 0.84])
    return b.select("x", sig(F.col("q")[0], 5).alias("lower"), sig(F.col("q")[1], 5).alias("upper"))


@query(f"SELECT c_mktsegment, {sig_sql('(4000.0 / 1e6 + n * m / v) / (1 / 1e6 + n / v)', 6)} AS mean, {sig_sql('sqrt(1 / (1 / 1e6 + n / v))', 6)} AS std FROM (SELECT c_mktsegment, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1)")
def posterior_gauss_conjugate(spark, sf):
    """A normal prior of mean 4000 and deviation 1000 for each segment's mean."""
    g = linear.gaussian_mle(_table(spark, sf, "customer"), F.col("c_acctbal"), ["c_mktsegment"])
    w, v = F.lit(1 / 1e6), F.col("sigma") ** 2
    return g.select("c_mktsegment", sig((4000.0 * w + F.col("n") * F.col("mu") / v) / (w + F.col("n") / v), 6).alias("mean"), sig(F.sqrt(1 / (w + F.col("n") / v)), 6).alias("std"))


def _sampled(spark, sf, sampler: str, steps: int, burn: int, thin: int) -> DataFrame:
    r = _values(spark, sf).agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()[0]
    n, s = r["n"], r["s"]
    target = ensembles.Target(lambda t: -n * np.log(t[:, 0]) + t[:, 0] * s, 0.5, ["rate"], [(1e-9, None)], [ensembles.uniform_prior("rate", 0.0, 1.0)])
    e = ensembles.sample(spark, target, [n / s], [[(n / s) ** 2 / n]], 4, sampler, steps, burn, thin, 1)
    return ensembles.posterior_summary(e, ["rate"])


@query(f"SELECT 'rate' AS name, {sig_sql('count(*) / sum(x)', 2)} AS mean, {sig_sql('sqrt(count(*)) / sum(x)', 1)} AS std FROM {VALUES}")
def posterior_stretch(spark, sf):
    return _sampled(spark, sf, "stretch", 1500, 300, 2).select("name", sig(F.col("mean"), 2).alias("mean"), sig(F.col("std"), 1).alias("std"))


@query(f"SELECT 'rate' AS name, {sig_sql('count(*) / sum(x)', 2)} AS mean, {sig_sql('sqrt(count(*)) / sum(x)', 1)} AS std FROM {VALUES}")
def mcmc_metropolis(spark, sf):
    return _sampled(spark, sf, "metropolis", 6000, 1000, 2).select("name", sig(F.col("mean"), 2).alias("mean"), sig(F.col("std"), 1).alias("std"))


CHAINS = f"(SELECT event_id % 4 AS c, event_id AS o, x FROM {VALUES})"


@query(f"""WITH k AS (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY o) AS k, count(*) OVER (PARTITION BY c) AS n FROM {CHAINS}),
 h AS (SELECT c, x, CASE WHEN k > n // 2 THEN 1 ELSE 0 END AS h FROM k WHERE k <= n // 2 OR k > n - n // 2), m AS (SELECT c, h, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM h GROUP BY c, h)
 SELECT count(DISTINCT c) AS chains, {sig_sql('sqrt(((min(n) - 1) / min(n) * avg(v) + var_samp(m)) / avg(v))', 6)} AS rhat FROM m""")
def split_rhat(spark, sf):
    d = _values(spark, sf).withColumn("c", F.col("event_id") % 4)
    return ensembles.split_rhat(d, "c", "event_id", "x").select("chains", sig(F.col("rhat"), 6).alias("rhat"))


@query(f"""WITH d AS (SELECT c, o, x - avg(x) OVER (PARTITION BY c) AS d FROM {CHAINS}), l AS (SELECT c, d, lag(d, 1) OVER (PARTITION BY c ORDER BY o) AS l1, lag(d, 2) OVER (PARTITION BY c ORDER BY o) AS l2, lag(d, 5) OVER (PARTITION BY c ORDER BY o) AS l5 FROM d),
 s AS (SELECT c, sum(d * d) AS c0, sum(d * l1) AS s1, sum(d * l2) AS s2, sum(d * l5) AS s5 FROM l GROUP BY c)
 SELECT c, 1 AS lag, {sig_sql('round(s1 / c0, 6)', 6)} AS rho FROM s UNION ALL SELECT c, 2, {sig_sql('round(s2 / c0, 6)', 6)} FROM s UNION ALL SELECT c, 5, {sig_sql('round(s5 / c0, 6)', 6)} FROM s""")
def ess_lag(spark, sf):
    d = _values(spark, sf).withColumn("c", F.col("event_id") % 4)
    return ensembles.autocorrelation(d, "c", "event_id", "x", [1, 2, 5]).select("c", "lag", sig(F.round("rho", 6), 6).alias("rho"))


@query(f"""WITH d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS k, x - avg(x) OVER (PARTITION BY c) AS d, count(*) OVER (PARTITION BY c) AS n FROM {CHAINS}),
 l AS (SELECT a.c, g.lag, sum(a.d * b.d) AS s FROM d a, (SELECT unnest(range(1, 61)) AS lag) g, d b WHERE b.c = a.c AND b.k = a.k + g.lag GROUP BY 1, 2),
 z AS (SELECT c, any_value(n) AS n, sum(d * d) AS c0 FROM d GROUP BY c), r AS (SELECT c, lag, s / c0 AS rho FROM l JOIN z USING (c)), f AS (SELECT c, min(lag) AS first FROM r WHERE rho <= 0 GROUP BY c)
 SELECT CAST(z.c AS VARCHAR) AS chain, z.n, {sig_sql('z.n / (1 + 2 * coalesce((SELECT sum(rho) FROM r WHERE r.c = z.c AND r.lag < f.first), 0))', 6)} AS ess FROM z JOIN f USING (c)""")
def effective_sample_size(spark, sf):
    d = _values(spark, sf).withColumn("c", F.col("event_id") % 4)
    return ensembles.effective_sample_size(d, "c", "event_id", "x").select("chain", "n", sig(F.col("ess"), 6).alias("ess"))


@query(f"WITH s AS (SELECT event_type, x, stddev_samp(x) OVER (PARTITION BY event_type) AS s FROM {VALUES}) SELECT event_type, {sig_sql('avg(CASE WHEN x < 0.5 * s THEN 1.0 ELSE 0.0 END)', 6)} AS near, avg(CASE WHEN x < 0.5 * s THEN 1.0 ELSE 0.0 END) > 0.12 AS flagged FROM s GROUP BY 1")
def boundary_flags(spark, sf):
    return ensembles.boundary_flag(_values(spark, sf), F.col("x"), 0.0, None, key=["event_type"]).select("event_type", sig(F.col("near"), 6).alias("near"), "flagged")


# ---- modes -------------------------------------------------------------------------------

EMB = "(SELECT vec_id AS id, label, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS p FROM embeddings)"


def _cloud(spark, sf):
    e = _table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("p"))


@query(f"WITH m AS (SELECT event_type, median(x) AS m FROM {VALUES} GROUP BY 1) SELECT event_type, count(*) AS n, {sig_sql('any_value(m)', 6)} AS median, {sig_sql('1.4826 * median(abs(x - m))', 6)} AS scale FROM {VALUES} JOIN m USING (event_type) GROUP BY 1")
def mad_scale(spark, sf):
    return _round(modes.mad_scale(_values(spark, sf), F.col("x"), ["event_type"]))


@query(f"SELECT id, {sig_sql('p[1] / 0.1', 6)} AS z0, {sig_sql('p[2] / 0.2', 6)} AS z1 FROM {EMB}")
def whiten_errors(spark, sf):
    z = modes.whiten(_cloud(spark, sf), modes.whitener(None, "errors", errors=[0.1, 0.2]))
    return z.select("id", sig(F.col("z")[0], 6).alias("z0"), sig(F.col("z")[1], 6).alias("z1"))


@query(f"SELECT id, {sig_sql('p[1] / 0.2', 6)} AS z0, {sig_sql('(p[2] - 0.5 * p[1]) / 0.3', 6)} AS z1 FROM {EMB}")
def whiten_cov2(spark, sf):
    """Of a covariance whose Cholesky root is [[0.2, 0], [0.1, 0.3]]."""
    root = np.array([[0.2, 0.0], [0.1, 0.3]])
    z = modes.whiten(_cloud(spark, sf), modes.whitener(None, "cov", root @ root.T))
    return z.select("id", sig(F.col("z")[0], 6).alias("z0"), sig(F.col("z")[1], 6).alias("z1"))


RADIUS = 0.004
NEAR = f"(SELECT a.id AS a, b.id AS b, sqrt(pow(a.p[1] - b.p[1], 2) + pow(a.p[2] - b.p[2], 2)) AS d FROM {EMB} a JOIN {EMB} b ON a.id < b.id AND abs(a.p[1] - b.p[1]) <= {RADIUS} WHERE pow(a.p[1] - b.p[1], 2) + pow(a.p[2] - b.p[2], 2) <= {RADIUS * RADIUS!r})"
REACH = f"""e AS (SELECT a, b FROM {NEAR} UNION ALL SELECT b, a FROM {NEAR}), r AS (SELECT id AS a, id AS b FROM {EMB} UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 l AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a), s AS (SELECT label, count(*) AS n FROM l GROUP BY label)"""


@query(f"WITH RECURSIVE {REACH}, o AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS mode FROM s WHERE n >= 2) SELECT id, CAST(coalesce(mode, 0) AS INT) AS mode FROM l LEFT JOIN o USING (label)")
def single_linkage(spark, sf):
    return modes.single_linkage(_cloud(spark, sf).withColumnRenamed("p", "z").select("id", "z"), RADIUS, 2)


@query(f"WITH m AS (SELECT a.id, min(sqrt(pow(a.p[1] - b.p[1], 2) + pow(a.p[2] - b.p[2], 2))) AS d FROM {EMB} a JOIN {EMB} b ON a.id <> b.id GROUP BY a.id) SELECT count(*) AS n, {sig_sql('median(d)', 6)} AS median, {sig_sql('quantile_cont(d, 0.9)', 6)} AS q90 FROM m")
def nn_distance(spark, sf):
    return _round(modes.nearest_distance(_cloud(spark, sf).withColumnRenamed("p", "z").select("id", "z"), RADIUS))


@query(f"SELECT CAST(label + 1 AS INT) AS mode, {sig_sql('min(p[1] * p[1] + p[2] * p[2])', 6)} AS fval, {sig_sql('min(p[1])', 6)} AS lo0, {sig_sql('max(p[2])', 6)} AS hi1, count(*) AS n_points, {sig_sql('count(*) / (SELECT count(*) FROM embeddings)', 6)} AS fraction FROM {EMB} WHERE label IS NOT NULL GROUP BY label")
def mode_representative(spark, sf):
    c = _cloud(spark, sf).withColumn("fval", F.col("p")[0] * F.col("p")[0] + F.col("p")[1] * F.col("p")[1])
    m = modes.modes(c.drop("label"), c.select("id", (F.col("label") + 1).cast("int").alias("mode")), 0.0)
    return m.select("mode", sig(F.col("fval"), 6).alias("fval"), sig(F.col("ranges")[0]["lo"], 6).alias("lo0"), sig(F.col("ranges")[1]["hi"], 6).alias("hi1"), "n_points", sig(F.col("fraction"), 6).alias("fraction"))


WIDE = NEAR.replace(f"<= {RADIUS * RADIUS!r}", f"<= {(3 * RADIUS) * (3 * RADIUS)!r}").replace(f"<= {RADIUS}", f"<= {3 * RADIUS!r}")


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {WIDE} UNION ALL SELECT b, a FROM {WIDE}), core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) + 1 >= 4),
 i AS (SELECT e.a, e.b FROM e JOIN core x ON x.id = e.a JOIN core y ON y.id = e.b), r AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, i.b FROM r JOIN i ON r.b = i.a),
 l AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a), m AS (SELECT id, label FROM l UNION ALL SELECT e.a, min(l.label) FROM e JOIN l ON l.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a),
 s AS (SELECT label, count(*) AS n FROM m GROUP BY label), o AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS mode FROM s WHERE n >= 4)
 SELECT v.id, CAST(coalesce(mode, 0) AS INT) AS mode FROM {EMB} v LEFT JOIN m ON m.id = v.id LEFT JOIN o ON o.label = m.label""")
def dbscan_modes(spark, sf):
    return modes.dbscan(_cloud(spark, sf).withColumnRenamed("p", "z").select("id", "z"), 3 * RADIUS, 4, 4)


# ---- derived quantities ------------------------------------------------------------------

D1 = delta_chisq(0.68, 1)
_HALF = f"sqrt({D1!r}::DOUBLE * (t * t * c00 + 2 * t * c01 + c11))"


@query(f"SELECT {sig_sql(f'slope * t + intercept - {_HALF}', 6)} AS lower, {sig_sql('slope * t + intercept', 6)} AS best, {sig_sql(f'slope * t + intercept + {_HALF}', 6)} AS upper FROM {_C2}, (SELECT 30.0::DOUBLE AS t)")
def extremize_linear(spark, sf):
    """The extremes of a linear quantity over the region, climbing on its surface, are those of the closed form."""
    found = regions.extremize(_linear_fit(spark, sf), lambda p: 30.0 * p[0] + p[1])
    return _round(spark.createDataFrame([(found["lower"], found["best"], found["upper"])], "lower double, best double, upper double"))


@query(f"SELECT t AS x, {sig_sql(f'slope * t + intercept - {_HALF}', 5)} AS lower, {sig_sql(f'slope * t + intercept + {_HALF}', 5)} AS upper FROM {_C2}, (SELECT unnest(range(0, 51, 5))::DOUBLE AS t)")
def profile_band_linear(spark, sf):
    band = regions.profile_band(_linear_fit(spark, sf), lambda p, x: x * p[0] + p[1], [float(t) for t in range(0, 51, 5)])
    return _round(spark.createDataFrame([(r["x"], r["lower"], r["upper"]) for r in band], "x double, lower double, upper double"), 5, ["x"])


@query(f"SELECT count(*) AS n, {sig_sql('avg(z)', 4)} AS mean, {sig_sql('stddev_pop(z)', 6)} AS std FROM (SELECT sqrt(-2 * ln(1 - {uniform_sql('1', 'event_id', chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform_sql('1', 'event_id', chr(39) + 'b' + chr(39))}) AS z FROM events)")
def hashed_normals(spark, sf):
    z = _table(spark, sf, "events").select(normal(F.lit(1), F.col("event_id")).alias("z"))
    return z.agg(F.count("*").alias("n"), sig(F.avg("z"), 4).alias("mean"), sig(F.stddev_pop("z"), 6).alias("std"))


_MINIMIZERS = ("bfgs", "lbfgs", "cg", "newton", "neldermead")


@query("SELECT unnest(['bfgs', 'cg', 'lbfgs', 'neldermead', 'newton']) AS method, 1.0::DOUBLE AS x1, 1.0::DOUBLE AS x2")
def optim_rosenbrock(spark, sf):
    f = minimize.scalar(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2)
    rows = []
    for m in _MINIMIZERS:
        found = minimize.minimize_with(minimize.Objective(f), [-1.2, 1.0], m)
        rows.append((m, float(round(found.x[0], 4)), float(round(found.x[1], 4))))
    return spark.createDataFrame(rows, "method string, x1 double, x2 double")
