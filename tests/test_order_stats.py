import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefit.operators import ensembles, modes, order_stats


@pytest.fixture(scope="module")
def draws(spark):
    """A hot group of many values, ties, wide ranges, few rows, nulls, and a null key."""
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("ties", float(v)) for v in rng.integers(0, 3, 900)]
    rows += [("wide", float(v)) for v in np.concatenate([rng.lognormal(0, 9, 400), -rng.lognormal(0, 9, 400)])] + [("far", v) for v in (1e308, -1e308, 0.0) for _ in range(40)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 4.0), ("nulls", None), (None, 3.0), (None, 1.0)] + [("flat", 2.5)] * 700
    return spark.createDataFrame(rows, "k string, v double").repartition(4)


def test_quantiles_are_exact(draws, lot=60):
    p = [0.0, 0.025, 0.5, 0.5, 0.84, 1.0]
    want = {r["k"]: (r["n"], r["q"]) for r in draws.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, p))).alias("q")).collect()}
    got = {r["k"]: (r["n"], r["q"]) for r in order_stats.quantiles(draws, F.col("v"), p, ["k"], lot).collect()}
    assert got == want
    n, q = draws.agg(F.count("v"), F.percentile("v", F.array(*map(F.lit, p)))).first()
    assert tuple(order_stats.quantiles(draws, F.col("v"), p, lot=lot).first()) == (n, q)


def test_quantiles_of_nothing(draws):
    assert order_stats.quantiles(draws.limit(0), F.col("v"), [0.5], ["k"]).count() == 0
    assert tuple(order_stats.quantiles(draws.limit(0), F.col("v"), [0.5]).first()) == (0, None)
    assert {tuple(r) for r in order_stats.quantiles(draws.where("k in ('nulls', 'hot')"), F.col("v"), [0.5], ["k"], 100).where("k = 'nulls'").collect()} == {("nulls", 0, None)}


def test_what_is_built_on_them(draws, monkeypatch):
    built = (lambda: modes.mad_scale(draws, F.col("v"), ["k"]), lambda: ensembles.credible_interval(draws, F.col("v")))
    before = [sorted(map(tuple, f().collect()), key=str) for f in built]
    whole = order_stats.quantiles
    monkeypatch.setattr(order_stats, "quantiles", lambda rows, value, p, key=(): whole(rows, value, p, key, 300))
    after = [sorted(map(tuple, f().collect()), key=str) for f in built]
    assert before == after
    hot = dict((r[0], r) for r in before[0])["hot"]
    v = np.array([r["v"] for r in draws.where("k = 'hot'").collect()])
    assert hot[1] == 3000 and hot[2:] == pytest.approx((np.median(v), 1.4826 * np.median(np.abs(v - np.median(v)))))
