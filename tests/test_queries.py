import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lodefit.operators import modes
from lodefit.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert found == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nearest_distance_counts_every_row(spark):
    z = np.random.default_rng(5).normal(size=(120, 3))
    z[0] += 50
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(z)], "id long, z array<double>")
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) + np.diag([np.inf] * 120)
    got = modes.nearest_distance(df, 0.3).first()
    assert got["n"] == 120 and np.allclose([got["median"], got["q90"]], [np.median(d.min(1)), np.quantile(d.min(1), 0.9)])
    assert modes.nearest_distance(df.limit(1), 0.3).first()["n"] == 0


def test_medoids(spark, monkeypatch):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(90, 2))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(z)], "id long, z array<double>")
    labels = spark.createDataFrame([(i, 1 + i % 2 if i < 80 else 0) for i in range(90)], "id long, mode int")
    monkeypatch.setattr(modes, "MEDOID_ROWS", 7)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    want = {}
    for m in (1, 2):
        own = [i for i in range(80) if 1 + i % 2 == m]
        want[m] = min(own, key=lambda i: d[i, own].sum())
    assert {r["mode"]: r["id"] for r in modes.medoids(df, labels).collect()} == want
