"""Point sets, samples and histograms as DataFrames, and the text form of ensembles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def points(df: DataFrame, x: str | None = None, y: str | None = None, err: str | None = None, check: bool = True) -> DataFrame:
    """points(x, y, err) from named columns, or from the first three; one aggregate rejects bad rows."""
    names = [n or df.columns[k] for k, n in enumerate((x, y, err))]
    out = df.select(*[F.col(n).cast("double").alias(k) for n, k in zip(names, ("x", "y", "err"), strict=True)])
    if check:
        bad = out.agg(*[F.count_if(~_finite(F.col(c))).alias(c) for c in out.columns], F.count_if(F.col("err") == 0).alias("zero")).collect()[0]
        if any(bad):
            raise ValueError(f"points need finite numbers and errors other than zero: {bad.asDict()}")
    return out


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_order(df: DataFrame) -> Iterator[Row]:
    """The rows by obs_id, one after another, a partition at a time on the driver."""
    return df.orderBy("obs_id").toLocalIterator()


def gather(df: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows by obs_id in indices(obs_id), each as often as it is listed."""
    return indices.select("obs_id").join(df, "obs_id")


def fit_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of a closed range of obs_id."""
    return df.where(F.col("obs_id").between(first, last))


def finite_only(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """The rows whose column is finite, and an aggregate that counts the others."""
    return df.where(_finite(F.col(column))), F.count_if(~_finite(F.col(column)))


def histogram(df: DataFrame, column: str, width: float, lo: float = 0.0) -> DataFrame:
    """hist(bin, lo, hi, n) of equal bins; empty bins within the range are there with n = 0."""
    k = F.floor((F.col(column) - lo) / width).cast("int")
    counted = df.where(F.col(column).isNotNull()).groupBy(k.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    every = counted.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0.0)).alias("n"))


def model_curve(df: DataFrame, x: str, model, theta: Sequence[float], n: int = 100) -> DataFrame:
    """n points of a model over the range of a column, for a plot."""
    from lodefit.functions.columns import SparkMath

    ends = df.agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"))
    xs = ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "a", "b").select("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (n - 1)).alias("x"))
    return xs.select("i", "x", model(F.col("x"), [F.lit(float(t)) for t in theta], SparkMath).alias("y"))


def save_ensemble(ensemble: DataFrame, path: str, names: Sequence[str], up: float = 1.0) -> None:
    """ensemble(fval, p) as text: a header of # key: value lines, then fval and the parameters of each row.

    The header is a part file of its own, so rows are written by all tasks.
    """
    if any(len(n.split()) != 1 for n in names):
        raise ValueError("names must not be empty or hold white space")
    spark = ensemble.sparkSession
    spark.createDataFrame([(f"# names: {' '.join(names)}",), (f"# up: {up!r}",)], "value string").coalesce(1).write.text(path)
    numbers = F.concat(F.array(F.col("fval").cast("double")), F.col("p"))
    ensemble.select(F.array_join(F.transform(numbers, lambda v: v.cast("string")), " ").alias("value")).write.mode("append").text(path)


def load_ensemble(spark: SparkSession, path: str, names: Sequence[str] | None = None, up: float | None = None) -> tuple[DataFrame, list[str], float]:
    """ensemble(fval, p), names and up from text; the first of a header's keys counts, ragged rows are rejected."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value") != "")
    header: dict[str, str] = {}
    for r in lines.where(F.col("value").startswith("#")).limit(1000).collect():
        k, sep, v = r["value"].lstrip("# ").partition(":")
        if sep:
            header.setdefault(k.strip(), v.strip())
    rows = lines.where(~F.col("value").startswith("#")).select(F.transform(F.split("value", r"\s+"), lambda v: v.cast("double")).alias("v"))
    sizes = rows.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).collect()[0]
    if sizes["a"] != sizes["b"]:
        raise ValueError("rows differ in length")
    found = list(names or header.get("names", "").split() or [f"p{i}" for i in range((sizes["a"] or 1) - 1)])
    if sizes["a"] is not None and len(found) != sizes["a"] - 1:
        raise ValueError(f"{len(found)} names for {sizes['a'] - 1} parameters")
    return rows.select(F.col("v")[0].alias("fval"), F.slice("v", 2, max(1, len(found))).alias("p")), found, float(up if up is not None else header.get("up", 1.0))

