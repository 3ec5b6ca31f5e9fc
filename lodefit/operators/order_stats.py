"""Exact quantiles of groups of any size.

Spark's percentile holds all values of a group in one task. Here a group beyond a
lot of rows is narrowed down first: counts by bin show in which bin a rank lies,
the bin becomes the range, and so on until what is left of it is a lot or one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodefit.functions.shared import written

#: Values of one group that a task may hold.
LOT = 1_000_000
#: Bins of a pass.
BINS = 1024
#: Ranges that are broadcast to the rows, at most; more are joined by exchange.
FEW = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def quantiles(rows: DataFrame, value: Column, p: Sequence[float], key: Sequence[str] = (), lot: int = LOT) -> DataFrame:
    """key, n, q: the linear quantiles of a value for each key, nulls left out; a key of nulls alone has n 0 and a null q.

    The same as percentile's, however many rows share a key: each pass over the rows
    counts them by bin, with partial sums, and sorts nothing; at last no task has
    more than lot values of one rank. Keys may be null. Without rows: no rows, or,
    without a key, a row of n 0.
    """
    key = list(key)
    v = rows.select(*key, value.cast("double").alias("_v"))
    sizes = v.groupBy(*key).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    most = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= lot:
        return v.groupBy(*key).agg(F.count("_v").alias("n"), F.percentile("_v", F.array(*[F.lit(float(x)) for x in p])).alias("q"))
    groups = written(sizes.withColumn("_g", F.monotonically_increasing_id()))
    if key:
        names = _few(groups.select(F.col("_g"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
        marked = v.where("_v is not null").join(names, same).select("_g", "_v")
    else:
        marked = v.where("_v is not null").select(F.lit(groups.first()["_g"]).alias("_g"), "_v")
    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(x)) * (F.col("n") - 1)).alias("at")) for i, x in enumerate(p)])
    wanted = written(groups.where("n > 0").select("_g", "n", "lo", "hi", F.explode(spots).alias("w")).select("_g", "n", "lo", "hi", "w.i", "w.at"))
    ranks = wanted.select("_g", "n", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    # lo to hi holds the rank, before rows lie below lo, inside rows lie in it
    state = written(ranks.select("_g", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")))
    while state.where((F.col("lo") < F.col("hi")) & (F.col("inside") > lot)).limit(1).count():
        state = _narrowed(marked, state, lot)
    values = _found(marked, state).select("_g", F.col("rank").alias("_rank"), "_v")
    low = values.select("_g", F.col("_rank").alias("_low"), F.col("_v").alias("a"))
    high = values.select("_g", F.col("_rank").alias("_high"), F.col("_v").alias("b"))
    placed = wanted.select("_g", "i", "at", F.floor("at").alias("_low"), F.ceil("at").alias("_high")).join(low, ["_g", "_low"]).join(high, ["_g", "_high"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("_high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("_low")) * F.col("b"))
    q = placed.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))), lambda s: s["q"]).alias("q"))  # len(p) of each
    return groups.join(q, "_g", "left").select(*key, "n", "q")


def _narrowed(marked: DataFrame, state: DataFrame, lot: int) -> DataFrame:
    """state with each range that is still too large replaced by the bin in which its rank lies, from the least to the largest value there."""
    large = (F.col("lo") < F.col("hi")) & (F.col("inside") > lot)
    ranges = state.where(large).select("_g", "lo", "hi").distinct()
    inside = marked.join(_few(ranges), "_g").where("_v >= lo AND _v <= hi")
    share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves don't overflow
    step = F.when(F.col("_v") == F.col("hi"), BINS - 1).otherwise(F.least(F.floor(share * (BINS - 1)), F.lit(BINS - 2)))
    by = ["_g", "lo", "hi"]
    bins = inside.groupBy(*by, F.coalesce(step, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b"))
    below = F.sum("c").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # BINS rows at most
    bins = bins.withColumn("below", F.coalesce(below, F.lit(0)))
    mine = (F.col("rank") >= F.col("before") + F.col("below")) & (F.col("rank") < F.col("before") + F.col("below") + F.col("c"))
    moved = state.where(large).join(bins, by).where(mine).select("_g", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("c").alias("inside"))
    return written(state.where(~large).unionByName(moved))


def _found(marked: DataFrame, state: DataFrame) -> DataFrame:
    """_g, rank, _v: the value of each rank; ranges of one value need no rows, others have a lot of them at most."""
    flat = state.where("lo = hi").select("_g", "rank", F.col("lo").alias("_v"))
    left = state.where("lo < hi")
    inside = marked.join(_few(left.select("_g", "lo", "hi").distinct()), "_g").where("_v >= lo AND _v <= hi")
    counted = inside.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "lo", "hi").orderBy("_v")))
    return flat.unionByName(left.join(counted, ["_g", "lo", "hi"]).where("_k = rank - before + 1").select("_g", "rank", "_v"))
