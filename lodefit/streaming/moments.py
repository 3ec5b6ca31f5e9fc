"""A running line fit over a stream, from moments that merge. An extra: the engine's own operators are batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moments(rows: DataFrame, key: str) -> DataFrame:
    """Sums of points(key, x, y) that add up across batches."""
    x, y = F.col("x"), F.col("y")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))


def lines(sums: DataFrame, key: str) -> DataFrame:
    """slope and intercept of each key from its sums; null where x doesn't vary."""
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    det = n * sxx - sx * sx
    slope = F.when(det > 0, (n * sxy - sx * sy) / det)
    return sums.select(key, "n", slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept"))


def running_lines(stream: DataFrame, key: str, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A streaming aggregate of the moments, kept by key in the state store, as an in-memory table of its lines."""
    out = lines(moments(stream, key), key).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
