"""Joins on keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key of fewer rows is never split.
FEW = 64
#: A key is split when it has more than this part of a task's share of the rows.
PART = 4


def hot_keys(rows: DataFrame, on: str, total: int | None = None) -> list[tuple[object, int]]:
    """(key, pieces) of the keys that more than a quarter of a task's share of rows has.

    There are at most four of them for each shuffle partition, whatever the rows.
    Counting combines before its exchange, so a hot key weighs no more than others.
    """
    tasks = PART * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count() if total is None else total
    share = max(FEW, total / tasks)
    if total <= share:
        return []
    found = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > share).collect()
    return [(r[on], -int(-r["_n"] // share)) for r in found]


def split_join(rows: DataFrame, by_key: DataFrame, on: str, spread: list[str], how: str = "inner", hot: list[tuple[object, int]] | None = None) -> DataFrame:
    """rows joined with by_key on the column on; how is inner, left, left_semi or left_anti.

    by_key has one row for a key. A hot key's rows are dealt by the hash of their
    columns spread to several tasks, and by_key's row is copied to each. hot is what
    hot_keys(rows, on) gives, if it is known. A null key meets nothing, as in any join;
    where how keeps its rows, they are dealt by spread too.
    """
    hot = hot_keys(rows, on) if hot is None else hot
    tasks = PART * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spot = F.xxhash64(*spread)
    null = F.when(F.col(on).isNull(), F.pmod(spot, F.lit(tasks)))
    if not hot:
        left = rows.withColumn("_spot", F.coalesce(null, F.lit(0).cast("long")))
        return left.join(by_key.withColumn("_spot", F.lit(0).cast("long")), [on, "_spot"], how).drop("_spot")
    # at most four rows for each shuffle partition
    pieces = F.broadcast(rows.sparkSession.createDataFrame(hot, T.StructType([rows.schema[on], T.StructField("_pieces", T.LongType())])))
    left = rows.join(pieces, on, "left").withColumn("_spot", F.coalesce(null, F.pmod(spot, F.coalesce("_pieces", F.lit(1)))))
    right = by_key.join(pieces, on, "left").withColumn("_spot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)).cast("long") - 1)))
    return left.drop("_pieces").join(right.drop("_pieces"), [on, "_spot"], how).drop("_spot")
