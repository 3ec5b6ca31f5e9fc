"""Embedding near-dedup by epsilon grid order.

Equal vectors are taken together. Unit vectors are turned to their principal
dimensions, sorted by grid cells, one radius wide, on the leading ones, and cut
into blocks of so many rows. Blocks whose boxes, over all dimensions, are within
the radius are joined; a join halves its sequence intervals as long as that lets
it skip parts that are provably too far apart, and compares the rest exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefit.functions.skew import split_join
from lodefit.llm.common import batch_of, cut, small_batches, table
from lodefit.llm.components import components


@dataclass(frozen=True)
class Settings:
    """Slack keeps rounding from skipping a block that is exactly at the radius. block_rows
    vectors are what a task holds of either side of a join; blocks don't depend on partitions."""

    cosine: float = 0.93
    grid_dimensions: int = 8
    block_rows: int = 2048
    leaf_rows: int = 64
    slack: float = 1e-6

    @property
    def radius(self) -> float:
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine)))


def linkable() -> Column:
    """Rows with a label and a vector of finite numbers that isn't zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors in double precision) for each length of vector in a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, flat[starts[at][:, None] + np.arange(d)]


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, the principal dimensions of all unit vectors of that length, leading ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for d, _, vectors in _by_length(b.column(0)):
                u = units(vectors)
                s = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
                s[0], s[1], s[2] = s[0] + len(u), s[1] + u.sum(0), s[2] + u.T @ u
        for d, (n, one, two) in sums.items():
            v = np.concatenate([[n], one, two.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), d)), pa.array(np.arange(len(v))), pa.array(v)], ["d", "k", "v"])

    total: dict[int, dict] = {}
    for r in rows.select("embedding").mapInArrow(run, "d long, k long, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).collect():
        total.setdefault(r["d"], {})[r["k"]] = r["v"]
    axes = {}
    for d, found in total.items():
        s = np.array([found[k] for k in range(1 + d + d * d)])
        n, one, two = s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)
        _, vectors = np.linalg.eigh(two / n - np.outer(one, one) / n**2)
        axes[d] = np.ascontiguousarray(vectors[:, ::-1])
    return axes


_BLOCK = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("d", pa.int64()), ("rows", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("v", pa.binary())])


def in_order(distinct: DataFrame, settings: Settings, axes) -> DataFrame:
    """distinct(label, embedding, first, n) -> the same in epsilon grid order, with row, which tells them apart, and within, the block of the label.

    Of each label and length of vector, every block but the last has block_rows
    vectors: a vector's place is the rows of its label in the partitions before its
    own and the rows before it there.
    """
    spark = distinct.sparkSession
    kind = distinct.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, cells = np.zeros(len(b), np.int64), [None] * len(b)
            for d, at, vectors in _by_length(b.column(1)):
                lead = units(vectors) @ axes.value[d][:, : settings.grid_dimensions]
                cell = np.floor(lead / settings.radius).astype(np.int32) if settings.radius else np.zeros(lead.shape, np.int32)
                lengths[at] = d
                for i, c in zip(at, cell.tolist(), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths), pa.array(cells, pa.list_(pa.int32()))], ["label", "embedding", "first", "n", "d", "cells"])

    columns = f"label long, embedding {kind}, first long, n long, d long"
    placed = distinct.select("label", "embedding", "first", "n").mapInArrow(place, f"{columns}, cells array<int>")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // settings.block_rows)))
    order = ["label", "d", "cells", "embedding"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("cells")

    def number(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, seen = TaskContext.get().partitionId(), 0, {}
        for b in part:
            k = []
            for key in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True):
                seen[key] = seen.get(key, -1) + 1
                k.append(seen[key])
            row = (own << 40) + np.arange(n, n + len(b))
            n += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), own)), pa.array(k, pa.int64()), pa.array(row)], ["label", "embedding", "first", "n", "d", "part", "k", "row"])

    numbered = cut(ordered.mapInArrow(number, f"{columns}, part long, k long, row long"))
    held = numbered.groupBy("label", "d", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("label", "d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("label", "d", "part", "before")
    # a row for each label of a partition: at most a window's worth of partitions for a label
    return numbered.join(held, ["label", "d", "part"]).withColumn("within", F.floor((F.col("before") + F.col("k")) / settings.block_rows))


def blocks(ordered: DataFrame, axes) -> DataFrame:
    """in_order's vectors, block by block, with their boxes over all principal dimensions."""
    dtype = _dtype(ordered)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        d = key[1].as_py()
        vectors = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        turned = units(vectors.astype(np.float64)) @ axes.value[d]
        box = [turned.min(0).tolist()], [turned.max(0).tolist()]
        return pa.Table.from_batches([batch_of([[0], [key[0].as_py()], [d], [rows.column("row").to_pylist()], [rows.column("n").to_pylist()], *box, [vectors.astype(dtype).tobytes()]], _BLOCK)])

    packed = ordered.select("label", "d", "within", "embedding", "row", "n").groupBy("label", "d", "within").applyInArrow(pack, "block long, label long, d long, rows array<long>, counts array<long>, lo array<double>, hi array<double>, v binary")
    return cut(packed.withColumn("block", F.monotonically_increasing_id()))


def _dtype(rows: DataFrame) -> np.dtype:
    return np.dtype("<f4" if rows.schema["embedding"].dataType.elementType == T.FloatType() else "<f8")


def near_blocks(made: DataFrame, settings: Settings) -> DataFrame:
    """a, b: pairs of blocks, a = b among them, whose boxes are within the radius.

    Blocks meet in the cells of the first two dimensions that both may reach.
    """
    size = settings.radius + settings.slack

    def reach(k: int, wider: float) -> Column:
        lo, hi = F.coalesce(F.get("lo", F.lit(k)), F.lit(0.0)), F.coalesce(F.get("hi", F.lit(k)), F.lit(0.0))
        return F.sequence(F.floor((lo - wider) / size), F.floor((hi + wider) / size))

    def in_cells(wider: float) -> DataFrame:
        own = made.select("block", "label", "d", "lo", "hi", F.explode(reach(0, wider)).alias("c0"), reach(1, wider).alias("c1s"))
        return own.select("block", "label", "d", "lo", "hi", "c0", F.explode("c1s").alias("c1"))

    a = in_cells(0.0).withColumnsRenamed({"block": "a", "lo": "lo_a", "hi": "hi_a"})
    b = in_cells(size).withColumnsRenamed({"block": "b", "lo": "lo_b", "hi": "hi_b"})
    gap = F.aggregate(
        F.zip_with(F.zip_with("lo_b", "hi_a", lambda x, y: x - y), F.zip_with("lo_a", "hi_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    met = a.join(b, ["label", "d", "c0", "c1"]).where((F.col("a") <= F.col("b")) & (gap <= size * size))
    return met.select("a", "b").distinct()


def join_intervals(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, settings: Settings, same: bool) -> np.ndarray:
    """The matrix of links between two blocks of unit vectors; same: between a block and itself.

    at_a and at_b are their principal dimensions, all of them, so boxes are as tight as may be.
    """
    links = np.zeros((len(a), len(b)), bool)
    size = (settings.radius + settings.slack) ** 2
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:
            continue  # the mirror image is joined instead
        gap = np.maximum(0, np.maximum(at_b[k:m].min(0) - at_a[i:j].max(0), at_a[i:j].min(0) - at_b[k:m].max(0)))
        if gap @ gap > size:
            continue
        if j - i <= settings.leaf_rows and m - k <= settings.leaf_rows:
            links[i:j, k:m] = a[i:j] @ b[k:m].T >= settings.cosine
            continue
        cut_a = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > settings.leaf_rows else [(i, j)]
        cut_b = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > settings.leaf_rows else [(k, m)]
        todo += [(*x, *y) for x in cut_a for y in cut_b]
    if same:
        links |= links.T
        np.fill_diagonal(links, False)
    return links


def smallest_reached(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches through links."""
    la, lb, none = ids_a.copy(), ids_b.copy(), np.iinfo(np.int64).max
    step = max(1, (1 << 20) // max(1, len(lb)))  # rows whose ids are held at a time

    def least(m: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.concatenate([np.minimum(own[i : i + step], np.where(m[i : i + step], other[None, :], none).min(1, initial=none)) for i in range(0, len(own), step)])

    while True:
        na = least(links, la, lb)
        nb = least(links.T, lb, na)
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def compare(pairs: DataFrame, axes, dtype: np.dtype, settings: Settings) -> DataFrame:
    """Block pairs with their vectors -> row, n, near: rows linked, copies counted, and the smallest row they lead to."""
    form = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("near", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one pair of blocks at a time
                a, b, d, va, vb, ra, rb, ca, cb = (batch.column(k)[i] for k in range(9))
                same, d = a.as_py() == b.as_py(), d.as_py()
                ua, ub = (units(np.frombuffer(v.as_buffer(), dtype).astype(np.float64).reshape(-1, d)) for v in (va, vb))
                links = join_intervals(ua, ub, ua @ axes.value[d], ub @ axes.value[d], settings, same)
                ia, ib = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
                if not len(ia):
                    continue
                links = links[np.ix_(ia, ib)]
                (rows_a, n_a), (rows_b, n_b) = ((r.values.to_numpy()[at], c.values.to_numpy()[at]) for r, c, at in ((ra, ca, ia), (rb, cb, ib)))
                la, lb = smallest_reached(links, rows_a, rows_b)
                parts = [(rows_a, links @ n_b, la)] if same else [(rows_a, links @ n_b, la), (rows_b, links.T @ n_a, lb)]
                yield batch_of([np.concatenate(x) for x in zip(*parts, strict=True)], form)

    return pairs.select("a", "b", "d", "va", "vb", "ra", "rb", "ca", "cb").mapInArrow(run, "row long, n long, near long")


def near_duplicates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """rows(vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row for each row.

    Rows of equal label link at a cosine of at least settings.cosine; equal vectors
    always do. Rows without a label, and vectors that are null, empty, zero or hold
    a null or a number that isn't finite, link with nothing, as do vectors of
    different length. Rows of equal vec_id are different vectors. component_id is
    the smallest vec_id of the component, null only if it has none; kept is true
    for that row. Other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    alone = rows.where(~linkable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    zero = F.lit(0.0).cast(rows.schema["embedding"].dataType.elementType)
    full = rows.where(linkable()).select("vec_id", F.struct("label", F.transform("embedding", lambda x: x + zero).alias("embedding")).alias("key"))  # -0.0 is 0.0
    # equal vectors are one from here on: a crowd of copies weighs as much as one vector
    distinct = cut(full.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).select("key.label", "key.embedding", "first", "n"))
    axes = spark.sparkContext.broadcast(principal_axes(distinct))
    ordered = in_order(distinct, settings, axes)
    made = blocks(ordered, axes)
    # few pairs at a time go to a worker: each holds two blocks
    left = made.select(F.col("block").alias("a"), "d", F.col("v").alias("va"), F.col("rows").alias("ra"), F.col("counts").alias("ca"))
    right = made.select(F.col("block").alias("b"), F.col("v").alias("vb"), F.col("rows").alias("rb"), F.col("counts").alias("cb"))
    pairs = near_blocks(made, settings).join(left, "a").join(right, "b")
    found = cut(compare(pairs, axes, _dtype(rows), settings))
    counts = found.groupBy("row").agg(F.sum("n").alias("links"))
    labels = components(found.select(F.col("row").alias("a"), F.col("near").alias("b"))).withColumnsRenamed({"node": "row", "label": "component"})
    nodes = ordered.select("label", "embedding", "first", "n", "row").join(counts, "row", "left").join(labels, "row", "left")
    nodes = cut(nodes.select(F.struct("label", "embedding").alias("key"), "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "row").alias("component")))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    nodes = cut(split_join(nodes, least, "component", ["first"]).select("key", "n_links", "component_id"))
    # rows meet their vector by its hash, which sorts fast, and by itself
    own = full.withColumn("h", F.xxhash64("key"))
    met = split_join(own, nodes.withColumnRenamed("key", "same").withColumn("h", F.xxhash64("same")), "h", ["vec_id"])
    linked = met.where(F.col("key") == F.col("same")).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_vector_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS m FROM reach GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least.m, vec_id) AS component_id, coalesce(least.m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.node = vec_id LEFT JOIN least ON least.node = vec_id
"""
