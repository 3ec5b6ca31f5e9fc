"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are cut into groups of correlated bits. If the thresholds
of the groups add up to radius - groups + 1, two fingerprints within the radius
are within the threshold of at least one group. The thresholds come from dynamic
programming on the estimated number of candidates; groups are probed for equal
or nearly equal values and candidates verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefit.functions.skew import split_join
from lodefit.llm.common import FEW, batch_of, cut, small_batches, table, texts
from lodefit.llm.components import components

BITS = 64
_OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_hash = partial(xxhash.xxh64_intdigest, seed=42)


@dataclass(frozen=True)
class Settings:
    """full_bucket: a bucket of more fingerprints than this is split by further groups."""

    shingle_words: int = 3
    radius: int = 2
    most_groups: int = 3
    full_bucket: int = 24


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The 64-bit SimHash of one whole text; null and texts without a word give 0."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only \x20\x09-\x0D separate
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : min(n, at + (1 << 16)) + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
        values = np.fromiter(map(_hash, shingles), np.dtype("<u8"))
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, a signed 64-bit fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, settings.shingle_words) for t in texts(b, "text")], np.uint64)
            yield batch_of([b.column(0), found.view(np.int64)], _OUT)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many have bits i and j both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n += len(bits)
            both += bits.T @ bits
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["k", "v"])

    found = {r["k"]: r["v"] for r in fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n = int(found.pop(BITS * BITS, 0))
    return n, np.array([found.get(k, 0.0) for k in range(BITS * BITS)]).reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size, each grown from the free bits that correlate most with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        seed = max(free, key=lambda i: (corr[i, free].max() if len(free) > 1 else 0, -i))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def near_share(group: list[int], p: np.ndarray, most: int) -> list[float]:
    """The share of pairs that differ in at most 0, 1, ... most bits of group, by each bit's own rate."""
    chance = np.zeros(len(group) + 1)
    chance[0] = 1.0
    for i in group:
        q = 2 * p[i] * (1 - p[i])
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return [float(chance[: t + 1].sum()) for t in range(most + 1)]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one for each group, that add up to total; -1 leaves a group out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (so_far, chosen) in best.items():
            for t, c in cost.items():
                at = spent + t
                if at not in step or so_far + c < step[at][0]:
                    step[at] = (so_far + c, [*chosen, t])
        best = step
    return best[total]


def plan(n: int, both: np.ndarray, settings: Settings) -> list[tuple[list[int], int]]:
    """Groups of bits with the threshold of each, at the least estimated cost; groups that are left out are not listed."""
    p = np.diag(both) / max(n, 1)
    plans = []
    for m in range(1, settings.most_groups + 1):
        groups = correlated_groups(n, both, m)
        costs = []
        for g in groups:
            share, probes, cost = near_share(g, p, settings.radius), 1.0, {-1: 0.0}
            for t in range(settings.radius + 1):
                probes += len(list(combinations(g, t))) if t else 0
                cost[t] = n * probes + share[t] * n * n
            costs.append(cost)
        total, chosen = allocate(costs, settings.radius - m + 1)
        plans.append((total, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def mask_of(bits) -> int:
    value = sum(1 << i for i in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


@dataclass(frozen=True)
class Path:
    """The bits that a bucket's members have in common, and the further groups that a full bucket is split by."""

    bits: tuple[int, ...]

    def split(self, radius: int) -> list[Path]:
        """Two fingerprints of a bucket, within the radius, agree in one of radius + 1 groups of the other bits."""
        left = [i for i in range(BITS) if i not in self.bits]
        return [Path(tuple(sorted((*self.bits, *left[k :: radius + 1])))) for k in range(radius + 1)] if len(left) > 2 * (radius + 1) else []


def _viewed(k: int, mask: Column) -> Callable[[Column], Column]:
    def flipped(x: Column) -> Column:
        view = F.col("fp").bitwiseXOR(x)
        return F.struct(F.lit(k).alias("path"), view.alias("view"), view.bitwiseAND(mask).alias("v"))

    return flipped


def links(fps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """fps(fp, rep), distinct -> a, b: all pairs within the radius.

    A bucket of more than full_bucket fingerprints isn't paired: its members go to
    buckets of further groups, as often as needed. What is left when too few bits
    are to split has few members, as fingerprints are distinct.
    """
    spark = fps.sparkSession
    n, both = bit_statistics(fps)
    chosen = plan(n, both, settings) if n else [([0], 0)]
    paths = [Path(tuple(group)) for group, _ in chosen]
    own, probes = [], []
    for k, (group, t) in enumerate(chosen):
        mask = F.lit(mask_of(group))
        flips = F.array(*[F.lit(mask_of(c)) for size in range(t + 1) for c in combinations(group, size)])
        own.append(F.struct(F.lit(k).alias("path"), F.col("fp").alias("view"), F.col("fp").bitwiseAND(mask).alias("v")))
        probes.append(F.transform(flips, _viewed(k, mask)))
    index = fps.select("fp", "rep", F.explode(F.array(*own)).alias("e")).select("e.*", "fp", "rep")
    probe = fps.select("fp", "rep", F.explode(F.flatten(F.array(*probes))).alias("e")).select("e.*", "fp", "rep")
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= settings.radius
    found = []
    while True:
        children = {k: p.split(settings.radius) for k, p in enumerate(paths)}
        most = F.when(F.col("path").isin([k for k, c in children.items() if c]), settings.full_bucket).otherwise(1 << 62)
        full = cut(index.groupBy("path", "v").count().where(F.col("count") > most).select("path", "v"))
        crowded = full.count()
        full = F.broadcast(full) if crowded <= FEW else full
        few = index.join(full, ["path", "v"], "left_anti").select("path", "v", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
        ask = probe.join(full, ["path", "v"], "left_anti").select("path", "v", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
        met = few.join(ask, ["path", "v"]).where((F.col("a") != F.col("b")) & near)
        found.append(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not crowded:
            return reduce(DataFrame.unionByName, found)
        paths, rows = [], []
        for k, split in children.items():
            for p in split:
                rows.append((k, len(paths), mask_of(p.bits)))
                paths.append(p)
        further = F.broadcast(spark.createDataFrame(rows, "path int, next int, mask long"))  # radius + 1 rows for each path
        index, probe = (cut(x.join(full, ["path", "v"], "left_semi").join(further, "path").select(F.col("next").alias("path"), "view", F.col("view").bitwiseAND(F.col("mask")).alias("v"), "fp", "rep")) for x in (index, probe))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id; one row for each row.

    component_id is the smallest doc_id that links lead to, the row itself included.
    Rows without a doc_id are grouped too; component_id is null only where no row
    of the component has one. Equal texts and repeated rows share a fingerprint and
    so a component; texts without a word have fingerprint 0.
    """
    marked = cut(fingerprints(docs, settings))
    # equal fingerprints meet here, before any pairing
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = fps.select("fp", F.col("fp").alias("rep"))
    found = components(links(nodes, settings))
    joined = cut(fps.join(found, fps.fp == found.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = cut(split_join(joined, least, "label", ["fp"]).select("fp", "component_id"))
    return split_join(marked, by_fp, "fp", ["doc_id"]).select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
