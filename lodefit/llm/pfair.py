"""Mixing sources to target weights by Pfair scheduling.

A source of weight w releases its k-th block at floor(k / w) and must place it
before ceil((k + 1) / w). Earliest deadline first among the released blocks keeps
every source less than one block from its share at all times. Weights are exact
fractions and the whole mix is scheduled, so this holds from the first block to the last.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodefit.llm.common import table

ADDED = ("position", "slot", "block", "epoch")
#: Rows of the table of bucket offsets that is broadcast.
OFFSET_ROWS = 200_000


@dataclass(frozen=True)
class Settings:
    """block_rows: rows of a block; period: blocks that a source's share is stated for;
    flatten: default weights are the sources' row counts to this power; most_blocks: the mix has at most so many
    blocks, as all are scheduled on the driver, so blocks of a very large one are larger."""

    block_rows: int = 64
    most_blocks: int = 1 << 20
    period: int = 4096
    flatten: float = 0.8


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Shares of at least one that add up to period, by largest remainder; ties go by name.

    For schedules that repeat; mix uses exact_shares.
    """
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources don't fit a period of {period} blocks")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    shares = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(f.denominator for f in exact.values()))
    return {s: int(f * scale) for s, f in exact.items()}


def schedule(shares: dict[str, int], end: int | None = None, least: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of each source's blocks among the first end, earliest deadline first; ties go by name.

    end is the sum of the shares if it isn't given. The first least blocks of a source are due by end.
    """
    total = sum(shares.values())
    end = total if end is None else end
    names = sorted(shares)
    coming = [(0, i, 0) for i in range(len(names))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in names}
    due = [least.get(s, 0) if least else 0 for s in names]
    for at in range(end):
        while coming[0][0] <= at:
            _, i, k = coming[0]
            c = shares[names[i]]
            deadline = -(-(k + 1) * total // c)
            heapq.heappush(ready, (min(deadline, end) if k < due[i] else deadline, i, k))
            heapq.heapreplace(coming, ((k + 1) * total // c, i, k + 1))
        deadline, i, _ = heapq.heappop(ready)
        assert at < deadline
        slots[names[i]].append(at)
    return slots


#: The group of the sources that are due less than a block.
TAIL = ""


@dataclass(frozen=True)
class Source:
    name: str
    rows: int
    share: float  # blocks of a period, not rounded to whole ones
    wanted: int  # rows of the mix, repeats included
    group: str  # whose blocks the source fills: its own or the tail's
    at: int  # rows of the group before it


def mix_end(shares: dict[str, int], least: dict[str, int]) -> int:
    """A number of blocks in which every source can place its least blocks and none leaves its share by a block.

    The last of these blocks must have been released, and what is due by then must fit: if the
    sum holds for the end, it does for every span before it.
    """
    total = sum(shares.values())
    low = max(sum(least.values()), *((least[s] - 1) * total // c + 1 for s, c in shares.items()))
    high = max(low, *(-(-least[s] * total // c) for s, c in shares.items()))  # fits always
    while low < high:
        end = (low + high) // 2
        if sum(max(least[s], end * c // total) for s, c in shares.items()) <= end:
            high = end
        else:
            low = end + 1
    return high


def sized(counts: dict[str, int], settings: Settings, weights: dict[str, float] | None = None) -> Settings:
    """settings with the block_rows that keep the mix within most_blocks."""
    shares = _shares(counts, settings, weights)
    total = sum(shares.values())
    length = max(Fraction(n * total, shares[s]) for s, n in counts.items())
    return replace(settings, block_rows=max(settings.block_rows, math.ceil(length / settings.most_blocks)))


def _shares(counts: dict[str, int], settings: Settings, weights: dict[str, float] | None) -> dict[str, int]:
    if weights is None:
        weights = {s: n**settings.flatten for s, n in counts.items()}
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"sources without a weight: {missing[:5]}")
    return exact_shares({s: weights[s] for s in sorted(counts)})


def plan(counts: dict[str, int], settings: Settings, weights: dict[str, float] | None = None) -> tuple[list[Source], dict[str, list[int]]]:
    """How many rows each source gives until the slowest has given all of its own, and the slots of each group's blocks.

    Sources that end before begin anew, so no row is left out and weights hold to the end.
    Sources that are due less than a block by then fill the blocks of one group, one after
    the other, each with the rows it is due.
    """
    shares = _shares(counts, settings, weights)
    size, total = settings.block_rows, sum(shares.values())
    length = max(Fraction(n * total, shares[s]) for s, n in counts.items())  # rows of the mix
    tail = {s: c for s, c in shares.items() if length * c < size * total}
    groups = {s: c for s, c in shares.items() if s not in tail}
    least = {s: -(-counts[s] // size) for s in groups}
    if tail:
        groups[TAIL] = sum(tail.values())
        least[TAIL] = -(-length * groups[TAIL] // (size * total))
    slots = schedule(groups, mix_end(groups, least), least)
    end = sum(map(len, slots.values()))
    given: dict[str, tuple[int, int]] = {}
    if tail:
        own = sum(counts[s] for s in tail)
        spare = min(size * len(slots[TAIL]), size * end * groups[TAIL] // total) - own
        extra = {s: Fraction(size * end * c, total) - counts[s] for s, c in tail.items()}
        most, so_far, before, at = sum(extra.values()), Fraction(0), 0, 0
        for s, x in extra.items():
            so_far += x
            upto = int(spare * so_far / most) if most else 0
            given[s] = (counts[s] + upto - before, at)
            at, before = at + given[s][0], upto
    found = []
    for s, n in sorted(counts.items()):
        share = float(Fraction(shares[s] * settings.period, total))
        if s in tail:
            found.append(Source(s, n, share, given[s][0], TAIL, given[s][1]))
        else:  # a source that gives its rows once closes with what is left of its last block
            found.append(Source(s, n, share, n if len(slots[s]) == least[s] else len(slots[s]) * size, s, 0))
    return found, slots


def source_key(source: Column) -> Column:
    """A source's name, which null has too."""
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("n:"))


def mix(rows: DataFrame, settings: Settings = Settings(), weights: dict[str, float] | None = None) -> DataFrame:
    """rows(doc_id, source, ...) -> the same columns with position, slot, block and epoch, in order of position.

    weights are by source_key. Every row is there at least once; epoch counts its
    repeats from 0. Within a source the order is by hash of doc_id. Rows without a
    source are a source of their own; an empty table stays empty. position grows
    along the mix; a source's short last block leaves numbers out. Sources that are
    due less than a block in all share blocks, which are numbered through. Columns
    of rows that are named like the added ones are replaced; no other name clashes.
    """
    spark = rows.sparkSession
    kept = [F.col(f"_row.`{c}`") for c in rows.columns if c not in ADDED]
    keyed = rows.select(F.struct("*").alias("_row"), "doc_id", source_key(F.col("source")).alias("_s"))
    counts = {r["_s"]: r["count"] for r in keyed.groupBy("_s").count().collect()}
    if not counts:
        return keyed.select(*kept, *[F.lit(0).cast("long").alias(c) for c in ADDED[:3]], F.lit(0).alias(ADDED[3]))
    settings = sized(counts, settings, weights)
    sources, slots = plan(counts, settings, weights)
    size, period = settings.block_rows, settings.period
    length = sum(map(len, slots.values())) * size
    pace = {TAIL: sum(s.share for s in sources if s.group == TAIL)}
    epochs = sum(-(-s.wanted // s.rows) for s in sources)
    buckets = max(64, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")), sum(s.wanted for s in sources) // 16384)
    # a source's epochs span the mix at most twice, so offsets are at most 2 buckets + epochs rows a source
    most = (OFFSET_ROWS - epochs) // (2 * len(sources))
    few = F.broadcast if most >= 64 else lambda df: df  # offsets of many sources or repeats are joined by exchange
    buckets = min(most, buckets) if most >= 64 else buckets
    known = spark.createDataFrame([(s.name, s.rows, pace.get(s.group, s.share), s.wanted, s.group, s.at) for s in sources], "_s string, _n long, _c double, _m long, _g string, _at long")
    places = spark.createDataFrame(list(slots.items()), "_g string, _x array<int>", verifySchema=False)
    # a row of each source, which plan has held already, and of places four bytes a block
    every = keyed.join(F.broadcast(known), "_s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast((_m - 1) div _n as int)"))))
    share = F.pmod(F.xxhash64("doc_id", "epoch"), F.lit(1 << 40)) / float(1 << 40)
    every = every.withColumn("_u", share).withColumn("_b", F.floor((F.col("_at") + (F.col("epoch") + F.col("_u")) * F.col("_n")) * period / F.col("_c") / length * buckets).cast("int"))
    before = Window.partitionBy("_s", "epoch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.groupBy("_s", "epoch", "_b").count().withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    # if broadcast at most OFFSET_ROWS rows, by the choice of buckets
    dealt = every.join(few(offsets), ["_s", "epoch", "_b"]).where(F.col("epoch") * F.col("_n") + F.col("_o") < F.col("_m"))
    # a bucket is a span of the mix, for all sources: one exchange serves the ranks and the order
    dealt = dealt.repartitionByRange(max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))), "_b")
    within = Window.partitionBy("_b", "_s", "epoch").orderBy("_u", "doc_id")
    rank = F.col("epoch") * F.col("_n") + F.col("_o") + F.row_number().over(within) - 1
    ranked = dealt.withColumn("_r", rank).where(F.col("_r") < F.col("_m")).withColumn("_r", F.col("_at") + F.col("_r"))
    ranked = ranked.withColumn("block", F.floor(F.col("_r") / size))
    ranked = ranked.join(F.broadcast(places), "_g").withColumn("slot", F.get("_x", F.col("block").cast("int")).cast("long"))
    ranked = ranked.withColumn("position", F.col("slot") * size + F.col("_r") % size)
    return ranked.sortWithinPartitions("_b", "position").select(*kept, *ADDED)


def op5_pfair(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
