"""Near copies of texts: SimHash candidates by the generalised pigeonhole, verified on their shingles.

A text's fingerprint has many words of 64 bits. Every word is cut into groups of
correlated bits; a dynamic program gives each group a threshold, or leaves it out,
so that two texts at the least similarity meet in some group with the wanted
chance at the least estimated number of rows and candidates. Candidates are held
against a whole word, then the whole fingerprint, then the exact similarity.

Crowds of copies are not written out as pairs: they are found by holding the members
of big buckets against a few of them, then each member is verified against a few
of its crowd, and only what that leaves apart from the crowd's core is looked at
block by block, for the links that join it. Buckets then pair what isn't of one crowd.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefit.functions.skew import split_join
from lodefit.llm.common import FEW, batch_of, cut, kept, small_batches, texts
from lodefit.llm.components import components
from lodefit.llm.simhash import BITS, correlated_groups, mask_of, near_share

_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("digest", pa.binary()), ("fps", pa.list_(pa.int64()))])
_SETS = pa.schema([("digest", pa.binary()), ("shingles", pa.list_(pa.int64()))])
_BLOCK = 1 << 12
#: So many choices of leaders are made for the buckets of a crowd.
SALTS = 4


@dataclass(frozen=True)
class Settings:
    """similarity: least share of common shingles; words: 64-bit words of a fingerprint; recall: the chance
    with which two texts of just that similarity meet in a group. star_groups groups and leaders of a
    bucket find the crowds, of at least crowd texts; block_rows is what a task holds of one twice."""

    shingle_words: int = 5
    similarity: float = 0.8
    words: int = 16
    recall: float = 0.995
    most_groups: int = 4
    star_groups: int = 8
    leaders: int = 4
    crowd: int = 32
    block_rows: int = 128
    row_cost: float = 10.0

    @property
    def bit_rate(self) -> float:
        """How often a bit differs at the least similarity: sets of one size have the least cosine."""
        return math.acos(min(1.0, 2 * self.similarity / (1 + self.similarity))) / math.pi

    def radius(self, bits: int, deviations: float) -> int:
        p = self.bit_rate
        return min(bits, math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p))))

    def loose(self, bits: int) -> int:
        """Bits by which texts of a crowd may differ from a leader: far more than similar texts do, far less than unlike ones."""
        return math.floor(bits * (self.bit_rate + (0.5 - self.bit_rate) / 3))


def shingles(text: str | None, n: int) -> tuple[bytes, np.ndarray]:
    """The digest of a text's words, in lower case, and its distinct shingles' hashes; a shorter text is one shingle, one without a word has none."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    if not words:
        return digest, np.empty(0, np.uint64)
    every = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    return digest, np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in every), np.uint64))


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of shingles: words times 64 bits, each word from its own mixing of the hashes."""
    ones = np.zeros(words * BITS, np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), _BLOCK):
        h = hashes[at : at + _BLOCK, None] + step  # the finalizer of splitmix64
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of unsigned numbers as a column of lists, without a Python object for each number."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.uint64)]).view(np.int64)))


def fingerprints(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs(doc_id, text) -> doc_id, th, digest, fps; th is the hash by which the text is found again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("near copies",), lambda: None)
        for b in batches:
            found = [(d, fingerprint(h, settings.words)) for d, h in (shingles(t, settings.shingle_words) for t in texts(b, "text"))]
            fps = lists([f for _, f in found])
            yield batch_of([b.column(0), b.column(1), [d for d, _ in found], fps], _OUT)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, digest binary, fps array<long>")


def bit_statistics(reps: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each word, how many have bits i and j both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((words, BITS, BITS))
        for b in batches:
            fps = b.column(0).flatten().to_numpy().reshape(-1, words)
            n += len(fps)
            for k in range(words):
                bits = np.unpackbits(np.ascontiguousarray(fps[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both[k] += bits.T @ bits
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.size + 1)), pa.array(np.append(both.ravel(), n))], ["k", "v"])

    size = words * BITS * BITS
    found = {r["k"]: r["v"] for r in reps.select("fps").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n = int(found.pop(size, 0))
    return n, np.array([found.get(k, 0.0) for k in range(size)]).reshape(words, BITS, BITS)


def meets(size: int, threshold: int, rate: float) -> float:
    """The chance that at most threshold of size bits differ."""
    return sum(math.comb(size, t) * rate**t * (1 - rate) ** (size - t) for t in range(threshold + 1))


def allocate(options: list[list[tuple[int, float, float]]], need: float, unit: float = 0.01) -> list[int]:
    """The cheapest threshold of each group, -1 for none, so that their gains add up to need; all at their most if they can't.

    options: (threshold, cost, gain) of each group.
    """
    want = math.ceil(need / unit)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in options:
        step: dict[int, tuple[float, list[int]]] = {}
        for got, (spent, chosen) in best.items():
            for t, cost, gain in [(-1, 0.0, 0.0), *group]:
                at = min(want, got + math.floor(gain / unit))
                if at not in step or spent + cost < step[at][0]:
                    step[at] = (spent + cost, [*chosen, t])
        best = step
    return best[max(best)][1]


def plan(n: int, both: np.ndarray, settings: Settings) -> list[tuple[int, list[int], int]]:
    """(word, bits, threshold) of the groups that are probed. At threshold t both sides flip up to t / 2 bits."""
    found = []
    need = -math.log(1 - settings.recall)
    for m in range(2, settings.most_groups + 1):
        groups, options, costs = [], [], {}
        for w in range(settings.words):
            p = np.diag(both[w]) / max(n, 1)
            for g in correlated_groups(n, both[w], m):
                share = near_share(g, p, 2)
                options.append([(t, n * (1 + len(g) * t // 2) * settings.row_cost + share[t] * n * n / 2, -math.log(1 - meets(len(g), t, settings.bit_rate))) for t in (0, 2)])
                groups.append((w, g))
        chosen = allocate(options, need)
        costs = sum(c for t, group in zip(chosen, options, strict=True) for o, c, _ in group if o == t)
        gain = sum(x for t, group in zip(chosen, options, strict=True) for o, _, x in group if o == t)
        found.append((gain < 0.95 * need, costs, [(w, g, t) for t, (w, g) in zip(chosen, groups, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


CHECKS = ("c0", "c1", "c2", "c3")


def members(reps: DataFrame, groups: list[tuple[int, list[int], int]], settings: Settings, names: tuple[str, ...] = CHECKS, *more: str) -> DataFrame:
    """A row (key, rep, checks) for each bucket that a text is in; the checks are words that its bucket mates are held against."""
    # one short expression for all groups, whose numbers are data: generated code doesn't grow with them
    spots = [(k, w, mask_of(bits), flip) for k, (w, bits, t) in enumerate(groups) for flip in ([0, *(mask_of([i]) for i in bits)] if t else [0])]
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(m).alias("m"), F.lit(x).cast("long").alias("x")) for k, w, m, x in spots])

    def spot(g: Column) -> Column:
        key = F.xxhash64(g["k"], F.get("fps", g["w"]).bitwiseAND(g["m"]).bitwiseXOR(g["x"]))
        return F.struct(key.alias("key"), *[F.get("fps", (g["w"] + 1 + i) % settings.words).alias(c) for i, c in enumerate(names)])

    return reps.select("rep", *more, F.explode(F.transform(table, spot)).alias("e")).select("e.key", "rep", *(f"e.{c}" for c in names), *more)


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _distance(a: Column, b: Column) -> Column:
    return sum((_apart(a[c], b[c]) for c in CHECKS), F.lit(0))


def one_each(met: DataFrame) -> DataFrame:
    """met(rep, to) -> a, b: each rep is joined to the first of those it is linked to, and these once for all that have the same."""
    met = cut(met)
    joined = met.where(F.size("to") > 1).select("to").distinct().select(F.col("to")[0].alias("a"), F.explode(F.expr("slice(to, 2, size(to) - 1)")).alias("b"))
    return met.select(F.col("rep").alias("a"), F.col("to")[0].alias("b")).unionByName(joined).distinct()


def crowds(rows: DataFrame, settings: Settings) -> DataFrame:
    """rep, crowd, size: texts that loosely hang together, in lots of at least settings.crowd.

    They show in buckets far above the mean, where every member is held against a
    few that are chosen by hash, nearly the same few in all buckets of a crowd. A
    member goes to one of those it is near to, and those are joined once for all
    members that are near to the same: edges are about as many as members, however
    many buckets they share.
    """
    sizes = cut(rows.groupBy("key").count())
    mean = sizes.agg(F.avg("count").alias("m")).collect()[0]["m"] or 0
    big = sizes.where(F.col("count") > 8 + 4 * mean).select("key")
    big = F.broadcast(big) if big.count() <= FEW else big
    rows = cut(rows.join(big, "key", "left_semi").select("key", "rep", F.struct(*CHECKS).alias("own")))
    salt = F.pmod("key", F.lit(SALTS))  # so that a crowd among others isn't without a leader in every bucket
    first = rows.groupBy("key").agg(F.array(*[F.min(F.struct(F.xxhash64("rep", salt, F.lit(i)).alias("h"), "rep", "own")) for i in range(settings.leaders)]).alias("first"))
    loose = settings.loose(BITS * len(CHECKS))
    near = F.filter("first", lambda f: (f["rep"] != F.col("rep")) & (_distance(F.col("own"), f["own"]) <= loose))
    met = split_join(rows, first, "key", ["rep"]).select("rep", F.explode(F.transform(near, lambda f: f["rep"])).alias("to"))
    near_to = met.groupBy("rep").agg(F.sort_array(F.collect_set("to")).alias("to"))  # a few of each bucket that a text is in
    found = components(one_each(near_to)).withColumnsRenamed({"node": "rep", "label": "crowd"})
    size = found.groupBy("crowd").agg(F.count("*").alias("size")).where(F.col("size") >= settings.crowd)
    return cut(split_join(found, size, "crowd", ["rep"]))


def star_links(held: DataFrame, settings: Settings) -> DataFrame:
    """a, b: what joins the members of each crowd to a few of them, chosen by hash: about one row for each member.

    held(rep, crowd, fps, shingles); every link is verified on the shingles. A member
    that links to several of the few goes to one of them, and those are joined
    once for all members that link to the same.
    """
    chosen = [F.struct(F.xxhash64("rep", "crowd", F.lit(i)).alias("h"), F.col("rep").alias("lead")) for i in range(settings.leaders)]
    first = held.groupBy("crowd").agg(F.array(*[F.min(c) for c in chosen]).alias("all"))
    first = cut(first.select("crowd", F.explode(F.array_distinct(F.transform("all", lambda f: f["lead"]))).alias("rep")))
    lead = first.join(held.drop("crowd"), "rep").groupBy("crowd").agg(F.collect_list(F.struct("rep", "fps", "shingles")).alias("leads"))  # settings.leaders at most
    bits = lambda f: F.aggregate(F.zip_with("fps", f["fps"], _apart), F.lit(0), lambda n, x: n + x)
    common = lambda f: F.size(F.array_intersect("shingles", f["shingles"]))
    near = lambda f: bits(f) <= settings.radius(BITS * settings.words, 3.0)
    alike = lambda f: F.when((f["rep"] != F.col("rep")) & near(f), common(f) >= F.lit(settings.similarity) * (F.size("shingles") + F.size(f["shingles"]) - common(f))).otherwise(F.lit(False))
    met = split_join(held, cut(lead), "crowd", ["rep"])
    found = met.select("rep", F.array_sort(F.transform(F.filter("leads", alike), lambda f: f["rep"])).alias("to")).where(F.size("to") > 0)
    return one_each(found)


def dealt(inside: DataFrame, linked: DataFrame, settings: Settings) -> DataFrame:
    """rep, crowd, i, j, rest: to which pairs of blocks the members of each crowd go, given what hangs together already (rep, label).

    The largest part of a crowd that hangs together is its core, which needs no
    look at itself. Blocks of the rest meet all blocks of the crowd: members go to
    as many tasks as the rest has blocks, so a crowd about one text is dealt
    about once. rest is 0 for a core's members.
    """
    own = split_join(inside, linked, "rep", ["crowd"], "left").withColumn("label", F.coalesce("label", "rep"))
    parts = cut(own.groupBy("crowd", "label").agg(F.count("*").alias("n")))
    core = parts.groupBy("crowd").agg(F.max(F.struct("n", "label")).alias("c"), F.sum("n").alias("size")).select("crowd", F.col("c.label").alias("core"), (F.col("size") - F.col("c.n")).alias("apart"))
    own = split_join(own, core.where("apart > 0"), "crowd", ["rep"])
    rest = (F.col("label") != F.col("core")).cast("int")
    blocks = lambda n: F.ceil(F.col(n) / settings.block_rows)
    spots = own.select("rep", "crowd", rest.alias("rest"), blocks("size").alias("all"), blocks("apart").alias("few"), F.xxhash64("rep").alias("h"))
    # i: a block of the rest, j: of all; members of the rest are on both sides, and a task takes each once
    side_i = spots.where("rest = 1").select("rep", "crowd", "rest", F.expr("pmod(h, few)").alias("i"), F.explode(F.expr("sequence(0L, all - 1)")).alias("j"))
    side_j = spots.select("rep", "crowd", "rest", F.explode(F.expr("sequence(0L, few - 1)")).alias("i"), F.expr("pmod(shiftrightunsigned(h, 17), all)").alias("j"))
    return side_i.unionByName(side_j).distinct()


def crowd_links(inside: DataFrame, reps: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """a, b: links that join the members of each crowd as all links between them do.

    Members are first held against a few of their crowd. What that leaves apart is
    dealt to blocks, and a task holds two of them: it looks at all pairs but
    those within the core, and gives only those that join what wasn't joined there.
    """
    least, most = settings.similarity, settings.radius(BITS * settings.words, 3.0)
    known = reps.join(inside.select("rep"), "rep").select("rep", "digest", "th", "fps")
    sets = shingle_sets(docs, cut(known.drop("fps")), settings)
    held = cut(known.select("rep", "fps").join(sets, "rep"))
    stars = star_links(held.join(inside.select("rep", "crowd"), "rep"), settings)
    linked = components(stars).withColumnRenamed("node", "rep")
    rows = cut(dealt(inside, linked, settings)).join(held, "rep")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rep, rest = rows.column("rep").to_pylist(), rows.column("rest").to_numpy().astype(bool)
        bits = np.unpackbits(rows.column("fps").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(rep), -1), axis=1).astype(np.float32) * 2 - 1
        apart = (bits.shape[1] - bits @ bits.T) / 2
        x, y = np.nonzero(np.triu((apart <= most) & (rest[:, None] | rest), 1))
        order = np.argsort(apart[x, y], kind="stable")
        lists = rows.column("shingles").combine_chunks()
        every, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        root = list(range(len(rep)))
        links = []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        core = np.flatnonzero(~rest).tolist()
        for k in core:  # a core hangs together as it is
            root[k] = core[0]
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            if find(a) != find(b):
                one, two = every[ends[a] : ends[a + 1]], every[ends[b] : ends[b + 1]]
                if (n := len(np.intersect1d(one, two, assume_unique=True))) >= least * (len(one) + len(two) - n):
                    root[find(a)] = find(b)
                    links.append((rep[a], rep[b]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return cut(stars.unionByName(rows.groupBy("crowd", "i", "j").applyInArrow(run, "a long, b long")))


def other_pairs(rows: DataFrame, settings: Settings) -> DataFrame:
    """a, b: members of a bucket that aren't of one crowd, where their first checks are near enough; two that link are in most of the buckets that they share."""
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.col("x.crowd").isNull() | F.col("y.crowd").isNull() | (F.col("x.crowd") != F.col("y.crowd"))
    near = _apart(F.col("x.c0"), F.col("y.c0")) <= settings.radius(BITS, 1.5)
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & apart & near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """rep, shingles of the wanted(rep, digest, th) texts."""
    th = wanted.select("th").distinct()
    th = F.broadcast(th) if wanted.count() <= FEW else th
    found = docs.select(F.xxhash64("text").alias("th"), "text").join(th, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t, settings.shingle_words) for t in texts(b, "text")]
            yield batch_of([[d for d, _ in made], lists([h for _, h in made])], _SETS)

    # another text of equal th would have another digest
    return wanted.select("rep", "digest").join(found.select("text").mapInArrow(run, "digest binary, shingles array<long>"), "digest").select("rep", "shingles")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose shingles are similar enough, after a look at their whole fingerprints."""
    fps = reps.select("rep", "fps")
    bits = F.aggregate(F.zip_with("fps", "fps_b", _apart), F.lit(0), lambda n, x: n + x)
    both = split_join(pairs, fps.withColumnRenamed("rep", "a"), "a", ["b"])
    both = split_join(cut(both), fps.withColumnsRenamed({"rep": "b", "fps": "fps_b"}), "b", ["a"])
    near = cut(both.where(bits <= settings.radius(BITS * settings.words, 3.0)).select("a", "b"))
    rep = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = cut(shingle_sets(docs, cut(reps.join(rep, "rep").select("rep", "digest", "th")), settings))
    both = split_join(near, sets.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a", ["b"])
    both = split_join(cut(both), sets.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b", ["a"])
    common = F.size(F.array_intersect("x", "y"))
    similar = common >= F.lit(settings.similarity) * (F.size("x") + F.size("y") - common)
    return cut(both.where(similar).select("a", "b"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, component_id; one row for each row.

    Two texts link if they share at least settings.similarity of their distinct
    shingles, or have the same words but for case and white space; so all texts
    without a word link, null ones too. component_id is the smallest doc_id that
    links lead to, null only where no row of the component has one. Other columns
    are ignored. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marked = cut(fingerprints(docs, settings))
    # equal texts are one from here on
    reps = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.first("fps").alias("fps"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    n, both = bit_statistics(reps, settings.words)
    if not n:
        return marked.select("doc_id", F.col("doc_id").alias("component_id"))
    groups = plan(n, both, settings)
    few = groups[:: max(1, len(groups) // settings.star_groups)]
    inside = crowds(members(reps, few, settings), settings)
    links = crowd_links(inside, reps, docs, settings)
    labelled = cut(reps.join(inside.drop("size"), "rep", "left"))
    others = verified(cut(other_pairs(members(labelled, groups, settings, CHECKS[:1], "crowd"), settings)), reps, docs, settings)
    found = components(links.unionByName(others)).withColumnsRenamed({"node": "rep"})
    joined = cut(reps.select("digest", "first", "rep").join(found, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    by_text = split_join(joined, least, "label", ["rep"]).select("digest", "component_id")
    return split_join(marked.select("doc_id", "digest"), cut(by_text), "digest", ["doc_id"]).select("doc_id", "component_id")
