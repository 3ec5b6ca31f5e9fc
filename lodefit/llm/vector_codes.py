"""Vector code compression: product quantization whose nearest entries are found by annular norm pruning.

By the triangle inequality an entry nearer to a part than d has a norm within d
of the part's. Entries lie sorted by norm; those next to the part's norm give a
first best distance, a binary search finds the interval of norms that it allows,
ends included, and only the entries of that annulus are compared, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefit.functions.shared import written
from lodefit.functions.skew import split_join
from lodefit.llm.common import FEW, batch_of, small_batches, table

_OUT = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
#: Rows whose annuli are taken together; they are neighbours by norm, so the annuli overlap.
TOGETHER = 32
#: Entries on either side of a part's norm that give the first best distance.
NEAR = 4


@dataclass(frozen=True)
class Settings:
    """parts of a vector, entries of a part's codebook (up to 256: two hex digits), rounds of the fit, and what one is worth in integers."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


class Codebook:
    """One part's entries, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.sorted = entries[self.order]
        self.squares = (self.sorted * self.sorted).sum(1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, the smaller of equals; squared distance) of each row.

        rows and entries are integers, held as int64 or, while sums of squares stay below 2^53, as float64: exact either way.
        """
        found, least = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        squares = (rows * rows).sum(1)
        norms = np.sqrt(squares.astype(np.float64))
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, len(rows), TOGETHER):
            some = by_norm[at : at + TOGETHER]
            part, norm = rows[some], norms[some]
            first = min(max(0, np.searchsorted(self.norms, norm[0]) - NEAR), max(0, len(self.norms) - 2 * NEAR))
            to = max(np.searchsorted(self.norms, norm[-1]) + NEAR, first + 1)
            best = self._squared(part, squares[some], slice(first, to)).min(1)
            reach = np.sqrt(best.astype(np.float64))
            slack = 1e-9 * (1 + norm + reach)  # rounded norms must not shut out an entry on the border
            low = np.searchsorted(self.norms, norm - reach - slack, "left")
            high = np.searchsorted(self.norms, norm + reach + slack, "right")
            ring = slice(low.min(), high.max())
            d = self._squared(part, squares[some], ring)
            best = d.min(1)
            found[some] = np.where(d == best[:, None], self.order[ring], len(self.order)).min(1)
            least[some] = best
        return found, least

    def _squared(self, rows: np.ndarray, squares: np.ndarray, ring: slice) -> np.ndarray:
        return squares[:, None] - 2 * (rows @ self.sorted[ring].T) + self.squares[ring]


def whole(vector: Column) -> Column:
    """True for a vector that isn't null and has neither null nor non-finite components."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, plain), F.lit(False))


@dataclass(frozen=True)
class Shape:
    """Components of a padded vector, and the number kind that holds sums of their squares exactly."""

    width: int
    kind: type

    @classmethod
    def of(cls, vectors: DataFrame, settings: Settings) -> Shape:
        size, most = vectors.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
        width = -(-(size or 0) // settings.parts) * settings.parts
        bound = 4 * max(1, width) * (settings.scale * int(most or 0) + settings.scale + 1) ** 2
        if bound >= 1 << 62:
            raise ValueError("components are too large for squared distances in longs")
        return cls(width, np.float64 if bound < 1 << 53 else np.int64)

    def integers(self, column: pa.Array, settings: Settings) -> np.ndarray:
        """A list column as rows of floor(scale * x), short vectors filled with zeros."""
        flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * settings.scale).astype(self.kind)
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        if len(lengths) and (lengths == self.width).all():
            return flat.reshape(len(lengths), self.width)
        rows = np.zeros((len(lengths), self.width), self.kind)
        rows[np.arange(self.width) < lengths[:, None]] = flat
        return rows


def _assign(vectors: DataFrame, books: np.ndarray, shape: Shape, settings: Settings, kinds: str, made, done=None) -> DataFrame:
    """mapInArrow with made(batch, rows by part, entries, squared distances) -> batch or None, then done() at a task's end."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # parts * entries * width / parts integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b.astype(shape.kind)) for b in sent.value]
        state: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            rows = shape.integers(b.column(0), settings).reshape(b.num_rows, settings.parts, shape.width // settings.parts)
            parts = [np.ascontiguousarray(rows[:, p]) for p in range(settings.parts)]
            got = [t.nearest(x) for t, x in zip(tables, parts, strict=True)]
            out = made(b, parts, [g[0] for g in got], [g[1] for g in got], state)
            if out is not None:
                yield out
        if done is not None and state:
            yield done(state)

    return vectors.mapInArrow(run, kinds)


def move(vectors: DataFrame, books: np.ndarray, shape: Shape, settings: Settings) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floor of its parts' mean, unused ones stay.

    A task hands on one sum for each entry it has used, and Spark adds them up.
    """

    def made(_, parts, entries, __, state):
        for p, (x, at) in enumerate(zip(parts, entries, strict=True)):
            n, total = state.setdefault(p, (np.zeros(books.shape[1], np.int64), np.zeros(books.shape[1:], np.int64)))
            n += np.bincount(at, minlength=len(n))
            np.add.at(total, at, x.astype(np.int64))

    def done(state):
        found = [(p, i, int(n[i]), total[i].tolist()) for p, (n, total) in sorted(state.items()) for i in np.flatnonzero(n)]
        return batch_of([[f[k] for f in found] for k in range(4)], _SUMS)

    sums = _assign(vectors.select("embedding"), books, shape, settings, "part int, entry int, n long, total array<long>", made, done)
    width = books.shape[2]
    each = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
    moved = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts * entries rows at most
        moved[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return moved


def fit(vectors: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, Shape]:
    """Codebooks (parts x entries x width of a part) of vectors(vec_id, embedding), and their shape.

    They start as the vectors of the smallest ids (null ids last, equal ids by
    their components) and take settings.rounds rounds over all vectors. Fewer
    vectors than entries make fewer entries. Shorter vectors count as filled up
    with zeros to the longest one's length, rounded up to a multiple of parts.
    Components so large that squared distances don't fit in longs raise ValueError.
    """
    if not 1 <= settings.entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    small_batches(vectors.sparkSession)
    vectors = vectors.where(whole(F.col("embedding")))
    shape = Shape.of(vectors, settings)
    first = [r["embedding"] for r in vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(settings.entries).collect()]
    start = shape.integers(pa.array(first, pa.list_(pa.float64())), settings).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), settings.parts, shape.width // settings.parts).transpose(1, 0, 2))
    for _ in range(settings.rounds if first else 0):
        books = move(vectors, books, shape, settings)
    return books, shape


def encode(vectors: DataFrame, books: np.ndarray, shape: Shape, settings: Settings = Settings()) -> DataFrame:
    """vectors(vec_id, label, embedding) -> vec_id, label (as text), code, error; vectors that aren't whole are left out.

    code has two hex digits for each part; error is the squared distance to the coded vector in scaled integers.
    """
    small_batches(vectors.sparkSession)

    def made(b, _, entries, errors, __):
        codes = np.stack(entries, 1).astype(np.uint8)
        text = codes.tobytes().hex()
        wide = 2 * settings.parts
        return batch_of([b.column(1), b.column(2), [text[i : i + wide] for i in range(0, len(text), wide)], np.sum(errors, axis=0)], _OUT)

    rows = vectors.where(whole(F.col("embedding"))).select("embedding", F.col("vec_id").cast("long"), F.col("label").cast("string"))
    return _assign(rows, books, shape, settings, "vec_id long, label string, code string, error long", made)


def decode(codes: DataFrame, books: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """codes with a column code -> the same with vector, the coded vector's components: entries looked up by part and divided by scale."""
    tables = [F.array(*[F.array(*[F.lit(float(x) / settings.scale) for x in e]) for e in book]) for book in books]
    digit = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[t[digit(p)] for p, t in enumerate(tables)]))


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded(label, error) with label_error, the sum of error over equal labels, nulls together.

    Labels are summed with partial sums first. Up to FEW of them, counted, are
    broadcast; more are joined by exchange, rows of a common label dealt to several tasks.
    """
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = written(keyed.groupBy("_label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= FEW:
        return keyed.join(F.broadcast(sums), "_label").drop("_label")
    return split_join(keyed, sums, "_label", ["vec_id", "code", "error"]).drop("_label")


def compress(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256.

    One row for each row whose vector is whole; repeated ids are rows of their
    own, an empty table gives no rows. Other columns are ignored. The table is
    read once for its shape, once for the first entries, once a round and once
    to be coded; the codes are written before their labels' sums are taken.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    books, shape = fit(vectors, settings)
    coded = with_label_errors(written(encode(vectors, books, shape, settings)))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(s: Settings = Settings()) -> str:
    """The same in DuckDB: each round a common table expression of the one before."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {s.parts}) + 1 : (p + 1) * (len(v) // {s.parts})] AS x FROM kept, range({s.parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {s.entries}))",
    ]
    near = "near{k} AS MATERIALIZED (SELECT c.vec_id, c.label, c.p, c.x, min((CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), b.e)) AS best FROM cut c JOIN book{k} b USING (p) GROUP BY ALL)"
    for k in range(s.rounds):
        steps.append(near.format(k=k))
        steps.append(
            f"mean{k} AS (SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM (SELECT p, best[2] AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i) GROUP BY ALL) GROUP BY ALL)"
        )
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (p, e))")
    last = s.rounds
    steps.append(near.format(k=last))
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{last} GROUP BY ALL)")
    sha = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{last})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {sha} AS codebooks_sha256 FROM coded"


OP11_SQL = _sql()
