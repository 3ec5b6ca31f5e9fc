"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

Documents are dealt to chunks. A chunk sends each of its distinct window hashes
once, with the smallest doc_id that has it, packed by hash range; so a passage
that a third of all documents share weighs a chunk's worth of bytes, not theirs.
Each hash range tells the chunks which of their windows start in a smaller
document elsewhere, and the chunks merge repeated windows into removal intervals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefit.llm.common import batch_of, small_batches, table, texts

#: An odd base: two windows that differ in one word never share a hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("windows", pa.list_(pa.binary()))])
_SEEN = pa.schema([("chunk", pa.int64()), ("hashes", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


@dataclass(frozen=True)
class Settings:
    """chunk_bytes of text and range_windows of hashes are what one group holds at the size of base_bytes.

    Both grow with the square root of the size, so that the messages between them
    grow with the size alone, up to what a worker can hold: most_growth times as
    much. Beyond that size, 32 GB by default, messages grow with its square again;
    with larger workers, raise it. A range is met in blocks of block_windows.
    """

    window: int = 13
    chunk_bytes: int = 8 << 20
    range_windows: int = 2 << 20
    base_bytes: int = 512 << 20
    most_growth: float = 8.0
    block_windows: int = 1 << 20

    def layout(self, size: int, least: int) -> tuple[int, int, int]:
        """(chunks, hash ranges, blocks of a range) for size bytes of text; least: tasks that are wanted."""
        growth = min(self.most_growth, max(1.0, math.sqrt(size / self.base_bytes)))
        chunks = max(2 * least, math.ceil(size / (self.chunk_bytes * growth)))
        ranges = max(least, math.ceil(size / 6 / (self.range_windows * growth)))
        return chunks, ranges, max(1, math.ceil(size / 6 / ranges / self.block_windows))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at \x20 and \x09-\x0D alone


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """The rolling hash of each run of window words, modulo 2**64."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    found = codes[:n].copy()
    for i in range(1, window):
        found *= BASE
        found += codes[i : i + n]
    return found ^ (found >> np.uint64(29))


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def pack(hashes: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted distinct hashes, as differences, with the doc_id of each, in byte planes."""
    low = int(ids.min())
    (wide, a), (narrow, b) = _planes(np.diff(hashes, prepend=np.uint64(0))), _planes((ids - low).astype(np.uint64))
    head = np.array([len(hashes), wide, narrow, low], "<i8").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(a + b)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, narrow, low = np.frombuffer(raw[:32], "<i8")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[32:]), np.uint8).reshape(-1, n)
    full = np.zeros((n, 16), np.uint8)
    full[:, :wide] = body[:wide].T
    full[:, 8 : 8 + narrow] = body[wide : wide + narrow].T
    both = full.view("<u8")
    return np.cumsum(both[:, 0], dtype=np.uint64), both[:, 1].astype(np.int64) + low


def first_ids(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the smallest id of each."""
    order = np.argsort(hashes, kind="stable")
    hashes, ids = hashes[order], ids[order]
    at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    return hashes[at], np.minimum.reduceat(ids, at) if len(at) else ids


def _chunk_windows(rows: pa.Table, window: int) -> tuple[list[list[bytes]], list[np.ndarray], np.ndarray, np.ndarray]:
    """Words and window hashes of each document, and the chunk's distinct hashes with their smallest id."""
    words = [words_of(t.as_py()) for t in rows.column("text")]
    hashes = [window_hashes(w, window) for w in words]
    named = [(h, i.as_py()) for h, i in zip(hashes, rows.column("doc_id"), strict=True) if i.is_valid and len(h)]
    every = np.concatenate([h for h, _ in named]) if named else np.empty(0, np.uint64)
    ids = np.repeat(np.array([i for _, i in named], np.int64), [len(h) for h, _ in named])
    return words, hashes, *first_ids(every, ids)


def send(rows: pa.Table, parts: int, blocks: int, window: int) -> pa.Table:
    """A chunk's distinct windows: a message for each hash range, packed block by block."""
    _, _, hashes, ids = _chunk_windows(rows, window)
    block = ((hashes >> np.uint64(32)) * np.uint64(parts * blocks)) >> np.uint64(32)
    at = np.searchsorted(block, np.arange(parts * blocks + 1, dtype=np.uint64))
    used = np.unique(block // np.uint64(blocks)).astype(int).tolist()
    packed = [[pack(hashes[at[k] : at[k + 1]], ids[at[k] : at[k + 1]]) if at[k] < at[k + 1] else b"" for k in range(p * blocks, (p + 1) * blocks)] for p in used]
    chunk = rows.column("chunk")[0].as_py()
    return pa.Table.from_batches([batch_of([used, [chunk] * len(used), packed], _SENT)])


def meet(rows: pa.Table) -> pa.Table:
    """For each chunk, the hashes of one range that start in a smaller document of another chunk; one block is unpacked at a time."""
    messages, chunks = rows.column("windows").combine_chunks(), rows.column("chunk").to_numpy()
    offsets, packed = messages.offsets.to_numpy(), messages.values
    found: list[pa.RecordBatch] = []
    for k in range(int(offsets[1] - offsets[0])):
        raw = [packed[int(i) + k].as_py() for i in offsets[:-1]]
        has = [i for i, x in enumerate(raw) if x]
        if len(has) > 1:
            found.append(_meet([unpack(raw[i]) for i in has], chunks[has]))
    return pa.Table.from_batches(found, _SEEN)


def _meet(got: list[tuple[np.ndarray, np.ndarray]], chunks: np.ndarray) -> pa.RecordBatch:
    hashes = np.concatenate([h for h, _ in got])
    ids = np.concatenate([i for _, i in got])
    source = np.repeat(np.arange(len(got)), [len(h) for h, _ in got])
    order = np.argsort(hashes, kind="stable")
    hashes, ids, source = hashes[order], ids[order], source[order]
    start = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    least = np.minimum.reduceat(ids, np.flatnonzero(start))[np.cumsum(start) - 1]
    late = ids > least
    hashes, source = hashes[late], source[late]
    order = np.argsort(source, kind="stable")
    hashes, source = hashes[order], source[order]
    at, where = np.unique(source, return_index=True)
    return batch_of([chunks[at], [h.astype("<u8").tobytes() for h in np.split(hashes, where[1:])] if len(at) else []], _SEEN)


def covered(windows: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """The words that the marked windows cover; overlapping windows merge into maximal intervals."""
    step = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(windows)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def remove(rows: pa.Table, seen: pa.Table, window: int) -> Iterator[tuple[int | None, list[bytes], np.ndarray]]:
    """doc_id, words and the mask of removed words of each document of a chunk."""
    words, hashes, own, ids = _chunk_windows(rows, window)
    got = [np.frombuffer(x.as_py(), "<u8") for x in seen.column("hashes")]
    if got:  # what starts in a smaller document elsewhere does so for every document here
        early = np.sort(np.concatenate(got))
        ids = ids.copy()
        ids[np.searchsorted(own, early)] = np.iinfo(np.int64).min
    for doc_id, w, h in zip(rows.column("doc_id").to_pylist(), words, hashes, strict=True):
        mask = np.zeros(len(w), bool)
        if doc_id is not None and len(h):
            late = ids[np.searchsorted(own, h)] < doc_id
            if late.any():
                mask = covered(late, len(w), window)
        yield doc_id, w, mask


def dedup(docs: DataFrame, settings: Settings = Settings(), texts_out: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 [, kept_text]; one row for each row.

    A word goes if a window over it also starts in a document of smaller doc_id.
    Rows of equal doc_id don't remove each other's words; rows without a doc_id
    neither lose words nor make others lose any. Null and empty texts have no
    words. Kept words are joined by one space.
    """
    spark = docs.sparkSession
    small_batches(spark)
    window = settings.window
    # a text of window words has as many characters and the space between them, so a shorter one loses and takes nothing
    windowed = F.coalesce(F.octet_length("text") >= 2 * window - 1, F.lit(False))
    size = docs.where(windowed).agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    chunks, parts, blocks = settings.layout(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(1, chunks // 2)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    task = F.pmod("chunk", F.lit(tasks)).cast("int")  # dealt in turn, as a hash would give some tasks several times the mean
    dealt = docs.where(windowed).select(key, "doc_id", "text").withColumn("task", task).repartitionById(tasks, "task")
    sent = dealt.groupBy("task", "chunk").applyInArrow(lambda t: send(t, parts, blocks, window), "part int, chunk long, windows array<binary>")
    met = sent.repartitionById(parts, "part").groupBy("part").applyInArrow(meet, "chunk long, hashes binary")
    seen = met.withColumn("task", task).repartitionById(tasks, "task")
    out = pa.schema([*_OUT, ("kept_text", pa.string())]) if texts_out else _OUT

    def rows_of(found: Iterator[tuple[int | None, list[bytes], np.ndarray]]) -> pa.RecordBatch:
        made = []
        for doc_id, words, mask in found:
            kept = b" ".join(compress(words, ~mask)) if mask.any() else b" ".join(words)
            made.append((doc_id, len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts_out else [])))
        return batch_of([[x[i] for x in made] for i in range(len(out))], out)

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows_of(remove(rows, found, window) if len(rows) else iter(()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [words_of(t) for t in texts(b, "text")]
            yield rows_of((i, w, np.zeros(len(w), bool)) for i, w in zip(b.column(0).to_pylist(), whole, strict=True))

    form = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts_out
    long = dealt.groupBy("task", "chunk").cogroup(seen.groupBy("task", "chunk")).applyInArrow(finish, form)
    return long.unionByName(docs.where(~windowed).select("doc_id", "text").mapInArrow(short, form))


def op6_substring(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(list_aggregate(list_slice(w, i, i + 12), 'string_agg', ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
least_doc AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) <> max(doc_id)),
late AS (SELECT doc_id, i FROM win JOIN least_doc USING (h) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, (SELECT unnest(range(0, 13)) AS k)),
marks AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id
"""
