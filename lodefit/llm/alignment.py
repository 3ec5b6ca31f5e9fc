"""Cross-tokenizer alignment: groups of the tokens of two tokenizers that cover the same bytes, and the links within them.

Python makes the tokens, Spark's functions of arrays align them. The byte offsets
where tokens of both sides end cut a text into groups. A token is one number, its
end above its id, and an end is the number of a token there with the largest id.
So sorting the tokens of a side together with the ends that both sides share puts
a mark behind the last token of each group, and the groups can be read off.

Texts are cut into chunks at ends that both sides share whatever the text, so no
group goes over a cut, and a task aligns a chunk once: numbered hands on each text
as numbers of chunks, with the tokens of those that the task hasn't met; align
finds their groups; together, in the same task and order, keeps them by number and
reads each text's off.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodefit.functions.shared import written
from lodefit.functions.skew import split_join
from lodefit.llm.bpe import byte_letters
from lodefit.llm.common import FEW, give_back, kept, small_batches, table, texts

#: Bits of a packed token that hold its id; all ones mark the end of a group.
ID_BITS = 20
MARK = (1 << ID_BITS) - 1
#: Chunks that a task numbers before it begins anew, and characters of them.
KEPT_CHUNKS = 600_000
KEPT_TEXT = 8 << 20
#: Tokens, chunks or kinds of groups of one batch that a worker hands on.
OUT_TOKENS = 1 << 20
#: Characters of a group from which on its ids are made distinct before they are paired.
LONG_KIND = 200
#: Bytes of the groups that are broadcast with what is known of them, at most.
FEW_BYTES = 32 << 20
_BROKEN = array("i", [-1]).tobytes()
_WHITE = "\t\n\x0b\x0c\r\x85\xa0  -     　"
#: A space, white space, and words up to a space that follows a word.
_CHUNK = re.compile(f" [ {_WHITE}]*(?:[^ {_WHITE}]++[{_WHITE}][ {_WHITE}]*)*[^ {_WHITE}]*")
#: Characters that every Unicode version takes for the same kind.
_PLAIN = re.compile("[\x00-ɏ‐-‧‰-›€]*")
_WHITE_SPACE = frozenset(f" {_WHITE}")
#: The pieces of byte-level texts: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Files:
    """Side A: a byte-level BPE as the tokenizers library keeps it; side B: a sentencepiece BPE with byte fallback."""

    a: str
    b: str

    @classmethod
    def of(cls, spark: SparkSession) -> Files:
        """The settings lodefit.tokenizer.a and .b, else the public ones."""
        import public_tokenizers

        given = lambda side, name: spark.conf.get(f"lodefit.tokenizer.{side}", None) or public_tokenizers.path(name)
        return cls(given("a", "byte_bpe_50k.json"), given("b", "piece_bpe_32k.model"))


class Sides:
    """Tokens of both sides, chunk by chunk.

    No token of A's pieces, and no piece of B's vocabulary, goes on from a letter
    to a space, so a text may be cut there and its chunks be encoded once.
    """

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this worker one core
        with open(files.a, encoding="utf-8") as f:
            model = json.load(f)
        cut = model["pre_tokenizer"]
        if model["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("side A must be a byte-level BPE without a normalizer")
        self.exact = Tokenizer.from_file(files.a)
        self.exact.encode_special_tokens = True
        self.exact.no_truncation()
        self.exact.no_padding()
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        merged = [vocabulary[x] for x in ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"])]
        # where merges stand in the order of ids, ids are ranks
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocabulary.items()}, special_tokens={}) if merged == sorted(merged) and len(merged) + 256 == len(vocabulary) else None
        self.a_raw = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_raw[i] = bytes(byte[c] for c in t)
        self.a_bytes = np.array([len(r) for r in self.a_raw], np.int64)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("a piece of side B goes on over a space")
        self.space = [self.pieces.piece_to_id("▁")]
        self.b_raw = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.b_bytes = np.array([len(r) for r in self.b_raw], np.int64)
        if max(len(self.a_bytes), len(names)) >= MARK:
            raise ValueError("too many ids")

    def encode_a(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, of so many bytes, one after another, and how many each has.

        Chunks of characters that no library reads otherwise, and that don't end in white space, are encoded in one go.
        """
        if self.ranked is None:
            plain = np.zeros(len(chunks), bool)
        elif _PLAIN.fullmatch("".join(chunks)):
            plain = np.array([c[-1] not in _WHITE_SPACE for c in chunks])
        else:
            plain = np.array([c[-1] not in _WHITE_SPACE and _PLAIN.fullmatch(c) is not None for c in chunks])
        together = list(compress(chunks, plain))
        ids = np.array(self.ranked.encode_ordinary("".join(together)) if together else [], np.int32)
        stops = np.searchsorted(np.cumsum(self.a_bytes[ids]), np.cumsum(sizes[plain]), "right")
        counts = np.zeros(len(chunks), np.int64)
        counts[plain] = np.diff(stops, prepend=0)
        if len(together) == len(chunks):
            return ids, counts
        rest = [np.array(e.ids, np.int32) for e in self.exact.encode_batch(list(compress(chunks, ~plain)), add_special_tokens=False)]
        counts[~plain] = [len(r) for r in rest]
        parts, other = iter(np.split(ids, stops[:-1]) if together else []), iter(rest)
        return np.concatenate([next(parts) if p else next(other) for p in plain]), counts

    def learn(self, chunks: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of both sides of chunks, as bytes; of one whose bytes come out otherwise, -1 on side A."""
        if not chunks:
            return
        b_lists = self.pieces.encode([c[1:] for c in chunks], num_threads=1)  # the library puts a space before
        b_lists = [x or self.space for x in b_lists]  # but not before nothing
        encoded = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, encoded), np.int64, len(chunks))
        a, n_a = self.encode_a(chunks, sizes)
        b, n_b = np.fromiter(chain.from_iterable(b_lists), np.int32), np.fromiter(map(len, b_lists), np.int64, len(chunks))
        a_raw, b_raw = (b"".join(map(raw.__getitem__, ids.tolist())) for raw, ids in ((self.a_raw, a), (self.b_raw, b)))
        # where each chunk's ids and bytes stop
        (a_at, a_to), (b_at, b_to) = ([np.concatenate([[0], x])[np.cumsum(n)] for x in (np.arange(4, 4 * len(ids) + 4, 4), np.cumsum(size[ids]))] for ids, size, n in ((a, self.a_bytes, n_a), (b, self.b_bytes, n_b)))
        stops, a_ids, b_ids = np.cumsum(sizes), a.tobytes(), b.tobytes()
        i = j = x = y = 0
        if a_raw == b_raw == b"".join(encoded) and (a_to == stops).all() and (b_to == stops).all():
            for i_to, j_to in zip(a_at.tolist(), b_at.tolist(), strict=True):
                yield a_ids[i:i_to], b_ids[j:j_to]
                i, j = i_to, j_to
            return
        for raw, i_to, x_to, j_to, y_to in zip(encoded, a_at.tolist(), a_to.tolist(), b_at.tolist(), b_to.tolist(), strict=True):
            yield (a_ids[i:i_to], b_ids[j:j_to]) if a_raw[x:x_to] == raw == b_raw[y:y_to] else (_BROKEN, b"")
            i, j, x, y = i_to, j_to, x_to, y_to

    def packed(self, found: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ends, tokens) of A and of B of the chunks with these ids, one after another."""
        a, b = (np.frombuffer(b"".join([f[k] for f in found]), np.int32) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_bytes[a]) << ID_BITS, np.cumsum(self.b_bytes[b]) << ID_BITS
        return a_ends | MARK, a_ends | a, b_ends | MARK, b_ends | b

    def tokens(self, rows: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ends, tokens) of A and of B of each text, packed; empty if it is null, empty or doesn't come out the same."""
        cut = [_CHUNK.findall(" " + t) if t else [] for t in rows]
        used = list(set().union(*cut))
        known = dict(zip(used, self.learn(used), strict=True))
        for chunks in cut:
            found = [known[c] for c in chunks]
            yield self.packed([] if any(f[0] == _BROKEN for f in found) else found)


class Numbers:
    """Numbers of the chunks that a task meets, from 0 in the order of their first places; they begin anew when there are more than most, or too long ones."""

    def __init__(self, most: int):
        self.most = most
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # the next one
        self.chars = 0
        self.broken: set[int] = set()

    def of(self, text: str | None) -> tuple[bool, list[int], int, list[str]]:
        """Whether numbers begin anew, those of this text's chunks, the next number before, and the chunks that are met first here."""
        anew = len(self.number) > self.most or self.chars > KEPT_TEXT
        if anew:
            self.number.clear()
            self.chars = 0
        before = len(self.number)
        own = list(map(self.number.__getitem__, _CHUNK.findall(" " + text))) if text else []
        new = list(islice(reversed(self.number), len(self.number) - before))[::-1]
        self.chars += sum(map(len, new))
        return anew, own, before, new

    def rows(self, sides: Sides, some: list[str | None]) -> Iterator[tuple[bool, list[int], list[int], list[int], np.ndarray, tuple[np.ndarray, ...]]]:
        """Of each text: whether numbers begin anew, its chunks, none if it doesn't come out the same; of those met first here n_a, n_b, packed ends and all tokens."""
        found = [self.of(t) for t in some]
        learned = sides.learn([c for *_, new in found for c in new])
        for anew, own, before, new in found:
            if anew:
                self.broken.clear()
            ids = list(islice(learned, len(new)))
            self.broken.update(before + k for k, x in enumerate(ids) if x[0] == _BROKEN)
            ids = [(b"", b"") if x[0] == _BROKEN else x for x in ids]
            if not self.broken.isdisjoint(own):
                own = []
            n_a, n_b = ([len(x[k]) // 4 for x in ids] for k in (0, 1))
            packed = sides.packed(ids)
            yield anew, own, n_a, n_b, np.concatenate([[0], packed[0]])[np.cumsum(n_a, dtype=np.int64)], packed


class Met:
    """The groups of the chunks of a task by number: how many tokens and groups each has, and the kinds of its groups."""

    def __init__(self):
        self.kind: defaultdict[bytes, int] = defaultdict()
        self.kind.default_factory = self.kind.__len__
        self.names: list[bytes] = []
        self.n = 0
        self.sizes = np.zeros((1 << 12, 3), np.int32)
        self.stops = np.zeros(1 << 12, np.int64)
        self.kinds = np.zeros(1 << 12, np.int32)

    def add(self, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, groups: bytes) -> None:
        """The next chunks, with the text of their groups one after another."""
        parts = groups.split(b";") if groups else []
        at = int(self.stops[self.n - 1]) if self.n else 0
        to, end = self.n + len(n_a), at + len(parts)
        while to > len(self.stops):
            self.sizes, self.stops = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.stops))
        while end > len(self.kinds):
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        self.sizes[self.n : to] = np.column_stack([n_a, n_b, n_groups])
        self.stops[self.n : to] = at + np.cumsum(n_groups)
        self.kinds[at:end] = np.fromiter(map(self.kind.__getitem__, parts), np.int32, len(parts))
        self.names += list(islice(reversed(self.kind), len(self.kind) - len(self.names)))[::-1]
        self.n = to

    def of(self, chunks: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Of a text: n_a, n_b and n_groups; the text of its groups; the distinct kinds of them, and how often each is there."""
        sizes = self.sizes[chunks]
        counts = sizes[:, 2]
        # where each chunk's kinds begin, less how many come before it here
        shift = self.stops[chunks] - np.cumsum(counts, dtype=np.int64)
        kinds = self.kinds[np.arange(counts.sum()) + np.repeat(shift, counts)]
        text = b";".join(map(self.names.__getitem__, kinds.tolist()))
        kinds, times = np.unique(kinds, return_counts=True)
        return sizes.sum(0, dtype=np.int64), text, kinds, times


_NUMBERS, _COUNTS = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
_NUMBERED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("anew", T.BooleanType(), False), *[T.StructField(n, _COUNTS, False) for n in ("chunks", "chunk_a", "chunk_b")], *[T.StructField(n, _NUMBERS, False) for n in ("stops", "a_ends", "a", "b_ends", "b")]])
_TOGETHER = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType(), False) for n in ("n_a", "n_b", "n_groups")], T.StructField("groups", T.StringType(), False), T.StructField("groups_sha256", T.StringType(), False), T.StructField("kinds", T.ArrayType(T.StringType(), False), False), T.StructField("times", _COUNTS, False)])


def _lists_of(rows: list, kind: type) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate([np.asarray(r, kind) for r in rows])))


def _rows_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of numbers without nulls."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def numbered(docs: DataFrame, files: Files, most: int = KEPT_CHUNKS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, anew, chunks, chunk_a, chunk_b, stops, a_ends, a, b_ends, b: one row for each row, in the order of a task.

    chunks has the numbers of a text's chunks, from 0 again with a row that is anew.
    The others are of the chunks whose numbers come first in this row: how many
    tokens each has, where it stops, and their tokens one after another, where they
    end in bytes above a mark, and each its end above its id.
    """
    small_batches(docs.sparkSession)

    def batch(ids: pa.Array, found: list) -> pa.RecordBatch:
        columns = [_lists_of([f[k] for f in found], np.int32) for k in (1, 2, 3)]
        columns += [_lists_of([f[4] for f in found], np.int64), *(_lists_of([f[5][k] for f in found], np.int64) for k in range(4))]
        return pa.RecordBatch.from_arrays([ids, pa.array([f[0] for f in found]), *columns], _NUMBERED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, numbers = kept(("alignment", files), lambda: Sides(files)), Numbers(most)
        for b in batches:
            found, at, n = [], 0, 0
            for some in range(0, b.num_rows, 64):
                for row in numbers.rows(sides, texts(b.slice(some, 64), "text")):
                    found.append(row)
                    n += len(row[1]) + len(row[5][0]) + len(row[5][2])
                    if n > OUT_TOKENS:
                        yield batch(b.column(0)[at : at + len(found)], found)
                        at, found, n = at + len(found), [], 0
            if found:
                yield batch(b.column(0)[at:], found)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _NUMBERED)


def together(aligned: DataFrame, with_groups: bool = False) -> DataFrame:
    """numbered's rows as align gives them -> doc_id, n_a, n_b, n_groups, groups, groups_sha256, kinds, times; one row for each row.

    groups has `ids of A|ids of B` of each group in order, joined by semicolons, if
    it is asked for; the digest is that of this text, and empty without any group.
    kinds has the distinct groups, times how often each is there. Rows must come in
    the order that numbered made them in, with no exchange between.
    """

    def batch(ids: pa.Array, found: list, met: Met) -> pa.RecordBatch:
        names = pa.array(met.names, pa.binary()).cast(pa.string())
        kinds = _lists_of([f[2] for f in found], np.int32)
        sizes = np.array([f[0] for f in found]).reshape(-1, 3)
        groups = [f[1].decode() if with_groups else "" for f in found]
        digests = [sha256(f[1]).hexdigest() if f[1] else "" for f in found]
        columns = [ids, *(pa.array(sizes[:, k]) for k in range(3)), pa.array(groups), pa.array(digests), pa.ListArray.from_arrays(kinds.offsets, names.take(kinds.values)), _lists_of([f[3] for f in found], np.int32)]
        return pa.RecordBatch.from_arrays(columns, _TOGETHER.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for b in batches:
            ids, anew, groups = b.column(0), b.column(1).to_pylist(), b.column(b.schema.get_field_index("groups")).to_pylist()
            chunks, chunk_a, chunk_b, stops, ends = (_rows_of(b.column(b.schema.get_field_index(n))) for n in ("chunks", "chunk_a", "chunk_b", "stops", "ends"))
            found, at, n = [], 0, 0
            for k in range(b.num_rows):
                if found and (anew[k] or n > OUT_TOKENS):
                    yield batch(ids[at:k], found, met)
                    found, at, n = [], k, 0
                if anew[k]:
                    met = Met()
                if len(stops[k]):
                    met.add(chunk_a[k], chunk_b[k], np.diff(np.searchsorted(ends[k], stops[k], "right"), prepend=0), groups[k].encode())
                found.append(met.of(chunks[k]))
                n += len(found[-1][2])
            if found:
                yield batch(ids[at:], found, met)
        give_back()

    return aligned.select("doc_id", "anew", "chunks", "chunk_a", "chunk_b", "stops", "ends", "groups").mapInArrow(run, _TOGETHER)


def _lists(marked: str) -> Column:
    """A side's ids by group, each group's joined by commas: of tokens and shared ends, sorted, the last end is left out, and the others cut."""
    ids = F.transform(F.slice(marked, 1, F.size(marked) - 1), lambda x: x.bitwiseAND(F.lit(MARK)))
    return F.split(F.replace(F.array_join(ids.cast("array<string>"), ","), F.lit(f",{MARK},"), F.lit(";")), ";")


def align(tokens: DataFrame) -> DataFrame:
    """Rows with a_ends, a, b_ends, b -> the rows with ends and groups in their place.

    ends has the ends that both sides share, as a_ends has them, groups the
    `ids of A|ids of B` of each group in order, joined by semicolons.
    Tokens and ends are sorted in columns of their own, each used twice, since
    compiled code sorts numbers, and code beside a function of elements isn't compiled.
    """
    rest = [c for c in tokens.columns if c not in ("a_ends", "a", "b_ends", "b")]
    found = tokens.withColumn("ends", F.array_intersect("a_ends", "b_ends"))
    marked = found.select(*rest, "ends", *(F.sort_array(F.concat(c, "ends")).alias(f"{c}_marked") for c in ("a", "b")))
    groups = F.array_join(F.zip_with(_lists("a_marked"), _lists("b_marked"), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    return marked.select(*rest, "ends", F.when(F.size("a_marked") > 0, groups).otherwise("").alias("groups"))


def _ids(kind: Column, side: int) -> Column:
    return F.split(F.substring_index(kind, "|", -1 if side else 1), ",")


def _pairs(kind: Column) -> Column:
    """All `a|b` of a group, joined by commas: for each a, the text of the b with `a|` before each."""
    b = F.substring_index(kind, "|", -1)
    return F.array_join(F.transform(_ids(kind, 0), lambda x: F.concat(x, F.lit("|"), F.replace(b, F.lit(","), F.concat(F.lit(","), x, F.lit("|"))))), ",")


def _distinct(kind: Column) -> Column:
    """A group with each of its ids once."""
    return F.concat(F.array_join(F.array_distinct(_ids(kind, 0)), ","), F.lit("|"), F.array_join(F.array_distinct(_ids(kind, 1)), ","))


def kind_counts(aligned: DataFrame) -> DataFrame:
    """aligned(kinds) -> kind, n: the rows that hold it; counts combine before they are exchanged."""
    return written(aligned.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")))


def pair_counts(aligned: DataFrame, kinds: DataFrame) -> DataFrame:
    """aligned(kinds), kinds from kind_counts -> pair (`a|b`), n: the rows that hold it linked, best: the largest n of its A id.

    A group of one token on either side is its own pair. Pairs from larger groups
    count where the row doesn't hold them so, each once; counts combine before they are exchanged.
    """
    several = lambda k: F.contains(k, F.lit(","))
    # the text of what has several tokens becomes pairs, and one cut serves all of a row
    made = F.transform(F.filter("kinds", several), lambda k: _pairs(F.when(F.length(k) > LONG_KIND, _distinct(k)).otherwise(k)))
    pairs = F.array_except(F.split(F.array_join(made, ","), ","), F.col("kinds"))
    other = aligned.select(F.explode(pairs).alias("pair")).where("pair <> ''").groupBy("pair").agg(F.count("*").alias("n"))
    single = kinds.where(~several(F.col("kind"))).select(F.col("kind").alias("pair"), "n")
    counts = written(single.unionByName(other).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.substring_index("pair", "|", 1)))
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("best")), "a").select("pair", "n", "best")


def kind_links(kinds: DataFrame, counts: DataFrame) -> DataFrame:
    """kinds from kind_counts, counts from pair_counts -> kind, links, best_links, links_sum: of all pairs of occurrences in one group of this kind."""
    times = lambda ids, x: F.aggregate(ids, F.lit(0).cast("long"), lambda n, y: n + (y == x).cast("long"))
    sides = kinds.select("kind", _ids(F.col("kind"), 0).alias("a"), _ids(F.col("kind"), 1).alias("b")).withColumns({"da": F.array_distinct("a"), "db": F.array_distinct("b")})
    spots = sides.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("da")))).withColumn("x", F.element_at("da", F.col("i")))
    spots = spots.withColumn("y", F.explode("db")).select("kind", F.concat("x", F.lit("|"), "y").alias("pair"), (times(F.col("a"), F.col("x")) * times(F.col("b"), F.col("y"))).alias("w"))
    known = split_join(spots, counts, "pair", ["kind"])
    return known.groupBy("kind").agg(F.sum("w").alias("links"), F.sum(F.when(F.col("n") == F.col("best"), F.col("w")).otherwise(0)).alias("best_links"), F.sum(F.col("w") * F.col("n")).alias("links_sum"))


def link_sums(aligned: DataFrame, kinds: DataFrame) -> DataFrame:
    """aligned(row, kinds, times), kinds from kind_links -> row, n_links, n_best, count_sum of the rows that have groups.

    Up to FEW kinds of FEW_BYTES in all, both counted, are broadcast; more are
    joined by exchange, common kinds dealt to several tasks.
    """
    each = aligned.select("row", F.inline(F.arrays_zip(F.col("kinds").alias("kind"), "times")))
    n, size = kinds.agg(F.count("*"), F.sum(F.length("kind"))).first()
    if n <= FEW and (size or 0) <= FEW_BYTES:
        known = each.join(F.broadcast(kinds), "kind")
    else:
        known = split_join(each, kinds, "kind", ["row"])
    times = F.col("times")
    return known.groupBy("row").agg(F.sum(F.col("links") * times).alias("n_links"), F.sum(F.col("best_links") * times).alias("n_best"), F.sum(F.col("links_sum") * times).alias("count_sum"))


def alignment(docs: DataFrame, files: Files, most: int = KEPT_CHUNKS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum; one row for each row.

    Null and empty texts, and those whose tokens don't come out as a space and the
    text, have no tokens: counts of 0 and an empty digest. Rows of one doc_id are
    documents of their own. Other columns are ignored; an empty table gives no rows.
    A task keeps up to most chunks. What is known of texts is written once; links are
    counted by kind of group, of which a corpus has few, and not by occurrence.
    The groups themselves are those of groups_of.
    """
    aligned = written(together(align(numbered(docs, files, most))).drop("groups").withColumn("row", F.monotonically_increasing_id()), "zstd")
    kinds = kind_counts(aligned)
    kinds = written(kind_links(kinds, pair_counts(aligned, kinds)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("kinds", "times").join(link_sums(aligned, kinds), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def groups_of(docs: DataFrame, files: Files, most: int = KEPT_CHUNKS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, groups: the `ids of A|ids of B` of each group in order."""
    found = together(align(numbered(docs, files, most)), with_groups=True)
    return found.select("doc_id", F.when(F.col("groups") == "", F.array().cast("array<string>")).otherwise(F.split("groups", ";")).alias("groups"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), Files.of(spark))
