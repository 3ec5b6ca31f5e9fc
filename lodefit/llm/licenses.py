"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads the expressions behind tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefit.llm.common import batch_of, kept, small_batches, table

#: The phrases that count as base places, as words, and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the scan's own, as words, and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "no rights reserved": "public-domain",
    "unlicense org": "unlicense",
    "proprietary and confidential": "proprietary",
}
#: Tags, as words, that stand before a licence expression.
TAGS = ("spdx license identifier", "spdx licence identifier", "license expression", "licence expression")
#: How much a licence asks for, from 0 (nothing) to 1 (all rights kept), by the start of its identifier; the longest start that fits counts.
DEMANDS = {
    "public-domain": 0.05, "unlicense": 0.05, "cc0": 0.05, "0bsd": 0.05, "wtfpl": 0.05, "zlib": 0.1,
    "mit": 0.2, "isc": 0.2, "bsd": 0.2, "apache": 0.25, "cc-by": 0.3, "artistic": 0.3, "python": 0.25, "psf": 0.25,
    "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "lgpl": 0.55, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8, "sspl": 0.9,
    "cc-by-nd": 0.85, "cc-by-nc": 0.85, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.95, "reserved": 1.0, "proprietary": 1.0,
}
#: What an unknown identifier counts as.
UNKNOWN = 0.5
#: An exception (after "with") takes so much of what a licence asks for away.
EXCEPTION = 0.15

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Every byte that is no part of a word becomes a space; A-Z are lower-cased before.
_SPACES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_SIGN = re.compile(rb"\s{0,8}[:=]?[ \t\"']*")
#: The label of a tag whose expression can't be read.
UNREADABLE = "unreadable"
#: Precedence of the operators; a higher one binds first.
_BINDS = {"or": 1, "and": 2, "with": 3}


def demand_of(name: str) -> float:
    """What a single identifier asks for."""
    fits = [d for d in DEMANDS if name == d or name.startswith(d + "-")]
    return DEMANDS[max(fits, key=len)] if fits else UNKNOWN


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: how much it asks for, and its identifiers in order (lower-cased)."""

    demand: float
    names: tuple[str, ...]


def expression(raw: bytes, at: int = 0) -> tuple[list[str], int]:
    """The tokens, lower-cased, of the longest well-formed licence expression that stands on one line from at on, and where reading stopped."""
    found: list[str] = []
    whole, depth, operand = 0, 0, True
    while m := _TOKEN.match(raw, at):
        word = m[1].decode().lower()
        name = word if word in "()" else word.rstrip(".:-")  # a full stop ends the sentence, not the name
        if operand:
            if word == ")" or name in _BINDS:
                break
            depth += word == "("
            operand = word == "("
        elif word == ")":
            if not depth:
                break
            depth -= 1
        elif word in _BINDS:
            operand = True
        else:
            break
        found.append(name)
        at = m.end()
        if not operand and not depth:
            whole = len(found)
        if name != word:
            break
    return found[:whole], at


def evaluate(raw: bytes, at: int = 0) -> tuple[Terms | None, int]:
    """The terms of the licence expression at a place in raw, None if none is well-formed there, and where reading stopped.

    A shunting yard: operands go to one stack, operators wait on another until one
    comes that binds less. "or" leaves the choice, so it asks for the lesser of its
    sides; "and" asks for both, so the greater; "with" takes something away.
    """
    words, end = expression(raw, at)
    values: list[float] = []
    waiting: list[str] = []

    def apply() -> None:
        op, b, a = waiting.pop(), values.pop(), values.pop()
        values.append(min(a, b) if op == "or" else max(a, b) if op == "and" else max(0.0, a - EXCEPTION))

    for word in words:
        if word == "(":
            waiting.append(word)
        elif word == ")":
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif word in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                apply()
            waiting.append(word)
        else:
            values.append(demand_of(word))
    while waiting:
        apply()
    names = tuple(dict.fromkeys(w for w in words if w not in _BINDS and w not in "()"))
    return (Terms(values[0], names) if values else None), end


@dataclass(frozen=True)
class Finding:
    """kind is base, notice or tag; first and last are word numbers, from 0, of the phrase or tag; labels are what it says."""

    kind: str
    labels: tuple[str, ...]
    first: int
    last: int
    demand: float


class Scanner:
    """Finds licence notices and tags in texts."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS):
        said: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
            for phrase, label in phrases.items():
                said.setdefault(phrase, []).append((kind, label))
        self.automaton = ahocorasick.Automaton()
        for phrase, found in said.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase.split()), found))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[Finding]]:
        """The number of words of a text in UTF-8, and its findings in order of their last words.

        A letter of bytes stands for a byte, so that words are compared byte by byte.
        """
        lower = raw.lower()  # of bytes: A-Z only
        words = lower.translate(_SPACES).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found: list[Finding] = []
        tags: list[tuple[int, int]] = []
        at = last = 0
        for end, (size, said) in self.automaton.iter(line):
            last += line.count(" ", at, end)
            at = end
            for kind, label in said:
                if kind == "tag":
                    tags.append((last - size, last - 1))
                else:
                    found.append(Finding(kind, (label,), last - size, last - 1, demand_of(label)))
        if tags:
            found += self._tagged(raw, lower, sorted({last: first for first, last in tags}.items()))
        return len(words), sorted(found, key=lambda f: (f.last, f.first, f.kind, f.labels))

    def _tagged(self, raw: bytes, lower: bytes, tags: list[tuple[int, int]]) -> Iterator[Finding]:
        """What stands behind tags, whose words are looked up in one walk along the text; a tag inside an expression is part of it."""
        walk, passed, read = _WORD.finditer(lower), 0, 0
        for last, first in tags:
            behind = next(islice(walk, last - passed, None)).end()
            passed = last + 1
            if behind <= read:
                continue
            terms, read = evaluate(raw, _SIGN.match(raw, behind).end())
            yield Finding("tag", terms.names, first, last, terms.demand) if terms else Finding("tag", (UNREADABLE,), first, last, UNKNOWN)


def score(findings: list[Finding]) -> float:
    """The most that a text asks for: 0 without findings. A phrase within a longer one doesn't count: "cc by" in "cc by nc"."""
    most, low = 0.0, None
    for f in sorted(findings, key=lambda f: (-f.last, f.first)):  # from the end: what begins no earlier than one seen lies in it
        if low is None or f.first < low[0] or (f.first, f.last) == low:
            most = max(most, f.demand)
            low = (f.first, f.last) if low is None or f.first < low[0] else low
    return most


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("labels", pa.list_(pa.string())), ("first", pa.int64()), ("last", pa.int64()), ("demand", pa.float64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("findings", _FINDINGS), ("score", pa.float64())])


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, findings, score; one row for each row.

    findings has kind (base, notice or tag), labels, first and last word, and what
    it asks for. Null and empty texts have no words and no findings, and score 0.
    A tag without a well-formed expression says only UNREADABLE. Repeated ids are
    rows of their own; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept(("licenses",), Scanner)
        for b in batches:
            found = [scanner.scan(t or b"") for t in b.column(1).to_pylist()]
            rows = [[{"kind": f.kind, "labels": f.labels, "first": f.first, "last": f.last, "demand": f.demand} for f in fs] for _, fs in found]
            yield batch_of([b.column(0), [n for n, _ in found], rows, [score(fs) for _, fs in found]], _OUT)

    kinds = "doc_id long, n_words long, findings array<struct<kind: string, labels: array<string>, first: long, last: long, demand: double>>, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, kinds)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["kind"] == "base")
    said = lambda fs: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(fs, lambda f: f["labels"])))), ",")
    first = F.transform(base, lambda f: f["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        said(base).alias("base_labels"), said(F.col("findings")).alias("labels"), "score",
    )
