"""BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of a prefix's encoding is the one suffix token that may follow the
last token of what precedes it. Distinct words are walked in sorted order, which
is a depth-first walk of their trie: the states of a shared prefix are computed
once, and a word's encoding is read back from its last token.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, pre_tokenizers

from lodefit.llm.common import batch_of, give_back, kept, small_batches, table, texts

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Texts are cut at white space into pieces of about this many characters, which bounds memory.
PIECE_CHARS = 1 << 20
#: Encodings a worker keeps; when there are more it starts anew.
KEPT_WORDS = 300_000
#: Bytes of words, ids and names, without their objects' own, that a worker keeps; likewise.
KEPT_BYTES = 64 << 20
#: Longer words have their states made from the first on, so that none asks for many others.
RECURSION = 200
#: Pairs of tokens whose order a worker remembers.
FOLLOWS = 500_000
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Characters that every Unicode version lower-cases, composes and classes alike.
_PLAIN = re.compile("[\x00-ɏ‐-‧‰-›€]*")
_CUT = re.compile(f"[{_SPACE}]")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    """Encodes words of one vocabulary; a word's last letter carries the end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, int] = model["model"]["vocab"]
        self.end: str = model["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.ranks = {tuple(m): i for i, m in enumerate(model["model"]["merges"])}
        pattern = next(x["pattern"]["Regex"] for x in model["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.words = regex.compile(pattern.replace(r"\s", _SPACE))
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.made: dict[str, tuple[int, tuple[str, str]]] = {}
        for pair, rank in self.ranks.items():
            self.made.setdefault("".join(pair), (rank, pair))
        self.spines: tuple[dict, dict] = ({}, {})
        known = {t: struct.pack("<I", i) for t, i in self.ids.items() if t in self.made or len(t.removesuffix(self.end)) == 1}
        #: tokens within a word and, without their mark, at its end, with the bytes of their ids
        self.inner = {t: i for t, i in known.items() if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in known.items() if t.endswith(self.end)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.follows: tuple[dict, dict] = ({}, {})
        self.encoded: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.kept_bytes = 0

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The tokens at the left (0) or right (1) edge of token's merge tree, from token down,
        each with the rank of the merge that takes it up."""
        found, taken = [], math.inf
        while True:
            found.append((token, taken))
            if token not in self.made:
                return found
            taken, pair = self.made[token]
            token = pair[side]

    def may_follow(self, a: str, b: str, last: bool) -> bool:
        """Whether the encoding of a + b is a, b; last: b ends its word.

        It is unless a merge across the border comes before the merges that take
        its two sides up; of equal ranks the left one comes first.
        """
        right = self.spines[1].get(a) or self.spines[1].setdefault(a, self.spine(a, 1))
        name = b + self.end if last else b
        left = self.spines[0].get(name) or self.spines[0].setdefault(name, self.spine(name, 0))
        ranks = self.ranks
        found = True
        for x, taken_x in right:
            for y, taken_y in left:
                r = ranks.get((x, y))
                if r is not None and r < taken_x and r <= taken_y:
                    found = False
        if len(self.follows[last]) > FOLLOWS:
            self.follows[last].clear()
        self.follows[last][a, b] = found
        return found

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes, str]]:
        """Each distinct word, in byte letters, with the bytes of its ids and its tokens' names.

        A state is the last token of a prefix and where it starts; the state there is the token before.
        """
        inner, final, longest, end = self.inner, self.final, self.longest, self.end
        follows, follows_last, may_follow = self.follows[False].get, self.follows[True].get, self.may_follow
        tokens: list[str | None] = [""]
        starts = array("q", [0])

        def state(word: str, n: int) -> str:
            """The last token of word[:n]; states before it are made as they are asked for."""
            for i in range(n - longest if n > longest else 0, n):
                t = word[i:n]
                if t in inner:
                    if i:
                        last = tokens[i] or state(word, i)
                        ok = follows((last, t))
                        if not (may_follow(last, t, False) if ok is None else ok):
                            continue
                    tokens[n] = t
                    starts[n] = i
                    return t
            raise ValueError("a letter that isn't in the vocabulary")

        before = ""
        for word in sorted(set(words)):
            size = len(word)
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            # tokens[n] and starts[n] are those of word[:n]; the state of a whole word as a prefix is made when it's needed
            del tokens[shared + 1 :], starts[shared + 1 :]
            more = size - len(tokens)
            tokens.extend([None] * more)
            starts.extend([0] * more)
            if size > RECURSION:
                for n in range(shared + 1, size):
                    state(word, n)
            for i in range(size - longest if size > longest else 0, size):
                t = word[i:]
                if t in final:
                    if i == 0:
                        yield word, final[t], t + end
                        break
                    last = tokens[i] or state(word, i)
                    ok = follows_last((last, t))
                    if may_follow(last, t, True) if ok is None else ok:
                        found = []
                        while i:
                            found.append(tokens[i])
                            i = starts[i]
                        found.reverse()
                        yield word, b"".join([inner[x] for x in found]) + final[t], " ".join(found) + f" {t}{end}"
                        break
            before = word[:-1]

    def as_letters(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.letters[b] for b in word.encode("utf-8")])

    def forget(self) -> None:
        """Drop the encodings of words, and give their memory back."""
        self.encoded.clear()
        self.decoded.clear()
        self.kept_bytes = 0
        for known in self.follows:
            if len(known) > FOLLOWS // 4:
                known.clear()
        give_back()

    def learn(self, words: set[str]) -> None:
        """Have the encodings of all these words."""
        new = words.difference(self.encoded)
        if len(self.encoded) + len(new) > KEPT_WORDS or self.kept_bytes > KEPT_BYTES:
            self.encoded.clear()
            self.decoded.clear()
            self.kept_bytes = 0
            new = words
        raw = {self.as_letters(w): w for w in new}
        for letters, ids, names in self.walk(raw):
            w = raw[letters]
            self.encoded[w] = ids
            self.decoded[w] = names
            self.kept_bytes += len(w) + len(ids) + len(names)

    def split_words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return self.words.findall(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of text, and whether each is a special token."""
        parts = self.at_special.split(text) if self.at_special else [text]
        for k, part in enumerate(parts):
            at = 0
            while k % 2 == 0 and len(part) - at > PIECE_CHARS and (m := _CUT.search(part, at + PIECE_CHARS)):
                yield part[at : m.start()], False
                at = m.start()
            yield part[at:], k % 2 == 1

    def tokens(self, text: str, words: dict[str, list[str]] | None = None) -> Iterator[tuple[bytes, str]]:
        """The ids and names of the tokens of a text, piece by piece. words: pieces already split and learnt."""
        for piece, special in self.pieces(text):
            if special:
                yield struct.pack("<I", self.special[piece]), piece
                continue
            found = None if words is None else words.get(piece)
            if found is None:
                found = self.split_words(piece)
                self.learn(set(found))
            if found:
                yield b"".join(map(self.encoded.__getitem__, found)), " ".join(map(self.decoded.__getitem__, found))

    def digests(self, rows: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, SHA-256 of the ids, SHA-256 of the decoded text) of each row; null is empty.

        The words of short rows are learnt together, so that they share their prefixes.
        """
        rows = [r or "" for r in rows]
        at = 0
        while at < len(rows):
            to, size = at + 1, len(rows[at])
            while to < len(rows) and size + len(rows[to]) <= PIECE_CHARS:
                size += len(rows[to])
                to += 1
            group = rows[at:to]
            words = {p: self.split_words(p) for t in group for p, special in self.pieces(t) if not special} if size <= PIECE_CHARS else None
            if words:
                self.learn(set().union(*words.values()))
            for text in group:
                n, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
                for raw, names in self.tokens(text, words):
                    n += len(raw) // 4
                    ids.update(raw)
                    decoded.update((gap + names).encode("utf-8"))
                    gap = " "
                yield n, ids.hexdigest(), decoded.hexdigest()
            at = to

    def encode(self, text: str | None) -> list[int]:
        """The ids of one whole text."""
        raw = b"".join(ids for ids, _ in self.tokens(text or ""))
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids with one space between them, as a vocabulary without a decoder gives them."""
        names = self._names()
        return " ".join(names[i] for i in ids)

    @lru_cache(maxsize=1)  # noqa: B019
    def _names(self) -> dict[int, str]:
        return {i: t for t, i in [*self.ids.items(), *self.special.items()]}


def encoder(path: str) -> TrieEncoder:
    """A worker's encoder of the vocabulary at path, kept between tasks."""
    return kept(("bpe", path), lambda: TrieEncoder(path))


def vocabulary_path(spark: SparkSession) -> str:
    """The vocabulary file: the setting lodefit.tokenizer.path, else the public one."""
    found = spark.conf.get("lodefit.tokenizer.path", None)
    if found is None:
        import public_tokenizers

        found = public_tokenizers.path("word_bpe_49k.json")
    return found


def encode_table(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns keep; one row for each row.

    Null texts count as empty: no tokens. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            found = list(e.digests(texts(b, "text")))
            made = batch_of([b.column(0), *([x[i] for x in found] for i in range(3))], _OUT)
            yield pa.RecordBatch.from_arrays([*made.columns, *b.columns[2:]], [*_OUT.names, *keep])
        e.forget()

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{kinds}")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: the token ids themselves."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.encode(t) for t in texts(b, "text")], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"), vocabulary_path(spark))
