"""Vector codes, licence scans and tokenizer alignment against brute-force versions, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodefit.llm import alignment, catalogue, licenses, vector_codes

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, spans string, row long, kind string"
AWKWARD = [
    (1, "MIT License and CC BY-NC 4.0"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "all rights reserved. All  Rights\nreserved cc by CC-BY"),
    (5, "all rights reserved. All  Rights\nreserved cc by CC-BY"),
    (None, "GNU Lesser General Public License"),
    (6, "x " * 30_000 + "cc by " * 3_000),
    (7, "<|endoftext|> <s> It's ΑΣ ﬁ İ é 日本 😀"),
    (8, "▁no tokens"),
    (9, "a\x85b\xa0c\x1fd  e\x0bf\n\n   g "),
    (10, "aaaaaaaa" * 2_000 + " " * 50 + "日本" * 500),
    (11, "é日all rights reserved"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "mine", 7, "mine") for i, t in AWKWARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 11 vector codes ---------------------------------------------------------------------


def brute_codes(rows, s):
    """(vec_id, code, error, label_error) of each whole row, and the books, with Python's integers."""
    kept = [(i, [int(np.floor(s.scale * float(x))) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // s.parts) * s.parts
    kept = [(i, v + [0] * (width - len(v)), la) for i, v, la in kept]
    w = width // s.parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(s.parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: s.entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(s.parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(s.rounds):
        new = []
        for p, book in enumerate(books):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v)[p], book)[1]].append(cut(v)[p])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(book)])
        books = new
    coded = [(i, [near(x, b) for x, b in zip(cut(v), books, strict=True)], la) for i, v, la in kept]
    total = Counter()
    for _, found, la in coded:
        total[la] += sum(d for d, _ in found)
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), total[la]) for i, found, la in coded], books


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, la, "mine", 1) for i, v, la in rows], "vec_id long, embedding array<float>, label int, code string, error long")


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 0.2], 0 if i < 30 else i % 3) for i in range(90)]
    rows += [(200, rows[3][1], 0), (201, rows[3][1], None), (201, rows[4][1], None), (202, None, 1), (203, [], 1), (204, [float("nan")] * 8, 1), (205, [1.0, None] * 4, 2), (206, [float("inf")] * 8, 2), (207, [0.5, -0.25, 0.125], 5), (None, rows[5][1], 1)]
    s = vector_codes.Settings(entries=12, rounds=3)
    got = vector_codes.compress(vectors(spark, rows), s).collect()
    want, books = brute_codes(rows, s)
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in t)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    model, shape = vector_codes.fit(vectors(spark, rows), s)
    coded = vector_codes.encode(vectors(spark, rows), model, shape, s)
    for r in vector_codes.decode(coded, model, s).where("vec_id < 5").collect():
        v = np.floor(np.array(rows[r["vec_id"]][1]) * s.scale)
        assert ((v - np.array(r["vector"]) * s.scale) ** 2).sum() == r["error"]


def test_annuli_leave_nothing_out():
    """Copies, equal norms and equal distances: the nearest entry of smallest index, as by looking at all of them."""
    rng = np.random.default_rng(2)
    for kind in (np.float64, np.int64):
        for spread in (1, 3, 1000):
            entries = rng.integers(-spread, spread + 1, (64, 4)).astype(kind)
            rows = np.vstack([rng.integers(-2 * spread, 2 * spread + 1, (300, 4)), entries[:5], np.zeros((2, 4))]).astype(kind)
            found, least = vector_codes.Codebook(entries).nearest(rows)
            d = ((rows[:, None] - entries[None]) ** 2).sum(2)
            assert (found == d.argmin(1)).all() and (least == d.min(1)).all()


def test_vector_codes_on_few_rows(spark):
    s = vector_codes.Settings()
    assert vector_codes.compress(vectors(spark, []), s).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 2)]), s).collect() == []
    (one,) = vector_codes.compress(vectors(spark, [(1, [], None)]), s).collect()
    assert (one["code"], one["error"], one["label_error"]) == ("00000000", 0, 0)
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(vectors(spark, [(1, [1e30], None)]), s)


def test_label_errors_by_exchange(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a" if i < 400 else None if i < 450 else str(i), "00", i % 7) for i in range(500)], "vec_id long, label string, code string, error long")
    a = sorted((r["vec_id"], r["label_error"]) for r in vector_codes.with_label_errors(rows).collect())
    monkeypatch.setattr(vector_codes, "FEW", 0)
    assert sorted((r["vec_id"], r["label_error"]) for r in vector_codes.with_label_errors(rows).collect()) == a and len(a) == 500


# ---- 12 licences -------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan_whole_table(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = catalogue.QUERIES["op12_license_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_scan_of_awkward_rows(spark, docs, empty):
    got = licenses.scan(docs).collect()
    assert len(got) == len(AWKWARD) and licenses.scan(empty).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in AWKWARD:
        r = by[i][0]
        n, n_base, *_ = brute_base(t)
        assert r["n_words"] == n and sum(f["kind"] == "base" for f in r["findings"]) == n_base
    assert len(by[5]) == 2 and by[2][0]["findings"] == [] and by[2][0]["score"] == 0
    assert by[1][0]["score"] == licenses.DEMANDS["cc-by-nc"] and by[None][0]["score"] == licenses.DEMANDS["lgpl"]  # the longer phrase counts


@pytest.mark.parametrize(
    ("text", "names", "demand"),
    [
        ("MIT", ["mit"], 0.2),
        ("(MIT OR GPL-3.0-only) AND Apache-2.0", ["mit", "gpl-3.0-only", "apache-2.0"], 0.25),
        ("MIT or GPL-2.0 and AGPL-3.0", ["mit", "gpl-2.0", "agpl-3.0"], 0.2),  # and binds before or
        ("(MIT or GPL-2.0) and AGPL-3.0", ["mit", "gpl-2.0", "agpl-3.0"], 0.8),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "classpath-exception-2.0"], 0.55),
        ("MIT. Or so", ["mit"], 0.2),
        ("MIT OR", ["mit"], 0.2),
        ("MIT the licence", ["mit"], 0.2),
        ("((LicenseRef-9))", ["licenseref-9"], 0.5),
        ("MIT\nAND GPL-2.0", ["mit"], 0.2),
        ("(MIT AND", None, None),
        (") MIT", None, None),
        ("", None, None),
    ],
)
def test_license_expressions(text, names, demand):
    terms, _ = licenses.evaluate(text.encode())
    assert terms is None if names is None else (list(terms.names), terms.demand) == (names, pytest.approx(demand))
    _, found = licenses.Scanner().scan(f"// SPDX-License-Identifier: {text}".encode())
    tags = [f for f in found if f.kind == "tag"]
    assert [list(f.labels) for f in tags] == [names or [licenses.UNREADABLE]] and (tags[0].first, tags[0].last) == (0, 2)


def brute_demand(words):
    """By the grammar: or of ands of withs of names and parentheses."""

    def read(level):
        ops = ["or", "and", "with"]
        if level == 3:
            w = words.pop(0)
            if w == "(":
                v = read(0)
                words.pop(0)
                return v
            return licenses.demand_of(w)
        v = read(level + 1)
        while words and words[0] == ops[level]:
            words.pop(0)
            b = read(level + 1)
            v = min(v, b) if level == 0 else max(v, b) if level == 1 else max(0.0, v - licenses.EXCEPTION)
        return v

    return read(0)


def test_shunting_yard_against_the_grammar():
    rnd = random.Random(5)

    def make(depth):
        if depth == 0 or rnd.random() < 0.3:
            return [rnd.choice(["mit", "gpl-2.0", "apache-2.0", "agpl-3.0", "cc0-1.0", "other"])]
        a, b, op = make(depth - 1), make(depth - 1), rnd.choice(["or", "and", "with"])
        return ["(", *a, op, *b, ")"] if rnd.random() < 0.5 else [*a, op, *b]

    for _ in range(300):
        words = make(4)
        terms, end = licenses.evaluate(" ".join(words).encode())
        assert terms.demand == pytest.approx(brute_demand(list(words))) and end == len(" ".join(words))


def test_many_tags_are_read_once():
    n, found = licenses.Scanner().scan(b"spdx-license-identifier: mit and " * 20_000)
    assert n == 100_000 and found[0].labels[0] == "mit" and len(found) < 20_000


# ---- 13 alignment ------------------------------------------------------------------------


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        sides = alignment.Sides(alignment.Files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
        self.a_raw, self.b_raw = sides.a_raw, sides.b_raw

    def groups(self, text):
        """(A's ids, B's ids) of each group, by walking along the bytes."""
        if not text:
            return []
        a, b, raw = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join(self.a_raw[i] for i in a) != raw or b"".join(self.b_raw[i] for i in b) != raw:
            return []
        found, x, y, i, j = [], 0, 0, 0, 0
        own = ([], [])
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                own[0].append(a[i])
                x += len(self.a_raw[a[i]])
                i += 1
            else:
                own[1].append(b[j])
                y += len(self.b_raw[b[j]])
                j += 1
            if x == y:
                found.append(own)
                own = ([], [])
        return found

    def table(self, rows):
        groups = [self.groups(t) for _, t in rows]
        links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
        count = Counter(p for own in links for p in set(own))
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        out = []
        for (i, _), g, own in zip(rows, groups, links, strict=True):
            digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
            out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), digest))
        return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def brute():
    return Brute()


def digested(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_alignment_whole_table(spark, brute):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = sorted(tuple(r[c] for c in COLUMNS) for r in catalogue.QUERIES["op13_alignment"](spark, SF).collect())
    assert got == sorted(brute.table(rows))


def test_alignment_of_awkward_rows(spark, brute, docs, empty, monkeypatch):
    files = alignment.Files.of(spark)
    want = sorted(brute.table(AWKWARD), key=str)
    assert digested(alignment.alignment(docs, files)) == want
    assert alignment.alignment(empty, files).count() == 0
    assert [r[1] for r in want if r[0] in (2, 3, 8)] == [0, 0, 0]
    monkeypatch.setattr(alignment, "FEW", 0)  # what is known of groups comes by exchange
    assert digested(alignment.alignment(docs, files)) == want


def test_chunks_are_encoded_as_whole_texts_are(spark, brute):
    sides = alignment.Sides(alignment.Files.of(spark))
    rnd = random.Random(1)
    letters = [*"ab Z.,'\"\n\t  0é\x85 \x1c日本▁😀<>|s'", "<s>", "<|endoftext|>", "'s", "  ", "́", "İ", "ﬁ", "don't", "123"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(4_000)]
    texts = [t.replace("▁", "") if rnd.random() < 0.8 else t for t in texts]
    for at in range(0, len(texts), 64):
        for t, (a_ends, a, b_ends, b) in zip(texts[at : at + 64], sides.tokens(texts[at : at + 64]), strict=True):
            g = brute.groups(t)
            assert [x for own, _ in g for x in own] == (a & alignment.MARK).tolist() and [y for _, own in g for y in own] == (b & alignment.MARK).tolist()
            assert not len(a) or a_ends[-1] >> alignment.ID_BITS == b_ends[-1] >> alignment.ID_BITS == len((" " + t).encode())
