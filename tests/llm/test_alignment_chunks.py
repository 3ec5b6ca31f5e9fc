"""Alignment by chunk: a task aligns a chunk once, and begins anew when it has too many."""

import pytest
from pyspark.sql import functions as F

from lodefit.llm import alignment
from tests.llm.test_codes_licenses_alignment import AWKWARD, DOCS, Brute, digested

#: Texts that don't come out the same, before and after texts that share their chunks.
ROWS = [*AWKWARD, (20, "no ▁no tokens"), (21, "no tokens no"), (22, "▁no"), (23, "tokens ▁no"), (24, "no tokens, no"), (25, "▁no tokens"), (26, " tokens")]


@pytest.fixture(scope="module")
def brute():
    return Brute()


def table(spark, rows, parts=1):
    return spark.createDataFrame([(i, t, "en", "mine", 7, "mine") for i, t in rows], DOCS).coalesce(parts)


def test_a_task_aligns_a_chunk_once(spark, brute):
    """1,000 copies hand on the tokens of one; by whole texts it was those of all."""
    text = "unbelievably ordinary tokenizers, don't they? " * 3 + "日本 naïveté"
    rows = [(i, text) for i in range(1_000)]
    files = alignment.Files.of(spark)
    n_a, n_b = alignment.numbered(table(spark, rows), files).agg(F.sum(F.size("a")), F.sum(F.size("b"))).first()
    groups = brute.groups(text)
    assert 0 < n_a < sum(len(a) for a, _ in groups) and 0 < n_b < sum(len(b) for _, b in groups)
    assert digested(alignment.alignment(table(spark, rows), files)) == sorted(brute.table(rows), key=str)


@pytest.mark.parametrize("most", [0, 3, alignment.KEPT_CHUNKS])
def test_numbers_begin_anew(spark, brute, most):
    files = alignment.Files.of(spark)
    docs = table(spark, ROWS)
    anew = alignment.numbered(docs, files, most).where("anew").count()
    assert anew == 0 if most == alignment.KEPT_CHUNKS else anew > 3
    assert digested(alignment.alignment(docs, files, most)) == sorted(brute.table(ROWS), key=str)
    got = sorted(((r["doc_id"], list(r["groups"])) for r in alignment.groups_of(docs, files, most).collect()), key=str)
    want = [(i, [",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute.groups(t)]) for i, t in ROWS]
    assert got == sorted(want, key=str)


def test_long_chunks_begin_anew(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_TEXT", 50)
    numbers = alignment.Numbers(10)
    assert numbers.of("x" * 60) == (False, [0], 0, [" " + "x" * 60])
    assert numbers.of("a b a") == (True, [0, 1, 0], 0, [" a", " b"])
    assert numbers.of("b c") == (False, [1, 2], 2, [" c"])
    assert numbers.of(None) == (False, [], 3, [])
