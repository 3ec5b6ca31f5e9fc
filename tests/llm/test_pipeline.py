"""The pipeline's stages against a brute-force version."""

import hashlib
import struct

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodefit.llm import bpe, pfair, quality_rules, secret_ledger
from tests.llm.test_operators import AWKWARD, DOCS, brute_near_copies, brute_spans, brute_statistics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    top = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or found.columns == docs.columns
        found.write.parquet(str(top / str(k)))
        docs = spark.read.parquet(str(top / str(k)))
        out.append(docs)
    return out


def as_rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, staged, tmp_path_factory):
    before = {r[0]: r for r in duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").fetchall()}
    rules = quality_rules.fit_texts(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = as_rows(staged[0])
    for i, r in before.items():
        s = dict(zip(quality_rules.STATISTICS, brute_statistics(r[1])))
        if s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]:
            assert i not in kept
    assert len(kept) > 0.8 * len(before) and all(k["text"] == before[i][1] for i, k in kept.items())
    assert isinstance(rules, list)
    ids = sorted(kept)
    roots = brute_near_copies([(i, kept[i]["text"]) for i in ids])
    single = as_rows(staged[1])
    assert set(single) == {min(i for i, q in zip(ids, roots) if q == r) for r in roots} and staged[1].count() == len(single)
    clean = as_rows(staged[2])
    assert set(clean) == set(single)
    for i, r in clean.items():
        text, at, want = single[i]["text"], 0, ""
        for s, _, e, _ in brute_spans(text):
            if s >= at:
                want += text[at:s] + secret_ledger.REDACTED
            at = max(at, e)
        assert r["text"] == want + text[at:] and r["n_chars"] == (len(r["text"]) if want else single[i]["n_chars"])
    mixed = staged[3].collect()
    counts = {}
    for r in clean.values():
        counts[f"s:{r['source']}"] = counts.get(f"s:{r['source']}", 0) + 1
    sources, _ = pfair.plan(counts, pfair.Settings())
    assert len(mixed) == sum(s.wanted for s in sources) and {r["doc_id"] for r in mixed} == set(clean)
    lib = Tokenizer.from_file(bpe.vocabulary_path(spark))
    for r in staged[4].collect():
        enc = lib.encode(clean[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(enc) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(enc)}I", *enc)).hexdigest()
    at = str(tmp_path_factory.mktemp("run") / "stages")
    whole = corpus_pipeline.run(spark, SF, at).collect()
    assert sorted(tuple(r)[:4] for r in whole) == sorted(map(tuple, staged[4].collect()))
    order = [r["doc_id"] for r in sorted(whole, key=lambda r: (r["mix_file"], r["mix_row"]))]
    assert order == [r["doc_id"] for r in pfair.mix(spark.read.parquet(f"{at}/2")).orderBy("position").collect()]
    # what is written whole is not made again
    rows = spark.read.parquet(f"{at}/2").limit(5)
    rows.write.parquet(f"{at}-resumed/3")
    for k in range(3):
        rows.limit(0).write.parquet(f"{at}-resumed/{k}")
    assert corpus_pipeline.run(spark, SF, f"{at}-resumed").count() == 5


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "mine", "mine") for i, t, lang, s in AWKWARD], DOCS)
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, table, SF)
            assert found.count() >= 0
            if k < len(corpus_pipeline.STAGES) - 1:
                assert found.columns == docs.columns
            if k == 2:
                assert {r["spans"] for r in found.collect()} <= {"mine"} and found.count() == table.count()
