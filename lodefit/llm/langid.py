"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of labelled text.
A text is given the language whose dictionary lets it compress smallest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodefit.llm.common import batch_of, held_out, small_batches, table, texts

UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


@dataclass(frozen=True)
class Settings:
    """docs_per_language bounds the fit: a dictionary is at most so many distinct labelled
    texts, whole. margin is the least relative gap between the two smallest encodings
    that is not rejected."""

    docs_per_language: int = 96
    level: int = 9
    chunk_bytes: int = 4096
    scale_bytes: float = 4.0
    margin: float = 0.01


def normalise(text: str | None) -> str:
    """Lower-case letters with one space between words; a word said twice running is said once."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).split()
    return " ".join(w for w, _ in groupby(words))


def fit(rows: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Dictionaries by language, the one of most rows first, from rows(text, lang); null texts and languages are left out.

    The sample is drawn by the hash of the text, at a rate set from the number of
    rows of each language, and is at most docs_per_language whole texts for each.
    """
    rows = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    space = 1 << 20
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(space, math.ceil(space * 8 * settings.docs_per_language / n)))])
    drawn = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    near = drawn.where(F.pmod("h", F.lit(space)) < limit[F.col("lang")]).dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("h")
    kept = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= settings.docs_per_language)
    found: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in kept.orderBy("lang", F.desc("k")).collect():
        found[r["lang"]].append(r["text"])
    missing = [lang for lang, some in found.items() if not some]
    if missing:  # a language whose few distinct texts all hash beyond its rate
        for r in drawn.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min("text").alias("text")).collect():
            found[r["lang"]].append(r["text"])
    order = sorted(found, key=lambda lang: (-counts[lang], lang))
    return {lang: " ".join(map(normalise, found[lang])).encode() for lang in order}


@lru_cache(maxsize=4)
def _compressors(model: tuple, level: int) -> list:
    found = []
    for lang, raw in model:
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
        if data is not None:
            data.precompute_compress(level=level)
        found.append((lang, zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return found


def classify(text: str | None, model: tuple, settings: Settings) -> tuple[str, float, bool]:
    """(language, confidence from 0 to 1, rejected) of one whole text.

    A null text or one without a letter is undetermined at 0. Equal sizes go to
    the language that comes first in the model, which has the most labelled rows.
    """
    plain = normalise(text)
    if not model or not any(map(str.isalpha, plain)):
        return UNDETERMINED, 0.0, True
    raw = plain.encode()
    sizes = [0] * len(model)
    for at in range(0, len(raw), settings.chunk_bytes):
        part = raw[at : at + settings.chunk_bytes]
        for i, (_, compressor) in enumerate(_compressors(model, settings.level)):
            sizes[i] += len(compressor.compress(part))
    best = min(sizes)
    score = 1.0 / sum(math.exp((best - s) / settings.scale_bytes) for s in sizes)
    second = min((s for i, s in enumerate(sizes) if i != sizes.index(best)), default=math.inf)
    return model[sizes.index(best)][0], score, (second - best) < settings.margin * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, lang_pred, score, rejected.

    Whole texts are encoded, in chunks. rejected marks a narrow margin: the best
    guess stays in lang_pred. Empty tables give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [classify(t, model.value, settings) for t in texts(b, "text")]
            yield batch_of([b.column(0), b.column(1), *([x[i] for x in found] for i in range(3))], _OUT)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return identify(docs, fit(docs.where("not held_out")))
