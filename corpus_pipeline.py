"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the columns of docs; the last
returns a row of token digests for each document of the mix.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefit.llm import bpe, near_copies, pfair, quality_rules, secret_ledger
from lodefit.llm.common import shared_dir


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that a learned rule rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.fit_texts(docs, labels)
    return docs.where(quality_rules.keeps(F.col("text"), rules))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles the document of smallest doc_id stays, once.

    Of rows of one doc_id and text one stays, whichever comes first. Rows without a doc_id stay, but for exact repeats.
    """
    found = near_copies.near_duplicates(docs)
    losers = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def secret_ledger_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows."""
    found = secret_ledger.scan_versions(docs.select(F.struct("*").alias("_row")), text="_row.text", path="_row.doc_id")
    hit = F.size("spans") > 0
    row = F.col("_row").withField("text", secret_ledger.redact(F.col("_row.text"), F.col("spans")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(hit, F.length(row["text"]).cast("long")).otherwise(F.col("_row.n_chars")))
    return found.select(F.when(hit, row).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def pfair_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in order: every document once, and again where its source's weight asks for more."""
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "source")
    return pfair.mix(whole).select("_row.*")


#: Where a row of the mix stands: the number of its file among those of the mixing stage, and the row in it.
PLACE = ("mix_file", "mix_row")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix, and its place if docs has it."""
    return bpe.encode_table(docs, bpe.vocabulary_path(spark), tuple(c for c in PLACE if c in docs.columns))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("simhash near-dedup", simhash_stage),
    ("secret scans", secret_ledger_stage),
    ("mixing sources", pfair_stage),
    ("bpe encoding", bpe_stage),
]
#: A learned decision list has no SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def _is_written(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again.

    at: the folder of the stages; one that a run before wrote whole is not run again.
    The mix keeps its order as mix_file and mix_row: files are numbered along it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = at or f"{shared_dir(spark)}/corpus-pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        if not _is_written(spark, f"{at}/{k}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    file = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("int")
    docs = docs.select("*", file.alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    return STAGES[-1][1](spark, docs, sf_dir)
