"""The folder that all executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Only a session of one process may do without either."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodefit-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The same as a table of files, which goes when the application ends; codec: how its pages are compressed.

    For loops: a checkpoint's size counts as the product of all that was ever joined
    to make it, so that planning takes ever longer; a table's is that of its files.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    at = f"{top}/{uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(at)
    return spark.read.schema(df.schema).parquet(at)
