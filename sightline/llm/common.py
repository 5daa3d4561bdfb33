"""Shared pieces of the corpus operators: reading, staging and text helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if the session names no shared folder (tests, one machine).
LOCAL_SHARED_DIR = "/tmp/checkpoints/sightline"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, under ``spark.checkpoint.dir``; where that is unset, on one machine, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = LOCAL_SHARED_DIR
    return f"{found}/sightline-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and computes ``df`` once.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results are written: they are read lazily until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished queries: it does so when the driver's JVM collects their plans."""
    spark._jvm.System.gc()


def text_or_empty(name: str = "text"):
    """A text column as a string whose null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
