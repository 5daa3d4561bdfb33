"""Sources: tables, column scans, image folders, lookups over JDBC, dictionaries, logs and settings."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.strings import is_image

# fixed values: the columns of a detector's training log
TRAINING_LOG = (
    "epoch int, time double, train_box_loss double, train_cls_loss double, train_dfl_loss double, precision_b double, recall_b double, map50_b double, "
    "map50_95_b double, val_box_loss double, val_cls_loss double, val_dfl_loss double, lr_pg0 double, lr_pg1 double, lr_pg2 double"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_scan(df: DataFrame, column: str) -> DataFrame:
    """One column without null and empty values."""
    return df.select(column).filter(F.col(column).isNotNull() & (F.col(column) != ""))


def registry(spark: SparkSession, url: str, dbtable: str, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A registry table over JDBC; with a partition column it is read by several tasks. Credentials come as options, never from here."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(label, name, path, content) of the images in a folder's sub-folders; the sub-folder is the label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(is_image(F.col("path")))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("name"), "path", "content")


def one_image(spark: SparkSession, path: str) -> DataFrame:
    """A single file's path and content; Spark raises if there is none."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def char_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch): a blank at 0, one character a line from 1 on, and a space last. The file is small by nature."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("chars"))
    whole = F.concat(F.array(F.lit("")), F.col("chars"), F.array(F.lit(" ")))
    return lines.select(F.posexplode(whole).alias("idx", "ch"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """A detector's training log with its 15 columns."""
    return spark.read.csv(path, header=True, schema=TRAINING_LOG, ignoreLeadingWhiteSpace=True)


def settings(path: str) -> dict:
    """Settings of a YAML file, read on the driver."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def ensure_table(spark: SparkSession, name: str, schema: str) -> None:
    """CREATE TABLE IF NOT EXISTS."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def file_name(path: str) -> str:
    """Last part of a path, separators at its end ignored."""
    return PurePosixPath(path.replace("\\", "/").rstrip("/")).name
