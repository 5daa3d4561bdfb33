"""Sinks: upsert, frame and segment files, image saves and a console report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TEMPLATES = 6


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Rows by unique key, the last write winning: base rows are version 0, updates carry their own; ``version`` is dropped.

    One shuffle by key; equal versions of a key are decided by the remaining columns so that the result is determined.
    """
    columns = [c for c in base.columns if c != version]
    every = base.select(*columns, F.lit(0).cast("long").alias("__v")).unionByName(updates.select(*columns, F.col(version).cast("long").alias("__v")))
    last = every.groupBy(key).agg(F.max(F.struct("__v", *[c for c in columns if c != key])).alias("__row"))
    return last.select(key, *[F.col(f"__row.{c}").alias(c) for c in columns if c != key])


def insert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added as they are; columns that they do not name are null."""
    return base.unionByName(rows, allowMissingColumns=True).select(*base.columns)


def padded_templates(rows: DataFrame, label: str, number: str, value: str, size: int = MAX_TEMPLATES) -> DataFrame:
    """Long templates to one row per label with ``size`` columns, null where there are fewer."""
    picks = [F.max(F.when(F.col(number) == i, F.col(value))).alias(f"t{i}") for i in range(1, size + 1)]
    return rows.groupBy(label).agg(*picks)


def long_templates(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Repeated template columns to (label, template_no, value), nulls left out."""
    found = rows.select(label, F.posexplode(F.array(*columns)).alias("p", "value"))
    return found.filter("value is not null").select(label, (F.col("p") + 1).alias("template_no"), "value")


def byte_pixels(content: Column) -> Column:
    """Pixel values for saving: an array whose largest value is at most 1 is scaled by 255; cut to 0..255."""
    scaled = F.when(F.array_max(content) <= 1, F.transform(content, lambda x: x * 255)).otherwise(content)
    return F.transform(scaled, lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int"))


def save_images(df: DataFrame, folder: str, prefix: str) -> DataFrame:
    """Write each row's ``content`` as ``{prefix}_{ms}_{n}.jpg`` to a folder that the executors share; one row (file, ok) per image."""

    def write(it):
        for pdf in it:
            out = []
            for ms, n, content in zip(pdf["ms"], pdf["n"], pdf["content"]):
                file = Path(folder) / f"{prefix}_{ms}_{n}.jpg"
                try:
                    file.parent.mkdir(parents=True, exist_ok=True)
                    file.write_bytes(content)
                    out.append((str(file), True))
                except (OSError, TypeError):
                    out.append((str(file), False))
            yield type(pdf)(out, columns=["file", "ok"])

    return df.select("ms", "n", "content").mapInPandas(write, "file string, ok boolean")


def saved_count(saved: DataFrame) -> DataFrame:
    return saved.agg(F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0)).alias("n_saved"))


def segments(frames: DataFrame, ts: str, seconds: float, rest: float, count: int) -> DataFrame:
    """Frames with the number of the recording segment that they fall in: ``count`` segments of a length with a rest between; frames in a rest go."""
    start = frames.agg(F.min(ts).alias("__start"))
    since = F.col(ts) - F.col("__start")
    number = F.floor(since / (seconds + rest)).cast("int")
    placed = frames.join(F.broadcast(start)).withColumn("segment", number)  # one row: the least timestamp
    return placed.filter((F.col("segment") < count) & (since - F.col("segment") * (seconds + rest) < seconds)).drop("__start")


def latest_per_tick(frames: DataFrame, ts: str, fps: float) -> DataFrame:
    """What a recorder of fixed rate writes: for each tick that has frames the latest of them."""
    w = Window.partitionBy(F.floor(F.col(ts) * fps)).orderBy(F.desc(ts))
    return frames.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def report(df: DataFrame, n: int = 20) -> None:
    """Print the first rows."""
    df.show(n, truncate=False)
