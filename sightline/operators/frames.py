"""Frames in order: sharpness, snapshots, rate limits, buffers, votes and work assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def laplacian(pixels: Column, width: int, height: int) -> Column:
    """The 4-neighbour Laplacian of a row-major image; borders mirror without repeating the edge."""
    mirror = lambda k, n: F.when(k < 0, -k).when(k > n - 1, 2 * (n - 1) - k).otherwise(k)
    at = lambda i, j: F.element_at(pixels, (mirror(i, height) * width + mirror(j, width) + 1).cast("int"))

    def one(k: Column) -> Column:
        i, j = F.floor(k / width), k % width
        return at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * at(i, j)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), one)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is not written out at each use, as a column expression is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sharpness(pixels: Column, width: int, height: int) -> Column:
    """Population variance of the Laplacian over the area, exact for integer pixels."""
    n = width * height

    def variance(lap: Column) -> Column:
        total = F.aggregate(lap, F.lit(0).cast("long"), lambda s, x: s + x)
        square = F.aggregate(lap, F.lit(0).cast("long"), lambda s, x: s + x * x)
        return (n * square - total * total).cast("double") / float(n) / float(n) / float(n)

    return _bound(pixels, lambda p: _bound(laplacian(p, width, height), variance))


def central_roi(width: int, height: int, ratio: float = 0.8) -> tuple[int, int, int, int]:
    """(x1, y1, x2, y2) of the centred part of an image."""
    w, h = int(width * ratio), int(height * ratio)
    return (width - w) // 2, (height - h) // 2, (width - w) // 2 + w, (height - h) // 2 + h


def best_of(df: DataFrame, group: list, score: str, order: list[str]) -> DataFrame:
    """The row of greatest score of each group, the first in order among equals; null scores are skipped. A max aggregate, combined map-side."""
    keys = [F.struct(F.col(score), *[(-F.col(o)).alias(o) for o in order])]
    columns = [c for c in df.columns if c not in group]
    return df.filter(F.col(score).isNotNull()).groupBy(*group).agg(F.max_by(F.struct(*columns), keys[0]).alias("__r")).select(*group, "__r.*")


def spaced(df: DataFrame, group: str, time: Column, order: str, gap: float) -> DataFrame:
    """(group, order): rows that come at least ``gap`` after the last accepted row of their group; the first is accepted.

    Depends on accepted rows, so each group is one fold over its times, in native expressions; groups spread by hash. For unbounded groups use the streaming form, which
    keeps one value per group.
    """
    items = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(time.alias("t"), F.col(order).alias("o")))).alias("a"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.slice(F.transform("a", lambda x: x["o"]), 1, 0).alias("kept"))
    step = lambda acc, x: F.when(acc["last"].isNull() | (x["t"] - acc["last"] >= gap), F.struct(x["t"].cast("double").alias("last"), F.concat(acc["kept"], F.array(x["o"])).alias("kept"))).otherwise(acc)
    return items.select(group, F.explode(F.aggregate("a", start, step)["kept"]).alias(order))


def keep_latest(df: DataFrame, group: str, order: list[str], n: int = 30) -> DataFrame:
    """The newest ``n`` rows of each group: what a bounded buffer that drops the oldest holds at the end."""
    w = Window.partitionBy(group).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def latest_value(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(group).agg(F.max_by(value, F.struct(*order)).alias(value))


def micro_batches(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Rows with the number of the pull that takes them: ``size`` at a time, oldest first."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("pull", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def moving_mean(df: DataFrame, group: str, value: str, order: list[str], n: int = 3) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("moving_mean", F.avg(value).over(w))


def ring(df: DataFrame, group: str, value: str, order: list[str], n: int = 2) -> DataFrame:
    """Rows with the last ``n`` values up to them, oldest first."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("ring", F.collect_list(value).over(w))


def majority(df: DataFrame, group: str, value: Column, order: str) -> DataFrame:
    """(group, winner, votes): the most frequent value that is not empty after trimming; among equals the one seen first."""
    bare = F.regexp_replace(value.cast("string"), "^\\s+|\\s+$", "")
    counts = df.withColumn("__v", bare).filter(F.col("__v") != "").groupBy(group, "__v").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return counts.groupBy(group).agg(F.max_by("__v", F.struct("n", -F.col("o"))).alias("winner"), F.max("n").alias("votes"))


def first_valid(df: DataFrame, group: str, value: Column, order: str) -> DataFrame:
    """(group, first): the first value in order that is not empty."""
    return df.withColumn("__v", value).filter(F.col("__v").isNotNull() & (F.col("__v") != "")).groupBy(group).agg(F.min_by("__v", order).alias("first"))


def assigned(df: DataFrame, number: str, workers: int) -> DataFrame:
    """Rows with the worker that takes them in turn."""
    return df.withColumn("worker", F.pmod(F.col(number), F.lit(workers)).cast("int"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in order: where a capture stops after a number of frames."""
    return df.orderBy(*order).limit(n)
