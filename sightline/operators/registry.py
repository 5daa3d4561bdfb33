"""Lookups, joins and reconciliation against the registry (people, batches, items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_lookup(df: DataFrame, column: str, value, key: str) -> DataFrame:
    """The key of a value; the smallest where the value repeats."""
    return df.filter(F.col(column) == value).agg(F.min(key).alias(key))


def resolve_names(df: DataFrame, column: str, key: str) -> DataFrame:
    """Every name with its smallest key and how many share it."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias(key), F.count("*").alias("n"))


def pair_exists(pairs: DataFrame, registered: DataFrame, on: dict[str, str]) -> DataFrame:
    """``pairs`` with ``found``: whether all their columns occur together in ``registered``."""
    known = registered.select(*[F.col(r).alias(f"__{p}") for p, r in on.items()]).distinct().withColumn("__hit", F.lit(True))
    condition = [F.col(p) == F.col(f"__{p}") for p in on]
    return pairs.join(known, condition, "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit", *[f"__{p}" for p in on])


def batch_items(batch_lines: DataFrame, items: DataFrame, item: str, item_key: str, batch: Column | None = None) -> DataFrame:
    """Lines of a batch (or of all) with the item's row."""
    lines = batch_lines if batch is None else batch_lines.filter(batch)
    return lines.join(items, F.col(item) == F.col(item_key))


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(values))


def key_split(names: DataFrame, cached: DataFrame, left: str, right: str) -> DataFrame:
    """Names with ``status`` kept or missing, by whether the cache has them. One join: the cache's keys are made distinct first."""
    known = cached.select(F.col(right).alias("__k")).filter("__k is not null").distinct()
    return names.join(known, F.col(left) == F.col("__k"), "left").withColumn("status", F.when(F.col("__k").isNull(), "missing").otherwise("kept")).drop("__k")


def reconcile(lines: DataFrame, batch: str, item: str, recognized: Column) -> DataFrame:
    """For each batch the registered items that were not recognised and the other way round.

    ``lines`` holds an occurrence of an item per row, ``recognized`` marks those that were seen; every row is registered. Output: the batch, only_registered and
    only_recognized (sorted, comma-separated), matched. Lines are made distinct by (batch, item) before a batch is gathered, so a hot item combines map-side.
    """
    seen = lines.groupBy(batch, item).agg(F.max(recognized.cast("int")).alias("seen"))
    missing = F.array_sort(F.collect_set(F.when(F.col("seen") == 0, F.col(item))))
    return seen.groupBy(batch).agg(missing.alias("m")).select(batch, F.array_join(F.col("m").cast("array<string>"), ",").alias("only_registered"), F.lit("").alias("only_recognized"), (F.size("m") == 0).alias("matched"))


def reconcile_sets(actual: DataFrame, expected: DataFrame, batch: str, item: str) -> DataFrame:
    """Both differences of two (batch, item) tables and whether they are equal as sets. A batch in one table only is compared with nothing."""
    marked = actual.select(batch, item, F.lit(1).alias("a"), F.lit(0).alias("e")).unionByName(expected.select(batch, item, F.lit(0).alias("a"), F.lit(1).alias("e")))
    both = marked.groupBy(batch, item).agg(F.max("a").alias("a"), F.max("e").alias("e"))
    only = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(item))))
    out = both.groupBy(batch).agg(only((F.col("a") == 0) & F.col(item).isNotNull()).alias("m"), only((F.col("e") == 0) & F.col(item).isNotNull()).alias("x"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select(batch, join("m").alias("only_registered"), join("x").alias("only_recognized"), ((F.size("m") == 0) & (F.size("x") == 0)).alias("matched"))


def status_chain(requests: DataFrame, people: DataFrame, batches: DataFrame, lines: DataFrame) -> DataFrame:
    """The outcome of each request(request_id, person, batch): no_person, no_batch or compared, with the number of distinct registered items.

    ``people(name, person_id)``, ``batches(batch_id, person_id)``, ``lines(batch_id, item)``. A name that repeats means the smallest person_id.
    """
    person = people.groupBy(F.col("name").alias("__n")).agg(F.min("person_id").alias("__p"))
    batch = batches.select(F.col("batch_id").alias("__b"), F.col("person_id").alias("__bp")).distinct()
    items = lines.select(F.col("batch_id").alias("__lb"), "item").distinct().groupBy("__lb").agg(F.count("item").alias("__c"))
    found = requests.join(person, F.col("person") == F.col("__n"), "left").join(batch, (F.col("batch") == F.col("__b")) & (F.col("__p") == F.col("__bp")), "left").join(items, F.col("__b") == F.col("__lb"), "left")
    status = F.when(F.col("__p").isNull(), "no_person").when(F.col("__b").isNull(), "no_batch").otherwise("compared")
    return found.select("request_id", status.alias("status"), F.when(status == "compared", F.coalesce("__c", F.lit(0))).otherwise(0).cast("long").alias("n_items"))


def first_templates(df: DataFrame, label: str, order: str, n: int = 6) -> DataFrame:
    """The first ``n`` rows of each label with template_no from 1."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("template_no", F.row_number().over(w)).filter(F.col("template_no") <= n)
