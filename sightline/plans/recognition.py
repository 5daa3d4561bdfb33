"""The whole dataflow: texts to candidates, candidates to items by vectors, items to a reconciled batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import fuzzy, registry
from sightline.operators.text import length_guard

BOTTLE_LEAST, BAG_LEAST = 3, 2


def recognised(texts: DataFrame, names: DataFrame, text: str, name: str, kind: str = "bottle", k: int = 10, cutoff: int = 50, scorer=fuzzy.windowed_score) -> DataFrame:
    """(text, status, candidates): guard on length, fuzzy candidates, and for bottles all names where nothing matches.

    status: empty_text, matched, all_names (bottle) or no_match (bag).
    """
    least = BOTTLE_LEAST if kind == "bottle" else BAG_LEAST
    known = texts.select(F.col(text).alias("text")).distinct().withColumn("guard", length_guard(F.col("text"), least))
    good = known.filter("guard = 'ok'")
    best = fuzzy.top_k(good, names, "text", name, k, cutoff, scorer)
    listed = best.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("found"))
    every = names.select(F.col(name).alias("n")).filter("n is not null and n <> ''").agg(F.array_sort(F.collect_set("n")).alias("every"))  # one row: the registry's names
    out = known.join(listed, "text", "left")
    if kind == "bottle":
        out = out.join(F.broadcast(every))
        status = F.when(F.col("guard") == "empty", "empty_text").when(F.col("found").isNotNull(), "matched").otherwise("all_names")
        candidates = F.when(status == "matched", F.col("found")).when(status == "all_names", F.col("every")).otherwise(F.array().cast("array<string>"))
    else:
        status = F.when(F.col("guard") == "empty", "empty_text").when(F.col("found").isNotNull(), "matched").otherwise("no_match")
        candidates = F.coalesce("found", F.array().cast("array<string>"))
    return out.select("text", status.alias("status"), candidates.alias("candidates"))


def best_name(texts: DataFrame, names: DataFrame, text: str, name: str, k: int = 10, cutoff: int = 50) -> DataFrame:
    """(text, name): the best candidate of each text."""
    return fuzzy.top_k(texts, names, text, name, k, cutoff).filter("rank = 1").select("text", "name")


def noisy(name: Column, key: Column) -> Column:
    """A name with a deterministic edit, standing for recognised text: a character changed, dropped or doubled by the key."""
    at = (F.pmod(key, F.length(name)) + 1).cast("int")
    head, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name))
    one = F.substring(name, at, F.lit(1))
    kind = F.pmod(key, F.lit(4))
    return F.when(kind == 0, F.concat(head, F.lit("x"), tail)).when(kind == 1, F.concat(head, tail)).when(kind == 2, F.concat(head, one, one, tail)).otherwise(name)


def reconciled(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Per batch: recognised texts of its items, matched to registered names, against the registered items.

    ``lines(batch, item_id, seen_text)`` has a null text where an item was not seen; ``items(item_id, name)`` is the registry. Texts are matched once each, however often they occur.
    """
    best = best_name(lines, items, "seen_text", "name")
    named = items.select("item_id", F.col("name").alias("item"))
    expected = lines.join(named, "item_id").select("batch", "item").distinct()
    actual = lines.join(best, F.col("seen_text") == F.col("text")).select("batch", F.col("name").alias("item")).distinct()
    return registry.reconcile_sets(actual, expected, "batch", "item")
