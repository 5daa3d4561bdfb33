"""Nearest-neighbour matching, scores and votes over template vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(v: Column, scale: int = 64) -> Column:
    """Components as integers, floor(scale * x)."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of integer vectors of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing bits of byte vectors of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)


#: Template descriptors that may be broadcast to the queries' tasks at once.
BROADCAST_TEMPLATES = 50_000


def nearest_two(queries: DataFrame, templates: DataFrame, query: str, query_vector: str, item: str, template_vector: str, distance: Callable[[Column, Column], Column] = squared_distance) -> DataFrame:
    """(query, item, d1, d2): the two smallest distances from each query to each item's templates; null d2 where there is one template.

    An item has a handful of templates, so they are one array each; the registry is broadcast in slices of whole items, BROADCAST_TEMPLATES at most, and the
    queries are not shuffled at all.
    """
    slices = max(1, -(-templates.count() // BROADCAST_TEMPLATES))
    items = templates.filter(F.col(template_vector).isNotNull()).groupBy(item).agg(F.collect_list(template_vector).alias("ts"))
    met = None
    for i in range(slices):
        part = items if slices == 1 else items.filter(F.pmod(F.xxhash64(item), F.lit(slices)) == i)
        pairs = queries.join(F.broadcast(part)).withColumn("ds", F.array_sort(F.transform("ts", lambda t: distance(F.col(query_vector), t))))
        pairs = pairs.select(query, item, F.get("ds", F.lit(0)).alias("d1"), F.get("ds", F.lit(1)).alias("d2"))
        met = pairs if met is None else met.unionByName(pairs)
    return met


def ratio_passes(pairs: DataFrame, share_of_square: Column) -> Column:
    """Ratio test on squared distances: d1 < share * d2; no second neighbour, no pass."""
    return F.coalesce(F.col("d1") < share_of_square * F.col("d2"), F.lit(False))


def good_matches(pairs: DataFrame, item: str, share: float) -> DataFrame:
    """(item, n_queries, good): how many of the item's pairs pass the ratio test with distances (share is squared for squares)."""
    return pairs.groupBy(item).agg(F.count("*").alias("n_queries"), F.sum(ratio_passes(pairs, F.lit(share * share)).cast("int")).cast("long").alias("good"))


def confidence(score: Column, full: float = 15.0, share: float = 0.6) -> Column:
    """Score to at most ``share``: min(1, score / full) * share."""
    return F.least(F.lit(1.0), score / full) * share


def vote_confidence(vote_share: Column, good: Column, full: float = 15.0) -> Column:
    """0.7 of the vote share and 0.3 of min(1, good / full)."""
    return 0.7 * vote_share + 0.3 * F.least(F.lit(1.0), good / full)


def template_scores(candidates: DataFrame, templates: DataFrame, item: str, vector: str, template: str) -> DataFrame:
    """A row for each candidate of a query and each template of that item, with ``score``, the inner product of both vectors.

    Templates of items that are nobody's candidate go before they meet vectors; candidates without templates have no row.
    """
    wanted = templates.join(candidates.select(item).distinct(), item, "left_semi")
    product = F.aggregate(F.zip_with(vector, template, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return candidates.join(wanted, item).withColumn("score", product)


def best_items(scores: DataFrame, query: str, item: str, template_score: str, order: str, n: int = 3) -> DataFrame:
    """Best template score per (query, item), its confidence, and the ``n`` best items of each query, ties in candidate order."""
    best = scores.groupBy(query, item).agg(F.max(template_score).alias("best"), F.min(order).alias("__o"))
    ranked = best.withColumn("confidence", confidence(F.col("best")))
    w = Window.partitionBy(query).orderBy(F.desc("confidence"), "__o")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("__o")


def or_first_candidate(ranked: DataFrame, candidates: DataFrame, query: str, item: str, position: str) -> DataFrame:
    """(query, item, confidence) of the best item, or the first candidate with confidence 0 where no candidate has templates."""
    first = candidates.groupBy(F.col(query).alias("__q")).agg(F.min_by(item, position).alias("__first"))
    top = ranked.filter("rank = 1").select(query, item, "confidence")
    return first.join(top, F.col("__q") == F.col(query), "left").select(F.col("__q").alias(query), F.coalesce(item, "__first").alias(item), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def weighted_votes(matches: DataFrame, group: list[str], distance: str) -> DataFrame:
    """Votes and ``weighted`` = votes + 0.1 * sum(1 / (distance + 1e-6)) per group."""
    return matches.groupBy(*group).agg(F.count("*").alias("votes"), (F.count("*") + 0.1 * F.sum(1 / (F.col(distance) + 1e-6))).alias("weighted"))


def mean_vector(df: DataFrame, item: str, vector: str) -> DataFrame:
    """(item, mean): the mean of each component over an item's vectors, by position; partial sums combine before the shuffle."""
    parts = df.select(item, F.posexplode(vector).alias("p", "x")).groupBy(item, "p").agg(F.avg("x").alias("x"))
    return parts.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("mean"))
