"""Fuzzy matching of recognised text against registered names.

Two scorers: ``windowed_score`` slides the shorter string over the longer and takes the best share of characters that Levenshtein distance leaves, all in
native expressions; ``indel_score`` takes insert/delete similarity of the best window after lower-casing and replacing non-word characters, in a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct names that are broadcast at once; a larger registry is scored in slices of this size.
BROADCAST_NAMES = 20_000


def windowed_score(a: Column, b: Column) -> Column:
    """0 to 100: max over windows of round(100 (1 - levenshtein / length)); 0 if either is empty."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    windows = F.sequence(F.lit(1), F.greatest(F.length(long) - n + 1, F.lit(1)))
    best = F.array_max(F.transform(windows, lambda i: F.round(100.0 * (1 - F.levenshtein(F.substring(long, i, n), short) / n)).cast("int")))
    return F.when(n == 0, 0).otherwise(best)


def _common(places: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence, a bit for each place of the first string."""
    full = (1 << size) - 1
    row = full
    for c in other:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


def _places(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - insertions and deletions / total length)."""
    if not a and not b:
        return 100.0
    return 200.0 * _common(_places(a), len(a), b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> int:
    """The best insert/delete ratio of the shorter string with a window of the longer, windows over its ends included."""
    clean = lambda s: "".join(c if c.isalnum() or c == "_" else " " for c in s).lower().strip()
    a, b = sorted((clean(a), clean(b)), key=len)
    if not a:
        return 0
    n = len(a)
    places = _places(a)
    windows = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    return round(max(200.0 * _common(places, n, w) / (n + len(w)) for w in windows))


def _partial_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b)])


def indel_score(a: Column, b: Column) -> Column:
    """``partial_ratio`` of two columns."""
    return F.pandas_udf(_partial_ratios, "int")(a, b)


def top_k(texts: DataFrame, names: DataFrame, text: str, name: str, k: int = 10, cutoff: int = 50, scorer: Callable[[Column, Column], Column] = windowed_score, slice_size: int = BROADCAST_NAMES) -> DataFrame:
    """(text, rank, name, score): the ``k`` best names of each distinct text with a score of at least ``cutoff``; ties by name.

    Names and texts are made distinct before scoring. The names are counted and broadcast in slices of ``slice_size`` at most, so what is broadcast has a bound however large the registry is; a
    slice's best ``k`` suffice for the best of all.
    """
    left = texts.select(F.col(text).alias("text")).filter("text is not null and text <> ''").distinct()
    right = names.select(F.col(name).alias("name")).filter("name is not null and name <> ''").distinct()
    slices = max(1, -(-right.count() // slice_size))
    w = Window.partitionBy("text").orderBy(F.desc("score"), "name")
    best = None
    for i in range(slices):
        part = right if slices == 1 else right.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == i)
        scored = left.join(F.broadcast(part)).withColumn("score", scorer(F.col("text"), F.col("name"))).filter(F.col("score") >= cutoff)
        found = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        best = found if best is None else best.unionByName(found)
    if slices > 1:
        best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("text", "rank", "name", "score")


def or_all(texts: DataFrame, matches: DataFrame, names: DataFrame, text: str, name: str, slice_size: int = BROADCAST_NAMES) -> DataFrame:
    """(text, name, fallback): a text's matches, or every name if it has none. Names are broadcast in slices, as in ``top_k``."""
    left = texts.select(F.col(text).alias("text")).distinct()
    hit = matches.select("text", "name")
    none = left.join(hit.select("text").distinct(), "text", "left_anti")
    every = names.select(F.col(name).alias("name")).filter("name is not null and name <> ''").distinct()
    out = hit.withColumn("fallback", F.lit(False))
    slices = max(1, -(-every.count() // slice_size))
    for i in range(slices):
        part = every if slices == 1 else every.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == i)
        out = out.unionByName(none.join(F.broadcast(part)).select("text", "name", F.lit(True).alias("fallback")))
    return out
