"""Recognised text: cleaning, line merging, field extraction, sequence decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what is kept of recognised text, and the fields of an infusion label
HAN_ONLY = "[^\\u4e00-\\u9fff]"
NAME_FIELD = "[\\u4e00-\\u9fa5]+液"
CONCENTRATION_FIELD = "\\d+(?:\\.\\d+)?%"
VOLUME_FIELD = "\\d+(?:\\.\\d+)?ml"


def keep_class(text: Column, drop: str = HAN_ONLY) -> Column:
    """Text without the characters that match ``drop``."""
    return F.regexp_replace(text, drop, "")


def cleaned(df: DataFrame, column: str, drop: str = HAN_ONLY) -> DataFrame:
    """Rows whose cleaned text is not empty, with it as ``clean``."""
    return df.withColumn("clean", keep_class(F.col(column), drop)).filter(F.col("clean") != "")


def length_guard(text: Column, least: int) -> Column:
    """``empty`` for text that is null or, trimmed of white space, shorter than ``least``; else ``ok``."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")
    return F.when(F.length(bare) < least, "empty").otherwise("ok")


def last_match(lines: Column, pattern: str) -> Column:
    """The first match in the last line that has one, spaces taken out; null if none has."""
    hits = F.filter(F.transform(lines, lambda x: F.regexp_extract(F.replace(x, F.lit(" "), F.lit("")), f"({pattern})", 1)), lambda x: x != "")
    return F.when(F.size(hits) > 0, F.element_at(hits, -1))


def extract_fields(df: DataFrame, lines: str, patterns: dict[str, str]) -> DataFrame:
    """A column for each field and ``status``: ok, or missing if any field is absent."""
    out = df
    for name, pattern in patterns.items():
        out = out.withColumn(name, last_match(F.col(lines), pattern))
    absent = [F.col(name).isNull() for name in patterns]
    condition = absent[0]
    for a in absent[1:]:
        condition = condition | a
    return out.withColumn("status", F.when(condition, "missing").otherwise("ok"))


def line_numbers(df: DataFrame, group: str, y: Column, order: list, gap: float) -> DataFrame:
    """Blocks with ``line``: a block more than ``gap`` from the one before it, in order of y, begins the next line."""
    w = Window.partitionBy(group).orderBy(y, *order)
    new = F.when(F.abs(y - F.lag(y).over(w)) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def merged_lines(numbered: DataFrame, group: str, text: str, order: list[str]) -> DataFrame:
    """(group, line, text): the blocks of a line joined in the given order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return numbered.groupBy(group, "line").agg(F.array_join(F.transform(parts, lambda p: p["__t"]), "").alias("text"))


def joined_lines(lines: DataFrame, group: str) -> DataFrame:
    """(group, n_lines, text): all lines joined."""
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return lines.groupBy(group).agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def collapse(steps: Column, blank: int = 0) -> Column:
    """A label sequence without blanks and without repeats of the step just before; a blank between lets a label repeat."""
    n = F.size(steps)
    keep = lambda i: (F.element_at(steps, i) != blank) & ((i == 1) | (F.element_at(steps, i) != F.element_at(steps, F.greatest(i - 1, F.lit(1)))))
    at = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), keep)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.element_at(steps, i))


def softmax(row: Column) -> Column:
    """Probabilities of a row of scores; a row that lies within [0, 1] already is left as it is."""
    e = F.transform(row, lambda x: F.exp(x - F.array_max(row)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.array_max(row) > 1) | (F.array_min(row) < 0), F.transform(e, lambda x: x / total)).otherwise(row)


def argmax(row: Column) -> Column:
    """Position from 0 of the first maximum."""
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def ctc_decode(df: DataFrame, scores: str, characters: Column) -> DataFrame:
    """``text`` and ``confidence`` of a sequence of score rows.

    Scores are made probabilities if any value of the sequence lies outside [0, 1]; the confidence is the mean probability of the kept steps, 0 if there are none; labels beyond the
    dictionary are dropped.
    """
    outside = F.exists(scores, lambda r: (F.array_max(r) > 1) | (F.array_min(r) < 0))
    soft = F.transform(scores, lambda r: F.transform(r, lambda x: F.exp(x - F.array_max(r)) / F.aggregate(F.transform(r, lambda y: F.exp(y - F.array_max(r))), F.lit(0.0), lambda s, y: s + y)))
    best = F.transform(F.when(outside, soft).otherwise(F.col(scores)), lambda r: F.struct(argmax(r).alias("i"), F.array_max(r).cast("double").alias("p")))
    steps = F.transform(best, lambda b, k: F.struct(b["i"].alias("i"), b["p"].alias("p"), F.when(k > 0, F.element_at(best, F.greatest(k, F.lit(1)))["i"]).alias("before")))
    kept = F.filter(steps, lambda s: (s["i"] != 0) & (s["before"].isNull() | (s["before"] != s["i"])) & (s["i"] < F.size(characters)))
    text = F.array_join(F.transform(kept, lambda s: F.element_at(characters, s["i"] + 1)), "")
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda t, s: t + s["p"]) / F.size(kept)).otherwise(0.0)
    return df.withColumn("text", text).withColumn("confidence", mean)


def normalise_name(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    bare = F.regexp_replace(text, "^\\s+|\\s+$", "")
    return F.when(bare != "", bare)
