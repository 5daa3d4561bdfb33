"""Column functions for names, paths, labels and mixed results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(raw: Column) -> Column:
    """UTF-8 bytes as text."""
    return F.decode(raw, "UTF-8")


def bare_path(path: Column) -> Column:
    """A path without separators at its end."""
    return F.regexp_replace(path, "[/\\\\]+$", "")


def base_name(path: Column) -> Column:
    """Last part of a path, separators at its end ignored."""
    return F.element_at(F.split(bare_path(path), "[/\\\\]"), -1)


def is_image(name: Column) -> Column:
    """Whether a file's name ends as an image's, in any case."""
    lower = F.lower(name)
    return lower.endswith(".jpg") | lower.endswith(".jpeg") | lower.endswith(".png")


def scored_label(name: Column, score: Column) -> Column:
    """``name: 0.1234``."""
    return F.format_string("%s: %.4f", name, score)


def one_name(*forms: Column) -> Column:
    """The first form of a result that holds a name: strings as they are, arrays by their first element; blank ones are skipped."""
    trimmed = [F.regexp_replace(f.cast("string"), "^\\s+|\\s+$", "") for f in forms]
    return F.coalesce(*[F.when(t != "", t) for t in trimmed])


def ordered_distinct(values: Column) -> Column:
    """Values without repeats, in order of first appearance."""
    return F.array_distinct(values)


def file_stamp(prefix: str, seconds: Column) -> Column:
    """A file name with the time in it."""
    return F.concat(F.lit(prefix + "_"), F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd_HHmmss"))
