"""Detections: thresholds, routing, suppression, tile votes and regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import gaussian_weight, iou
from sightline.operators.text import argmax

# fixed values: the detector's classes
KINDS = {0: "bottle", 1: "bag", 2: "infusion"}


def best_class(df: DataFrame, scores: Column, threshold: float) -> DataFrame:
    """``cls`` (first maximum) and ``conf`` of score arrays, where conf is at least the threshold."""
    return df.withColumn("cls", argmax(scores)).withColumn("conf", F.array_max(scores)).filter(F.col("conf") >= threshold)


def kind(cls: Column, kinds: dict[int, str] = KINDS) -> Column:
    """The name of a class; null for an unknown one."""
    out = F.lit(None).cast("string")
    for number, name in kinds.items():
        out = F.when(cls == number, name).otherwise(out)
    return out


def suppressed(boxes: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Greedy suppression: per group, by falling score (ties by id), a box stays unless it overlaps a kept one by more than ``threshold``.

    ``boxes`` has id, score, x1, y1, x2, y2. A group is the detections of one frame (and class), which the detector bounds; it is one array and one fold in native
    expressions. Frames spread over tasks by hash.
    """
    one = F.struct((-F.col("score")).alias("s"), "id", "x1", "y1", "x2", "y2")
    listed = boxes.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("b"))
    empty = F.slice(F.col("b"), 1, 0)
    kept = F.aggregate("b", empty, lambda acc, x: F.when(F.exists(acc, lambda k: iou(k, x) > threshold), acc).otherwise(F.concat(acc, F.array(x))))
    rows = listed.select(*group, F.explode(kept).alias("k"))
    return rows.select(*group, "k.id", (-F.col("k.s")).alias("score"), "k.x1", "k.y1", "k.x2", "k.y2")


def tile_votes(predictions: DataFrame, size: int) -> DataFrame:
    """(frame, x, y, cls): each pixel's class of greatest weight over the tiles that see it, ties to the smaller class.

    ``predictions`` has frame, tile origin tx, ty, pixel within the tile i, j, and cls.
    """
    weighted = predictions.withColumn("w", gaussian_weight(F.col("i"), F.col("j"), size))
    sums = weighted.groupBy("frame", (F.col("tx") + F.col("j")).alias("x"), (F.col("ty") + F.col("i")).alias("y"), "cls").agg(F.sum("w").alias("w"))
    return sums.groupBy("frame", "x", "y").agg(F.max_by(F.struct("cls"), F.struct(F.round("w", 9), -F.col("cls"))).alias("c")).select("frame", "x", "y", "c.cls")


def components(mask: DataFrame, frame: str, min_area: int = 1) -> DataFrame:
    """8-connected regions of the pixels (x, y) that each frame lists: (frame, region, area, x, y, w, h), regions by first pixel in reading order.

    A frame's mask is one group; frames are bounded by the camera's size.
    """

    def label(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(int(y), int(x)) for x, y in zip(pdf["x"], pdf["y"])})
        number = {p: i for i, p in enumerate(points)}
        root = np.arange(len(points))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (y, x), i in number.items():
            for q in ((y, x - 1), (y - 1, x - 1), (y - 1, x), (y - 1, x + 1)):
                if q in number:
                    a, b = find(i), find(number[q])
                    root[max(a, b)] = min(a, b)
        if not points:
            return pd.DataFrame(columns=["f", "region", "area", "x", "y", "w", "h"])
        found = pd.DataFrame({"r": [find(i) for i in range(len(points))], "y": [p[0] for p in points], "x": [p[1] for p in points]})
        out = found.groupby("r").agg(area=("x", "size"), x=("x", "min"), y=("y", "min"), x2=("x", "max"), y2=("y", "max")).reset_index(drop=True)
        out["region"] = np.arange(len(out))
        out["w"], out["h"], out["f"] = out["x2"] - out["x"] + 1, out["y2"] - out["y"] + 1, key[0]
        return out[out["area"] >= min_area][["f", "region", "area", "x", "y", "w", "h"]]

    kind_of = mask.schema[frame].dataType.simpleString()
    rows = mask.select(frame, "x", "y").groupBy(frame).applyInPandas(label, f"f {kind_of}, region int, area int, x int, y int, w int, h int")
    return rows.withColumnRenamed("f", frame)


def colour_mask(pixels: DataFrame, h: tuple[int, int] = (90, 145), s: tuple[int, int] = (50, 255), v: tuple[int, int] = (40, 255)) -> DataFrame:
    """Pixels whose h, s and v lie in inclusive ranges."""
    return pixels.filter(F.col("h").between(*h) & F.col("s").between(*s) & F.col("v").between(*v))


def largest_region(regions: DataFrame, frame: str, width: int, height: int, pad: int = 10) -> DataFrame:
    """Each frame's region of most area (ties to the first), its rectangle padded and cut to the image."""
    w = Window.partitionBy(frame).orderBy(F.desc("area"), "region")
    top = regions.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    low = lambda c: F.greatest(F.col(c) - pad, F.lit(0))
    return top.select(frame, "area", low("x").alias("x1"), low("y").alias("y1"), F.least(F.col("x") + F.col("w") + pad, F.lit(width)).alias("x2"), F.least(F.col("y") + F.col("h") + pad, F.lit(height)).alias("y2"))


def contour_gate(df: DataFrame, min_area: float = 500, low: float = 1.2, high: float = 6.0) -> DataFrame:
    """Contours of enough area whose aspect w / h lies strictly between two bounds."""
    return df.filter((F.col("area") >= min_area) & (F.col("w") / F.col("h") > low) & (F.col("w") / F.col("h") < high))


def text_box_gate(df: DataFrame, box_threshold: float = 0.5, min_side: float = 3, limit: int = 1000) -> DataFrame:
    """Candidates in contour order up to a limit per image: at least four points, sides of min_side and, after growing, two more, and score enough."""
    w = Window.partitionBy("image").orderBy("contour")
    first = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn")
    return first.filter((F.col("n_points") >= 4) & (F.col("side") >= min_side) & (F.col("score") >= box_threshold) & (F.col("grown_side") >= min_side + 2))


def region_mean(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image, box, mean): the mean probability of the pixels inside each convex polygon (corners in order), edges included; pixels and boxes meet by image."""
    px, py = F.col("x"), F.col("y")
    side = lambda p, q: (q["x"] - p["x"]) * (py - p["y"]) - (q["y"] - p["y"]) * (px - p["x"])
    n = F.size("points")
    turns = F.transform(F.sequence(F.lit(1), n), lambda i: side(F.element_at("points", i), F.element_at("points", F.when(i == n, 1).otherwise(i + 1))))
    inside = F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)
    return pixels.join(boxes, "image").filter(inside).groupBy("image", "box").agg(F.avg("p").alias("mean"))


def median_angle(lines: DataFrame, image: str, angle: str, more_than: int = 5, least: float = 5.0) -> DataFrame:
    """(image, angle, rotate): the median angle of images with more than ``more_than`` lines; rotate if it exceeds ``least``."""
    out = lines.groupBy(image).agg(F.count("*").alias("__n"), F.median(angle).alias("angle")).filter(F.col("__n") > more_than)
    return out.select(image, "angle", (F.abs("angle") > least).alias("rotate"))
