"""Column functions for boxes, tiles, crops and rotations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(x: Column) -> Column:
    """Toward zero, as an int."""
    return x.cast("int")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(x, F.lit(high) if not isinstance(high, Column) else high))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """Centre form to corners."""
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def in_tile(box: dict[str, Column], valid_w: Column, valid_h: Column, off_x: Column, off_y: Column) -> dict[str, Column]:
    """Corners cut to the valid part of their tile (from above only) and moved to the image."""
    top = {"x1": (valid_w, off_x), "x2": (valid_w, off_x), "y1": (valid_h, off_y), "y2": (valid_h, off_y)}
    return {k: F.least(box[k], limit) + off for k, (limit, off) in top.items()}


def from_roi(box: dict[str, Column], roi: tuple[int, int, int, int], size: int = 640) -> dict[str, Column]:
    """Centre form in pixels of a resized region to corners in the image."""
    x1, y1, x2, y2 = roi
    sx, sy = (x2 - x1) / size, (y2 - y1) / size
    return corners(box["cx"] * sx + x1, box["cy"] * sy + y1, box["w"] * sx, box["h"] * sy)


def clipped(box: dict[str, Column], width: int, height: int) -> dict[str, Column]:
    """Integer corners inside the image; truncation comes first."""
    return {k: clamp(truncated(v), 0, width if k[0] == "x" else height) for k, v in box.items()}


def proper(box: dict[str, Column]) -> Column:
    return (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])


def crop_region(x_min: Column, y_min: Column, x_max: Column, y_max: Column, width: Column, height: Column) -> Column:
    """The region that a crop leaves, as a struct with ``cropped``; an invalid region leaves the whole frame."""
    c = [clamp(x_min, 0, width - 1), clamp(y_min, 0, height - 1), clamp(x_max, 0, width - 1), clamp(y_max, 0, height - 1)]
    good = (x_min < x_max) & (y_min < y_max) & (c[0] < c[2]) & (c[1] < c[3])
    pick = lambda i, whole: F.when(good, c[i]).otherwise(whole)
    return F.struct(pick(0, F.lit(0)).alias("x1"), pick(1, F.lit(0)).alias("y1"), pick(2, width).alias("x2"), pick(3, height).alias("y2"), F.coalesce(good, F.lit(False)).alias("cropped"))


def aspect_fit(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, ratio: float = 0.8) -> Column:
    """The box of aspect ``ratio`` around a box's centre, shrunk and moved into the frame; integers by truncation."""
    wide = F.when(h != 0, w / h).otherwise(F.lit(math.inf)) >= ratio
    new_w, new_h = F.when(wide, w.cast("double")).otherwise(h * ratio), F.when(wide, w / ratio).otherwise(h.cast("double"))
    scale = F.least(width / new_w, height / new_h, F.lit(1.0))
    fw, fh = truncated(new_w * scale), truncated(new_h * scale)
    place = lambda start, size, new, frame: F.greatest(F.lit(0), F.least(truncated(start + size / 2.0 - new / 2.0), frame - new))
    return F.struct(place(x, w, fw, width).alias("x"), place(y, h, fh, height).alias("y"), fw.alias("w"), fh.alias("h"))


def ordered_corners(points: Column) -> Column:
    """Four points (struct x, y) as top left, top right, bottom right, bottom left: the left two by x, then by y within each side."""
    p = F.array_sort(points)
    by_y = lambda a: F.array_sort(F.transform(a, lambda q: F.struct(q["y"].alias("y"), q["x"].alias("x"))))
    left, right = by_y(F.slice(p, 1, 2)), by_y(F.slice(p, 3, 2))
    back = lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))
    return F.array(back(left[0]), back(right[0]), back(right[1]), back(left[1]))


def upright(angle: Column) -> Column:
    """The rotation that undoes a recognised one."""
    return F.pmod(F.lit(360) - angle, F.lit(360))


def rotated_canvas(width: Column, height: Column, degrees: Column) -> Column:
    """Width and height (truncated) of the canvas that holds a rotated image."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    return F.struct(truncated(height * s + width * c).alias("w"), truncated(height * c + width * s).alias("h"))


def edge(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def crop_size(tl: Column, tr: Column, br: Column, bl: Column) -> Column:
    """Width and height of a perspective crop, and whether it is turned (height at least 1.5 widths)."""
    side = lambda a, b: edge(a["x"], a["y"], b["x"], b["y"])
    w, h = truncated(F.greatest(side(tl, tr), side(bl, br))), truncated(F.greatest(side(tl, bl), side(tr, br)))
    return F.struct(w.alias("w"), h.alias("h"), (h >= w * 1.5).alias("turned"))


def resized_width(width: Column, height: Column, target_h: int = 48, target_w: int = 320) -> Column:
    """Width at a target height, between 1 and the target width."""
    return F.greatest(F.lit(1), F.least(truncated(target_h * (width / height)), F.lit(target_w)))


def unclip_distance(area: Column, perimeter: Column, ratio: float = 1.5) -> Column:
    """How far a polygon grows; null for one of less than unit area."""
    return F.when(area >= 1, area * ratio / perimeter)


def unclipped(points: Column, ratio: float = 1.5) -> Column:
    """Points scaled about their centre by 1 + 0.3 * ratio."""
    n = F.size(points)
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / n
    grow = lambda p, k: (mean(k) + (p[k] - mean(k)) * (1 + ratio * 0.3)).alias(k)
    return F.transform(points, lambda p: F.struct(grow(p, "x"), grow(p, "y")))


def gaussian_weight(i: Column, j: Column, size: int) -> Column:
    """Weight of a pixel of a square tile: exp(-(x^2 + y^2) / 0.5) for x and y from -1 to 1."""
    x, y = -1 + 2 * j / (size - 1), -1 + 2 * i / (size - 1)
    return F.exp(-(x * x + y * y) / 0.5)


def tile_grid(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """Tiles from every step of tile - overlap, cut at the image's end: array of (x1, y1, x2, y2)."""
    step = tile - overlap
    starts = lambda n: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(x.alias("x1"), y.alias("y1"), F.least(x + tile, width).alias("x2"), F.least(y + tile, height).alias("y2")))))


def shifted_tile_grid(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """Tiles of full size where the image allows it: the last ones are moved back inside."""
    step = tile - overlap
    count = lambda n: F.when(n > tile, F.greatest(F.lit(1), F.ceil((n - overlap) / step).cast("int"))).otherwise(1)
    place = lambda k, n: F.when(n > tile, F.least(k * step, F.greatest(F.lit(0), n - tile))).otherwise(0)
    return F.flatten(F.transform(F.sequence(F.lit(0), count(height) - 1), lambda a: F.transform(F.sequence(F.lit(0), count(width) - 1), lambda b: F.struct(
        place(b, width).alias("x1"), place(a, height).alias("y1"), F.least(place(b, width) + tile, width).alias("x2"), F.least(place(a, height) + tile, height).alias("y2")))))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with x1, y1, x2, y2."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    area = lambda q: (q["x2"] - q["x1"]) * (q["y2"] - q["y1"])
    return w * h / (area(a) + area(b) - w * h)
