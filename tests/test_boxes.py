import random

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import boxes, frames


def test_best_class_takes_first_maximum_and_inclusive_threshold(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.1, 0.2],)], "s array<double>")
    rows = boxes.best_class(df, F.col("s"), 0.5).collect()
    assert [(r["cls"], r["conf"]) for r in rows] == [(0, 0.5)]


def test_suppression_is_idempotent_and_strict(spark):
    rows = [(1, 1, 0.9, 0, 0, 10, 10), (1, 2, 0.8, 0, 5, 10, 15), (1, 3, 0.7, 100, 100, 110, 110), (1, 4, 0.9, 0, 0, 10, 10)]
    df = spark.createDataFrame(rows, "f int, id int, score double, x1 int, y1 int, x2 int, y2 int")
    once = boxes.suppressed(df, ["f"], 1 / 3)
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 3]  # an overlap of exactly the threshold stays
    assert sorted(boxes.suppressed(once, ["f"], 1 / 3).collect()) == sorted(once.collect())


def test_tile_grids_cover_the_image(spark):
    for w, h in ((700, 500), (640, 640), (100, 2000), (3840, 2160)):
        for tiles in (g.tile_grid(F.lit(w), F.lit(h), 640, 128), g.shifted_tile_grid(F.lit(w), F.lit(h), 1024, 128)):
            found = spark.range(1).select(tiles.alias("t")).first()["t"]
            xs, ys = {(t["x1"], t["x2"]) for t in found}, {(t["y1"], t["y2"]) for t in found}
            assert set(range(w)) == {x for a, b in xs for x in range(a, b)} and set(range(h)) == {y for a, b in ys for y in range(a, b)}


def test_crop_region(spark):
    region = lambda *c: spark.range(1).select(g.crop_region(*map(F.lit, c)).alias("r")).first()["r"]
    assert tuple(region(500, 300, 1500, 900, 3840, 2160)) == (500, 300, 1500, 900, True)
    assert tuple(region(5, 5, 5, 9, 100, 80)) == (0, 0, 100, 80, False)
    assert tuple(region(200, 0, 300, 50, 100, 80)) == (0, 0, 100, 80, False)
    assert tuple(region(-10, -10, 5000, 5000, 100, 80)) == (0, 0, 99, 79, True)


def test_corner_order_and_sizes(spark):
    p = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 0), (0, 10), (10, 10), (0, 0))])
    row = spark.range(1).select(g.ordered_corners(p).alias("c"), g.unclipped(p, 1.0).alias("u")).first()
    assert [tuple(q) for q in row["c"]] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert abs(row["u"][0]["x"] - 11.5) < 1e-9
    size = spark.range(1).select(g.crop_size(*[g.ordered_corners(p)[i] for i in range(4)]).alias("s")).first()["s"]
    assert tuple(size) == (10, 10, False)


def flood(points):
    left, out = set(points), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            x, y = todo.pop()
            part.append((x, y))
            for q in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append((len(part), min(x for x, _ in part), min(y for _, y in part)))
    return sorted(out)


def test_components_match_flood_fill(spark):
    rng = random.Random(3)
    points = [(f, rng.randrange(20), rng.randrange(15)) for f in (1, 2) for _ in range(90)]
    df = spark.createDataFrame(points, "f int, x int, y int")
    rows = boxes.components(df, "f").collect()
    for f in (1, 2):
        assert sorted((r["area"], r["x"], r["y"]) for r in rows if r["f"] == f) == flood({(x, y) for k, x, y in points if k == f})
    assert boxes.components(df.limit(0), "f").count() == 0


def test_gates_and_regions(spark):
    df = spark.createDataFrame([(500.0, 20.0, 10.0), (499.0, 20.0, 10.0), (900.0, 12.0, 10.0), (900.0, 60.0, 10.0)], "area double, w double, h double")
    assert boxes.contour_gate(df).count() == 1
    text = spark.createDataFrame([(1, 1, 4, 3.0, 0.5, 5.0), (1, 2, 3, 9.0, 0.9, 9.0), (1, 3, 4, 9.0, 0.4, 9.0), (1, 4, 4, 9.0, 0.9, 9.0)], "image int, contour int, n_points int, side double, score double, grown_side double")
    assert [r["contour"] for r in boxes.text_box_gate(text, limit=3).collect()] == [1]
    pixels = spark.createDataFrame([(1, float(x), float(y), float(x)) for x in range(4) for y in range(4)], "image int, x double, y double, p double")
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    box = spark.createDataFrame([(1, 7, square)], "image int, box int, points array<struct<x:double,y:double>>")
    assert boxes.region_mean(pixels, box).first()["mean"] == 1.0
    regions = spark.createDataFrame([(1, 0, 5, 3, 3, 4, 4), (1, 1, 5, 50, 30, 9, 9)], "f int, region int, area int, x int, y int, w int, h int")
    assert tuple(boxes.largest_region(regions, "f", 60, 40).first()) == (1, 5, 0, 0, 17, 17)


def test_median_angle_needs_more_than_five(spark):
    df = spark.createDataFrame([(1, float(a)) for a in range(5)] + [(2, float(a)) for a in (1, 2, 3, 8, 9, 10)], "i int, a double")
    assert [tuple(r) for r in boxes.median_angle(df, "i", "a").collect()] == [(2, 5.5, True)]


def test_sharpness_and_ties(spark):
    flat = spark.createDataFrame([([5] * 16,)], "p array<bigint>").select(frames.sharpness(F.col("p"), 4, 4)).first()[0]
    assert flat == 0.0
    df = spark.createDataFrame([(1, 3, 2.0), (1, 2, 2.0), (1, 1, None)], "g int, i int, s double")
    assert frames.best_of(df, ["g"], "s", ["i"]).first()["i"] == 2
    assert frames.central_roi(100, 50) == (10, 5, 90, 45)
