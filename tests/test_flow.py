import pytest
from pyspark.sql import functions as F

from sightline.functions import strings
from sightline.functions.hooks import rotated_reading, with_model
from sightline.operators import frames, registry, vectors
from sightline.plans import catalogue, recognition
from sightline.plans.cache import RegistryCache
from sightline.sources import frames as capture
from sightline.sources import sinks, tables
from sightline.streaming import runs, states


def test_reconcile_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "b int, i string")
    e = spark.createDataFrame([(1, "y"), (1, "w"), (3, "q")], "b int, i string")
    one = {r["b"]: tuple(r)[1:] for r in registry.reconcile_sets(a, e, "b", "i").collect()}
    two = {r["b"]: tuple(r)[1:] for r in registry.reconcile_sets(e, a, "b", "i").collect()}
    assert one == {1: ("w", "x", False), 2: ("", "z", False), 3: ("q", "", False)}
    assert two == {k: (y, x, m) for k, (x, y, m) in one.items()}


def test_point_lookup_and_upsert(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "id int, n string")
    assert registry.point_lookup(df, "n", "a", "id").first()["id"] == 1
    base = spark.createDataFrame([("k", 1)], "k string, v int")
    new = spark.createDataFrame([("k", 2, 1), ("k", 3, 2), ("n", None, 1)], "k string, v int, at int")
    assert sorted(sinks.upsert(base, new, "k", "at").collect(), key=str) == [("k", 3), ("n", None)]


def test_templates_long_and_wide(spark):
    df = spark.createDataFrame([("a", "p", None, "q")], "l string, s1 string, s2 string, s3 string")
    assert [tuple(r) for r in sinks.long_templates(df, "l", ["s1", "s2", "s3"]).collect()] == [("a", 1, "p"), ("a", 3, "q")]


def test_fewer_than_two_neighbours_never_pass(spark):
    q = spark.createDataFrame([(1, [0, 0])], "q int, v array<bigint>")
    t = spark.createDataFrame([("one", 1, [0, 1]), ("two", 2, [0, 1]), ("two", 3, [9, 9])], "i string, t int, w array<bigint>")
    pairs = vectors.nearest_two(q, t, "q", "v", "i", "w")
    found = {r["i"]: r["good"] for r in vectors.good_matches(pairs, "i", 0.7).collect()}
    assert found == {"one": 0, "two": 1}


def test_first_candidate_when_no_templates(spark):
    candidates = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "c", 0)], "q int, i string, p int")
    ranked = spark.createDataFrame([(2, "c", 0.4, 1)], "q int, i string, confidence double, rank int")
    assert sorted(tuple(r) for r in vectors.or_first_candidate(ranked, candidates, "q", "i", "p").collect()) == [(1, "b", 0.0), (2, "c", 0.4)]


def test_hamming_and_confidence(spark):
    row = spark.createDataFrame([([255, 0], [254, 3])], "a array<int>, b array<int>")
    assert row.select(vectors.hamming_distance(F.col("a"), F.col("b"))).first()[0] == 3
    assert row.select(vectors.confidence(F.lit(30)), vectors.confidence(F.lit(0))).first()[:] == (0.6, 0.0)


def test_majority_prefers_first_seen(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a "), (1, 4, "b"), (1, 5, " "), (2, 1, None)], "g int, o int, v string")
    assert [tuple(r) for r in frames.majority(df, "g", F.col("v"), "o").collect()] == [(1, "b", 2)]


def test_recognised_statuses(spark):
    texts = spark.createDataFrame([("red bolt",), ("qqqqqq",), (" a",)], "t string")
    names = spark.createDataFrame([("red bolt",), ("blue nut",)], "n string")
    bottle = {r["text"]: (r["status"], r["candidates"]) for r in recognition.recognised(texts, names, "t", "n").collect()}
    assert bottle["red bolt"][0] == "matched" and bottle["red bolt"][1][0] == "red bolt"
    assert bottle["qqqqqq"] == ("all_names", ["blue nut", "red bolt"]) and bottle[" a"] == ("empty_text", [])
    bag = {r["text"]: r["status"] for r in recognition.recognised(texts, names, "t", "n", "bag").collect()}
    assert bag["qqqqqq"] == "no_match"


def test_model_hook_survives_a_bad_input(spark):
    def loader():
        def model(inputs):
            if "bad" in inputs:
                raise ValueError
            return [[(x, 0.0, 0.0, 1.0)] for x in inputs]

        return model

    df = spark.createDataFrame([("ok",), ("bad",)], "c string").coalesce(1)
    rows = {r["c"]: r["o"] for r in with_model(df, loader, "c", "o", "array<struct<text:string,center_x:double,center_y:double,conf:double>>").collect()}
    assert rows["bad"] is None and rows["ok"][0]["text"] == "ok"
    assert [rotated_reading(a) for a in (0, 90, 180, 270)] == [0, 270, 180, 90]


def test_capture_reconnects_skips_and_limits():
    opened = []

    def opener():
        opened.append(1)
        if len(opened) == 1:
            raise OSError
        return iter([(k * 0.125, b"") for k in range(20)])

    pauses = []
    got = [t for t, _ in capture.Capture(opener, fps=4, skip=10, sleep=pauses.append).frames(3)]
    assert pauses == [3.0] and got == [1.25, 1.5, 1.75, 2.0, 2.25]


def test_frame_source_streams(spark):
    spark.dataSource.register(capture.FrameSource)
    stream = spark.readStream.format("frames").option("frames", 25).load()
    assert runs.drained(stream).count() in (10, 25)  # what is there at the start, batch by batch


def test_stream_spacing_equals_batch(spark, sf_dir):
    batch = frames.spaced(tables.table(spark, sf_dir, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "event_id", 3600)
    stream = runs.drained(states.spaced_stream(runs.event_stream(spark, sf_dir), "user_id", "seconds", "event_id", 3600))
    assert sorted(tuple(r) for r in batch.select("user_id", "event_id").collect()) == sorted(tuple(r) for r in stream.select("user_id", "event_id").collect())


def test_window_stream_equals_batch_on_closed_windows(spark, sf_dir):
    stream = runs.drained(states.best_per_window(runs.event_stream(spark, sf_dir), "ts", "value", "event_id", "1 hour", "10 minutes"))
    events = tables.table(spark, sf_dir, "events").withColumn("w", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    batch = {r["w"]: r["event_id"] for r in frames.best_of(events.select("w", "event_id", "value"), ["w"], "value", ["event_id"]).collect()}
    got = {r["window_start"]: r["best"] for r in stream.collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(batch) - len(got) <= 2


def test_sources(spark, tmp_path):
    (tmp_path / "drug").mkdir()
    for name in ("b.PNG", "a.jpg", "c.txt", "d.Jpg"):
        (tmp_path / "drug" / name).write_bytes(b"x")
    rows = tables.image_files(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r["label"], r["name"]) for r in rows] == [("drug", "a.jpg"), ("drug", "b.PNG"), ("drug", "d.Jpg")]
    (tmp_path / "keys.txt").write_text("甲\n乙\n")
    assert [tuple(r) for r in tables.char_dictionary(spark, str(tmp_path / "keys.txt")).orderBy("idx").collect()] == [(0, ""), (1, "甲"), (2, "乙"), (3, " ")]
    log = tmp_path / "log.csv"
    log.write_text(",".join(f"c{i}" for i in range(15)) + "\n1," + ",".join(["0.5"] * 14) + "\n")
    assert tables.training_log(spark, str(log)).first()["map50_b"] == 0.5
    assert tables.file_name("a/b/") == "b"


def test_saves_and_segments(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, bytearray(b"x")), (1, 1, None)], "ms long, n int, content binary")
    assert sinks.saved_count(sinks.save_images(df, str(tmp_path / "o"), "bag")).first()["n_saved"] == 1
    f = spark.createDataFrame([(float(t),) for t in range(20)], "ts double")
    assert [r["n"] for r in sinks.segments(f, "ts", 5, 5, 2).groupBy("segment").agg(F.count("*").alias("n")).orderBy("segment").collect()] == [5, 5]
    assert sinks.latest_per_tick(f, "ts", 0.5).count() == 10
    p = spark.createDataFrame([([0.0, 1.0],), ([300.0, -4.0],)], "p array<double>")
    assert [r[0] for r in p.select(sinks.byte_pixels(F.col("p"))).collect()] == [[0, 255], [255, 0]]


def test_registry_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, None)], "item string, template_no int, value string").write.parquet(path)
    state = {"n": 0}

    def save(df):
        state["n"] += 1
        df.write.parquet(f"{path}{state['n']}")

    cache = RegistryCache(lambda: spark.read.parquet(f"{path}{state['n'] or ''}"), save)
    assert {r["item"] for r in cache.names().collect()} == {"a", "b"}
    cache.enrol(spark.createDataFrame([("b", "z", 2), ("b", "w", 1), ("d", "v", 1)], "item string, value string, o int"), "o", 1)
    assert {(r["item"], r["value"]) for r in cache.templates.collect()} == {("a", "x"), ("b", "w"), ("c", None), ("d", "v")}
    merged = cache.enrol_by_key(spark.createDataFrame([("a", 1, "q", 1), ("a", 2, "r", 1)], "item string, template_no int, value string, at int"), "at")
    assert {(r["item"], r["template_no"], r["value"]) for r in merged.collect() if r["item"] == "a"} == {("a", 1, "q"), ("a", 2, "r")}


def test_strings(spark):
    df = spark.createDataFrame([("a/b.PNG//", None, bytearray("é".encode()))], "p string, n string, r binary")
    row = df.select(strings.base_name(F.col("p")), strings.is_image(strings.bare_path(F.col("p"))), strings.one_name(F.col("n"), F.lit(" "), F.lit(" z ")), strings.decoded(F.col("r")), strings.ordered_distinct(F.array(F.lit(2), F.lit(1), F.lit(2)))).first()
    assert tuple(row) == ("b.PNG", True, "z", "é", [2, 1])


def test_a_camera_behind_a_stream_source(spark):
    def opener():  # a first connection that breaks, then another; cloudpickle carries its state
        yield from ((i / 4, b"%d" % i) for i in range(30))

    spark.dataSource.register(capture.frame_source("camera", opener, skip=10, sleep=lambda s: None))
    rows = runs.drained(spark.readStream.format("camera").option("fps", 1).option("batch", 100).load())
    assert [r["ts"] for r in rows.orderBy("frame_id").collect()] == [2.5 + k / 2 for k in range(10)]


def test_a_capture_without_frames_raises():
    def broken():
        raise OSError

    reader = capture._Reader(capture.Capture(broken, sleep=lambda s: None), 10, 3)
    with pytest.raises(ConnectionError):
        reader.read({"frame": 0})


def test_a_reader_goes_on_and_replays():
    opener = lambda: iter([(float(i), b"x") for i in range(25)])
    reader = capture._Reader(capture.Capture(opener, skip=5, sleep=lambda s: None), 8, 1)
    rows, offset = reader.read({"frame": 0})
    more, end = reader.read(offset)
    assert [r[0] for r in [*rows, *more]] == list(range(16)) and end == {"frame": 16}
    assert [r[1] for r in reader.readBetweenOffsets({"frame": 8}, {"frame": 11})] == [13.0, 14.0, 15.0]


def test_buffers_of_several_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    key = lambda r: r["user_id"]
    one, many = (sorted(catalogue.QUERIES["q51_latest_stream"](spark, str(d)).collect(), key=key) for d in (sf_dir, tmp_path))
    assert one == many


def test_triggers_and_stop(spark, sf_dir, tmp_path):
    seen = []
    stream = runs.event_stream(spark, sf_dir)
    runs.once(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "once"))
    assert sum(seen) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    query = runs.periodic(stream, lambda df, n: seen.append(-1), 1, str(tmp_path / "periodic"))
    query.processAllAvailable()
    assert runs.stop(query) and not query.isActive and seen[-1] == -1
