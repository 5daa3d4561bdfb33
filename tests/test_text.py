from pyspark.sql import functions as F

from sightline.operators import fuzzy, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_han_only(spark):
    assert one(spark, text.keep_class(F.col("t")), t="AB头孢12钠!") == "头孢钠"


def test_fields_last_line_wins(spark):
    lines = [(1, ["氯化钠 注射液 0.9 %", "250 ml", "葡萄糖液 5% 100ml"]), (2, ["水"]), (3, [])]
    df = spark.createDataFrame(lines, "id int, lines array<string>")
    fields = {"name": text.NAME_FIELD, "conc": text.CONCENTRATION_FIELD, "vol": text.VOLUME_FIELD}
    rows = {r["id"]: r for r in text.extract_fields(df, "lines", fields).collect()}
    assert (rows[1]["name"], rows[1]["conc"], rows[1]["vol"], rows[1]["status"]) == ("葡萄糖液", "5%", "100ml", "ok")
    assert rows[2]["status"] == rows[3]["status"] == "missing"


def test_collapse(spark):
    for steps, expected in [([1, 1, 0, 1, 2, 2], [1, 1, 2]), ([0, 0], []), ([], []), ([3], [3])]:
        df = spark.createDataFrame([(steps,)], "s array<int>")
        assert df.select(text.collapse(F.col("s")).alias("x")).first()["x"] == expected


def test_ctc_decode(spark):
    probabilities = [[0.1, 0.8, 0.1], [0.2, 0.7, 0.1], [0.9, 0.05, 0.05], [0.1, 0.6, 0.3], [0.1, 0.2, 0.7]]
    df = spark.createDataFrame([(probabilities,), ([[0.9, 0.1, 0.0]],), ([],)], "s array<array<double>>")
    rows = text.ctc_decode(df, "s", F.array(F.lit(""), F.lit("a"), F.lit("b"))).collect()
    assert rows[0]["text"] == "aab" and abs(rows[0]["confidence"] - (0.8 + 0.6 + 0.7) / 3) < 1e-12
    assert rows[1]["text"] == rows[2]["text"] == "" and rows[1]["confidence"] == rows[2]["confidence"] == 0.0
    logits = spark.createDataFrame([([[0.0, 2.0, 0.0], [0.0, 0.0, 3.0]],)], "s array<array<double>>")
    row = text.ctc_decode(logits, "s", F.array(F.lit(""), F.lit("a"))).first()
    assert row["text"] == "a" and 0.78 < row["confidence"] < 0.79  # the label beyond the dictionary is dropped


def test_line_merge_compares_with_the_block_before(spark):
    df = spark.createDataFrame([(1, 0.0, "a", 0), (1, 20.0, "b", 1), (1, 40.0, "c", 2), (1, 60.1, "d", 3)], "g int, y double, t string, i int")
    rows = text.merged_lines(text.line_numbers(df, "g", F.col("y"), ["i"], 20), "g", "t", ["y", "i"]).orderBy("line").collect()
    assert [r["text"] for r in rows] == ["abc", "d"]


def test_length_guard(spark):
    df = spark.createDataFrame([("abc",), (" ab\t",), (None,)], "t string")
    assert [r[0] for r in df.select(text.length_guard(F.col("t"), 3)).collect()] == ["ok", "empty", "empty"]


def test_windowed_score(spark):
    pairs = [("abc", "xxabcxx", 100), ("abd", "xxabcxx", 67), ("", "abc", 0), ("abc", "", 0), ("头孢", "头孢钠", 100)]
    df = spark.createDataFrame(pairs, "a string, b string, e int")
    assert all(r["s"] == r["e"] for r in df.select("e", fuzzy.windowed_score(F.col("a"), F.col("b")).alias("s")).collect())


def test_indel_by_hand():
    assert fuzzy.indel_ratio("abc", "abd") == 200 * 2 / 6
    assert fuzzy.indel_ratio("", "") == 100 and fuzzy.indel_ratio("a", "") == 0
    assert fuzzy.partial_ratio("ABC!", "xxabcxx") == 100 and fuzzy.partial_ratio("", "abc") == 0
    assert fuzzy.partial_ratio("abd", "xxabcxx") == 67
    assert fuzzy.partial_ratio("abcd", "xxabc") == 86  # the window that hangs over the end is "abc"


def test_top_k_in_slices_is_the_same(spark):
    texts = spark.createDataFrame([("red bolt",), ("blu ring",), ("zzz",), ("",), (None,)], "t string")
    names = spark.createDataFrame([(n,) for n in ("red bolt", "red ring", "blue ring", "small nut", "small nut", None)], "n string")
    whole = fuzzy.top_k(texts, names, "t", "n", 2).collect()
    parts = fuzzy.top_k(texts, names, "t", "n", 2, slice_size=2).collect()
    assert sorted(whole) == sorted(parts) and ("red bolt", 1, "red bolt", 100) in [tuple(r) for r in whole]
    every = fuzzy.or_all(texts.filter("t is not null"), fuzzy.top_k(texts, names, "t", "n"), names, "t", "n")
    assert {r["name"] for r in every.filter("text = 'zzz'").collect()} == {"red bolt", "red ring", "blue ring", "small nut"}
