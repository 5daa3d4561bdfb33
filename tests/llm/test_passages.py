"""Repeated passages against brute force and planted cases."""

import pyarrow as pa

from sightline.llm import passages, queries, words
from sightline.llm.common import table

PASSAGE = [f"word{i}" for i in range(60)]


def slow_words(text):
    return [w.encode().lower() for w in passages.WORD.findall(text)]


def by_force(docs):
    """The spans of words that stand in a window of 50 words seen earlier, for each document."""
    first, out = {}, set()
    for doc_id, text in sorted((i, t or "") for i, t in docs if i is not None):
        found, gone = slow_words(text), set()
        for p in range(len(found) - 49):
            at = first.setdefault(tuple(found[p : p + 50]), (doc_id, p))
            if at[0] != doc_id or p >= at[1] + 50:
                gone.update(range(p, p + 50))
        for p in sorted(gone):
            if p - 1 not in gone:
                n = next(n for n in range(1, len(found) + 1) if p + n not in gone)
                out.add((doc_id, p, n))
    return out


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = queries.QUERIES["op4_substring_dedup"](spark, sf_dir).collect()
    assert len(got) > 0 and {(r["doc_id"], r["word"], r["n_words"]) for r in got} == by_force(docs)
    texts = dict(docs)
    assert all(len(slow_words(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]])) == r["n_words"] for r in got)


def test_words_and_spans_of_any_text():
    texts = ["", " \t\n", "a B\x0b\x0cc ", "見 出し", "É\xa0x\x1cy  \r\nz", "กข ab", "x" * 70]
    for some in (texts, [t for t in texts if t.isascii()], [""], []):
        found, counts, unspaced = passages.words(pa.array(some, pa.string()))
        assert [w.encode() for w in found.to_pylist()] == [w for t in some for w in slow_words(t)] and counts.tolist() == [len(slow_words(t)) for t in some]
        starts, stops = passages.spans(some, unspaced)
        joined = "\n".join(some)
        assert [joined[a:b].encode().lower() for a, b in zip(starts, stops)] == [w for t in some for w in slow_words(t)]


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 10)
    batch = pa.record_batch({"text": ["a" * n for n in (3, 0, 8, 30, 0, 2, 2)]})
    parts = [p.column(0).to_pylist() for p in words.slices(batch, "text")]
    assert sum(parts, []) == batch.column(0).to_pylist() and [len(p) for p in parts] == [2, 1, 1, 3]


def test_result_does_not_depend_on_slices(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(40)
    rows = passages._rows(docs).toArrow().combine_chunks().to_batches()
    whole = [p for b in rows for p in words.slices(b, "text")]

    def made(parts):
        out = set()
        for part in parts:
            found, counts, _ = passages.words(part.column("text"))
            of, *rest = passages.paragraphs(passages.Digests().of(found), counts, passages.Powers().upto(len(found)))
            out |= set(zip(part.column("doc_id").to_numpy()[of].tolist(), *(x.tolist() for x in rest)))
        return out

    monkeypatch.setattr(words, "SLICE_BYTES", 1)
    assert made(whole) == made(p for b in rows for p in words.slices(b, "text")) != set()


def test_extra_columns_repeated_rows_and_very_long_texts(spark):
    inline = " ".join(PASSAGE)
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, long), (1, long), (2, f"{long} {inline}"), (3, inline), (3, inline), (4, "x" * 300_000), (5, f"{inline} y"), (5, "other words")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, version string, word string, gram string, runs string")
    got = {(r["doc_id"], r["word"], r["n_words"], r["earlier_doc_id"], r["earlier_word"]) for r in passages.repeated_passages(docs).collect()}
    assert got == {(2, 0, 150_000, 1, 0), (3, 0, 60, 2, 150_000), (5, 0, 60, 2, 150_000)}
    out = passages.without_passages(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(
        [(1, long), (1, long), (2, f" {inline}"), (3, ""), (3, ""), (4, "x" * 300_000), (5, " y"), (5, "other words")]
    )


def test_planted_inline_passages(spark):
    inline = " ".join(PASSAGE)
    rows = [(1, f"one line {inline} goes on"), (2, f"Ünlike words {inline.upper()} and\nmore"), (3, f"again {inline}\n{inline}"), (4, " ".join(PASSAGE[:49])), (None, inline), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {(r["doc_id"], r["start"], r["length"], r["n_words"], r["earlier_doc_id"], r["earlier_word"]) for r in passages.repeated_passages(docs).collect()}
    assert got == {(2, 13, len(inline), 60, 1, 2), (3, 6, 2 * len(inline) + 1, 120, 1, 2)}
    out = passages.without_passages(docs)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == docs.columns and texts[2] == ("Ünlike words  and\nmore", 22) and texts[3] == ("again ", 6)
    assert all(texts[i][0] == t for i, t in rows if i not in (2, 3))
    assert passages.without_passages(docs.limit(0)).count() == 0


def test_passages_of_short_lines_and_without_blanks(spark):
    lines = "\n".join(" ".join(PASSAGE[i : i + 12]) for i in range(0, 60, 12))
    han = "".join(chr(0x4E00 + i) for i in range(70))
    rows = [(1, f"Heading\n{lines}\nend"), (2, f"Heading\nother\n{lines}\n"), (3, han), (4, f"see 「{han}」")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["start"], r["n_words"], r["earlier_doc_id"]) for r in passages.repeated_passages(docs).collect()} == {(2, 14, 60, 1), (4, 5, 70, 3)}
    left = {r["doc_id"]: r["text"] for r in passages.without_passages(docs).collect()}
    assert left == {1: rows[0][1], 2: "Heading\nother\n\n", 3: han, 4: "see 「」"}


def test_a_run_of_one_word_keeps_its_first_window(spark):
    docs = spark.createDataFrame([(1, "x " * 130)], "doc_id long, text string")
    assert [(r["word"], r["n_words"]) for r in passages.repeated_passages(docs).collect()] == [(50, 80)]
