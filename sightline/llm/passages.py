"""Substring dedup by paragraph hashing, with paragraphs that the content itself delimits.

A written line or paragraph is too coarse a unit: a passage that stands inside a longer line, or over several, has no line of its own. So
paragraphs are cut by content. Words are what ASCII blanks part, line feeds among them, with A-Z lower-cased; in scripts without blanks each letter is a word. Neighbouring
windows of MIN_PASSAGE words that share their least gram (winnowing) make one paragraph, which is the same wherever the passage stands. Paragraphs are
digested and the digests grouped globally; the occurrence that ranks first, by doc_id and place, is kept, and the others are removed, with their original offsets retained.
Paragraphs at the edges of a passage hold words from outside it; those that share a gram with others are therefore grouped window by window as well, by
128-bit digests, which makes the result exact: a window is removed if and only if it occurs earlier.

A hot passage is as many rows as documents hold it, in joins that adaptive execution splits and aggregates that combine before the shuffle; what is gathered
in one row is the paragraphs of one document.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import discard, fresh, staged, text_or_empty
from sightline.llm.words import Memory, numbered, ragged, slices

#: Words of the shortest passage that is cut.
MIN_PASSAGE = 50
#: Words of a gram; a window holds MIN_PASSAGE - GRAM + 1 of them.
GRAM = 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Thai to Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^ \t-\r{UNSPACED}]+")
BLOCK_SCHEMA = "doc_id long, version long, word int, n int, gram long, digest long, inside boolean"
PLACE_SCHEMA = "doc_id long, version long, word int, n_words int, start int, stop int, earlier_doc_id long, earlier_word int, a long, b long"


def spread(texts: pa.Array) -> tuple[pa.Array, bool]:
    """Texts with blanks around letters of scripts that have none, and whether there are such letters."""
    found = pc.match_substring_regex(texts, f"[{UNSPACED}]")
    if not pc.any(found).as_py():
        return texts, False
    return pc.if_else(found, pc.replace_substring_regex(texts, f"([{UNSPACED}])", r" \1 "), texts), True


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, bool]:
    """Normalised words of all texts in a row, how many each text has, and whether some text needed ``spread``."""
    texts, unspaced = spread(pc.ascii_lower(texts))
    texts = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(texts)
    some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    found = lists.flatten()
    counts = np.where(some, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    return (found if some.all() else found.filter(pc.greater(pc.binary_length(found), 0))), counts, unspaced


def spans(texts: list[str], unspaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of all words in a row, counted from the first text, with one character between texts."""
    joined = "\n".join(texts)
    if unspaced:
        found = np.array([m.span() for m in WORD.finditer(joined)], np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = np.concatenate([[True], (points == 32) | ((points >= 9) & (points <= 13)), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


class Digests:
    """128-bit digests of words, remembered up to a bound."""

    def __init__(self):
        self.memory = Memory()

    def of(self, found: pa.Array) -> np.ndarray:
        """(2, n) halves of the words' digests."""
        at, distinct = numbered(found)
        out = self.memory.get(distinct)
        for i, d in enumerate(out):
            if d is None:
                out[i] = hashlib.blake2b(distinct[i].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                self.memory.put(distinct[i], out[i])
        return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2).T[:, at]


def rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of each n consecutive items, by doubling."""
    if len(h) < n:
        return h[:0]
    out, width, part, w = None, 0, h, 1
    while n:
        by = np.uint64(pow(base, w, 1 << 64))
        if n & 1:
            rest = part[width:]
            out = part if out is None else out[: len(rest)] * by + rest[: len(out)]
            width += w
        n >>= 1
        if n:
            part, w = part[:-w] * by + part[w:], 2 * w
    return out


def sliding(op, x: np.ndarray, n: int) -> np.ndarray:
    """Least or greatest of each n consecutive items."""
    w = 1
    while 2 * w <= n:
        x, w = op(x[:-w], x[w:]), 2 * w
    return op(x[: w - n], x[n - w :]) if w < n else x


def least_grams(h: np.ndarray) -> np.ndarray:
    """The least gram of each window of MIN_PASSAGE words."""
    return sliding(np.minimum, rolled(h, GRAM, BASES[0]), MIN_PASSAGE - GRAM + 1)


class Powers:
    """Powers of the digest's base and of its inverse, as many as were asked for."""

    def __init__(self):
        self.table = np.ones((2, 1), np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if self.table.shape[1] <= n:
            steps = np.full((2, 2 * n), BASES[1], np.uint64)
            steps[1] = pow(BASES[1], -1, 1 << 64)
            steps[:, 0] = 1
            self.table = np.cumprod(steps, 1)
        return self.table


def paragraphs(h: np.ndarray, counts: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paragraphs of a row of texts: (text, first word, windows, gram, digest, inside), see ``blocks``."""
    text = np.repeat(np.arange(len(counts)), counts)
    if len(text) < MIN_PASSAGE:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    least, whole = least_grams(h[0]), text[: 1 - MIN_PASSAGE] == text[MIN_PASSAGE - 1 :]  # a window lies within one text
    change = np.concatenate([[True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    cuts = np.flatnonzero(change)
    long = np.diff(cuts, append=len(least))
    at, long = cuts[whole[cuts]], long[whole[cuts]]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[1] * powers[0, : len(text)])])
    digest = (sums[at + long + MIN_PASSAGE - 1] - sums[at]) * powers[1, at]
    of, gram = text[at], least[at]
    order = np.lexsort((gram, of))
    same = (gram[order][1:] == gram[order][:-1]) & (of[order][1:] == of[order][:-1])
    inside = long > MIN_PASSAGE - GRAM + 1
    inside[order] |= np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return of, at - (np.cumsum(counts) - counts)[of], long, gram, digest, inside


def blocks(docs: DataFrame) -> DataFrame:
    """The paragraphs of ``docs(doc_id, version, text)``: (doc_id, version, word, n, gram, digest, inside), n windows from ``word`` on with one least gram, and the digest of their words.

    ``inside`` says that the document may repeat windows of the paragraph itself: it holds more windows than one place of a gram can, or another one of the document has the gram.
    """

    def batches(it):
        memo, powers = Digests(), Powers()
        for b in it:
            for part in slices(b, "text"):
                found, counts, _ = words(part.column("text"))
                of, word, n, gram, digest, inside = paragraphs(memo.of(found), counts, powers.upto(len(found)))
                ids, versions = (part.column(k).to_numpy(zero_copy_only=False)[of] for k in ("doc_id", "version"))
                columns = [ids, versions, word.astype(np.int32), n.astype(np.int32), gram.view(np.int64), digest.view(np.int64), inside]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["doc_id", "version", "word", "n", "gram", "digest", "inside"])

    return docs.mapInArrow(batches, BLOCK_SCHEMA)


def placed(docs: DataFrame) -> DataFrame:
    """Places of ``docs(doc_id, version, text, runs)``, offsets in characters: a row for each run that is repeated as a whole, and one with its digest (a, b) for each window of the others."""

    def batches(it):
        memo = Digests()
        for b in it:
            for part in slices(b, "text"):
                texts, runs = part.column("text"), part.column("runs")
                found, counts, unspaced = words(texts)
                texts = texts.to_pylist()
                starts, stops = spans(texts, unspaced)
                sizes = np.array([len(t) + 1 for t in texts], np.int64)
                char, first = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
                of = np.repeat(np.arange(len(texts)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                fields = runs.flatten()
                word, n = (pc.struct_field(fields, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("word", "n"))
                earlier, earlier_word = (pc.struct_field(fields, k) for k in ("earlier_doc_id", "earlier_word"))
                whole = earlier.is_valid().to_numpy(zero_copy_only=False)

                def made(of, word, n_words, earlier, earlier_word, a, b):
                    at = first[of] + word
                    begin, end = starts[at] - char[of], stops[at + n_words - 1] - char[of]
                    ids, versions = (part.column(k).to_numpy(zero_copy_only=False)[of] for k in ("doc_id", "version"))
                    columns = [ids, versions, *(x.astype(np.int32) for x in (word, n_words, begin, end)), earlier, earlier_word, a, b]
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    names = ["doc_id", "version", "word", "n_words", "start", "stop", "earlier_doc_id", "earlier_word", "a", "b"]
                    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

                none = pa.nulls(int(whole.sum()), pa.int64())
                yield made(of[whole], word[whole], n[whole] + MIN_PASSAGE - 1, earlier.filter(pa.array(whole)), earlier_word.filter(pa.array(whole)), none, none)
                if not whole.all():
                    of, word, n = of[~whole], word[~whole], n[~whole]
                    h = memo.of(found)
                    each, word = np.repeat(of, n), ragged(word, n)
                    a, b_ = (rolled(h[i], MIN_PASSAGE, BASES[i])[first[each] + word].view(np.int64) for i in (0, 1))
                    yield made(each, word, np.full(len(word), MIN_PASSAGE), pa.nulls(len(word), pa.int64()), pa.nulls(len(word), pa.int32()), a, b_)

    return docs.mapInArrow(batches, PLACE_SCHEMA)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text) of the rows that have a doc_id; rows that repeat it with another text are told apart by the text's hash."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("version"), text_or_empty().alias("text"))


def _removed(docs: DataFrame) -> DataFrame:
    """``repeated_passages`` with the version of the document."""
    spark, rows = docs.sparkSession, _rows(docs)
    every = staged(blocks(rows), "paragraphs")
    often = every.groupBy("gram").agg(F.count("*").alias("times"), F.max("inside").alias("any")).filter("times > 1 or any").select("gram")
    some = staged(every.join(often, "gram"), "paragraphs-often")
    discard(spark, every)
    place = F.struct("doc_id", "version", "word")
    kinds = staged(some.groupBy("gram", "digest", "n").agg(F.min(place).alias("keep")), "paragraph-kinds")
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram", F.lit(True).alias("mixed"))
    # a later copy of a paragraph is repeated as a whole; the first copies that share a gram with other paragraphs are told apart by windows
    told = some.join(kinds.join(mixed, "gram", "left"), ["gram", "digest", "n"])
    told = told.withColumn("whole", F.expr(f"doc_id <> keep.doc_id or version <> keep.version or word >= keep.word + {MIN_PASSAGE}")).filter("whole or inside or mixed")
    run = F.struct("word", "n", F.expr("if(whole, keep.doc_id, null)").alias("earlier_doc_id"), F.expr("if(whole, keep.word, null)").alias("earlier_word"))
    runs = told.groupBy(F.col("doc_id").alias("of"), F.col("version").alias("of_version")).agg(F.collect_list(run).alias("runs"))
    texts = rows.join(runs, (F.col("doc_id") == F.col("of")) & (F.col("version") == F.col("of_version")))
    found = staged(placed(texts.select("doc_id", "version", "text", "runs")), "passage-places")
    discard(spark, some)
    discard(spark, kinds)
    single, key = found.filter("a is not null"), ["doc_id", "version"]
    first = single.groupBy("a", "b").agg(F.min(place).alias("keep"), F.count("*").alias("copies")).filter("copies > 1").select("a", "b", "keep")
    again = single.join(first, ["a", "b"]).filter(f"doc_id <> keep.doc_id or version <> keep.version or word >= keep.word + {MIN_PASSAGE}")
    places = [*key, "word", "n_words", "start", "stop"]
    again = again.select(*places, F.col("keep.doc_id").alias("earlier_doc_id"), F.col("keep.word").alias("earlier_word")).unionByName(found.filter("a is null").drop("a", "b"))
    by_place = Window.partitionBy(*key).orderBy("word", "n_words")
    ends = again.withColumn("end", F.col("word") + F.col("n_words"))
    apart = ends.withColumn("new", F.coalesce(F.col("word") > F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    joined = apart.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "run")
    out = joined.agg(
        F.min("word").alias("word"), F.max("end").alias("end"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.min(F.struct("word", "earlier_doc_id", "earlier_word")).alias("at"),
    )
    return out.select(
        *key, "word", (F.col("end") - F.col("word")).alias("n_words"), "start", (F.col("stop") - F.col("start")).alias("length"),
        F.col("at.earlier_doc_id").alias("earlier_doc_id"), F.col("at.earlier_word").alias("earlier_word"),
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per removed passage of ``docs(doc_id, text)``.

    doc_id, word (number of the first word, from 0) and n_words, start and length (characters of the original text), and earlier_doc_id, earlier_word: an
    earlier place of the passage's first MIN_PASSAGE words. Passages that touch are one. Inside one document an occurrence that overlaps the first one stays.
    Null or empty texts have no passages, nor has an empty table; rows with a null doc_id cannot be ranked and are left as they are; rows that repeat a doc_id and
    text count as one, and of several texts under one doc_id that with the least xxhash64 ranks first. Whole texts count whatever their length; other columns are ignored.
    """
    return _removed(docs).drop("version")


def cut(text: str, places: list) -> str:
    """``text`` without the given (start, length)."""
    out, at = [], 0
    for start, length in sorted((p["start"], p["length"]) for p in places):
        out.append(text[at:start])
        at = start + length
    return "".join([*out, text[at:]])


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; n_chars follows where it exists, every row and column stays."""

    @F.pandas_udf("string")
    def rest(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if g is None else cut(t or "", g) for t, g in zip(text, gone)], dtype=object)

    of, version, places = fresh(docs, "passage_doc_id"), fresh(docs, "passage_version"), fresh(docs, "gone_passages")
    gone = _removed(docs).groupBy(F.col("doc_id").alias(of), F.col("version").alias(version)).agg(F.collect_set(F.struct("start", "length")).alias(places))
    found = docs.join(gone, (F.col("doc_id") == F.col(of)) & (F.xxhash64(text_or_empty()) == F.col(version)), "left")
    touched = F.col(places).isNotNull()
    out = found.withColumn("text", F.when(touched, rest("text", places)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
