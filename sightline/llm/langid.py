"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of two to four characters are hashed into a fixed number of
buckets, all as numpy arrays over code points. The matrix of log-probabilities (buckets x languages) is broadcast; the
n-grams of a batch of texts are the places of a sparse matrix (texts x buckets), whose product with it scores the whole batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import text_or_empty
from sightline.llm.words import slices

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Expected number of documents of each language that the model is fitted on, at most.
SAMPLE_PER_LANGUAGE = 1500
#: Characters that are held as arrays at once.
SLICE = 1 << 18
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]):
    """Slice by slice (rows, buckets): the n-grams of a batch of texts as the places of a sparse matrix, in order of row within each order of n-gram.

    Each n-gram is in one slice, a place as often as the text has its n-gram. n-grams of spaces alone are left out.
    """
    lowered = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    edge = np.array([32], np.uint32)
    points = np.concatenate([x for t in lowered for x in (edge, t, edge)] or [edge[:0]])
    points = np.where(_is_letter()[points], points, 32).astype(np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    reach = max(ORDERS) - 1
    for i in range(0, len(points), SLICE):
        part, row = points[i : i + SLICE + reach], rows[i : i + SLICE + reach]
        key, mine = part * np.uint32(0x9E3779B1), min(SLICE, len(points) - i)
        for n in range(2, reach + 2):
            key = (key[:-1] ^ (key[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + part[n - 1 :] * np.uint32(0xC2B2AE35)
            if n in ORDERS and len(key):
                some = part[: len(key)] != 32
                for k in range(1, n):
                    some |= part[k : k + len(key)] != 32
                some &= row[: len(key)] == row[n - 1 :]  # none reaches into the next text
                some[mine:] = False
                yield row[: len(key)][some], ((key[some] ^ (key[some] >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(16))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Languages, in order, and their log-probabilities: (buckets, languages) and priors."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        total = counts.sum(axis=0)
        self.matrix = (np.log(counts + smoothing) - np.log(total + smoothing * BUCKETS)).astype(np.float32)
        self.prior = np.log(documents / max(1, documents.sum()))

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) log-scores: the batch's sparse matrix of n-grams times the log-probabilities, plus the priors."""
        z = np.tile(self.prior, (len(texts), 1))
        for rows, buckets in grams(texts):
            if len(rows):
                starts = np.nonzero(np.diff(rows, prepend=-1))[0]
                z[rows[starts]] += np.add.reduceat(self.matrix[buckets], starts, axis=0, dtype=np.float64)
        return z

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; (und, 0) for texts without letters or a model without languages."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        z, known = self.scores(texts), [has_letter(t) for t in texts]
        best = z.argmax(1)
        sure = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known)], np.where(known, sure, 0.0).tolist()


def held_out(doc_id: str = "doc_id") -> Column:
    """Every third document by the CRC-32 of its id: never learned from. Null ids are not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from ``docs(doc_id, text, lang)`` outside the held-out third; about ``sample_per_language`` rows, or all if fewer, of each.

    Counting runs on the executors; the driver gets at most buckets x languages sums.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_per_language / sizes[k]))])
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    number = {k: i for i, k in enumerate(languages)}

    def counted(it):
        sums = np.zeros((BUCKETS, len(languages)), np.int64)
        for b in it:
            for part in slices(b, "text"):
                of = np.array([number[x] for x in part.column(0).to_pylist()], np.int64)
                for rows, buckets in grams(part.column(1).to_pylist()):
                    np.add.at(sums, (buckets, of[rows]), 1)
        bucket, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(sums[bucket, lang])], names=["bucket", "lang", "n"])

    sample = known.filter(place < shares[F.col("lang")]).select("lang", "text").repartition(8)
    rows = sample.mapInArrow(counted, "bucket int, lang int, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows["bucket"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, counts, np.array([sizes[k] for k in languages], float))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, repeated rows too: doc_id, held_out, lang_pred, score (0 to 1). An empty table gives no rows.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null or has no letter. Whole texts count; ties go to the
    language first in order; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        for b in it:
            for part in slices(b, "text"):
                names, scores = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")
