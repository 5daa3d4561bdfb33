"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, strips accents and combining marks, drops characters without width, maps homoglyphs of other scripts and digit substitutions to Latin letters and turns
punctuation of any script into spaces. Lexicon patterns are starts of words or whole words with weights (log-odds of their document frequencies);
exception phrases, of one word or two, cancel the matches that they cover. The weighted matches of a document, as a sum, a share of its words and a
maximum, make its score through a logistic curve.

The lexicon, the exceptions and the curve are fitted on a sample of labelled rows whose size is bounded by a parameter; scoring
reads whole texts. The fitted model has at most a few hundred patterns and is broadcast.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import staged, text_or_empty

#: Expected number of labelled rows of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 1500
MAX_PATTERNS = 400
#: Least log-likelihood ratio of a pattern: chance alone reaches it about once in 5,000 patterns.
LEAST_RATIO = 14.0
#: Lengths of the word starts that are considered.
STARTS = range(4, 9)

# fixed values: look-alikes of Latin letters in other scripts, and digits and signs that stand for letters
LOOK_ALIKES = dict(zip("авекмнорстухіјѕԁɡαβεικνορτυχӏ", "abekmhopctyxijsdgabeiknoptuxl"))
SUBSTITUTES = dict(zip("013457@$", "oieastas"))


def _folding() -> dict[int, str]:
    out = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if base != chr(c):
            out[c] = base
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind == "Cf" or 0x300 <= c < 0x370:  # without width, and combining marks of Latin letters
            out[c] = ""
        elif c not in out and kind[0] in "CPSZ" and kind not in ("Cs", "Co", "Cn"):
            out[c] = " "
    return out | {ord(k): v for k, v in (LOOK_ALIKES | SUBSTITUTES).items()}


FOLDING = _folding()


def fold(text: str) -> str:
    """The folded text with a space before and after."""
    return f" {text.lower().translate(FOLDING)} "


@dataclass
class Model:
    """Patterns begin with a space (a word start) and may end with one (a whole word)."""

    patterns: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    _automaton: object = None

    def automaton(self):
        if self._automaton is None and (self.patterns or self.exceptions):
            found = ahocorasick.Automaton()
            for p, w in self.patterns.items():
                found.add_word(p, (len(p), w))
            for p in self.exceptions:
                found.add_word(p, (len(p), None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def evidence(self, text: str) -> tuple[float, float, float]:
        """Weighted matches: log of their sum, log of their sum in a hundred words, their maximum. Of the matches at a place the longest counts."""
        folded = fold(text)
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton().iter(folded) if self.automaton() else ():
            if weight is None:
                spared.append((end - length + 1, end))
            else:
                at[end - length + 1] = weight
        for a, b in spared:
            for place in [p for p in at if a <= p < b]:
                del at[place]
        if not at:
            return 0.0, 0.0, 0.0
        total = math.fsum(at.values())
        return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split()))), max(at.values())

    def score(self, text: str) -> float:
        z = self.curve[-1] + sum(w * x for w, x in zip(self.curve, self.evidence(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def pairs(words: list[str]) -> set[str]:
    """Neighbouring words of a text, each pair as one string."""
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def lexicon(words: list[set[str]], labels: list[int], couples: list[set[str]] | None = None) -> tuple[dict[str, float], list[str]]:
    """Patterns with weights, and exception phrases, from the distinct folded words of each document and its neighbouring words."""
    toxic, clean = Counter(), Counter()
    for ws, label in zip(words, labels):
        (toxic if label else clean).update({f" {w[:k]}" for w in ws for k in STARTS if len(w) >= k} | {f" {w} " for w in ws})
    n1, n0 = sum(labels), len(labels) - sum(labels)
    least = max(3, n1 // 300)

    def odds(p: str) -> tuple[float, float]:
        """Log-odds of a pattern's document frequencies, and the log-likelihood ratio that they differ."""
        a, b = toxic[p], clean[p]
        weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        expected = (a + b) / (n1 + n0)
        return weight, 2 * sum(x * math.log(x / (n * expected)) for x, n in ((a, n1), (b, n0)) if x)

    found = {p: o for p in toxic if toxic[p] >= least and (o := odds(p))[0] >= 1 and o[1] >= LEAST_RATIO}
    best = sorted(found, key=lambda p: (-found[p][1], p))[:MAX_PATTERNS]
    patterns = {p: round(found[p][0], 6) for p in best}
    shown = lambda w: any(f" {w} "[:k] in patterns for k in range(2, len(w) + 3))
    for ws, label in zip(couples or [], labels):
        (toxic if label else clean).update(f" {c} " for c in ws if any(map(shown, c.split(" "))))
    exceptions = [p for p in clean if p[-1] == " " and clean[p] >= max(4, n0 // 300) and any(map(shown, p.split())) and odds(p)[0] <= -0.5]
    return patterns, sorted(exceptions)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a light ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.1 * w)
    return tuple(float(v) for v in w)


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by the CRC-32 of its id: never learned from. Null ids are not held out, and have no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the labelled documents outside the held-out fifth.

    Of each class about ``sample_per_class`` rows, or all if fewer, are taken by a hash of their id, so the driver sees a bounded sample
    whatever the corpus. A document with several labels is toxic if one of them says so. Without both classes the score is the
    constant share of the one there is (0 if none).
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(curve=(0.0, 0.0, 0.0, 20.0 if 1 in sizes else -20.0))
    share = {k: min(1.0, sample_per_class / n) for k, n in sizes.items()}
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(place < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    sample = staged(docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).join(F.broadcast(picked), "id"), "toxicity-sample")

    def distinct_words(it):
        for b in it:
            words = [fold(t).split() for t in b.column(1).to_pylist()]
            columns = [pa.array([sorted(x) for x in found], pa.list_(pa.string())) for found in (map(set, words), map(pairs, words))]
            yield pa.RecordBatch.from_arrays([b.column(2), *columns], names=["label", "words", "pairs"])

    rows = sample.mapInArrow(distinct_words, "label int, words array<string>, pairs array<string>").toArrow().to_pydict()
    model = Model(*lexicon([set(w) for w in rows["words"]], rows["label"], [set(c) for c in rows["pairs"]]))

    def features(it):
        for b in it:
            found = np.array([model.evidence(t) for t in b.column(1).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(2), *(pa.array(found[:, k]) for k in range(3))], names=["label", "a", "b", "c"])

    seen = sample.mapInArrow(features, "label int, a double, b double, c double").toArrow().to_pandas()
    y = seen["label"].to_numpy(float)
    model.curve = _curve(seen[["a", "b", "c"]].to_numpy(float), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts are empty and score as a text without matches. Whole texts count; other columns are ignored.
    """

    def batches(it):
        for b in it:
            score = np.array([model.score(t) for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay."""

    @F.pandas_udf("double")
    def score(text):
        return text.map(model.score)

    return docs.filter(score(text_or_empty()) < limit)
