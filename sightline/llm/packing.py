"""Packing documents into token sequences by linear grouping and best fit.

Only the histogram of piece lengths (one row for each length up to the capacity, whatever the corpus) is planned on the
driver. Large lengths are dealt into groups of equal cardinality and rounded up to their group's largest; the
configurations of these few sizes are optimised as a linear programme by column generation and rounded down;
actual lengths are substituted where that leaves next to no gap, and what is left, small lengths above all, goes best-fit. All of that works on runs
of equal sequences, so the plan's size depends on the number of lengths, not of documents. A piece finds its place from
its rank among the pieces of its length, which is a window within hashed buckets plus each bucket's offset.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import staged, text_or_empty
from sightline.llm.wordbpe import WordBpe
from sightline.llm.words import slices

CAPACITY = 2048
END_ID = 0
#: Lengths above this share of the capacity are large; the number of groups that they are rounded into.
LARGE = 1 / 8
GROUPS = 32
#: A substituted sequence stays if rounding has left at most this share of it empty; else its documents go best-fit.
SLACK = 1 / 256
#: Aimed-at number of pieces in a bucket of the ranking.
PIECES_PER_BUCKET = 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: a document's ids, then ``end_id``, cut every ``capacity`` ids."""

    def batches(it):
        bpe = WordBpe.at(vocabulary)
        for b in it:
            for part in slices(b, "text"):
                ids, sizes = bpe.encode_all(part.column(1))
                raw = memoryview(np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes())
                sizes = sizes + 1
                count = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                at = (4 * ((np.cumsum(sizes) - sizes)[of] + start)).tolist()
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at, length.tolist())]
                columns = [part.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(batches, PIECE_SCHEMA)


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes of greatest worth that fits: an unbounded knapsack."""
    use = np.nonzero(worth > 1e-12)[0]
    pattern = np.zeros(len(sizes), np.int64)
    if not len(use):
        return pattern, 0.0
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    s, v = sizes[use], worth[use]
    for c in range(int(s.min()), capacity + 1):
        best[c] = best[c - 1]
        fits = s <= c
        got = best[c - s[fits]] + v[fits]
        i = int(got.argmax())
        if got[i] > best[c] + 1e-12:
            best[c], took[c] = got[i], np.nonzero(fits)[0][i]
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[use[took[c]]] += 1
            c -= int(s[took[c]])
    return pattern, float(best[capacity])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over few sizes and how often to use each: the configuration LP by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        pattern, worth = _best_pattern(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-7:
            break
        level, step = inverse @ demand, inverse @ pattern
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    times = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].astype(np.int64), int(times[j] + 1e-6)) for j in range(k) if times[j] >= 1 - 1e-6]


class Plan:
    """Runs of equal sequences: [how many, ((length, times), ...) in order, room left]."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.rooms, self.by_room = capacity, [], [], {}

    def add(self, count: int, items: tuple, room: int) -> None:
        if count <= 0:
            return
        self.runs.append([count, items, room])
        if room:
            if room not in self.by_room:
                bisect.insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append(len(self.runs) - 1)

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` pieces of one length, each where it leaves least room; new sequences where none fits."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                self.add(count // each, ((length, each),), self.capacity - each * length)
                if rest := count % each:
                    self.add(1, ((length, rest),), self.capacity - rest * length)
                return
            room = self.rooms[at]
            run = self.runs[self.by_room[room].pop()]
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[at]
            have, items, _ = run
            run[0] = 0  # its sequences come back as other runs
            each = room // length
            full = min(have, count // each)
            self.add(full, (*items, (length, each)), room - each * length)
            have, count = have - full, count - full * each
            if have and count:  # fewer than `each` are left
                self.add(1, (*items, (length, count)), room - count * length)
                have, count = have - 1, 0
            self.add(have, items, room)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple]]:
    """``{length: pieces}`` to runs (sequences, ((length, times), ...)); every piece is in exactly one place."""
    out, left = Plan(capacity), dict(histogram)
    large = sorted((n for n in histogram if n > LARGE * capacity), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        each = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of each group: [length, pieces], largest first
        room = each
        for n in large:
            count = histogram[n]
            while count:
                if not room:
                    members.append([])
                    room = each
                take = min(room, count)
                members[-1].append([n, take])
                count, room = count - take, room - take
        merged: dict[int, list[list[int]]] = {}
        for g in members:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged))
        demand = np.array([sum(c for _, c in merged[s]) for s in merged])
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [s for s, a in zip(merged, pattern) for _ in range(a)]
            while times:  # actual lengths for rounded ones, as far as each lasts
                heads = {s: slots.count(s) for s in slots}
                times_now = min([times, *(sum(c for _, c in merged[s]) // k for s, k in heads.items())])
                if not times_now:
                    break
                picked = []
                for s, k in heads.items():
                    queue = merged[s]
                    while not queue[0][1]:
                        queue.pop(0)
                    if queue[0][1] >= k:
                        picked.append([(queue[0], k)])
                        times_now = min(times_now, queue[0][1] // k)
                    else:  # one sequence across two lengths or more
                        need, parts = k, []
                        for q in queue:
                            took = min(need, q[1])
                            if took:
                                parts.append((q, took))
                            need -= took
                            if not need:
                                break
                        picked.append(parts)
                        times_now = 1
                items = [(q[0], k) for parts in picked for q, k in parts]
                for parts in picked:
                    for q, k in parts:
                        q[1] -= k * times_now
                room = capacity - sum(n * k for n, k in items)
                if room <= SLACK * capacity:
                    out.add(times_now, tuple(items), room)
                    for n, k in items:
                        left[n] -= k * times_now
                times -= times_now
    for n in sorted(left, reverse=True):
        if left[n]:
            out.best_fit(n, left[n])
    return [(count, items) for count, items, _ in out.runs if count]


def _intervals(runs: list[tuple[int, tuple]]) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset), by length and rank."""
    rows, sequence, ranks = [], 0, {}
    for count, items in runs:
        offset = 0
        for length, times in items:
            rank = ranks.get(length, 0)
            rows.append((length, rank, times, sequence, offset))
            ranks[length] = rank + count * times
            offset += length * times
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of ``end_id`` alone. Repeated rows are packed each; a null doc_id stays null. An empty table gives no
    rows. Whole texts are used whatever their length; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = staged(pieces(docs, vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")  # fixed once written
    lengths = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_intervals(plan(lengths, capacity)))
    buckets = max(64, sum(lengths.values()) // PIECES_PER_BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(counts, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("rank"))

    def placed(it):
        table = places.value
        key = table[:, 0] << 44 | table[:, 1]
        for b in it:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            i = rank - at[:, 1]
            columns = [b.column(k) for k in range(5)] + [pa.array(at[:, 3] + i // at[:, 2]), pa.array(at[:, 4] + i % at[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, PIECE_SCHEMA + ", sequence_id long, offset long")
