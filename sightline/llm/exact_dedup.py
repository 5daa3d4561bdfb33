"""Exact dedup against a history held in a minimal perfect hash.

The distinct SHA-256 digests of the history are dealt into shards by their leading bytes. Each shard
builds its own minimal perfect hash: keys that are alone in a bit array of a level take that bit, the others go
to the next level, and the rank of a key's bit is its slot. Slots hold the full digest and the locator
of the winner (its doc_id, with the group's size). A lookup may land on any slot, so it compares all 32 bytes.
Digests of a new batch that are not members form groups of their own.

Both sides are reduced to distinct digests (with map-side combine) before they meet, so a text with a third of all
rows is one row by then; shards are uniform because digests are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import fresh, staged, text_or_empty

#: Aimed-at number of distinct digests in a shard of the index, and bits per key in a level.
DIGESTS_PER_SHARD = 50_000
BITS_PER_KEY = 2
INDEX_SCHEMA = "shard int, sizes array<long>, bits binary, digests binary, winners binary, counts binary"


def _level_slot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys (uint64 words of their digests) fall in a level's array."""
    x = words[:, 1] + np.uint64(level + 1) * words[:, 2]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests, given as an (n, 4) array of uint64."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        sizes, arrays, left = [], [], words
        while len(left):
            size = max(8, BITS_PER_KEY * len(left))
            at = _level_slot(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(arrays) if arrays else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key outside the set some slot or -1."""
        out, open_, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = start + _level_slot(words[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, start = open_[~hit], start + size
        return out


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    mph = PerfectHash.build(words)
    slot = mph.slots(words)
    order = np.empty(len(slot), np.int64)
    order[slot] = np.arange(len(slot))
    ids = pdf["winner"].to_numpy(dtype=np.int64)[order]
    return pd.DataFrame({
        "shard": [key[0]], "sizes": [mph.sizes], "bits": [np.packbits(mph.bits).tobytes()], "digests": [words[order].tobytes()],
        "winners": [ids.tobytes()], "counts": [pdf["n"].to_numpy(dtype=np.int64)[order].tobytes()],
    })


def _look_up(key: tuple, index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """History and batch of a shard as one set of groups."""
    new, winner, n = _words(batch["digest"]), batch["winner"].to_numpy(dtype=np.int64), batch["n"].to_numpy(dtype=np.int64)
    if not len(index):
        return pd.DataFrame({"digest": batch["digest"], "keep_id": winner, "group_size": n})
    row = index.iloc[0]
    sizes = [int(s) for s in row["sizes"]]
    mph = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool))
    held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
    winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
    slot = mph.slots(new)
    member = (slot >= 0) & (held[np.maximum(slot, 0)] == new).all(axis=1)
    at = slot[member]
    winners[at] = np.maximum(winners[at], winner[member])
    counts[at] += n[member]
    raw = held.tobytes()
    return pd.DataFrame({
        "digest": [raw[i : i + 32] for i in range(0, len(raw), 32)] + batch["digest"][~member].tolist(),
        "keep_id": np.concatenate([winners, winner[~member]]), "group_size": np.concatenate([counts, n[~member]]),
    })


#: Stands for a null doc_id inside the index: less than any other.
NO_ID = -(2**63)


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, digest, winner, n): distinct digests, combined before the shuffle."""
    found = rows.groupBy("digest").agg(F.max(F.coalesce("id", F.lit(NO_ID))).alias("winner"), F.count("*").alias("n"))
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return found.select((lead % shards).cast("int").alias("shard"), "digest", "winner", "n")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of ``history(id, digest)``: one row a shard, see INDEX_SCHEMA. It can be written and reused."""
    return _groups(history, shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def look_up(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``batch(id, digest)`` against an index: (digest, keep_id, group_size) of history and batch together."""
    found = index.groupBy("shard").cogroup(_groups(batch, shards).groupBy("shard"))
    out = found.applyInPandas(_look_up, "digest binary, keep_id long, group_size long")
    return out.withColumn("keep_id", F.expr(f"nullif(keep_id, {NO_ID}L)"))


def exact_dedup(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null is the empty text. The row with the largest doc_id of a group stays; a null
    doc_id ranks below all others. Rows that repeat a doc_id and its text all carry the same verdict (``deduplicated`` returns
    one of them). ``historical`` marks the rows that the index is built from (default: half of all, by a hash of
    doc_id); the result does not depend on it. An empty table gives no rows; other columns are ignored.
    """
    historical = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if historical is None else historical
    rows = staged(
        docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"), F.coalesce(historical, F.lit(False)).alias("old")),
        "digests",
    )
    shards = max(64, -(-rows.count() // DIGESTS_PER_SHARD))
    index = staged(build_index(rows.filter("old"), shards), "digest-index")
    groups = look_up(rows.filter("not old"), index, shards)
    return rows.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept. Text moves once, dealt by doc_id and digest."""
    of, own, keep, sha = (fresh(docs, n) for n in ("own_id", "own_sha256", "kept_id", "kept_sha256"))
    kept = exact_dedup(docs).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(keep), F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(of, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own, F.sha2(text_or_empty(), 256))
    found = keyed.join(kept, (F.col(of) == F.col(keep)) & (F.col(own) == F.col(sha)), "left_semi")
    return found.dropDuplicates([of, own]).drop(of, own)
