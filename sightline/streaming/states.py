"""Stateful stream operators: greedy spacing, bounded buffers and best-of-window, on event time.

State is one small value per key: the last accepted time, or the newest N rows. Timestamps must be TIMESTAMP (not TIMESTAMP_NTZ) for watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def spaced_stream(rows: DataFrame, key: str, seconds: str, order: str, gap: float) -> DataFrame:
    """(key, order, seconds) of rows at least ``gap`` after the last accepted one of their key; rows older than that are dropped."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t, o in sorted((t, o) for pdf in frames for t, o in zip(pdf["t"], pdf["o"])):
            if last is None or t - last >= gap:
                last = t
                kept.append((keys[0], o, t))
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(kept, columns=["k", "o", "t"])

    kinds = dict(rows.dtypes)
    plain = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(seconds).cast("double").alias("t"))
    out = plain.groupBy("k").applyInPandasWithState(step, f"k {kinds[key]}, o {kinds[order]}, t double", "last double", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.col("t").alias(seconds))


def latest_stream(rows: DataFrame, key: str, seconds: str, order: str, n: int = 30) -> DataFrame:
    """Per key and micro-batch the orders of the newest ``n`` rows so far, oldest first: what a buffer that drops the oldest holds."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for pdf in frames:
            held = sorted([*held, *zip(pdf["t"].tolist(), pdf["o"].tolist())])[-n:]
        times, orders = (list(x) for x in zip(*held)) if held else ([], [])
        state.update((times, orders))
        yield pd.DataFrame({"k": [keys[0]], "o": [orders]})

    kinds = dict(rows.dtypes)
    plain = rows.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(seconds).cast("double").alias("t"))
    out = plain.groupBy("k").applyInPandasWithState(step, f"k {kinds[key]}, o array<bigint>", "ts array<double>, os array<bigint>", "update", GroupStateTimeout.NoTimeout)
    return out.select(F.col("k").alias(key), F.col("o").alias("held"))


def best_per_window(rows: DataFrame, time: str, score: str, order: str, length: str = "15 seconds", late: str = "15 seconds") -> DataFrame:
    """(window_start, best, score): the row of greatest score in each closed window, the smallest order among equals."""
    w = F.window(time, length)
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")))
    return rows.withWatermark(time, late).groupBy(w).agg(best.alias("b")).select(F.col("window.start").alias("window_start"), (-F.col("b.o")).alias("best"), F.col("b.s").alias("score"))
