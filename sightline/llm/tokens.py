"""SentencePiece ids and token counts of whole documents, by the machines of ``pieces``."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import text_or_empty
from sightline.llm.pieces import CountTransducer, PieceFst
from sightline.llm.words import slices

TOKEN_LIMIT = 4096


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text; a null or empty text has none. Repeated rows are encoded each; an empty table gives no rows; other columns are ignored."""

    def batches(it):
        fst = PieceFst.at(model)
        for b in it:
            for part in slices(b, "text"):
                ids, sizes, _ = fst.encode_all(part.column(1))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return _documents(docs).mapInArrow(batches, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of ``rows(doc_id, ids)``; null ids give null."""

    def batches(it):
        fst = PieceFst.at(model)
        for b in it:
            texts = [None if ids is None else fst.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(batches, "doc_id long, text string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_crc32 (of little-endian uint32 ids), round_trip.

    round_trip tells whether decoding the ids gives the text again; the piece's own blank sign in a text comes back as a space. Null or
    empty texts have no tokens; whole texts are encoded whatever their length; a null doc_id stays null; repeated rows are encoded each. An empty table gives no
    rows; other columns are ignored.
    """

    def batches(it):
        fst = PieceFst.at(model)
        for b in it:
            for part in slices(b, "text"):
                ids, sizes, intact = fst.encode_all(part.column(1))
                raw, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(sizes)
                crc = [zlib.crc32(raw[a:z]) for a, z in zip((ends - 4 * sizes).tolist(), ends.tolist())]
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(intact)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return _documents(docs).mapInArrow(batches, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def token_counts(docs: DataFrame, model: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null counts as empty: no bytes, no tokens. Whole texts are counted; a null doc_id stays null; repeated rows are counted each. An empty
    table gives no rows; other columns are ignored.
    """

    def batches(it):
        counter = CountTransducer.at(model)
        for b in it:
            for part in slices(b, "text"):
                n = counter.count_all(part.column(1))
                size = pc.binary_length(part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return _documents(docs).mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
