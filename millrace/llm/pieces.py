"""SentencePiece encoding and decoding with a table of distinct chunks.

In models whose pieces hold the white-space marker only at their start (or are
nothing but markers), no merge crosses the boundary in front of a marker that
follows another character. A text therefore falls into chunks, each a run of
markers and the characters up to the next marker, whose ids do not depend on
their neighbours. Every task keeps a table of the distinct chunks it has met,
segments each of them once with the library, and joins the ids back by
position. ``check_model`` verifies the property on the vocabulary and refuses
models (or normalisers) for which it does not hold.

The table is bounded in entries and characters and started anew beyond that,
which costs time only. Chunks are not shuffled: one row per word occurrence
would move several times the input.

Nulls encode as the empty text, which has no ids. Null ids decode to the empty
text. Texts of any length are segmented whole. Repeated rows have equal ids each; there are no ties, as every row is encoded by itself.
An empty table gives no rows. Columns named as an output column are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_ENTRIES = 300_000
TABLE_CHARS = 32_000_000


def check_model(model: bytes) -> None:
    """Raise ValueError unless chunks of this model can be segmented alone."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
        raise ValueError("the model's normaliser changes texts beyond marking white space")
    if m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model marks white space at the end of words")
    if not any(p.piece == MARK and p.type == p.NORMAL for p in m.pieces):
        raise ValueError("the marker alone is no piece")
    for p in m.pieces:
        if MARK in p.piece.lstrip(MARK):
            raise ValueError(f"piece {p.piece!r} crosses a white-space marker")
        if p.type == p.USER_DEFINED:
            raise ValueError(f"piece {p.piece!r} is user-defined and may join chunks")


def chunks(text: str) -> list[str]:
    """The chunks of a text, as the texts that the library would mark and segment alone."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for w in words:
        if w:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if spaces:  # markers at the end, the first of which the library adds itself
        out.append(" " * (spaces - 1))
    return out


class ChunkTable(dict):
    """Distinct chunk -> number of its row; ``ids`` and ``starts`` hold the rows."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lone = [self.processor.piece_to_id(MARK)]  # of a text that is one marker
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.chars = 0
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = row = len(self)
        self.fresh.append(chunk)
        self.chars += len(chunk)
        return row

    def segment(self) -> None:
        """Segment the chunks met since the last call, each once."""
        if self.fresh:
            found = [ids if c else self.lone for c, ids in zip(self.fresh, self.processor.encode(self.fresh, num_threads=1), strict=True)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.fresh = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start."""
        rows: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                rows.extend(map(self.__getitem__, chunks(text)))
            ends[k + 1] = len(rows)
        self.segment()
        at = np.asarray(rows, np.int64)
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(first - stops[:-1], sizes) + np.arange(stops[-1])] if len(at) else self.ids[:0]
        if len(self) > TABLE_ENTRIES or self.chars > TABLE_CHARS:
            self.reset()
        return flat, stops[ends]


def encoder(model: bytes):
    """Arrow UDF from texts to arrays of ids."""
    check_model(model)

    @F.arrow_udf("array<int>")
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(model)
        for batch in batches:
            flat, starts = table.encode(batch.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))

    return encode_texts


def decoder(model: bytes):
    """Arrow UDF from arrays of ids to texts."""

    @F.arrow_udf("string")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            rows = [[] if x is None else x for x in batch.to_pylist()]
            yield pa.array(processor.decode(rows) if rows else [], pa.string())

    return decode_ids


def encode(df: DataFrame, model: bytes, text: str | Column = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>) with the library's ids of ``text``."""
    return df.withColumn(ids, encoder(model)(text))


def decode(df: DataFrame, model: bytes, ids: str | Column = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text`` with the library's decoding of ``ids``."""
    return df.withColumn(text, decoder(model)(ids))


def load_model(path: str) -> bytes:
    """The model's bytes, read on the driver and sent to the executors with the tasks."""
    with open(path, "rb") as f:
        return f.read()
