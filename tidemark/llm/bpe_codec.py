"""Byte-pair encoding and decoding, long unsplit text by tree concatenation.

Method: a pre-token of more than ``leaf`` symbols is cut into leaves. The leaves are
dealt over the cluster and encoded in parallel; per text they are then joined pairwise
up a tree. At each join the tokens around the seam are taken back to their symbols and
encoded anew, in a window that grows on both sides until its first and its last token
are the ones that stood there before. All neighbouring tokens outside the window then
are as in a whole encoding, and so is the rest.

Texts whose blank-free stretches are all short need no tree and are encoded where they
are read, without a shuffle. Only leaves of long stretches are shuffled, and what meets
in one task is one text's tokens, which end up in one row anyway.

Defined results: a null or empty text has no ids and decodes to the empty text; null and
repeated ids give a row each; an empty table gives an empty table; further columns are
ignored. Ids are little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import Known, Vocabulary, merge_all, vocabulary
from tidemark.llm.common import whole_text

LEAF = 1024
# Texts worked on together in a batch.
_ROWS = 512


def merged(vocab: Vocabulary, symbols: list[int]) -> list[int]:
    work = list(symbols)
    merge_all(work, vocab.merges)
    return [s for s in work if s >= 0]


def to_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def to_ids(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


class Symbols:
    """The initial symbols of tokens, taken apart again by the merge that made them."""

    def __init__(self, vocab: Vocabulary):
        self.parts = {made: pair for pair, (_, made) in reversed(vocab.merges.items())}
        self.known: dict[int, list[int]] = {}

    def of(self, token: int) -> list[int]:
        if token not in self.known:
            pair = self.parts.get(token)
            self.known[token] = [token] if pair is None else self.of(pair[0]) + self.of(pair[1])
        return self.known[token]


def join_halves(vocab: Vocabulary, symbols: Symbols, left: list[int], right: list[int]) -> list[int]:
    """Encoding of the concatenation, from the encodings of both halves."""
    if not left or not right:
        return left + right
    width = 2
    while True:
        a, b = left[-width:], right[:width]
        window = merged(vocab, [s for t in a + b for s in symbols.of(t)])
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        width *= 2


def join_tree(vocab: Vocabulary, symbols: Symbols, leaves: list[list[int]]) -> list[int]:
    """Join encoded leaves pairwise until one is left."""
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [join_halves(vocab, symbols, *p) if len(p) == 2 else p[0] for p in pairs]
    return leaves[0] if leaves else []


@lru_cache(maxsize=2)
def stretch_ids(vocab_path: str) -> Known:
    """Ids of blank-free stretches whose pre-tokens need no tree."""
    vocab = vocabulary(vocab_path)
    pieces = Known(lambda piece: to_bytes(merged(vocab, vocab.symbols(piece))))

    def encode_stretch(stretch: str) -> bytes:
        return b"".join([to_bytes([p]) if isinstance(p, int) else pieces[p] for p in vocab.pre_tokens(stretch)])

    return Known(encode_stretch)


def _has_long_stretch(text: Column, leaf: int) -> Column:
    return text.rlike(rf"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D]{{{leaf}}}")


def _encode_short(rows: DataFrame, vocab_path: str, kind: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = stretch_ids(vocab_path)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.record_batch(
                    {
                        "id": part.column(0),
                        "ids": pa.array(
                            [b"".join(map(ids.__getitem__, t.split())) for t in texts], pa.binary()
                        ),
                    }
                )

    return rows.mapInArrow(encode, f"id {kind}, ids binary")


def _encode_long(rows: DataFrame, vocab_path: str, kind: str, leaf: int) -> DataFrame:
    """Texts with long stretches: cut, encode the leaves in parallel, join per text.

    Rows between the steps: the text (uid), a running number (at), the pre-token a leaf
    belongs to (piece, -1 for finished ids) and symbols or ids (data).
    """
    part = f"uid long, id {kind}, at long, piece long, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for row_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()):
                pieces: list[int] = []
                data: list[bytes] = []
                done: list[int] = []
                for n, piece in enumerate(vocab.pre_tokens(text.decode("utf-8", "replace"))):
                    if isinstance(piece, int):
                        done.append(piece)
                    elif len(piece) <= leaf:
                        done += merged(vocab, vocab.symbols(piece))
                    else:
                        if done:
                            pieces.append(-1)
                            data.append(to_bytes(done))
                            done = []
                        symbols = vocab.symbols(piece)
                        for i in range(0, len(symbols), leaf):
                            pieces.append(n)
                            data.append(to_bytes(symbols[i : i + leaf]))
                if done or not data:
                    pieces.append(-1)
                    data.append(to_bytes(done))
                yield pa.record_batch(
                    {
                        "uid": pa.array([uid] * len(data), pa.int64()),
                        "id": pa.array([row_id.as_py()] * len(data), batch.column(0).type),
                        "at": pa.array(range(len(data)), pa.int64()),
                        "piece": pa.array(pieces, pa.int64()),
                        "data": pa.array(data, pa.binary()),
                    }
                )
                uid += 1

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            data = [
                value if piece < 0 else to_bytes(merged(vocab, to_ids(value)))
                for piece, value in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            yield batch.set_column(4, "data", pa.array(data, pa.binary()))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab = vocabulary(vocab_path)
        symbols = Symbols(vocab)
        ids: list[int] = []
        leaves: list[list[int]] = []
        last = -1
        for piece, data in pdf.sort_values("at")[["piece", "data"]].itertuples(index=False):
            if leaves and piece != last:
                ids += join_tree(vocab, symbols, leaves)
                leaves = []
            if piece < 0:
                ids += to_ids(data)
            else:
                leaves.append(to_ids(data))
            last = piece
        ids += join_tree(vocab, symbols, leaves)
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "ids": [to_bytes(ids)]})

    spread = rows.mapInArrow(cut, part).repartition("uid", "at")
    return (
        spread.mapInArrow(encode_leaves, part)
        .groupBy("uid")
        .applyInPandas(join, f"id {kind}, ids binary")
    )


def encode(
    docs: DataFrame,
    vocab_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf: int = LEAF,
) -> DataFrame:
    """One row per input row: the id and ``ids``, the encoding of the whole text."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    long = _has_long_stretch(F.col("text"), leaf)
    return (
        _encode_short(rows.where(~long), vocab_path, kind)
        .union(_encode_long(rows.where(long), vocab_path, kind, leaf))
        .withColumnRenamed("id", id_col)
    )


def decode(encoded: DataFrame, vocab_path: str, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids``: the token texts, one space between them.

    Encoding and decoding in one stage give each core two Python workers with a dictionary
    each; store the encoding between them (:func:`tidemark.llm.common.written`) to have one.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    at = encoded.columns.index("ids")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(vocab_path).token_texts()
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                found = [
                    None if data is None else " ".join(map(tokens.__getitem__, to_ids(data)))
                    for data in part.column(at).to_pylist()
                ]
                yield pa.record_batch([*part.columns, pa.array(found, pa.string())], names=schema.names)

    return encoded.mapInArrow(texts, schema)
