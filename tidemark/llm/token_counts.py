"""Token counts by heap-and-linked-list byte-pair merging, without emitting ids.

Method: the symbols of a pre-token form a linked list, a heap pops the adjacent pair of
lowest rank; the count is the number of initial symbols minus the number of merges.

One pass over the texts, no shuffle; memory per task is one Arrow batch, the vocabulary
and a bounded dictionary. Texts are counted whole, however long.

Defined results: a null or empty text has 0 bytes and 0 tokens; null and repeated ids
give a row each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Known, merge_all, vocabulary
from tidemark.llm.common import whole_text

TOKEN_LIMIT = 2048


@lru_cache(maxsize=2)
def stretch_counts(vocab_path: str) -> Known:
    """Token counts of blank-free stretches."""
    vocab = vocabulary(vocab_path)

    def count_piece(piece: str) -> int:
        symbols = vocab.symbols(piece)
        return len(symbols) - merge_all(symbols, vocab.merges)

    pieces = Known(count_piece)

    def count(stretch: str) -> int:
        return sum(1 if isinstance(p, int) else pieces[p] for p in vocab.pre_tokens(stretch))

    return Known(count)


def token_counts(
    docs: DataFrame,
    vocab_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = stretch_counts(vocab_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "n_tokens": pa.array(
                        [sum(map(tokens.__getitem__, t.split())) for t in texts], pa.int64()
                    ),
                }
            )

    rows = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
