"""Byte-balanced shards by histogram sort.

Method: rows are ordered by (hash of the text, id). Exact bytes and rows below candidate
key boundaries are counted across all partitions; each round probes the open boundaries
more finely, between the keys that really occur, until every splitter is within
tolerance of its target or no key lies between. Then rows are exchanged once.

Equal texts lie together and stay in one shard unless a boundary falls inside their
group; a group that holds a third of all bytes is cut at ids. A shard larger than
``range_bytes`` is made of several ranges, each sorted by one task, and the rows' slots
continue across them. Only probe counts reach the driver, bounded by the number of
ranges, never by rows.

Defined results: a null text has size 16 and is kept apart from no other; null ids come
first inside a group of texts; rows that repeat id and text share a boundary side; an
empty table gives an empty table; all columns of the input are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed, whole_text, written

ROW_BYTES = 16
RANGE_BYTES = 128 << 20
TOLERANCE = 0.001
_PROBES = 4096


@dataclass(frozen=True)
class Splitters:
    """Upper keys of the ranges but the last, with exact bytes and rows up to each."""

    keys: np.ndarray
    bytes_below: list[int]
    rows_below: list[int]


def _as_bytes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(high, low) signed 64-bit pairs as 16-byte strings of the same order."""
    pair = np.empty((len(high), 2), ">u8")
    pair[:, 0] = high.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    pair[:, 1] = low.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return pair.view("S16").ravel()


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(16, b"\0"), "big")


def _keys(numbers: list[int]) -> np.ndarray:
    return np.array([n.to_bytes(16, "big") for n in numbers], "S16")


def _count(keys: DataFrame, probes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Per stretch between probes that holds rows: number, bytes, rows, least and last key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(probes) + 1), np.int64)
        ends: dict[int, list[bytes]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _as_bytes(*(batch.column(i).to_numpy() for i in (0, 1)))
            size = batch.column(2).to_numpy()
            order = np.argsort(key)
            key, size = key[order], size[order]
            stretch = np.searchsorted(probes, key, side="left")
            used, first = np.unique(stretch, return_index=True)
            last = np.append(first[1:], len(key)) - 1
            sums[0, used] += np.add.reduceat(size, first)
            sums[1, used] += last - first + 1
            for s, low, high in zip(used.tolist(), key[first].tolist(), key[last].tolist()):
                low, high = low.ljust(16, b"\0"), high.ljust(16, b"\0")
                old = ends.setdefault(s, [low, high])
                old[0], old[1] = min(old[0], low), max(old[1], high)
        used = sorted(ends)
        yield pa.record_batch(
            {
                "stretch": pa.array(used, pa.int32()),
                "size": pa.array(sums[0, used]),
                "n": pa.array(sums[1, used]),
                "low": pa.array([ends[s][0] for s in used], pa.binary()),
                "high": pa.array([ends[s][1] for s in used], pa.binary()),
            }
        )

    found = (
        keys.mapInArrow(count, "stretch int, size long, n long, low binary, high binary")
        .groupBy("stretch")
        .agg(*(f(c).alias(c) for f, c in ((F.sum, "size"), (F.sum, "n"), (F.min, "low"), (F.max, "high"))))
        .orderBy("stretch")
        .collect()
    )
    return [(r.stretch, r.size, r.n, _number(bytes(r.low)), _number(bytes(r.high))) for r in found]


def find_splitters(keys: DataFrame, ranges: int, shards: int, tolerance: float = TOLERANCE) -> Splitters:
    """Splitters of ``keys`` (high, low, size) into ``ranges``, a multiple of ``shards``.

    A boundary between shards is within ``tolerance`` of a shard's bytes of its target,
    one inside a shard within a tenth of a range's bytes; or it is the nearest key.
    """
    whole = _count(keys, _keys([]))
    if not whole or ranges < 2:
        return Splitters(_keys([]), [], [])
    _, total, rows, low, high = whole[0]
    per_shard = ranges // shards
    # Open boundary: target bytes, known point below (key, bytes, rows), point at or above.
    below, above = (low - 1, 0, 0), (high, total, rows)
    open_ = {j: (total * j / ranges, below, above) for j in range(1, ranges)}
    done: dict[int, tuple[int, int, int]] = {}
    while open_:
        each = max(3, _PROBES // len(open_))
        points: set[int] = set()
        for _, a, b in open_.values():
            step = b[0] - a[0]
            points.update(a[0] + step * i // (each + 1) for i in range(each + 2))
        probes = sorted(p for p in points if p >= 0)
        found = _count(keys, _keys(probes))
        # After the stretch, at its last key, everything up to there is counted.
        at, counted = {}, [(low - 1, 0, 0)]
        for stretch, size, n, first, last in found:
            at[len(counted)] = first
            counted.append((last, counted[-1][1] + size, counted[-1][2] + n))
        sums = np.array([c[1] for c in counted])
        still = {}
        for j, (target, _, _) in open_.items():
            i = int(np.searchsorted(sums, target, side="left"))
            i = min(max(i, 1), len(counted) - 1)
            a, b = counted[i - 1], counted[i]
            allowed = tolerance * total / shards if j % per_shard == 0 else total / ranges / 10
            near = min(a, b, key=lambda c: abs(c[1] - target))
            if abs(near[1] - target) <= allowed or at[i] == b[0]:
                done[j] = near
            else:
                # Nothing lies between the last key of a stretch and the next one's first.
                still[j] = (target, (at[i] - 1, a[1], a[2]), b)
        open_ = still
    order = [done[j] for j in sorted(done)]
    return Splitters(_keys([max(k, 0) for k, _, _ in order]), [b for _, b, _ in order], [r for _, _, r in order])


def id_order(ids: Column, kind: str) -> Column:
    """A 64-bit order of ids: integers as they are, others by hash, null lowest."""
    number = ids.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(ids)
    return F.when(ids.isNull(), F.lit(-(1 << 63))).otherwise(number)


def range_of(splitters: Splitters, high: str, low: str, per_shard: int) -> Column:
    """(range, shard, before): where a key belongs, and the rows of its shard before the range."""
    keys = splitters.keys
    starts = np.array([0, *splitters.rows_below], np.int64)
    before = starts - starts[np.arange(len(starts)) // per_shard * per_shard]

    @F.pandas_udf("range int, shard int, before long")
    def place(h: pd.Series, k: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, _as_bytes(h.to_numpy(), k.to_numpy()), side="left")
        return pd.DataFrame({"range": at, "shard": at // per_shard, "before": before[at]})

    return place(high, low)


def sharded(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = RANGE_BYTES,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """row (all columns of ``docs``), size, shard, slot (gapless from 0 in each shard)."""
    text = F.col(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = (
        F.xxhash64(text).alias("high"),
        id_order(F.col(id_col), kind).alias("low"),
        (F.octet_length(whole_text(text)) + ROW_BYTES).cast("long").alias("size"),
    )
    keys = written(docs.select(*keyed), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * range_bytes)))
    splitters = find_splitters(keys, shards * per_shard, shards, tolerance)
    inside = Window.partitionBy("at.range").orderBy("high", "low")
    return (
        packed(docs, *keyed)
        .withColumn("at", range_of(splitters, "high", "low", per_shard))
        .withColumn("slot", F.col("at.before") + F.row_number().over(inside) - 1)
        .select("row", "size", F.col("at.shard").alias("shard"), "slot")
    )
