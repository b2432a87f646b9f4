"""Near-duplicate groups by MinHash, banding and connected components.

Method: 128 minima of universal hash functions per set of five-word shingles, 32 bands
of 4; documents that share a band are candidates, candidates whose signatures agree too
little are dropped, the rest is confirmed on the full shingle sets, and confirmed links
are grouped by alternating large-star and small-star.

Equal shingle sets are one class first, so copies never meet as pairs. Inside a band's
bucket not all pairs are made: what counts is which classes connect.

1. Every class is compared with the bucket's least class; confirmed links are grouped.
2. In buckets that still hold several components, classes outside the largest one are
   compared with another class of the largest, a different one in each bucket.
3. What a large bucket leaves open is settled exactly: where buckets still hold several
   components, classes outside the largest one look for partners through the rare
   shingles they share. Two sets can only be similar enough if they share one among the
   first few of each in a common order, here by rising frequency; a large group's common
   text is frequent and so never makes pairs. The order comes from a table of counters
   of fixed size; whatever it counts, no partner is missed.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6, and
agrees in fewer than 64 of 128 minima with probability 3e-10.

Defined results: a null or blank text has no shingles and links with nothing; a null id
is larger than every id; rows that repeat an id are separate rows of the classification
and one of them stays when filtering; an empty table gives an empty table; further
columns, also with names used here, pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.common import packed, text_key, whole_text, written
from tidemark.llm.components import connected_components


@dataclass(frozen=True)
class NearParams:
    percent: int = 75
    bands: int = 32
    rows: int = 4
    least_agreeing: int = 64
    slots: int = 1 << 20


def signatures(docs: DataFrame, id_col: str, text_col: str, params: NearParams) -> DataFrame:
    """id, key (of id and text), n_shingles, digest of the shingle set, its minima."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        text_key(F.col(id_col).cast("string"), F.col(text_col)).alias("key"),
        whole_text(F.col(text_col)).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = shingles.MinHash(params.bands * params.rows)
        for batch in batches:
            sizes, digests, signed = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles.shingle_set(text)
                sizes.append(len(found))
                digests.append(hashlib.md5(found.tobytes()).digest())
                signed.append(minima.signature(found).tobytes() if len(found) else None)
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "key": batch.column(1),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "minima": pa.array(signed, pa.binary()),
                }
            )

    return rows.mapInArrow(
        sign, f"id {kind}, key binary, n_shingles long, digest binary, minima binary"
    )


def _buckets(classes: DataFrame, params: NearParams) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = [
                shingles.band_keys(np.frombuffer(m, "<u4"), params.rows)
                for m in batch.column(1).to_pylist()
            ]
            if bands:
                at = np.repeat(np.arange(len(bands)), params.bands)
                yield pa.record_batch(
                    {
                        "bucket": pa.array(np.concatenate(bands)),
                        "node": batch.column(0).take(pa.array(at)),
                    }
                )

    return classes.select("digest", "minima").mapInArrow(keys, "bucket long, node binary")


def _agreeing(pairs: DataFrame, classes: DataFrame, params: NearParams) -> DataFrame:
    """Pairs (u, v) whose signatures agree often enough."""
    minima = classes.select(F.col("digest").alias("node"), "minima")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1)
                for i in (2, 3)
            )
            good = (a == b).sum(axis=1) >= params.least_agreeing
            yield batch.select([0, 1]).filter(pa.array(good))

    return (
        pairs.join(minima.withColumnRenamed("node", "v").withColumnRenamed("minima", "mv"), "v")
        .join(minima.withColumnRenamed("node", "u").withColumnRenamed("minima", "mu"), "u")
        .select("u", "v", "mu", "mv")
        .mapInArrow(agree, "u binary, v binary")
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """Pairs (u, v) that are similar enough by their full shingle sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            good = [
                shingles.similar(x, y, params.percent)
                for x, y in zip(shingles.recent(a), shingles.recent(b))
            ]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
        .join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
        .select("u", "v", "tu", "tv")
        .mapInArrow(confirm, "u binary, v binary")
    )


def _regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) after adding ``links`` (u, v) between its nodes."""
    of = lambda name: groups.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    between = links.join(of("u"), "u").join(of("v"), "v").select(
        F.col("cu").alias("u"), F.col("cv").alias("v")
    )
    merged = connected_components(between).select(
        F.col("node").alias("component"), F.col("component").alias("merged")
    )
    return written(
        groups.join(merged, "component", "left").select(
            "node", F.coalesce("merged", "component").alias("component")
        ),
        "groups",
    )


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: bucket, node, outside (of the largest)."""
    placed = members.join(groups, "node")
    largest = (
        placed.groupBy("bucket", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket")
        .agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
    )
    return placed.join(largest, "bucket").select(
        "bucket", "node", (F.col("component") != F.col("largest")).alias("outside")
    )


def _frequencies(texts: DataFrame, slots: int) -> np.ndarray:
    """How often shingles fall into each of ``slots`` counters, in eighths of a doubling.

    One byte a counter: that is all the driver gets and sends to the tasks. Counts that
    share a level are in the order of the shingles.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                total += np.bincount(_slot(shingles.shingle_set(text), slots), minlength=slots)
        used = np.flatnonzero(total)
        yield pa.record_batch({"slot": pa.array(used, pa.int32()), "n": pa.array(total[used])})

    counted = (
        texts.select("text")
        .mapInArrow(count, "slot int, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .select("slot", F.least(F.floor(8 * F.log2("n")) + 1, F.lit(255)).cast("short").alias("level"))
        .toArrow()
    )
    out = np.zeros(slots, np.uint8)
    out[counted["slot"].to_numpy()] = counted["level"].to_numpy()
    return out


def _slot(found: np.ndarray, slots: int) -> np.ndarray:
    return (found % np.uint64(slots)).astype(np.int64)


def _rare_first(texts: DataFrame, params: NearParams) -> DataFrame:
    """The first shingles of every set: shingle, node, n (set size), at (position from 1)."""
    frequency = _frequencies(texts, params.slots)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, sizes, places = [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = shingles.shingle_set(text)
                n = len(found)
                length = n - -(-params.percent * n // 100) + 1
                first = found[np.lexsort((found, frequency[_slot(found, params.slots)]))[:length]]
                rows.append(np.full(len(first), row))
                values.append(first.view(np.int64))
                sizes.append(np.full(len(first), n))
                places.append(np.arange(1, len(first) + 1))
            if rows:
                yield pa.record_batch(
                    {
                        "shingle": pa.array(np.concatenate(values)),
                        "node": batch.column(0).take(pa.array(np.concatenate(rows))),
                        "n": pa.array(np.concatenate(sizes), pa.int64()),
                        "at": pa.array(np.concatenate(places), pa.int64()),
                    }
                )

    return texts.select("node", "text").mapInArrow(
        prefixes, "shingle long, node binary, n long, at long"
    )


def _partners(opened: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """Pairs (a, b) of different components, ``a`` outside, that could be similar.

    By their sizes and the places of a rare shingle they share; ``opened`` has node,
    outside and component.
    """
    first = written(_rare_first(texts.join(opened, "node"), params).join(opened, "node"), "rare-shingles")
    a = first.where("outside").select(
        "shingle", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa")
    )
    b = first.select(
        "shingle", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb")
    )
    # Shingles that two similar sets of these sizes have in common at least.
    p = params.percent
    common = F.expr(f"ceil({p} * (na + nb) / {100 + p})")
    possible = (
        (F.col("ca") != F.col("cb"))
        & (100 * F.least("na", "nb") >= p * F.greatest("na", "nb"))
        & (F.col("na") - F.col("pa") + 1 >= common)
        & (F.col("nb") - F.col("pb") + 1 >= common)
    )
    return a.join(b, (a["shingle"] == b["shingle"]) & possible).select("a", "b")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _class_groups(
    docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, params: NearParams
) -> DataFrame:
    """(digest, component_id) of every shingle set that shares a bucket with another."""
    classes = written(
        signed.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("minima").alias("minima")),
        "classes",
    )
    buckets = _buckets(classes, params)
    heads = (
        buckets.groupBy("bucket")
        .agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    members = written(buckets.join(heads, "bucket"), "members")
    nodes = members.select("node").distinct()
    # One whole text per class, found by the key of its id and text.
    holders = nodes.join(classes.select(F.col("digest").alias("node"), "key"), "node")
    texts = written(
        docs.select(
            text_key(F.col(id_col).cast("string"), F.col(text_col)).alias("key"),
            F.col(text_col).cast("string").alias("text"),
        )
        .join(holders, "key")
        .dropDuplicates(["node"])
        .select("node", "text"),
        "candidate-texts",
    )
    groups = nodes.select("node", F.col("node").alias("component"))

    def joined(groups: DataFrame, pairs: DataFrame) -> DataFrame:
        links = written(_confirmed(_agreeing(pairs, classes, params), texts, params), "near-links")
        return _regrouped(groups, links)

    near = members.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    tested = written(_pairs(near), "pairs")
    groups = joined(groups, tested)

    open_ = written(_open_members(members, groups), "open-members")
    other = (
        open_.where("not outside")
        .groupBy("bucket")
        .agg(F.min_by("node", F.struct(F.xxhash64("node", "bucket"), "node")).alias("b"))
    )
    near = open_.where("outside").select("bucket", F.col("node").alias("a")).join(other, "bucket")
    pairs = written(_pairs(near).join(tested, ["u", "v"], "left_anti"), "other-pairs")
    groups = joined(groups, pairs)
    tested = tested.union(pairs)

    opened = written(
        _open_members(members, groups).groupBy("node").agg(F.max("outside").alias("outside")).join(groups, "node"),
        "open-classes",
    )
    pairs = written(
        _pairs(_partners(opened, texts, params)).join(tested, ["u", "v"], "left_anti"), "open-pairs"
    )
    groups = joined(groups, pairs)
    least = (
        groups.join(classes.select(F.col("digest").alias("node"), "least"), "node")
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
    )
    return groups.join(least, "component").select(F.col("node").alias("digest"), "component_id")


def _assigned(docs: DataFrame, id_col: str, text_col: str, params: NearParams) -> DataFrame:
    signed = written(signatures(docs, id_col, text_col, params), "signatures")
    grouped = _class_groups(docs, signed, id_col, text_col, params)
    own = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("own"))
    ids = own.join(grouped, "digest", "left").select(
        "digest", F.coalesce("component_id", "own").alias("component_id")
    )
    return signed.select("id", "key", "n_shingles", "digest").join(ids, "digest", "left").select(
        "id",
        "key",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id"))
        .otherwise(F.col("id"))
        .alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    params: NearParams = NearParams(),
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    return _assigned(docs, id_col, text_col, params).select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    params: NearParams = NearParams(),
) -> DataFrame:
    """One document of each group, all columns unchanged; blank texts all stay."""
    stays = (
        _assigned(docs, id_col, text_col, params)
        .where(F.col("id").eqNullSafe(F.col("component_id")))
        .select("key", F.col("n_shingles") > 0)
        .toDF("key", "grouped")
        .distinct()
    )
    first = Window.partitionBy("key").orderBy(F.lit(0))
    joined = packed(
        docs, text_key(F.col(id_col).cast("string"), F.col(text_col)).alias("key")
    ).join(stays, "key")
    return (
        joined.withColumn("nth", F.when(F.col("grouped"), F.row_number().over(first)).otherwise(1))
        .where("nth = 1")
        .select("row.*")
    )
