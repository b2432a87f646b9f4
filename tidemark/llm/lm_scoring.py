"""Language-model scores by context-tree weighting over the bytes of the texts.

A text is lower-cased (A to Z), its words are joined by single spaces, and END closes it.
The model is :mod:`tidemark.llm.context_tree` with contexts of up to ``depth`` bytes,
trained on all texts whose ``crc32(id) % 5`` is not 1; the others are held out. The score
is the log10 probability of the text. Beside it stands the score by single words.

Flow: texts are written in chunks of at most ``chunk_bytes`` (a longer text is a chunk of
its own). Each chunk's distinct grams and words go, packed, to buckets by the last two
bytes of the context or by word. A bucket first adds up all chunks' counts and weighs its
subtrees; only depths 0 and 1, at most 65,280 sums, pass through the driver. It then
answers every chunk with one value per gram, and each chunk adds up its texts. So a
frequent gram or word is one entry per chunk, chunks stream past a bucket one at a time,
and a bucket holds distinct grams only. Nothing is dropped, capped or broadcast but those
65,280 sums; what is gathered grows with the input.

Defined results: a null or blank text is END alone (one token); a null id counts as the
empty text in the checksum and is trained on; rows that repeat are scored and trained on
as often as they occur; without training texts every bit has probability one half and the
score by words is 0; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import context_tree as ct
from tidemark.llm.common import whole_text, written

DEPTH = 6
CHUNK_BYTES = 32 << 20
# Text per step of numpy work, and text per bucket.
_STEP = 4 << 20
_BUCKET_BYTES = 8 << 20
_CHUNKED = "chunk long, held_out boolean, n_tokens long, norm binary"
_PACKED = "bucket int, chunk long, part int, entries binary, counts binary, known long"
_SUMS = "key long, zeros double, ones double, below double"


def _steps(texts: list[bytes], most: int = _STEP) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if texts:
        yield first, len(texts)


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """id, chunk, held_out, n_tokens (END included) and the normalised text of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    for field in T.StructType.fromDDL(_CHUNKED):
        schema.add(field)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        size = 0
        for batch in batches:
            words = [t.encode().lower().split() for t in batch.column(2).to_pylist()]
            norms = [b" ".join(w) for w in words]
            for first, last in _steps(norms, chunk_bytes):
                more = sum(len(n) + 1 for n in norms[first:last])
                if size and size + more > chunk_bytes:
                    chunk, size = chunk + 1, 0
                size += more
                part = batch.slice(first, last - first)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([chunk] * len(part), pa.int64()),
                        part.column(1),
                        pa.array([len(w) + 1 for w in words[first:last]], pa.int64()),
                        pa.array(norms[first:last], pa.binary()),
                    ],
                    names=schema.names,
                )

    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.crc32(number.cast("binary")) % 5 == 1).alias("held_out"),
        whole_text(F.col(text_col)).alias("text"),
    )
    return rows.mapInArrow(assign, schema)


def _gram_bucket(grams: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """The bucket of a gram: by the two bytes before the symbol."""
    return (grams >> (8 * (depth - 1))) * 40503 % 65536 % buckets


def _by_bucket(grams: np.ndarray, depth: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets in order, each with the places of its grams, themselves in order."""
    at = _gram_bucket(grams, depth, buckets)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(at[places[0]]), places


def _chunk_grams(norms: list[bytes], held_out: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a chunk in order, with their counts in training texts."""
    found = []
    for first, last in _steps(norms):
        for held in (False, True):
            texts = [n for n, h in zip(norms[first:last], held_out[first:last]) if h == held]
            if texts:
                keys, n = np.unique(ct.text_grams(texts, depth)[0], return_counts=True)
                found.append((keys, n * (not held)))
    return ct.summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def _chunk_words(norms: list[bytes], held_out: list[bool], buckets: int) -> dict[int, dict[bytes, int]]:
    """Counts in training texts of the distinct words, by bucket."""
    counts: Counter = Counter()
    for norm, held in zip(norms, held_out):
        if held:
            counts.update(dict.fromkeys(norm.split(), 0))
        else:
            counts.update(norm.split())
    out: dict[int, dict[bytes, int]] = defaultdict(dict)
    for word, n in counts.items():
        out[-1 - zlib.crc32(word) % buckets][word] = n
    return out


def _squeezed(numbers: np.ndarray) -> bytes:
    """Eight-byte numbers by byte planes, compressed."""
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _spread(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps_between(grams: np.ndarray) -> bytes:
    """Grams in order as differences."""
    return _squeezed(np.diff(grams, prepend=np.int64(0)))


def _in_order(data: bytes) -> np.ndarray:
    return _spread(data).cumsum()


def _distinct(grams: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting: most grams of a step are distinct."""
    grams = np.sort(grams)
    return grams[np.r_[True, grams[1:] != grams[:-1]]] if len(grams) else grams


def _joined(words: list[bytes]) -> bytes:
    return zstandard.compress(b" ".join(words), 1)


def _split(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split()


def _row(bucket: int, chunk: int | None, part: int, entries: bytes, counts: bytes, known: int = 0):
    return pa.record_batch(
        [
            pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([part], pa.int32()),
            pa.array([entries], pa.binary()), pa.array([counts], pa.binary()), pa.array([known], pa.int64()),
        ],
        names=[part.split()[0] for part in _PACKED.split(", ")],
    )


def dictionaries(chunks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Per chunk and bucket, the chunk's distinct grams (or words) with training counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, norms, held in _whole_chunks(batches):
            grams, n = _chunk_grams(norms, held, depth)
            for bucket, at in _by_bucket(grams, depth, buckets):
                yield _row(bucket, chunk, 0, _steps_between(grams[at]), _squeezed(n[at]))
            for bucket, words in _chunk_words(norms, held, buckets).items():
                names = sorted(words)
                counts = np.array([words[w] for w in names], np.int64)
                yield _row(bucket, chunk, 0, _joined(names), _squeezed(counts))

    return chunks.select("chunk", "held_out", "norm").mapInArrow(count, _PACKED)


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """Neighbouring rows of one chunk, together."""
    chunk, norms, held = None, [], []
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for number, is_held, norm in rows:
            if number != chunk and norms:
                yield chunk, norms, held
                norms, held = [], []
            chunk = number
            norms.append(norm)
            held.append(is_held)
    if norms:
        yield chunk, norms, held


class _Places:
    """Where a gram stands in an array of distinct ones, by open addressing; it must be there."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = max(4, (4 * len(grams)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, waiting = self._slot(grams), np.arange(len(grams), dtype=np.int32)
        while len(waiting):
            own = at[waiting]
            free = self.slots[own] < 0
            self.slots[own[free]] = waiting[free]
            waiting = waiting[self.slots[own] != waiting]
            at[waiting] = (at[waiting] + 1) % len(self.slots)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        at = self._slot(grams)
        found = self.slots[at]
        wrong = np.flatnonzero(self.grams[found] != grams)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.grams[found[wrong]] != grams[wrong]]
        return found


class _GramSums:
    """Counts by gram; what was added is merged whenever it outgrows what is merged."""

    def __init__(self):
        self.grams, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, entries: bytes, counts: bytes) -> None:
        self.fresh.append((_in_order(entries), _spread(counts)))
        self.waiting += len(self.fresh[-1][0])
        if self.waiting > max(len(self.grams), 1 << 18):
            self.merge()

    def merge(self) -> None:
        if self.fresh:
            self.grams, self.counts = ct.summed(
                np.concatenate([self.grams, *(g for g, _ in self.fresh)]),
                np.concatenate([self.counts, *(n for _, n in self.fresh)]),
            )
            self.fresh, self.waiting = [], 0


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, chunk, entries, counts = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4))
            yield bucket, chunk, entries, counts


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _GramSums, Counter]]:
    """Every bucket of the partition, its chunks' counts added up."""
    now, grams, words = None, _GramSums(), Counter()
    for bucket, _, entries, counts in _bucket_rows(batches):
        if bucket != now:
            if now is not None:
                grams.merge()
                yield now, grams, words
            now, grams, words = bucket, _GramSums(), Counter()
        if bucket >= 0:
            grams.add(entries, counts)
        else:
            words.update(dict(zip(_split(entries), _spread(counts).tolist())))
    if now is not None:
        grams.merge()
        yield now, grams, words


def bucket_counts(dictionary: DataFrame) -> DataFrame:
    """Per bucket, all distinct entries with their training counts, in rows of bounded size."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, grams, words in _sums(batches):
            if bucket >= 0:
                for part, first in enumerate(range(0, len(grams.grams), 1 << 20)):
                    cut = slice(first, first + (1 << 20))
                    yield _row(bucket, None, part, _steps_between(grams.grams[cut]), _squeezed(grams.counts[cut]))
            else:
                names, n = list(words), np.fromiter(words.values(), np.int64, len(words))
                for part, first in enumerate(range(0, len(names), 1 << 19)):
                    cut = slice(first, first + (1 << 19))
                    known = int((n[cut] > 0).sum())
                    yield _row(bucket, None, part, _joined(names[cut]), _squeezed(n[cut]), known)

    return _dealt(dictionary).mapInArrow(add_up, _PACKED)


def _dealt(packed: DataFrame) -> DataFrame:
    """Each bucket in one partition: sums (null chunk) first, then the chunks."""
    return packed.repartition("bucket").sortWithinPartitions(F.col("bucket"), F.col("chunk").asc_nulls_first(), "part")


def shallow_levels(totals: DataFrame, depth: int) -> list[ct.Level]:
    """Depths 0 and 1 from the subtrees of all buckets: at most 65,280 sums at the driver."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, _ in _sums(batches):
            if len(grams.grams):
                second = ct.levels(grams.grams, grams.counts, depth, top=2)[0]
                columns = ct.gathered(second)
                yield pa.record_batch([pa.array(c) for c in columns], names=["key", "zeros", "ones", "below"])

    sums = (
        _dealt(totals.where("bucket >= 0")).mapInArrow(climb, _SUMS)
        .groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).orderBy("key").toArrow()
    )
    first = ct.weigh(*(sums.column(c).to_numpy() for c in ("key", "zeros", "ones", "below")))
    return [ct.weigh(*ct.gathered(first)), first]


def answers(dictionary: DataFrame, totals: DataFrame, shallow: list[ct.Level], depth: int) -> DataFrame:
    """Per chunk and bucket, a value per entry: log2 probability, or a word's training count.

    Words come back by name; a chunk works out its grams in the same order again.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, words, values = None, _GramSums(), {}, None
        for (bucket, chunk), rows in groupby(_bucket_rows(batches), lambda row: row[:2]):
            if bucket != now:
                now, sums, words, values = bucket, _GramSums(), {}, None
            if chunk is None:
                for _, _, entries, counts in rows:
                    if bucket >= 0:
                        sums.add(entries, counts)
                    else:
                        words.update(zip(_split(entries), _spread(counts).tolist()))
                continue
            # A chunk may have been read in pieces: their entries together, in order.
            pieces = [entries for _, _, entries, _ in rows]
            if bucket < 0:
                names = sorted(set().union(*(_split(p) for p in pieces)))
                found = np.array([words[w] for w in names], np.float64)
                entries = _joined(names)
            else:
                entries = b""
                if values is None:
                    sums.merge()
                    tree = shallow + ct.levels(sums.grams, sums.counts, depth, top=2)
                    values = np.empty(len(sums.grams))
                    for first in range(0, len(values), 1 << 18):
                        cut = slice(first, first + (1 << 18))
                        values[cut] = ct.log2_probabilities(sums.grams[cut], tree)
                    del tree
                grams = _distinct(np.concatenate([_in_order(p) for p in pieces]))
                found = values[np.searchsorted(sums.grams, grams)]
            yield pa.record_batch(
                [
                    pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([entries], pa.binary()),
                    pa.array([_squeezed(found)], pa.binary()),
                ],
                names=["bucket", "chunk", "words", "found"],
            )

    asked = dictionary.withColumn("counts", F.lit(None).cast("binary"))
    return _dealt(totals.unionByName(asked)).mapInArrow(answer, "bucket int, chunk long, words binary, found binary")


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes (of the normalised text) and bits_per_byte, END included.
    """
    if not 2 <= depth <= 6:
        raise ValueError("a gram has to fit 64 bits: depth 2 to 6")
    chunks = written(chunked(docs, id_col, text_col, chunk_bytes), "lm-chunks")
    size, train_tokens, train_texts = chunks.agg(
        F.coalesce(F.sum(F.octet_length("norm") + 1), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("held_out"), 1)), F.lit(0)),
    ).first()
    buckets = min(1 << 14, size // _BUCKET_BYTES + 16)
    dictionary = written(dictionaries(chunks, depth, buckets), "lm-dictionaries")
    totals = written(bucket_counts(dictionary), "lm-totals")
    distinct = (totals.agg(F.sum("known")).first()[0] or 0) + (train_texts > 0)
    shallow = shallow_levels(totals, depth)
    found = answers(dictionary, totals, shallow, depth)
    scale, log10_2 = train_tokens + 0.5 * (distinct + 1), math.log10(2)
    kind = chunks.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind)])
    for field in T.StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double,"
        " score double, n_bytes long, bits_per_byte double"
    ):
        schema.add(field)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        norms = left.column("norm").to_pylist()
        values = dict(zip(right.column("bucket").to_pylist(), right.column("found").to_pylist()))
        grams = _distinct(
            np.concatenate([_distinct(ct.text_grams(norms[first:last], depth)[0]) for first, last in _steps(norms)])
        )
        known = np.empty(len(grams))
        for bucket, at in _by_bucket(grams, depth, buckets):
            known[at] = _spread(values[bucket], np.float64)
        end, unseen = (math.log10((n + 0.5) / scale) for n in (train_texts, 0))
        log_of: dict[bytes, float] = {}
        for bucket, names in zip(right.column("bucket").to_pylist(), right.column("words").to_pylist()):
            if bucket < 0:
                counts = _spread(values[bucket], np.float64)
                logs = np.where(counts > 0, np.log10((counts + 0.5) / scale), unseen)
                log_of.update(zip(_split(names), logs.tolist()))
        base, n_known = [], []
        for norm in norms:
            logs = list(map(log_of.__getitem__, norm.split()))
            base.append(sum(logs) + end)
            n_known.append(len(logs) - logs.count(unseen) + (train_texts > 0))
        places, bits = _Places(grams), np.empty(len(norms))
        for first, last in _steps(norms):
            positions, starts = ct.text_grams(norms[first:last], depth)
            bits[first:last] = np.add.reduceat(known[places.of(positions)], starts)
        n_bytes = np.array([len(n) for n in norms], np.int64)
        return pa.table(
            [
                left.column("id"), left.column("held_out"), left.column("n_tokens"), pa.array(n_known, pa.int64()),
                pa.array([train_tokens] * len(norms), pa.int64()), pa.array(base, pa.float64()),
                pa.array(bits * log10_2), pa.array(n_bytes), pa.array(-bits / (n_bytes + 1)),
            ],
            names=schema.names,
        )

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, schema)
