"""Packing token sequences into windows by minimum bin slack.

Method: texts are tokenised whole and cut into full windows and one remainder each. The
remainders count only by length, so a histogram of at most ``capacity`` entries holds
all a plan needs. The planner fills one window after another: it takes the longest
length left, then a bitset subset-sum over the lengths with their counts finds the
multiset that comes closest to the capacity, and the counts are read back from the
bitsets. A window found this way is used as often as its lengths last. Where lengths
are left but none fits the slack, one of them is cut and its rest goes back into the
histogram; so only the very last window can have room.

Nothing but the histogram reaches the driver, and the plan that goes back to the tasks
holds a bounded number of windows. Pieces find their place by their rank among pieces
of equal length: ranks inside a written partition are given while tokenising, and the
partitions' offsets come from counts per partition and length. No window function runs
over all pieces of a length, so a length that a third of all texts share is no hot spot.

Defined results: a null or empty text is the end token alone; null and repeated ids are
packed like any others; an empty table gives an empty table; further columns are
ignored. Ids are little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import LATIN_PIECES, LATIN_TEXT, Known, vocabulary
from tidemark.llm.common import whole_text, written

CAPACITY = 2048
END_ID = 1
# Texts that are split together; their distinct words are worked out once.
_SLICE_BYTES = 8 << 20
# Stands for the line end among ids; no vocabulary has that many tokens.
_LINE = (1 << 32) - 1
LATIN_LINES = re.compile(LATIN_PIECES.pattern + "|\n")


@dataclass(frozen=True)
class Use:
    """Where the pieces of one length with ranks from ``start`` on go.

    ``each`` of them share a window, at ``offset`` and after; ``taken`` tokens are used,
    and a rest becomes a piece of its own length with ranks from ``rest_start`` on.
    """

    start: int
    sequence: int
    each: int
    offset: int
    taken: int
    rest_start: int = -1


@dataclass
class Plan:
    """Windows so far, and for every length its uses in order of rank."""

    capacity: int
    sequences: int = 0
    uses: dict[int, list[Use]] = field(default_factory=lambda: defaultdict(list))

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of a piece, cuts followed."""
        out, done = [], 0
        while length:
            uses = self.uses[length]
            use = uses[bisect.bisect_right(uses, rank, key=lambda u: u.start) - 1]
            window, slot = divmod(rank - use.start, use.each)
            out.append((done, use.taken, use.sequence + window, use.offset + slot * length))
            done += use.taken
            length, rank = length - use.taken, use.rest_start + window
        return out


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how often each is used: the longest one, and what fills the rest best.

    Bit ``s`` of ``reached`` says that the sum ``s`` can be made. A length that may be
    used ``c`` times enters in doubling portions; ``trail`` keeps the bits before each
    portion, from which the counts are traced back.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << room + 1) - 1
    reached, trail = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        portion = 1
        while left > 0 and not reached >> room & 1:
            portion = min(portion, left)
            trail.append((length, portion, reached))
            reached |= reached << length * portion & mask
            left -= portion
            portion *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    used = Counter({longest: 1})
    for length, portion, before in reversed(trail):
        if not before >> total & 1:
            used[length] += portion
            total -= length * portion
    return dict(used)


def plan_windows(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan for ``histogram`` (pieces by length, each 1 to ``capacity``)."""
    plan = Plan(capacity)
    counts = {length: n for length, n in histogram.items() if n > 0}
    made = dict(counts)
    while counts:
        window = fill_window(counts, capacity)
        slack = capacity - sum(length * n for length, n in window.items())
        rest = [x for x in counts if counts[x] > window.get(x, 0)] if slack else []
        cut = max(rest, default=0)
        need = Counter(window)
        need[cut] += bool(cut)
        times = min(counts[x] // n for x, n in need.items() if n)
        offset = 0
        for length, n in window.items():
            start = made[length] - counts[length]
            plan.uses[length].append(Use(start, plan.sequences, n, offset, length))
            counts[length] -= n * times
            offset += n * length
        if cut:
            start, left = made[cut] - counts[cut], cut - slack
            plan.uses[cut].append(
                Use(start, plan.sequences, 1, offset, slack, made.get(left, 0))
            )
            counts[cut] -= times
            made[left] = made.get(left, 0) + times
            counts[left] = counts.get(left, 0) + times
        plan.sequences += times
        counts = {length: n for length, n in counts.items() if n}
    return plan


@lru_cache(maxsize=2)
def piece_ids(vocab_path: str) -> Known:
    """Ids of pre-tokens in byte characters; the merges are the library's."""
    tokenize = vocabulary(vocab_path).library.model.tokenize
    return Known(lambda piece: array("I", [t.id for t in tokenize(piece)]).tobytes())


@lru_cache(maxsize=2)
def latin_ids(vocab_path: str) -> Known:
    """Ids of lower-case Latin pre-tokens and of the line end, which is ``_LINE``."""
    names, tokenize = vocabulary(vocab_path).byte_names, vocabulary(vocab_path).library.model.tokenize

    def work(piece: str) -> bytes:
        if piece == "\n":
            return _LINE.to_bytes(4, "little")
        name = piece if piece.isascii() else "".join([names[b] for b in piece.encode()])
        return array("I", [t.id for t in tokenize(name)]).tobytes()

    return Known(work)


def word_ids(words: list[bytes], vocab_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of blank-free words: all of them in a row, and each word's start and count there.

    Latin words are split together, as the lines of one text; the others, and those with a
    special string, go one by one.
    """
    vocab, pieces = vocabulary(vocab_path), piece_ids(vocab_path)
    lines = b"\n".join(words).decode("utf-8", "replace")
    rest = []
    if not (vocab.latin and LATIN_TEXT.fullmatch(lines)) or vocab.special_pattern.search(lines):
        texts = lines.split("\n")
        for i, text in enumerate(texts):
            if not (vocab.latin and LATIN_TEXT.fullmatch(text)) or vocab.special_pattern.search(text):
                rest.append((i, text))
                texts[i] = ""
        lines = "\n".join(texts)
    found = LATIN_LINES.findall(f"{lines}\n".lower())
    flat = np.frombuffer(b"".join(map(latin_ids(vocab_path).__getitem__, found)), "<u4")
    ends = np.flatnonzero(flat == _LINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = ends - starts
    more = []
    for i, text in rest:
        ids = [p.to_bytes(4, "little") if isinstance(p, int) else pieces[p] for p in vocab.pre_tokens(text)]
        more.append(b"".join(ids))
        counts[i] = len(more[-1]) // 4
    if rest:
        at = [i for i, _ in rest]
        starts[at] = len(flat) + np.cumsum(counts[at]) - counts[at]
        flat = np.concatenate([flat, np.frombuffer(b"".join(more), "<u4")])
    return flat, starts, counts


def text_ids(texts: pa.Array, vocab_path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, each with the end, in a row; and where each text ends there."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    flat, starts, counts = word_ids(words.dictionary.cast(pa.binary()).to_pylist(), vocab_path)
    # The end is one more word, after the last of each text.
    starts, counts = np.append(starts, len(flat)), np.append(counts, 1)
    flat = np.append(flat, np.uint32(end_id))
    last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    order = np.insert(words.indices.to_numpy(zero_copy_only=False), last, len(counts) - 1)
    sizes = counts[order]
    until = np.cumsum(sizes)
    # A slice has fewer than 2^31 tokens, as Arrow's strings have fewer bytes.
    shift = (starts[order] - until + sizes).astype("int32")
    ids = flat[np.repeat(shift, sizes) + np.arange(until[-1], dtype="int32")]
    return ids, until[last + np.arange(len(texts))]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about ``_SLICE_BYTES`` together."""
    until = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64"))
    first = 0
    while first < len(texts):
        before = until[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(until, before + _SLICE_BYTES, "right")))
        yield first, stop - first
        first = stop


def tokenised(
    docs: DataFrame, vocab_path: str, id_col: str, text_col: str, end_id: int, capacity: int
) -> DataFrame:
    """id, ids, n (tokens), and where the text stands inside its partition.

    ``nth`` is its rank among the texts of the partition with an equally long remainder,
    ``nth_full`` the number of full windows before it.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        full = 0
        for whole in batches:
            for first, rows_in in slices(whole.column(1)):
                batch = whole.slice(first, rows_in)
                ids, until = text_ids(batch.column(1), vocab_path, end_id)
                n = np.diff(until, prepend=0)
                nth, nth_full = [], []
                for tokens in n.tolist():
                    nth.append(seen[tokens % capacity])
                    nth_full.append(full)
                    seen[tokens % capacity] += 1
                    full += tokens // capacity
                bounds = np.concatenate([[0], 4 * until]).astype("int64")
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))]
                )
                yield pa.record_batch(
                    {
                        "id": batch.column(0),
                        "ids": data.cast(pa.binary()),
                        "n": pa.array(n, pa.int64()),
                        "part": pa.array([part] * len(n), pa.int32()),
                        "nth": pa.array(nth, pa.int64()),
                        "nth_full": pa.array(nth_full, pa.int64()),
                    }
                )

    return rows.mapInArrow(
        tokenise, f"id {kind}, ids binary, n long, part int, nth long, nth_full long"
    )


def pack(
    docs: DataFrame,
    vocab_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset."""
    tokens = written(tokenised(docs, vocab_path, id_col, text_col, end_id, capacity), "tokens")
    # Per partition: pieces of every length, full windows under the length ``capacity``.
    counts = (
        tokens.groupBy("part", (F.col("n") % capacity).alias("length"))
        .agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.expr(f"n div {capacity}")).alias("full"))
    )
    full = counts.groupBy("part").agg(F.sum("full").alias("pieces"))
    pieces = counts.select("part", "length", "pieces").where("length > 0").union(
        full.select("part", F.lit(capacity).cast("long"), "pieces")
    )
    histogram = {
        r["length"]: r["pieces"]
        for r in pieces.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()
    }
    plan = plan_windows(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.withColumn("before", F.coalesce(F.sum("pieces").over(before), F.lit(0)))
    offsets = (
        counts.select("part", "length")
        .join(
            ranked.where(F.col("length") == capacity).select("part", F.col("before").alias("full_before")),
            "part",
        )
        .join(ranked.where(F.col("length") < capacity).select("part", "length", "before"), ["part", "length"], "left")
    )
    kind = tokens.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        for batch in batches:
            of, out = [], {k: [] for k in kinds}
            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            for row, (ids, n, rank, rank_full) in enumerate(zip(*columns)):
                whole = [(capacity * i, capacity, rank_full + i) for i in range(n // capacity)]
                for begin, length, nth in [*whole, (n - n % capacity, n % capacity, rank)]:
                    for at, size, sequence, offset in plan.place(length, nth):
                        of.append(row)
                        start = begin + at
                        values = (start, size, ids[4 * start : 4 * (start + size)], n, sequence, offset)
                        for k, value in zip(kinds, values):
                            out[k].append(value)
            types = {k: pa.binary() if k == "ids" else pa.int64() for k in kinds}
            yield pa.record_batch(
                {"id": batch.column(0).take(pa.array(of, pa.int64()))}
                | {k: pa.array(v, types[k]) for k, v in out.items()}
            )

    return (
        tokens.withColumn("length", F.col("n") % capacity)
        .join(offsets, ["part", "length"])
        .select(
            "id",
            "ids",
            "n",
            (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("rank"),
            (F.col("full_before") + F.col("nth_full")).alias("rank_full"),
        )
        .mapInArrow(
            place,
            f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
        )
        .withColumnRenamed("id", id_col)
    )
