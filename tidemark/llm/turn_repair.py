"""Structure repair of conversations by the cheapest edits.

Method: iterative-deepening A* (:mod:`tidemark.llm.edit_search`), depth first in ASCII
edit order under rising cost bounds with a table of failed states; the first accepting
path is the answer.

A conversation longer than ``PART`` rows is searched in parts: per part the best edits
from every state it can begin in to every state it can end in, put together from left to
right. Of equal costs the least string wins in each step; as no string for the same rows
begins another, this gives the least string of all. So the search is bounded by the part,
and memory by one part, one letter per row and four running digests, however long the
conversation. Its rows pass in order through one task, because the digest of the repaired
text can only be taken in order; they are streamed, never gathered.

Whether role and text were seen earlier is found by grouping on a 128-bit key before that,
with rows that repeat turn, role and text counted once by map tasks.

Defined results: rows go by turn (nulls first), then role and text; a null role or text is
one space; an empty role has no initial; a null conversation id is a conversation; a role
is told by its first character, as it is; an empty table gives an empty table; further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import edit_search as es
from tidemark.llm.common import BLANKS, text_key

PART = 32
_NAMES = {"u": "user", "a": "assistant"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by ``crc32("conv_id:turn") % 20``.

    0 drops the row, 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 sets
    the role user.
    """
    space = F.lit(" ")

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(known("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    )
    return rows.drop("copy")


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, n (equal rows), seen (earlier): a conversation in one partition, in order."""
    space = F.lit(" ")
    given = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
    )
    counted = given.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "key", text_key(F.col("role"), F.col("text"))
    )
    # A null turn is the first.
    first = counted.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(
        F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("least")
    )
    seen = F.col("turn").isNotNull() & (F.col("at_null") | (F.col("turn") > F.col("least")))
    told = counted.join(first, counted.conv.eqNullSafe(first.c) & (counted.key == first.k))
    return (
        told.select("conv", "turn", "role", "text", "n", seen.alias("seen"))
        .repartition("conv")
        .sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), "role", "text")
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, turn, role, text, duplicate) per row, equal rows one by one."""
    for batch in batches:
        for conv, turn, role, text, n, seen in zip(*(c.to_pylist() for c in batch.columns)):
            yield conv, turn, role, text, seen
            for _ in range(n - 1):
                yield conv, turn, role, text, True


def _symbol(role: str, text: str, duplicate: bool) -> tuple[str, str]:
    """The row as a symbol of the search, and its fault."""
    ended = text.rstrip(BLANKS)
    if not ended:
        return "-", "blank"
    if duplicate:
        return "-", "duplicate"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (initial, "") if ended[-1] in ".!?" else (initial.upper(), "truncated")


def _parts(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], bool]]:
    """Runs of at most PART rows, each with whether it is the last."""
    part: list[tuple] = []
    for row in rows:
        if len(part) == PART:
            yield part, False
            part = []
        part.append(row)
    if part:
        yield part, True


class _Fold:
    """Best edits so far per state: cost, place in ASCII order, edits as a chain, digest, turns."""

    def __init__(self):
        self.best = {es.START: (0, 0, None, hashlib.sha256(), 0)}

    def add(self, part: list[tuple], symbols: str, final: bool) -> None:
        found: dict[int, tuple] = {}
        ends = [es.ACCEPTING] if final else [(e,) for e in range(4)]
        for state, (cost, place, *_) in self.best.items():
            for wanted in ends:
                answer = es.remembered(symbols, state, wanted, final)
                if answer:
                    candidate = (cost + answer[0], place, answer[1], state)
                    kept = found.get(wanted[0])
                    found[wanted[0]] = candidate if kept is None else min(kept, candidate)
        order = {key: i for i, key in enumerate(sorted((c[1], c[2]) for c in found.values()))}
        best = {}
        for end, (cost, place, edits, state) in found.items():
            _, _, chain, digest, turns = self.best[state]
            digest = digest.copy()
            for edit, at, said in es.follow(symbols, edits, state):
                if said:
                    role = part[at][2] if edit == "K" else _NAMES[said]
                    text = part[at][3] if edit != "I" else ""
                    digest.update(("\n" * (turns > 0) + f"{role}:{text}").encode())
                    turns += 1
            best[end] = (cost, order[place, edits], (chain, edits), digest, turns)
        self.best = best

    def result(self) -> tuple[int, str, str, int]:
        """Cost, edits, digest and turns of the whole, after its last part."""
        ((cost, _, chain, digest, turns),) = self.best.values()
        edits = []
        while chain:
            chain, part = chain
            edits.append(part)
        return cost, "".join(reversed(edits)), digest.hexdigest(), turns


def _audit(rows: Iterator[tuple]) -> dict:
    """Counts, edits and digest of one conversation, from its rows in order."""
    out = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal"), 0)
    fold, said, least, last, distinct = _Fold(), None, None, None, 0
    for part, final in _parts(rows):
        symbols = ""
        for _, turn, role, text, duplicate in part:
            symbol, fault = _symbol(role, text, duplicate)
            symbols += symbol
            out["rows"] += 1
            if fault:
                out[fault] += 1
            if said is not None and said + role[:1] not in ("su", "ua", "au"):
                out["illegal"] += 1
            said = role[:1]
            if turn is not None and turn != last:
                least, last, distinct = turn if least is None else least, turn, distinct + 1
        fold.add(part, symbols, final)
    out["gaps"] = 0 if last is None else last - least + 1 - distinct
    out["cost"], out["audit"], out["repaired_sha256"], out["turns"] = fold.result()
    return out


def _schema(kind: T.DataType, ddl: str) -> T.StructType:
    schema = T.StructType([T.StructField("conv", kind)])
    for field in T.StructType.fromDDL(ddl):
        schema.add(field)
    return schema


def audits(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id (named ``conv``), gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256, rows and turns (after the repair)."""
    numbers = (*_COUNTS, "rows", "turns")
    schema = _schema(
        rows.schema[conv].dataType, ", ".join(f"{c} long" for c in numbers) + ", audit string, repaired_sha256 string"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        kind = None
        held: list[dict] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([h["conv"] for h in held], kind)]
            columns += [pa.array([h[c] for h in held], pa.int64()) for c in numbers]
            columns += [pa.array([h[c] for h in held], pa.string()) for c in names[-2:]]
            return pa.record_batch(columns, names=names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for key, own in groupby(_rows(typed()), lambda row: row[0]):
            held.append({"conv": key, **_audit(own)})
            if len(held) == 1024:
                yield batch()
                held.clear()
        if held:
            yield batch()

    found = _ordered(rows, conv, turn, role, text).mapInArrow(search, schema)
    return found.withColumnRenamed("conv", conv)


def repaired_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired conversations: id, place (from 0), turn (null where inserted), role, text, edit."""
    ordered = _ordered(rows, conv, turn, role, text)
    schema = T.StructType(
        [
            T.StructField("conv", rows.schema[conv].dataType), T.StructField("place", T.LongType()),
            T.StructField("turn", rows.schema[turn].dataType), T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()), T.StructField("edit", T.StringType()),
        ]
    )
    # The edits of a conversation stand before its rows.
    edits = audits(rows, conv, turn, role, text).select(
        F.col(conv).alias("conv"), F.lit(None).cast(rows.schema[turn].dataType).alias("turn"),
        F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("seen"),
    )
    both = ordered.unionByName(edits).repartition("conv").sortWithinPartitions(
        F.col("conv"), F.col("n") > 0, F.col("turn").asc_nulls_first(), "role", "text"
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        letters: Iterator[str] = iter("")
        conv_now, state, place = None, es.START, 0

        def insertions_then_edit(conv_id) -> str:
            nonlocal state, place
            for edit in letters:
                if edit != "I":
                    return edit
                said, state = es.NEXT[state]
                out.append((conv_id, place, None, _NAMES[said], "", "I"))
                place += 1
            return ""

        for given in batches:
            types = types or [
                given.schema.field(0).type, pa.int64(), given.schema.field(1).type, *[pa.string()] * 3
            ]
            for conv_id, at, who, what, n, _ in zip(*(c.to_pylist() for c in given.columns)):
                if n == 0:
                    insertions_then_edit(conv_now)
                    letters, conv_now, state, place = iter(what), conv_id, es.START, 0
                for _ in range(n):
                    edit = insertions_then_edit(conv_id)
                    if edit == "D":
                        continue
                    if edit == "K" and who[:1] == "s":
                        state = es.SYSTEM
                    else:
                        said, state = es.NEXT[state]
                        who = _NAMES[said] if edit == "R" else who
                    out.append((conv_id, place, at, who, what, edit))
                    place += 1
                if len(out) >= 1024:
                    yield batch()
                    out.clear()
        insertions_then_edit(conv_now)
        if out:
            yield batch()

    return both.mapInArrow(apply, schema).withColumnRenamed("conv", conv)


def audits_after_damage(conversations: DataFrame) -> DataFrame:
    """``audits`` of the damaged rows for every original conv_id; without rows: zeros."""
    found = audits(damaged(conversations)).withColumnRenamed("conv_id", "_found")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA)).alias("repaired_sha256"),
    )
