"""Quality rules from the frequency of lines across the documents of a host.

Method: lines are normalised (lower case, digit runs as one 0, trimmed) and hashed; per
host the distinct documents that hold a line are counted (equal texts of a host are one
document); a line above the limit ``max(min_docs, share * documents of the host)`` is
removed; a document that loses more than half of its words this way is rejected.

The text is read once. What the rules need (counts and one hash and word count per
line) goes to a table in the shared folder; lines are deduplicated per text before they
are counted, and both counts combine in the map tasks, so a line or host that a third of
all rows share never meets in one task. All of it is built-in functions.

Defined results: a null text has no words and fails the base rule; a null host is a host
of its own; repeated rows are separate rows with equal verdicts; an empty table gives an
empty table; further columns, also with names used here, pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK_RUN, BLANKS, packed, text_key, whole_text, written

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate when more documents of its host hold it than both limits."""

    share: float = 0.10
    min_docs: int = 8
    max_lost_percent: int = 50


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )


def _repeated(windows: DataFrame) -> DataFrame:
    """``n_repeat_words``: words covered by windows that occur twice or more in a text.

    Each hash gives its low bits to its position, so that one sort of plain longs brings
    equal windows together; neighbours are then compared by their whole hashes.
    """
    packed_order = (
        "array_sort(transform(_windows, (h, i) -> "
        "shiftleft(shiftright(h, _bits), _bits) | cast(i as bigint)))"
    )
    like = (
        "shiftright(x, _bits) = shiftright(get(_order, {0}), _bits) and "
        "get(_windows, cast(x & _mask as int)) = get(_windows, cast(get(_order, {0}) & _mask as int))"
    )
    covered = (
        f"filter(_order, (x, j) -> (j > 0 and {like.format('j - 1')}) or ({like.format('j + 1')}))"
    )
    return (
        windows.withColumn("_bits", F.length(F.bin("_n")))
        .withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
        .withColumn("_order", F.expr(packed_order))
        .withColumn("_covered", F.expr(f"array_sort(transform({covered}, x -> x & _mask))"))
        .withColumn(
            "n_repeat_words",
            F.expr(
                "aggregate(_covered, struct(0L as n, -3L as last), (a, p) -> "
                "struct(a.n + least(3L, p - a.last) as n, p as last), a -> a.n)"
            ),
        )
    )


def line_table(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per input row: base measures, and hash and words of every line with words."""
    text = F.col("_text")
    lowered = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    windows = (
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("-")).alias("host"),
            text_key(F.col(host_col).cast("string"), F.col(text_col)).alias("key"),
            whole_text(F.col(text_col)).alias("_text"),
        )
        .select(
            "id",
            "host",
            "key",
            _words(text).alias("_words"),
            F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("_lines"),
            F.filter(
                F.transform(F.split(lowered, "\n"), lambda line: F.btrim(line, F.lit(BLANKS))),
                lambda line: line != "",
            ).alias("_normal"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        )
        .select(
            "id",
            "host",
            "key",
            "n_symbols",
            F.expr("aggregate(_words, 0L, (a, x) -> a + length(x))").alias("word_chars"),
            F.size("_words").cast("long").alias("n_words"),
            F.size("_words").alias("_n"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.expr(
                "case when size(_words) < 3 then cast(array() as array<bigint>) else "
                "transform(sequence(0, size(_words) - 3), i -> "
                "xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) end"
            ).alias("_windows"),
            F.transform(
                "_normal",
                lambda line: F.struct(
                    F.xxhash64(line).alias("h"), F.size(F.split(line, BLANK_RUN)).alias("w")
                ),
            ).alias("lines"),
        )
    )
    return _repeated(windows).select(
        F.monotonically_increasing_id().alias("uid"),
        "id",
        "host",
        "key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "lines",
    )


def frequent_lines(lines: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, h) of the lines above the limits, from the rows of :func:`line_table`."""
    texts = lines.select("host", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return (
        lines.select(
            "host", "key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")
        )
        .distinct()
        .groupBy("host", "h")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") > limits.min_docs)
        .join(texts, "host")
        .where(F.col("held") > F.col("docs") * limits.share)
        .select("host", "h")
    )


def line_verdicts(lines: DataFrame, limits: LineLimits) -> DataFrame:
    """``lines`` with removed (hashes of its frequent lines), lost_words and the verdict."""
    hits = (
        lines.select("uid", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .join(frequent_lines(lines, limits), ["host", "h"])
        .groupBy("uid")
        .agg(F.collect_set("h").alias("removed"))
    )
    lost = F.expr(
        "aggregate(filter(lines, x -> array_contains(removed, x.h)), 0L, (a, x) -> a + x.w)"
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        lines.join(hits, "uid", "left")
        .withColumn("lost_words", F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(lost))
        .withColumn("base_failed", base_failed)
        .withColumn(
            "kept",
            ~base_failed & (100 * F.col("lost_words") <= limits.max_lost_percent * F.col("n_words")),
        )
    )


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    limits: LineLimits = LineLimits(),
) -> DataFrame:
    """One row per input row: the id, the base measures, lost_words, base_failed, kept."""
    lines = written(line_table(docs, id_col, text_col, host_col), "quality-lines")
    return line_verdicts(lines, limits).select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lost_words",
    )


def apply_quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    limits: LineLimits = LineLimits(),
) -> DataFrame:
    """The documents that pass, without their frequent lines; other columns unchanged."""
    lines = written(line_table(docs, id_col, text_col, host_col), "quality-lines")
    verdicts = line_verdicts(lines, limits)
    # Equal text on an equal host has an equal verdict: one row per key decides.
    changed = (
        verdicts.where(~F.col("kept") | F.col("removed").isNotNull())
        .select("key", "kept", "removed")
        .dropDuplicates(["key"])
    )
    text = F.col("row").getField(text_col)
    cleaned = F.array_join(
        F.filter(
            F.split(text, "\n"),
            lambda line: ~F.array_contains(
                F.col("removed"),
                F.xxhash64(F.btrim(F.regexp_replace(F.lower(line), "[0-9]+", "0"), F.lit(BLANKS))),
            ),
        ),
        "\n",
    )
    return (
        packed(docs, text_key(F.col(host_col).cast("string"), F.col(text_col)).alias("key"))
        .join(changed, "key", "left")
        .where(F.coalesce(F.col("kept"), F.lit(True)))
        .select(
            F.when(F.col("removed").isNull(), F.col("row"))
            .otherwise(F.col("row").withField(f"`{text_col}`", cleaned))
            .alias("row")
        )
        .select("row.*")
    )
