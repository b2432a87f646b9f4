"""Secret scan: candidates by pattern, false positives removed by a random forest.

Method: candidates are blank-free runs of key-like characters, private key blocks, web
tokens, and whatever a name such as token or password is set to. A random forest on
its length, character transitions, dictionary coverage, path and neighbouring words,
trained from labelled findings, decides which candidates are secrets; those of a known
format always are.

The dictionary is a top-k report: the most frequent words over all texts. The forest is
fitted on a bounded sample of labelled findings (``sample``): distinct pairs of value and
label, up to half of them of each label, those with the least hash, with their counts as
weights;
counting, candidate search and classification cover every row and whole texts. The
dictionary (``dictionary`` words of at most 24 bytes) and the forest are the only things
sent to all tasks.

Defined results: a null or empty text has no findings; null and repeated ids give their
own findings; a null path is the empty path; without negative labelled findings nothing
can be told false, so every candidate stays with a score of 1; with negative ones only,
the candidates that :func:`known_format` confirms stay, with a score of 1, and the others
have 0; an empty table gives an empty table. Findings carry the id; masking passes further columns through untouched.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, text_key, whole_text, written

CANDIDATE = re.compile(
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]|-(?!-))*-----END [A-Z0-9 ]*PRIVATE KEY-----"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*"
    r"|[A-Za-z0-9+/_\-]{16,}={0,2}"
)
# A name that a secret is set to, up to the value.
SECRET_NAME = (
    r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key)"
    r"[A-Za-z0-9_\-]{0,24}[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}"
)
ASSIGNED = re.compile(SECRET_NAME + r"(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"',;]{6,}))")
# Forms of issued keys, whole values.
ISSUED = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|sk-[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*)$"
    r"|^-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
)
MASK = "[SECRET]"
_VOWELS = frozenset("aeiouy")
_PATH_SLOTS = 8
_WORD_SLOTS = 32


@dataclass(frozen=True)
class ScanParams:
    dictionary: int = 20_000
    sample: int = 20_000
    trees: int = 40
    depth: int = 8
    threshold: float = 0.5
    seed: int = 7


def frequent_words(docs: DataFrame, text_col: str, top: int) -> list[str]:
    """The ``top`` most frequent words of 3 letters or more, ties in alphabetical order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch(
                {
                    "word": pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                    "n": pa.array(words.values(), pa.int64()),
                }
            )

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words.update(text.lower().split())
                if len(words) > 300_000:
                    yield rows()
                    words.clear()
        yield rows()

    counted = docs.select(whole_text(F.col(text_col)).alias("text")).mapInArrow(count, "word string, n long")
    clean = F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "")
    return [
        r.word
        for r in counted.withColumn("word", clean)
        .where(F.col("word").rlike(r"^\p{L}{3,24}$") & (F.octet_length("word") <= 24))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(top)
        .collect()
    ]


def coverage(text: str, words: frozenset[str], longest: int) -> float:
    """Largest share of the characters of ``text`` that words can cover side by side."""
    text = text.lower()
    best = [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        most = best[end - 1]
        for size in range(3, min(longest, end) + 1):
            if best[end - size] + size > most and text[end - size : end] in words:
                most = best[end - size] + size
        best[end] = most
    return best[-1] / len(text)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode()) % slots


def features(
    text: str, start: int, end: int, path: str, words: frozenset[str], longest: int
) -> list[float]:
    """Feature row of the candidate ``text[start:end]``."""
    value = text[start:end]
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    letters = [c.lower() in _VOWELS for c in value if c.isalpha()]
    out = [
        float(n),
        *(kinds.count(k) / n for k in range(4)),
        # Character transitions: between kinds, between vowels and other letters.
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a != b for a, b in zip(letters, letters[1:])) / max(1, len(letters)),
        len(counts) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        coverage(value, words, longest),
    ]
    before = text[max(0, start - 48) : start]
    after = text[end : end + 48]
    slots = [0.0] * (_PATH_SLOTS + 2 * _WORD_SLOTS)
    for part in re.findall(r"\w+", path.lower()):
        slots[_slot(part, _PATH_SLOTS)] = 1.0
    # The nearest two words on each side, with what stands between them and the value.
    for part in re.findall(r"\w+|[^\w\s]+", before.lower())[-3:]:
        slots[_PATH_SLOTS + _slot(part, _WORD_SLOTS)] = 1.0
    for part in re.findall(r"\w+|[^\w\s]+", after.lower())[:2]:
        slots[_PATH_SLOTS + _WORD_SLOTS + _slot(part, _WORD_SLOTS)] = 1.0
    return out + slots


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidates in order; overlapping ones are one."""
    hits = [hit.span() for hit in CANDIDATE.finditer(text)]
    for hit in ASSIGNED.finditer(text):
        start, end = hit.span(hit.lastindex)
        if hit.lastindex == 3:
            end = start + len(text[start:end].rstrip(".)]}>"))
        if end > start:
            hits.append((start, end))
    out: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def candidates(
    docs: DataFrame, words: list[str], id_col: str, text_col: str, path_col: str
) -> DataFrame:
    """One row per candidate: id, key of the row, start, length, value, context, features."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        _row_key(id_col, text_col, path_col).alias("key"),
        whole_text(F.col(path_col)).alias("path"),
        whole_text(F.col(text_col)).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    known, longest = frozenset(words), max(map(len, words), default=0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for i, (path, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for start, end in spans(text):
                    context = text[max(0, start - 64) : start]
                    found.append((start, end - start, text[start:end], context, features(text, start, end, path, known, longest)))
                    of.append(i)
            columns = list(zip(*found)) or [()] * 5
            at = pa.array(of, pa.int64())
            yield pa.record_batch(
                {
                    "id": batch.column(0).take(at),
                    "key": batch.column(1).take(at),
                    "start": pa.array(columns[0], pa.int64()),
                    "length": pa.array(columns[1], pa.int64()),
                    "value": pa.array(columns[2], pa.string()),
                    "before": pa.array(columns[3], pa.string()),
                    "features": pa.array(columns[4], pa.list_(pa.float64())),
                }
            )

    return rows.mapInArrow(
        scan,
        f"id {kind}, key binary, start long, length long, value string, before string, features array<double>",
    )


def _row_key(id_col: str, text_col: str, path_col: str) -> Column:
    return text_key(*(F.col(c).cast("string") for c in (id_col, text_col, path_col)))


def training_rows(labelled: DataFrame, params: ScanParams) -> DataFrame:
    """Distinct (value, label) with one feature row and their count n, at most half the sample of each label."""
    distinct = labelled.groupBy("value", "label").agg(F.min("features").alias("features"), F.count(F.lit(1)).alias("n"))
    parts = [
        distinct.where(F.col("label") == label).orderBy(F.xxhash64("value"), "value").limit(params.sample // 2)
        for label in (0, 1)
    ]
    return parts[0].union(parts[1])


def train(labelled: DataFrame, params: ScanParams) -> RandomForestClassificationModel | int | None:
    """Forest from labelled findings (value, features, label 0/1); the label where all have one, None without any."""
    bounded = written(training_rows(labelled, params), "labelled-findings")
    labels = [r.label for r in bounded.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else None
    forest = RandomForestClassifier(
        numTrees=params.trees, maxDepth=params.depth, seed=params.seed, featuresCol="vector", labelCol="label", weightCol="n"
    )
    return forest.fit(
        bounded.select(array_to_vector("features").alias("vector"), F.col("label").cast("double"), F.col("n").cast("double"))
    )


def classified(found: DataFrame, model: RandomForestClassificationModel | int | None, params: ScanParams) -> DataFrame:
    """``found`` with score and is_secret."""
    if model is None or model == 1:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    confirmed = known_format(F.col("value"), F.col("before"))
    if model == 0:
        return found.withColumn("score", confirmed.cast("double")).withColumn("is_secret", confirmed)
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    return (
        scored.withColumn("score", F.when(confirmed, F.lit(1.0)).otherwise(vector_to_array("probability")[1]))
        .withColumn("is_secret", F.col("score") >= params.threshold)
        .drop("vector", "rawPrediction", "probability", "prediction")
    )


def known_format(value: Column, before: Column) -> Column:
    """Annotation rule: the value has a form that only issued keys and set passwords have.

    An issued key by its fixed prefix, a web token, a private key block, or a value without
    blanks that a name such as token or password is set to: any in quotes, others with a
    digit; references to variables and calls are none.
    """
    assigned = before.rlike(SECRET_NAME + r"[\"']?$") & ~value.rlike(_REFERENCE) & ~value.rlike(r"\s")
    return value.rlike(ISSUED) | (assigned & (before.rlike(r"[\"']$") | value.rlike("[0-9]")))


_REFERENCE = r"[(<{\[]|^\$|^%|(?i)^(?:os\.|process\.|self\.|none$|null$|true$|false$|undefined$)"


def known_harmless(value: Column, before: Column) -> Column:
    """Annotation rule: letters or digits only, or a hash by its name; and set to no secret name."""
    named = before.rlike(r"(?i)(?:commit|revision|sha-?[0-9]*|md5|checksum|digest|etag|uuid|integrity)[\"']?\s*[:=]?\s*[\"']?$")
    plain = value.rlike(r"^(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)$") | value.rlike(r"^[A-Za-z]+(?:[/_\-]+[A-Za-z]+)*[/_\-]*$")
    return (named | plain) & ~before.rlike(SECRET_NAME + r"[\"']?$")


def annotated(found: DataFrame, labelled_ids: DataFrame) -> DataFrame:
    """Findings in the reviewed documents (``id``), labelled by the two rules; unclear ones are left out."""
    value, before = F.col("value"), F.col("before")
    label = F.when(known_format(value, before), 1).when(known_harmless(value, before), 0)
    return found.join(labelled_ids, "id", "left_semi").withColumn("label", label).where("label IS NOT NULL")


def scan(
    docs: DataFrame,
    labelled_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    params: ScanParams = ScanParams(),
) -> DataFrame:
    """All candidates with key, score and is_secret; labels come from ``labelled_ids`` (id)."""
    words = frequent_words(docs, text_col, params.dictionary)
    found = written(candidates(docs, words, id_col, text_col, path_col), "secret-candidates")
    return classified(found, train(annotated(found, labelled_ids), params), params)


def mask_secrets(
    docs: DataFrame,
    labelled_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    params: ScanParams = ScanParams(),
) -> DataFrame:
    """``docs`` with every secret in the text replaced by a mask; all rows and columns stay."""
    spans = (
        scan(docs, labelled_ids, id_col, text_col, path_col, params)
        .where("is_secret")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "length")), asc=False).alias("spans"))
    )
    # From the last span to the first, so that earlier places stay where they are.
    masked = F.aggregate(
        "spans",
        F.col("row").getField(text_col),
        lambda text, span: F.concat(
            F.substring(text, F.lit(1), span["start"].cast("int")),
            F.lit(MASK),
            F.substring(text, (span["start"] + span["length"] + 1).cast("int"), F.length(text)),
        ),
    )
    return (
        packed(docs, _row_key(id_col, text_col, path_col).alias("key"))
        .join(spans, "key", "left")
        .select(
            F.when(F.col("spans").isNull(), F.col("row"))
            .otherwise(F.col("row").withField(f"`{text_col}`", masked))
            .alias("row")
        )
        .select("row.*")
    )
