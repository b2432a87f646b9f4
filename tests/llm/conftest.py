import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHING = ["row", "key", "norm", "hash", "sha", "id", "text_key", "kept", "lines", "shard", "spans", "nth", "at"]


def prose(rng, n):
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, near copies, a very long text."""
    rng = random.Random(5)
    base, other = prose(rng, 120), prose(rng, 200)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base), (2, base.replace(" ", "\n", 3)), (3, " ".join(near)), (4, other), (4, other), (5, other),
        (None, base), (None, "only here"), (None, None), (6, None), (7, ""), (8, " \t\n\x0b "),
        (9, "one two three four"), (10, "ONE two three Four"), (11, "one two three four five"),
        (12, prose(rng, 6000) + " " + "ab" * 4000 + " end"), (13, "a b c " * 60), (14, "€uro ñandú \u0000 x" + "é" * 1500),
        (15, "x <|endoftext|>y z don't 12½ ΑΣ İ"),
    ]
    return [
        (i, t, rng.choice(["en", None]), rng.choice(["src0", "src1", None]), None if t is None else len(t)) for i, t in out
    ]


@pytest.fixture
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3, "doc_id", "text")


@pytest.fixture
def clashing_docs(edge_docs):
    return edge_docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
