"""op11: scores against a plain context tree that mixes bit by bit with dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import context_tree as ct
from tidemark.llm import lm_scoring


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Plain:
    """Context-tree weighting by recursion over all contexts of the training texts."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        for text in texts:
            for context, symbol in self.symbols(text):
                for h, bit in self.bits(symbol):
                    for d in range(depth + 1):
                        self.counts.setdefault((context[depth - d:], h), [0, 0])[bit] += 1
        self.children = {}
        for context, h in self.counts:
            if context:
                self.children.setdefault((context[1:], h), []).append((context, h))
        self.weights = {}

    def symbols(self, text):
        line = b"\xff" * self.depth + text + b"\xff"
        return [(line[i - self.depth:i], line[i]) for i in range(self.depth, len(line))]

    @staticmethod
    def bits(symbol):
        return [((1 << k) | (symbol >> (8 - k)), symbol >> (7 - k) & 1) for k in range(8)]

    def weight(self, node):
        if node not in self.weights:
            own = log_kt(*self.counts[node])
            if len(node[0]) < self.depth:
                below = sum(self.weight(c) for c in self.children[node])
                own = np.logaddexp(own, below) + math.log(0.5)
            self.weights[node] = own
        return self.weights[node]

    def bit(self, context, h, bit, d=0):
        node = (context[self.depth - d:], h)
        if node not in self.counts:
            return 0.5
        seen = self.counts[node]
        kt = (seen[bit] + 0.5) / (sum(seen) + 1)
        if d == self.depth:
            return kt
        share = 0.5 * math.exp(log_kt(*seen) - self.weight(node))
        return share * kt + (1 - share) * self.bit(context, h, bit, d + 1)

    def log10(self, text):
        return sum(math.log10(self.bit(c, h, b)) for c, s in self.symbols(text) for h, b in self.bits(s))


def normal(text):
    return b" ".join((text or "").encode().lower().split())


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def expected(rows, depth):
    texts = [(i, normal(t)) for i, t in rows]
    training = [t for i, t in texts if not held_out(i)]
    tree = Plain(training, depth)
    words = Counter(w for t in training for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in texts:
        tokens = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((i, held_out(i), len(tokens), sum(words[w] > 0 for w in tokens), n, base, tree.log10(t), len(t)))
    return out


def order(row):
    return (row[0] is not None, row[0], row[7], row[6])


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:5] == b[:5] and a[7] == b[7]
        assert a[5] == pytest.approx(b[5], rel=1e-12) and a[6] == pytest.approx(b[6], rel=1e-9)


def rows_of(df):
    return [tuple(r)[:8] for r in df.collect()]


@pytest.mark.parametrize("depth, chunk_bytes", [(2, 1 << 20), (6, 700), (4, 40000)])
def test_equals_the_plain_tree(spark, edge_docs, depth, chunk_bytes):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = lm_scoring.scores(edge_docs, depth=depth, chunk_bytes=chunk_bytes)
    same(rows_of(got), expected(rows, depth))


def test_pieces_of_a_chunk_are_joined(spark, edge_docs, monkeypatch):
    """A chunk whose rows two tasks read gives the same scores."""
    real = lm_scoring.written

    def scattered(df, name):
        out = real(df, name)
        return out.repartition(7) if name == "lm-chunks" else out

    monkeypatch.setattr(lm_scoring, "written", scattered)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    same(rows_of(lm_scoring.scores(edge_docs, depth=3)), expected(rows, 3))


def test_clashing_names_and_other_ids(spark, clashing_docs):
    named = clashing_docs.drop("norm").withColumn("chunk", clashing_docs.doc_id).withColumnRenamed("doc_id", "norm")
    rows = [(r.norm, r.text) for r in named.collect()]
    got = lm_scoring.scores(named, id_col="norm", depth=2)
    assert got.columns[0] == "norm"
    same(rows_of(got), expected(rows, 2))


def test_no_rows_and_no_training_rows(spark, no_docs):
    assert lm_scoring.scores(no_docs).count() == 0
    number = next(i for i in range(100) if held_out(i))
    only = spark.createDataFrame([(number, "a b")], "doc_id long, text string")
    (row,) = rows_of(lm_scoring.scores(only))
    assert row[:6] == (number, True, 3, 0, 0, 0.0)
    assert row[6] == pytest.approx(4 * 8 * math.log10(0.5))


def test_the_probabilities_behind_a_context_add_up_to_one():
    grams, n = np.unique(ct.text_grams([b"abracadabra", b"abba"], 3)[0], return_counts=True)
    tree = ct.levels(grams, n, 3)
    for context in {int(g) >> 8 for g in grams} | {0x010203}:
        every = np.array([context << 8 | s for s in range(256)])
        assert np.exp2(ct.log2_probabilities(every, tree)).sum() == pytest.approx(1.0)


def test_log_gamma():
    x = np.array([0.5, 1.0, 7.5, 8191.5, 8192.0, 1e6 + 0.5, 1e9])
    assert ct.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-14)


def test_held_out_texts_score_better_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm_scoring.scores(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert row.s > row.b
