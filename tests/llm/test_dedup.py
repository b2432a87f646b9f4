"""Exact and near deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, edge_rows, prose
from tidemark.llm import exact_dedup, near_dedup
from tidemark.llm.components import connected_components


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def want_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            kept = i == keep and first
            first = first and not kept
            out[(i, keep, len(ids), kept, sha)] += 1
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(edge_docs, weak):
    hash_ = (lambda text: F.lit(b"same")) if weak else exact_dedup.md5_128
    got = exact_dedup.exact_duplicates(edge_docs, content_hash=hash_)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == want_exact(edge_rows())


def test_exact_dedup_keeps_columns(clashing_docs):
    got = exact_dedup.drop_exact_duplicates(clashing_docs)
    assert got.columns == clashing_docs.columns
    want = Counter(r[0] for r in want_exact(edge_rows()).elements() if r[3])
    assert Counter(r[0] for r in got.collect()) == want


def test_no_documents(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert near_dedup.drop_near_duplicates(no_docs).count() == 0


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def want_near(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter(
        (r[0], len(s), c, r[0] == c)
        for i, (r, s) in enumerate(zip(rows, sets))
        for c in [least[root(i)] if s else r[0]]
    )


def test_near_duplicates_of_edge_cases(edge_docs):
    got = near_dedup.near_duplicates(edge_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == want_near(edge_rows())


def near_group(seed, copies, edits):
    """One large group: copies of a text with more and more words changed."""
    rng = random.Random(seed)
    base = prose(rng, 150).split()
    out = []
    for i in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append((i, " ".join(words), "en", "src0", 0))
    return out + [(copies + i, prose(rng, 60), "en", "src1", 0) for i in range(20)]


def test_large_near_group_loses_no_link(spark):
    rows = near_group(3, 120, 14)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    want = want_near(rows)
    assert len({r[2] for r in want}) > 40  # some copies are too far off
    assert Counter(map(tuple, got.collect())) == want


def test_one_of_each_near_group_stays(clashing_docs):
    got = near_dedup.drop_near_duplicates(clashing_docs)
    assert got.columns == clashing_docs.columns
    ids = Counter(r[0] for r in got.collect())
    assert ids == Counter({None: 2, 1: 1, 4: 1, **{i: 1 for i in (6, 7, 8, 9, 11, 12, 13, 14, 15)}})


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    label = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = connected_components(spark.createDataFrame(links, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == label
    assert got.count() == len(label)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
