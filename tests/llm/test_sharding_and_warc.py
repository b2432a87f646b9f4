"""Shards by bytes and WARC archives, round trips and laws."""

import gzip
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, edge_rows, prose
from tidemark.llm import sharding, warc


def size(text):
    return len((text or "").encode()) + 16


def shard_rows(n=600):
    rng = random.Random(8)
    hot = prose(rng, 40)
    return [(i, hot if i % 3 == 0 else prose(rng, rng.randint(1, 60)), "en", "s", 0) for i in range(n)]


@pytest.mark.parametrize("range_bytes", [1 << 30, 2_000])
def test_shards_are_even_and_whole(spark, range_bytes):
    rows = shard_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.sharded(docs, 8, range_bytes=range_bytes).collect()
    assert Counter(tuple(r.row) for r in got) == Counter(rows)
    total = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == size(r.row.text)
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(total) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / 8
    assert all(abs(t - mean) <= 2 * max(size(r[1]) for r in rows) for t in total.values())
    texts = defaultdict(set)
    for r in got:
        texts[r.row.text].add(r.shard)
    # Equal texts lie in neighbouring shards; only the large group is cut.
    assert all(max(s) - min(s) == len(s) - 1 for s in texts.values())


def test_edge_cases(clashing_docs, no_docs):
    got = sharding.sharded(clashing_docs, 3).collect()
    assert len(got) == len(edge_rows()) and {r.shard for r in got} <= {0, 1, 2}
    assert sharding.sharded(no_docs, 3).count() == 0


def test_keys_sort_as_numbers():
    rng = random.Random(1)
    pairs = [(rng.randint(-(2**63), 2**63 - 1), rng.choice([-(2**63), 0, 256, 2**63 - 1])) for _ in range(500)]
    keys = sharding._as_bytes(*np.array(pairs, np.int64).T)
    assert [pairs[i] for i in np.argsort(keys, kind="stable")] == sorted(pairs)


PAGES = "page_id long, url string, html string, title string"


def page_rows():
    rng = random.Random(6)
    same = prose(rng, 50)
    out = [(i, f"http://h/{i}", prose(rng, rng.randint(0, 300)), "t") for i in range(60)]
    out += [(100 + i, f"http://h/c{i}", same, "t") for i in range(40)]
    out += [(7, "http://h/7", out[7][2], "t"), (99, "http://h/a\r\nX: 1", same, None), (None, None, same, "t")]
    return out + [(200, "u", None, "t"), (201, "u", "", "t"), (None, "u", "é€", None), (300, "u", "x", "t"), (300, "u", "y", "t")]


def want_records(rows, least):
    groups = defaultdict(list)
    for page_id, _, html, _ in rows:
        groups[html or ""].append(page_id)
    out = Counter()
    for html, ids in groups.items():
        data = html.encode()
        first = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            revisit = n > 0 and len(data) >= least
            out[(i, len(data), warc.digest(data), "revisit" if revisit else "response", first if revisit else None)] += 1
    return out


@pytest.mark.parametrize("least", [0, 30])
def test_archives_read_back(spark, tmp_path, least):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    params = warc.WarcParams(shard_bytes=6_000, file_bytes=1_500, min_revisit_bytes=least)
    manifests = []
    for run in ("a", "b"):
        manifest = warc.write_archives(pages.repartition(4 if run == "a" else 7), str(tmp_path / run), params=params)
        manifests.append({tuple(r) for r in manifest.collect()})
    assert manifests[0] == manifests[1] and len(manifests[0]) > 5  # the same files, byte for byte
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    read = Counter(
        (int(r.page_id) if r.page_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None)
        for r in got
    )
    assert read == want_records(rows, least)
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {r[2] or "" for r in rows}
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith(".pages")]


def test_files_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    name = warc.write_archives(pages, str(tmp_path / "w")).first().file
    with gzip.open(tmp_path / "w" / name) as stream:
        found = [(f["warc-type"], len(b)) for f, b in warc.records(stream)]
    assert found[0][0] == "warcinfo" and len(found) > 50


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    assert warc.write_archives(empty, str(tmp_path / "e")).count() == 0
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_sharding_query(spark):
    import zlib

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = entry.queries()["op4_sharding"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r["size"] == size(docs[r.doc_id]) for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
