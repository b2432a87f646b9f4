"""Token counts, encoding and packing against the public library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import edge_rows
from tidemark.llm import bpe, bpe_codec, packing, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts(edge_docs, library):
    got = Counter(map(tuple, token_counts.token_counts(edge_docs, PATH, limit=100).collect()))
    want = Counter()
    for doc_id, text, *_ in edge_rows():
        n = len(ids_of(library, text))
        want[(doc_id, len((text or "").encode()), n, n > 100)] += 1
    assert got == want


def test_codec(clashing_docs, library):
    coded = bpe_codec.decode(bpe_codec.encode(clashing_docs, PATH, leaf=64), PATH)
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in coded.collect())
    want = Counter()
    for doc_id, text, *_ in edge_rows():
        ids = ids_of(library, text)
        want[(doc_id, bpe_codec.to_bytes(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


@pytest.mark.parametrize("letters", ["ab", "a", "the", "thernoings", "abcdefghijklmnopqrstuvwxyz"])
def test_joined_leaves_equal_whole_encoding(library, letters):
    vocab, rng = bpe.vocabulary(PATH), random.Random(letters)
    symbols = bpe_codec.Symbols(vocab)
    for n in (2, 30, 400, 2500):
        text = "".join(rng.choice(letters) for _ in range(n))
        first = vocab.symbols(vocab.pre_tokens(text)[0])
        for leaf in (1, 3, 50, 700):
            leaves = [bpe_codec.merged(vocab, first[i : i + leaf]) for i in range(0, len(first), leaf)]
            assert bpe_codec.join_tree(vocab, symbols, leaves) == ids_of(library, text)


def test_byte_characters_cover_all_bytes():
    assert len(set(bpe.byte_characters())) == 256


def brute_fill(counts, capacity):
    longest = max(counts)
    sums = {longest}
    for length, n in counts.items():
        for _ in range(n - (length == longest)):
            sums |= {s + length for s in sums if s + length <= capacity}
    return max(sums)


def test_window_is_the_fullest_possible():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        counts = {rng.randint(1, capacity): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        window = packing.fill_window(counts, capacity)
        assert all(n <= counts[x] for x, n in window.items()) and max(counts) in window
        assert sum(x * n for x, n in window.items()) == brute_fill(counts, capacity)


@pytest.mark.parametrize(
    "histogram", [{}, {1: 3}, {37: 1000}, {64: 5, 3: 1}, {i: i % 7 for i in range(1, 65)}, {33: 400, 20: 3, 64: 1}]
)
def test_plan_uses_every_token_once(histogram):
    plan = packing.plan_windows(histogram, 64)
    windows = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            parts = plan.place(length, rank)
            assert sum(p[1] for p in parts) == length
            for start, size, sequence, offset in parts:
                windows[sequence].append((offset, size))
    total = sum(k * n for k, n in histogram.items())
    assert sorted(windows) == list(range(plan.sequences)) and plan.sequences == -(-total // 64)
    for parts in windows.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 64


def check_packed(rows, docs, library, capacity):
    """Pieces cover every token once and fill gapless windows."""
    wanted = Counter()
    for doc_id, text in docs:
        ids = np.asarray([*ids_of(library, text), packing.END_ID], "<u4").tobytes()
        wanted[(doc_id, ids)] += 1
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens, r.start)].append(bytes(r.ids))
        assert len(r.ids) == 4 * r.length
        windows[r.sequence_id].append((r.offset, r.length))
    total = sum(len(ids) // 4 * n for (_, ids), n in wanted.items())
    assert sum(len(p) // 4 for v in pieces.values() for p in v) == total
    for parts in windows.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= capacity
    assert sorted(windows) == list(range(-(-total // capacity)))
    for (doc_id, ids), n in wanted.items():
        if n == 1 and doc_id is not None:
            own = sorted((start, data) for (i, _, start), all_ in pieces.items() if i == doc_id for data in all_)
            assert b"".join(data for _, data in own) == ids


def test_packing(clashing_docs, library):
    rows = packing.pack(clashing_docs, PATH, capacity=128).collect()
    check_packed(rows, [(r[0], r[1]) for r in edge_rows()], library, 128)


def test_ids_of_distinct_words_equal_the_library(library, monkeypatch):
    rng = random.Random(8)
    letters = "aZ éß\n\t$_1'sıİſ日\u0301" + "".join(map(chr, range(33)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    special = next(iter(bpe.vocabulary(PATH).special))
    texts += ["", " ", f"a{special}b {special.upper()} it's IT'S", "don't " * 300, "x" * 5000, texts[0]]
    ids, until = packing.text_ids(pa.array(texts), PATH, packing.END_ID)
    got = [part.tolist() for part in np.split(ids, until[:-1])]
    assert got == [[*ids_of(library, t), packing.END_ID] for t in texts]
    monkeypatch.setattr(packing, "_SLICE_BYTES", 100)
    cut = list(packing.slices(pa.array(texts)))
    assert len(cut) > 100 and [i for first, n in cut for i in range(first, first + n)] == list(range(len(texts)))
    assert all(n == 1 or sum(len(t.encode()) for t in texts[first : first + n]) <= 100 for first, n in cut)


def test_a_word_is_worked_out_once(monkeypatch):
    seen = []
    word_ids = packing.word_ids
    monkeypatch.setattr(packing, "word_ids", lambda words, path: seen.append(words) or word_ids(words, path))
    packing.text_ids(pa.array(["one two one", "two  one"]), PATH, packing.END_ID)
    assert [sorted(words) for words in seen] == [[b"one", b"two"]]


def test_no_documents(no_docs):
    assert token_counts.token_counts(no_docs, PATH).count() == 0
    assert bpe_codec.encode(no_docs, PATH).count() == 0
    assert packing.pack(no_docs, PATH).count() == 0


SF = "/root/testdata/sf0.001"


def test_queries_equal_the_library(spark, library):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: ids_of(library, r.text) for r in docs}
    counts = entry.queries()["op5_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {k: len(v) for k, v in ids.items()}
    for r in entry.queries()["op9_bpe_codec"](spark, SF).collect():
        data, text = bpe_codec.to_bytes(ids[r.doc_id]), library.decode(ids[r.doc_id], skip_special_tokens=False)
        assert (r.ids_sha256, r.n_tokens) == (hashlib.sha256(data).hexdigest(), len(ids[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    packed = entry.queries()["op8_packing"](spark, SF)
    assert packed.groupBy("doc_id", "start").count().where(F.col("count") > 1).count() == 0
    tokens = 0
    for r in packed.collect():
        part = [*ids[r.doc_id], packing.END_ID][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(bpe_codec.to_bytes(part)) == r.ids_crc32
        tokens += r.length
    assert tokens == sum(len(v) + 1 for v in ids.values())
