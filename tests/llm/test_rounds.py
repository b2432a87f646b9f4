"""Rounds of the components and what the driver holds for near duplicates."""

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import components, near_dedup


@pytest.fixture
def stored(monkeypatch):
    names = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: names.append(name) or f(df, name))
    return names


def test_no_round_after_the_components_are_there(spark, stored):
    def run(links):
        stored.clear()
        got = components.connected_components(spark.createDataFrame(links, "u long, v long"))
        return {r.node: r.component for r in got.collect()}, stored.count("stars")

    assert run([(5, 1), (2, 1), (1, 3), (9, 8), (7, 7)]) == ({1: 1, 2: 1, 3: 1, 5: 1, 8: 8, 9: 8}, 0)
    assert run([(1, 3), (2, 3), (9, 8)]) == ({1: 1, 2: 1, 3: 1, 8: 8, 9: 8}, 1)
    got, rounds = run([(i, i + 1) for i in range(40)])
    assert set(got.values()) == {0} and len(got) == 41 and rounds > 1


def test_frequencies_are_one_byte_a_counter(spark):
    import random

    rng = random.Random(31)
    common, rare = prose(rng, 30), prose(rng, 30)
    texts = spark.createDataFrame([(common,)] * 50 + [(rare,)] * 2, "text string")
    levels = near_dedup._frequencies(texts, 1 << 12)
    slots = [near_dedup._slot(near_dedup.shingles.shingle_set(t.encode()), 1 << 12) for t in (rare, common)]
    assert levels.dtype == np.uint8 and levels.nbytes == 1 << 12
    assert 0 < levels[slots[0]].min() < levels[slots[1]].min()
