"""The entry point works without the optional part, or without a module only that part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
print(len(entry.queries()), sum(q.startswith("op") or q == "pipeline" for q in entry.queries()))
"""


def run(missing):
    code = SCRIPT.format(root=ROOT, missing=missing)
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("missing", ["corpus_pipeline", "tidemark.llm", "public_tokenizers", "zstandard"])
def test_without_an_optional_module(missing):
    done = run(missing)
    assert done.returncode == 0, done.stderr
    total, optional = map(int, done.stdout.split())
    assert total > 150 and optional == 0


def test_a_module_of_the_rest_is_needed():
    assert run("tidemark.plans").returncode != 0
