"""Quality rules against a plain version."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, edge_rows, prose
from tidemark.llm.quality_rules import LineLimits, apply_quality_rules, quality_verdicts

LIMITS = LineLimits(share=0.2, min_docs=3)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def line_rows():
    """Two hosts with menu lines; one document consists mostly of them, one is repeated."""
    rng = random.Random(9)
    menus = [f"Home 12 | {k} | " + prose(rng, 28) for k in "abc"]
    out = []
    for i in range(30):
        lines = [prose(rng, 45) for _ in range(3)]
        if i % 2:
            lines[1:1] = [m.replace("12", str(i)) for m in menus]
        out.append((100 + i, "\n".join(lines), "en", "a" if i < 20 else None, 1))
    out.append((200, "\n".join([menus[0], menus[1].upper().replace("12", "7"), " " + menus[2], prose(rng, 6)]), "en", "a", 1))
    return [*out, out[0], *edge_rows()]


def normal(line):
    return re.sub("[0-9]+", "0", line.lower()).strip(BLANKS)


def want(rows, limits):
    hosts, held = {}, {}
    for _, text, _, host, _ in rows:
        hosts.setdefault(host, set()).add(text)
        for line in set(map(normal, (text or "").split("\n"))) - {""}:
            held.setdefault((host, line), set()).add(text)
    frequent = {
        k for k, v in held.items() if len(v) > limits.min_docs and len(v) > limits.share * len(hosts[k[0]])
    }
    out = []
    for doc_id, text, _, host, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        lost = sum(len(WORD.findall(x)) for x in lines if (host, normal(x)) in frequent)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append(
            (
                doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                len(lines) - len(set(lines)), len(covered), failed, not failed and 2 * lost <= len(words), lost,
            )
        )
    return out, frequent


def test_verdicts(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = quality_verdicts(docs, limits=LIMITS)
    expected, frequent = want(rows, LIMITS)
    assert len(frequent) >= 2 and any(r[8] and r[7] for r in expected)
    assert any(not r[6] and not r[7] for r in expected)  # rejected by its lines alone
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_filter_removes_lines_and_documents(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "key", "removed", "kept")})
    got = apply_quality_rules(docs, limits=LIMITS)
    assert got.columns == docs.columns
    expected, frequent = want(rows, LIMITS)
    stay = Counter(
        (r[0], "\n".join(x for x in r[1].split("\n") if (r[3], normal(x)) not in frequent))
        for r, v in zip(rows, expected)
        if v[7]
    )
    assert Counter((r.doc_id, r.text) for r in got.collect()) == stay


def test_no_documents(no_docs):
    assert quality_verdicts(no_docs).count() == 0
    assert apply_quality_rules(no_docs).columns == no_docs.columns
