"""op12: every conversation against a cheapest-first search over whole strings of edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import edit_search, turn_repair

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(live, begin="", accept=re.compile(r"(s?(ua)+)?\Z").match):
    """Least (cost, edits) over strings of edits; ``live``: (initial, must go, truncated) per row."""
    heap, done = [(0, "", 0, begin)], set()
    while heap:
        cost, edits, at, said = heapq.heappop(heap)
        # Beyond the last two initials and whether it began with s, the past does not matter.
        short = (at, said[:1] == "s", said[-1:], len(said) % 2, said == "")
        if short in done:
            continue
        done.add(short)
        if at == len(live) and accept(said):
            return cost, edits, said
        for edit, more, to, new in options(live, at, said):
            if re.fullmatch(r"(s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + more, edits + edit, to, new))
    raise AssertionError


def options(live, at, said):
    yield from (("I", 2, at, said + c) for c in "ua")
    if at < len(live):
        initial, must_go, truncated = live[at]
        yield "D", 3, at + 1, said
        if not must_go:
            yield "K", truncated, at + 1, said + (initial or "?")
            yield from (("R", 2 + truncated, at + 1, said + c) for c in "ua")


def damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected(rows, after):
    out = {}
    convs = {}
    for conv, *row in after:
        convs.setdefault(conv, []).append(row)
    for conv in {r[0] for r in rows}:
        own = sorted(convs.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, live, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            ended = text.rstrip(BLANK)
            fault = "blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            live.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = itertools.pairwise(r[1][:1] for r in own)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        cost, edits, said = cheapest(live) if own else (0, "", "")
        lines, at, place = [], 0, 0
        for edit in edits:
            if edit != "D":
                name = {"u": "user", "a": "assistant"}.get(said[place])
                lines.append(f"{own[at][1] if edit == 'K' else name}:{'' if edit == 'I' else own[at][2]}")
                place += 1
            at += edit != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, edits, sha, lines)
    return out


def some_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        n = rng.choice([1, 2, 3, 5, 9, most])
        for i in range(n):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "User", "usher"]) if rng.random() < 0.4 else (
                "user" if i % 2 == 0 else "assistant")
            text = rng.choice([f"text {rng.randint(0, 9 * n)}.", "ok!", "cut off", " \t", "", None, "x.\n ", "é?"])
            rows.append((conv, rng.choice([i, i, i, i + 7, None]), role, text))
        if rng.random() < 0.3:
            rows += rows[-2:]
    return rows


KEYS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_columns(spark):
    rows = some_rows(3, 60, 40)
    want = expected(rows, list(damage(rows)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("conv", "n", "seen", "key")})
    got = turn_repair.audits_after_damage(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[k] for k in KEYS) == want[r.conv_id][:8], r


def test_repaired_turns(spark):
    rows = some_rows(4, 40, 40)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    want = expected(rows, plain)
    found = {}
    for r in turn_repair.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect():
        assert r.place == len(found.setdefault(r.conv_id, []))
        found[r.conv_id].append(f"{r.role}:{r.text}")
    assert found == {c: w[8] for c, w in want.items() if w[8]}


def test_parts_of_a_long_conversation_give_the_whole_answer(spark):
    rng = random.Random(9)
    for _ in range(60):
        symbols = "".join(rng.choice("uaua-suUAx") for _ in range(rng.randint(33, 110)))
        fold = turn_repair._Fold()
        part = [(0, 0, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "t") for c in symbols]
        for first in range(0, len(symbols), 8):
            fold.add(part[first:first + 8], symbols[first:first + 8], first + 8 >= len(symbols))
        assert fold.result()[:2] == edit_search.search(symbols)


def test_search_equals_cheapest_first():
    rng = random.Random(2)
    for _ in range(3000):
        symbols = "".join(rng.choice("-suaxSUAX") for _ in range(rng.randint(0, 10)))
        live = [(c.lower().replace("x", "t"), c == "-", c.isupper()) for c in symbols]
        assert edit_search.search(symbols) == cheapest(live)[:2], symbols


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.audits_after_damage(empty).count() == 0
    assert turn_repair.repaired_turns(empty).count() == 0


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows, list(damage(rows)))
    got = turn_repair.audits_after_damage(df).collect()
    assert {r.conv_id: tuple(r[k] for k in KEYS) for r in got} == {c: w[:8] for c, w in want.items()}
