"""Cheapest repair of a turn sequence by iterative-deepening A*.

A conversation is a string of symbols, one per row. A row is to be deleted ("-"), or has
a role initial s, u, a, or x for any other, upper case where its text is truncated. The
edits, in ASCII order, are D (delete, 3), I (insert a turn with empty text, 2), K (keep, 0)
and R (rerole to user or assistant, 2); a truncated row that is not deleted adds 1. The
role initials that remain must read ``(s?(ua)+)?``. The answer is the cheapest string of
edits, the least one in ASCII order among equals.

States of the pattern: START, after the s (SYSTEM), after a u (ASKED), after an a
(ANSWERED); START and ANSWERED accept. State and edit determine the next state, so a
string of edits stands for one repair.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, ASKED, ANSWERED = range(4)
ACCEPTING = (START, ANSWERED)
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
# The turn that can follow a state, if it is not the s, and the state behind it.
NEXT = {START: ("u", ASKED), SYSTEM: ("u", ASKED), ASKED: ("a", ANSWERED), ANSWERED: ("u", ASKED)}
# Initial last said in a state, for the legality of the pair with the next row.
_SAID = {START: "^", SYSTEM: "s", ASKED: "u", ANSWERED: "a"}
_LEGAL = {"su", "ua", "au", "^s", "^u"}


def reachable(symbols: str, begin: int, end: int) -> bool:
    """Whether some edits lead from ``begin`` to ``end``."""
    if end in (ASKED, ANSWERED) or begin == end:
        return True
    return begin == START and end == SYSTEM and any(c in "sS" for c in symbols)


def _bounds(symbols: str) -> tuple[list[int], list[int], list[str]]:
    """Per place: unavoidable cost, illegal pairs inside, and the next initial, from there on."""
    cost, clashes, first = [0], [0], [""]
    for c in reversed(symbols):
        initial = c.lower()
        if initial == "-":
            cost.append(cost[-1] + 3), clashes.append(clashes[-1]), first.append(first[-1])
        else:
            cost.append(cost[-1] + (c != initial))
            clashes.append(clashes[-1] + bool(first[-1] and initial + first[-1] not in _LEGAL))
            first.append(initial)
    return cost[::-1], clashes[::-1], first[::-1]


def search(
    symbols: str, begin: int = START, ends: tuple[int, ...] = ACCEPTING, final: bool = True
) -> tuple[int, str] | None:
    """Cost and edits of the best path from ``begin`` to one of ``ends``; None if there is none.

    Turns are inserted behind the last row only if ``final``. A part of a conversation that
    is not the last one leaves them to the next part, so that no two strings of edits for
    the same rows are one the beginning of the other.

    Depth-first search in ASCII edit order under a cost bound; the bound rises to the least
    estimate that exceeded it. A table keeps, per place and state, the largest remaining
    cost that is known to fail. The estimate counts the unavoidable deletions and
    truncations, and 2 per two illegal pairs, since an edit mends two pairs at most.
    """
    ends = tuple(e for e in ends if reachable(symbols, begin, e))
    if not ends:
        return None
    n = len(symbols)
    cost, clashes, first = _bounds(symbols)
    last = next((c.lower() for c in reversed(symbols) if c != "-"), "")
    closing = {_SAID[e] for e in ends}

    early = max(ends) <= SYSTEM

    def estimate(at: int, state: int) -> int:
        if early:
            # All that remains is deleted, but for the s that leads from START to SYSTEM.
            if state > max(ends):
                return 4 * n + 4
            return 3 * (n - at) - (3 if state not in ends else 0)
        if not first[at]:
            return cost[at] + (0 if state in ends else 2)
        pairs = clashes[at] + (_SAID[state] + first[at] not in _LEGAL) + (last not in closing)
        return cost[at] + (pairs + 1) // 2 * 2

    def moves(at: int, state: int):
        """(edit, cost, place, state) in ASCII order."""
        role, after = NEXT[state]
        if at < n:
            yield "D", 3, at + 1, state
        if at < n or final:
            yield "I", 2, at, after
        if at < n and symbols[at] != "-":
            more = symbols[at].isupper()
            initial = symbols[at].lower()
            if initial == role:
                yield "K", more, at + 1, after
            elif initial == "s" and state == START:
                yield "K", more, at + 1, SYSTEM
            yield "R", 2 + more, at + 1, after

    limit = estimate(0, begin)
    while True:
        failed: dict[tuple[int, int], int] = {}
        exceeded = None
        # One frame per step of the path: place, state, what is left, moves still to try.
        path: list[str] = []
        frames = [(0, begin, limit, moves(0, begin))]
        if n == 0 and begin in ends:
            return 0, ""
        while frames:
            at, state, left, rest = frames[-1]
            for edit, price, to, after in rest:
                remains = left - price
                need = estimate(to, after)
                if need > remains:
                    over = limit + need - remains
                    exceeded = over if exceeded is None else min(exceeded, over)
                    continue
                if failed.get((to, after), -1) >= remains:
                    continue
                path.append(edit)
                if to == n and after in ends:
                    return limit - remains, "".join(path)
                frames.append((to, after, remains, moves(to, after)))
                break
            else:
                failed[at, state] = max(left, failed.get((at, state), -1))
                frames.pop()
                if path:
                    path.pop()
        limit = exceeded


@lru_cache(maxsize=1 << 16)
def remembered(symbols: str, begin: int, ends: tuple[int, ...], final: bool) -> tuple[int, str] | None:
    """``search``; short conversations repeat the same few strings."""
    return search(symbols, begin, ends, final)


def follow(symbols: str, edits: str, state: int = START):
    """(edit, place of its row or -1, role initial said or "") per edit."""
    at = 0
    for edit in edits:
        role, after = NEXT[state]
        if edit == "D":
            yield edit, at, ""
        elif edit == "K" and symbols[at].lower() == "s":
            yield edit, at, "s"
            state = SYSTEM
        else:
            yield edit, -1 if edit == "I" else at, role
            state = after
        at += edit != "I"
