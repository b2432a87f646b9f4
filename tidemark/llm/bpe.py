"""Byte-pair vocabularies in the public ``tokenizers`` JSON form, and their merges.

The library does the steps before the merges (special strings, normaliser, splitter);
the merges themselves are run here. Blanks (space, 0x09 to 0x0D) end every pre-token and
no rule reaches over one, so the stretches between blanks are independent: a task keeps
a bounded dictionary of results per stretch and looks most of them up.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache

# A stretch over this many bytes is worked out anew each time it occurs.
STORED_BYTES = 96
# Entries of a dictionary; when full it starts over.
STORED = 400_000

# Fixed value: the splitting pattern that has a plain form for Latin text.
LATIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Printable ASCII and the Latin letters of one code point up to U+00FF.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
# The same in several lines.
LATIN_TEXT = re.compile("[!-~À-ÖØ-öø-ÿ\\n]*")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special strings of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE vocabularies without prefixes are supported")
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        missing = [
            c for c in byte_characters() if c not in self.ids or c + self.suffix not in self.ids
        ]
        if missing:
            raise ValueError(f"bytes without a symbol: {missing}")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special strings must match as they stand")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first)) or "(?!)")
        # Where the file's steps are known, Latin stretches are split without the library;
        # composing, lower-casing and splitting are the same there.
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.latin = (
            steps == ["NFC", "Replace", "Lowercase"]
            and splits[0].get("pattern") == {"Regex": LATIN_SPLIT}
            and splits[0].get("behavior") == "Removed"
            and splits[0].get("invert") is True
        )
        self.byte_names = byte_characters()
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {
            i: t for t, i in self.special.items()
        }

    def pre_tokens(self, text: str) -> list[str | int]:
        """The pre-tokens as byte characters, special strings as their ids."""
        out: list[str | int] = []
        at = 0
        for hit in self.special_pattern.finditer(text):
            out += self._split(text[at : hit.start()])
            out.append(self.special[hit.group()])
            at = hit.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        if self.latin and _LATIN.fullmatch(text):
            pieces = LATIN_PIECES.findall(text.lower())
            if text.isascii():
                return pieces
            names = self.byte_names
            return ["".join([names[b] for b in p.encode()]) for p in pieces]
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def symbols(self, piece: str) -> list[int]:
        """Initial symbols of a pre-token; the last one carries the word end."""
        return [self.ids[c] for c in piece[:-1]] + [self.ids[piece[-1] + self.suffix]]

    def token_texts(self) -> list[str]:
        """Token texts by id, empty where no token has the id."""
        return [self.tokens.get(i, "") for i in range(max(self.tokens, default=-1) + 1)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, loaded once per Python worker."""
    return Vocabulary(path)


def merge_all(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Run every merge on ``symbols`` in place; swallowed symbols become -1.

    A heap holds the adjacent pairs that can merge, lowest rank and leftmost first; a
    linked list over the live symbols gives the neighbours. Entries whose pair has
    changed since they were pushed are skipped. Returns the number of merges.
    """
    n = len(symbols)
    find = merges.get
    heap = []
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        found = find(pair)
        if found:
            heap.append((found[0], i, found[1], *pair))
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    done = 0
    while heap:
        _, i, merged, left, right = heapq.heappop(heap)
        if symbols[i] != left:
            continue
        j = after[i]
        if j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = merged, -1
        done += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = find((merged, symbols[k]))
            if found:
                heapq.heappush(heap, (found[0], i, found[1], merged, symbols[k]))
        h = before[i]
        if h >= 0:
            found = find((symbols[h], merged))
            if found:
                heapq.heappush(heap, (found[0], h, found[1], symbols[h], merged))
    return done


class Known(dict):
    """Results by text, worked out when first asked for; a worker keeps them across tasks."""

    def __init__(self, work: Callable[[str], object], stored_length: int = STORED_BYTES):
        super().__init__()
        self.work = work
        self.stored_length = stored_length

    def __missing__(self, text: str | bytes):
        value = self.work(text.decode("utf-8", "replace") if isinstance(text, bytes) else text)
        if len(text) <= self.stored_length:
            if len(self) >= STORED:
                self.clear()
            self[text] = value
        return value
