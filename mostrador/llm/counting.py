"""Counting words and character runs in Arrow tasks, summed up in each task before they are shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .words import emit

LETTERS = re.compile(r"[^\W\d_]+")
# Distinct keys that a task holds before it hands on what it has.
HELD = 300_000
PIECE = 1 << 20
# An n-gram as a number whose order is that of the code points: 21 bits a character, the first highest.
BITS, SPACE = np.uint64(21), np.uint64(32)
LAST, FIRST = np.uint64((1 << 21) - 1), np.uint64(42)
# Distinct n-grams that a task holds before it hands on what it has.
GRAMS_HELD = 2_000_000


def letter_pieces(text: str | None) -> Iterator[list[str]]:
    """Lower-case runs of letters of a whole text, a piece at a time; no run is cut."""
    at = 0
    while text and at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = LETTERS.match(text, end)
            end = cut.end() if cut else end
        yield LETTERS.findall(text[at:end].lower())
        at = end


def summed(parts: Iterable[Iterable[tuple[Hashable, int]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (*key, count) of all parts, added up as far as memory for HELD keys allows."""
    def rows() -> Iterator[tuple]:
        held: Counter = Counter()
        for part in parts:
            for key, n in part:
                held[key] += n
            if len(held) > HELD:
                yield from ((*key, n) for key, n in held.items())
                held.clear()
        yield from ((*key, n) for key, n in held.items())

    yield from emit(rows(), schema)

Counts = tuple[np.ndarray, np.ndarray]
NONE: Counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def added(parts: list[Counts]) -> Counts:
    """One sorted list of codes with the sums of their counts."""
    if len(parts) < 2:
        return parts[0] if parts else NONE
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    return codes, total


def by_prefix(codes: np.ndarray, counts: np.ndarray, shift: np.uint64) -> Counts:
    """Counts of the codes without their last ``shift`` bits."""
    cut = codes >> shift
    first = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
    return cut[first] << shift, np.add.reduceat(counts, first)


def gram_counts(text: str | None, ends: bool = False) -> Counts:
    """1- to 3-grams of the space-padded lower-case words of a whole text, a piece of a very long one at a time; with
    ``ends`` also the space itself, once a word."""
    longest: list[Counts] = []
    for words in letter_pieces(text):
        if words:
            at = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
            third = np.append(at[2:], np.uint64(0))
            third[at[1:] == SPACE] = 0  # a word's last character and the space after it start nothing longer
            codes, counts = np.unique((at[:-1] << FIRST) | (at[1:] << BITS) | third, return_counts=True)
            longest.append((codes, counts))
    codes, counts = added(longest)
    if not len(codes):
        return NONE
    two, n_two = by_prefix(codes, counts, BITS)
    one, n_one = by_prefix(two, n_two, FIRST)
    letter, three = ends | (one != SPACE << FIRST), (codes & LAST) != 0
    return np.concatenate([one[letter], two, codes[three]]), np.concatenate([n_one[letter], n_two, counts[three]])


def to_code(gram: str) -> int:
    return sum(ord(c) << (42 - 21 * k) for k, c in enumerate(gram))


def to_gram(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def gathered(texts: Iterable[tuple[Hashable, str | None]], ends: bool = False) -> Iterator[tuple[Hashable, np.ndarray, np.ndarray]]:
    """(key, codes, counts) of the n-grams of all (key, text), added up as far as memory for GRAMS_HELD allows."""
    held: dict[Hashable, list[Counts]] = {}
    have, most = 0, GRAMS_HELD

    def sums() -> Iterator[tuple[Hashable, np.ndarray, np.ndarray]]:
        yield from ((key, *added(found)) for key, found in held.items())

    for key, text in texts:
        found = gram_counts(text, ends)
        held.setdefault(key, []).append(found)
        have += len(found[0])
        if have > most:
            held = {k: [added(v)] for k, v in held.items()}
            have = sum(len(v[0][0]) for v in held.values())
            if have > GRAMS_HELD // 2:
                yield from sums()
                held, have = {}, 0
            most = have + GRAMS_HELD
    yield from sums()
