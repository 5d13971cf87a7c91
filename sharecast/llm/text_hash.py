"""Hashes of the words of many texts at once, with numpy: texts are joined, cut into
words by a table of separator bytes, and hashed without a loop over words."""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 20       # texts hashed at once
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Byte tables: the six ASCII blanks; everything ASCII but digits and letters.
BLANKS = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit of the argument over the result."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def _pieces(texts: list[bytes]):
    """The texts in lists of about CHUNK_BYTES as (number, bytes); longer texts are cut
    at blanks, so that what is hashed at once stays small."""
    out, held = [], 0
    for d, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = at + CHUNK_BYTES
            while end < len(t) and t[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            out.append((d, t[at:end]))
            held, at = held + end - at, end
            if held >= CHUNK_BYTES:
                yield out
                out, held = [], 0
    if out:
        yield out


def _piece_words(pieces: list[tuple[int, bytes]], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(t for _, t in pieces) + b" ", np.uint8)
    upper = (data >= 65) & (data <= 90)
    blank = separators[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = ends - starts
    inside = np.flatnonzero(~blank)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, size)
    letters = (data[inside] + upper[inside] * np.uint8(32)).astype(np.uint64) + np.uint64(1)
    odd = mix(np.arange(int(size.max()), dtype=np.uint64)) | np.uint64(1)
    sums = np.add.reduceat(letters * odd[place], first)
    piece_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for _, t in pieces])[:-1]))
    docs = np.array([d for d, _ in pieces])[np.searchsorted(piece_starts, starts, "right") - 1]
    return mix(sums + size.astype(np.uint64)), docs


def word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the texts, in order. Words are runs of bytes
    that are no separators (blanks are), with A-Z lower-cased."""
    parts = [_piece_words(p, separators) for p in _pieces(texts)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([d for _, d in parts])
