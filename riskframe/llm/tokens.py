"""Vectorised words and hashes of whole texts, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20


def pieces(texts: list[bytes], limit: int = CHUNK, overlap: int = 0) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of at most about ``limit`` bytes: (text number of each piece, pieces).  A longer text is cut, with
    ``overlap`` bytes repeated at each cut, or after white space where ``overlap`` is 0."""
    of: list[int] = []
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = min(len(text), at + limit)
            if end < len(text) and not overlap:
                cut = max(text.rfind(c, at + 1, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                end = cut if cut > at else end
                if cut <= at:  # a word longer than the limit stays whole
                    later = [k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := text.find(c, end)) >= 0]
                    end = min(later, default=len(text))
            of.append(i)
            group.append(text[at:end])
            size += end - at
            if size >= limit:
                yield of, group
                of, group, size = [], [], 0
            if end >= len(text):
                break
            at = end - overlap
    if of:
        yield of, group


def hash_table(seed: int = 1) -> np.ndarray:
    """Random 64-bit numbers by position in the word (modulo 64) and byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, (64, 256), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words between ASCII white space."""
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~((a == 32) | ((a >= 9) & (a <= 13)))
    step = np.diff(inside)
    return a, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of ``data``."""
    a, starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    size = ends - starts
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(first, size)
    value = table[pos & 63, a[pos + np.repeat(starts, size)]]
    if size.max() > 64:
        value = value * (2 * (pos >> 6) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, first)), starts, ends


def token_groups(texts: list[bytes], table: np.ndarray, limit: int = 2 * CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, words per text) for runs of consecutive texts of about ``limit`` bytes together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        counts, hashes = np.zeros(end - at, np.int64), []
        for of, group in pieces(texts[at:end]):
            h, starts, _ = hash_words(b" ".join(group), table)
            begin = np.cumsum([0] + [len(p) + 1 for p in group])
            np.add.at(counts, of, np.diff(np.searchsorted(starts, begin)))
            hashes.append(h)
        yield at, np.concatenate(hashes), counts
        at = end
