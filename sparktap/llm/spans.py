"""Hashes of many spans of text at once, by numpy: words, word runs and pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: An odd number and its inverse modulo 2**64, of the polynomial that spans are hashed by.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that part words: space, and 9 to 13.
BREAKS = np.zeros(256, bool)
BREAKS[[32, 9, 10, 11, 12, 13]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
#: About how many bytes are worked on at once; a single longer word is never cut.
BLOCK = 1 << 18

_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        steps = np.full(size, BASE, U)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=U)
        steps[1:] = INVERSE
        _inverses = np.cumprod(steps, dtype=U)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, key: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(key))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Running sums by which span_hashes() finds any span's hash."""
    powers, _ = _grown(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * powers[: len(codes)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverses = _grown(len(sums))
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(codes: np.ndarray, breaks: np.ndarray = BREAKS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't breaks."""
    solid = np.zeros(len(codes) + 2, np.int8)
    solid[1:-1] = ~breaks[codes]
    turns = np.diff(solid)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def _hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each starts."""
    codes = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(codes)
    return span_hashes(prefix(codes), starts, ends), starts


def pieces(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A long text cut at white space."""
    at = 0
    while len(text) - at > 2 * size:
        found = _BREAK.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """The same rows in smaller record batches, so that what comes out of them is small too."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def blocks(sizes: list[int], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of entries of about the given size; a larger entry has a range of its own."""
    low = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and bounds: text i has those from bounds[i] to bounds[i + 1]."""
    if len(texts) == 1:
        found = np.concatenate([_hash_words(x)[0] for x in pieces(texts[0])])
        return found, np.array([0, len(found)])
    hashes, starts = _hash_words(b" ".join(texts))
    offsets = np.cumsum([0, *[len(x) + 1 for x in texts]])
    return hashes, np.searchsorted(starts, offsets)


#: Odd multipliers of the places of a word run.
PLACES = [U(0x9FB21C651E98DF25 | 1), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63)]


def word_runs(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word runs, and their bounds; a text with fewer words is one run, without words none."""
    places = [PLACES[i % 5] * U(2 * (i // 5) + 1) for i in range(width)]
    counts = np.diff(bounds)
    n = len(hashes)
    if n >= width:
        total = hashes[: n - width + 1] * places[0]
        for i in range(1, width):
            total += hashes[i : n - width + 1 + i] * places[i]
        runs = mix(total)
        ends = np.repeat(bounds[1:], counts)[: n - width + 1]
        runs_ok = np.arange(n - width + 1) + width <= ends
        full = runs[runs_ok]
    else:
        full = np.zeros(0, U)
    out, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for i, m in enumerate(counts.tolist()):
        if m >= width:
            own = np.sort(full[at : at + m - width + 1])
            at += m - width + 1
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif m:
            own = mix(np.array([sum(int(h) * int(p) for h, p in zip(hashes[bounds[i] : bounds[i + 1]], places)) + m * BASE & (1 << 64) - 1], U))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)])
