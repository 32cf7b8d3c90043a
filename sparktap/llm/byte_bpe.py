"""Token ids of byte-level BPE for many texts at once.

Pre-tokens are found by character class over whole blocks, each distinct pre-token is encoded once for each worker, and
ids are gathered by numpy. The ids are those of the tokenizers library for the same vocabulary.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata

import numpy as np

from sparktap.llm import spans

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
#: Code points of Unicode White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 1 << 18
#: Pre-tokens kept for each worker; beyond it the memory starts anew, which changes no result.
KEEP = 1_000_000

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point; the last one, beyond Unicode, parts texts."""
    global _classes
    if _classes is None:
        names = "".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))[::2]
        firsts = np.frombuffer(names.encode("ascii"), np.uint8)
        out = np.full(sys.maxunicode + 2, OTHER, np.uint8)
        out[:-1][firsts == ord("L")] = LETTER
        out[:-1][firsts == ord("N")] = NUMBER
        out[WHITE] = SPACE
        out[-1] = BREAK
        _classes = out
    return _classes


def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts joined by the break code: a contraction; an optional space and a run of
    letters, numbers or others; white space, whose last character stands alone or joins the next run."""
    kind = classes()[codes]
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = np.concatenate([starts[1:], [len(codes)]])
    kinds = kind[starts]
    after = np.concatenate([kinds[1:], [BREAK]])
    gap = (kinds == SPACE) & (after != BREAK)
    spaced = gap & (codes[ends - 1] == 32)
    lone = gap & ~spaced
    joined = np.concatenate([[False], spaced[:-1]])
    ends = ends - gap
    # An apostrophe alone, with no space before it, takes one of its endings from the letters behind it.
    quote = np.flatnonzero((kinds == OTHER) & (codes[starts] == 39) & (ends - starts == 1) & (after == LETTER) & ~joined)
    starts = starts - joined
    if len(quote):
        padded = np.concatenate([codes, [0, 0]])
        one, two = padded[ends[quote]], padded[ends[quote] + 1]
        room = ends[quote + 1] - starts[quote + 1]
        takes = np.zeros(len(quote), np.int64)
        takes[np.isin(one, [ord(c) for c in "stmd"])] = 1
        for pair in ("re", "ve", "ll"):
            takes[(one == ord(pair[0])) & (two == ord(pair[1])) & (room >= 2)] = 2
        ends[quote] += takes
        starts[quote + 1] += takes
    more = np.flatnonzero(lone)
    starts, ends, kinds = np.concatenate([starts, ends[more]]), np.concatenate([ends, ends[more] + 1]), np.concatenate([kinds, kinds[more]])
    keep = (ends > starts) & (kinds != BREAK)
    starts, ends = starts[keep], ends[keep]
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _parts(text: str) -> list[str]:
    """A long text, cut before single spaces, where pre-tokens always end."""
    out, at = [], 0
    while len(text) - at > 2 * BLOCK and (found := _SAFE.search(text, at + BLOCK)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Encoder:
    """ranks_path: a file of base64 tokens and their ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        #: Bytes of each token.
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        self.lengths[list(ranks.values())] = [len(x) for x in ranks]
        self.one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        one = self.one
        new = [one(p.encode()) for p in pieces]
        sizes = np.fromiter(map(len, new), np.int32, len(new))
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), np.int32)])
        self.flat[self.used : self.used + total] = np.fromiter((x for ids in new for x in ids), np.int32, total)
        at = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += total
        spot = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = np.insert(self.known, spot, hashes), np.insert(self.at, spot, at), np.insert(self.size, spot, sizes)

    def _block(self, text: str, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts joined by the break (shown as a lone surrogate), and the bounds of each text's."""
        if not text:
            return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(codes == 0xD800)
        if len(breaks):
            codes = codes.copy()
            codes[breaks] = sys.maxunicode + 1
        starts, ends = split(codes)
        hashes = spans.span_hashes(spans.prefix(codes), starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inside = spot < len(self.known)
        missing[inside] = self.known[spot[inside]] != distinct[inside]
        if missing.any():
            if len(self.known) > KEEP:
                self._forget()
                missing[:] = True
            s, e = starts[first[missing]].tolist(), ends[first[missing]].tolist()
            self._learn(distinct[missing], [text[a:b] for a, b in zip(s, e)])
            spot = np.searchsorted(self.known, distinct)
        at, size = self.at[spot][back], self.size[spot][back].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        cut = np.searchsorted(starts, breaks)
        return ids, upto[np.concatenate([[0], cut, [len(starts)]])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for low, high in spans.blocks([len(x) for x in texts], BLOCK):
            if high - low == 1 and len(texts[low]) > 2 * BLOCK:
                out.append(np.concatenate([self._block(p, 1)[0] for p in _parts(texts[low])]))
                continue
            ids, bounds = self._block("\ud800".join(texts[low:high]), high - low)
            out += [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str | None = None, pattern: str | None = None) -> Encoder:
    """The worker's encoder of that vocabulary; by default the public 50k one."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
