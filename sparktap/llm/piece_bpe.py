"""SentencePiece encoding and decoding of merge-type (BPE) models, with seeded merge-dropout.

A text is a list of units: spaces and what follows up to the next space; no piece of the vocabulary spans two units, so
each is merged alone, by an agenda: the candidate of the best score goes first, of equal ones the leftmost. A candidate
is skipped for good where a keyed hash of seed, variant, unit and the candidate's place says so, with chance `dropout`.
Each occurrence of a unit takes one of `variants` variants by a keyed hash of the document and the place, so one text has
varied segmentations and a rerun gives the same; variants=None bounds them by nothing. All distinct units of a block are merged at once by numpy; a very
long unit is merged by a heap, with the same result. Without dropout the ids are those of the sentencepiece library.

Decoding gives the text back whatever was skipped: characters outside the vocabulary, and the literal mark that stands
for a space, are written as bytes. Defined results: null text encodes to null, empty text to no ids, and back; a null id
names a document like any other, and rows that repeat an id and a text have the same ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktap.llm import spans
from sparktap.session import ship

MARK = 0x2581
#: Stands for a literal mark inside the text, and for the end of a text in a block.
LITERAL, BREAK = 0x110000, 0x110001
#: Variants of a unit where the caller names no other number.
VARIANTS = 8
DROPOUT = 0.1
SEED = 17
BLOCK = 1 << 18
#: Units kept for each worker; beyond it the memory starts anew, which changes no result.
KEEP = 1_000_000
#: Symbols of a unit from which the heap is used.
LONG = 256


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p, u in zip(names, usable) if u):
            raise ValueError("a piece spans two units")
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.by_name = {p: i for i, (p, u) in enumerate(zip(names, usable)) if u}
        self.byte_ids = np.zeros(256, np.int32)
        self.outputs: list[bytes] = []
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:-1], 16)] = i
                self.outputs.append(bytes([int(p[3:-1], 16)]))
            else:
                self.outputs.append(p.replace("▁", " ").encode() if usable[i] else b"")
        # Symbols: piece ids, and from n on the code points that are no piece.
        self.n = n
        self.symbols = np.arange(0x110002, dtype=np.int64) + n
        for p, i in self.by_name.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        merges = [(self.by_name[p[:k]] * n + self.by_name[p[k:]], i) for p, i in self.by_name.items() for k in range(1, len(p)) if p[:k] in self.by_name and p[k:] in self.by_name]
        keys, first = np.unique(np.array([m[0] for m in merges], np.int64), return_index=True)
        self.keys, self.merged = keys, np.array([m[1] for m in merges], np.int64)[first]
        self.out_sizes = np.array([len(x) for x in self.outputs])
        self.out_at = np.cumsum(self.out_sizes) - self.out_sizes
        self.out_flat = np.frombuffer(b"".join(self.outputs), np.uint8)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        ok = (left < self.n) & (right < self.n)
        key = np.where(ok, left * self.n + right, -1)
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.merged[spot], -1)


class Codec:
    def __init__(self, path: str, dropout: float, seed: int, variants: int | None = VARIANTS):
        self.variants = variants
        self.pieces, self.dropout, self.seed = Pieces(path), dropout, spans.U(seed * 2 + 1)
        self.limit = spans.U(min(int(dropout * 2.0**64), (1 << 64) - 1))
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _skipped(self, keys: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not self.dropout:
            return np.zeros(len(keys), bool)
        place = (start.astype(np.uint64) * spans.U(0x9E3779B1) + mid.astype(np.uint64)) * spans.U(0x85EBCA77) + end.astype(np.uint64)
        return spans.mix(keys ^ spans.mix(place + self.seed)) < self.limit

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units after merging, and their numbers. keys: of seed, variant and unit."""
        pieces = self.pieces
        unit = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = start + 1
        done_s, done_u = [], []

        def candidates(i: np.ndarray) -> np.ndarray:
            """The scores of pairs (i, i + 1)."""
            inside = i + 1 < len(symbols)
            j = np.minimum(i + 1, len(symbols) - 1)
            made = np.where(inside & (unit[i] == unit[j]), pieces.join(symbols[i], symbols[j]), -1)
            made[self._skipped(keys[unit[i]], start[i], start[j], end[j])] = -1
            return made

        made = candidates(np.arange(len(symbols))) if len(symbols) else np.zeros(0, np.int64)
        while len(symbols):
            score = np.where(made >= 0, pieces.scores[made], -np.inf)
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.maximum.reduceat(score, first)
            count = np.diff(np.concatenate([first, [len(symbols)]]))
            spread = np.repeat(best, count)
            over = spread == -np.inf
            if over.any():
                done_s.append(symbols[over]), done_u.append(unit[over])
                go = ~over
                symbols, unit, start, end, made, score, spread = symbols[go], unit[go], start[go], end[go], made[go], score[go], spread[go]
                if not len(symbols):
                    break
            hit = np.flatnonzero(score == spread)
            hit = hit[np.concatenate([[True], unit[hit[1:]] != unit[hit[:-1]]])]
            symbols[hit], end[hit] = made[hit], end[hit + 1]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one symbol has gone before each later hit
            symbols, unit, start, end, made = symbols[stay], unit[stay], start[stay], end[stay], made[stay]
            again = np.concatenate([hit, hit[hit > 0] - 1])
            made[again] = candidates(again)
        if not done_s:
            return symbols, np.zeros(len(sizes), np.int64)
        all_s, all_u = np.concatenate(done_s), np.concatenate(done_u)
        order = np.argsort(all_u, kind="stable")
        return all_s[order], np.bincount(all_u, minlength=len(sizes))

    def _merge_long(self, symbols: list[int], key: np.uint64) -> list[int]:
        """The same for one unit, by a heap."""
        pieces, n = self.pieces, len(symbols)
        symbols, nxt, prev, end = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple] = []

        def push(lefts: list[int]) -> None:
            i = np.array([x for x in lefts if x >= 0 and nxt[x] < n], np.int64)
            if not len(i):
                return
            j = np.array([nxt[x] for x in i.tolist()])
            made = pieces.join(np.array([symbols[x] for x in i.tolist()]), np.array([symbols[x] for x in j.tolist()]))
            made[self._skipped(np.full(len(i), key), i, j, np.array([end[x] for x in j.tolist()]))] = -1
            for a, b, m in zip(i.tolist(), j.tolist(), made.tolist()):
                if m >= 0:
                    heapq.heappush(heap, (-pieces.scores[m], a, b, end[b], symbols[a], m))

        push(list(range(n)))
        while heap:
            _, a, b, e, s, m = heapq.heappop(heap)
            if symbols[a] != s or nxt[a] != b or symbols[b] is None or end[b] != e:
                continue
            symbols[a], end[a], nxt[a], symbols[b] = m, e, nxt[b], None
            if nxt[b] < n:
                prev[nxt[b]] = a
            push([a, prev[a]])
        return [s for s in symbols if s is not None]

    def _learn(self, hashes: np.ndarray, keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        sizes = ends - starts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        symbols = self.pieces.symbols[codes[at]]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        long = sizes > LONG
        out_s, out_n = self._merge(symbols[np.repeat(~long, sizes)].copy(), sizes[~long], keys[~long])
        number = np.zeros(len(sizes), np.int64)
        number[~long] = out_n
        parts = {}
        for i in np.flatnonzero(long).tolist():
            parts[i] = np.array(self._merge_long(symbols[bounds[i] : bounds[i + 1]].tolist(), keys[i]), np.int64)
            number[i] = len(parts[i])
        if parts:
            upto = np.concatenate([[0], np.cumsum(out_n)])
            short = iter(zip(upto[:-1].tolist(), upto[1:].tolist()))
            out_s = np.concatenate([parts[i] if i in parts else out_s[slice(*next(short))] for i in range(len(sizes))])
        # Symbols that are no piece become the bytes of their character.
        n = self.pieces.n
        owner = np.repeat(np.arange(len(sizes)), number)
        odd = np.flatnonzero(out_s >= n)
        if len(odd):
            spelled = [(chr(MARK) if c == LITERAL else chr(c)).encode() for c in (out_s[odd] - n).tolist()]
            times = np.ones(len(out_s), np.int64)
            times[odd] = [len(x) for x in spelled]
            wide = np.repeat(out_s, times)
            wide[np.repeat(out_s >= n, times)] = self.pieces.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            out_s, number = wide, np.bincount(np.repeat(owner, times), minlength=len(sizes))
        total = len(out_s)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), np.int32)])
        self.flat[self.used : self.used + total] = out_s
        at = self.used + np.cumsum(number) - number
        self.used += total
        spot = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = np.insert(self.known, spot, hashes), np.insert(self.at, spot, at), np.insert(self.size, spot, number)

    def _block(self, texts: list[str], names: np.ndarray) -> list[np.ndarray]:
        body = "\ud800".join(" " + t if t else "" for t in texts)
        if not body:
            return [np.zeros(0, np.int32)] * len(texts)
        codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[codes == MARK] = LITERAL
        codes[codes == 32] = MARK
        codes[codes == 0xD800] = BREAK
        mark, cut = codes == MARK, codes == BREAK
        opens = cut.copy()
        opens[1:] |= cut[:-1] | (mark[1:] & ~mark[:-1])
        opens[0] = True
        starts = np.flatnonzero(opens)
        ends = np.concatenate([starts[1:], [len(codes)]])
        breaks = np.flatnonzero(cut)
        real = ~cut[starts]
        starts, ends = starts[real], ends[real]
        bounds = np.concatenate([[0], np.searchsorted(starts, breaks), [len(starts)]])
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(texts)), sizes)
        nth = np.arange(len(starts)) - np.repeat(bounds[:-1], sizes)
        keys = spans.span_hashes(spans.prefix(codes), starts, ends)
        if self.dropout:
            variant = spans.mix(names[owner] + spans.mix(nth.astype(np.uint64) + self.seed))
            if self.variants is not None:
                variant %= spans.U(self.variants)
            keys = spans.mix(keys + (variant + spans.U(1)) * spans.U(spans.BASE) * self.seed)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inside = spot < len(self.known)
        missing[inside] = self.known[spot[inside]] != distinct[inside]
        if missing.any():
            if len(self.known) > KEEP:
                self._forget()
                missing[:] = True
            which = first[missing]
            self._learn(distinct[missing], distinct[missing], codes, starts[which], ends[which])
            spot = np.searchsorted(self.known, distinct)
        at, size = self.at[spot][back], self.size[spot][back]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        edge = upto[bounds].tolist()
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]

    def encode(self, texts: list[str], names: list[str]) -> list[np.ndarray]:
        """Ids of each text; names: what tells the documents apart in the keyed hash."""
        import xxhash

        hashed = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
        out: list[np.ndarray] = []
        for low, high in spans.blocks([len(x) for x in texts], BLOCK):
            out += self._block(texts[low:high], hashed[low:high])
        return out

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        out = []
        p = self.pieces
        for ids in lists:
            size = p.out_sizes[ids]
            upto = np.cumsum(size) - size
            raw = p.out_flat[np.repeat(p.out_at[ids] - upto, size) + np.arange(size.sum())].tobytes()
            out.append(raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace"))
        return out


_codecs: dict[tuple, Codec] = {}


def codec(path: str | None = None, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = VARIANTS) -> Codec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    key = (path, dropout, seed, variants)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), path: str | None = None, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = VARIANTS) -> DataFrame:
    """Rows (id, *keep, ids): token ids as 32-bit little-endian numbers, null for null text.

    variants: segmentations that a distinct unit has over all documents, so that most come from memory; None: each
    occurrence draws its own, by document and place.
    """
    ship(docs.sparkSession)
    few = docs.select(F.col(id_col).alias(id_col), *keep, F.col(text_col).alias("ids"))
    schema = ", ".join(f"`{n}` {t}" for n, t in few.dtypes[:-1]) + ", ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, dropout, seed, variants)
        for batch in spans.slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = c.encode([x or "" for x in texts], list(map(str, batch.column(0).to_pylist())))
            packed = pa.array([None if t is None else x.astype("<u4").tobytes() for t, x in zip(texts, ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)

    return few.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The rows with their ids' text in a column more; all other columns stay."""
    ship(encoded.sparkSession)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in encoded.dtypes), f"`{text_col}` string"])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, 0.0, 0)
        for batch in spans.slices(batches):
            packed = batch.column(at).to_pylist()
            texts = c.decode([np.frombuffer(x or b"", "<u4") for x in packed])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if p is None else t for p, t in zip(packed, texts)], pa.string())], names=[*batch.schema.names, text_col])

    return encoded.mapInArrow(run, schema)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Each document encoded with merge-dropout and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    back = decode(encode(docs, keep=("text_sha256",)), text_col="decoded")
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"))
