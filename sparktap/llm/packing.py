"""Packing of token sequences by a dot-product heuristic under several limits at once.

Every task tokenises and packs the documents that it reads: no row is shuffled, and a task that is run again gives the
same sequences. A piece of a document needs tokens, one segment, and as many loss-bearing tokens as the document's loss
spans give it; these needs are independent of each other: an answer bears loss, a prompt doesn't. An open sequence has
room left in each dimension. Of the pieces in the window that fit in every dimension, the one goes in whose needs,
weighted by how scarce each dimension is in the window, have the largest dot product with that room. Where no whole piece
fits, one is cut to fill what is left. Where a limit ends a sequence early, it is left as it is if the padding is within
`MOST_PADDING`, and cut back to a power of two otherwise, which needs none; so is what remains at a task's end.

Defined results: null text is empty, and still has the end token, which bears a loss; a null id is packed as any other.
Without a column of spans all tokens bear a loss; null spans mean none does but the end token. Spans beyond the text are
clipped, spans that overlap count once. The first token of each piece has no context in it and bears no loss. Repeated
rows are packed each. A document's pieces may lie in several sequences. Tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.llm.byte_bpe import encoder
from sparktap.session import ship

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: A 64th of a sequence is for what bears no loss.
MAX_LOSS = 2016
#: Share of a sequence that may be padding where a limit other than that of tokens ends it.
MOST_PADDING = 0.02
#: Pieces among which the next one is chosen.
WINDOW = 1024
#: Tokens of a cut piece, unless fewer are left to fill. As a piece's first token bears no loss, crumbs would evade that limit.
LEAST_CUT = 32
END_ID = 1
SPANS = "array<struct<start:int,length:int>>"


class Packer:
    """Takes documents, gives out pieces: (document, start, length, sequence, offset, loss-bearing tokens).

    A document is a list of running counts: how many of its first k tokens bear a loss, for k from 0 to its size.
    """

    def __init__(self, tokens: int, segments: int, loss: int, padding: float = MOST_PADDING):
        self.limits = (tokens, segments, loss)
        self.padding = int(tokens * padding)
        self.sequence = 0
        self.docs: list = []
        self.counts: list[np.ndarray] = []
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.losses = np.zeros(0, np.int64)

    @staticmethod
    def bearing(counts: np.ndarray, start: int, size: int) -> int:
        """Loss-bearing tokens of a piece: its first one has no context and is none."""
        return int(counts[start + size] - counts[start + 1])

    @staticmethod
    def most(counts: np.ndarray, start: int, size: int, tokens: int, loss: int) -> int:
        """Tokens from the start of a piece that stay within both limits."""
        if min(size, tokens) <= 0:
            return 0
        fits = int(np.searchsorted(counts[start + 1 : start + size + 1], counts[start + 1] + loss, side="right"))
        return min(fits, tokens)

    def add(self, docs: list, counts: list[np.ndarray]) -> list[tuple]:
        """Full sequences of single documents go out at once; the rest waits for a place."""
        out, new = [], []
        tokens, _, loss = self.limits
        for doc, own in zip(docs, counts):
            start, size = 0, len(own) - 1
            while start < size:
                take = self.most(own, start, size - start, tokens, loss)
                if take == tokens:
                    out.append((doc, start, take, self.sequence, 0, self.bearing(own, start, take)))
                    self.sequence += 1
                else:
                    new.append((doc, own, start, take, self.bearing(own, start, take)))
                start += take
        if new:
            d, c, s, n, b = zip(*new)
            self.docs += d
            self.counts += c
            self.starts = np.concatenate([self.starts, np.array(s, np.int64)])
            self.sizes = np.concatenate([self.sizes, np.array(n, np.int64)])
            self.losses = np.concatenate([self.losses, np.array(b, np.int64)])
        while len(self.sizes) > 2 * WINDOW:
            out += self._fill(WINDOW)
        return out

    def score(self, size: np.ndarray, loss: np.ndarray, room: tuple[int, int, int], weight: tuple) -> np.ndarray:
        """The dot product of each piece's needs with the room, both as shares of the limits, by the weights."""
        tokens, segments, most = self.limits
        return size * (weight[0] * room[0] / tokens**2) + loss * (weight[1] * room[2] / max(most, 1) ** 2) + weight[2] * room[1] / segments**2

    def _fill(self, floor: int) -> list[tuple]:
        """Sequences from the oldest pieces, until at most `floor` of these are left; from all of them if that is 0."""
        out = []
        tokens, segments, loss = self.limits
        n = min(len(self.sizes), 2 * WINDOW)
        counts = self.counts[:n]
        start, size, need = self.starts[:n].copy(), self.sizes[:n].copy(), self.losses[:n].copy()
        free = np.ones(n, bool)
        left, count = int(size.sum()), n
        # How much of each limit the window asks for: the scarcer a dimension, the more it weighs.
        weight = (left / tokens, int(need.sum()) / max(loss, 1), n / segments)

        def change(i: int, by: int) -> None:
            """Takes so many tokens from a piece, or gives them back."""
            nonlocal left, count
            before = size[i] > 0
            start[i] += by
            size[i] -= by
            left -= by
            need[i] = self.bearing(counts[i], int(start[i]), int(size[i])) if size[i] else 0
            free[i] = size[i] > 0
            count += int(free[i]) - int(before)

        while count > floor:
            closing = left < tokens
            if closing and floor:
                break
            room_t, room_s, room_l, row = tokens, segments, loss, []
            while room_t and room_s and count:
                fits = free & (size <= room_t) & (need <= room_l)
                score = np.where(fits, self.score(size, need, (room_t, room_s, room_l), weight), -1.0)
                i = int(score.argmax())
                if score[i] >= 0:
                    take = int(size[i])
                else:
                    # Where the loss is what is scarce, the piece with the least of it is cut, else the largest one.
                    scarce = room_l * tokens < room_t * max(loss, 1)
                    i = int((np.where(free, -need / np.maximum(size, 1), -2.0) if scarce else np.where(free, size, 0)).argmax())
                    take = self.most(counts[i], int(start[i]), int(size[i]), room_t, room_l)
                    if take < min(LEAST_CUT, room_t):
                        break
                bears = self.bearing(counts[i], int(start[i]), take)
                row.append((i, int(start[i]), take))
                change(i, take)
                room_t, room_s, room_l = room_t - take, room_s - 1, room_l - bears
            used = tokens - room_t
            if room_t and (closing or room_t > self.padding):
                excess = used - (1 << used.bit_length() - 1)
                while excess:
                    i, s, take = row.pop()
                    back = min(excess, take)
                    change(i, -back)
                    if take > back:
                        row.append((i, s, take - back))
                    excess -= back
            offset = 0
            for i, s, take in row:
                out.append((self.docs[i], s, take, self.sequence, offset, self.bearing(counts[i], s, take)))
                offset += take
            self.sequence += 1
        rest = np.flatnonzero(free)
        self.docs = [self.docs[i] for i in rest] + self.docs[n:]
        self.counts = [counts[i] for i in rest] + self.counts[n:]
        self.starts = np.concatenate([start[rest], self.starts[n:]])
        self.sizes = np.concatenate([size[rest], self.sizes[n:]])
        self.losses = np.concatenate([need[rest], self.losses[n:]])
        return out

    def close(self) -> list[tuple]:
        """All that waits: full sequences, then sequences of powers of two."""
        out = []
        while len(self.sizes):
            out += self._fill(0)
        return out


_all = np.arange(1 << 16, dtype=np.int32)


def all_bear(size: int) -> np.ndarray:
    """Running counts where every token bears a loss."""
    global _all
    if size >= len(_all):
        _all = np.arange(2 * size, dtype=np.int32)
    return _all[: size + 1]


def running_losses(text: str, lengths: np.ndarray, spans: list) -> np.ndarray:
    """Running counts of a text's tokens, given their bytes, and of the end token: a token bears a loss where the
    character of its first byte lies in a span (start, length; in code points)."""
    cuts = np.array([(max(0, a), max(0, a) + max(0, n + min(0, a))) for a, n in spans if a is not None and n is not None], np.int64).reshape(-1, 2)
    cuts = np.minimum(cuts, len(text))
    if len(text) != int(lengths.sum()):
        raw = np.frombuffer(text.encode(), np.uint8)
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        cuts = place[cuts]
    size = int(lengths.sum())
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, cuts[:, 0], 1)
    np.add.at(depth, cuts[:, 1], -1)
    bears = np.cumsum(depth)[np.cumsum(lengths) - lengths] > 0 if len(lengths) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(bears), [int(bears.sum()) + 1]]).astype(np.int32)


def _pack(limits: tuple[int, int, int], vocabulary: tuple, end_id: int, masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = encoder(*vocabulary)
        packer = Packer(*limits)
        base = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}  # of waiting documents: id, token ids, tokens not yet given out
        next_doc = 0
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

        def emit(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(pieces), 4096):
                rows = []
                for doc, start, n, sequence, offset, bears in pieces[low : low + 4096]:
                    own = held[doc]
                    rows.append((own[0], start, n, own[1][start : start + n].tobytes(), len(own[1]), base + sequence, offset, bears))
                    own[2] -= n
                    if not own[2]:
                        del held[doc]
                kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        def counts(text: str, ids: np.ndarray, spans) -> np.ndarray:
            if not masked:
                return all_bear(len(ids) + 1)
            return running_losses(text, known.lengths[ids], [(x["start"], x["length"]) for x in spans or () if x is not None])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                spans = part.column(2).to_pylist() if masked else [None] * len(texts)
                found = known.encode(texts)
                docs = list(range(next_doc, next_doc + len(found)))
                for k, ids, name in zip(docs, found, part.column(0).to_pylist()):
                    held[k] = [name, np.append(ids, end_id).astype("<u4"), len(ids) + 1]
                next_doc += len(found)
                yield from emit(packer.add(docs, [counts(t, x, s) for t, x, s in zip(texts, found, spans)]))
        yield from emit(packer.close())

    return run


def answer_spans(text: Column) -> Column:
    """The loss spans of a text whose first line is its prompt; a text of one line is all answer."""
    start = F.instr(F.coalesce(text, F.lit("")), "\n")
    return F.array(F.struct(start.alias("start"), (F.coalesce(F.char_length(text), F.lit(0)) - start).alias("length"))).cast(SPANS)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: Column | None = None, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, most_loss: int = MAX_LOSS, vocabulary: tuple = (None, None), end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset, loss_tokens.

    loss: spans of the text whose tokens bear a loss, as SPANS in code points, e.g. the loss mask of chat_format; the
    default is the whole text. vocabulary: path of the ranks file and the pre-token pattern.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if loss is not None:
        cols.append(loss.cast(SPANS).alias("spans"))
    shown = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    run = _pack((tokens, segments, most_loss), vocabulary, end_id, loss is not None)
    return docs.select(*cols).mapInArrow(run, shown).withColumnRenamed("id", id_col)


def digest(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Documents have no roles: the first line of each stands for a prompt and bears no loss."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, loss=answer_spans(F.col("text"))))
