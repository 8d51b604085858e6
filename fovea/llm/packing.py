"""Packing of tokenised documents into fixed windows by bounded-space online best fit.

Each task walks its documents once. A document's ids are cut into whole windows and one rest. The rest
goes to the open window that it fills best; at most `open_windows` stay open. When none has room, the
fullest is topped up with the head of the rest, so it leaves full, and the tail is placed again.
Windows still open when a task ends are merged: their pieces are dealt into `merge_tasks` groups, each
laid end to end over new windows. The last, partly filled window of a group is cut at powers of two,
which need no padding.

Main cost: one pass over the text without a shuffle. Only what open windows hold moves, at most
open_windows * window ids a task, so memory and shuffle don't depend on document counts or skew.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.llm.storage import keep

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(name.split()[0], pa.int64()) for name in PIECE.split(", ")] + [("ids", pa.binary())])
# Fixed value: the vocabulary's added token, one id wherever a text spells it; its id follows those of the ranks.
END_OF_TEXT = "<|endoftext|>"
_encoders: dict[str, tiktoken.Encoding] = {}
_plain: dict[str, tokenizers.Tokenizer] = {}


def encoder(path: str | None = None) -> tiktoken.Encoding:
    """The 50k byte-level BPE. Its rank file holds the vocabulary of byte_bpe_50k.json and gives the same ids, faster."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines)}
        _encoders[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
    return _encoders[path]


def ids_of(text: str | None, ranks: str | None = None) -> np.ndarray:
    """The text's ids. The fast library's pattern gives up on white space of some hundred thousand characters; such texts go to the slower one."""
    if not text:
        return np.zeros(0, np.uint32)
    try:
        return encoder(ranks).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(plain_encoder(ranks).encode(text, add_special_tokens=False).ids, np.uint32)


def plain_encoder(ranks: str | None = None) -> tokenizers.Tokenizer:
    """The same vocabulary from its tokenizers file, beside the rank file."""
    import public_tokenizers

    path = f"{ranks.removesuffix('.tiktoken')}.json" if ranks else public_tokenizers.path("byte_bpe_50k.json")
    if path not in _plain:
        _plain[path] = tokenizers.Tokenizer.from_file(path)
    return _plain[path]


class _Windows:
    """The open windows of one task, ordered by fill."""

    def __init__(self, window: int, most: int, first_id: int):
        self.window, self.most, self.next_id = window, most, first_id
        self.fills: list[tuple[int, int]] = []  # (fill, sequence)
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def piece(self, doc, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> tuple:
        return (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.done.append((*self.piece(doc, start, ids[start : start + self.window], total, self.new(), 0), None))
        if whole < total:
            self.place(doc, whole, ids[whole:], total)

    def place(self, doc, start: int, rest: np.ndarray, total: int) -> None:
        at = bisect_left(self.fills, (self.window - len(rest) + 1, -1)) - 1  # the fullest that still has room
        if at >= 0 and (len(self.fills) >= self.most or self.fills[at][0] + len(rest) == self.window):
            fill, sequence = self.fills.pop(at)
        elif len(self.fills) < self.most:
            fill, sequence = 0, self.new()
            self.held[sequence] = []
        else:
            fill, sequence = self.fills.pop()
            head = self.window - fill
            self.held[sequence].append((*self.piece(doc, start, rest[:head], total, sequence, fill), None))
            self.done += [(*p[:7], None) for p in self.held.pop(sequence)]
            return self.place(doc, start + head, rest[head:], total)
        self.held[sequence].append((*self.piece(doc, start, rest, total, sequence, fill), rest.tobytes()))
        if fill + len(rest) == self.window:
            self.done += [(*p[:7], None) for p in self.held.pop(sequence)]
        else:
            insort(self.fills, (fill + len(rest), sequence))
        return None


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, window: int = 1024, open_windows: int = 64, merge_tasks: int | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, its closing `end_id` included, lies in exactly one piece; pieces lie gapless in
    their sequence. Null or empty text is the closing id alone. Repeated rows are packed once each; a null key
    stays null. An empty table gives no rows. Other columns are ignored. `merge_tasks` groups share the leftovers
    (default: one for each 64 tasks); sequence ids are unique, not dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Windows(window, open_windows, (TaskContext.get().partitionId() + 1) << 36)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state.add(doc, np.append(ids_of(text.as_py(), ranks), end_id).astype("<u4"))
                if len(state.done) >= 20_000:
                    yield _batches(state.done)
                    state.done = []
        rows = state.done + [p for pieces in state.held.values() for p in pieces]
        if rows:
            yield _batches(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = (1 << 60) + (TaskContext.get().partitionId() << 36)
        fill, cut, held = 0, [], []
        for batch in batches:
            for doc, start, _, _, total, _, _, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u4")
                while len(ids):
                    head = ids[: window - fill]
                    held.append((doc, start, head, total, fill))
                    fill, start, ids = fill + len(head), start + len(head), ids[len(head) :]
                    if fill == window:
                        cut += [(d, s, len(x), zlib.crc32(x.tobytes()), t, group, o, None) for d, s, x, t, o in held]
                        fill, held, group = 0, [], group + 1
            if cut:
                yield _batches(cut)
                cut = []
        bounds, low = [0], 0
        for bit in reversed(range(window.bit_length())):
            if fill >> bit & 1:
                low += 1 << bit
                bounds.append(low)
        for k, (first, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            for d, s, x, t, o in held:
                a, b = max(first, o) - o, min(end, o + len(x)) - o
                if a < b:
                    cut.append((d, s + a, b - a, zlib.crc32(x[a:b].tobytes()), t, group + k, o + a - first, None))
        if cut:
            yield _batches(cut)

    first = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"{PIECE}, ids binary"))
    tasks = docs.rdd.getNumPartitions() if merge_tasks is None else 0
    left = first.where("ids is not null").repartition(merge_tasks or max(1, tasks // 64), "sequence_id")
    return first.where("ids is null").drop("ids").unionByName(left.mapInArrow(merge, f"{PIECE}, ids binary").drop("ids"))
