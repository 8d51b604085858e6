"""Removal of passages that repeat across documents, by FM-indexes over shards of the corpus.

A window is `window` consecutive words. A window's anchor is the least hash of the `gram`-word runs inside it, so
equal windows have equal anchors, wherever they stand, and neighbours mostly share one. Documents lie in parts of
PART_BYTES at most, in a table bucketed by part, and are worked on in chunks of CHUNK_BYTES.

1. Each chunk tells its distinct anchors once, with how many windows have them and whether several documents do.
   Anchors of one document alone are done with: no window of theirs repeats.
2. Runs of windows with one shared anchor (segments) go to the anchor's shard, equal ones of a chunk once, with the
   smallest and largest key of the documents that hold them. Windows of an anchor that over HOT windows have
   (a phrase in ever new surroundings) go each by its own hash, so no shard has to hold them all.
3. A shard indexes its distinct segments: the Burrows-Wheeler transform of their words in a wavelet matrix of packed
   bits, with each word window's smallest document key. Segments are streamed through it from right to left;
   extending a match by a word is a backward step, shortening it goes to the enclosing interval. Where a match reaches
   `window` words, its interval's smallest key tells whether an earlier document has it.
4. The windows found go back to their chunks, which drop the words that they cover.

Main cost: three passes over the texts without a shuffle of them. Anchors, four bytes each, about one for four
words, and the packed segments move. Words and windows are compared by 64-bit hashes, anchors may collide without harm.
Memory: a part's texts and a chunk's arrays, or a bucket of anchors or segments (buckets are four times the parts)
and an index over SHARD_BYTES of them or one key of at most HOT windows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, PandasCogroupedOps
from pyspark.sql import functions as F

from fovea.llm import textbytes
from fovea.llm.storage import keep
from fovea.sources.shared import keep_bucketed

CHUNK_BYTES = 8_000_000
PART_BYTES = 64_000_000
SHARD_BYTES = 2_500_000
HOT = 10_000
SEGMENT_WINDOWS = 64
MAX_BUCKETS = 10_000
_LAST = np.iinfo(np.int64).max  # stands for a null key: after all others
_MANY = 0x80


class Words:
    """Word hashes of some texts, and hashes of their runs."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        parts, counts, base, row = [], [np.zeros(1, np.int64)], 0, 0
        for _, _, data, offsets in textbytes.slices(texts):
            starts, ends, before = textbytes.word_spans(data, offsets)
            parts.append((data, starts + base, ends + base, textbytes.word_hashes(data, starts, ends, lower=False)))
            counts.append(before[1:] + row)
            base, row = base + len(data), row + len(starts)
        data, self.starts, self.ends, self.hashes = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint8, np.int64, np.int64, np.uint64))
        self.raw, self.counts, n = data.tobytes(), np.concatenate(counts), len(self.hashes)
        up, self._down = textbytes.powers(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * up[:n], out=self._total[1:])

    def runs(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of `size` words from the words `first` on."""
        return textbytes.mix((self._total[first + size] - self._total[first]) * self._down[first] + np.asarray(size).astype(np.uint64))

    def all_runs(self, size: int) -> np.ndarray:
        n = max(0, len(self.hashes) - size + 1)
        return textbytes.mix((self._total[size : n + size] - self._total[:n]) * self._down[:n] + np.uint64(size))


class Chunk(Words):
    """The windows of some documents: first word `at`, hash `windows`, `anchors`, key `keys` of their document."""

    def __init__(self, keys: np.ndarray, texts: pa.ChunkedArray, window: int, gram: int):
        super().__init__(texts)
        self.window, lengths = window, np.diff(self.counts)
        windows, grams = self.all_runs(window), self.all_runs(gram)
        n = len(windows)
        least = grams[:n].copy()
        for k in range(1, window - gram + 1):
            np.minimum(least, grams[k : n + k], out=least)
        inside = np.arange(n) + window <= np.repeat(self.counts[1:], lengths)[:n]
        self.at = np.flatnonzero(inside)
        self.windows, self.anchors = windows[self.at], textbytes.mix(least[self.at])  # mixed: least hashes crowd low
        self.keys = np.repeat(keys, lengths)[self.at]
        self.order = np.argsort(self.anchors, kind="stable")
        self.groups, self.sizes = _groups(self.anchors[self.order])

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, ascending; for each the bit length of its number of windows, and _MANY if several documents have it."""
        if not len(self.at):
            return self.anchors, np.zeros(0, np.uint8)
        keys = self.keys[self.order]
        many = np.minimum.reduceat(keys, self.groups) != np.maximum.reduceat(keys, self.groups)
        return self.anchors[self.order][self.groups], (np.frexp(self.sizes)[1] + _MANY * many).astype(np.uint8)

    def segments(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Shard key, smallest and largest document key, and text of each distinct segment. Flags by anchor: 1 shared, 2 hot."""
        flag = np.zeros(len(self.at), np.uint8)
        flag[self.order] = np.repeat(flags, self.sizes)
        cold = np.flatnonzero(flag == 1)
        ahead = np.ones(len(cold), bool)
        ahead[1:] = (np.diff(cold) != 1) | (np.diff(self.at[cold]) != 1) | (self.anchors[cold][1:] != self.anchors[cold][:-1])
        begin = np.flatnonzero(ahead)
        since = np.arange(len(cold)) - np.repeat(begin, np.diff(np.append(begin, len(cold))))
        begin = np.flatnonzero(since % SEGMENT_WINDOWS == 0)
        count = np.diff(np.append(begin, len(cold)))
        hot = np.flatnonzero(flag == 2)
        first = np.concatenate([cold[begin], hot])
        size = np.concatenate([count, np.ones(len(hot), np.int64)]) + self.window - 1
        shard = np.concatenate([self.anchors[cold[begin]], self.windows[hot]])
        content = self.runs(self.at[first], size)
        order = np.argsort(content, kind="stable")
        groups, _ = _groups(content[order])
        if not len(order):
            return shard, first, first, []
        keys, one = self.keys[first][order], order[groups]
        starts, ends = self.starts[self.at[first[one]]], self.ends[self.at[first[one]] + size[one] - 1]
        return shard[one], np.minimum.reduceat(keys, groups), np.maximum.reduceat(keys, groups), [self.raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]

    def covered(self, windows: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each word, whether a window covers it that starts in a document with a smaller key; `least` by window."""
        n = len(self.hashes)
        if not len(windows) or not len(self.at):
            return np.zeros(n, bool)
        order = np.argsort(windows, kind="stable")
        windows, least = windows[order], least[order]
        found = np.minimum(np.searchsorted(windows, self.windows), len(windows) - 1)
        gone = self.at[(windows[found] == self.windows) & (least[found] < self.keys)]
        edges = np.bincount(gone, minlength=n + 1) - np.bincount(gone + self.window, minlength=n + 1)
        return np.cumsum(edges[:n]) > 0


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit row for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, n = [], len(sequence)
        for bit in reversed(range(max(1, (symbols - 1).bit_length()))):
            ones = (sequence >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(ones, bitorder="little")
            blocks = packed.view(np.uint64)
            before = np.zeros(len(blocks), np.int64)
            np.cumsum(np.bitwise_count(blocks[:-1]), out=before[1:])
            self.levels.append((bit, n - int(ones.sum()), blocks, before))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.first = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, zeros, blocks, before in self.levels:
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = before[block] + np.bitwise_count(blocks[block] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.descend(symbol, at) - self.first[symbol]


class FMIndex:
    """Backward search in a text of symbols, 0 between its parts, for patterns of up to `depth` symbols.

    Suffixes are sorted by their first `depth` symbols at least, which is all that such patterns can tell apart.
    """

    def __init__(self, text: np.ndarray, depth: int):
        text = np.concatenate([text, np.zeros(2 * depth, np.int64)])
        self.depth, self.size, symbols = depth, len(text), int(text.max()) + 1
        rank, reach = text, 1
        while reach < depth + 1:
            ahead = np.zeros_like(rank)
            ahead[:-reach] = rank[reach:]
            rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]
            reach *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.matrix = WaveletMatrix(text[self.suffixes - 1], symbols)
        self.common = np.full(self.size + 1, -1, np.int64)  # symbols shared with the suffix before; -1 at both ends
        self.common[1:-1] = 0
        same = np.ones(self.size - 1, bool)
        for k in range(depth):
            here = text[np.minimum(self.suffixes + k, self.size - 1)]
            same &= here[1:] == here[:-1]
            self.common[1:-1] += same
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with a symbol put before them; empty where it never stands there."""
        base = self.smaller[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)

    def bounds(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, the interval of those that share its first `length` symbols."""
        if length not in self._bounds:
            cut = np.flatnonzero(self.common < length)
            group = np.cumsum(self.common[:-1] < length) - 1
            self._bounds[length] = cut[group], cut[group + 1]
        return self._bounds[length]

    def shorten(self, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        lows, highs = self.bounds(length)
        return lows[low], highs[high - 1]

    def matching_statistics(self, patterns: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the patterns, how far (up to depth) the text matches from there on, and a suffix that does.

        Pattern k is patterns[ends[k] - sizes[k] : ends[k]]; all go from right to left at once.
        """
        reached, found = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[order], sizes[order]
        low, high, length = np.zeros(len(ends), np.int64), np.full(len(ends), self.size), np.zeros(len(ends), np.int64)
        for step in range(int(sizes.max(initial=0))):
            k = int(np.searchsorted(-sizes, -step, side="left"))  # so many are longer than step
            low, high, length, at = low[:k], high[:k], length[:k], ends[:k] - 1 - step
            l, h = self.extend(patterns[at], low, high)
            for_good = np.zeros(k, bool)
            while len(lost := np.flatnonzero((l >= h) & ~for_good)):
                parent = np.where(length[lost] > 0, np.maximum(self.common[low[lost]], self.common[high[lost]]), -1)
                for size in np.unique(parent).tolist():
                    own = lost[parent == size]
                    if size < 0:
                        low[own], high[own], length[own], for_good[own] = 0, self.size, 0, True
                    else:
                        low[own], high[own] = self.shorten(low[own], high[own], size)
                        length[own] = size
                again = lost[~for_good[lost]]
                l[again], h[again] = self.extend(patterns[at[again]], low[again], high[again])
            low, high, length = np.where(for_good, 0, l), np.where(for_good, self.size, h), np.where(for_good, 0, length + 1)
            reached[at], found[at] = length, low
            full = np.flatnonzero(length == self.depth)  # the next symbol before it drops the last one
            low[full], high[full] = self.shorten(low[full], high[full], self.depth - 1)
            length[full] = self.depth - 1
        return reached, found


def search_shard(shard: pa.Table, window: int) -> pa.Table:
    """For each chunk with rows in the shard, the windows that a smaller document has, and that document's key."""
    texts, low, high = shard.column("words"), shard.column("low").to_numpy(), shard.column("high").to_numpy()
    words = Words(texts)
    sizes = np.diff(words.counts)
    _, one, own = np.unique(words.runs(words.counts[:-1], sizes), return_index=True, return_inverse=True)
    least = np.full(len(one), _LAST)
    np.minimum.at(least, own, low)
    symbols = np.unique(words.hashes, return_inverse=True)[1] + 1
    n = sizes[one]
    ends = np.cumsum(n + 1) - 1  # a 0 closes each segment
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    text[inside + np.repeat(ends - n, n)] = symbols[inside + np.repeat(words.counts[:-1][one], n)]
    index = FMIndex(text, window)
    reached, found = index.matching_statistics(text, ends, n)
    keys = np.full(index.size, _LAST)
    keys[: len(text)] = np.repeat(least, n + 1)
    cut = np.flatnonzero(index.common[:-1] < window)
    smallest = np.minimum.reduceat(keys[index.suffixes], cut)[np.cumsum(index.common[:-1] < window) - 1]
    first = np.where(reached == window, smallest[found], _LAST)  # by place of the distinct segments
    count = sizes - window + 1
    place = np.repeat((ends - n)[own], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    source = np.repeat(words.counts[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    gone = np.flatnonzero(first[place] < np.repeat(high, count))
    chunk = np.repeat(np.stack([shard.column("part").to_numpy(), shard.column("slice").to_numpy().astype(np.int64)], axis=1), count, axis=0)[gone]
    hashes, firsts = words.runs(source[gone], window), first[place[gone]]
    order = np.lexsort((chunk[:, 1], chunk[:, 0]))
    chunk, hashes, firsts = chunk[order], hashes[order], firsts[order]
    new = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]).any(axis=1)])) if len(chunk) else np.zeros(0, np.int64)
    stop = np.append(new[1:], len(chunk))[: len(new)]
    pieces = list(zip(new.tolist(), stop.tolist(), strict=True))
    return pa.table({"part": pa.array(chunk[new, 0], pa.int64()), "slice": pa.array(chunk[new, 1], pa.int32()), "windows": pa.array([hashes[a:b].tobytes() for a, b in pieces], pa.binary()), "firsts": pa.array([firsts[a:b].tobytes() for a, b in pieces], pa.binary())})


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _joined(table: pa.Table, piece: int, field: str, kind: type) -> np.ndarray:
    """What all rows of a chunk hold in `field`, by bucket where there are several."""
    rows = table.filter(pc.equal(table.column("slice"), piece))
    if "bucket" in rows.column_names:
        rows = rows.sort_by("bucket")
    return np.frombuffer(b"".join(rows.column(field).to_pylist()), kind)


def _packed(part: int, piece: int, shard: np.ndarray, low: np.ndarray, high: np.ndarray, words: list[bytes], buckets: int) -> pa.Table:
    """A chunk's segments, a row a bucket of shard keys."""
    order = np.argsort(shard, kind="stable")
    shard, low, high, words = shard[order], low[order], high[order], [words[k] for k in order.tolist()]
    starts, sizes = _groups(_bucket(shard, buckets))
    spans = list(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
    sizes = np.array([len(w) for w in words], np.int64)
    numbers = [_blob(shard[a:b], low[a:b], high[a:b] - low[a:b], sizes[a:b]) for a, b in spans]
    return pa.table({"bucket": pa.array(_bucket(shard[starts], buckets).astype(np.int32)), "part": pa.array([part] * len(spans), pa.int64()), "slice": pa.array([piece] * len(spans), pa.int32()), "numbers": pa.array(numbers, pa.binary()), "words": pa.array([zstandard.compress(b"".join(words[a:b]), 1) for a, b in spans], pa.binary())})


def _unpacked(table: pa.Table) -> pa.Table:
    """The segments of a bucket, by shard key."""
    shard, low, high, words, part, piece = [], [], [], [], [], []
    for p, s, numbers, text in zip(*(table.column(c).to_pylist() for c in ("part", "slice", "numbers", "words")), strict=True):
        own, first, wide, sizes = np.split(np.frombuffer(zstandard.decompress(numbers), np.int64), 4)
        shard.append(own.view(np.uint64))
        low.append(first)
        high.append(first + wide)
        text, ends = zstandard.decompress(text), np.cumsum(sizes)
        words += [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        part.append(np.full(len(own), p))
        piece.append(np.full(len(own), s, np.int32))
    shard, low, high, part, piece = (np.concatenate(c) for c in (shard, low, high, part, piece))
    order = np.argsort(shard, kind="stable")
    return pa.table({"shard": pa.array(shard[order]), "part": pa.array(part[order]), "slice": pa.array(piece[order]), "low": pa.array(low[order]), "high": pa.array(high[order]), "words": pa.array([words[k] for k in order.tolist()], pa.binary())})


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """The documents with part and slice (a chunk of the part), bucketed by part without a shuffle; and the number of buckets."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(1, min(source.rdd.getNumPartitions(), MAX_BUCKETS))
    numbers = dict(spark.range(64 * buckets).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket")).agg(F.min("id")).collect())
    first = list(numbers.values())  # one in each bucket, so buckets get equally many tasks' rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            before = size + np.cumsum(lengths) - lengths
            size += int(lengths.sum())
            part = before // part_bytes + ((number + 1) << 30)
            if number < len(first):
                part = np.where(before < part_bytes, first[number], part)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array((before // chunk_bytes).astype(np.int32)), *batch.columns], names=["part", "slice", "doc_id", "text"])

    return keep_bucketed(source.mapInArrow(cut, "part long, slice int, doc_id long, text string"), "part", buckets), buckets


def without_repeats(docs: DataFrame, window: int = 13, gram: int = 7, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept (its remaining words, joined by one space).

    A word is a run without ASCII white space, unchanged. It goes if a window of `window` words covers it that also
    starts in a row with a smaller key. Null or empty text has no words and an empty `kept`; texts shorter than a
    window lose nothing. Rows with equal keys don't take words from each other; a null key comes after all others
    and stays null. An empty table gives no rows. Other columns are ignored.
    """
    held, parts = chunks(docs, id_col, text_col, chunk_bytes, part_bytes)
    buckets = 4 * parts

    def cut(table: pa.Table) -> Iterator[tuple[int, int, pa.Table, Chunk]]:
        part = table.column("part")[0].as_py() if table.num_rows else 0
        for piece in sorted(pc.unique(table.column("slice")).to_pylist()):
            own = table.filter(pc.equal(table.column("slice"), piece))
            yield part, piece, own, Chunk(own.column("doc_id").fill_null(_LAST).to_numpy(), own.column("text"), window, gram)

    def tell(table: pa.Table) -> pa.Table:
        out = []
        for part, piece, _, chunk in cut(table):
            anchors, codes = chunk.told()
            bucket = _bucket(anchors, buckets)
            starts, sizes = _groups(bucket)
            low = anchors.astype("<u4")
            spans = list(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
            out.append(pa.table({"bucket": pa.array(bucket[starts].astype(np.int32)), "part": pa.array([part] * len(spans), pa.int64()), "slice": pa.array([piece] * len(spans), pa.int32()), "anchors": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), "codes": pa.array([codes[a:b].tobytes() for a, b in spans], pa.binary())}))
        return pa.concat_tables(out)

    def compare(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, "<u4") for x in table.column("anchors").to_pylist()]
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8)
        anchors = np.concatenate(rows)
        order = np.argsort(anchors, kind="stable")
        starts, sizes = _groups(anchors[order])
        codes = codes[order]
        windows = np.add.reduceat(np.int64(1) << (codes & (_MANY - 1)).astype(np.int64), starts)
        shared = (sizes > 1) | (np.maximum.reduceat(codes, starts) >= _MANY)
        flags = np.empty(len(anchors), np.uint8)
        flags[order] = np.repeat(shared * (1 + (windows >= 2 * hot)), sizes)
        ends = np.cumsum([len(r) for r in rows]).tolist()
        return pa.table({"part": table.column("part"), "slice": table.column("slice"), "bucket": table.column("bucket"), "flags": pa.array([flags[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})

    def segment(table: pa.Table, flags: pa.Table) -> pa.Table:
        out = [_packed(0, 0, *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)), [], buckets)]
        for part, piece, _, chunk in cut(table):
            out.append(_packed(part, piece, *chunk.segments(_joined(flags, piece, "flags", np.uint8)), buckets))
        return pa.concat_tables(out)

    def search(table: pa.Table) -> pa.Table:
        rows, out, at = _unpacked(table), [], 0
        ends = np.cumsum(pc.binary_length(rows.column("words")).to_numpy())
        cuts = np.append(_groups(rows.column("shard").to_numpy())[0][1:], rows.num_rows)
        while at < rows.num_rows:  # whole keys, up to shard_bytes or one key
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + shard_bytes, side="right"))
            fit = int(np.searchsorted(cuts, most, side="right"))
            stop = int(cuts[fit - 1]) if fit and cuts[fit - 1] > at else int(cuts[np.searchsorted(cuts, at, side="right")])
            out.append(search_shard(rows.slice(at, stop - at), window))
            at = stop
        return pa.concat_tables(out)

    def drop(table: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for _, piece, own, chunk in cut(table):
            gone = chunk.covered(_joined(found, piece, "windows", np.uint64), _joined(found, piece, "firsts", np.int64))
            removed = np.concatenate([[0], np.cumsum(gone)])[chunk.counts]
            kept = []
            for text, a, b, lost in zip(own.column("text"), chunk.counts[:-1].tolist(), chunk.counts[1:].tolist(), np.diff(removed).tolist(), strict=True):
                words = (text.as_py() or "").encode().split()
                kept.append(b" ".join(itertools.compress(words, (~gone[a:b]).tolist()) if lost else words))
            out.append(pa.table({"doc_id": own.column("doc_id"), "n_words": pa.array(np.diff(chunk.counts), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}))
        return pa.concat_tables(out)

    def beside(side: DataFrame) -> PandasCogroupedOps:
        """The texts by part with what belongs to it: dealt as they lie, so that they stay where they are."""
        return held.groupBy("part").cogroup(side.repartition(parts, "part").groupBy("part"))

    told = held.groupBy("part").applyInArrow(tell, "bucket int, part long, slice int, anchors binary, codes binary")
    flags = told.groupBy("bucket").applyInArrow(compare, "part long, slice int, bucket int, flags binary")
    segments = beside(flags).applyInArrow(segment, "bucket int, part long, slice int, numbers binary, words binary")
    found = segments.groupBy("bucket").applyInArrow(search, "part long, slice int, windows binary, firsts binary")
    return beside(keep(found)).applyInArrow(drop, "doc_id long, n_words long, n_removed long, kept string")
