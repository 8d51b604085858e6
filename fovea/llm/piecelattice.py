"""Encoding with a SentencePiece vocabulary as an N-best search over the piece lattice, and decoding.

A segmentation's score is the sum of its pieces' scores. Forward Viterbi gives, for every position, the best score
of any prefix up to there; from the end of the text, A-star then walks backward with those scores as exact
heuristics, so hypotheses leave the queue in order of their full score. Of equal ways to a position both take the one
with the shortest last piece.

Where no piece of the vocabulary runs over the start of a space or over a control character, those are cut points
that every path crosses: Viterbi runs on the distinct chunks between them, many at once in numpy, whose pieces one walk
down a tree of the vocabulary finds. It also tells what the cheapest detour of a chunk costs. The N best paths of a text
leave the best one in at most N - 1 chunks, all among those with the N - 1 cheapest detours; A-star lists the paths of
these, and their sums are merged best first.

Characters without a piece are spelled in byte pieces. One pass, no shuffle; chunks once seen are remembered in a
bounded cache.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
BYTE_PENALTY = 10.0
_LONGEST_IN_BATCH = 40
_FEWEST_IN_BATCH = 8
_BATCH_CHARS = 40_000
_PART_ROWS, _PART_CHARS = 500, 2_000_000
_HELD = 4_000_000
_NONE = float("-inf")
_ENCODED = "n_pieces long, ids_crc32 long, scores array<double>, n_best_pieces array<long>, n_best_crc32 array<long>, round_trip boolean"


def _cut(pieces: dict) -> re.Pattern:
    """Chunks of a text that no piece runs over: control characters no longer piece holds, and runs from one space to the next."""
    glued = {c for p in pieces if len(p) > 1 for c in p if c < " "}
    apart = "".join(f"\\x{k:02x}" for k in range(32) if chr(k) not in glued) or "\ud800"  # no text holds half a surrogate pair
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return re.compile(rf"[{apart}]|[^{apart}]+")
    return re.compile(rf"{SPACE}+[^{SPACE}{apart}]*|[{apart}]|[^{SPACE}{apart}]+")


class Tree:
    """The pieces' prefixes as nodes from 1 on. A node's children lie in one table, at its base plus their characters'
    numbers, so a step is one look-up for any number of nodes at once.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        nodes = {"": 0}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        numbers = {c: k + 1 for k, c in enumerate(sorted({p[-1] for p in nodes if p}))}  # 0: in no piece, or the end
        self.numbers = np.zeros(0x110000, np.int64)
        self.numbers[[ord(c) for c in numbers]] = list(numbers.values())
        self.ids, self.scores = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes))
        children: dict[int, list[tuple[int, int]]] = {}
        for prefix, node in nodes.items():
            if prefix:
                children.setdefault(nodes[prefix[:-1]], []).append((numbers[prefix[-1]], node))
            if prefix in pieces:
                self.ids[node], self.scores[node] = pieces[prefix]
        width = len(numbers) + 1
        self.base = np.zeros(len(nodes), np.int64)
        held: dict[int, tuple[int, int]] = {}
        first = width
        for node, below in sorted(children.items(), key=lambda x: -len(x[1])):
            at, tries = first, 0
            while any(at - below[0][0] + c in held for c, _ in below):
                at, tries = at + 1, tries + 1
            first += tries // 2  # where it is crowded a few places stay empty
            self.base[node] = at - below[0][0]
            held |= {at - below[0][0] + c: (node, child) for c, child in below}
        self.parent, self.child = np.full((2, max(held) + width + 1), -1, np.int64)
        self.parent[list(held)], self.child[list(held)] = np.array(list(held.values())).T

    def walk(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the starts and nodes of the pieces of that length, going down the columns of chars, whose last row is 0."""
        width, chars = chars.shape[1], chars.ravel()
        at, node, length = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        while len(at):
            slot = self.base[node] + chars[at + length * width]
            on = np.flatnonzero(self.parent[slot] == node)
            at, node, length = at[on], self.child[slot[on]], length + 1
            piece = np.flatnonzero(self.ids[node] >= 0)
            if len(piece):
                yield length, at[piece], node[piece]


class Lattice:
    """Piece scores of a vocabulary file, with the searches over them."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.pieces: dict[str, tuple[int, float]] = {}
        self.surface: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(read.get_piece_size()):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif read.is_control(i) or read.is_unknown(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = (i, read.get_score(i))
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.byte_score = min(s for _, s in self.pieces.values() if s > -1e8) - BYTE_PENALTY
        self.spelled = (-1, self.byte_score)
        # Every ending of a piece, with the piece's id and score: what isn't here is no piece, nor is anything that ends so.
        self.endings: dict[str, tuple[int, float]] = {}
        for piece in self.pieces:
            for k in range(len(piece)):
                self.endings.setdefault(piece[k:], (-1, _NONE) if len(piece) - k > 1 else self.spelled)
        self.endings.update(self.pieces)
        self.cut = _cut(self.pieces)
        self.tree = Tree(self.pieces)
        self._forget()

    def _forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.scores, self.detours = np.zeros(0), np.zeros(0)
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.ways: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.held = 0

    def _batch(self, words: list[str]) -> list[np.ndarray]:
        """Viterbi over chunks of one length at once, a column each: scores, detours, numbers of pieces, ids one chunk after another.

        A column whose best path holds a character without a piece has an id of -1.
        """
        size, n = len(words[0]), len(words)
        chars = np.zeros((size + 1, n), np.int64)
        chars[:-1] = self.tree.numbers[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")].reshape(n, size).T
        found = list(self.tree.walk(chars))
        longest = max([length for length, *_ in found], default=1)
        scores, ids = np.full((longest + 1, size * n), -np.inf), np.full((longest + 1, size * n), -1, np.int64)
        scores[1] = self.byte_score
        some = np.zeros((longest + 1, size), bool)
        for length, at, node in found:
            scores[length, at], ids[length, at] = self.tree.scores[node], self.tree.ids[node]
            some[length, at // n] = True
        best, second = np.zeros((size + 1, n)), np.full((size + 1, n), -np.inf)
        back = np.ones((size + 1, n), np.int64)
        scores = scores.reshape(-1, size, n)
        for i in range(1, size + 1):
            top, other = best[i], second[i]
            np.add(best[i - 1], scores[1, i - 1], out=top)
            for length in range(2, min(i, longest) + 1):
                if some[length, i - length]:
                    value = best[i - length] + scores[length, i - length]
                    np.maximum(other, np.minimum(value, top), out=other)
                    np.copyto(back[i], length, where=value > top)
                    np.maximum(value, top, out=top)
        best, second, back, ids = best.ravel(), second.ravel(), back.ravel(), ids.ravel()
        detour, taken, live, row = np.full(n, np.inf), np.full((n, size), -2, np.int64), np.arange(n), np.full(n, size)
        for k in range(size - 1, -1, -1):
            at = row * n + live
            step = back[at]
            detour[live] = np.minimum(detour[live], best[at] - second[at])
            taken[live, k] = ids[step * (size * n) + at - step * n]
            row = row - step
            on = np.flatnonzero(row)
            if not len(on):
                break
            live, row = live[on], row[on]
        pieces = taken > -2
        return [best[-n:], detour, pieces.sum(axis=1), taken[pieces]]

    def _forward(self, text: str) -> tuple[array, array, array, array]:
        """For every position the best score of the text before it and of another last piece, that piece's length and id."""
        known, spelled = self.endings.get, self.spelled
        best, second, lengths, last = array("d", [0.0]), array("d", [_NONE]), array("i", [0]), array("i", [-1])
        for i in range(1, len(text) + 1):
            piece, s = known(text[i - 1], spelled)
            top, other, start = best[i - 1] + s, _NONE, i - 1
            for j in range(i - 2, -1, -1):
                found = known(text[j:i])
                if found is None:
                    break
                value = best[j] + found[1]
                if value > top:
                    other, top, start, piece = top, value, j, found[0]
                elif value > other:
                    other = value
            best.append(top)
            second.append(other)
            lengths.append(i - start)
            last.append(piece)
        return best, second, lengths, last

    def _viterbi(self, text: str) -> tuple[float, float, np.ndarray]:
        """Score of the best segmentation, how much less the next one scores, and the best one's ids."""
        best, second, lengths, last = self._forward(text)
        i, detour, ids = len(text), np.inf, array("i")
        while i:
            detour = min(detour, best[i] - second[i])
            ids.extend((last[i],) if last[i] >= 0 else self._spell(text[i - 1])[::-1])
            i -= lengths[i]
        return best[-1], detour, np.array(ids, np.int64)[::-1]

    def _spell(self, char: str) -> tuple[int, ...]:
        return tuple(int(self.byte_ids[b]) for b in char.encode("utf-8", "surrogatepass"))

    def arcs(self, text: str, i: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The pieces that end at position i: start, score, ids. A character without one is spelled in bytes."""
        out = []
        for j in range(i - 1, -1, -1):
            piece = text[j:i]
            found = self.pieces.get(piece)
            if found:
                out.append((j, found[1], (found[0],)))
            elif j == i - 1:
                out.append((j, self.byte_score, self._spell(piece)))
            if piece not in self.endings:
                break
        return out[::-1]

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n segmentations of highest score, ids first to last; fewer if there are fewer.

        A queue entry is a partial path and the best of its extensions not tried yet, so a step adds two entries at
        most. Of equal scores the newest goes first: ties are walked depth first, and n paths cost about n times the
        text's length. Only Viterbi scores are held for every position; extensions are made when an entry's turn comes.
        """
        best = self._forward(text)[0]
        out: list[tuple[float, tuple[int, ...]]] = []
        order = 0
        queue: list[tuple] = []

        def offer(score: float, i: int, k: int, path: tuple) -> None:
            nonlocal order
            order += 1
            heapq.heappush(queue, (-score, -order, i, k, after, path))

        if not text:
            return [(0.0, ())]
        after = 0.0
        offer(best[-1], len(text), 0, ())
        while queue and len(out) < n:
            _, _, i, k, after, path = heapq.heappop(queue)
            ranked = sorted(((best[j] + s, j, s, ids) for j, s, ids in self.arcs(text, i)), key=lambda x: (-x[0], -x[1]))
            if k + 1 < len(ranked):
                offer(ranked[k + 1][0] + after, i, k + 1, path)
            _, j, s, ids_here = ranked[k]
            after += s
            path = (ids_here, path)
            if j:
                offer(best[j] + after, j, 0, path)
                continue
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((after, tuple(ids)))
        return out

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def prepare(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The number of every chunk of the texts, after Viterbi for those that aren't in the cache."""
        if self.held > _HELD:
            self._forget()
        known = len(self.numbers)
        out = [np.fromiter(map(self.numbers.__getitem__, t), np.int64, len(t)) for t in texts]
        words = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.held += int(sizes.sum())
        order = np.argsort(sizes, kind="stable")
        ranks, found, alone = [], [], []
        for k in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(k) < _FEWEST_IN_BATCH or sizes[k[0]] > _LONGEST_IN_BATCH:
                alone += k.tolist()
                continue
            step = max(1, _BATCH_CHARS // int(sizes[k[0]]))
            for j in range(0, len(k), step):
                made = self._batch([words[w] for w in k[j : j + step].tolist()])
                bare = np.repeat(np.arange(len(made[0])), made[2])[made[3] < 0]
                if len(bare):
                    keep = np.ones(len(made[0]), bool)
                    keep[bare] = False
                    alone += k[j : j + step][~keep].tolist()
                    made = [made[0][keep], made[1][keep], made[2][keep], made[3][np.repeat(keep, made[2])]]
                    ranks.append(k[j : j + step][keep])
                else:
                    ranks.append(k[j : j + step])
                found.append(made)
        if alone:
            made = [self._viterbi(words[w]) for w in alone]
            ranks.append(np.array(alone))
            found.append([*(np.array([m[k] for m in made]) for k in range(2)), np.array([len(m[2]) for m in made]), np.concatenate([m[2] for m in made])])
        if words:
            back = np.argsort(np.concatenate(ranks))
            scores, detours, counts, ids = (np.concatenate([f[k] for f in found]) for k in range(4))
            starts = len(self.ids) + np.cumsum(counts) - counts
            for name, new in (("scores", scores), ("detours", detours), ("counts", counts), ("starts", starts)):
                setattr(self, name, np.concatenate([getattr(self, name), new[back]]))
            self.ids = np.concatenate([self.ids, ids.astype("<u4")])
        return out

    def _detours(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The n best ways through a chunk: what each scores less than the best, and its ids."""
        found = self.ways.get((chunk, n))
        if found is None:
            ways = self.n_best(chunk, n)
            found = self.ways[chunk, n] = [(ways[0][0] - s, np.array(ids, "<u4").tobytes()) for s, ids in ways]
            self.held += n * len(chunk)
        return found

    def paths(self, chunks: list[str], numbers: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """The n segmentations of highest score of prepared chunks, best first: score, ids as 32-bit little-endian bytes.

        Of detours that cost the same those further left are listed.
        """
        if not chunks:
            return [(0.0, b"")]
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        whole = self.ids[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(ends[-1])].tobytes()
        best = float(self.scores[numbers].sum())
        if n == 1:
            return [(best, whole)]
        costs = self.detours[numbers]
        near = min(n - 1, len(costs))
        near = np.flatnonzero(costs <= np.partition(costs, near - 1)[near - 1])
        near = np.sort(near[np.argsort(costs[near], kind="stable")][: n - 1])
        near = near[np.isfinite(costs[near])].tolist()
        lists = [self._detours(chunks[k], n) for k in near]
        cuts = [0, *(x for k in near for x in (4 * int(ends[k] - counts[k]), 4 * int(ends[k]))), len(whole)]
        kept = [whole[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        out, queue, met = [], [(0.0, (0,) * len(lists))], set()
        while queue and len(out) < n:
            cost, at = heapq.heappop(queue)
            out.append((best - cost, kept[0] + b"".join(ways[i][1] + after for ways, i, after in zip(lists, at, kept[1:], strict=True))))
            for k, ways in enumerate(lists):
                if at[k] + 1 < len(ways):
                    after = (*at[:k], at[k] + 1, *at[k + 1 :])
                    if after not in met:
                        met.add(after)
                        heapq.heappush(queue, (cost - ways[at[k]][0] + ways[at[k] + 1][0], after))
        return out

    def encode(self, chunks: list[str], n: int) -> tuple[np.ndarray, list[float]]:
        """Ids of the best segmentation, and the scores of the n best."""
        found = self.paths(chunks, self.prepare([chunks])[0], n)
        return np.frombuffer(found[0][1], "<u4"), [s for s, _ in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces as the bytes they spell, the first space dropped."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_lattices: dict[str | None, Lattice] = {}


def lattice(path: str | None = None) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts that hold some million characters, or one longer text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > _PART_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    yield part


def encode(docs: DataFrame, n: int = 3, model: str | None = None, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The rows of docs, text replaced by: n_pieces, ids_crc32 (of the best segmentation's ids, unsigned little-endian
    32-bit), scores, n_best_pieces and n_best_crc32 (of the n best segmentations, best first; fewer if fewer exist),
    round_trip (whether decoding the best gives the text back; it can't where the text itself holds the space mark),
    and, if asked for, ids (array<int>, of the best) and n_best_ids (of all n).

    Null and empty texts have no pieces and the one score 0. Whole texts are segmented. Repeated rows and null keys
    give a row each; columns of these names are replaced.
    """
    lists = ["ids array<int>", "n_best_ids array<array<int>>"]
    made = [*_ENCODED.split(", "), *(lists if with_ids else [])]
    names = [c.split()[0] for c in made]
    docs = docs.drop(*names, *(c.split()[0] for c in lists))
    others = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = lattice(model)
        for batch in batches:
            for part in (batch.slice(k, _PART_ROWS) for k in range(0, batch.num_rows, _PART_ROWS)):
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                found, back = [], []
                for some in _parts(texts):
                    cut = [search.chunks(t) for t in some]
                    found += [search.paths(c, numbers, n) for c, numbers in zip(cut, search.prepare(cut), strict=True)]
                    back += [search.decode(np.frombuffer(f[0][1], "<u4")) == t for f, t in zip(found[len(back) :], some, strict=True)]
                sizes = [[len(ids) // 4 for _, ids in paths] for paths in found]
                sums = [[zlib.crc32(ids) for _, ids in paths] for paths in found]
                columns = [
                    pa.array([k[0] for k in sizes], pa.int64()),
                    pa.array([k[0] for k in sums], pa.int64()),
                    pa.array([[s for s, _ in paths] for paths in found], pa.list_(pa.float64())),
                    pa.array(sizes, pa.list_(pa.int64())),
                    pa.array(sums, pa.list_(pa.int64())),
                    pa.array(back, pa.bool_()),
                ]
                if with_ids:
                    ids = [[np.frombuffer(i, "<i4") for _, i in paths] for paths in found]
                    columns.append(pa.array([i[0] for i in ids], pa.list_(pa.int32())))
                    columns.append(pa.array(ids, pa.list_(pa.list_(pa.int32()))))
                left = [part.column(part.schema.get_field_index(f.name)) for f in others]
                yield pa.RecordBatch.from_arrays([*left, *columns], names=[*(f.name for f in others), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *made])
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows with text string in place of the ids; null ids give null, no ids the empty text."""
    rows = rows.drop("text")
    others = [f for f in rows.schema.fields if f.name != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = lattice(model)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if i is None else search.decode(np.array(i, np.int64)) for i in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in others), pa.array(texts, pa.string())], names=[*(f.name for f in others), "text"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text string"]))
