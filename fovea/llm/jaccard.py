"""Near duplicates by Jaccard similarity of word shingle sets, found with an R-tree over count vectors.

A text's shingles are hashed into groups, about one for each three (ten in long texts); the counts by group are a point. The number of
groups is a power of two, so a finer point folds to a coarser one. Two texts share at most the sum of the coordinate
minima of their points, and a text and all members of a tree node share at most that of the point and the node's
upper corner. A checksum of each group's members sharpens the bound between two points: equal counts of unlike
members share at least one less. Pairs and nodes whose bound is too low for the threshold go; what survives is
verified on the full sets.

How this spreads over a cluster:
1. Texts with one shingle set form a class; from here on a class counts once, however many copies it has.
2. Two sets similar enough share a shingle among the first (1 - threshold) of each in any fixed order. That head
   routes classes to trees, losing no pair. The order puts shingles met often anywhere in the corpus last, so
   passages that many texts share route nothing. From their first common shingle on two sets share at most what is
   left of either; a route of two whose sets have too little left there is dropped, for a similar pair is met at its
   first common shingle.
3. Only components are asked for, and families of near copies have links without number. So two cheap rounds join
   most of a family first: every class is held against the class it shares most routes with, then, in its two most
   crowded open routes, against its neighbours in a random order of the route, of which the likeliest three are
   verified. Their output is a few rows a class.
4. What routes still hold several components get trees, one for each band of set sizes, and all surviving pairs of
   different components are verified: this round is exhaustive. A node whose members are all of the asker's
   component is skipped. Routes with the same members need one tree; a route of two went with the first round.
5. A route or band over `ROUTE_BYTES` of points is dealt into blocks by a hash of the class, and a tree task gets two
   blocks (or one with itself), so no task holds more and each pair is tested once. The members of the largest
   component need no link with each other: their blocks meet only the others'. A family of any size thus costs as
   much as it has rows; a hot route of unlinked classes costs a block pair for each two blocks.
6. Links feed connected components.

Shuffled: the routes (four numbers each), folded points of candidate classes, full points and checksum vectors of what
those allow, and the sets of what is left, once for each route with such a pair. Nothing but the `max_common` commonest shingles reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.llm import textbytes
from fovea.llm.graph import components
from fovea.llm.storage import Scratch, give_back, keep

LEAST_GROUPS, MOST_GROUPS = 32, 8192
GLANCE_GROUPS = 64
ROUTE_BYTES = 10_000_000
BAND_ROWS = 2_000
TASK_BYTES = 8_000_000
CROWD = 8
NEIGHBOURS = 32
NEIGHBOUR_ROUTES = 2
MAX_COMMON = 100_000
BROADCAST_BYTES = 8_000_000
_MET = 200_000
_RUN_BYTES = 8_000_000
_LEAST_IN_RUN = 4
_CELLS = 4_000_000
_NO_BOUND = 1 << 30


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted shingle hashes of each text."""
    for first, _, data, offsets in textbytes.slices(texts):
        starts, ends, counts = textbytes.word_spans(data, offsets)
        words = textbytes.word_hashes(data, starts, ends)
        for k, found in enumerate(textbytes.all_shingles(words, counts, size)):
            yield first + k, found


def _class(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _point(found: np.ndarray) -> bytes:
    """Counts by group, then a checksum of each group's members: at most 2 bytes an element beyond a least size."""
    n = len(found)
    groups = max(LEAST_GROUPS, 1 << (n // 4).bit_length()) if n < 512 else min(MOST_GROUPS, max(256, 1 << (n // 16).bit_length()))
    at = (found & np.uint64(groups - 1)).astype(np.int64)
    counts = np.bincount(at, minlength=groups)
    marks = np.zeros(groups, np.uint8)
    np.bitwise_xor.at(marks, at, (found >> np.uint64(56)).astype(np.uint8))
    if counts.max() >= 255:  # no bound: all pass
        return b"\xff" * (2 * groups)
    return counts.astype(np.uint8).tobytes() + marks.tobytes()


def _fine(found: np.ndarray) -> bytes:
    """A fine checksum vector: up to two elements a group, a byte a group."""
    out = np.zeros(1 << (len(found).bit_length() - 1), np.uint8)
    np.bitwise_xor.at(out, (found & np.uint64(len(out) - 1)).astype(np.int64), (found >> np.uint64(56)).astype(np.uint8))
    return out.tobytes()


def _glance(point: bytes) -> bytes:
    """The point folded to `GLANCE_GROUPS`, or to the fewest groups beyond whose counts have a place in a byte."""
    groups = min(len(point) // 2, GLANCE_GROUPS)
    if max(point[: len(point) // 2]) == 255:
        return b"\xff" * (2 * groups)
    raw = np.frombuffer(point, np.uint8).reshape(2, -1)
    while (counts := raw[0].reshape(-1, groups).sum(axis=0, dtype=np.int32)).max() >= 255:
        groups *= 2
    return counts.astype(np.uint8).tobytes() + np.bitwise_xor.reduce(raw[1].reshape(-1, groups), axis=0).tobytes()


def _points(cells: list[bytes], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and checksums of points of at least so many groups, folded to that many. A count of 255 says that the point
    is no bound: it counts as more than any set holds, without checksums."""
    lengths = np.array([len(c) for c in cells]) // 2
    counts, marks = np.empty((len(cells), groups), np.int32), np.empty((len(cells), groups), np.uint8)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join([cells[k] for k in at]), np.uint8).reshape(len(at), 2, n // groups, groups)
        counts[at] = raw[:, 0].sum(axis=1, dtype=np.int32)
        marks[at] = np.bitwise_xor.reduce(raw[:, 1], axis=1)
        none = at[(raw[:, 0] == 255).any(axis=(1, 2))]
        counts[none], marks[none] = _NO_BOUND, 0
    return counts, marks


def most_shared(x: np.ndarray, mx: np.ndarray, y: np.ndarray, my: np.ndarray) -> np.ndarray:
    """Row by row the most that two sets share: coordinate minima, one less where equal counts have other checksums."""
    low = np.minimum(x, y)
    return low.sum(axis=1) - ((x == y) & (mx != my)).sum(axis=1)


def _shared(p: list[bytes], q: list[bytes]) -> np.ndarray:
    """The most that each p and q can share."""
    groups = np.array([min(len(x), len(y)) // 2 for x, y in zip(p, q, strict=True)])
    out = np.zeros(len(p), np.int64)
    for g in np.unique(groups).tolist():
        rows = np.flatnonzero(groups == g)
        for at in (rows[k : k + _CELLS // g] for k in range(0, len(rows), _CELLS // g)):
            out[at] = most_shared(*_points([p[k] for k in at], g), *_points([q[k] for k in at], g))
    return out


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """For each document its set's size, class, point and checksums; and apart from those, shingles met often inside a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("point", pa.binary()), ("fine", pa.binary()), ("token", pa.int64()), ("often", pa.int64())])

    def common(run: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(run), return_counts=True)
        often = times >= _LEAST_IN_RUN
        none = pa.nulls(int(often.sum()))
        return pa.RecordBatch.from_arrays([*(none.cast(t) for t in schema.types[:5]), pa.array(tokens[often].view(np.int64)), pa.array(times[often])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            rows = []
            for _, found in _sets(batch.column(1), size):
                rows.append((len(found), _class(found), _point(found), _fine(found)) if len(found) else (0, None, None, None))
                held.append(found)
                size_held += 8 * len(found)
                if size_held >= _RUN_BYTES:
                    yield common(held)
                    held, size_held = [], 0
            if rows:
                n, cls, *cells = zip(*rows, strict=True)
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *(pa.array(c, pa.binary()) for c in cells), none, none], schema=schema)
        if held:
            yield common(held)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, class long, point binary, fine binary, token long, often long")


def _routes(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """token, class, size: the head of each class's set; size is 256 times the number of its elements and, in 255ths,
    rounded up, the share of them from the token on. Copies inside a task are left out, they add nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = shared.value, set()

        def rows(heads: list[np.ndarray], owners: list[tuple[int, int]]) -> pa.RecordBatch:
            each = np.repeat(np.array(owners, np.int64), [len(h) for h in heads], axis=0)
            rest = np.concatenate([n - np.arange(len(h)) for h, (_, n) in zip(heads, owners, strict=True)])
            columns = (np.concatenate(heads).view(np.int64), each[:, 0].copy(), each[:, 1] * 256 - -255 * rest // each[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "class", "size"])

        for batch in batches:
            heads, owners, held = [], [], 0
            for _, found in _sets(batch.column(1), size):
                n = len(found)
                if n == 0 or (cls := _class(found)) in met:
                    continue
                if len(met) >= _MET:
                    met.clear()
                met.add(cls)
                if len(last):
                    often = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
                    found = np.concatenate([found[~often], found[often]])
                head = found[: n - -(-percent * n // 100) + 1].copy()
                heads.append(head)
                owners.append((cls, n))
                held += len(head)
                if held >= 100_000:
                    yield rows(heads, owners)
                    heads, owners, held = [], [], 0
            if heads:
                yield rows(heads, owners)
        give_back()

    return docs.mapInArrow(run, "token long, class long, size long")


def may_link(shared: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements can be similar enough when they share at most `shared`."""
    return 100 * shared >= percent * (n + m - shared)


class CountTree:
    """An R-tree over count vectors, bulk loaded: sorted by set size, then in tiles by owner and the first coordinates.

    apart: (rows, labels); two rows that have the same label of a kind, one of at least 0, are no pair. The first kind is the owner.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, apart: np.ndarray, marks: np.ndarray | None = None, fan: int = 16):
        slab = max(fan, fan * math.isqrt(max(1, len(sizes) // fan)))
        by_size = np.argsort(sizes, kind="stable")
        apart = apart if apart.ndim == 2 else apart[:, None]
        self.order = np.concatenate([s[np.lexsort((points[s, 1], points[s, 0], apart[s, 0]))] for s in (by_size[k : k + slab] for k in range(0, len(by_size), slab))]) if len(sizes) else by_size
        self.fan = fan
        self.marks = np.zeros_like(points, dtype=np.uint8) if marks is None else marks
        self.marks = self.marks[self.order]
        labels = np.stack([np.unique(c, return_inverse=True)[1] if k == 0 else c for k, c in enumerate(apart.T)], axis=1)[self.order]
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], labels)]  # upper corner, least and most elements, the one label of a kind or -1
        while len(self.levels[-1][0]) > fan:
            high, low_n, high_n, labels = self.levels[-1]
            at = np.arange(0, len(high), fan)
            low, top = np.minimum.reduceat(labels, at, axis=0), np.maximum.reduceat(labels, at, axis=0)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at), np.where(low == top, low, -1)))

    def pairs(self, percent: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that survive the bounds and that no label forbids, each pair once."""
        points, sizes, _, own = self.levels[0]
        chunk = max(1, _CELLS // points.shape[1])
        for first in range(0, len(sizes), block):
            q = np.arange(first, min(first + block, len(sizes)))
            nodes = len(self.levels[-1][0])
            ask, node = np.repeat(q, nodes), np.tile(np.arange(nodes), len(q))
            for depth in range(len(self.levels) - 1, -1, -1):
                high, low_n, high_n, labels = self.levels[depth]
                if depth < len(self.levels) - 1:
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    ask = np.repeat(ask, self.fan)
                    ask, node = ask[node < len(high)], node[node < len(high)]
                reach = (node + 1) * self.fan**depth > ask  # later members only
                for kind in range(own.shape[1]):
                    reach &= (labels[node, kind] != own[ask, kind]) | (own[ask, kind] < 0)
                ask, node = ask[reach], node[reach]
                kept = []
                for k in range(0, len(ask), chunk):
                    a, b = ask[k : k + chunk], node[k : k + chunk]
                    least = np.maximum(low_n[b], -(-percent * sizes[a] // 100))
                    fits = (least <= high_n[b]) & (100 * sizes[a] >= percent * low_n[b])
                    a, b, least = a[fits], b[fits], least[fits]
                    shared = np.minimum(points[a], high[b]).sum(axis=1) if depth else most_shared(points[a], self.marks[a], high[b], self.marks[b])
                    fits[fits] = may_link(shared, sizes[a], least, percent)
                    kept.append(fits)
                fits = np.concatenate(kept) if kept else np.zeros(0, bool)
                ask, node = ask[fits], node[fits]
            good = ask < node
            if good.any():
                yield self.order[ask[good]], self.order[node[good]]


def _glances_link(x: list[tuple], y: list[tuple], percent: int) -> np.ndarray:
    """What folded points allow, of (size, point)."""
    n, m = (np.array([c[0] for c in side], np.int64) for side in (x, y))
    return may_link(_shared([c[1] for c in x], [c[1] for c in y]), n, m, percent)


def _codes_link(x: list[tuple], y: list[tuple], percent: int) -> np.ndarray:
    """What points and fine checksums allow, of (size, point, fine): every group that differs holds an element the sets don't share."""
    n, m = (np.array([c[0] for c in side], np.int64) for side in (x, y))
    good = may_link(_shared([c[1] for c in x], [c[1] for c in y]), n, m, percent)
    for k in np.flatnonzero(good).tolist():
        a, b = (np.frombuffer(c[k][2], np.uint8) for c in (x, y))
        width = min(len(a), len(b))
        if len(a) != len(b):
            a, b = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (a, b))
        good[k] = may_link((n[k] + m[k] - np.count_nonzero(a != b)) // 2, n[k], m[k], percent)
    return good


def _sets_link(x: list[tuple], y: list[tuple], percent: int) -> np.ndarray:
    good = np.zeros(len(x), bool)
    for k, ((p,), (q,)) in enumerate(zip(x, y, strict=True)):
        a, b = (np.frombuffer(v, np.uint64) for v in (p, q))
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        good[k] = may_link(int((b[at] == a).sum()), len(a), len(b), percent)
    return good


_KEY = ["bucket", "cut", "i", "j"]


def _dealt(pairs: DataFrame, keep: Callable) -> DataFrame:
    """The pairs (a, b, n_a, n_b, cluster) with the task that is to check them.

    Pairs of one cluster share a task, so a class is sent once for all its pairs there; too large a cluster is cut
    in blocks, and a class goes to the block pairs that need it.
    """
    pairs = keep(pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.min("cluster").alias("cluster")))
    loads = pairs.groupBy("cluster").agg((F.sum(F.col("n_a") + F.col("n_b")) * 8).alias("bytes"))
    total = pairs.agg(F.sum(F.col("n_a") + F.col("n_b")) * 8).first()[0] or 0
    dealt = pairs.join(loads, "cluster").withColumn("blocks", F.ceil(F.col("bytes") / TASK_BYTES).cast("int"))
    block = {k: F.pmod(F.xxhash64(k), F.col("blocks")).cast("int") for k in ("a", "b")}
    bucket = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-total // TASK_BYTES))))).otherwise(F.col("cluster"))
    return dealt.select(bucket.alias("bucket"), (F.col("blocks") > 1).alias("cut"), F.least(*block.values()).alias("i"), F.greatest(*block.values()).alias("j"), "a", "b")


def _goes(dealt: DataFrame, keep: Callable, lookup: DataFrame | None = None) -> DataFrame:
    """The tasks that each class goes to, for a broadcast if that is small; with the columns of `lookup` by class."""
    goes = dealt.select(*_KEY, F.col("a").alias("class")).union(dealt.select(*_KEY, "b")).distinct()
    goes = keep(goes if lookup is None else goes.join(lookup, "class"))
    return F.broadcast(goes) if goes.count() * 48 <= BROADCAST_BYTES else goes


def _checked(dealt: DataFrame, coded: DataFrame, accept: Callable) -> DataFrame:
    """The dealt pairs of classes that accept(codes of a, codes of b). coded: a row for each class and task that it goes to, its code the last columns."""

    def check(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        at = {c: k for k, c in enumerate(held["class"].to_pylist())}
        columns = [held[k].combine_chunks() for k in range(5, held.num_columns)]
        i, j = (np.array([at.get(c, -1) for c in asked[side].to_pylist()], np.int64) for side in ("a", "b"))
        good = (i >= 0) & (j >= 0)
        rows = np.flatnonzero(good)
        for part in (rows[k : k + 1000] for k in range(0, len(rows), 1000)):
            x, y = ([tuple(c[k].as_py() for c in columns) for k in side[part].tolist()] for side in (i, j))
            good[part] = accept(x, y)
        return asked.filter(pa.array(good, pa.bool_()))

    return dealt.groupBy(*_KEY).cogroup(coded.groupBy(*[f"to_{c}" for c in _KEY])).applyInArrow(check, "bucket long, cut boolean, i int, j int, a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, keep: Callable) -> DataFrame:
    """The pairs (a, b) of those given whose full sets are similar enough.

    Folded points go first, a few bytes a set; then, for what they allow, points and checksum vectors, a quarter of the
    sets' bytes or less; the sets of what these allow decide.
    """
    to = [F.col(c).alias(f"to_{c}") for c in _KEY]
    dealt = keep(_dealt(pairs.where(f"100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a"), keep))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_glance(p) for p in batch.column(2).to_pylist()], pa.binary())], names=["class", "n", "glance"])

    folded = classes.select("class", "n", "point").mapInArrow(fold, "class long, n long, glance binary")
    glances = folded.join(_goes(dealt, keep), "class").select(*to, "class", "n", "glance")
    alike = keep(_checked(dealt, glances, lambda x, y: _glances_link(x, y, percent)))
    codes = classes.select("class", "n", "point", "fine").join(_goes(alike, keep), "class").select(*to, "class", "n", "point", "fine")
    allowed = keep(_checked(alike, codes, lambda x, y: _codes_link(x, y, percent)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                want = part.column(4).to_pylist()
                # a key that repeats with another text belongs to another class too
                found = [(k, s.tobytes()) for k, s in _sets(part.column(5), size) if len(s) and _class(s) == want[k]]
                taken = part.take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns[:5], pa.array([s for _, s in found], pa.binary())], names=[*taken.schema.names[:5], "code"])
        give_back()

    goes = _goes(allowed, keep, classes.select("class", "rep"))
    sets = docs.join(goes, F.col("doc_id") == F.col("rep")).select(*to, "class", "text").mapInArrow(fill, "to_bucket long, to_cut boolean, to_i int, to_j int, class long, code binary")
    return keep(_checked(allowed, sets, lambda x, y: _sets_link(x, y, percent)).select("a", "b"))


_PAIR = "a long, b long, n_a long, n_b long, cluster long"
_BEFORE = ("before_1", "before_2", "before_3")


def _tree_pairs(routes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, n_a, n_b, cluster) of classes inside each route, size band and pair of blocks.

    routes: token, band, i, j, block, late, class, component, n, point, and the class's last three routes before this
    one (before_1 to before_3): a pair that shares one of them has come from there, so few come twice. Two blocks are
    held against each other, one against itself; of two late members (guests of the next band) the own band has
    the pair.
    """

    def join(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, n, cells = t["class"].to_numpy(), t["n"].to_numpy(), t["point"].to_pylist()
        before = [(t[c].is_valid().to_numpy(zero_copy_only=False), t[c].fill_null(0).to_numpy()) for c in _BEFORE]
        counts, marks = _points(cells, min(map(len, cells)) // 2)
        late = np.where(t["late"].to_numpy(zero_copy_only=False), 0, -1)
        block = t["block"].to_numpy() if t["i"][0].as_py() != t["j"][0].as_py() else np.full(len(cls), -1)
        for i, j in CountTree(n, counts, np.column_stack([t["component"].to_numpy(), block, late]), marks).pairs(percent):
            met = np.zeros(len(i), bool)
            for there, x in before:
                for also, y in before:
                    met |= there[i] & also[j] & (x[i] == y[j])
            i, j = i[~met], j[~met]
            i, j = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
            route = pa.repeat(t["token"][0], len(i))
            yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j]), pa.array(n[i]), pa.array(n[j]), route], names=["a", "b", "n_a", "n_b", "cluster"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                if len(t) > 1:
                    yield from join(t)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if key is None or (keys[s] != key).any():
                    yield from flush()
                    key, held = keys[s], []
                held.append(batch.slice(s, e - s))
        yield from flush()
        held.clear()
        give_back()

    columns = ["token", "band", "i", "j", "block", "late", "class", "component", "n", "point", *_BEFORE]
    dealt = routes.select(*columns).repartition("token", "band", "i", "j").sortWithinPartitions("token", "band", "i", "j")
    return dealt.mapInArrow(run, _PAIR)


def _neighbour_pairs(routes: DataFrame, percent: int, most: int = 3) -> DataFrame:
    """Up to `most` candidate pairs (a, b, n_a, n_b, cluster) for each row (token, class, component, n, point): the
    likeliest of the members of other components that come just before it in a random order of the route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            for new in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                t = pa.Table.from_batches([new])
                t = (t if last is None else pa.concat_tables([last, t])).combine_chunks()
                before = 0 if last is None else last.num_rows
                token, cls, own, n = (t[c].to_numpy() for c in ("token", "class", "component", "n"))
                cells = t["point"].to_pylist()
                likeness = np.full((NEIGHBOURS, len(token)), -1.0)
                for step in range(1, NEIGHBOURS + 1):
                    j = np.arange(max(before, step), len(token))
                    i = j - step
                    good = (token[i] == token[j]) & (own[i] != own[j]) & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
                    i, j = i[good], j[good]
                    if len(i):
                        shared = np.minimum(_shared([cells[k] for k in i], [cells[k] for k in j]), np.minimum(n[i], n[j]))
                        fits = may_link(shared, n[i], n[j], percent)
                        likeness[step - 1, j[fits]] = (shared / (n[i] + n[j] - shared))[fits]
                best = np.argsort(-likeness, axis=0, kind="stable")[:most]
                at = np.take_along_axis(likeness, best, axis=0) >= 0
                j = np.nonzero(at)[1]
                i = j - best[at] - 1
                i, j = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[i], cls[j], n[i], n[j], token[i])], names=["a", "b", "n_a", "n_b", "cluster"])
                last = t.slice(max(0, t.num_rows - NEIGHBOURS))
        give_back()

    dealt = routes.select("token", "class", "component", "n", "point").repartition("token").sortWithinPartitions("token", F.xxhash64("class", "token"))
    return dealt.mapInArrow(run, _PAIR)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_common: int = MAX_COMMON) -> DataFrame:
    """One row per document: doc_id, n_shingles (its set's size), component_id (the smallest key reachable by links).

    Words are runs without ASCII white space, A-Z folded; a set holds the distinct runs of `size` words, or the
    whole sequence if there are fewer words. Sets link when 100 * shared >= percent * joint. Null, empty and
    wordless texts have empty sets and link with nothing. Repeated rows each give a row. A null key gives a null
    component and lends its text to no link. Whole texts are read; other columns are ignored. Sets are compared by
    64-bit hashes of their shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        return keep(_near_duplicates(docs, size, percent, max_common, scratch.keep))


def _near_duplicates(docs: DataFrame, size: int, percent: int, max_common: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    profile = keep(_profile(docs, size))
    rows = profile.where("n is not null").select("doc_id", "n", "class")
    named = docs.where("doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("n", "point", "fine")]
    classes = keep(profile.where("doc_id is not null and class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), *firsts))
    often = profile.where("token is not null").groupBy("token").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "token").limit(max_common).select("token")
    common = np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))

    # each class once a route, without routes of one class and without members that no other's size comes near
    by_token = Window.partitionBy("token")
    routed = _routes(named, size, percent, common).withColumns({"same": F.lag("class").over(by_token.orderBy("class")), "low": F.min("class").over(by_token), "top": F.max("class").over(by_token)})
    routed = routed.where("low < top and (same is null or same != class)").select("token", "class", F.shiftright("size", 8).alias("n"), (F.col("size").bitwiseAND(255) * F.shiftright("size", 8) / 255).alias("rest"))
    by_size = by_token.orderBy("n")
    routed = routed.withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)}).where(f"100 * below >= {percent} * n or 100 * n >= {percent} * above")
    partner = {f"of_{c}": F.coalesce(F.lag(c).over(by_size), F.lead(c).over(by_size)) for c in ("n", "rest")}
    routed = routed.withColumns({"lead": F.min(F.struct("class", "n")).over(by_token), "members": F.count(F.lit(1)).over(by_token), **partner}).where("members > 1")
    # what two sets share from their first common shingle on is at most the rest of either; a pair is met at its first one
    routed = routed.where(f"members > 2 or (100 + {percent}) * least(rest, of_rest) >= {percent} * (n + of_n)")
    routed = keep(routed.select("token", "class", "n", F.col("lead.class").alias("lead"), F.col("lead.n").alias("lead_n"), "members"))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, named, classes, size, percent, keep)

    groups = F.greatest(F.lit(512), F.least(F.lit(2 * MOST_GROUPS), F.col("n")))  # about the bytes of a point; 512 at least, so a block is at most 20,000 rows

    def state(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Components so far as links; the routes' rows with theirs; and one open route for each set of members."""
        found = keep(components(links, keep).select(F.col("node").alias("a"), F.col("component").alias("b")))
        held = routed.join(found, routed["class"] == found["a"], "left").select("token", "class", F.coalesce("b", "class").alias("component"), "n")
        routes = held.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.sum(groups).alias("bytes"), F.min("class").alias("a"), F.max("class").alias("b"), F.bit_xor(F.xxhash64("class")).alias("mark"), F.min("component").alias("low"), F.max("component").alias("high"))
        return found, held, keep(routes.where("low < high").groupBy("members", "a", "b", "mark").agg(F.min("token").alias("token"), F.first("bytes").alias("bytes")))

    points = classes.select("class", "point")
    led = routed.where("class != lead").groupBy("class", "n", "lead", "lead_n").agg(F.count(F.lit(1)).alias("routes"), F.min("members").alias("members"))
    best_led = led.groupBy("class", "n").agg(F.max(F.struct("routes", "lead", "lead_n")).alias("l")).select(F.col("l.lead").alias("a"), F.col("class").alias("b"), F.col("l.lead_n").alias("n_a"), F.col("n").alias("n_b"))
    first_pairs = best_led.union(led.where("members = 2").select("lead", "class", "lead_n", "n"))
    links = verified(first_pairs.withColumn("cluster", F.col("a")))
    routed = routed.where("members > 2").select("token", "class", "n")  # a route of two is done

    links, held, routes = state(links)
    crowded = held.join(routes.where(F.col("members") >= CROWD).select("token", "members"), "token")
    crowded = crowded.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("members"), "token"))).where(F.col("rank") <= NEIGHBOUR_ROUTES)
    links = links.unionByName(verified(_neighbour_pairs(crowded.join(points, "class"), percent)))

    links, held, routes = state(links)
    own_band = F.floor(F.log("n") / (math.log(100 / percent) * 1.0001))
    many = held.join(routes.select("token", "members", "bytes"), "token").withColumn("own_band", own_band)
    many = many.withColumn("band", F.explode(F.when(F.col("members") > BAND_ROWS, F.array("own_band", F.col("own_band") + 1)).otherwise(F.array(F.lit(-1).cast("bigint")))))
    many = many.withColumn("late", (F.col("members") > BAND_ROWS) & (F.col("band") > F.col("own_band")))
    shares = many.where(F.col("bytes") > ROUTE_BYTES).groupBy("token", "band", "component").agg(F.sum(groups).alias("own")).groupBy("token", "band").agg(F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("all"))
    shares = shares.where(F.col("all") > ROUTE_BYTES).select("token", "band", F.col("top.component").alias("largest"), F.ceil(F.col("top.own") / ROUTE_BYTES).cast("int").alias("large"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.own")) / ROUTE_BYTES).cast("int")).alias("others"))
    many = many.join(shares, ["token", "band"], "left")
    is_large = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    block = F.when(is_large, F.col("others") + F.pmod(F.xxhash64("class"), F.col("large"))).otherwise(F.pmod(F.xxhash64("class"), F.coalesce("others", F.lit(1)))).cast("int")
    meets = F.sequence(F.lit(0), F.when(is_large, F.col("others")).otherwise(F.coalesce(F.col("others") + F.col("large"), F.lit(1))) - 1)
    many = many.withColumn("block", block).withColumn("to", meets)
    by_class = Window.partitionBy("class").orderBy("token")
    first = Window.partitionBy("class", "token").orderBy("band")
    lags = many.withColumn("copy", F.row_number().over(first)).where("copy = 1").select("class", "token", *[F.lag("token", k).over(by_class).alias(b) for k, b in enumerate(_BEFORE, 1)])
    many = many.join(lags, ["class", "token"]).join(points, "class").withColumn("other", F.explode("to")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = components(links.unionByName(verified(_tree_pairs(many, percent))), keep)

    homes = classes.join(found, classes["class"] == found["node"], "left").select("class", "rep", F.coalesce("component", "class").alias("component"))
    named_homes = keep(homes.groupBy("component").agg(F.min("rep").alias("home")))
    homes = homes.join(named_homes, "component").select("class", "home")
    return rows.join(homes, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("home", "doc_id")).alias("component_id"))
