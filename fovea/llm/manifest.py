"""A Merkle manifest of a table: a tree of each group's rows, a tree of the groups' roots, a proof of every row.

A forest is a set of unresolved nodes, keyed by tree, level and index, with the sizes of those trees whose end
it has seen. Two forests merge by union; whenever all siblings of a run are there (ARITY of them, or as many as
the tree's size leaves for its last run) they become their parent's digest. That is associative and commutative,
and a forest of consecutive rows keeps only the open runs at its two edges, whatever it covers.

Rows are sorted in ranges and numbered without a window over all of them. Blocks of BLOCK consecutive rows are
the first forests; groups of FAN neighbours merge, round by round, until one root is left (the tree reduction).
Going back down, each group hands every member those digests that its open runs' proofs need and that lie
outside it, at most two edges of a run a level. The rounds are kept tables, so no node passes through the
driver but one line a range of the sort, and a lost executor costs its tasks only.

Main cost: one pass over the rows' values; a sort and two shuffles of digests, of 100 bytes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.llm.storage import Scratch, keep

ARITY = 16
BLOCK = 4096
FAN = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1  # the tree over the groups' roots
_SIZE = -1  # the level of a row that tells a tree's size
_NODES = "tree long, level int, index long, digest string"
_NODE_ARROW = [("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
Node = tuple[int, int, int]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """SHA-256 of the values, each as byte count, colon and text, or a hyphen for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


class Forest:
    """`open`: nodes without a parent yet; `known`: every node seen; `sizes`: leaves of the trees that have ended."""

    def __init__(self, arity: int, trees: int):
        self.arity, self.sizes = arity, {_TOP: trees}
        self.known: dict[Node, str] = {}
        self.open: dict[tuple[int, int, int], dict[int, str]] = {}

    def width(self, tree: int, level: int) -> int | None:
        """Nodes of a level; None while the tree's end is unknown."""
        n = self.sizes.get(tree)
        for _ in range(level if n else 0):
            n = -(-n // self.arity)
        return n

    def add(self, rows: Iterable[tuple[int, int, int, str | None]]) -> None:
        """Merges nodes and sizes, then closes every run that is whole."""
        touched = set()
        for tree, level, index, value in rows:
            if level == _SIZE:
                self.sizes[tree] = index
            else:
                touched.add(self._put(tree, level, index, value))
        touched |= set(self.open)  # a size may close what lay open
        while touched:
            touched = {up for run in touched if (up := self._close(*run))}

    def _put(self, tree: int, level: int, index: int, value: str) -> tuple[int, int, int]:
        run = (tree, level, index // self.arity)
        self.known[tree, level, index] = value
        self.open.setdefault(run, {})[index] = value
        return run

    def _close(self, tree: int, level: int, run: int) -> tuple[int, int, int] | None:
        held, width = self.open.get((tree, level, run), {}), self.width(tree, level)
        if width == 1 and tree != _TOP and held:
            del self.open[tree, level, run]
            return self._put(_TOP, 0, tree, held[0])
        whole = self.arity if width is None else min(self.arity, width - run * self.arity)
        if width == 1 or len(held) < whole:
            return None
        del self.open[tree, level, run]
        return self._put(tree, level + 1, run, digest("".join(held[k] for k in sorted(held))))

    def rows(self, sizes: Iterable[int]) -> Iterator[tuple[int, int, int, str | None]]:
        """The open nodes, and the sizes of the trees named."""
        for (tree, level, _), held in self.open.items():
            yield from ((tree, level, index, value) for index, value in held.items())
        yield from ((tree, _SIZE, self.sizes[tree], None) for tree in sizes if tree in self.sizes and tree != _TOP)

    def up(self, tree: int, level: int, index: int) -> Node | None:
        """The node above; a group's root stands in the tree over the groups. None: the root of all."""
        width = self.width(tree, level)
        if width == 1:
            return None if tree == _TOP else (_TOP, 0, tree)
        return tree, level + 1, index // self.arity

    def siblings(self, tree: int, level: int, index: int) -> range:
        first = index // self.arity * self.arity
        width = self.width(tree, level)
        return range(first, first + self.arity if width is None else min(first + self.arity, width))

    def needed(self, nodes: Iterable[Node]) -> set[Node]:
        """Keys of the siblings of the nodes and of all above them, as far as they are known here."""
        out, seen = set(), set()
        for node in nodes:
            while node and node not in seen:
                seen.add(node)
                tree, level, index = node
                if self.width(tree, level) != 1:
                    out.update(k for i in self.siblings(*node) if (k := (tree, level, i)) in self.known)
                node = self.up(*node)
        return out

    def path(self, node: Node, cache: dict[Node, list]) -> list[tuple[str, str] | None]:
        """For each level from the node to the root of all, the digests left and right of its ancestor, joined; None where the ancestor is the group's root."""
        if node not in cache:
            tree, level, index = node
            above = self.up(*node)
            rest = self.path(above, cache) if above else []
            if self.width(tree, level) == 1:
                cache[node] = [None, *rest] if above else rest
            else:
                own = self.siblings(*node)
                sides = ["".join(self.known[tree, level, i] for i in side) for side in (range(own.start, index), range(index + 1, own.stop))]
                cache[node] = [tuple(sides), *rest]
        return cache[node]


def fold(value: str, path: list[tuple[str, str] | None]) -> tuple[str, str]:
    """The group's root and the root of all that a leaf's digest and its siblings give."""
    group = value
    for step in path:
        if step is None:
            group = value
        else:
            value = digest(step[0] + value + step[1])
    return group, value


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to a task's sorted rows: part, pos, ordinal of the group, place in it, and whether the group's next row is another's."""
    part, pos, ordinal, place, last, held = TaskContext.get().partitionId(), 0, -1, 0, object(), None
    for batch in batches:
        groups, numbers = batch.column("group").to_pylist(), []
        for group in groups:
            if group != last or ordinal < 0:
                ordinal, place, last = ordinal + 1, 0, group
            numbers.append((pos, ordinal, place))
            pos, place = pos + 1, place + 1
        if not numbers:
            continue
        if held is not None:
            yield _closing(*held, numbers[0][1])
        held = (batch, part, numbers)
    if held is not None:
        yield _closing(*held, held[2][-1][1])


def _closing(batch: pa.RecordBatch, part: int, numbers: list[tuple], following: int) -> pa.RecordBatch:
    pos, ordinal, place = (list(c) for c in zip(*numbers, strict=True))
    closes = [a != b for a, b in zip(ordinal, [*ordinal[1:], following], strict=True)]
    extra = {"part": pa.array([part] * len(pos), pa.int64()), "pos": pa.array(pos, pa.int64()), "ordinal": pa.array(ordinal, pa.int64()), "place": pa.array(place, pa.int64()), "closes": pa.array(closes)}
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def _places(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Each row's tree, index in it and block; the number of blocks and of trees. The driver gets one line a range of the sort."""
    own = F.coalesce(F.sha2("group", 256), F.lit("-"))
    lines = rows.groupBy("part").agg(F.max("pos"), F.max("ordinal"), F.min_by(own, "pos"), F.max_by(own, "pos"), F.max_by("place", "pos")).collect()
    out, blocks, trees, carried, before = [], 0, 0, 0, None
    for part, last_pos, last_ordinal, first_group, last_group, last_place in sorted(lines):
        goes_on = first_group == before
        if out and not goes_on:
            out[-1][-1] = True
        tree, index = (trees - 1, carried) if goes_on else (trees, 0)
        out.append([part, tree, index, blocks, last_pos, False])
        blocks += last_pos // BLOCK + 1
        trees = tree + last_ordinal + 1
        carried, before = last_place + 1 + (index if last_ordinal == 0 else 0), last_group
    if out:
        out[-1][-1] = True
    ranges = rows.sparkSession.createDataFrame(out, "part long, first_tree long, first_index long, first_block long, last_pos long, ends boolean")
    index = F.col("place") + F.when(F.col("ordinal") == 0, F.col("first_index")).otherwise(0)
    closes = F.col("closes") | ((F.col("pos") == F.col("last_pos")) & F.col("ends"))
    placed = rows.join(F.broadcast(ranges), "part").select("key", "leaf", "changed", (F.col("first_tree") + F.col("ordinal")).alias("tree"), index.alias("index"), closes.alias("closes"), (F.col("first_block") + F.floor(F.col("pos") / BLOCK)).alias("unit"))
    return placed, blocks, trees


def _table(unit: list[int], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({"unit": pa.array(unit, pa.int64())} | {name: pa.array(list(c), kind) for c, (name, kind) in zip(columns, _NODE_ARROW, strict=True)})


def _leaves(table: pa.Table) -> list[tuple[int, int, int, str | None]]:
    """A block's leaves as nodes, and the sizes of the trees that end in it."""
    tree, index, value, closes = (table.column(c).to_pylist() for c in ("tree", "index", "leaf", "closes"))
    return [(t, 0, i, v) for t, i, v in zip(tree, index, value, strict=True)] + [(t, _SIZE, i + 1, None) for t, i, c in zip(tree, index, closes, strict=True) if c]


def _nodes(table: pa.Table) -> list[tuple[int, int, int, str | None]]:
    return list(zip(*(table.column(n).to_pylist() for n, _ in _NODE_ARROW), strict=True))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None, arity: int = ARITY) -> DataFrame:
    """One row a row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a group ascend by key, equal keys by leaf; groups by bytes, null first. A level's runs of `arity` nodes
    become a digest each while there are several; a single leaf is its group's root. `changed` gives columns' other
    values and `where` the rows that take them: their folded_root comes from the changed leaf and the original
    siblings. Null fields count as a hyphen, null keys come first, repeated rows are leaves of their own. An empty
    table has no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    other = leaf(*[(changed or {}).get(f, F.col(f)) for f in fields])
    other = F.when(F.coalesce(where, F.lit(False)), other) if where is not None else F.lit(None).cast("string")
    with Scratch(spark) as scratch:
        hashed = docs.select(F.col(group).cast("string").alias("group"), F.col(key).cast("long").alias("key"), leaf(*map(F.col, fields)).alias("leaf"), other.alias("changed"))
        hashed = scratch.keep(hashed.withColumn("row", F.monotonically_increasing_id()))
        order = ("group", "key", "leaf", "row")  # the row's number lets a range end between equal rows
        numbering = "group string, key long, leaf string, changed string, part long, pos long, ordinal long, place long, closes boolean"
        dealt = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select("group", "key", "leaf", "changed")
        placed, blocks, trees = _places(scratch.keep(dealt.mapInArrow(_numbered, numbering)))
        if not blocks:
            return spark.createDataFrame([], _RESULT)

        def first(table: pa.Table) -> pa.Table:
            forest = Forest(arity, trees)
            forest.add(_leaves(table))
            rows = list(forest.rows({tree for tree, *_ in forest.open}))
            return _table([table.column("unit")[0].as_py()] * len(rows), rows)

        def merge(table: pa.Table) -> pa.Table:
            forest = Forest(arity, trees)
            forest.add(_nodes(table))
            rows = list(forest.rows({tree for tree, *_ in forest.open}))
            return _table([table.column("unit")[0].as_py() // FAN] * len(rows), rows)

        rounds = [scratch.keep(placed.select("unit", "tree", "index", "leaf", "closes").groupBy("unit").applyInArrow(first, f"unit long, {_NODES}"))]
        units = blocks
        while units > 1:
            rounds.append(scratch.keep(rounds[-1].groupBy(F.floor(F.col("unit") / FAN)).applyInArrow(merge, f"unit long, {_NODES}")))
            units = -(-units // FAN)
        if blocks == 1:
            rounds.append(rounds[0])
        root = rounds[-1].where(f"tree = {_TOP} and level >= 0").select("digest").collect()[0][0]

        def hand_down(members: pa.Table, above: pa.Table) -> pa.Table:
            forest = Forest(arity, trees)
            nodes, outside = _nodes(members), _nodes(above)
            forest.add(nodes)
            forest.sizes |= {tree: index for tree, level, index, _ in outside if level == _SIZE}
            forest.known |= {(tree, level, index): value for tree, level, index, value in outside if level != _SIZE}
            own: dict[int, list[Node]] = {}
            for unit, (tree, level, index, _) in zip(members.column("unit").to_pylist(), nodes, strict=True):
                if level != _SIZE:
                    own.setdefault(unit, []).append((tree, level, index))
            units, rows = [], []
            for unit, mine in own.items():
                keys = forest.needed(mine)
                found = [(*k, forest.known[k]) for k in keys] + [(t, _SIZE, forest.sizes[t], None) for t in {k[0] for k in mine} - {_TOP} if t in forest.sizes]
                units += [unit] * len(found)
                rows += found
            return _table(units, rows)

        outside = spark.createDataFrame([], f"unit long, {_NODES}")
        for members in reversed(rounds[:-1]):
            outside = scratch.keep(members.groupBy(F.floor(F.col("unit") / FAN)).cogroup(outside.groupBy("unit")).applyInArrow(hand_down, f"unit long, {_NODES}"))

        def prove(table: pa.Table, above: pa.Table) -> pa.Table:
            forest = Forest(arity, trees)
            forest.add(_leaves(table))
            given = _nodes(above)
            forest.sizes |= {tree: index for tree, level, index, _ in given if level == _SIZE}
            forest.known |= {(tree, level, index): value for tree, level, index, value in given if level != _SIZE}
            cache: dict[Node, list] = {}
            rows = []
            for doc, value, other, tree, index in zip(*(table.column(c).to_pylist() for c in ("key", "leaf", "changed", "tree", "index")), strict=True):
                path = forest.path((tree, 0, index), cache)
                subroot, folded = fold(value, path)
                if other is not None:
                    folded = fold(other, path)[1]
                rows.append((doc, value, subroot, root, digest("".join(a + b for a, b in filter(None, path))), folded, folded == root))
            names = [c.split()[0] for c in _RESULT.split(", ")]
            kinds = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()]
            return pa.table({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

        return keep(placed.groupBy("unit").cogroup(outside.groupBy("unit")).applyInArrow(prove, _RESULT))
