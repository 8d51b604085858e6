"""SimHash fingerprints of texts, and search within a Hamming radius by permuted block tables.

A text's terms are its words, each with the word before it. A term occurring t times votes with weight
1 + ln t on every bit, plus or minus by the bits of its hash; the signs of the sums are the fingerprint
(BITS bits). Fingerprints of unrelated texts differ in about half of the bits, so likeness is
cos(pi * differing / BITS), at least 0, which estimates the cosine of the term vectors.

Search: BITS are cut into radius + 2 blocks. Two fingerprints within the radius agree on two blocks at least,
so a table for each pair of blocks, keyed by their bits, finds all; candidates are checked by bit counts. Equal
fingerprints are one class. `neighbourhoods` tells for every document how many others lie within the radius: each
bucket of a table is searched in a task, which gives one row a member, and a pair counts in the first table that
holds it. A bucket of over `BUCKET_ROWS` members is dealt into blocks and a task gets two of them.

Main cost: the fingerprints need one pass and no shuffle. Holding each text against its neighbour by key needs
one range shuffle of the texts; rows at partition edges, one for each partition, are matched afterwards.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.llm import textbytes
from fovea.llm.storage import keep

BITS = 128
_WORDS = BITS // 64
BUCKET_ROWS = 2048
_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(texts: list[str] | pa.Array) -> np.ndarray:
    """(rows, BITS / 8) bytes; no words, no votes: all zero."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for first, _, data, offsets in textbytes.slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
        starts, ends, counts = textbytes.word_spans(data, offsets)
        words = textbytes.word_hashes(data, starts, ends)
        before = np.zeros_like(words)
        before[1:] = words[:-1]
        before[counts[:-1][counts[:-1] < len(words)]] = 0
        terms = textbytes.mix(words + textbytes.mix(before))
        for k, (s, e) in enumerate(zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)):
            if s < e:
                own, times = np.unique(terms[s:e], return_counts=True)
                weight = np.rint(16 * (1 + np.log(times))).astype(np.float32)
                wide = np.stack([textbytes.mix(own + np.uint64(97 * j + 1)) for j in range(_WORDS)], axis=1)
                ones = weight @ np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32)
                out[first + k] = np.packbits(2 * ones > weight.sum())
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1, row by row."""
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    return np.where(apart == 0, 1.0, np.clip(np.cos(np.pi * apart / BITS), 0, 1))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new = fingerprints(changed)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([p.tobytes().hex() for p in prints]),
        pa.array([p.tobytes().hex() for p in new]),
        pa.array(likeness(prints, new)),
        pa.array(likeness(prints, next_prints)),
    ]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and the likeness to that and to the next document.

    Next is by descending key (after the last: the first), ties by text, null keys last; a single row is its own
    next. Null text is empty. Repeated rows give a row each. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = docs.repartitionByRange(partitions, "doc_id") if partitions else docs.repartitionByRange("doc_id")
    dealt = dealt.sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last = TaskContext.get().partitionId(), None

        def edge(kind: str, row: tuple) -> pa.RecordBatch:
            cells = [pa.array([row[0]], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*cells, pa.array([kind]), pa.array([pid], pa.int32()), pa.array([row[1]])], names=[*names, "edge", "part", "text"])

        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                prints = fingerprints(part.column(1))
                if last is None:
                    yield edge("head", (ids[0], texts[0]))
                else:
                    ids, texts, prints = [last[0], *ids], [last[1], *texts], np.concatenate([last[2][None], prints])
                if len(ids) > 1:
                    n = len(ids) - 1
                    cells = _compared(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                    yield pa.RecordBatch.from_arrays([*cells, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=[*names, "edge", "part", "text"])
                last = ids[-1], texts[-1], prints[-1]
        if last is not None:
            yield edge("tail", last)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, texts, following = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays(_compared(ids, texts, following, fingerprints(texts), fingerprints(following)), names=names)

    rows = keep(dealt.mapInArrow(run, f"{_ROWS}, edge string, part int, text string"))
    down = Window.orderBy(F.desc("part"))  # one row for each partition
    heads = rows.where("edge = 'head'").select("part", F.col("text").alias("following"))
    order = heads.select("part", F.coalesce(F.lead("part").over(down), F.first("part").over(down)).alias("next_part"))
    tails = rows.where("edge = 'tail'").select("part", "doc_id", "text").join(order, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part")
    return rows.where("edge is null").select(*names).unionByName(tails.select("doc_id", "text", "following").mapInArrow(close, _ROWS))


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows of docs with the fingerprint appended as lower-case hexadecimal; null text counts as empty."""
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                prints = pa.array([p.tobytes().hex() for p in fingerprints(part.column(part.schema.get_field_index(text_col)))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, prints], names=[*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` string")


def _keys(fingerprint: Column, radius: int) -> Column:
    """An array of (table, key): for each pair of blocks, the bits of both."""
    digits = BITS // 4
    cuts = [digits * k // (radius + 2) for k in range(radius + 3)]
    block = [F.substring(fingerprint, a + 1, b - a) for a, b in itertools.pairwise(cuts)]
    return F.array(*[F.struct(F.lit(k).alias("table"), F.concat(block[i], block[j]).alias("bits")) for k, (i, j) in enumerate(itertools.combinations(range(radius + 2), 2))])


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal fingerprints."""
    words = [F.bit_count(F.conv(F.substring(a, 16 * k + 1, 16), 16, -10).cast("long").bitwiseXOR(F.conv(F.substring(b, 16 * k + 1, 16), 16, -10).cast("long"))) for k in range(_WORDS)]
    return sum(words[1:], words[0]).cast("int")


def search(queries: DataFrame, stored: DataFrame, radius: int = 6, fingerprint: str = "fingerprint") -> DataFrame:
    """query, found, apart: every distinct stored fingerprint within `radius` bits of each distinct query fingerprint.

    Exact. Rows are found again by joining on the fingerprint; equal ones are searched once. Null ones take no part.
    """
    asked = queries.select(F.col(fingerprint).alias("query")).where("query is not null").distinct()
    held = stored.select(F.col(fingerprint).alias("found")).where("found is not null").distinct()
    left = asked.select("query", F.explode(_keys(F.col("query"), radius)).alias("key"))
    right = held.select("found", F.explode(_keys(F.col("found"), radius)).alias("key"))
    pairs = left.join(right, "key").select("query", "found", distance(F.col("query"), F.col("found")).alias("apart"))
    return pairs.where(F.col("apart") <= radius).distinct()


def _block_words(radius: int) -> np.ndarray:
    """(blocks, _WORDS) masks of the bits of each block."""
    digits = BITS // 4
    cuts = [digits * k // (radius + 2) for k in range(radius + 3)]
    masks = [["f" if a <= d < b else "0" for d in range(digits)] for a, b in itertools.pairwise(cuts)]
    return np.array([[int("".join(m[16 * w : 16 * w + 16]), 16) for w in range(_WORDS)] for m in masks], np.uint64)


def _bucket(prints: np.ndarray, table: int, radius: int, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows left and right within the radius whose first common table is this one; of one block each pair once."""
    masks = _block_words(radius)
    order = list(itertools.combinations(range(radius + 2), 2))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, 2_000_000 // max(1, len(right)))
    for first in range(0, len(left), step):
        a = left[first : first + step]
        apart = sum(np.bitwise_count(prints[a, w][:, None] ^ prints[right, w][None, :]).astype(np.int16) for w in range(_WORDS))
        i, j = np.nonzero(apart <= radius)
        i, j = a[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        diff = prints[i] ^ prints[j]
        agrees = np.stack([((diff & m) == 0).all(axis=1) for m in masks], axis=1)
        earlier = np.zeros(len(i), bool)
        for x, y in order[:table]:
            earlier |= agrees[:, x] & agrees[:, y]
        found.append((i[~earlier], j[~earlier]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def neighbourhoods(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, near_docs (other documents within `radius` bits), near_least (the smallest key within the
    radius, the own included) of every row of docs.

    Exact, and counted by permuted block tables. Null text counts as empty; texts without words share the zero
    fingerprint. Repeated rows count each; a null key is counted, but is nobody's smallest. Other columns are ignored.
    """
    rows = keep(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "fingerprint"))
    held = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least"))
    keyed = keep(held.select("fingerprint", "docs", "least", F.explode(_keys(F.col("fingerprint"), radius)).alias("key")).select("fingerprint", "docs", "least", "key.table", "key.bits"))
    sizes = keyed.groupBy("table", "bits").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("table", "bits", F.ceil(F.col("members") / BUCKET_ROWS).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, ["table", "bits"]).withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.select("table", "bits", "i", "j", "block", "fingerprint", "docs", F.coalesce("least", F.lit((1 << 63) - 1)).alias("least"))

    def search_bucket(key: tuple, t: pa.Table) -> pa.Table:
        table, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        names = t["fingerprint"].to_pylist()
        prints = np.array([[int(n[16 * w : 16 * w + 16], 16) for w in range(_WORDS)] for n in names], np.uint64).reshape(-1, _WORDS)
        block, docs, least = (t[c].to_numpy() for c in ("block", "docs", "least"))
        left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j))
        a, b = _bucket(prints, table, radius, left, right, i == j)
        near, low = np.zeros(len(names), np.int64), least.copy()
        for x, y in ((a, b), (b, a)):
            np.add.at(near, x, docs[y])
            np.minimum.at(low, x, least[y])
        met = np.zeros(len(names), bool)
        met[a] = met[b] = True
        return pa.table({"fingerprint": pa.array([n for n, m in zip(names, met, strict=True) if m], pa.string()), "near": pa.array(near[met]), "low": pa.array(low[met])})

    found = dealt.groupBy("table", "bits", "i", "j").applyInArrow(search_bucket, "fingerprint string, near long, low long")
    near = found.groupBy("fingerprint").agg(F.sum("near").alias("near"), F.min("low").alias("low"))
    about = held.join(near, "fingerprint", "left").select("fingerprint", (F.col("docs") - 1 + F.coalesce("near", F.lit(0))).alias("near_docs"), F.least("least", "low").alias("near_least"))
    about = about.withColumn("near_least", F.when(F.col("near_least") < (1 << 63) - 1, F.col("near_least")))
    return rows.join(about, "fingerprint").select("doc_id", "fingerprint", "near_docs", "near_least")
