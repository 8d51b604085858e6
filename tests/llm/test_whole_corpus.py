"""Repeated passages, importance resampling and the Merkle manifest: brute force, edge cases, hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fovea.llm import importance, manifest, substrings

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, rank string, unit long, `group` string, part long, slice int, kept string"


def frame(spark, rows, tasks=3):
    """Rows of (doc_id, text, source) beside columns of the operators' own names."""
    full = [(k, t, "en", s, len(t) if t else None, -1, "r", -2, "g", -3, -4, "k") for k, t, s in rows]
    return spark.createDataFrame(full, EXTRA).repartition(tasks)


# -- matching statistics -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_equal_plain_search(seed):
    rng = np.random.default_rng(seed)
    depth, symbols = int(rng.integers(2, 6)), int(rng.integers(2, 5))
    text = np.concatenate([np.append(rng.integers(1, symbols + 1, rng.integers(1, 15)), 0) for _ in range(6)])
    index = substrings.FMIndex(text, depth)
    patterns = [np.minimum(rng.integers(1, symbols + 1, rng.integers(1, 12)), text.max()) for _ in range(5)]
    flat, sizes = np.concatenate(patterns), np.array([len(p) for p in patterns])
    ends, held = np.cumsum(sizes), text.tolist()
    reached, found = index.matching_statistics(flat, ends, sizes)
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        for at in range(end - size, end):
            lengths = [n for n in range(1, min(depth, end - at) + 1) if any(held[j : j + n] == flat[at : at + n].tolist() for j in range(len(held)))]
            assert reached[at] == max(lengths, default=0)
            where = index.suffixes[found[at]]
            assert held[where : where + reached[at]] == flat[at : at + reached[at]].tolist()


def test_wavelet_ranks_are_counts():
    rng = np.random.default_rng(3)
    for n, symbols in ((1, 1), (63, 2), (64, 5), (65, 9), (1000, 300)):
        text = rng.integers(0, symbols, n)
        matrix = substrings.WaveletMatrix(text, symbols)
        at, symbol = rng.integers(0, n + 1, 200), rng.integers(0, symbols, 200)
        assert matrix.rank(symbol, at).tolist() == [int((text[:i] == c).sum()) for c, i in zip(symbol.tolist(), at.tolist(), strict=True)]


# -- repeated passages -------------------------------------------------------------------------------------------------


def plain_repeats(rows, window):
    """Rows of (key, text): key, words, removed, kept."""
    first, cut = {}, [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    for key, words in cut:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if key is not None:
                first[w] = min(first.get(w, key), key)
    out = []
    for key, words in cut:
        gone = set()
        for i in range(len(words) - window + 1):
            least = first.get(tuple(words[i : i + window]))
            if least is not None and (key is None or least < key):
                gone.update(range(i, i + window))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    shared, line, pages = some(30), some(9), [some(40) for _ in range(4)]
    rows = []
    for k in range(90):
        kind = rng.randrange(7)
        body = some(rng.randrange(1, 50))
        if kind == 1:
            body = body + shared[rng.randrange(5) :] + some(6)
        elif kind == 2:
            body = some(8) + line + some(8)  # a common line in ever new surroundings
        elif kind == 3:
            body = list(rng.choice(pages))
            body[rng.randrange(40)] = "edited"
        elif kind == 4:
            body = rng.choice(pages)
        elif kind == 5:
            body = ["na"] * rng.randrange(5, 200)
        rows.append((rng.randrange(40) if kind == 6 else 100 + k, rng.choice((" ", "\n", " \t ")).join(body)))
    return [*rows, (7, None), (8, ""), (9, " \n "), (None, " ".join(shared)), (None, " ".join(pages[0])), rows[3], rows[3]]


@pytest.mark.parametrize("seed,window,gram,hot,chunk,part,shard", [(1, 13, 8, 10_000, 8_000_000, 64_000_000, 2_500_000), (2, 5, 3, 3, 400, 900, 300), (3, 4, 4, 2, 100, 100, 1), (4, 6, 1, 5, 1000, 64_000_000, 2000)])
def test_passages_go_as_in_a_plain_search(spark, seed, window, gram, hot, chunk, part, shard):
    rows = passages(seed)
    docs = frame(spark, [(k, t, "s") for k, t in rows], tasks=5)
    got = substrings.without_repeats(docs, window=window, gram=gram, hot=hot, chunk_bytes=chunk, part_bytes=part, shard_bytes=shard).collect()
    want = plain_repeats(rows, window)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert any(gone for _, _, gone, _ in want)


def test_a_very_long_text_and_its_copy(spark):
    long = " ".join(f"x{k * k % 7919}" for k in range(300_000))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.without_repeats(frame(spark, [(1, long, "s"), (2, long + " end", "s"), (3, "short", "s")])).collect()}
    assert got == {1: (300_000, 0), 2: (300_001, 300_000), 3: (1, 0)}


def test_no_documents(spark):
    none = frame(spark, [])
    assert substrings.without_repeats(none).count() == 0
    assert manifest.manifest(none).count() == 0
    assert importance.resample(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


# -- importance resampling ---------------------------------------------------------------------------------------------


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + n]) for i in range(len(words)) for n in range(1, longest + 1) if i + n <= len(words)], len(words)


@pytest.mark.parametrize("longest,size", [(1, 1_000_000), (3, 7), (2, 1)])
def test_ring_gives_every_run_of_words(longest, size, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_BYTES", size)
    for text in ("", "One", "The cat-sat on THE mat; 12 é Üx über's", "a " * 50, "--"):
        hashes, n = importance.ring(text.encode(), longest)
        found, words = runs(text, longest)
        assert Counter(hashes.tolist()) == Counter(zlib.crc32(f.encode()) for f in found) and n == words


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 50, 40)])
def test_resampling_equals_a_plain_draw(spark, longest, buckets, percent):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(80)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60))), "s") for k in range(80)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "12 .. ÄÖ " * 20, "s"), rows[7], rows[7], (None, "v1 " * 30, "s")]
    aims = [(1, "v1 v2 v3 V4 " * 9), (2, None), (3, "v5")]
    got = importance.resample(frame(spark, rows), spark.createDataFrame(aims, "item_id long, text string"), percent=percent, longest=longest, buckets=buckets).collect()
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(crc(f) for _, t, _ in rows for f in runs(t, longest)[0])
    t = Counter(crc(f) for _, x in aims for f in runs(x, longest)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    want, eligible = [], []
    for key, text, _ in rows:
        found, n = runs(text, longest)
        weight = sum(gain(crc(f)) for f in found) // len(found) if found else 0
        score = None
        if key is not None:
            h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                eligible.append((-score, key))
        want.append((key, len(found), weight, score))
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=repr) == sorted(want, key=repr)
    drawn = sorted(eligible)[: percent * len(eligible) // 100]
    assert [(r["rank"], -r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(k + 1, *d) for k, d in enumerate(drawn)]
    assert drawn


# -- manifest ----------------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
    return levels


def plain_manifest(rows, arity):
    groups = {}
    for key, text, source, tampered in rows:
        values = [key, source, "en", len(text) if text else None]
        leaf = plain_leaf([*values, text])
        changed = plain_leaf([*values, text.lower() if text is not None else None]) if tampered else leaf
        groups.setdefault(source, []).append((key is not None, key or 0, leaf, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[s])], arity) for s in order]
    top = plain_tree([t[-1][0] for t in trees], arity)
    out = []
    for j, s in enumerate(order):
        for i, (_, key, leaf, changed) in enumerate(sorted(groups[s])):
            proof, value = "", changed
            for levels, at in ((trees[j], i), (top, j)):
                for level in levels[:-1]:
                    first = at // arity * arity
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + arity])
                    proof, value, at = proof + left + right, h(left + value + right), at // arity
            out.append((leaf, trees[j][-1][0], top[-1][0], h(proof), value, value == top[-1][0]))
    return sorted(out)


SIZES = {"one": 1, "two": 2, "full": 16, "more": 17, "square": 256, "over": 300, "": 3, None: 5}


@pytest.mark.parametrize("arity,block,fan,extra,tasks", [(16, 4096, 32, 0, 3), (16, 7, 2, 0, 5), (2, 5, 3, 0, 4), (3, 4, 2, 40, 6)])
def test_manifest_equals_plain_trees(spark, monkeypatch, arity, block, fan, extra, tasks):
    monkeypatch.setattr(manifest, "BLOCK", block)
    monkeypatch.setattr(manifest, "FAN", fan)
    sizes = SIZES | {f"s{k}": 1 + k % 3 for k in range(extra)}
    rows, key = [], 0
    for source, n in sizes.items():
        for k in range(n):
            key += 7
            text = None if k % 11 == 5 else f"Text ünd {key} " * (k % 4)
            rows.append((key % 1009, text, source))
    rows += [rows[-1], rows[-1], (None, "No Key", "one"), (3, "ABC" * 100_000, "full")]
    docs = frame(spark, rows, tasks)
    where = F.col("doc_id") % 5 == 0
    got = manifest.manifest(docs, changed={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}, where=where, arity=arity).collect()
    lower = [(k, t, s, k is not None and k % 5 == 0) for k, t, s in rows]
    want = plain_manifest([(k, t, s, g) for k, t, s, g in lower], arity)
    assert sorted(tuple(r)[1:] for r in got) == want
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _, _ in rows)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_repeats(spark):
    one = manifest.manifest(frame(spark, [(1, "a", None)])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == one[0]["folded_root"] and one[0]["proof_sha256"] == h("") and one[0]["verified"]
    same = manifest.manifest(frame(spark, [(1, "a", "s")] * 500)).collect()
    assert len(same) == 500 and len({r["root"] for r in same}) == 1 and all(r["verified"] for r in same)


def test_forests_merge_in_any_order():
    rng = random.Random(2)
    leaves = [(0, 0, i, h(str(i))) for i in range(75)] + [(0, -1, 75, None)] + [(1, 0, i, h(f"b{i}")) for i in range(3)] + [(1, -1, 3, None)]
    whole = manifest.Forest(4, 2)
    whole.add(leaves)
    for _ in range(20):
        cuts = [0, *sorted(rng.sample(range(1, len(leaves)), 6)), len(leaves)]
        parts = [leaves[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rng.shuffle(parts)
        merged = manifest.Forest(4, 2)
        for part in parts:
            piece = manifest.Forest(4, 2)
            piece.add(part)
            merged.add(list(piece.rows({t for t, *_ in piece.open} | set(piece.sizes))))
        assert merged.open == whole.open and len(whole.open) == 1
