"""Toxic spans by a linear-chain conditional random field with two tags, clean and toxic.

Documents carry one label, the chain needs labelled tokens. A token counts as toxic if its word is tied to
toxic documents: among distinct (left word, word, right word) contexts, so that copies of a text count once,
it, or all words with its first letters, is far more frequent there than in clean ones. The chain then learns
emissions from the word, its head, tail and length, and the tag transitions, by maximum likelihood.
Forward-backward gives each token's marginal; spans are maximal runs at 0.5 or more. A document's score is a
logistic function, fitted on sample rows that the chain did not see, of the sum of its marginals, their highest
and its token count: one doubtful word in a long text isn't toxic, several are.

The forward recursion over all tokens of a batch is one scan: the tokens are laid in equal lanes, every lane is
run for both starting tags at once, and then the lanes are chained. A document start resets the state.

Main cost: one pass over the texts, in tasks of bounded memory. The model comes from about `max_train_docs`
labelled rows of each class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.llm.storage import give_back

WORD = re.compile(r"[^\W_]+")
DIMS = 1 << 16
HEAD = 5
MAX_TRAIN_DOCS = 2000
_CACHE = 100_000
_STEP_TOKENS = 100_000
SPAN = "array<struct<start:int,end:int,p:double>>"


def features(word: str) -> list[int]:
    """Hashed emission features of a lower-cased word."""
    kinds = (f"w{word}", f"h{word[:HEAD]}", f"g{word[:HEAD - 2]}", f"t{word[-3:]}", f"n{min(len(word), 12)}")
    return [zlib.crc32(k.encode()) % DIMS for k in kinds]


@dataclass
class Chain:
    """weights: log-odds of the toxic tag by feature; trans[i, j]: from tag i to tag j; start: by tag; whole: of documents."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: np.ndarray
    whole: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 1.0, 0.0]))
    seen: dict[str, float] = field(default_factory=dict)

    def emission(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > _CACHE:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = float(self.weights[features(w)].sum() + self.bias)
        return np.fromiter(map(seen.__getitem__, words), float, len(words))


def _scan(step: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised forward vectors. step[t]: emission factors (n, 2); first[t]: a document starts; trans, start: factors."""
    n = len(step)
    lanes = max(1, int(np.sqrt(n)))
    length = -(-n // lanes)
    pad = lanes * length - n
    e = np.concatenate([step, np.ones((pad, 2))]).reshape(lanes, length, 2)
    s = np.concatenate([first, np.zeros(pad, bool)]).reshape(lanes, length)
    basis = np.tile(np.eye(2), (lanes, 1, 1))  # lane, tag before the lane, tag now
    for t in range(length):
        basis = np.where(s[:, t, None, None], start, basis @ trans) * e[:, t, None, :]
        basis /= basis.sum(axis=(1, 2), keepdims=True)
    state = np.empty((lanes, 2))
    now = np.array([0.5, 0.5])
    for k in range(lanes):
        state[k] = now
        now = now @ basis[k]
        now /= now.sum()
    out = np.empty((lanes, length, 2))
    for t in range(length):
        state = np.where(s[:, t, None], start, state @ trans) * e[:, t]
        state /= state.sum(axis=1, keepdims=True)
        out[:, t] = state
    return out.reshape(-1, 2)[:n]


def marginals(emission: np.ndarray, counts: np.ndarray, chain: Chain, pairs: bool = False):
    """Each token's chance of the toxic tag, for documents of `counts` tokens laid end to end.

    With `pairs`, also the chances of each (tag, next tag) inside documents, and the log likelihood's normaliser.
    """
    n = len(emission)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.cumsum(counts)
    begins = ends - counts
    first[begins[counts > 0]] = True
    last[ends[counts > 0] - 1] = True
    top = np.maximum(emission, 0)
    step = np.exp(np.stack([-top, emission - top], axis=1))
    trans, start = np.exp(chain.trans - chain.trans.max()), np.exp(chain.start - chain.start.max())
    forward = _scan(step, first, trans, start)
    # beta * emission obeys the same recursion from the right with the transition transposed
    right = _scan(step[::-1], last[::-1], trans.T, np.ones(2))[::-1]
    inner = np.where(last[:, None], 1.0, np.concatenate([right[1:], np.ones((1, 2))]) @ trans.T)
    both = forward * inner
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both[:, 1]
    joint = forward[:-1, :, None] * trans * right[1:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return both[:, 1], joint[~last[:-1]]


def train(words: list[str], tags: np.ndarray, counts: np.ndarray, rounds: int = 60, rate: float = 0.3, l2: float = 1e-3) -> Chain:
    """Maximum likelihood by adaptive gradient steps (Adam) over all token sequences.

    A step sums the gradient over runs of whole documents of about `_STEP_TOKENS` tokens, so what is held beside the
    tokens doesn't grow with them.
    """
    chain = Chain(np.zeros(DIMS), -2.0, np.zeros((2, 2)), np.zeros(2))
    if not words:
        return chain
    at: dict[str, int] = {}
    index = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int32, len(words))
    table = np.array([features(w) for w in at])
    first = np.zeros(len(words), bool)
    ends = np.cumsum(counts)
    first[(ends - counts)[counts > 0]] = True
    runs, begin = [], 0
    for k in range(len(counts)):
        if k + 1 == len(counts) or ends[k + 1] - (ends[begin] - counts[begin]) > _STEP_TOKENS:
            runs.append((slice(int(ends[begin] - counts[begin]), int(ends[k])), counts[begin : k + 1]))
            begin = k + 1
    inside = ~first[1:]
    real = np.zeros((2, 2))
    np.add.at(real, (tags[:-1][inside], tags[1:][inside]), 1)
    opening = np.bincount(tags[first], minlength=2).astype(float)
    scale = max(1.0, tags.sum())
    moments: dict[str, tuple] = {}

    def adam(name: str, value, grad, k: int):
        m, v = moments.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        moments[name] = (m, v)
        return value - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    for k in range(1, rounds + 1):
        each = chain.weights[table].sum(axis=1) + chain.bias
        off, joint, heads = np.zeros(len(at)), np.zeros((2, 2)), 0.0
        for tokens, own in runs:
            if own.sum():
                p, pairs = marginals(each[index[tokens]], own, chain, pairs=True)
                off += np.bincount(index[tokens], p - tags[tokens], minlength=len(at))
                joint += pairs.sum(axis=0)
                heads += p[first[tokens]].sum()
        off /= scale
        slope = np.bincount(table.ravel(), np.repeat(off, table.shape[1]), minlength=DIMS)
        chain.weights = adam("weights", chain.weights, slope + l2 * chain.weights, k)
        chain.bias = float(adam("bias", chain.bias, off.sum() + l2 * chain.bias, k))
        chain.trans = adam("trans", chain.trans, (joint - real) / scale + l2 * chain.trans, k)
        chain.start = adam("start", chain.start, (np.array([first.sum() - heads, heads]) - opening) / scale + l2 * chain.start, k)
    return chain


def _label(texts: list[str], toxic: np.ndarray, min_contexts: int, min_ratio: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All tokens with their tags, toxic documents' tied words being 1."""
    docs = [WORD.findall(t.lower()) for t in texts]
    contexts: tuple[set, set] = (set(), set())
    for words, y in zip(docs, toxic, strict=True):
        contexts[int(y)].update(zip(["", *words[:-1]], words, [*words[1:], ""], strict=True))
    counts: tuple[dict, dict] = ({}, {})
    for c, n in zip(contexts, counts, strict=True):
        for _, w, _ in c:
            n[w] = n.get(w, 0) + 1
    for n in counts:
        heads: dict[str, int] = {}
        for w, k in n.items():
            if len(w) > HEAD:
                heads[w[:HEAD] + "*"] = heads.get(w[:HEAD] + "*", 0) + k
        n.update(heads)
    base = (len(contexts[1]) + 1) / (len(contexts[0]) + 1)
    tied = {w for w, n in counts[1].items() if n >= min_contexts and n / (counts[0].get(w, 0) + 0.5) >= min_ratio * base}
    words = [w for d in docs for w in d]
    owner = np.repeat(toxic.astype(bool), [len(d) for d in docs])
    tags = np.fromiter((w in tied or (len(w) > HEAD and w[:HEAD] + "*" in tied) for w in words), bool, len(words)) & owner
    return words, tags.astype(np.int64), np.array([len(d) for d in docs], np.int64)


def _summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the document score sees: 1, log of the marginals' sum, log-odds of the highest, log of the token count."""
    total, top = np.zeros(len(counts)), np.full(len(counts), 1e-6)
    full = counts > 0
    at = (np.cumsum(counts) - counts)[full]
    if len(at):
        total[full] = np.add.reduceat(p, at)
        top[full] = np.clip(np.maximum.reduceat(p, at), 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(counts)), np.log(total + 1e-3), np.log(top / (1 - top)) / 4, np.log(counts + 1.0)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.0003, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [l2 * len(y)] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def _learn(texts: list[str], toxic: np.ndarray, min_contexts: int, min_ratio: float) -> Chain:
    """The chain from three quarters of the rows, the document score from the rest; few rows serve for both."""
    rest = np.array([zlib.crc32(t.encode()) % 4 == 0 for t in texts], bool)
    if min(rest.sum(), toxic[rest].sum(), toxic[~rest].sum()) < 10:
        rest = np.zeros(len(texts), bool)
    words, tags, counts = _label([t for t, r in zip(texts, rest, strict=True) if not r], toxic[~rest], min_contexts, min_ratio)
    chain = train(words, tags, counts)
    judge = np.flatnonzero(rest) if rest.any() else np.arange(len(texts))
    found = [WORD.findall(texts[i].translate(_FOLD)) for i in judge]
    counts = np.array([len(f) for f in found], np.int64)
    p = marginals(chain.emission([w for f in found for w in f]), counts, chain) if counts.sum() else np.zeros(0)
    if 0 < toxic[judge].sum() < len(judge):
        chain.whole = _logistic(_summary(p, counts), toxic[judge].astype(float))
    return chain


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_docs: int = MAX_TRAIN_DOCS, min_contexts: int = 5, min_ratio: float = 8.0) -> Chain:
    """A chain learned from labelled rows where `train_rows` (over the label table) holds.

    Of each class at most about `max_train_docs` rows are drawn by a hash of their key; the draw's keys, a set of
    that size, are broadcast and the chain is learned in one task. Rows with null text, key or label teach nothing.
    A key labelled twice counts twice. Without labelled rows the chain calls everything clean.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.lit(True) if train_rows is None else train_rows))
    sizes = {r[0]: r[1] for r in known.groupBy((F.col(label_col) == 1).alias("y")).count().collect()}
    share = F.when(F.col(label_col) == 1, min(1.0, max_train_docs / max(1, sizes.get(True, 0)))).otherwise(min(1.0, max_train_docs / max(1, sizes.get(False, 0))))
    drawn = known.where(F.pmod(F.xxhash64(id_col, F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_toxic"))
    rows = docs.join(F.broadcast(drawn), F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), "_toxic").where("text is not null").repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: texts[i])  # the same chain whatever the order of arrival
        c = _learn([texts[i] for i in order], np.array(toxic, bool)[order], min_contexts, min_ratio)
        texts.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (c.weights.astype(np.float32), np.array([c.bias]), c.trans, c.start, c.whole)], names=["w", "b", "t", "s", "d"])

    learned = rows.mapInArrow(learn, "w binary, b binary, t binary, s binary, d binary").first()
    if learned is None:
        return train([], np.zeros(0), np.zeros(0))
    w, b, t, s, d = learned
    return Chain(np.frombuffer(w, np.float32).astype(float), float(np.frombuffer(b)[0]), np.frombuffer(t).reshape(2, 2), np.frombuffer(s), np.frombuffer(d))


def score_texts(texts: list[str | None], chain: Chain, slice_chars: int = 500_000) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """Score and spans (start, end, chance; code points) of each text."""
    out: list[tuple[float, list[tuple[int, int, float]]]] = []
    first = 0
    while first < len(texts):
        size, end = 0, first
        while end < len(texts) and (end == first or size + len(texts[end] or "") <= slice_chars):
            size += len(texts[end] or "")
            end += 1
        part = [(t or "").translate(_FOLD) for t in texts[first:end]]
        found = [WORD.findall(t) for t in part]
        counts = np.array([len(f) for f in found], np.int64)
        words = [w for f in found for w in f]
        p = marginals(chain.emission(words), counts, chain) if words else np.zeros(0)
        ends = np.cumsum(counts)
        whole = np.where(counts > 0, 1 / (1 + np.exp(-np.clip(_summary(p, counts) @ chain.whole, -30, 30))), 0.0)
        for text, n, value, last in zip(part, counts.tolist(), whole.tolist(), ends.tolist(), strict=True):
            own, spans = p[last - n : last], []
            if n and own.max() >= 0.5:
                before = False
                for m, q in zip(WORD.finditer(text), own.tolist(), strict=True):
                    if q >= 0.5 and before:
                        spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], q))
                    elif q >= 0.5:
                        spans.append((m.start(), m.end(), q))
                    before = q >= 0.5
            out.append((value, spans))
        first = end
    return out


class _Fold(dict):
    """Lower case that keeps the number of code points, so offsets stay those of the text."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_FOLD = _Fold()


def score(docs: DataFrame, chain: Chain, text_col: str = "text", score_name: str = "toxic_score", spans_name: str = "toxic_spans") -> DataFrame:
    """The rows of `docs` with toxic_score double (0 to 1) and toxic_spans (start, end, p; code points) appended, under the names given.

    Null and empty texts score 0 without spans. Whole texts are read. Columns of these names are replaced.
    """
    docs = docs.drop(score_name, spans_name)
    shared = docs.sparkSession.sparkContext.broadcast(Chain(chain.weights, chain.bias, chain.trans, chain.start, chain.whole))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                found = score_texts(part.column(part.schema.get_field_index(text_col)).to_pylist(), shared.value)
                spans = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in found], span_type)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.float64()), spans], names=[*part.schema.names, score_name, spans_name])
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{score_name}` double, `{spans_name}` {SPAN}")
