"""Language identification by words first, with backoff to ever shorter character n-grams.

Training counts words of labelled texts by language. A word seen at least `min_count` times is known and
scored by its log frequency in each language. An unseen word is scored by its character n-grams: of the
longest order at which the model knows any n-gram of the word, the mean of their log frequencies. The
language with the highest sum wins; the score is its share after a softmax.

Main cost: one pass over the texts in tasks of bounded memory. The model comes from a sample of at most
about `max_train_docs` labelled rows, so its size doesn't follow the table's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.llm.storage import give_back

_RUN = re.compile(r"[^\W\d_]+")  # letters, and number signs such as ½ that are no letters
LETTERS = r"\p{L}+"
_LETTERS = regex.compile(LETTERS)
UNKNOWN = "und"
MAX_TRAIN_DOCS = 8000
_CACHE = 50_000


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L) of the lower-cased text, in training and prediction alike."""
    runs = _RUN.findall(text.lower())
    return runs if "".join(runs).isalpha() else [w for run in runs for w in _LETTERS.findall(run)]


class Table:
    """Rows of numbers by key: one matrix and the keys' places in it, far smaller than an array for each key."""

    def __init__(self, rows: dict[str, np.ndarray], width: int):
        self.at = {key: k for k, key in enumerate(rows)}
        self.rows = np.array(list(rows.values()), np.float64).reshape(len(rows), width)

    def get(self, key: str) -> np.ndarray | None:
        k = self.at.get(key)
        return None if k is None else self.rows[k]


@dataclass
class Model:
    """Log frequencies by language of known words and of n-grams; takes dictionaries of arrays, holds them as tables."""

    langs: list[str]
    words: dict[str, np.ndarray] | Table
    grams: dict[str, np.ndarray] | Table
    orders: tuple[int, ...]

    def __post_init__(self) -> None:
        self.words, self.grams = (t if isinstance(t, Table) else Table(t, len(self.langs)) for t in (self.words, self.grams))
        self.forget()

    def forget(self) -> None:
        """Empties the cache of unseen words' scores."""
        self.seen: dict[str, int] = {}
        self.cache = np.zeros((_CACHE, len(self.langs)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "cache")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def _backoff(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for n in self.orders:
            hits = [k for k in (self.grams.at.get(marked[i : i + n]) for i in range(len(marked) - n + 1)) if k is not None]
            if hits:
                return self.grams.rows[hits].mean(axis=0)
        return np.zeros(len(self.langs))

    def of(self, word: str) -> np.ndarray:
        """Log frequencies by language."""
        known = self.words.get(word)
        if known is not None:
            return known
        k = self.seen.get(word)
        if k is not None:
            return self.cache[k]
        found = self._backoff(word)
        if len(word) <= 64:
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            k = self.seen[word] = len(self.seen)
            self.cache[k] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text)) if text else None
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        known = [(k, n) for k, n in ((self.words.at.get(word), n) for word, n in counts.items()) if k is not None]
        total = np.zeros(len(self.langs))
        if known:
            at, times = zip(*known, strict=True)
            total += np.array(times, np.float64) @ self.words.rows[list(at)]
        if len(known) < len(counts):
            for word, n in counts.items():
                if word not in self.words.at:
                    total += n * self.of(word)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, bound: int) -> DataFrame:
    """About `bound` labelled rows, chosen by a hash of their key; all of them if there are no more."""
    labelled = docs.where(train & F.col(lang_col).isNotNull())
    n = labelled.select(F.count(F.lit(1))).first()[0]
    if n > bound:
        labelled = labelled.where(F.pmod(F.xxhash64(id_col, F.lit("langid")), F.lit(1 << 20)) < F.lit(int((1 << 20) * bound / n)))
    return labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def fit(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS, min_count: int = 3, orders: tuple[int, ...] = (5, 4, 3, 2, 1)) -> Model:
    """Learns from rows where `train` holds and text and language are not null, at most about `max_train_docs` of them.

    Ties between languages go to the one first by name. Without any labelled row every prediction is "und".
    """
    rows = _sampled(docs, id_col, text_col, lang_col, F.lit(True) if train is None else train, max_train_docs)
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = words.where(F.length("word") <= 64).persist()
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = words.select("lang", "n", marked.alias("m"), F.explode(F.array(*map(F.lit, orders))).alias("order")).where(F.length("m") >= F.col("order"))
    grams = grams.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("m") - F.col("order") + 1), lambda i: F.substring(F.col("m"), i, F.col("order")))).alias("word"))
    grams = grams.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    known = [tuple(r) for r in words.where(F.col("n") >= min_count).collect()]
    pieces = [tuple(r) for r in grams.where(F.col("n") >= min_count).collect()]
    words.unpersist()
    langs = sorted({lang for lang, _, _ in pieces})
    order = {lang: k for k, lang in enumerate(langs)}

    def tables(counted: list[tuple]) -> dict[str, np.ndarray]:
        """Log frequency by language among keys of the same kind; a key unseen in a language counts as a tenth."""
        table: dict[str, np.ndarray] = {}
        totals: dict[int, np.ndarray] = {}
        for lang, key, n, kind in counted:
            table.setdefault((kind, key), np.zeros(len(langs)))[order[lang]] = n
            totals.setdefault(kind, np.ones(len(langs)))[order[lang]] += n
        return {key: np.log(np.maximum(n, 0.1)) - np.log(totals[kind]) for (kind, key), n in table.items()}

    words_known = tables([(lang, key, n, 0) for lang, key, n in known])
    return Model(langs, words_known, tables([(lang, key, n, len(key)) for lang, key, n in pieces]), tuple(sorted(orders, reverse=True)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The rows of `docs` with the language, lang_pred string, and score double (0 to 1) appended, under the names given.

    Null text, and text without a letter, gives "und" with score 0. Whole texts are read, however long. Columns of
    these names in `docs` are replaced.
    """
    docs = docs.drop(lang_name, score_name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                found = [scorer.predict(text.as_py()) for text in part.column(part.schema.get_field_index(text_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*part.schema.names, lang_name, score_name])
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{lang_name}` string, `{score_name}` double")


def accepted(min_score: float = 0.3, lang_name: str = "lang_pred", score_name: str = "score") -> Column:
    """A text is kept if it has letters and some language takes a fair share of the evidence; very short clean texts pass."""
    return (F.col(lang_name) != UNKNOWN) & (F.col(score_name) >= min_score)

