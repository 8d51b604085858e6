"""Making readers of one text agree on its words: a word that some reports split in two is joined again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.operators.joins import shift_after_drop
from fovea.sources.shared import keep

DASH_OR_SPACE = r"[\s‐‑‒–—-]"


def _bare(label) -> F.Column:
    return F.regexp_replace(label, DASH_OR_SPACE, "")


def first_mismatch(words: DataFrame, text: Sequence[str], index: str, label: str) -> DataFrame:
    """text, index: the first word of each text whose label readers disagree on."""
    return words.groupBy(*text, index).agg(F.countDistinct(label).alias("_labels")).where("_labels > 1").groupBy(*text).agg(F.min(index).alias(index))


def join_split_words(words: DataFrame, fixations: DataFrame, who: str, text: Sequence[str], index: str, label: str) -> tuple[DataFrame, DataFrame]:
    """One pass: at each text's first mismatch, readers whose word and the next together spell another reader's word
    lose the second half; later words move up, and so do fixations. Fixations of the dropped half go to the joined word.
    """
    text = list(text)
    here = words.join(first_mismatch(words, text, index, label), [*text, index]).select(*text, who, F.col(index).alias("_at"), F.col(label).alias("_own"))
    longest = here.groupBy(*text).agg(F.max_by("_own", F.struct(F.length(_bare("_own")), "_own")).alias("_joined"))
    after = words.select(*text, who, (F.col(index) - 1).alias("_at"), F.col(label).alias("_next"))
    split = here.join(longest, text).join(after, [*text, who, "_at"]).where(_bare(F.concat("_own", "_next")) == _bare("_joined")).select(*text, who, "_at", "_joined")
    keys = [*text, who]
    relabelled = words.join(split, keys, "left").withColumn(label, F.when(F.col(index) == F.col("_at"), F.col("_joined")).otherwise(F.col(label))).drop("_at", "_joined")
    gone = split.select(*keys, (F.col("_at") + 1).alias(index))
    moved = fixations.join(split.select(*keys, "_at"), keys, "left").withColumn(index, F.when(F.col(index) > F.col("_at"), F.col(index) - 1).otherwise(F.col(index))).drop("_at")
    return shift_after_drop(relabelled, gone, keys, index), moved


def align(words: DataFrame, fixations: DataFrame, who: str, text: Sequence[str], index: str, label: str, passes: int = 10) -> tuple[DataFrame, DataFrame]:
    """Passes until no text disagrees; what still does after the last is an error that names some texts."""
    for _ in range(passes):
        left = first_mismatch(words, text, index, label).limit(5).collect()
        if not left:
            return words, fixations
        words, fixations = (keep(df) for df in join_split_words(words, fixations, who, text, index, label))
    left = first_mismatch(words, text, index, label).limit(5).collect()
    if left:
        raise ValueError(f"texts still disagree: {[tuple(r) for r in left]}")
    return words, fixations
