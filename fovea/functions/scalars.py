"""Column functions: dirty values, keys, flags, labels. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Universal part-of-speech tags of content words.
CONTENT_TAGS = ("PROPN", "NOUN", "VERB", "ADV", "ADJ")
# Characters that end a word broken over lines.
DASHES = "-‐‑‒–—"


def dirty_int(c: str) -> Column:
    """Text to integer; anything that is no number (such as '.') and null become 0. A fraction is cut off."""
    return F.coalesce(F.expr(f"try_cast(try_cast(`{c}` as double) as bigint)"), F.lit(0))


def dirty_float(c: str) -> Column:
    """Text to double; anything that is no number becomes null, NaN too."""
    return F.nullif(F.expr(f"try_cast(`{c}` as double)"), F.lit(float("nan")))


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def sentinel_to_null(c: str | Column, sentinel: float = -1.0) -> Column:
    """A test not taken is stored as the sentinel and read as null."""
    return F.nullif(nan_to_null(c), F.lit(sentinel))


def null_to_sentinel(c: str | Column, sentinel: float = -1.0) -> Column:
    return F.coalesce(nan_to_null(c), F.lit(sentinel))


def composite_key(*cols: str) -> Column:
    """Parts joined by '_'; a null part makes the key null, so rows can't fall together."""
    return F.concat(*[x for c in cols for x in (F.col(c).cast("string"), F.lit("_"))][:-1])


def moves_back(current: str, following: str) -> Column:
    """Whether the next fixation is to the left; false where either is missing."""
    return F.coalesce(F.col(following) < F.col(current), F.lit(False))


def moves_on(current: str, following: str) -> Column:
    return F.coalesce(F.col(following) > F.col(current), F.lit(False))


def first_pass_regression(progressive: str, regressions_out: str) -> Column:
    """1 or 0 for words first entered in reading order, null for all others."""
    return F.when(F.col(progressive) == 1, (F.col(regressions_out) >= 1).cast("double"))


def rate(part: str | Column, whole: str | Column) -> Column:
    """part / whole; null where that isn't a number."""
    return F.try_divide(F.col(part) if isinstance(part, str) else part, F.col(whole) if isinstance(whole, str) else whole)


def is_content_word(tag: str) -> Column:
    return F.coalesce(F.col(tag).isin(*CONTENT_TAGS), F.lit(False))


def strip_dashes(c: str) -> Column:
    return F.regexp_replace(c, f"[{DASHES}]+$", "")


def mapped(c: str, names: Mapping[str, str]) -> Column:
    """Names for codes; a code without one stays."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c)), F.col(c)) if pairs else F.col(c)


def years_and_months(years: str, months: str) -> Column:
    """Years as a fraction; null only if both are missing."""
    some = F.col(years).isNotNull() | F.col(months).isNotNull()
    return F.when(some, F.coalesce(F.col(years), F.lit(0)) + F.coalesce(F.col(months), F.lit(0)) / F.lit(12.0))


def star_count(p: str | Column) -> Column:
    """3, 2, 1 or 0 by p below .001, .01, .05; null p stays null."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, 3).when(p < 0.01, 2).when(p < 0.05, 1).when(p.isNotNull(), 0)


def stars(p: str | Column) -> Column:
    """'***', '**', '*' or 'ns'."""
    n = star_count(p)
    return F.when(n == 0, "ns").when(n.isNotNull(), F.repeat(F.lit("*"), n))


def signed_stars(p: str, a: str, b: str) -> Column:
    """The star count, negative where b wins over a, 0 on a tie."""
    return F.signum(F.col(a) - F.col(b)).cast("int") * star_count(p)


def batch_of(group: str) -> Column:
    """What stands before the first '_'."""
    return F.substring_index(group, "_", 1)


def combo_key(participant: str, batch: str, preview: str) -> Column:
    return F.concat_ws("_", F.substring_index(participant, "_", 1), F.col(batch).cast("int").cast("string"), F.col(preview).cast("string"))


def natural_key(c: str, width: int = 12) -> Column:
    """Sorts 'p2' before 'p10': every digit run is padded with zeros."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


def clipped(c: str | Column, top: float = 100.0) -> Column:
    """Into [0, top]; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), c)))


def half_of(item: str | Column) -> Column:
    """'odd' or 'even' by an integer item id."""
    item = F.col(item) if isinstance(item, str) else item
    return F.when(item % 2 == 1, "odd").otherwise("even")


def pair_name(prefix: str, paragraph: str, first: str, second: str | None = None) -> Column:
    """The column name of a per-text cell, as wide files carry it."""
    return F.concat_ws("_", F.lit(prefix), *(F.col(c).cast("string") for c in (paragraph, first, second) if c))


def parsed_pair(name: str) -> Column:
    """Struct (paragraph, i, j) from a per-text column name; j is null for single words."""
    found = F.regexp_extract_all(name, F.lit(r"_(.+?)_(\d+)(?:_(\d+))?$"), F.lit(0))
    whole = F.get(found, F.lit(0))
    pick = lambda g: F.nullif(F.regexp_extract(whole, r"_(.+?)_(\d+)(?:_(\d+))?$", g), F.lit(""))
    return F.struct(pick(1).alias("paragraph"), pick(2).cast("int").alias("i"), pick(3).cast("int").alias("j"))


def from_zero(df, *columns: str):
    """Places counted from one, counted from zero."""
    return df.withColumns({c: F.col(c) - 1 for c in columns})


def proxy_code(component: str, code: str, proxies: dict[str, str], of: str = "scriptural") -> Column:
    """The language code to look a distance up by: a proxy for the one component that lacks the language."""
    found = F.create_map(*[F.lit(x) for kv in proxies.items() for x in kv])[F.col(code)] if proxies else F.lit(None)
    return F.when(F.col(component) == of, F.coalesce(found, F.col(code))).otherwise(F.col(code))


def level_code(c: str, high: str = "Adv", low: str = "Ele") -> Column:
    """1 for the advanced text, 0 for the elementary; null for others."""
    return F.when(F.col(c) == high, 1).when(F.col(c) == low, 0)


def proficiency(df, who: str, scores: list[str], absent: list[str], digits: int = 5, missing: float = -1.0):
    """A distinct row a participant: scores rounded, absent tests added, gaps as the sentinel."""
    rows = df.select(who, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in scores], *[F.lit(None).cast("double").alias(c) for c in absent]).distinct()
    return rows.select(who, *[F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(missing)).alias(c) for c in [*scores, *absent]])
